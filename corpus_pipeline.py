"""Five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller
writes and reads again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontamination, jaccard, packing, quality, templates
from strataloom.session import discard, durable, scope
from strataloom.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that fail the base limits or a rule learned from the labels."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop recurring lines; a document that had words and has none left goes, and n_chars follows the text."""
    done = templates.strip(docs)
    kept = done.filter(~(F.col("had_words") & (F.col("lines_dropped") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones: that with the smallest doc_id."""
    return jaccard.distinct_documents(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences of at most 1024."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: The rules are learned and the tokens come from a vocabulary file, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir, each written and read again.

    Tables that a stage made on its way go when its result is written, and a
    stage's result when the next one is; no table of another call is touched.
    """
    docs = table(spark, sf_dir, "documents")
    own = []
    for name, stage in STAGES[:-1]:
        with scope() as end:
            docs = durable(stage(spark, docs, sf_dir), name)
            end(docs)
        discard(*own)
        own = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
