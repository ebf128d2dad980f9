"""Candidate search for record linkage by blocks."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators import qgrams
from strataloom.session import ship


def _top(rows: DataFrame, q: str, order: list, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(q).orderBy(*order))
    return rows.withColumn("__r", rank).filter(F.col("__r") <= top).drop("__r")


def exact_then_fuzzy(asked: DataFrame, keys: DataFrame, q: str, k: str, block: int | None, most: int, least: int, top: int) -> DataFrame:
    """(q, k, d): equal keys, or for those asked without one and of ``least`` characters, keys within ``most`` edits.

    With ``block``, only keys with the same first characters are looked at; without,
    all keys, by their q-grams.  Null strings match nothing.
    """
    exact = asked.join(keys, F.col(q) == F.col(k)).withColumn("d", F.lit(0))
    rest = asked.join(exact.select(q), q, "left_anti").filter(F.length(q) >= least)
    if block is None:
        near = qgrams.alike(rest, keys, q, k, edits=most).select(q, k, F.col("errors").alias("d"))
    else:
        near = rest.withColumn("__b", F.left(F.col(q), F.lit(block))).join(keys.withColumn("__b", F.left(F.col(k), F.lit(block))), "__b").filter(F.abs(F.length(q) - F.length(k)) <= most)
        near = near.withColumn("d", F.levenshtein(q, k)).filter(F.col("d") <= most).select(q, k, "d")
    return _top(exact.select(q, k, "d").unionByName(near), q, [F.col("d"), F.col(k)], top)


def ratio_candidates(asked: DataFrame, keys: DataFrame, q: str, k: str, cutoff: float, top: int) -> DataFrame:
    """(q, k, ratio) by twice the length of matching blocks over both lengths, for all pairs that can reach the cutoff.

    Matching blocks are characters in common, so pairs meet by those: at least
    cutoff / 2 of both lengths, and of q alone at least cutoff / (2 - cutoff), since
    that is how short the other can be.  Then come the blocks, with the key as first
    and the asked as second sequence, as ``get_close_matches`` has them.  Null and
    empty strings match nothing.
    """
    ship(asked.sparkSession)
    few = F.ceil(F.length(q) * (cutoff / (2 - cutoff)) - 1e-9)
    both = F.ceil((F.length(q) + F.length(k)) * (cutoff / 2) - 1e-9)
    pairs = qgrams.candidates(asked.filter(F.length(q) > 0), keys, q, k, F.lit(1), few, both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, last = difflib.SequenceMatcher(None), None
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(q).to_pylist(), batch.column(k).to_pylist()):
                if a != last:
                    match.set_seq2(a)
                    last = a
                match.set_seq1(b)
                if match.real_quick_ratio() >= cutoff and match.quick_ratio() >= cutoff and (ratio := match.ratio()) >= cutoff:
                    rows.append((a, b, ratio))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], [q, k, "ratio"])

    return _top(pairs.mapInArrow(run, f"{q} string, {k} string, ratio double"), q, [F.desc("ratio"), F.col(k)], top)
