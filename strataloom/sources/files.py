"""Readers for directories of documents, registries, page texts and raw volumes."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import durable


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one of the schema where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def documents(spark: SparkSession, path: str, schema: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """One JSON object a file, in one folder a kind: (good rows, errors).

    Broken files, rows whose key is not the file's name or whose kind is not the
    folder's, and repeated keys become error rows; the scan goes on.
    """
    full = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    read = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
    rows = read.json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    stem = F.regexp_extract("_file", r"([^/]+)\.json$", 1)
    folder = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    rules = [F.when(F.col("_corrupt").isNotNull() | F.col(key).isNull(), "unreadable"), F.when(F.col(key) != stem, "key is not the file name")]
    if "kind" in full.names:
        rules.append(F.when(F.col("kind") != folder, "kind is not the folder"))
    judged = durable(rows.withColumn("_error", F.coalesce(*rules)), "documents")  # read by four plans
    twice = judged.filter(F.col("_error").isNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    good = judged.filter(F.col("_error").isNull()).join(twice, key, "left_anti")
    errors = judged.filter(F.col("_error").isNotNull()).select("_file", F.col("_error").alias("error"))
    repeated = judged.filter(F.col("_error").isNull()).join(twice, key, "left_semi").select("_file", F.lit("key is not unique").alias("error"))
    return good.drop("_corrupt", "_error", "_file"), errors.unionByName(repeated)


def registry(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Tables of a registry in YAML: a mapping of table names to lists of rows or mappings of ids to rows.

    Anchors and aliases work as in YAML; ``!join [a, b]`` joins strings.
    """
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!join", lambda loader, node: "".join(map(str, loader.construct_sequence(node, deep=True))))
    out = {}
    for name, rows in (yaml.load(text, Loader) or {}).items():
        if isinstance(rows, dict):
            rows = [{"id": k, **v} for k, v in rows.items() if isinstance(v, dict)]
        if isinstance(rows, list) and rows and isinstance(rows[0], dict):
            out[name] = _frame(spark, rows)
    return out


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = sorted({k for r in rows for k in r})
    texts = [tuple(None if r.get(n) is None else r[n] if isinstance(r[n], str) else json.dumps(r[n]) for n in names) for r in rows]
    return spark.createDataFrame(texts, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def registry_lines(lines: DataFrame, least: dict[str, int]) -> DataFrame:
    """(section, key, value) of ``section: key = value`` lines; fails where a section has fewer than ``least`` rows."""
    got = lines.select(*[F.regexp_extract("value", r"^\s*([\w-]+):\s*([\w.-]+)\s*=\s*(.*)$", i).alias(n) for i, n in enumerate(("section", "key", "value"), 1)]).filter("section <> ''")
    have = {r["section"]: r["count"] for r in got.groupBy("section").count().collect()}
    short = {s: n for s, n in least.items() if have.get(s, 0) < n}
    if short:
        raise ValueError(f"too few rows: {short}")
    return got


def discovered(spark: SparkSession, path: str, kinds: dict[str, str], junk: str) -> DataFrame:
    """Files below path with kind, side and stem from their names; names like ``junk`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    kind = F.coalesce(*[F.when(F.col("name").rlike(p), F.lit(k)) for k, p in kinds.items()], F.lit("other"))
    return files.filter(~F.col("name").rlike(junk)).select("path", "length", kind.alias("kind"), *side_and_stem(F.regexp_replace("name", r"\.[^.]*$", "")))


def side_and_stem(name: Column) -> list[Column]:
    """The side token that ends a name (l or r), and what stands before it."""
    side = F.lower(F.regexp_extract(name, r"(?i)[-_. ](l|r|left|right)$", 1))
    return [F.when(side != "", F.left(side, F.lit(1))).alias("side"), F.regexp_replace(name, r"(?i)[-_. ](l|r|left|right)$", "").alias("stem")]


def volume(spark: SparkSession, path: str, dims: tuple[int, int, int], dtype: str) -> DataFrame:
    """Non-zero cells (i, j, k, value) of raw gzipped volumes in x-fastest order; a wrong length is an error."""
    nx, ny, nz = dims
    size = np.dtype(dtype).itemsize * nx * ny * nz

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = gzip.decompress(content.as_py())
                if len(raw) != size:
                    raise ValueError(f"{len(raw)} bytes, not {size}")
                flat = np.frombuffer(raw, dtype)
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (at % nx, at // nx % ny, at // (nx * ny))] + [pa.array(flat[at].astype(np.float64))], ["i", "j", "k", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "i int, j int, k int, value double")


def text_lines(words: DataFrame, page: str, tolerance: float) -> DataFrame:
    """Words (page, x, y, text) to lines (page, line from 0, text), each read from left to right.

    Words are taken in bands of ``tolerance`` from the top, in a band from the
    left; a word no farther than ``tolerance`` from the first word of the open
    line joins it.  Words without a place or text are left out.
    """
    whole = words.dropna(subset=["x", "y", "text"]).select(page, F.col("x").cast("double"), F.col("y").cast("double"), "text")
    kind = whole.schema[page].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:  # the words of one page
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        text = table.column("text").to_pylist()
        lines, top = [], None
        for i in sorted(range(len(text)), key=lambda i: (round(y[i] / tolerance), x[i], y[i], text[i])):
            if top is None or abs(y[i] - top) > tolerance:
                lines.append([])
                top = y[i]
            lines[-1].append(i)
        joined = [" ".join(text[i] for i in sorted(held, key=lambda i: x[i])) for held in lines]
        name = table.column(page).combine_chunks().take(pa.array([0] * len(lines), pa.int64()))
        return pa.table({page: name, "line": pa.array(range(len(lines)), pa.int64()), "text": pa.array(joined, pa.string())})

    return whole.groupBy(page).applyInArrow(run, f"`{page}` {kind}, line long, text string")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Page lines without junk: fewer than three letters, or more than 30 % signs."""
    letters = F.length(F.regexp_replace("value", "[^A-Za-z]", ""))
    signs = F.length(F.regexp_replace("value", r"[A-Za-z0-9\s]", ""))
    return lines.filter((letters >= 3) & (signs <= 0.3 * F.length("value")))


def rejoined(lines: DataFrame, lexicon: DataFrame, page: str, line: str) -> DataFrame:
    """Lines (``value``) with words broken at their ends joined, where the whole word is in ``lexicon`` (word, lower case).

    The line after it gives all it has to the line that ends in the first half
    and is empty from then on, so it joins none itself.
    """
    w = Window.partitionBy(page).orderBy(line)
    after = F.ltrim(F.coalesce(F.lead("value").over(w), F.lit("")))
    head, tail = F.regexp_extract("value", r"(?U)(\w+)[-\u2014\u2013]$", 1), F.regexp_extract("__after", r"(?U)^(\w+)", 1)
    broken = lines.withColumn("__after", after).withColumn("__word", F.when((head != "") & (tail != ""), F.lower(F.concat(head, tail))))
    known = lexicon.select(F.col("word").alias("__word")).distinct().withColumn("__known", F.lit(True))
    met = broken.join(known, "__word", "left").withColumn("__joins", F.coalesce("__known", F.lit(False)))
    # in a run of lines that could join, every other one does
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(page, "__joins").orderBy(line))
    place = F.row_number().over(Window.partitionBy(page, "__joins", "__run").orderBy(line))
    taken = met.withColumn("__run", run).withColumn("__joins", F.col("__joins") & (place % 2 == 1))
    gone = F.coalesce(F.lag("__joins").over(w), F.lit(False))
    value = F.when(gone, F.lit("")).when(F.col("__joins"), F.concat(F.regexp_replace("value", r"[-\u2014\u2013]$", ""), "__after")).otherwise(F.col("value"))
    return taken.withColumn("value", value).select(*lines.columns)


def tsv(spark: SparkSession, paths: list[str], columns: list[str], header: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of tab-separated files (with their file's place in ``paths`` and line number), and lines with too few fields.

    The first ``header`` lines of each file are left out, as are empty lines;
    fields beyond ``columns`` are dropped; a missing file has no rows.
    """
    parts = []
    for i, path in enumerate(paths):
        if exists(spark, path):
            # a file is one text, so its lines keep their numbers
            lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
            parts.append(lines.filter((F.col("line") >= header) & (F.trim("text") != "")).withColumn("file", F.lit(i)))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) + ", file int, line int"), spark.createDataFrame([], "file int, line int, text string")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("fields", F.split("text", "\t"))
    long = F.size("fields") >= len(columns)
    good = rows.filter(long).select(*[F.trim(F.get("fields", F.lit(i))).alias(c) for i, c in enumerate(columns)], "file", "line")
    return good, rows.filter(~long).select("file", "line", "text")


def multimap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the distinct values of each key, in the order in which they first come."""
    first = rows.groupBy(key, value).agg(F.min(F.struct("file", "line")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key: by file, then by line."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("file", "line")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


#: Fixed value (inventory rows STR27 and SRC19): the line that opens a page: book, printed page, page of the file.
PAGE = r"⟦(\w+) p\.([0-9]+) \| pdf ([0-9]+)⟧"


def pages(texts: DataFrame, text: str) -> DataFrame:
    """A row for each page of texts with page marks: the other columns, book, printed, pdf and body.

    A mark stands at the beginning of a line and its page runs to the next one;
    what comes before the first mark belongs to no page.  A text without marks has
    none.
    """
    marks = F.regexp_extract_all(F.col(text), F.lit(rf"(?m)^{PAGE}$"), F.lit(0))
    bodies = F.slice(F.split(F.col(text), rf"(?m)^{PAGE}$\n?"), 2, F.greatest(F.size(marks), F.lit(0)))
    rows = texts.withColumn("__p", F.explode(F.arrays_zip(marks.alias("mark"), bodies.alias("body"))))
    part = lambda g: F.regexp_extract(F.col("__p.mark"), PAGE, g)
    rest = [c for c in texts.columns if c != text]
    return rows.select(*rest, part(1).alias("book"), part(2).cast("int").alias("printed"), part(3).cast("int").alias("pdf"), F.regexp_replace(F.col("__p.body"), r"\n\z", "").alias("body"))
