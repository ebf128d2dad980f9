"""Reports of checks, lock files and catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.sources.bundles import Bundle
from strataloom.sources.sinks import carried_over

#: Findings of each rule that the written report shows; the table beside it has all.
SHOWN = 5


def findings(rules: dict[str, tuple[str, DataFrame]], key: str, message: str) -> DataFrame:
    """(rule, severity, key, message) of all rules, each a relation of what it found; severity is problem or warning."""
    wrong = {s for s, _ in rules.values()} - {"problem", "warning"}
    if wrong:
        raise ValueError(f"unknown severities {sorted(wrong)}")
    rows = [df.select(F.lit(name).alias("rule"), F.lit(s).alias("severity"), F.col(key).cast("string").alias("key"), F.col(message).cast("string").alias("message")) for name, (s, df) in rules.items()]
    return reduce(DataFrame.unionByName, rows)


def report(spark: SparkSession, found: DataFrame, metrics: dict[str, float], root: str, previous: DataFrame | None = None) -> int:
    """Write findings as a bundle with a Markdown summary beside it; 1 if there is a problem, else 0.

    The table has a column ``decision``, carried over from ``previous`` by rule and
    key.  The summary has the metrics, and for each rule its count and the first
    SHOWN keys: a few rows a rule come to the driver, whatever was found.
    """
    named = found.withColumn("id", F.concat_ws("|", "rule", "key"))
    before = previous if previous is not None else spark.createDataFrame([], "id string, decision string")
    bundle = Bundle(spark, root)
    bundle.commit({"findings": carried_over(named, before.dropDuplicates(["id"]), "id", "decision")})
    place = F.row_number().over(Window.partitionBy("rule").orderBy("key", "message"))
    counts = {(r["severity"], r["rule"]): r["n"] for r in found.groupBy("severity", "rule").agg(F.count("*").alias("n")).collect()}
    first = found.withColumn("i", place).filter(F.col("i") <= SHOWN).orderBy("rule", "i").collect()
    told = ["# Report", "", *[f"- {name}: {value:g}" for name, value in sorted(metrics.items())]]
    for severity in ("problem", "warning"):
        for (s, rule), n in sorted(counts.items()):
            if s == severity:
                told += ["", f"## {severity}: {rule} ({n})", "", *[f"- `{r['key']}` {r['message'] or ''}".rstrip() for r in first if r["rule"] == rule]]
    spark.createDataFrame([("\n".join(told) + "\n",)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/summary")
    return int(any(s == "problem" for s, _ in counts))


def locked(lock: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A lock file (source, sha256, bytes, url) with what was fetched written over it, and the sources whose content is not what is locked.

    A source that the lock does not have is taken up; one that was not fetched
    stays; one with another digest keeps its locked row and is told.
    """
    columns = ["source", "sha256", "bytes", "url"]
    one = fetched.groupBy("source").agg(F.max_by(F.struct(*columns[1:]), F.struct("fetched", "sha256")).alias("r")).select("source", "r.*")
    both = one.join(lock.select("source", F.col("sha256").alias("known")), "source", "left")
    differ = both.filter(F.col("known") != F.col("sha256"))
    fresh = both.filter(F.col("known").isNull() | (F.col("known") == F.col("sha256"))).select(*columns)
    kept = lock.select(*columns).join(fresh.select("source"), "source", "left_anti")
    return kept.unionByName(fresh), differ.select("source", "known", "sha256")


def catalogue(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of files that each hold a JSON array of objects, and (file, error) of files that do not or that repeat a key."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = texts.withColumn("rows", F.from_json("value", f"array<struct<{schema}>>"))
    broken = parsed.filter(F.col("rows").isNull() | ~F.ltrim("value").startswith("[")).select("file", F.lit("not an array of objects").alias("error"))
    rows = parsed.filter(F.col("rows").isNotNull() & F.ltrim("value").startswith("[")).select("file", F.inline("rows"))
    twice = rows.groupBy(key).agg(F.count("*").alias("n"), F.max("file").alias("file")).filter(F.col("n") > 1)
    return rows, broken.unionByName(twice.select("file", F.concat(F.lit("repeated key "), F.col(key).cast("string")).alias("error")))


def indexed(rows: DataFrame, key: str, *others: str) -> dict[str, DataFrame]:
    """A keyed table by its key and by each other column: rows, and (column, key) for look-ups the other way; a repeated key is an error."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"repeated keys: {[r[0] for r in twice]}")
    second = {o: rows.filter(F.col(o).isNotNull()).select(o, key) for o in others}
    return {key: rows, **second}

