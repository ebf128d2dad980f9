"""Bundles of tables that are written whole or not at all.

A bundle is a folder with a manifest.  Outputs, and where asked each value of
their partition columns, are written aside under the fingerprint of their rows,
and only then one rename puts the new manifest in the place of the old one.  A
reader follows the manifest, so it sees the old bundle or the new one; a run that
stops halfway leaves files that no manifest names, which ``prune`` removes.  What
did not change is named again and not written.

All file work goes through Hadoop's file systems, so a bundle lies wherever Spark
can write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import numbering
from strataloom.sources.sinks import GateError

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Entry:
    """One written part of a bundle: its output, partition values, rows, fingerprint and folder (below the root)."""

    output: str
    part: tuple[tuple[str, str | None], ...]
    rows: int
    fingerprint: str
    path: str


def fingerprints(rows: DataFrame, *by: str) -> DataFrame:
    """(by, rows, fingerprint): a digest of the rows of each group that their order and their cut into files do not change."""
    each = F.struct(*[F.col(c).cast("string").alias(c) if t == "void" else F.col(c) for c, t in sorted(rows.dtypes)])
    told = F.to_json(each, {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(told, F.lit(salt)).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    names = F.lit(",".join(sorted(f"{c}:{t}" for c, t in rows.dtypes)))
    digest = F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums, F.max(names)), 256)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), digest.alias("fingerprint"))


class Bundle:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join(parts))

    def entries(self) -> list[Entry]:
        """What the manifest names; nothing where there is none."""
        at = self._path(self.root, MANIFEST)
        if not self._fs.exists(at):
            return []
        text = "".join(r[0] for r in self.spark.read.text(str(at.toString()), wholetext=True).collect())
        return [Entry(e["output"], tuple(map(tuple, e["part"])), e["rows"], e["fingerprint"], e["path"]) for e in json.loads(text)["entries"]]

    def read(self, output: str, **part: str) -> DataFrame:
        """An output, or those parts of it with these values."""
        paths = [f"{self.root}/{e.path}" for e in self.entries() if e.output == output and part.items() <= dict(e.part).items()]
        if not paths:
            raise FileNotFoundError(f"{self.root} has no {output} {part or ''}")
        return self.spark.read.parquet(*paths)

    def plan(self, outputs: dict[str, DataFrame], by: dict[str, list[str]] | None = None) -> list[tuple[str, Entry]]:
        """(action, entry) of a commit: write, keep or retire.  One pass over each output; one row for each part comes back."""
        before = {(e.output, e.part): e for e in self.entries()}
        found = []
        for name, rows in outputs.items():
            keys = (by or {}).get(name, [])
            for r in fingerprints(rows, *keys).collect():
                part = tuple((k, None if r[k] is None else str(r[k])) for k in keys)
                old = before.pop((name, part), None)
                path = f"{name}/{r['fingerprint'][:32]}"
                same = old is not None and old.fingerprint == r["fingerprint"] and self._fs.exists(self._path(self.root, old.path))
                found.append(("keep", old) if same else ("write", Entry(name, part, r["rows"], r["fingerprint"], path)))
        return found + [("retire", e) for e in before.values()]

    def commit(self, outputs: dict[str, DataFrame], gates: dict[str, DataFrame] | None = None, by: dict[str, list[str]] | None = None) -> dict[str, int]:
        """Write the bundle if every gate is empty; counts of parts written, kept and retired.

        A gate is a relation of violations.  They are looked at before anything is
        written.  Outputs that are not given are retired: the bundle is what is
        given.  Nothing is written, the manifest neither, if nothing changed.
        """
        for name, violations in (gates or {}).items():
            some = violations.limit(5).collect()
            if some:
                raise GateError(f"{name}: not written: {some}")
        plan = self.plan(outputs, by)
        for action, entry in plan:
            if action == "write":
                rows = outputs[entry.output]
                for column, value in entry.part:
                    rows = rows.filter(F.col(column).cast("string").eqNullSafe(F.lit(value)))
                rows.write.mode("overwrite").parquet(f"{self.root}/{entry.path}")
        if any(action != "keep" for action, _ in plan) or not self._fs.exists(self._path(self.root, MANIFEST)):
            self._publish([e for action, e in plan if action != "retire"])
        return {a: sum(x == a for x, _ in plan) for a in ("write", "keep", "retire")}

    def _publish(self, entries: list[Entry]) -> None:
        aside, at = self._path(self.root, f".{MANIFEST}-{uuid.uuid4().hex}"), self._path(self.root, MANIFEST)
        told = [{"output": e.output, "part": e.part, "rows": e.rows, "fingerprint": e.fingerprint, "path": e.path} for e in sorted(entries, key=lambda e: (e.output, str(e.part)))]
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps({"entries": told}, indent=1).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        overwrite[0] = self._hadoop.Options.Rename.OVERWRITE
        context.rename(aside, at, overwrite)  # one step: readers see the old manifest or the new one

    def missing(self) -> list[Entry]:
        """Entries whose folder is not there."""
        return [e for e in self.entries() if not self._fs.exists(self._path(self.root, e.path))]

    def prune(self) -> list[str]:
        """Delete what the manifest does not name, and say what; refuse if something that it names is missing."""
        gone = self.missing()
        if gone:
            raise FileNotFoundError(f"named and missing: {[e.path for e in gone]}")
        named = {e.path for e in self.entries()}
        deleted = []
        for top in self._fs.listStatus(self._path(self.root)):
            name = top.getPath().getName()
            below = [f"{name}/{x.getPath().getName()}" for x in self._fs.listStatus(top.getPath())] if top.isDirectory() else []
            stale = [p for p in below if p not in named] if top.isDirectory() else [name] if name != MANIFEST else []
            whole = top.isDirectory() and len(stale) == len(below)
            for p in [name] if whole else stale:
                self._fs.delete(self._path(self.root, p), True)
            deleted += stale or ([name] if whole else [])
        return sorted(deleted)


def upserted_in_order(old: DataFrame, new: DataFrame, key: str, place: str, batch: str) -> DataFrame:
    """old with new written over it: of rows with one key the one of the largest ``batch`` in new counts, in the place of the first.

    ``place`` numbers old's rows; keys that old does not have follow in order of
    their first batch, then key.
    """
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in (key, batch)]), batch).alias("__row"), F.min(batch).alias("__first"))
    held = [c for c in old.columns if c not in (key, place)]
    both = old.join(last, key, "full")
    taken = [F.when(F.col("__row").isNotNull(), F.col(f"__row.{c}")).otherwise(F.col(c)).alias(c) for c in held]
    kept = both.filter(F.col(place).isNotNull()).select(key, place, *taken)
    fresh = both.filter(F.col(place).isNull()).select(key, "__first", *taken)
    most = old.agg(F.coalesce(F.max(place), F.lit(-1)).alias("__most"))
    ranked = numbering.numbered(fresh, ["__first", key], "__r").crossJoin(F.broadcast(most))  # one row
    placed = ranked.withColumn(place, (F.col("__most") + 1 + F.col("__r")).cast(old.schema[place].dataType))
    return kept.unionByName(placed.select(key, place, *held))


def reusable(wanted: DataFrame, records: DataFrame, key: str, fingerprint: str, artefacts: DataFrame | None = None, forced: bool = False) -> DataFrame:
    """wanted with ``reuse``: whether a record of the same key and fingerprint is there, with its artefact (``path``), and not forced."""
    have = records.select(key, fingerprint, *(["path"] if artefacts is not None else []))
    if artefacts is not None:
        have = have.join(artefacts.select("path").distinct(), "path", "left_semi").drop("path")
    marked = wanted.join(have.distinct().withColumn("__have", F.lit(True)), [key, fingerprint], "left")
    return marked.withColumn("reuse", F.coalesce("__have", F.lit(False)) & ~F.lit(forced)).select(*wanted.columns, "reuse")


def one_file_each(rows: DataFrame, key: str, path: str) -> None:
    """A folder with one JSON file for each value of ``key``, as authored documents are kept; the key stays in the document too."""
    rows.withColumn("__key", F.col(key)).withColumnRenamed("__key", "key").repartition("key").write.mode("overwrite").partitionBy("key").json(path)
