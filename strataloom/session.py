"""Session settings, shared storage for cut lineage, and shipping of the package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strataloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only where that
    is unset, as in local tests, a temporary folder of this machine is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", named)
        context.setCheckpointDir(named)
    return named


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strataloom/{spark.sparkContext.applicationId}"


#: Tables written since each open scope began, innermost last.
_SCOPES: list[list[DataFrame]] = []
#: The setting by which Spark removes shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The plan above starts from files: losing an executor costs no more than the
    tasks it ran, and the columns that a later step leaves out are not read.
    The shuffle files of the step go when the write ends, since nothing but that
    write reads them.  The table belongs to the innermost open ``scope``, or else
    stays until its owner discards it.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_path = path
    if _SCOPES:
        _SCOPES[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that durable() wrote, when all that was made of them is written too."""
    for table in tables:
        context = table.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(table._durable_path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope() -> Iterator[Callable[..., None]]:
    """Own the tables that durable() writes inside; the function given ends them, but for those named.

    Only tables of this scope are deleted, so results that other calls in the
    same application still read are left alone.  Those kept, and all of them if
    the function is not called, pass to the scope around this one.
    """
    made: list[DataFrame] = []

    def end(*keep: DataFrame) -> None:
        paths = {t._durable_path for t in keep}
        discard(*(t for t in made if t._durable_path not in paths))
        made[:] = keep

    _SCOPES.append(made)
    try:
        yield end
    finally:
        _SCOPES.pop()
        if _SCOPES:
            _SCOPES[-1].extend(made)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="strataloom-"), "strataloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
