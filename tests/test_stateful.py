"""Streams with state, stopped and started again, against the same over the whole table; rasters as a data source; plug-ins."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import plugins
from strataloom.plans import plugins as plans
from strataloom.plans import registry
from strataloom.sources import rasters, volumes
from strataloom.streaming import stateful

SF = "/root/testdata/sf0.001"


def dealt(spark, folder, rows, name):
    rows.coalesce(1).write.mode("append").parquet(str(folder / name))


def run(spark, make, folder, out, checkpoint):
    """One run over the files that are there: it stops by itself, and a later one goes on from its checkpoint."""
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    q = make(live).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)


@pytest.fixture
def halves(spark):
    """Events in two halves by time with some rows out of order in each, and one far later that ends all waiting."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    e = e.filter("event_id < 400")
    middle = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    end = e.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 60 days"), "event_id": F.lit(10**6).cast("long"), "user_id": F.lit(-1).cast("long")})
    return e, e.filter(F.col("event_id") <= middle), e.filter(F.col("event_id") > middle), end


def test_debounce_after_a_restart(spark, tmp_path, halves):
    whole, early, late, end = halves
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    pause = 3 * 3600 * 1000
    make = lambda live: stateful.debounced(live, pause, "1 hour")
    dealt(spark, source, early, "a")
    run(spark, make, source, out, checkpoint)
    half = spark.read.parquet(str(out)).count() if list(out.glob("*.parquet")) else 0
    dealt(spark, source, late, "b")
    run(spark, make, source, out, checkpoint)
    dealt(spark, source, end, "c")
    run(spark, make, source, out, checkpoint)
    got = {tuple(r) for r in spark.read.parquet(str(out)).select("user_id", "event_id", "value").collect()}
    want = {tuple(r) for r in stateful.debounced_table(whole, pause).select("user_id", "event_id", "value").collect()}
    assert got - {r for r in got if r[0] == -1} == want and 0 < half < len(want) < whole.count()


def test_join_of_two_streams_after_a_restart(spark, tmp_path, halves):
    whole, early, late, end = halves
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    make = lambda live: stateful.followed(live.filter("event_type = 'click'"), live.filter("event_type = 'purchase'"), "2 days", "1 hour")
    for part, name in ((early, "a"), (late, "b"), (end, "c")):
        dealt(spark, source, part, name)
        run(spark, make, source, out, checkpoint)
    got = sorted(map(tuple, spark.read.parquet(str(out)).collect()))
    want = sorted(map(tuple, make(whole).collect()))
    assert got == want and want


def nifti(dims, affine, kind=4, values=None):
    """A file of whole numbers with this matrix."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *dims, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, kind)
    struct.pack_into("<4f", head, 76, 1.0, *np.linalg.norm(affine[:3, :3], axis=0))
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype(rasters.TYPES[kind]).ravel(order="F").tobytes()


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    one = np.diag([2.0, 2.0, 2.0, 1.0])
    two = np.array([[0, 0, -0.5, 9.0], [0.5, 0, 0, -3.0], [0, -0.5, 0, 4.0], [0, 0, 0, 1.0]])
    three = np.diag([1.0, 1.0, -1.25, 1.0])
    (tmp_path / "in").mkdir()
    for name, dims, affine, kind in (("mask_left.nii", (3, 4, 40), one, 4), ("turned.nii", (6, 5, 4), two, 4), ("deep_r.nii.gz", (2, 3, 30), three, 16)):
        content = nifti(dims, affine, kind, rng.integers(0, 4, dims))
        (tmp_path / "in" / name).write_bytes(gzip.compress(content) if name.endswith("gz") else content)
    (tmp_path / "in" / "._mask_left.nii").write_bytes(b"junk")
    return tmp_path / "in"


def test_rasters_as_a_data_source(spark, folder):
    volumes.register(spark)
    uri = f"file://{folder}"
    df = spark.read.format("rasters").option("planes", 8).load(uri)
    cells = lambda rows: sorted((r["file"].rsplit("/", 1)[-1], r["i"], r["j"], r["k"], round(r["x"], 4), round(r["y"], 4), round(r["z"], 4), r["value"]) for r in rows)
    want = cells(r for name in ("mask_left.nii", "turned.nii", "deep_r.nii.gz") for r in rasters.nifti(spark, str(folder / name)).collect())
    assert cells(df.collect()) == want and df.rdd.getNumPartitions() == 5 + 1 + 4
    some = df.filter("k between 17 and 20")
    assert cells(some.collect()) == [c for c in want if 17 <= c[3] <= 20]
    # slabs 16 to 23 of the first file; none of the second; two of the third, whose planes run down
    assert some.rdd.getNumPartitions() == 1 + 2
    assert df.filter("k = 1000").count() == 0 and df.filter("i = 1 and k in (2, 3)").count() == sum(c[1] == 1 and c[3] in (2, 3) for c in want)
    (folder / "short.nii").write_bytes(nifti((4, 4, 4), np.eye(4), 4, np.ones((4, 4, 4)))[:-5])
    with pytest.raises(Exception, match="short.nii"):
        spark.read.format("rasters").load(f"file://{folder}/short.nii").count()


def test_discovery_by_first_bytes(spark, folder):
    (folder / "notes.txt").write_text("x" * 100_000)
    (folder / "raw.gz").write_bytes(gzip.compress(b"y" * 500_000))
    got = {r["path"].rsplit("/", 1)[-1]: r for r in volumes.discovered(spark, f"file://{folder}").collect()}
    assert {k: (r["kind"], r["side"], r["stem"], r["resolution"]) for k, r in got.items()} == {
        "mask_left.nii": ("label", "l", "mask", "2"),
        "turned.nii": ("label", None, "turned", "0.5"),
        "deep_r.nii.gz": ("volume", "r", "deep", "1.08"),
        "notes.txt": ("other", None, "notes", None),
        "raw.gz": ("gzip", None, "raw", None),
    }
    assert got["turned.nii"]["dims"] == [6, 5, 4] and max(r["bytes_read"] for r in got.values()) <= volumes.HEAD


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_plugins_run_in_one_scan(spark):
    assert scans(registry.queries()["plugin_regions"](spark, SF)) == 1 and scans(registry.queries()["plugin_anchors"](spark, SF)) == 1
    more = plans.regions()
    more.region("corner", ("near", lambda at: at["x"] < 3))(lambda margin: (F.col("x") < 3) & (F.col("y") < 3))
    got = more.select(plans._points(spark, SF), ["x", "y", "z"], margin=0.5)
    assert scans(got) == 1 and "corner" in {r["region"] for r in got.collect()}
    none = plans._points(spark, SF).limit(0)
    empty = {r["region"]: (r["n"], r["x"], r["failed"]) for r in more.select(none, ["x", "y", "z"], margin=0.5).collect()}
    assert empty["slab"] == (0, None, "rows")


def test_plugins_refuse_what_they_do_not_know(spark):
    r = plugins.standard()
    with pytest.raises(ValueError, match="no region"):
        r.select(spark.range(1), ["id"])
    with pytest.raises(ValueError, match="unknown kind"):
        r.anchors(spark.range(1), {"a": {"kind": "none"}}, ["id"])
    r.kind("all")(lambda: F.lit(True))
    with pytest.raises(ValueError, match="already"):
        r.kind("all")(lambda: F.lit(False))
    with pytest.raises(ValueError, match="unknown rules"):
        r.anchors(spark.range(1), {"a": {"kind": "all", "rules": {"id": "far"}}}, ["id"])
    assert r.anchors(spark.range(4), {"a": {"kind": "all", "rules": {"id": "middle"}}}, ["id"]).first()[:] == ("a", 4, 1.5)
