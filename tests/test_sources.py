"""Readers, writers, streams and sequential kernels on small files."""

import gzip
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import paths, sequences
from strataloom.sources import files, rasters, sinks
from strataloom.streaming import events as streams

SF = "/root/testdata/sf0.001"


def test_documents(spark, tmp_path):
    for name, text in {"a/one.json": {"id": "one", "kind": "a"}, "a/two.json": {"id": "2", "kind": "a"}, "b/three.json": {"id": "three", "kind": "a"}, "b/four.json": {"id": "four", "kind": "b"}}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(text, indent=1))
    (tmp_path / "a/five.json").write_text("{broken")
    good, errors = files.documents(spark, str(tmp_path), "id string, kind string")
    assert {r["id"] for r in good.collect()} == {"one", "four"}
    assert sorted(r["error"] for r in errors.collect()) == ["key is not the file name", "kind is not the folder", "unreadable"]


def test_optional(spark, tmp_path):
    assert files.optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_registry(spark):
    text = "base: &b https://x.org/\nsources:\n  s1: {url: !join [*b, one], nc: true}\n  s2: {url: plain}\nlicences:\n  - {id: l1}\n"
    got = files.registry(spark, text)
    assert {tuple(r) for r in got["sources"].select("id", "url", "nc").collect()} == {("s1", "https://x.org/one", "true"), ("s2", "plain", None)}
    lines = spark.createDataFrame([("a: k = v",), ("a: l = w",), ("# note",)], "value string")
    assert files.registry_lines(lines, {"a": 2}).count() == 2
    with pytest.raises(ValueError):
        files.registry_lines(lines, {"a": 3})


def test_discovery_and_volume(spark, tmp_path):
    grid = np.zeros(24, "<u2")
    grid[[0, 5, 23]] = [1, 7, 9]
    (tmp_path / "mask_left.vol").write_bytes(gzip.compress(grid.tobytes()))
    (tmp_path / "._mask.vol").write_bytes(b"x")
    rows = files.discovered(spark, str(tmp_path), {"volume": r"\.vol$"}, r"^\._").collect()
    assert [(r["kind"], r["side"], r["stem"]) for r in rows] == [("volume", "l", "mask")]
    got = files.volume(spark, str(tmp_path / "mask_left.vol"), (2, 3, 4), "<u2").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0, 1.0), (1, 2, 0, 7.0), (1, 2, 3, 9.0)]
    assert all(sinks.linear(r["i"], r["j"], r["k"], (2, 3, 4)) in (0, 5, 23) for r in got)
    with pytest.raises(Exception, match="bytes, not"):
        files.volume(spark, str(tmp_path / "mask_left.vol"), (2, 3, 5), "<u2").collect()


def test_lines(spark):
    words = spark.createDataFrame([(1, 5.0, 1.0, "b"), (1, 1.0, 1.2, "a"), (1, 0.0, 9.0, "c"), (2, 0.0, 0.0, "d")], "page int, x double, y double, text string")
    assert sorted(r["text"] for r in files.text_lines(words, "page", 2.0).collect()) == ["a b", "c", "d"]
    lines = spark.createDataFrame([("good line",), ("12",), ("a.b.c.;;;;",)], "value string")
    assert [r[0] for r in files.clean_lines(lines).collect()] == ["good line"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (1, "a")], "id int, v string")
    assert {tuple(r) for r in sinks.upserted(old, new.filter("id > 1"), "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r["id"] for r in sinks.changed(old, new, "id").collect()} == {2, 3}
    with pytest.raises(sinks.GateError):
        sinks.gated(new, old.limit(1), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    sinks.gated(new, old.limit(0), str(tmp_path / "out"))
    sinks.bundle(new, str(tmp_path / "by"), "v")
    assert spark.read.parquet(str(tmp_path / "by")).filter("v = 'c'").count() == 1


def test_streams_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.latest(live()).writeStream.outputMode("complete").format("memory").queryName("latest_t").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in streams.latest(batch).collect()}
    assert {tuple(r) for r in spark.table("latest_t").collect()} == want
    q = streams.windowed(live(), late="60 days").writeStream.outputMode("complete").format("memory").queryName("windowed_t").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windowed_t").agg(F.sum("n")).first()[0] == batch.count()
    q = streams.once(live(), late="60 days").writeStream.outputMode("append").format("memory").queryName("once_t").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once_t").count() == batch.count()
    assert streams.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_best_path_against_all(spark):
    rng = np.random.default_rng(3)
    rows = [(k, s, p, float(rng.integers(0, 5))) for k in range(3) for s in range(4) for p in range(3)]
    got = paths.viterbi(spark.createDataFrame(rows, "k long, s long, p int, v double"), "k", "s", "p", "v", 0.5, 3).collect()
    value = {(k, s, p): v for k, s, p, v in rows}
    worth = lambda k, path: sum(value[k, s, p] for s, p in enumerate(path)) - 0.5 * sum((a - b) ** 2 for a, b in zip(path, path[1:]))
    for k in range(3):
        mine = [r["p"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["s"])]
        assert worth(k, mine) == max(worth(k, path) for path in itertools.product(range(3), repeat=4))


def test_separated(spark):
    rows = spark.createDataFrame([("g", i, float(x), 0.0, 0.0) for i, x in enumerate([0, 2, 3, 4, 6.5])], "g string, i int, l double, a double, b double")
    got = sequences.streamed(rows, "g", ["i"], paths.separated(3.0), "g string, i int, taken int").orderBy("i").collect()
    assert [r["taken"] for r in got] == [1, 0, 1, 0, 1]


def test_tsv_multimap_and_first(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\tv\nx\t2\textra\nshort\n\ny\t1\nx\t1\nx\t2\n")
    (tmp_path / "b.tsv").write_text("k\tv\r\ny\t9\r\nz\t3")
    good, short = files.tsv(spark, [str(tmp_path / n) for n in ("a.tsv", "none.tsv", "b.tsv")], ["k", "v"])
    assert [(r["file"], r["line"], r["text"]) for r in short.collect()] == [(0, 2, "short")]
    assert {r["k"]: r["values"] for r in files.multimap(good, "k", "v").collect()} == {"x": ["2", "1"], "y": ["1", "9"], "z": ["3"]}
    assert {r["k"]: (r["v"], r["file"]) for r in files.first_of(good, "k").collect()} == {"x": ("2", 0), "y": ("1", 0), "z": ("3", 2)}
    assert files.tsv(spark, [str(tmp_path / "none.tsv")], ["k", "v"])[0].count() == 0


def test_drifting_lines(spark):
    """A line reaches as far as its first word, not its last, as a plain loop has it."""
    import random

    rng = random.Random(5)
    words = [(p, rng.uniform(0, 50), rng.uniform(0, 30), f"w{i}") for p in range(3) for i in range(40)]
    table = spark.createDataFrame(words + [(None, 1.0, 1.0, "n"), (1, None, 1.0, "x")], "page int, x double, y double, text string")
    got = {}
    for r in files.text_lines(table, "page", 2.5).orderBy("line").collect():
        got.setdefault(r["page"], []).append(r["text"])
    assert got.pop(None) == ["n"]
    for page, found in got.items():
        lines = []
        for w in sorted((w for w in words if w[0] == page), key=lambda w: (round(w[2] / 2.5), w[1])):
            if not lines or abs(w[2] - lines[-1][0][2]) > 2.5:
                lines.append([])
            lines[-1].append(w)
        assert found == [" ".join(w[3] for w in sorted(x, key=lambda w: w[1])) for x in lines]
    assert files.text_lines(table.limit(0), "page", 2.5).count() == 0


def test_rejoined(spark):
    import re

    pages = [["the cere-", "  bellum is inter-", "nal to a well-", "known place", "open-"], ["brain\u2014", "stem", "spi-", "nal-", "cord"], ["é-", "té", "", "x-"]]
    words = {"cerebellum", "internal", "brainstem", "spinal", "nalcord", "été", "openbrain"}
    lines = spark.createDataFrame([(p, i, v) for p, rows in enumerate(pages) for i, v in enumerate(rows)], "page int, line int, value string")
    got = {(r["page"], r["line"]): r["value"] for r in files.rejoined(lines, spark.createDataFrame([(w,) for w in words], "word string"), "page", "line").collect()}
    for p, rows in enumerate(pages):
        rows = list(rows)
        for i in range(len(rows) - 1):
            head, tail = re.search("(\\w+)[-\u2014\u2013]$", rows[i]), re.match(r"\s*(\w+)", rows[i + 1])
            if head and tail and (head[1] + tail[1]).lower() in words:
                rows[i], rows[i + 1] = rows[i][:-1] + rows[i + 1].lstrip(), ""
        assert [got[p, i] for i in range(len(rows))] == rows


def raster(voxels, code, order="<", rows=None, rotation=None, size=(1.0, 1.0, 1.0), turn=1.0, scale=(0.0, 0.0)):
    head = bytearray(352)
    put = lambda at, kind, *v: head.__setitem__(slice(at, at + np.array(v, order + kind).nbytes), np.array(v, order + kind).tobytes())
    put(0, "i4", 348), put(40, "i2", 3, *voxels.shape, 1, 1, 1, 1), put(70, "i2", code), put(76, "f4", turn, *size), put(108, "f4", 352), put(112, "f4", *scale)
    if rows is not None:
        put(254, "i2", 1), put(280, "f4", *np.ravel(rows))
    if rotation is not None:
        put(252, "i2", 1), put(256, "f4", *rotation)
    head[344:348] = b"n+1\0"
    return bytes(head) + voxels.astype(voxels.dtype.newbyteorder(order)).tobytes(order="F")


def test_rasters(spark, tmp_path):
    """Each cell lies in the world where the header puts it, whatever the order of the axes."""
    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, (3, 4, 5)).astype(np.int16)
    turned = [[0, 0, -2, 9], [3, 0, 0, -1], [0, -1, 0.1, 4]]  # stored by y, -z, -x
    (tmp_path / "a.nii").write_bytes(raster(v, 4, rows=turned))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(raster(v, 4, ">", rows=turned, scale=(2.0, 1.0))))
    rows = rasters.nifti(spark, str(tmp_path)).collect()
    for name, change in (("a.nii", lambda x: x), ("b.nii.gz", lambda x: 2 * x + 1)):
        mine = [r for r in rows if r["file"].endswith(name)]
        want = {tuple(np.round(np.array(turned) @ [*at, 1], 4)): change(x) for at, x in np.ndenumerate(v) if change(x)}
        assert {tuple(np.round([r["x"], r["y"], r["z"]], 4)): r["value"] for r in mine} == want and len(mine) == len(want)
        for axis, cell in zip("xyz", "ijk"):  # cells run with the world
            assert np.corrcoef([r[axis] for r in mine], [r[cell] for r in mine])[0, 1] > 0.9
    # half a turn around z by the rotation, with cells of 2 x 3 x 4
    voxels, matrix = rasters.decoded(raster(v, 4, rotation=(0, 0, 1, 5, 6, 7), size=(2, 3, 4)))
    assert np.allclose(matrix, [[-2, 0, 0, 5], [0, -3, 0, 6], [0, 0, 4, 7], [0, 0, 0, 1]])
    out, placed = rasters.canonical(voxels, matrix)
    assert np.array_equal(out, v[::-1, ::-1]) and np.allclose(placed, [[2, 0, 0, 1], [0, 3, 0, -3], [0, 0, 4, 7], [0, 0, 0, 1]])
    # without either, around the middle, x reversed; a given matrix goes before all
    assert np.allclose(rasters.decoded(raster(v, 4, size=(1, 2, 3)))[1][:3], [[-1, 0, 0, 1], [0, 2, 0, -3], [0, 0, 3, -6]])
    assert np.array_equal(rasters.decoded(raster(v, 4), 2 * np.eye(4))[1], 2 * np.eye(4))
    for broken in (b"", b"x" * 400, raster(v, 4)[:-1], raster(v, 128)):
        with pytest.raises(ValueError):
            rasters.decoded(broken)
