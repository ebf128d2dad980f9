"""Commands, reports, lock files, catalogues and pages on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom import __main__ as commands
from strataloom.functions import text as T
from strataloom.operators import graphs
from strataloom.sources import files, reports

SF = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path, capsys):
    run = lambda *args: commands.main(list(args), lambda: spark)
    assert run("list", "GEO20") == 0 and capsys.readouterr().out.startswith("enclosed_cells\t")
    assert run("build", SF, str(tmp_path), "dense_ids", "count_buckets") == 0
    assert spark.read.parquet(str(tmp_path / "dense_ids")).count() > 0 and (tmp_path / "count_buckets").exists()
    assert run("run", "no_such", SF, str(tmp_path / "x")) == 2 and run("walk") == 2 and run() == 2
    assert run("build", str(tmp_path / "nothing"), str(tmp_path / "out"), "dense_ids", "count_buckets") == 1 and not (tmp_path / "out/count_buckets").exists()
    capsys.readouterr()
    assert run("explain", "dense_ids", SF) == 0 and "Physical Plan" in capsys.readouterr().out


def test_report(spark, tmp_path):
    bad = spark.createDataFrame([(i, f"m{i}") for i in range(8)], "id int, why string")
    rules = {"count": ("warning", bad.filter("id < 3")), "shape": ("problem", bad), "none": ("problem", bad.limit(0))}
    found = reports.findings(rules, "id", "why")
    root = str(tmp_path / "qa")
    assert reports.report(spark, found, {"rows": 8, "share": 0.25}, root) == 1
    summary = "".join(p.read_text() for p in (tmp_path / "qa/summary").glob("*.txt"))
    assert "## problem: shape (8)" in summary and "## warning: count (3)" in summary and "`4` m4" in summary and "`5` m5" not in summary and "- share: 0.25" in summary
    kept = spark.read.parquet(*[f"{root}/{e.path}" for e in reports.Bundle(spark, root).entries()])
    decided = kept.withColumn("decision", F.when(F.col("key") == "2", "accepted").otherwise(""))
    assert reports.report(spark, reports.findings({"count": rules["count"]}, "id", "why"), {}, str(tmp_path / "next"), decided) == 0
    again = reports.Bundle(spark, str(tmp_path / "next")).read("findings").collect()
    assert {r["key"]: r["decision"] for r in again} == {"0": "", "1": "", "2": "accepted"}
    with pytest.raises(ValueError, match="severities"):
        reports.findings({"x": ("note", bad)}, "id", "why")


def test_lock_file(spark):
    lock = spark.createDataFrame([("a", "h1", 10, "u"), ("b", "h2", 20, "u"), ("c", "h3", 30, "u")], "source string, sha256 string, bytes long, url string")
    fetched = spark.createDataFrame([("a", "h1", 10, "v", 1), ("b", "hx", 21, "u", 1), ("d", "h4", 40, "u", 1), ("d", "h5", 50, "u", 2)], "source string, sha256 string, bytes long, url string, fetched int")
    new, differ = reports.locked(lock, fetched)
    assert {tuple(r) for r in new.collect()} == {("a", "h1", 10, "v"), ("b", "h2", 20, "u"), ("c", "h3", 30, "u"), ("d", "h5", 50, "u")}
    assert [tuple(r) for r in differ.collect()] == [("b", "h2", "hx")]


def test_catalogue_and_index(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "name": "one"}, {"id": "y", "name": None}]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "x", "name": "two"}]))
    (tmp_path / "c.json").write_text(json.dumps({"id": "z"}))
    (tmp_path / "d.json").write_text("{broken")
    rows, errors = reports.catalogue(spark, str(tmp_path / "*.json"), "id: string, name: string", "id")
    assert sorted((r["id"], r["name"]) for r in rows.drop("file").collect()) == [("x", "one"), ("x", "two"), ("y", None)] or sorted((r["id"], str(r["name"])) for r in rows.collect()) == [("x", "one"), ("x", "two"), ("y", "None")]
    assert sorted((r["file"][-6:], r["error"]) for r in errors.collect()) == [("b.json", "repeated key x"), ("c.json", "not an array of objects"), ("d.json", "not an array of objects")]
    held = reports.indexed(rows.filter("file not like '%b.json'"), "id", "name")
    assert [tuple(r) for r in held["name"].collect()] == [("one", "x")]
    with pytest.raises(ValueError, match="repeated"):
        reports.indexed(rows, "id")


def test_pages_of_a_text(spark):
    text = "before\n⟦book p.3 | pdf 5⟧\nline one\nline two\n⟦book p.4 | pdf 6⟧\n\n⟦other p.1 | pdf 9⟧\nend ⟦book p.9 | pdf 9⟧"
    rows = files.pages(spark.createDataFrame([(1, text), (2, "no mark"), (3, None)], "id int, text string"), "text").collect()
    assert [(r["id"], r["book"], r["printed"], r["pdf"], r["body"]) for r in rows] == [(1, "book", 3, 5, "line one\nline two"), (1, "book", 4, 6, ""), (1, "other", 1, 9, "end ⟦book p.9 | pdf 9⟧")]


def test_filled_once(spark):
    df = spark.createDataFrame([("{a}-{b}-{c}{a}", {"a": "{b}", "b": "x"}), ("plain", {"a": "1"}), ("{a}", {"a": None})], "t string, v map<string,string>")
    assert [r[0] for r in df.select(T.filled(F.col("t"), F.col("v"))).collect()] == ["{b}-x-{c}{b}", "plain", "{a}"]


def test_components_without_small(spark):
    rows = spark.createDataFrame([("a", 100), ("a", 39), ("a", 40), ("b", 3), ("b", 4), ("b", 4)], "k string, n int")
    assert sorted(map(tuple, graphs.without_small(rows, "n", 10, 0.4, "k").collect())) == [("a", 40), ("a", 100), ("b", 4), ("b", 4)]
