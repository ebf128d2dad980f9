"""Bundles on small folders: commits, skips, gates, retirement and pruning."""

import json
from pathlib import Path

import pytest

from strataloom.sources import bundles
from strataloom.sources.sinks import GateError


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*") if p.is_file()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, lang string, text string")


def test_commit_skip_retire_and_prune(spark, tmp_path):
    root = str(tmp_path / "bundle")
    b = bundles.Bundle(spark, root)
    rows = [(1, "en", "one"), (2, "en", "two"), (3, "fr", "trois"), (4, None, "?")]
    by = {"content": ["lang"]}
    assert b.entries() == []
    assert b.commit({"content": frame(spark, rows), "index": frame(spark, rows[:2])}, by=by) == {"write": 4, "keep": 0, "retire": 0}
    assert sorted(map(tuple, b.read("content").collect())) == sorted(rows) and [r["id"] for r in b.read("content", lang="fr").collect()] == [3]
    first = files(root)
    # the same rows in another order and cut: nothing is written
    again = {"content": frame(spark, rows[::-1]).repartition(3), "index": frame(spark, rows[:2])}
    assert b.commit(again, by=by) == {"write": 0, "keep": 4, "retire": 0} and files(root) == first
    # one part changes, one goes, one output goes
    changed = [(1, "en", "one"), (2, "en", "2"), (4, None, "?")]
    assert [a for a, _ in b.plan({"content": frame(spark, changed)}, by)].count("retire") == 2
    assert b.commit({"content": frame(spark, changed)}, by=by) == {"write": 1, "keep": 1, "retire": 2}
    assert sorted(map(tuple, b.read("content").collect()), key=str) == sorted(changed, key=str)
    with pytest.raises(FileNotFoundError):
        b.read("index")
    assert (tmp_path / "bundle/index").exists()
    (tmp_path / "bundle/left.tmp").write_text("from a run that stopped")
    gone = b.prune()
    assert "left.tmp" in gone and len(gone) == 4 and b.prune() == []
    assert not (tmp_path / "bundle/index").exists() and b.read("content").count() == 3


def test_a_failed_gate_leaves_the_old_bundle(spark, tmp_path):
    b = bundles.Bundle(spark, str(tmp_path / "b"))
    b.commit({"t": frame(spark, [(1, "en", "x")])}, gates={"none": frame(spark, [])})
    before = files(tmp_path / "b")
    with pytest.raises(GateError, match="licence"):
        b.commit({"t": frame(spark, [(2, "en", "y")])}, gates={"none": frame(spark, []), "licence": frame(spark, [(2, "en", "y")])})
    assert files(tmp_path / "b") == before and b.read("t").first()["id"] == 1


def test_a_write_that_stops_leaves_the_old_bundle(spark, tmp_path, monkeypatch):
    b = bundles.Bundle(spark, str(tmp_path / "b"))
    b.commit({"t": frame(spark, [(1, "en", "x")])})
    monkeypatch.setattr(b, "_publish", lambda entries: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        b.commit({"t": frame(spark, [(2, "en", "y")])})
    fresh = bundles.Bundle(spark, str(tmp_path / "b"))
    assert fresh.read("t").first()["id"] == 1 and len(fresh.prune()) == 1
    assert fresh.commit({"t": frame(spark, [(2, "en", "y")])})["write"] == 1 and fresh.read("t").first()["id"] == 2


def test_missing_files_are_told_and_written_again(spark, tmp_path):
    b = bundles.Bundle(spark, str(tmp_path / "b"))
    b.commit({"t": frame(spark, [(1, "en", "x")]), "u": frame(spark, [])})
    (entry,) = [e for e in b.entries() if e.output == "t"]
    (tmp_path / "b" / entry.path).rename(tmp_path / "elsewhere")
    assert b.missing() == [entry]
    with pytest.raises(FileNotFoundError):
        b.prune()
    assert b.commit({"t": frame(spark, [(1, "en", "x")]), "u": frame(spark, [])}) == {"write": 1, "keep": 1, "retire": 0}
    assert not b.missing() and b.read("u").count() == 0


def test_fingerprints(spark):
    one = lambda rows: bundles.fingerprints(frame(spark, rows)).first()["fingerprint"]
    assert one([(1, "a", "b"), (2, "a", "b")]) == one([(2, "a", "b"), (1, "a", "b")])
    assert len({one(r) for r in ([(1, "a", "b")], [(1, "a", "b")] * 2, [(1, "ab", "")], [(1, "", "ab")], [(1, None, "ab")], [])}) == 6


def test_one_file_for_each_document(spark, tmp_path):
    bundles.one_file_each(frame(spark, [(1, "en", "one"), (2, "fr", "deux")]), "lang", str(tmp_path / "docs"))
    found = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "docs").glob("key=*/*.json")}
    assert found == {"key=en": {"id": 1, "lang": "en", "text": "one"}, "key=fr": {"id": 2, "lang": "fr", "text": "deux"}}


def test_upserts_keep_the_first_place(spark):
    old = spark.createDataFrame([("b", 0, 1.0), ("a", 1, 2.0)], "id string, place int, v double")
    new = spark.createDataFrame([("a", 5, 7.0), ("z", 6, 8.0), ("c", 6, 9.0), ("z", 9, None), ("a", 4, 3.0)], "id string, batch int, v double")
    got = bundles.upserted_in_order(old, new, "id", "place", "batch").orderBy("place").collect()
    assert [tuple(r) for r in got] == [("b", 0, 1.0), ("a", 1, 7.0), ("c", 2, 9.0), ("z", 3, None)]
