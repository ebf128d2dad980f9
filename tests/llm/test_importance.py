"""Importance resampling against a plain computation of the same integers."""

import hashlib
import math
import re
import zlib
from collections import Counter

from helpers import SMALL, awkward, frame, table_rows

from strataloom.llm import importance
from strataloom.llm.queries import op11_importance


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, longest):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def by_hand(docs, target, longest=1):
    s, t = (Counter(b for _, text in rows for b in runs(text, longest)) for rows in (docs, target))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))
    rows = []
    for d, text in docs:
        f = runs(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append((d, len(words(text)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    rank = {r[0]: n for n, r in enumerate(able[: len(able) * 10 // 100], 1)}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(r[0])) for r in rows), key=lambda r: (r[0] is not None, r))


def test_query_by_hand(spark):
    docs = [(r["doc_id"], r["text"]) for r in table_rows(spark, "documents", "/root/testdata/sf0.01")]
    target = [(r["item_id"], r["text"]) for r in table_rows(spark, "benchmark", "/root/testdata/sf0.01")]
    got = op11_importance(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == by_hand(docs, target)


def test_longer_runs_of_words(spark):
    docs, target = ([(list(r.values())[0], r["text"]) for r in table_rows(spark, t)] for t in ("documents", "benchmark"))
    docs += [(10**6, "Été ÉTÉ été 3x <b>bold</b>"), (10**6 + 1, "w" * 5000 + " x")]
    got = importance.resample(frame(spark, docs), frame(spark, target), longest=3)
    assert sorted(tuple(r) for r in got.drop("n_words").collect()) == by_hand(docs, target, 3)


def test_ties_and_suffix_sums(spark):
    """Many rows on few scores: the counts above each, over all digits of a score and below zero."""
    values = [v for v in (-(10**7), -1025, -1024, -1, 0, 1, 1023, 1024, 10**6, 3 * 10**9) for _ in range(abs(v) % 7 + 1)]
    got = dict(map(tuple, importance.above(spark.createDataFrame([(v,) for v in values], "score long")).collect()))
    assert got == {v: sum(x > v for x in values) for v in values}
    docs = [(i, "same words " * 10) for i in range(500)]
    rows = importance.resample(frame(spark, docs), frame(spark, []), percent=50).collect()
    order = sorted(rows, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in order] == [*range(1, 251), *[None] * 250] and len({r["score"] for r in rows}) < 500


def test_awkward(spark):
    docs = awkward(spark, [(i, "many words " * 15) for i in range(20, 50)] + [(20, "many words " * 15)])
    rows = importance.resample(docs, docs.limit(0)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and got[1]["weight"] == got[2]["n_features"] == 0 and got[None]["rank"] is None
    assert got[6]["n_features"] == 30000 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]
    assert not importance.resample(frame(spark, []), docs).collect()
    assert all(r["rank"] is None for r in importance.resample(frame(spark, [(1, "a few")]), docs).collect())
    assert SMALL
