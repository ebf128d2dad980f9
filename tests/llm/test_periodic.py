"""Runs of repeated words against brute force over all places and periods."""

import hashlib
import random
import zlib

import numpy as np
from helpers import SMALL, WORD, awkward, frame, table_rows

from strataloom.llm import periodic
from strataloom.llm.queries import op12_periodic


def brute(w, longest_period=None):
    """(start, length, period) of maximal runs of two or more smallest periods."""
    found = []
    for q in range(1, (longest_period or len(w) // 2) + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= 2 * q and not any(all(w[i + t] == w[i + t + p] for t in range(length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_kernel_against_all_periods():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))]
            if rng.random() < 0.5 and len(w) > 6:
                s, p = rng.randrange(len(w)), rng.randint(1, len(w) // 3)
                w = [w[s + (i - s) % p] if i >= s else w[i] for i in range(len(w))]
            docs.append(w)
        sizes = [len(d) for d in docs]
        got = periodic.runs(np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), sizes))
        base = np.cumsum([0, *sizes])
        want = [(int(b) + s, n, q) for b, d in zip(base, docs) for s, n, q in brute(d)]
        assert list(zip(*(c.tolist() for c in got))) == want


def test_rotations_that_only_suffix_links_reach():
    """The square vocabulary is whole: every kind of square of a word over two letters is found."""
    rng = random.Random(9)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(40)]
        s = periodic.Suffixes(np.array(w), np.zeros(len(w), np.int64))
        start, half = periodic.covering(s, periodic.blocks(s))
        ok = periodic.primitive(s, start, half)
        kinds = {tuple(w[i : i + 2 * k]) for i, k in zip(*(c.tolist() for c in periodic.vocabulary(s, start[ok], half[ok])))}
        every = {tuple(w[i : i + 2 * k]) for k in range(1, 21) for i in range(41 - 2 * k) if w[i : i + k] == w[i + k : i + 2 * k]}
        root = lambda v: not any(len(v) // 2 % p == 0 and v == v[:p] * (len(v) // p) for p in range(1, len(v) // 2))
        assert kinds == {v for v in every if root(v)}


def expected(rows):
    for r in rows:
        w = WORD.findall(r["text"] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = [x for x in brute(w, n // 4) if x[1] >= max(6, 4 * x[2])]
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        yield (r["doc_id"], len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(told), sha(kept))


def test_query_against_brute_force(spark):
    done = op12_periodic(spark, SMALL)
    assert done.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [r for r in table_rows(spark, "documents") if len(r["text"] or "") < 12000]
    ids = {r["doc_id"] for r in rows}
    got = [tuple(r) for r in done.collect()]
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert sorted(r for r in got if r[0] in ids) == sorted(expected(rows))
    assert any(r[1] for r in got)


def test_awkward_rows(spark):
    rows = periodic.collapse(awkward(spark, [(7, "a b " * 5 + "end"), (8, "x " * 5), (9, "Go go go go go go go")])).collect()
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.text) for r in rows}
    assert len(rows) == 11 and sum(r.doc_id == 4 for r in rows) == 2
    assert got[1] == got[2] == got[3] == (0, [], "")
    assert got[5] == (5, [], "tab and line breaks here") and got[6][0] == 30000 and got[6][1] == []
    assert got[7] == (11, [(0, 10, 2)], "a b end") and got[8] == (5, [], "x x x x x") and got[9] == (7, [(1, 6, 1)], "Go go")
    assert not periodic.collapse(frame(spark, [])).collect()


def test_long_document(spark):
    w = [f"w{i}" for i in range(3000)] * 30 + ["tail"]
    (row,) = periodic.collapse(frame(spark, [(1, " ".join(w))])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 90000, 3000)] and len(row.text.split()) == 3001
