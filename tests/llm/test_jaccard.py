import random

import pytest

from helpers import SMALL, WORD, awkward, frame, table_rows
from strataloom.llm import jaccard, queries
from strataloom.llm.components import components


def sets_of(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def by_hand(docs, k, percent):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    s = {d: sets_of(t, k) for d, t in docs}
    up = {d: d for d in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for d in s:
        for x in s[d]:
            where.setdefault(x, []).append(d)
    for a, b in {(a, b) for held in where.values() for a in held for b in held if a < b}:
        both = len(s[a] & s[b])
        if 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in s}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in table_rows(spark, "documents")]
    got = result(queries.op4_ngram_jaccard(spark, SMALL))
    assert got == by_hand(docs, 4, 85) and any(c < d for d, (_, c) in got.items())


@pytest.mark.parametrize("short,last,block", [(32, 1000, 512), (1, 0, 3), (2, 5, 2), (3, 1000, 4)])
def test_families(spark, monkeypatch, short, last, block):
    """Families of edited copies near the limit, with long lists, few shingles put last, and small blocks."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "LAST", last)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(short)
    bases = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 12, 50, 90]))] for _ in range(12)]
    docs = []
    for d in range(160):
        words = list(bases[d % 12])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = [f"w{rng.randrange(500)}"] * rng.randrange(2)
        docs.append((d, " ".join(words) if d % 5 else " ".join(words).upper()))
    docs += [(200, "Just one"), (201, "just ONE"), (202, "just"), (203, ""), (204, None)]
    for k, percent in ((4, 85), (2, 80)):
        assert result(jaccard.similar(frame(spark, docs), k, percent)) == by_hand(docs, k, percent)


def test_awkward(spark):
    docs = awkward(spark, [(20, "a b c d e f"), (20, "a b c d e f"), (21, "a b c d e f"), (22, "x")])
    rows = jaccard.similar(docs).collect()
    assert len(rows) == 12
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[None] == (3, None) and got[1] == (0, 1) and got[3] == (0, 3) and got[21] == (2, 20) and got[22] == (1, 22)
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 20, 22]
    assert jaccard.similar(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, x) for x in range(501, 540)]
    up = {x: x for ab in links for x in ab}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in ab and ab[0] != ab[1] for ab in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
