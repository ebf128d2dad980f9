"""The epsilon grid join against all pairs."""

import math

import numpy as np
import pytest

from strataloom.llm import vectors as V
from strataloom.llm.queries import op13_near_vectors
from strataloom.sources.tables import table

SCHEMA = "vec_id long, embedding array<double>, label int, row string, n long, size int"


def by_hand(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of every row, over all pairs."""

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        dot = lambda x, y: math.fsum(p * q for p, q in zip(x, y))
        top = lambda v: [x / max(map(abs, v)) for x in v]
        a, b = top(a), top(b)
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    links, root = [0] * len(rows), {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for p, (i, v, label) in enumerate(rows):
        for q, (j, w, other) in enumerate(rows[:p]):
            if None in (i, j, label, other) or label != other or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            if cosine(v, w) >= least:
                links[p] += 1
                links[q] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    own = [None if r[0] is None else find(r[0]) for r in rows]
    return sorted(((r[0], n, c, c is not None and c == r[0]) for r, n, c in zip(rows, links, own)), key=str)


def joined(spark, rows, least=0.98):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    out = V.near(df, least)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=str)


def cloud(seed, n, d, clumps):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for at, size, noise in clumps:
        x[at : at + size] = x[at] + rng.normal(size=(size, d)) * noise
    return x


def test_kernel_against_all_pairs():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n, d = int(rng.integers(1, 500)), int(rng.choice([1, 2, 3, 8, 64]))
        x = cloud(seed, n, d, [(n // 3, n // 4, noise) for noise in (0, 1e-3)] + [(n // 2, n // 3, 0.1)])
        y = None if seed % 2 else np.concatenate([cloud(seed + 99, 150, d, []), x[:40] + rng.normal(size=(min(40, n), d)) * 0.05])
        basis = {} if seed % 5 == 0 else {d: np.linalg.eigh(V._units(x).T @ V._units(x))[1][:, ::-1][:, : V.AXES]}
        x = x[np.lexsort(np.floor(V._leading(V._units(x), basis) / 0.2).T[::-1])]
        counts, label, _ = V.compare(x, y, basis, 0.98)
        hit = V._units(x) @ V._units(x if y is None else y).T >= 0.98
        if y is None:
            np.fill_diagonal(hit, False)
        a, b = np.nonzero(hit)
        assert (counts == (hit.sum(1) if y is None else np.concatenate([hit.sum(1), hit.sum(0)]))).all()
        assert (label == V.forest(a, b + (0 if y is None else len(x)), len(counts))).all()


def test_distant_intervals_are_skipped_and_close_ones_counted_whole():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(4)[k] + rng.normal(size=(512, 4)) * 1e-3 for k in range(4)])
    counts, _, tally = V.compare(x, None, {4: np.eye(4)}, 0.98)
    assert (counts == 511).all() and tally["compared"] == 0 and tally["whole"] >= 4 and tally["skipped"] >= 6


def test_against_all_pairs(spark, monkeypatch):
    """Tiles, blocks and fans so small that every level of intervals is used, with a group of copies and of near copies."""
    rows = []
    for label, (n, d, clumps) in enumerate([(260, 5, [(10, 90, 0.0), (120, 60, 1e-4)]), (90, 5, [(0, 40, 0.08)]), (60, 3, [])]):
        rows += [(len(rows) + k, v.tolist(), label) for k, v in enumerate(cloud(label, n, d, clumps))]
    want = by_hand(rows)
    assert joined(spark, rows) == want and max(r[1] for r in want) >= 89
    for name, small in (("TILE", 16), ("BLOCK", 8), ("LEAF", 4), ("FAN", 1)):
        monkeypatch.setattr(V, name, small)
    assert joined(spark, rows) == want


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, op13_near_vectors(spark, sf).collect()), key=str) == by_hand(rows)


def test_awkward(spark):
    v, nan = [0.6, 0.8], math.nan
    rows = [(1, v, 1), (2, [1.2, 1.6], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [math.inf, 1.0], 1)]
    rows += [(10, [0.6, None], 1), (11, [0.6, 0.8, 0.0], 1), (None, v, 1), (12, [6e300, 8e300], 1), (13, [6e-310, 8e-310], 1), (2, v, 1), (14, [1.0, 0.0], 3), (15, [0.98, math.sqrt(1 - 0.98**2)], 3)]
    got = joined(spark, rows)
    assert [r for r in got if r[0] not in (14, 15)] == [r for r in by_hand(rows) if r[0] not in (14, 15)]
    assert (1, 4, 1, True) in got and got.count((2, 4, 1, False)) == 2 and (None, 0, None, False) in got
    assert joined(spark, []) == []
    with pytest.raises(ValueError):
        V.near(spark.createDataFrame([], SCHEMA), 1.5)
