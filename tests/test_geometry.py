"""Fits, nearest points, exact percentiles and ordered names against plain numpy and loops."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from strataloom.operators import fits, graphs, paths, spatial, stats
from strataloom.plans import registry
from strataloom.sources.tables import table

SF = "/root/testdata/sf0.001"
AXES = ["x", "y", "z"]


def umeyama(src, dst, scale=None):
    ms, md = src.mean(0), dst.mean(0)
    s, d = src - ms, dst - md
    u, v, vt = np.linalg.svd(d.T @ s / len(s))
    f = np.ones(3)
    f[2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    r = u @ np.diag(f) @ vt
    k = (v * f).sum() / ((s**2).sum() / len(s)) if scale is None else scale
    return np.column_stack([k * r, md - k * r @ ms])


def points(n, seed, spread=1.0):
    rng = random.Random(seed)
    return np.array([[rng.gauss(0, spread) for _ in range(3)] for _ in range(n)])


def test_nearest_is_proven_however_far(spark):
    refs = np.concatenate([points(60, 1), points(5, 2) * 0.01 + 40])
    asked = np.concatenate([points(80, 3), points(10, 4) + 500, [[40.0, 40, 40], refs[0], refs[0]]])
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(asked)] + [(999, None, 1.0, 1.0)], "k int, x double, y double, z double")
    b = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(refs)] + [(70, *map(float, refs[0])), (71, float("nan"), 0.0, 0.0)], "r int, x double, y double, z double")
    got = {x["k"]: (x["r"], x["distance"]) for x in spatial.nearest(a, b, "k", "r", AXES).collect()}
    assert got.keys() == set(range(len(asked)))
    for i, p in enumerate(asked):
        d = np.sqrt(((refs - p) ** 2).sum(1))
        assert got[i][0] == int(d.argmin()) and abs(got[i][1] - d.min()) < 1e-9
    assert spatial.nearest(a, b.limit(0), "k", "r", AXES).count() == 0 and spatial.nearest(a.limit(0), b, "k", "r", AXES).count() == 0
    same = spark.createDataFrame([(1, 2.0, 2.0, 2.0)], "r int, x double, y double, z double")
    assert spatial.nearest(same.withColumnRenamed("r", "k"), same, "k", "r", AXES).first()["distance"] == 0


def test_percentiles_by_rank(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.expovariate(1) ** 3 for _ in range(301)] + [0.5] * 200 + [1e9]]
    rows += [("one", 4.0), ("nan", float("nan")), ("null", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"lo": 0.005, "mid": 0.5, "hi": 0.995, "top": 1.0}
    for held, most, cells in ((1_000_000, 200_000, 4096), (0, 200_000, 4096), (0, 3, 4)):
        monkeypatch.setattr(stats, "HELD_ROWS", held)
        monkeypatch.setattr(stats, "SORTED_ROWS", most)
        monkeypatch.setattr(stats, "CELLS", cells)
        got = {r["k"]: r for r in stats.percentiles(df, "v", shares, "k").collect()}
        assert got.keys() == {"a", "b", None, "one"}
        for k in got:
            held = [v for g, v in rows if g == k and v is not None]
            assert all(math.isclose(got[k][n], float(np.percentile(held, q * 100)), rel_tol=1e-9) for n, q in shares.items())
    assert stats.exact_quantile(df.limit(0), "v", 0.5) is None


def test_percentiles_of_values_without_bounds(spark, monkeypatch):
    """Infinite values and the largest numbers of either sign end, by both ways."""
    inf = math.inf
    rows = [("a", float(v)) for v in range(40)] + [("a", inf)] * 20 + [("a", -inf)] * 3
    rows += [("b", inf)] * 5 + [("c", -1.7e308), ("c", 1.7e308), ("c", 0.0), ("c", 1.0)] * 5 + [("d", -inf), ("d", inf)]
    shares = {"lo": 0.0, "some": 0.25, "mid": 0.5, "high": 0.75, "top": 1.0}
    for held, most, cells in ((10**6, 200_000, 4096), (0, 200_000, 4096), (0, 2, 4)):
        monkeypatch.setattr(stats, "HELD_ROWS", held)
        monkeypatch.setattr(stats, "SORTED_ROWS", most)
        monkeypatch.setattr(stats, "CELLS", cells)
        got = {r["k"]: r for r in stats.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", shares, "k").collect()}
        for k, n in (("a", 63), ("b", 5), ("c", 20)):
            v = sorted(x for g, x in rows if g == k)
            for name, q in shares.items():
                low, high = v[math.floor((n - 1) * q)], v[math.ceil((n - 1) * q)]
                part = (n - 1) * q % 1
                want = low if low == high else (1 - part) * low + part * high
                assert got[k][name] == want or math.isclose(got[k][name], want, rel_tol=1e-9), (k, name)
        assert math.isnan(got["d"]["mid"])


def test_similarity_and_rigid(spark):
    src = points(50, 5)
    dst = src @ np.array([[0.0, -2.0, 0], [2.0, 0, 0], [0, 0, 2.0]]).T + [1.0, 2.0, 3.0] + points(50, 6, 0.01)
    df = spark.createDataFrame([tuple(map(float, (*p, *q))) for p, q in zip(src, dst)] + [(None, *[0.0] * 5)], "x double, y double, z double, a double, b double, c double")
    assert np.allclose(fits.similarity(df, AXES, ["a", "b", "c"]), umeyama(src, dst))
    assert np.allclose(fits.similarity(df, AXES, ["a", "b", "c"], 1.0), umeyama(src, dst, 1.0))
    assert np.allclose(fits.similarity(df.limit(0), AXES, ["a", "b", "c"]), np.column_stack([np.eye(3), np.zeros(3)]))


def test_icp_query(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"][:3]]) for r in table(spark, SF, "embeddings").collect()]
    src = np.array([p for _, p in rows])
    turn = np.array([[0.9998, -0.02, 0.0], [0.02, 0.9998, 0.0], [0.0, 0.0, 1.0]])
    target = np.array([p for i, p in rows if i % 2 == 0]) @ turn.T + [0.004, -0.003, 0.002]
    m = np.column_stack([np.eye(3), np.zeros(3)])
    for _ in range(3):
        d = np.sqrt((((src @ m[:, :3].T + m[:, 3])[:, None] - target[None]) ** 2).sum(2))
        near = d.min(1)
        keep = near <= np.quantile(near, 0.9)
        m = umeyama(src[keep], target[d.argmin(1)[keep]])
    near = np.sort(np.sqrt((((src @ m[:, :3].T + m[:, 3])[:, None] - target[None]) ** 2).sum(2)).min(1))
    got = {r["axis"]: r for r in registry.queries()["icp_fit"](spark, SF).collect()}
    for i, a in enumerate(AXES):
        assert np.allclose([got[a]["kx"], got[a]["ky"], got[a]["kz"], got[a]["shift"]], m[i], atol=2e-6)
    assert abs(got["x"]["rms"] - np.sqrt((near[: int(len(near) * 0.9)] ** 2).mean())) < 2e-6


def test_ordered_names_against_all_assignments(spark):
    rng = random.Random(7)
    rows = [(k, p, rng.random() * 3) for k in (1, 2) for p in range(14) if rng.random() < 0.8]
    df = spark.createDataFrame(rows + [(3, 2, 0.5)], "k long, p int, v double")
    heights, names = (3, 4), ("a", "b", "c")
    got = {}
    for r in paths.assigned(df, "k", "p", "v", heights, names, 0.25, 14).collect():
        got.setdefault(r["k"], {})[r["name"]] = r["p"]
    for k in (1, 2, 3):
        gain = [0.0] * 14
        for g, p, v in rows + [(3, 2, 0.5)]:
            if g == k:
                gain[p] += v
        def worth(at):
            total = sum(gain[p] for p in at)
            for h, a, b in zip(heights, at, at[1:]):
                if not round(0.45 * h) <= b - a <= round(1.75 * h):
                    return -math.inf
                total -= 0.5 * ((b - a - h) / (0.25 * h)) ** 2
            return total

        best = max(map(worth, itertools.product(range(14), repeat=3)))
        assert math.isclose(worth([got[k][n] for n in names]), best)


def test_similarity_query(spark):
    got = {(r["fit"], r["axis"]): r for r in registry.queries()["similarity_fit"](spark, SF).collect()}
    want = [[1.2, -0.9, 0, 0.25], [0.9, 1.2, 0, -0.5], [0, 0, 1.5, 1.0]]
    for a, row in zip(AXES, want):
        r = got["similarity", a]
        assert np.allclose([r["kx"], r["ky"], r["kz"], r["shift"]], row, atol=5e-3)
    turn = np.array([[got["rigid", a][k] for k in ("kx", "ky", "kz")] for a in AXES])
    assert np.allclose(turn @ turn.T, np.eye(3), atol=1e-5)


def test_shells_are_joined_without_a_broadcast(spark, monkeypatch):
    """Tables that grow with the faces are never sent whole to the driver, however small their files are."""
    plans, keep = [], graphs.durable

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(graphs, "durable", seen)
    got = registry.queries()["shell_volumes"](spark, SF)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 4 and not [p for p in plans if "BroadcastHashJoin" in p]
    assert got.count() > 0


def test_percentiles_of_values_that_differ_in_their_last_bits(spark, monkeypatch):
    """Sums are not added in one order each time they are made: every scan has to see the same values."""

    def shaken(batches):
        for b in batches:
            v = b.column("v").to_numpy(zero_copy_only=False)
            yield pa.record_batch([b.column("g"), pa.array(v * (1 + np.random.default_rng().integers(-3, 4) * 2.0**-52))], ["g", "v"])

    rng = np.random.default_rng(5)
    values = {g: np.repeat(rng.normal(size=300) * 7, 6) for g in ("F", "O")}  # six copies of each
    rows = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v], "g string, v double").repartition(4).mapInArrow(shaken, "g string, v double")
    monkeypatch.setattr(stats, "HELD_ROWS", 100)
    monkeypatch.setattr(stats, "SORTED_ROWS", 20)
    monkeypatch.setattr(stats, "CELLS", 8)
    for q in (0.5, 0.25):
        got = {r["g"]: r["q"] for r in stats.percentiles(rows, "v", {"q": q}, "g").collect()}
        assert got == {g: pytest.approx(np.percentile(v, 100 * q), rel=1e-12) for g, v in values.items()}


def test_icp_puts_references_in_blocks_once(spark, monkeypatch):
    """Points move from round to round, references do not."""
    from strataloom.operators import nearest

    labels, keep = [], nearest.durable

    def seen(df, label):
        labels.append(label)
        return keep(df, label)

    monkeypatch.setattr(nearest, "durable", seen)
    registry.queries()["icp_fit"](spark, SF)
    assert labels.count("refs") == 1 and labels.count("points") == 4
