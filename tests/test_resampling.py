"""Resampling with holes, nearest points in blocks, welded points and filled holes against plain loops."""

import math
import random
from collections import deque

import numpy as np
import pytest

from strataloom.operators import graphs, holes, nearest, numbering, resampling, spatial
from strataloom.plans import registry, resampling as plans


def test_along_knows_holes(spark):
    rng = random.Random(2)
    rows = [(k, round(rng.random() * 60, 3), rng.choice([None, rng.random()])) for k in (1, 2) for _ in range(25)]
    rows += [(3, 4.0, 1.0), (3, 20.0, 2.0), (3, 6.0, 3.0), (4, 8.0, 5.0), (5, None, 1.0), (6, 2.0, 1.0), (6, 2.0, 3.0), (6, 4.0, None)]
    got = {(r["k0"], r["k"]): r["value"] for r in resampling.along(spark.createDataFrame(rows, "k0 int, s double, v double"), ["k0"], "s", "v", 2.0, 10.0).collect()}
    want = {}
    for key in (1, 2, 3, 4, 6):
        at = {}
        for k, s, v in rows:
            if k == key and s is not None:
                at.setdefault(s, []).append(v)
        s = sorted(at)
        mean = [(lambda h: sum(h) / len(h) if h else None)([v for v in at[x] if v is not None]) for x in s]
        for k in range(math.ceil(s[0] / 2 - 1e-9), math.floor(s[-1] / 2 + 1e-9) + 1):
            x = 2.0 * k
            i = max(j for j in range(len(s)) if s[j] <= x + 1e-9)
            part = 0.0 if i + 1 == len(s) else max(0.0, (x - s[i]) / (s[i + 1] - s[i]))
            u = mean[min(i + 1, len(s) - 1)]
            gone = (1 - part) * (mean[i] is None) + part * (u is None)
            far = i + 1 < len(s) and s[i + 1] - s[i] > 10 and part > 1e-9
            want[key, k] = None if far or gone > 0.01 else (1 - part) * (mean[i] or 0) + part * (u or 0)
    assert got.keys() == want.keys() and any(v is None for v in got.values())
    assert all(got[k] == want[k] or math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_no_value_lies_in_a_hole(spark):
    """Between events that are far apart, every place of the query's result is empty."""
    sf = "/root/testdata/sf0.001"
    got = registry.queries()["straightened"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts").collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["user_id"], []).append(r["ts"])
    hours = {u: sorted({(t - min(ts)).total_seconds() / 3600 for t in ts}) for u, ts in seen.items()}
    inside = 0
    for r in got:
        x = r["k"] * plans.STEP
        before, after = max(h for h in hours[r["user_id"]] if h <= x + 1e-9), min((h for h in hours[r["user_id"]] if h > x + 1e-9), default=x)
        if after - before > plans.GAP and x - before > 1e-6:
            inside += 1
            assert r["value"] is None
    assert inside


def test_frames_of_a_straight_line(spark):
    knots = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 3.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 0.0, 4.0, 0.0)], "g int, o int, x double, y double, z double")
    rows = resampling.frames(knots, ["g"], "o", ["x", "y", "z"], 1.0).orderBy("g", "n").collect()
    one = [r for r in rows if r["g"] == 1]
    assert [r["z"] for r in one] == [0.0, 1.0, 2.0] and all((r["t2"], r["r0"], r["a1"]) == (1.0, -1.0, 1.0) for r in one)
    assert all(r["r0"] is None and r["a0"] is None and r["t1"] == 1.0 for r in rows if r["g"] == 2)
    points = resampling.lattice(spark.createDataFrame(one), ["x", "y", "z"], [-1.0, 2.0]).collect()
    assert len(points) == 12 and {(r["world0"], r["world1"]) for r in points} == {(-u, v) for u in (-1.0, 2.0) for v in (-1.0, 2.0)}


def cloud(spark, points, key):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"{key} int, x double, y double, z double")


@pytest.mark.parametrize("shape", ["even", "outlier", "dense", "line"])
def test_nearest_against_all(spark, monkeypatch, shape):
    rng = np.random.default_rng(4)
    refs, asked = rng.random((400, 3)), rng.random((300, 3)) * 1.4 - 0.2
    if shape == "outlier":
        refs[7] = asked[3] = 1e6
        asked[4] = -1e6
    if shape == "dense":
        refs[:300] = refs[0] + rng.normal(size=(300, 3)) * 1e-6
        refs[50:60] = refs[50]
        asked[:100] = refs[:100]
    if shape == "line":
        refs[:, 1:] = asked[:, 1:] = 0
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "TOP", 2)
    monkeypatch.setattr(nearest, "FAN", 2)
    a = cloud(spark, asked, "k").union(spark.createDataFrame([(900, None, 0.0, 0.0), (901, math.nan, 0.0, 0.0), (902, math.inf, 0.0, 0.0)], "k int, x double, y double, z double"))
    got = {r["k"]: (r["r"], r["distance"]) for r in spatial.nearest(a, cloud(spark, refs, "r"), "k", "r", ["x", "y", "z"]).collect()}
    assert len(got) == 300
    for i, p in enumerate(asked):
        d = ((refs - p) ** 2).sum(1)
        assert got[i] == (int(d.argmin()), pytest.approx(math.sqrt(d.min()), abs=1e-9))


def test_one_outlier_changes_no_block_but_its_own(spark, monkeypatch):
    """Pairs of blocks that are compared hardly grow by a reference a million times farther than all others."""
    rng = np.random.default_rng(8)
    refs, asked = rng.random((3000, 3)), rng.random((500, 3))
    monkeypatch.setattr(nearest, "BLOCK", 64)
    pairs = []
    keep = nearest.durable

    def counted(df, label):
        table = keep(df, label)
        if label == "near":
            pairs.append(table.count())
        return table

    monkeypatch.setattr(nearest, "durable", counted)
    for far in (False, True):
        if far:
            refs[11] = 1e6
        assert spatial.nearest(cloud(spark, asked, "k"), cloud(spark, refs, "r"), "k", "r", ["x", "y", "z"]).count() == 500
    assert pairs[1] <= 2 * pairs[0] and pairs[0] < 0.7 * 8 * 48 * 2


def test_welded_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.random() * 10, rng.random() * 10) for i in range(150)] + [(i, "ab"[i % 2], 5.0, 5.0) for i in range(200, 240)]
    rows += [(300, None, 5.0, 5.0), (301, "c", None, 1.0)]
    got = {r["id"]: (r["component"], r["n"], r["x"], r["y"]) for r in graphs.welded(spark.createDataFrame(rows, "id int, owner string, x double, y double"), "id", "owner", ["x", "y"], 0.5).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    whole = [r for r in rows if None not in r]
    for a in whole:
        for b in whole:
            if a[1] != b[1] and math.dist(a[2:], b[2:]) <= 0.5:
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    for i, _, x, y in rows:
        group = [r for r in rows if find(r[0]) == find(i)]
        assert got[i][:2] == (find(i), len(group))
        want = (x, y) if len(group) == 1 else tuple(sum(r[k] for r in group) / len(group) for k in (2, 3))
        assert got[i][2:] == pytest.approx(want, abs=1e-9) if None not in want else got[i][2:] == want


def flooded(cells):
    lo, hi = cells.min(0) - 1, cells.max(0) + 1
    solid, seen, queue = set(map(tuple, cells.tolist())), {tuple(lo)}, deque([tuple(lo)])
    while queue:
        at = queue.popleft()
        for axis in range(len(lo)):
            for step in (-1, 1):
                n = tuple(c + step * (i == axis) for i, c in enumerate(at))
                if n not in seen and n not in solid and all(a <= c <= b for a, c, b in zip(lo, n, hi)):
                    seen.add(n)
                    queue.append(n)
    return {n for n in map(tuple, np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(lo, hi)], indexing="ij"), -1).reshape(-1, len(lo)).tolist()) if n not in seen and n not in solid}


@pytest.mark.parametrize("side", [3, 16])
def test_enclosed_against_a_flood(spark, side):
    rng = np.random.default_rng(6)
    box = np.argwhere(rng.random((12, 9, 7)) < 0.75) - [4, 0, 100]
    shell = np.array([p for p in np.argwhere(np.ones((14, 14, 14))) if (p == 0).any() or (p == 13).any()]) + [40, 0, 0]
    for cells in (box, shell, np.array([[5, 5, 5]])):
        df = spark.createDataFrame([tuple(map(int, c)) for c in cells] + [tuple(map(int, cells[0])), (None, 1, 1)], "i int, j int, k int")
        assert {tuple(r) for r in holes.enclosed(df, ["i", "j", "k"], side).collect()} == flooded(cells)
    flat = np.argwhere(rng.random((20, 20)) < 0.6)
    df = spark.createDataFrame([tuple(map(int, c)) for c in flat], "u long, v long")
    assert {tuple(r) for r in holes.enclosed(df, ["u", "v"], side).collect()} == flooded(flat)
    assert holes.enclosed(df.limit(0), ["u", "v"], side).count() == 0


def test_numbers_over_ranges(spark):
    rows = [(1, i) for i in range(200)] + [(0, 5), (None, 1), (2, 0), (2, 0)]
    got = numbering.numbered(spark.createDataFrame(rows, "a int, b int"), ["a"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(204)) and [r["a"] for r in got] == [None, 0, *[1] * 200, 2, 2]
    assert numbering.numbered(spark.createDataFrame([], "a int, b int"), ["a"], "n").count() == 0


def test_welded_writes_no_pair_of_points(spark, monkeypatch):
    """In a dense place and among copies links join cells, and rounds do not grow with the way across."""
    rng = np.random.default_rng(9)
    at = [(float(x), float(y)) for x, y in rng.random((1500, 2)) * [6, 0.5]]
    rows = [(i, "abc"[(i + i // 1500) % 3], *at[i % 1500]) for i in range(4500)] + [(9000, "a", 100.0, 0.0), (9001, "a", 100.0, 0.0)]
    written, keep = [], graphs.durable

    def counted(df, label):
        table = keep(df, label)
        written.append((label, table.count()))
        return table

    monkeypatch.setattr(graphs, "durable", counted)
    got = {r["id"]: (r["component"], r["n"]) for r in graphs.welded(spark.createDataFrame(rows, "id int, owner string, x double, y double"), "id", "owner", ["x", "y"], 0.1).collect()}
    assert max(n for label, n in written if label in ("links", "met")) < 20 * 600 and len(written) < 60
    assert got[9000] == (9000, 1) and got[9001] == (9001, 1)  # copies of one owner alone are not linked
    near = lambda a, b: math.dist(a, b) <= 0.1
    seen, queue = {0}, [0]
    while queue:
        i = queue.pop()
        for j in range(1500):
            if j not in seen and near(at[i], at[j]):
                seen.add(j)
                queue.append(j)
    assert all(got[i + 1500 * k] == (0, 3 * len(seen)) for i in seen for k in range(3))


def test_nearest_holds_few_pairs_at_a_time(monkeypatch):
    """What a worker sends back at once does not grow with the pairs of blocks it was sent."""
    import pyarrow as pa

    points = np.random.default_rng(1).random((64, 8, 3))
    ids = pa.array([list(range(8 * i, 8 * i + 8)) for i in range(64)])
    blobs = pa.array([p.tobytes() for p in points], pa.binary())
    batch = pa.record_batch([ids, ids, blobs, blobs, pa.array(np.full(64, 9.0))], ["ids", "r_ids", "points", "r_points", "far"])
    monkeypatch.setattr(nearest, "FOUND", 32)
    made = list(nearest._compared(3)(iter([batch])))
    assert max(b.num_rows for b in made) <= 32 + 8 and [k for b in made for k in b.column("key").to_pylist()] == list(range(512))
    assert all(d == 0 for b in made for d in b.column("distance").to_pylist())


def test_copies_of_references_are_met_once(spark, monkeypatch):
    """However many references lie at one place, a block of points meets one of them and a point gets one result of a pair of blocks."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    refs, asked = rng.random((40, 3)), rng.random((60, 3))
    written, keep = {}, nearest.durable

    def seen(df, label):
        table = keep(df, label)
        written.setdefault(label, []).append(table)
        return table

    monkeypatch.setattr(nearest, "durable", seen)
    monkeypatch.setattr(nearest, "discard", lambda *tables: None)
    got = {r["k"]: r["r"] for r in spatial.nearest(cloud(spark, np.repeat(asked, 3, axis=0), "k"), cloud(spark, np.tile(refs, (30, 1))[::-1], "r"), "k", "r", ["x", "y", "z"]).collect()}
    nearby = [int(((refs - p) ** 2).sum(1).argmin()) for p in asked]
    assert got == {k: 39 - nearby[k // 3] for k in range(180)}
    assert sum(len(r["ids"]) for r in written["refs"][0].collect()) == 40
    tied = [pa.array([[5, 6]]), pa.array([list(range(9))]), pa.array([np.zeros((2, 3)).tobytes()], pa.binary()), pa.array([np.ones((9, 3)).tobytes()], pa.binary()), pa.array([9.0])]
    made = list(nearest._compared(3)(iter([pa.record_batch(tied, ["ids", "r_ids", "points", "r_points", "far"])])))
    assert [(k, r) for b in made for k, r in zip(b.column("key").to_pylist(), b.column("ref").to_pylist())] == [(5, 0), (6, 0)]


def test_blocks_that_are_too_far_are_not_compared(spark, monkeypatch, tmp_path):
    """Boxes alone leave many pairs of blocks open; what the nearest of them give leaves few to be compared."""
    rng = np.random.default_rng(3)
    refs, asked = rng.normal(size=(4000, 3)), rng.normal(size=(4000, 3))
    monkeypatch.setattr(nearest, "BLOCK", 16)
    pairs, keep, compared, path = [], nearest.durable, nearest._compared, str(tmp_path / "pairs")

    def counted(df, label):
        table = keep(df, label)
        if label == "near":
            pairs.append(table.count())
        return table

    def seen(*args):
        run = compared(*args)

        def counting(batches):
            for batch in batches:
                with open(path, "a") as out:
                    out.write(f"{batch.num_rows}\n")
                yield from run(iter([batch]))

        return counting

    monkeypatch.setattr(nearest, "durable", counted)
    monkeypatch.setattr(nearest, "_compared", seen)
    got = {r["k"]: (r["r"], r["distance"]) for r in spatial.nearest(cloud(spark, asked, "k"), cloud(spark, refs, "r"), "k", "r", ["x", "y", "z"]).collect()}
    for i, p in enumerate(asked):
        d = ((refs - p) ** 2).sum(1)
        assert got[i] == (int(d.argmin()), pytest.approx(math.sqrt(d.min()), abs=1e-9))
    assert sum(map(int, open(path))) < 0.5 * pairs[-1]
