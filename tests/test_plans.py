"""Every registered query against its SQL on the smallest tables, and micro-fixtures for the operators."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strataloom.operators import checks, graphs, sequences, spatial, stats
from strataloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.found()))
def test_query_equals_sql(spark, duck, name):
    q = registry.found()[name]
    df = q.run(spark, SF)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if q.sql is None:
        return
    got = duck.execute(q.sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    assert in_order(rows) == in_order([tuple(plain(r[columns.index(c)]) for c in names) for r in got.fetchall()])


def test_every_inventory_row_has_a_home():
    """Rows named by a query are spelled as in the inventory."""
    import re

    for q in registry.found().values():
        assert all(re.fullmatch("[A-Z]{3}[0-9]{2}", r) for r in q.rows)


def test_checks(spark):
    facts = spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 11)], "id int, ref int")
    keys = spark.createDataFrame([(10,), (10,), (11,), (None,)], "ref int")
    assert [r["id"] for r in checks.missing_keys(facts, keys, "ref", "ref").orderBy("id").collect()] == [2, 3]
    rules = checks.broken_rules(facts, "id", {"set": F.col("ref").isNotNull(), "small": F.col("ref") < 50})
    assert {tuple(r) for r in rules.collect()} == {(2, "set"), (2, "small"), (3, "small")}
    assert checks.duplicates(keys, "ref").count() == 1


def test_intervals_and_as_of(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (9.9,), (10.0,), (None,)], "x double")
    bands = spark.createDataFrame([("a", 1, 0.0, 10.0), ("b", 2, 5.0, 10.0)], "id string, ord int, lo double, hi double")
    assert [r["id"] for r in spatial.paint(rows, bands, "x").collect()] == ["a", "b", "b", None, None]
    left = spark.createDataFrame([(i,) for i in range(0, 100, 7)], "t long")
    right = spark.createDataFrame([(3, "p"), (20, "q"), (77, "r")], "s long, v string")
    got = {r["t"]: r["v"] for r in spatial.as_of(left, right, "t", "s", ["v"], 10).collect()}
    assert got == {t: ("p" if t < 20 else "q" if t < 77 else "r") for t in range(0, 100, 7) if t >= 3}


def test_radius_and_grid(spark):
    import itertools
    import random

    rng = random.Random(1)
    pts = [(i, rng.random() * 4, rng.random() * 4) for i in range(60)]
    a = spark.createDataFrame(pts, "i int, x double, y double")
    got = {(r["i"], r["j"]) for r in spatial.radius_pairs(a, a.withColumnRenamed("i", "j"), "i", "j", ["x", "y"], 0.5).collect()}
    assert got == {(p[0], q[0]) for p, q in itertools.product(pts, pts) if math.dist(p[1:], q[1:]) <= 0.5}
    grid = spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], "u int, v int")
    assert [tuple(r) for r in spatial.erode(grid, ["u", "v"]).collect()] == [(1, 1)]
    assert spatial.dilate(grid, ["u", "v"]).count() == 21


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (8, 9), (9, 8)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "n long")
    got = {r["n"]: r["component"] for r in graphs.connected(nodes, edges, "n").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "k int, p int")
    paths = {r["k"]: r["path"] for r in graphs.ancestors(rows, "k", "p", 3).collect()}
    assert paths == {1: [1], 2: [2, 1], 3: [3, 2, 1], 4: [4, 5], 5: [5, 4]}


def test_sequences(spark):
    rows = spark.createDataFrame([(g, i, (i * 7) % 5) for g in "ab" for i in range(10)], "g string, i int, d int")
    numbered = sequences.numbered(rows, ["g", "i"], "n").orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(1, 21)) and [(r["g"], r["i"]) for r in numbered] == [(g, i) for g in "ab" for i in range(10)]
    depths = [1, 2, 3, 4, 4, 2, 1, 2, 1, 2]  # ten rows of an indented list
    tree = spark.createDataFrame([("x", i + 1, d) for i, d in enumerate(depths)], "g string, i int, d int")
    got = sequences.streamed(tree, "g", ["i"], sequences.parents("d", "i"), "g string, i int, parent int").orderBy("i").collect()
    assert [r["parent"] for r in got] == [None, 1, 2, 3, 3, 1, None, 7, None, 9]


def test_quantise_cuts_off(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (0.999,), (1.0,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(stats.quantise(F.col("v"), F.lit(0.0), F.lit(1.0))).collect()] == [0, 0, 254, 255, 255]


def test_similar_titles_equal_a_plain_loop(spark):
    import difflib

    keys = sorted({r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()})
    want = set()
    for q in {k.replace("a", "o") for k in keys}:
        near = [(difflib.SequenceMatcher(None, k, q).ratio(), k) for k in keys]
        want |= {(q, k, r) for r, k in sorted((x for x in near if x[0] >= 0.8), key=lambda x: (-x[0], x[1]))[:3]}
    got = [tuple(r) for r in registry.queries()["similar_titles"](spark, SF).select("q", "k", "ratio").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(q[:3] != k[:3] for q, k, _ in want)


def test_ratio_candidates_of_all_lengths(spark):
    import difflib
    import random

    from strataloom.operators import linkage

    rng = random.Random(6)
    names = sorted({"".join(rng.choices("ab", k=rng.randrange(0, 14))) for _ in range(120)})
    keys, asked = names[::2], names[1::2]
    for cutoff in (0.6, 0.8):
        want = {(q, k) for q in asked for k in keys if difflib.SequenceMatcher(None, k, q).ratio() >= cutoff}
        frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("q", asked), ("k", keys))]
        got = linkage.ratio_candidates(*frames, "q", "k", cutoff, 1000).collect()
        assert len(got) == len(want) and {(r["q"], r["k"]) for r in got} == want


def test_unicode_order_is_whole(spark, tmp_path):
    rest = ["zz" + "".join(chr(97 + i // 26**p % 26) for p in (2, 1, 0)) for i in range(1000)]
    want = ["apfel", "Apfel", "Äpfel", "eclair", "éclair", "eclairs", "œuvre", "ou", "straße", "strategy", "zebra", "Zug", *rest, "Ωmega"]
    texts = [(i, " ".join(["no1", "a,b", *want[i::7], *want[i::3]])) for i in range(7)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["w"] for r in registry.queries()["unicode_order"](spark, str(tmp_path)).collect()] == want


def test_as_of_one_busy_place(spark):
    """Most rows at one place, ties and nulls on both sides, against a plain loop; the parts stay even."""
    import random

    rng = random.Random(8)
    asked = [(i, 50 if rng.random() < 0.5 else rng.randrange(100)) for i in range(600)] + [(600, None), (601, -1)]
    known = [(rng.randrange(100), f"v{i}", rng.choice([None, 1, 2])) for i in range(60)] + [(50, f"w{i}", i) for i in range(100)] + [(None, "no", 0)]
    left = spark.createDataFrame(asked, "id long, t int")
    right = spark.createDataFrame(known, "s long, v string, n int")
    got = {r["id"]: (r["t"], r["v"], r["n"]) for r in spatial.as_of(left, right, "t", "s", ["v", "n"], 7).collect()}
    held = [k for k in known if k[0] is not None]
    want = {}
    for i, t in asked:
        before = [k for k in held if t is not None and k[0] <= t]
        if before:
            best = max(before, key=lambda k: (k[0], k[1], -1 if k[2] is None else k[2]))
            want[i] = (t, best[1], best[2])
    assert got == want
    assert spatial.as_of(left, right.limit(0), "t", "s", ["v"], 7).count() == 0
    assert spatial.as_of(left.limit(0), right, "t", "s", ["v"], 7).count() == 0


def test_composite_fk_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """Nulls, copies and the smallest number as in the SQL; a table five times as large gives more tasks, not larger ones."""
    import random

    monkeypatch.setattr(checks, "TASK_ROWS", 400, raising=False)
    largest = []
    for n in (1_000, 5_000):
        rng, folder = random.Random(n), tmp_path / str(n)
        odd = [(None, 1), (None, 2), (None, None), (3, None), (3, None), (-1, -(2**31)), (-1, 1 - 2**31), (-2, -(2**31))] + [(-3, i % 3) for i in range(60)]
        lines = odd + [(rng.randrange(n // 4), rng.randrange(1, 8)) for _ in range(n)]
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(folder / "lineitem.parquet"))
        q = registry.found()["composite_fk"]
        got = q.run(spark, str(folder))
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
        assert in_order([tuple(r) for r in got.collect()]) == in_order(con.execute(q.sql).fetchall())
        largest.append(max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()))
    assert largest[1] < 1.5 * largest[0] and largest[1] < 400
