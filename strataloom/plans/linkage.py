"""Record linkage: exact, linked and fuzzy candidates, decisions and relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import linkage
from strataloom.plans.registry import query
from strataloom.sources.tables import table


@query(
    "JON14 JON15 JON16 SRT11",
    """WITH k AS (SELECT DISTINCT p_name AS k FROM part), q AS (SELECT DISTINCT left(p_name, length(p_name) - 1) || 'x' AS q FROM part WHERE length(p_name) >= 8 UNION SELECT DISTINCT p_name FROM part WHERE p_size = 1),
    e AS (SELECT q, k, 0 AS d FROM q JOIN k ON q = k), f AS (SELECT q, k, levenshtein(q, k) AS d FROM q JOIN k ON left(q, 3) = left(k, 3) AND abs(length(q) - length(k)) <= 2 WHERE q NOT IN (SELECT q FROM e) AND length(q) >= 8)
    SELECT q, k, CAST(d AS INTEGER) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, k) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM f WHERE d <= 2)) WHERE r <= 3""",
)
def exact_then_fuzzy(spark, sf_dir):
    """Exact keys first; only what has none is compared, within blocks of equal beginnings, at most three each."""
    name = F.col("p_name")
    keys = table(spark, sf_dir, "part").select(name.alias("k")).distinct()
    asked = table(spark, sf_dir, "part").filter(F.length(name) >= 8).select(F.concat(F.left(name, F.length(name) - 1), F.lit("x")).alias("q"))
    asked = asked.union(table(spark, sf_dir, "part").filter("p_size = 1").select(name)).distinct()
    return linkage.exact_then_fuzzy(asked, keys, "q", "k", block=3, most=2, least=8, top=3)


@query(
    "JON14 JON16",
    """WITH k AS (SELECT DISTINCT p_name AS k FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT lower(event_type) FROM events),
    q AS (SELECT DISTINCT 'x' || right(k, length(k) - 1) AS q FROM k UNION SELECT DISTINCT left(k, 2) || right(k, length(k) - 3) FROM k UNION SELECT DISTINCT k FROM k WHERE length(k) % 2 = 0),
    e AS (SELECT q, k, 0 AS d FROM q JOIN k ON q = k), f AS (SELECT q, k, levenshtein(q, k) AS d FROM q JOIN k ON levenshtein(q, k) <= 2 WHERE q NOT IN (SELECT q FROM e) AND length(q) >= 4)
    SELECT q, k, CAST(d AS INTEGER) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, k) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM f)) WHERE r <= 3""",
)
def exact_then_near(spark, sf_dir):
    """Exact keys first; what has none is held against all keys by q-grams, at most two edits away wherever they are."""
    keys = table(spark, sf_dir, "part").select(F.col("p_name").alias("k"))
    keys = keys.union(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment"))).union(table(spark, sf_dir, "events").select(F.lower("event_type"))).distinct()
    rest = lambda n: F.right(F.col("k"), F.length("k") - n)
    asked = keys.select(F.concat(F.lit("x"), rest(1)).alias("q")).union(keys.select(F.concat(F.left("k", F.lit(2)), rest(3)))).union(keys.filter(F.length("k") % 2 == 0)).distinct()
    return linkage.exact_then_fuzzy(asked, keys, "q", "k", block=None, most=2, least=4, top=3)


@query("JON16")
def similar_titles(spark, sf_dir):
    """Candidates among all keys by matching-blocks ratio, a measure that SQL does not have; checked against a plain loop."""
    keys = table(spark, sf_dir, "part").select(F.col("p_name").alias("k")).distinct()
    asked = keys.select(F.regexp_replace("k", "a", "o").alias("q")).distinct()
    return linkage.ratio_candidates(asked, keys, "q", "k", cutoff=0.8, top=3)


@query(
    "JON12",
    """WITH hit AS (SELECT l_orderkey AS e, l_partkey AS id, max(l_quantity) / 50 AS score FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), link AS (SELECT DISTINCT p_partkey AS a, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b FROM part WHERE p_size > 25),
    n AS (SELECT e, b AS id, max(score) - 0.01 AS score FROM hit JOIN link ON a = id GROUP BY 1, 2) SELECT e, id, round(score, 6) AS score, false AS nominated FROM hit UNION ALL SELECT e, id, round(score, 6), true FROM n WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.e = n.e AND hit.id = n.id)""",
)
def symmetric_links(spark, sf_dir):
    """A hit nominates the record linked with it, a little below its own score, unless it is a hit already."""
    hit = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("id")).agg((F.max("l_quantity") / 50).alias("score"))
    part = table(spark, sf_dir, "part")
    total = F.broadcast(part.agg(F.count("*").alias("n")))
    links = part.filter("p_size > 25").crossJoin(total).select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("b")).distinct()  # one row of totals
    named = hit.join(links, F.col("a") == F.col("id")).groupBy("e", F.col("b").alias("id")).agg((F.max("score") - 0.01).alias("score")).join(hit.select("e", "id"), ["e", "id"], "left_anti")
    both = hit.withColumn("nominated", F.lit(False)).unionByName(named.withColumn("nominated", F.lit(True)))
    return both.select("e", "id", F.round("score", 6).alias("score"), "nominated")


@query(
    "JON13 JON35",
    """SELECT c_custkey, coalesce(s.s_suppkey, t.s_suppkey, -1) AS filled, CASE WHEN s.s_suppkey IS NOT NULL THEN 'id' WHEN t.s_suppkey IS NOT NULL THEN 'place' ELSE 'none' END AS how, CASE WHEN c_acctbal > 0 THEN 'l' ELSE 'r' END AS side
    FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) t ON t.s_nationkey = c_nationkey""",
)
def cross_fill(spark, sf_dir):
    """Missing links filled from other keys in authored order."""
    supplier = table(spark, sf_dir, "supplier")
    place = supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("t"))
    both = table(spark, sf_dir, "customer").join(supplier.select(F.col("s_suppkey").alias("s")), F.col("s") == F.col("c_custkey"), "left").join(place, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    how = F.when(F.col("s").isNotNull(), "id").when(F.col("t").isNotNull(), "place").otherwise("none")
    return both.select("c_custkey", F.coalesce("s", "t", F.lit(-1)).alias("filled"), how.alias("how"), F.when(F.col("c_acctbal") > 0, "l").otherwise("r").alias("side"))


@query(
    "STR12 STR13 GAT11",
    """SELECT action, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'no decision' WHEN quality = 1 AND toxic = 0 AND lang = 'en' THEN 'exact' WHEN quality = 1 AND toxic = 0 THEN 'synonym' WHEN toxic = 1 AND n_chars > 1000 THEN 'broader' WHEN toxic = 1 THEN 'narrower' ELSE 'related' END AS action FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY action""",
)
def decisions(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    action = (
        F.when(F.col("quality").isNull(), "no decision").when(good & (F.col("lang") == "en"), "exact").when(good, "synonym")
        .when((F.col("toxic") == 1) & (F.col("n_chars") > 1000), "broader").when(F.col("toxic") == 1, "narrower").otherwise("related")
    )
    return both.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query(
    "SRT07",
    """WITH t AS (SELECT DISTINCT p_name AS name, unnest(string_split(p_name, ' ')) AS w FROM part), s AS (SELECT a.name, b.name AS other, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.name <> b.name GROUP BY 1, 2)
    SELECT name, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shared DESC, other) AS r FROM s) WHERE r <= 4""",
)
def related_terms(spark, sf_dir):
    """Up to four other names that share the most words; names are distinct before they meet by word."""
    words = table(spark, sf_dir, "part").select("p_name").distinct().select(F.col("p_name").alias("name"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    pairs = words.join(words.withColumnRenamed("name", "other"), "w").filter("name <> other").groupBy("name", "other").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("shared"), "other"))
    return pairs.withColumn("r", rank).filter("r <= 4").drop("r")
