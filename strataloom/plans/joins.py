"""Lookups with precedence and fallback, overlays, back-links and range lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import spatial
from strataloom.plans.registry import query
from strataloom.sources.tables import table


@query(
    "JON04 MTH10",
    """SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE c_acctbal + coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 10.5 END, 0) END, 4) AS x, CASE WHEN n_regionkey <> 2 THEN n_name END AS shipped
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def coord_lookup_offset(spark, sf_dir):
    """An explicit coordinate, else that of the referenced row plus an optional offset; hidden references lose their name."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    own = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    offset = F.when(F.col("o_orderkey") % 2 == 0, F.lit(10.5))
    x = F.coalesce(own, F.col("c_acctbal") + F.coalesce(offset, F.lit(0.0)))
    return both.select("o_orderkey", F.round(x, 4).alias("x"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("shipped"))


@query(
    "JON05 JON30 WIN11",
    """WITH f AS (SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS first FROM lineitem GROUP BY 1)
    SELECT p_partkey, coalesce(s_suppkey, first) AS owner, s_suppkey IS NOT NULL AS declared FROM part LEFT JOIN supplier ON s_suppkey = p_partkey - 5 LEFT JOIN f ON l_partkey = p_partkey""",
)
def owner_precedence(spark, sf_dir):
    """The declared owner if it exists, else the first that lists the part."""
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", order).alias("first"))
    declared = table(spark, sf_dir, "part").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("p_partkey") - 5, "left")
    return declared.join(first, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("s_suppkey", "first").alias("owner"), F.col("s_suppkey").isNotNull().alias("declared"))


@query("JON06 SRC12 JON34", "SELECT o_custkey, count(DISTINCT l_partkey) AS n, array_to_string(list_slice(list_sort(list(DISTINCT l_partkey)), 1, 5), ',') AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def backlinks(spark, sf_dir):
    """The distinct parts behind each customer: how many, and the first five."""
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_partkey"))
    top = pairs.withColumn("r", rank).groupBy("o_custkey")
    five = F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.col("l_partkey"))))
    return top.agg(F.count("*").alias("n"), F.array_join(five, ",").alias("parts"))


@query(
    "JON07 SNK02",
    """WITH e AS (SELECT doc_id, unnest(['lang', 'source', 'size']) AS path, unnest([lang, source, CAST(n_chars AS VARCHAR)]) AS value FROM documents),
    o AS (SELECT doc_id, 'lang' AS path, 'q' || quality AS value FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'none', 't' FROM labels WHERE toxic = 1)
    SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, coalesce(e.path, o.path) AS path, coalesce(o.value, e.value) AS value, e.path IS NULL AS unknown FROM e FULL JOIN o ON o.doc_id = e.doc_id AND o.path = e.path""",
)
def overlay_fields(spark, sf_dir):
    """Fields in long form with an overlay by (id, path); overlay paths without a field are reported."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("size"))
    fields = docs.unpivot(["doc_id"], ["lang", "source", "size"], "path", "value").withColumn("known", F.lit(True))
    labels = table(spark, sf_dir, "labels")
    over = labels.filter("doc_id % 3 <> 0").select("doc_id", F.lit("lang").alias("path"), F.concat(F.lit("q"), "quality").alias("over"))
    over = over.unionByName(labels.filter("toxic = 1").select("doc_id", F.lit("none").alias("path"), F.lit("t").alias("over")))
    return fields.join(over, ["doc_id", "path"], "full_outer").select("doc_id", "path", F.coalesce("over", "value").alias("value"), F.col("known").isNull().alias("unknown"))


@query(
    "JON08",
    """WITH t AS (SELECT source, lang, min(doc_id) AS d FROM documents GROUP BY 1, 2), s AS (SELECT DISTINCT source FROM documents)
    SELECT s.source, coalesce(f.d, e.d) AS doc_id, CASE WHEN f.d IS NOT NULL THEN 'fr' WHEN e.d IS NOT NULL THEN 'en' END AS lang FROM s LEFT JOIN t f ON f.source = s.source AND f.lang = 'fr' AND f.d % 2 = 0 LEFT JOIN t e ON e.source = s.source AND e.lang = 'en'""",
)
def locale_fallback(spark, sf_dir):
    """The translated entry of each source where there is one, else the English one."""
    first = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("d"))
    sources = first.select("source").distinct()
    pick = lambda lang, name: first.filter(F.col("lang") == lang).select("source", F.col("d").alias(name))
    both = sources.join(pick("fr", "f").filter("f % 2 = 0"), "source", "left").join(pick("en", "e"), "source", "left")
    return both.select("source", F.coalesce("f", "e").alias("doc_id"), F.when(F.col("f").isNotNull(), "fr").when(F.col("e").isNotNull(), "en").alias("lang"))


@query(
    "JON23 WIN06",
    """WITH b(id, ord, lo, hi) AS (VALUES ('a', 1, 0.0, 120000.0), ('b', 2, 60000.0, 150000.0), ('c', 3, 100000.0, 110000.0), ('d', 4, 300000.0, 1e9))
    SELECT o_orderkey, arg_max(id, ord) AS band FROM orders LEFT JOIN b ON o_totalprice >= lo AND o_totalprice < hi GROUP BY o_orderkey""",
)
def interval_paint(spark, sf_dir):
    """Half-open bands over a value; where they overlap the later one paints over."""
    bands = spark.createDataFrame([("a", 1, 0.0, 120000.0), ("b", 2, 60000.0, 150000.0), ("c", 3, 100000.0, 110000.0), ("d", 4, 300000.0, 1e9)], "id string, ord int, lo double, hi double")
    return spatial.paint(table(spark, sf_dir, "orders"), bands, "o_totalprice").select("o_orderkey", F.col("id").alias("band"))


@query(
    "JON24 JON47",
    """WITH s AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (ORDER BY o_orderkey) - 1 AS b, o_custkey AS chapter FROM orders WHERE o_orderkey % 50 = 0)
    SELECT o_orderkey, chapter, a FROM orders JOIN s ON o_orderkey >= a AND o_orderkey <= coalesce(b, 9223372036854775807)""",
)
def range_from_starts(spark, sf_dir):
    """Each row's chapter, where a chapter ends before the next one's start: an as-of lookup on the row's own order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    starts = orders.filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("chapter"))
    return spatial.as_of(orders, starts, "o_orderkey", "a", ["chapter", "a"]).select("o_orderkey", "chapter", "a")


@query(
    "JON29 JON39 SRT03",
    """WITH own AS (SELECT DISTINCT c_custkey AS k, c_nationkey AS g, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey), hub AS (SELECT c_nationkey AS g, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) <= 3),
    a AS (SELECT k, o, min(r) AS r FROM (SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY o) AS r FROM own UNION ALL SELECT c_custkey, hub.o, 1000 + row_number() OVER (PARTITION BY c_custkey ORDER BY hub.o) FROM customer JOIN hub ON g = c_nationkey) GROUP BY k, o)
    SELECT k AS c_custkey, array_to_string(list(o ORDER BY r), ',') AS refs FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS n FROM a) WHERE n <= 4 GROUP BY k""",
)
def hub_topup(spark, sf_dir):
    """Up to four references each: its own first, then those of its group's hubs, without repeats."""
    pairs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    own = pairs.select(F.col("c_custkey").alias("k"), F.col("o_orderkey").alias("o")).distinct().withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    hub = pairs.withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("n <= 3").select(F.col("c_nationkey").alias("g"), F.col("o_orderkey").alias("o"))
    more = table(spark, sf_dir, "customer").join(hub, F.col("g") == F.col("c_nationkey")).select(F.col("c_custkey").alias("k"), "o").withColumn("r", F.lit(1000) + F.row_number().over(Window.partitionBy("k").orderBy("o")))
    ranked = own.unionByName(more).groupBy("k", "o").agg(F.min("r").alias("r")).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("r"))).filter("n <= 4")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("r", "o"))), lambda x: x["o"])
    return ranked.groupBy(F.col("k").alias("c_custkey")).agg(F.array_join(ordered, ",").alias("refs"))


@query("JON31 AGG23 FLT14", "SELECT o_custkey, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS l, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS r, round((avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') + avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O')) / 2, 6) AS midline FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND count(*) FILTER (WHERE o_orderstatus = 'O') > 0")
def pair_midline(spark, sf_dir):
    side = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    both = side.filter(F.col("F").isNotNull() & F.col("O").isNotNull())
    return both.select("o_custkey", F.round("F", 6).alias("l"), F.round("O", 6).alias("r"), F.round((F.col("F") + F.col("O")) / 2, 6).alias("midline"))


@query("JON36 JON46 SNK07 SRC24", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40)")
def incremental_todo(spark, sf_dir):
    """What has been asked for and is not yet done."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    of = lambda flag: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(of("A"), "p_partkey", "left_semi").join(of("R"), "p_partkey", "left_anti").select("p_partkey", "p_brand")


@query("SNK05 SNK11 SRC11 SRC13", "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_extendedprice, l_partkey)) AS l_partkey, count(*) - 1 AS replaced FROM lineitem GROUP BY 1, 2")
def keyed_upsert(spark, sf_dir):
    """The last write of each key, and how many it replaced."""
    last = F.max_by("l_partkey", F.struct("l_shipdate", "l_extendedprice", "l_partkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(last.alias("l_partkey"), (F.count("*") - 1).alias("replaced"))


@query("SET04 FLT27", "SELECT n_nationkey AS id, n_name AS name, 'base' AS origin FROM nation UNION ALL SELECT c_custkey, c_name, 'extra' FROM customer WHERE c_custkey < 60 AND c_custkey NOT IN (SELECT n_nationkey FROM nation)")
def union_base_wins(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("base").alias("origin"))
    extra = table(spark, sf_dir, "customer").filter("c_custkey < 60").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("extra").alias("origin"))
    return base.unionByName(extra.join(base.select("id"), "id", "left_anti"))


@query("SET02", "SELECT a.o_custkey, list_sort(list(DISTINCT a.o_orderstatus)) = ['F', 'O', 'P'] AS whole FROM orders a GROUP BY a.o_custkey")
def set_equality(spark, sf_dir):
    held = F.collect_set("o_orderstatus")  # three values at most
    want = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(((F.size(held) == F.size(want)) & (F.size(F.array_except(want, held)) == 0)).alias("whole"))
