"""Referential integrity, schema rules, parity and publication gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.text import hashed_shingles, plain_words
from strataloom.operators import checks
from strataloom.plans.registry import query
from strataloom.sources.tables import table

_SHINGLE_SQL = """
words(kind, id, source, w) AS (
  SELECT 'd', doc_id, source, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') FROM documents
  UNION ALL SELECT 'b', item_id, NULL, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') FROM benchmark),
shingle AS (SELECT kind, id, source, i AS seq, array_to_string(w[i:i + 10], ' ') AS s FROM words, unnest(range(1, len(w) - 9)) AS r(i)),
known AS (SELECT s, min((id, seq)) AS place FROM shingle WHERE kind = 'b' GROUP BY s),
hit AS (SELECT d.id AS doc_id, d.source, d.seq, k.place FROM shingle d JOIN known k USING (s) WHERE d.kind = 'd'),
first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM hit)
"""


def _copied(spark, sf_dir):
    """First run of 11 words of each document that a benchmark item also has, and where the item has it."""

    def runs(name, key):
        words = table(spark, sf_dir, name).select(F.col(key).alias("id"), *(["source"] if name == "documents" else []), plain_words(F.col("text")).alias("w"))
        # runs meet as numbers; rows of 64 bits instead of 11 words are exploded and shuffled
        return words.select(*[c for c in words.columns if c != "w"], F.posexplode(hashed_shingles(F.col("w"), 11)).alias("pos", "s"))

    known = runs("benchmark", "item_id").groupBy("s").agg(F.min(F.struct("id", "pos")).alias("place"))
    hits = runs("documents", "doc_id").join(known, "s")
    # the earliest hit of a document is a minimum over its hits, combined before the shuffle
    first = hits.groupBy(F.col("id").alias("doc_id"), "source").agg(F.min(F.struct("pos", "place")).alias("f"))
    return first.select("doc_id", "source", (F.col("f.pos") + 1).cast("long").alias("seq"), F.col("f.place.id").alias("item_id"), (F.col("f.place.pos") + 1).cast("long").alias("item_seq"))


@query("JON18 STR04", f"WITH {_SHINGLE_SQL} SELECT doc_id, seq, place[1] AS item_id, place[2] AS item_seq FROM first WHERE n = 1".replace("place[1]", "struct_extract(place, 1)").replace("place[2]", "struct_extract(place, 2)"))
def copied_text(spark, sf_dir):
    return _copied(spark, sf_dir).drop("source")


@query("FLT21 JON18 GAT01", f"WITH {_SHINGLE_SQL} SELECT source, count(*) AS hits, CASE WHEN count(*) >= 2 THEN 'error' ELSE 'warn' END AS level FROM first WHERE n = 1 GROUP BY source")
def copied_text_level(spark, sf_dir):
    hits = _copied(spark, sf_dir).groupBy("source").agg(F.count("*").alias("hits"))
    return hits.select("source", "hits", F.when(F.col("hits") >= 2, "error").otherwise("warn").alias("level"))


@query("JON01 GAT02", "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey")
def fk_violations(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "F")
    return checks.missing_keys(table(spark, sf_dir, "lineitem"), known, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("JON02 SNK06 SNK13", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_dims(spark, sf_dir):
    return checks.unused_keys(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query("JON03 SET01", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark UNION SELECT page_id FROM pages)")
def unknown_ids_union(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id").union(table(spark, sf_dir, "benchmark").select("item_id")).union(table(spark, sf_dir, "pages").select("page_id"))
    return checks.missing_keys(table(spark, sf_dir, "documents"), known, "doc_id", "doc_id").select("doc_id")


@query("JON09 WIN04", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) GROUP BY 1, 2")
def composite_fk(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    before = lines.select("l_orderkey", F.try_subtract("l_linenumber", F.lit(1)).alias("l_linenumber"))
    return checks.missing_counts(lines, before, "l_orderkey", "l_linenumber")


@query("SET01 WIN04 GAT03", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "JON10 GAT04",
    """SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'no nation' WHEN r_regionkey IS NULL THEN 'no region' END AS error FROM customer
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 7 <> 3) ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON r_regionkey = n_regionkey
    WHERE n_nationkey IS NULL OR r_regionkey IS NULL""",
)
def chained_lookup_errors(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 7 != 3)
    region = table(spark, sf_dir, "region").filter(F.col("r_name") != "ASIA")
    both = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    error = F.when(F.col("n_nationkey").isNull(), "no nation").when(F.col("r_regionkey").isNull(), "no region")
    return both.select("c_custkey", error.alias("error")).filter(F.col("error").isNotNull())


@query(
    "JON37 SET03 GAT08",
    """WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_size <> 7), b AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_size <> 11)
    SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'unknown' ELSE 'stale' END AS state
    FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE b.p_partkey IS NULL OR a.p_partkey IS NULL OR a.p_size <> b.p_size""",
)
def field_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    changed = part.filter("p_size <> 11").withColumn("p_size", F.when(F.col("p_size") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return checks.difference(part.filter("p_size <> 7"), changed, ["p_partkey"], "p_size")


@query(
    "JON38 SET06 SET07",
    """SELECT p_type, count(*) FILTER (WHERE u.k IS NULL) AS unused, count(*) AS parts FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) u ON u.k = p_partkey GROUP BY p_type""",
)
def coverage(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct()
    return table(spark, sf_dir, "part").join(used, F.col("k") == F.col("p_partkey"), "left").groupBy("p_type").agg(F.count_if(F.col("k").isNull()).alias("unused"), F.count("*").alias("parts"))


@query(
    "FLT01 FLT03 FLT20 FLT22 GAT05",
    """SELECT doc_id, rule FROM (SELECT doc_id, unnest(['lang', 'length', 'words', 'line start', 'source']) AS rule,
      unnest([lang IN ('en', 'fr', 'de'), n_chars BETWEEN 100 AND 5000, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) >= 40, regexp_matches(text, '^[A-Z]'), regexp_matches(source, '^src[0-9]$')]) AS ok FROM documents) WHERE NOT coalesce(ok, false)""",
)
def row_rules(spark, sf_dir):
    rules = {
        "lang": F.col("lang").isin("en", "fr", "de"),
        "length": F.col("n_chars").between(100, 5000),
        "words": F.size(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))) >= 40,
        "line start": F.col("text").rlike("^[A-Z]"),
        "source": F.col("source").rlike("^src[0-9]$"),
    }
    return checks.broken_rules(table(spark, sf_dir, "documents"), "doc_id", rules)


@query(
    "GAT06 SNK16 AGG34",
    """WITH m AS (SELECT avg(l_discount) AS mean_discount, max(l_quantity) AS max_quantity, stddev_pop(l_tax) AS sd_tax, count(DISTINCT l_returnflag) AS flags FROM lineitem),
    v(metric, value) AS (SELECT 'mean_discount', mean_discount FROM m UNION ALL SELECT 'max_quantity', max_quantity FROM m UNION ALL SELECT 'sd_tax', sd_tax FROM m UNION ALL SELECT 'flags', flags FROM m),
    t(metric, low, high) AS (VALUES ('mean_discount', 0.04, 0.06), ('max_quantity', 0.0, 49.0), ('sd_tax', 0.0, 0.03), ('flags', 3.0, 3.0), ('mean_tax', 0.0, 1.0))
    SELECT t.metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'unmeasured' WHEN value BETWEEN low AND high THEN 'pass' ELSE 'fail' END AS result FROM t LEFT JOIN v USING (metric)""",
)
def qa_thresholds(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").agg(F.avg("l_discount").alias("mean_discount"), F.max("l_quantity").alias("max_quantity"), F.stddev_pop("l_tax").alias("sd_tax"), F.countDistinct("l_returnflag").cast("double").alias("flags"))
    metrics = one.unpivot([], ["mean_discount", "max_quantity", "sd_tax", "flags"], "metric", "value")
    limits = spark.createDataFrame([("mean_discount", 0.04, 0.06), ("max_quantity", 0.0, 49.0), ("sd_tax", 0.0, 0.03), ("flags", 3.0, 3.0), ("mean_tax", 0.0, 1.0)], "metric string, low double, high double")
    return checks.thresholds(metrics, limits).withColumn("value", F.round("value", 6))


@query(
    "FLT12 FLT13 AGG06 GAT07 SNK03",
    """WITH restricted(k, reason) AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'both' WHEN n_nationkey % 3 = 0 THEN 'no redistribution' WHEN n_nationkey % 2 = 0 AND n_regionkey = 2 THEN 'non-commercial' END FROM nation),
    r AS (SELECT l_extendedprice, coalesce(a.reason, b.reason, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'derived' END) AS reason FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN restricted a ON a.k = s_nationkey JOIN restricted b ON b.k = c_nationkey)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, round(sum(l_extendedprice), 2) AS bytes FROM r GROUP BY 1""",
)
def exclusion_totals(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    reason = F.when(k % 6 == 0, "both").when(k % 3 == 0, "no redistribution").when((k % 2 == 0) & (F.col("n_regionkey") == 2), "non-commercial")
    restricted = nation.select(k.alias("k"), reason.alias("reason"))
    by_supplier = table(spark, sf_dir, "supplier").join(restricted, F.col("k") == F.col("s_nationkey")).select("s_suppkey", F.col("reason").alias("own"))
    by_customer = table(spark, sf_dir, "customer").join(restricted, F.col("k") == F.col("c_nationkey")).select("c_custkey", F.col("reason").alias("source"))
    orders = table(spark, sf_dir, "orders").join(by_customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "source")
    lines = table(spark, sf_dir, "lineitem").join(by_supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    derived = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "derived")
    return lines.select("l_extendedprice", F.coalesce("own", "source", derived, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("bytes"))


@query(
    "GAT10 AGG32 GAT09",
    """WITH t AS (SELECT conv_id, turn, list_sort(regexp_extract_all(text, '[0-9]+')) AS n, length(text) AS len, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, n = list_sort(regexp_extract_all(next, '[0-9]+')) AS same_numbers, length(next) * 1.0 / greatest(len, 1) BETWEEN 0.6 AND 2.2 AS length_ok FROM t WHERE next IS NOT NULL""",
)
def multiset_numbers(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    numbers = lambda c: F.sort_array(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next")).filter("next is not null")
    ratio = F.length("next") / F.greatest(F.length("text"), F.lit(1))
    return t.select("conv_id", "turn", (numbers("text") == numbers("next")).alias("same_numbers"), ratio.between(0.6, 2.2).alias("length_ok"))
