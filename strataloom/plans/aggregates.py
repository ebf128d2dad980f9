"""Counts, conditional and robust aggregates, fits and information measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import stats
from strataloom.plans.registry import query
from strataloom.sources.tables import table


@query("AGG01 AGG02 SRT05", "SELECT lang, source, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]+'))) AS BIGINT) AS words FROM documents GROUP BY ALL")
def count_buckets(spark, sf_dir):
    words = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(words).alias("words"))


@query("AGG03", "SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def status_rollup(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority")
    level = (F.grouping("o_orderstatus") + F.grouping("o_orderpriority")).cast("long")
    return grouped.agg(level.alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})


@query(
    "AGG04 AGG05 AGG08",
    """SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE n_chars > 2000) AS long,
    count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def conditional_stats(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tests = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "unlabelled": F.col("quality").isNull(), "long": F.col("n_chars") > 2000}
    return both.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()], F.countDistinct("source").alias("sources"))


@query("AGG07 JON11", "SELECT s_suppkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, min(l_orderkey) AS first FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def source_credits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.min("l_orderkey").alias("first"))
    both = table(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select("s_suppkey", zero("n"), zero("returned"), "first")


@query("AGG09", "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'all' WHEN NOT bool_or(o_orderstatus = 'F') THEN 'none' ELSE 'some' END AS state FROM orders GROUP BY o_custkey")
def tri_state(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    state = F.when(F.bool_and(done), "all").when(~F.bool_or(done), "none").otherwise("some")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(state.alias("state"))


@query("AGG10", "SELECT user_id, count(*) FILTER (WHERE CAST(value AS INTEGER) % 4 = user_id % 4) AS score, count(*) FILTER (WHERE CAST(value AS INTEGER) % 4 <> user_id % 4) AS missed FROM (SELECT user_id, floor(value) AS value FROM events) GROUP BY user_id")
def answer_score(spark, sf_dir):
    right = F.floor("value").cast("int") % 4 == F.col("user_id") % 4
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(right).alias("score"), F.count_if(~right).alias("missed"))


@query("AGG11 AGG16", "SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y, round(avg(CAST(embedding[3] AS DOUBLE)), 6) AS z, round(min(CAST(embedding[1] AS DOUBLE)), 6) AS x_lo, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS x_hi FROM embeddings GROUP BY label")
def centroids(spark, sf_dir):
    at = lambda i: F.col("embedding")[i].cast("double")
    mean = [F.round(F.avg(at(i)), 6).alias(n) for i, n in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), *mean, F.round(F.min(at(0)), 6).alias("x_lo"), F.round(F.max(at(0)), 6).alias("x_hi"))


@query("AGG12 AGG22 AGG46", "SELECT CAST(floor(l_quantity / 2.5) AS BIGINT) AS slab, count(*) AS n, round(avg(l_discount), 6) AS centre, round((min(l_extendedprice) + max(l_extendedprice)) / 2, 4) AS midrange FROM lineitem WHERE l_tax > 0.02 GROUP BY 1 HAVING count(*) >= 20")
def slab_centroids(spark, sf_dir):
    slab = F.floor(F.col("l_quantity") / 2.5).alias("slab")
    lines = table(spark, sf_dir, "lineitem").filter("l_tax > 0.02").groupBy(slab)
    middle = F.round((F.min("l_extendedprice") + F.max("l_extendedprice")) / 2, 4)
    return lines.agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("centre"), middle.alias("midrange")).filter("n >= 20")


@query(
    "AGG13 MTH03 FLT18",
    """WITH w AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.005) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1)
    SELECT l_returnflag, CAST(floor(least(greatest((l_extendedprice - lo) / (hi - lo) * 255, 0), 255)) AS INTEGER) AS level, count(*) AS n FROM lineitem JOIN w USING (l_returnflag) GROUP BY 1, 2""",
)
def robust_window(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ends = stats.robust_window(lines, "l_extendedprice", 0.005, 0.995, "l_returnflag")
    level = stats.quantise(F.col("l_extendedprice"), F.col("lo"), F.col("hi"))
    return lines.join(F.broadcast(ends), "l_returnflag").groupBy("l_returnflag", level.alias("level")).agg(F.count("*").alias("n"))


@query(
    "AGG14",
    """WITH e AS (SELECT quantile_cont(l_extendedprice, 0.005) AS alo, quantile_cont(l_extendedprice, 0.995) AS ahi, quantile_cont(l_quantity, 0.005) AS blo, quantile_cont(l_quantity, 0.995) AS bhi FROM lineitem),
    b AS (SELECT least(floor((least(greatest(l_extendedprice, alo), ahi) - alo) / (ahi - alo) * 48), 47) AS x, least(floor((least(greatest(l_quantity, blo), bhi) - blo) / (bhi - blo) * 48), 47) AS y FROM lineitem, e),
    j AS (SELECT x, y, count(*) AS n FROM b GROUP BY 1, 2), a AS (SELECT sum(n) AS n FROM j GROUP BY x), c AS (SELECT sum(n) AS n FROM j GROUP BY y),
    h AS (SELECT (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM a) AS ha, (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM c) AS hb, (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM j) AS hab)
    SELECT round((ha + hb) / hab, 6) AS nmi FROM h""",
)
def nmi(spark, sf_dir):
    return stats.mutual_information(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 48).select(F.round("nmi", 6).alias("nmi"))


@query("AGG15 AGG17", "SELECT l_linestatus, round(corr(l_extendedprice, l_quantity), 6) AS r, round(avg(l_discount - l_tax), 6) AS mean, round(stddev_pop(l_discount - l_tax), 6) AS sd, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 6) AS rms FROM lineitem GROUP BY 1")
def residual_stats(spark, sf_dir):
    d = F.col("l_discount") - F.col("l_tax")
    measures = {"r": F.corr("l_extendedprice", "l_quantity"), "mean": F.avg(d), "sd": F.stddev_pop(d), "rms": F.sqrt(F.avg(d * d))}
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(*[F.round(c, 6).alias(n) for n, c in measures.items()])


@query(
    "AGG18 AGG44 AGG48",
    """WITH m AS (SELECT l_linenumber, max(l_extendedprice) AS top FROM lineitem GROUP BY 1), w AS (SELECT l.*, CASE WHEN l_extendedprice >= 0.5 * top THEN l_extendedprice ELSE 0 END AS w FROM lineitem l JOIN m USING (l_linenumber))
    SELECT l_linenumber, round(sum(l_quantity * w) / sum(w), 6) AS x, round(sum(l_discount * w) / sum(w), 6) AS y FROM w GROUP BY 1""",
)
def weighted_centroid(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    top = lines.groupBy("l_linenumber").agg(F.max("l_extendedprice").alias("top"))
    price = F.col("l_extendedprice")
    weighted = lines.join(F.broadcast(top), "l_linenumber").withColumn("w", F.when(price >= 0.5 * F.col("top"), price).otherwise(F.lit(0.0)))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 6)
    return weighted.groupBy("l_linenumber").agg(mean("l_quantity").alias("x"), mean("l_discount").alias("y"))


@query("AGG19 AGG33", "SELECT user_id, count(value) FILTER (WHERE value > 5) AS n, CASE WHEN count(value) FILTER (WHERE value > 5) >= 20 THEN round(avg(value) FILTER (WHERE value > 5), 6) END AS mean FROM events GROUP BY user_id")
def mean_with_min_support(spark, sf_dir):
    known = F.when(F.col("value") > 5, F.col("value")).otherwise(F.lit(float("nan")))
    value = F.nanvl(known, F.lit(None).cast("double"))  # NaN stands for no data
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(value).alias("n"), F.when(F.count(value) >= 20, F.round(F.avg(value), 6)).alias("mean"))


@query(
    "AGG20 AGG43 AGG45",
    """WITH g AS (SELECT l_linenumber AS g, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.02) AS p2 FROM lineitem GROUP BY 1)
    SELECT g, round(lo, 4) AS lo, round((hi + lead(lo) OVER (ORDER BY g)) / 2, 4) AS edge, round(p2, 4) AS p2 FROM g""",
)
def boundary_estimates(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.percentile("l_extendedprice", F.lit(0.02)).alias("p2"))
    after = F.lead("lo").over(Window.orderBy("g"))  # a handful of groups
    return g.select("g", F.round("lo", 4).alias("lo"), F.round((F.col("hi") + after) / 2, 4).alias("edge"), F.round("p2", 4).alias("p2"))


@query(
    "AGG21 FLT19 UDF01 UDF02",
    """SELECT l_returnflag, round(CASE l_returnflag WHEN 'A' THEN min(l_quantity) WHEN 'N' THEN min(l_quantity) + 0.25 * (max(l_quantity) - min(l_quantity)) ELSE avg(l_quantity) END, 6) AS at FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY 1""",
)
def axis_rules(spark, sf_dir):
    rules = {"min": F.min("l_quantity"), "frac": F.min("l_quantity") + 0.25 * (F.max("l_quantity") - F.min("l_quantity")), "centroid": F.avg("l_quantity")}
    at = F.when(F.col("l_returnflag") == "A", rules["min"]).when(F.col("l_returnflag") == "N", rules["frac"]).otherwise(rules["centroid"])
    return table(spark, sf_dir, "lineitem").filter("l_discount between 0.02 and 0.08").groupBy("l_returnflag").agg(F.round(at, 6).alias("at"))


@query("AGG17", "SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query(
    "AGG24 SRT10",
    """WITH f AS (SELECT l_linenumber AS k, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, count(*) AS n1 FROM lineitem GROUP BY 1),
    r AS (SELECT k, s, n1, l_quantity AS x, l_extendedprice AS y, l_extendedprice - s * l_quantity - i AS r FROM lineitem JOIN f ON k = l_linenumber), m AS (SELECT k, median(r) AS m FROM r GROUP BY k), d AS (SELECT k, m, median(abs(r - m)) AS d FROM r JOIN m USING (k) GROUP BY k, m)
    SELECT k AS l_linenumber, round(s, 4) AS slope1, round(regr_slope(y, x), 4) AS slope2, n1, count(*) AS n2 FROM r JOIN d USING (k) WHERE abs(r - m) <= 2.5 * d GROUP BY k, s, n1""",
)
def mad_clip_fit(spark, sf_dir):
    fit = stats.clipped_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 2.5, "l_linenumber")
    return fit.select("l_linenumber", F.round("slope1", 4).alias("slope1"), F.round("slope2", 4).alias("slope2"), "n1", "n2")


@query("AGG30 AGG29", "SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS best, count(*) AS n FROM part GROUP BY p_brand")
def best_by_rank(spark, sf_dir):
    order = F.struct("p_size", (-F.col("p_partkey")).alias("k"))  # the smallest key wins a tie
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", order).alias("best"), F.count("*").alias("n"))


@query("AGG31", "SELECT l_orderkey, CAST(bit_or(1 << l_linenumber) AS BIGINT) AS mask FROM lineitem GROUP BY l_orderkey")
def bitmask_levels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1L, l_linenumber)")).alias("mask"))


@query("AGG35 AGG36", "SELECT l_linenumber, round(least(greatest(median(l_extendedprice / (l_quantity * 1000)), 0.7), 1.45), 6) AS scale, round(quantile_cont(l_extendedprice, 0.9) / quantile_cont(l_extendedprice, 0.1), 6) AS contrast FROM lineitem GROUP BY 1")
def scale_and_contrast(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("ratio", F.col("l_extendedprice") / (F.col("l_quantity") * 1000))
    ends = stats.percentiles(rows, "l_extendedprice", {"p90": 0.9, "p10": 0.1}, "l_linenumber")
    both = stats.percentiles(rows, "ratio", {"middle": 0.5}, "l_linenumber").join(ends, "l_linenumber")
    scale = F.least(F.greatest("middle", F.lit(0.7)), F.lit(1.45))
    return both.select("l_linenumber", F.round(scale, 6).alias("scale"), F.round(F.col("p90") / F.col("p10"), 6).alias("contrast"))


@query("AGG37 AGG39", "SELECT p_type, count(*) * 8 AS volume, CAST(sum(coalesce(CASE WHEN p_size < 10 THEN p_size END, p_size * 100)) AS BIGINT) AS bytes FROM part GROUP BY p_type")
def first_paint_bytes(spark, sf_dir):
    stand_in = F.when(F.col("p_size") < 10, F.col("p_size"))
    return table(spark, sf_dir, "part").groupBy("p_type").agg((F.count("*") * 8).alias("volume"), F.sum(F.coalesce(stand_in, F.col("p_size") * 100)).alias("bytes"))


@query("AGG40 SET05", "SELECT l_orderkey, array_to_string(list_sort(list_filter(range(1, 8), lambda x: NOT list_contains(list(l_linenumber), x))), ',') AS absent FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) < 7")
def absent_levels(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("held"))  # line numbers are 1 to 7
    absent = F.array_except(F.sequence(F.lit(1), F.lit(7)), "held")
    return held.filter(F.size("held") < 7).select("l_orderkey", F.array_join(absent, ",").alias("absent"))


@query(
    "AGG41 AGG42",
    """WITH d AS (SELECT date_trunc('day', ts) AS day, round(avg(value), 9) AS v FROM events GROUP BY 1), n AS (SELECT *, lag(v) OVER (ORDER BY day) AS p, lead(v) OVER (ORDER BY day) AS q FROM d), t(t) AS (VALUES (10.0), (45.0), (50.0), (52.0))
    SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE v >= t) AS days, count(*) FILTER (WHERE v >= t AND v >= coalesce(p, v) AND v >= coalesce(q, v)) AS peaks, round(max(v), 6) AS largest FROM n, t GROUP BY t""",
)
def threshold_sweep(spark, sf_dir):
    day = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 9).alias("v"))
    w = Window.orderBy("day")  # one row a day
    near = day.select("v", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("q"))
    swept = near.select("*", F.explode(F.array(*[F.lit(x) for x in (10.0, 45.0, 50.0, 52.0)])).alias("threshold"))
    above = F.col("v") >= F.col("threshold")
    peak = above & (F.col("v") >= F.coalesce("p", "v")) & (F.col("v") >= F.coalesce("q", "v"))
    return swept.groupBy("threshold").agg(F.count_if(above).alias("days"), F.count_if(peak).alias("peaks"), F.round(F.max("v"), 6).alias("largest"))
