"""Window operators: arc length, resampling, ids, ranks, batches and blends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import sequences
from strataloom.plans.registry import query
from strataloom.sources.tables import table


@query(
    "WIN01",
    """WITH s AS (SELECT user_id, event_id, value, coalesce(abs(value - lag(value) OVER w), 0) AS step, lag(value) OVER w AS p, lead(value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round(sum(step) OVER (PARTITION BY user_id ORDER BY ts2 ROWS UNBOUNDED PRECEDING), 6) AS arc, round(CASE WHEN p IS NULL THEN q - value WHEN q IS NULL THEN value - p ELSE (q - p) / 2 END, 6) AS gradient
    FROM (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY e.ts, e.event_id) AS ts2 FROM s JOIN events e USING (event_id))""".replace("s.user_id", "s.user_id"),
)
def arc_length(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", v, before.alias("p"), after.alias("q"))
    arc = F.sum(F.coalesce(F.abs(v - F.col("p")), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    gradient = F.when(F.col("p").isNull(), F.col("q") - v).when(F.col("q").isNull(), v - F.col("p")).otherwise((F.col("q") - F.col("p")) / 2)
    return rows.select("user_id", "event_id", F.round(arc, 6).alias("arc"), F.round(gradient, 6).alias("gradient"))


@query(
    "WIN02",
    """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    p AS (SELECT a.user_id, a.event_id, d, least(greatest(a.i + d, 1), a.n) AS j FROM e a, unnest(range(-2, 3)) r(d))
    SELECT p.user_id, p.event_id, round(avg(b.value), 6) AS smooth FROM p JOIN e b ON b.user_id = p.user_id AND b.i = p.j GROUP BY 1, 2""",
)
def moving_mean(spark, sf_dir):
    """A centred mean of five with the first and last value repeated beyond the ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    terms = [F.coalesce(F.lag("value", -d).over(w) if d else F.col("value"), (F.first("value") if d < 0 else F.last("value")).over(whole)) for d in range(-2, 3)]
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(sum(terms) / 5, 6).alias("smooth"))


@query(
    "WIN04 AGG40",
    "SELECT o_orderkey, gap FROM (SELECT o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap, o_totalprice > lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 50000 AS jump FROM orders) WHERE gap <> 1 AND jump",
)
def id_gaps(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    gap = F.col("o_orderkey") - F.lag("o_orderkey").over(w)
    jump = F.col("o_totalprice") > F.lag("o_totalprice").over(w) + 50000
    return table(spark, sf_dir, "orders").select("o_orderkey", gap.alias("gap"), jump.alias("jump")).filter((F.col("gap") != 1) & F.col("jump")).drop("jump")


@query("WIN05 SRT04", "SELECT p_partkey, row_number() OVER (ORDER BY coalesce(CASE p_type WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 END, 99), p_brand, p_partkey) AS id FROM part")
def dense_ids(spark, sf_dir):
    """Ids without gaps in paint order, by ranges: no task sees all rows."""
    part = table(spark, sf_dir, "part").withColumn("priority", F.coalesce(F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "LARGE", 2), F.lit(99)))
    return sequences.numbered(part, ["priority", "p_brand", "p_partkey"], "id").select("p_partkey", "id")


@query(
    "WIN07 WIN08 SRT07",
    "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, length(p_name), p_partkey) AS r, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size DESC, p_retailprice, p_partkey) AS s FROM part) WHERE r <= 8 AND s = 1",
)
def rank_dedup(spark, sf_dir):
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_retailprice", F.length("p_name"), "p_partkey")
    same = Window.partitionBy("p_brand", "p_name").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(order).alias("r"), F.row_number().over(same).alias("s")).filter("r <= 8 and s = 1").select("p_brand", "p_partkey")


@query("WIN09", "SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def suffix_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("base"), n.alias("n"))
    return rows.select("p_partkey", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("id"))


@query(
    "WIN10 SNK10",
    """WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    r(source, i, doc_id, batch, total) AS (SELECT source, i, doc_id, CAST(0 AS BIGINT), n_chars FROM d WHERE i = 1 UNION ALL SELECT d.source, d.i, d.doc_id, CASE WHEN r.total + d.n_chars > 20000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.total + d.n_chars > 20000 THEN d.n_chars ELSE r.total + d.n_chars END FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1)
    SELECT source, doc_id, batch FROM r""",
)
def greedy_batches(spark, sf_dir):
    """Batches filled in order up to a budget; the sum restarts with each batch, so it streams through sorted rows."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sequences.streamed(docs, "source", ["doc_id"], sequences.budget("n_chars", 20000), "source string, doc_id long, batch long")


@query(
    "WIN12",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value, (value % 10) / 20 AS w FROM events),
    c AS (SELECT *, coalesce(exp(sum(ln(1 - w)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS left_over FROM e) SELECT user_id, round(sum(value * w * left_over), 6) AS blend, round(min(left_over), 9) AS rest FROM c GROUP BY user_id""",
)
def residual_blend(spark, sf_dir):
    """Each weight takes its share of what the earlier ones left."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    weight = (F.col("value") % 10) / 20
    rows = table(spark, sf_dir, "events").select("user_id", "value", weight.alias("w"), F.coalesce(F.exp(F.sum(F.log(1 - weight)).over(w)), F.lit(1.0)).alias("left_over"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("w") * F.col("left_over")), 6).alias("blend"), F.round(F.min("left_over"), 9).alias("rest"))


@query("WIN20", "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, o_orderkey) AS next, coalesce(lag(o_orderkey) OVER w, o_orderkey) AS previous FROM orders WHERE o_orderstatus = 'O' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def navigation(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    at = lambda f: F.coalesce(f("o_orderkey").over(w), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", at(F.lead).alias("next"), at(F.lag).alias("previous"))


@query("WIN22", "SELECT user_id, event_id, round(coalesce(last_value(CASE WHEN value > 60 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1), 6) AS reference FROM events")
def carried_reference(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("value") > 60, F.col("value")), True).over(w)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.coalesce(known, F.lit(-1.0)), 6).alias("reference"))


@query(
    "MTH05",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity < 10 THEN l_quantity - 10 + 5 WHEN l_quantity > 40 THEN l_quantity - 40 + 50 ELSE 5 + (l_quantity - 10) * 1.5 END, 6) AS mapped, round(CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 1 ELSE t * t * (3 - 2 * t) END, 6) AS taper FROM (SELECT *, (l_quantity - 5) / 30 AS t FROM lineitem)",
)
def piecewise_map(spark, sf_dir):
    """A piecewise linear map with unit slope beyond its knots, and a smooth step."""
    x = F.col("l_quantity")
    mapped = F.when(x < 10, x - 10 + 5).when(x > 40, x - 40 + 50).otherwise(5 + (x - 10) * 1.5)
    t = F.least(F.greatest((x - 5) / 30, F.lit(0.0)), F.lit(1.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(mapped, 6).alias("mapped"), F.round(t * t * (3 - 2 * t), 6).alias("taper"))


@query(
    "JON33",
    """WITH k AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'), q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT q.event_id, round(k.value, 6) AS before FROM q ASOF JOIN k ON q.user_id = k.user_id AND q.ts >= k.ts""",
)
def asof_value(spark, sf_dir):
    """The last value of one kind of event at each event of another kind of the same user."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("event_type") == "view", F.col("value")), True).over(w)
    return e.select("event_id", "event_type", F.round(known, 6).alias("before")).filter("event_type = 'purchase' and before is not null").select("event_id", "before")


@query(
    "WIN19 STR16",
    """WITH d AS (SELECT l_orderkey, l_linenumber, min(l_partkey % 4) AS depth FROM lineitem GROUP BY 1, 2)
    SELECT a.l_orderkey, a.l_linenumber, max(b.l_linenumber) AS parent FROM d a LEFT JOIN d b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.depth < a.depth GROUP BY 1, 2""",
)
def indent_parents(spark, sf_dir):
    """The parent of each row by its indent: the last earlier row with a smaller one; a stack over sorted rows."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") % 4).alias("depth"))
    return sequences.streamed(rows, "l_orderkey", ["l_linenumber"], sequences.parents("depth", "l_linenumber"), "l_orderkey long, l_linenumber int, parent int")


@query("SRT09 AGG27", "SELECT l_linenumber, round(sqrt(avg(r * r)), 6) AS rms, count(*) AS n FROM (SELECT l_linenumber, r, row_number() OVER (PARTITION BY l_linenumber ORDER BY abs(r), l_orderkey, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_linenumber) AS c FROM (SELECT *, l_discount - l_tax AS r FROM lineitem)) WHERE i <= floor(c * 0.9) GROUP BY 1")
def trimmed_rms(spark, sf_dir):
    """The root mean square of the nine tenths nearest to zero, from counts of equal values: no sort of a whole group."""
    r = F.round(F.col("l_discount") - F.col("l_tax"), 12)
    size = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.abs(r).alias("a")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_linenumber")
    upto = F.sum("n").over(w.orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    cut = size.withColumn("upto", upto).withColumn("limit", F.floor(F.sum("n").over(w) * 0.9))
    taken = F.least(F.col("n"), F.greatest(F.col("limit") - (F.col("upto") - F.col("n")), F.lit(0)))
    return cut.withColumn("t", taken).groupBy("l_linenumber").agg(F.round(F.sqrt(F.sum(F.col("a") * F.col("a") * F.col("t")) / F.sum("t")), 6).alias("rms"), F.sum("t").alias("n"))
