"""State folded from events: changes, debounce, latest wins, clicks, frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.plans.registry import query
from strataloom.sources.tables import table


@query(
    "STM01",
    """SELECT user_id, count(*) FILTER (WHERE changed) AS fired, arg_max(event_type, (ts, event_id)) AS state FROM (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events) GROUP BY user_id""",
)
def state_fold(spark, sf_dir):
    """Each user's last state, and how often a change fired: a patch that changes nothing is silent."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", changed.alias("changed"))
    return rows.groupBy("user_id").agg(F.count_if("changed").alias("fired"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("STM02", "SELECT event_id FROM (SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, ts FROM events) WHERE next IS NULL OR next - ts > INTERVAL 2 HOUR")
def debounce(spark, sf_dir):
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", following.alias("next"))
    return rows.filter(F.col("next").isNull() | (F.col("next") - F.col("ts") > F.expr("interval 2 hours"))).select("event_id")


@query(
    "STM03",
    "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS frame, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS samples FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND date_trunc('day', p.ts) = date_trunc('day', e.ts)) GROUP BY 1, 2",
)
def frame_samples(spark, sf_dir):
    """One sample a frame, none in frames that are busy."""
    e = table(spark, sf_dir, "events").withColumn("frame", F.date_trunc("day", "ts"))
    busy = e.filter("event_type = 'purchase'").select("user_id", "frame").distinct()
    return e.join(busy, ["user_id", "frame"], "left_anti").groupBy("user_id", "frame").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("samples"))


@query("STM04", "SELECT event_id, up FROM (SELECT event_id, event_type, value, ts, lead(event_id) OVER w AS up, lead(ts) OVER w AS ts2, lead(value) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND abs(v2 - value) <= 30 AND ts2 - ts < INTERVAL 12 HOUR")
def click_pairs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = lambda c: F.lead(c).over(w)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts", after("event_id").alias("up"), after("ts").alias("ts2"), after("value").alias("v2"))
    short = F.col("ts2") - F.col("ts") < F.expr("interval 12 hours")
    return rows.filter((F.col("event_type") == "click") & (F.abs(F.col("v2") - F.col("value")) <= 30) & short).select("event_id", "up")


@query("STM07 STM09", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY 1, 2")
def latest_wins(spark, sf_dir):
    """A slower earlier result must not win."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("at"))


@query("FLT07 FLT15 GEO18 MTH11", "SELECT event_id, CASE WHEN value > 90 THEN 'selected' WHEN event_type = 'view' THEN 'hover' WHEN user_id % 5 = 0 AND value < 20 THEN 'dimmed' WHEN user_id % 5 = 0 THEN 'involved' ELSE 'normal' END AS state, CAST((value > 50)::INTEGER * 3 + (event_type = 'click')::INTEGER * 2 - (value < 5)::INTEGER * 9 AS INTEGER) AS score FROM events")
def visual_state(spark, sf_dir):
    """Ordered cases, and a score from rules with a hard reject."""
    value, user = F.col("value"), F.col("user_id")
    state = F.when(value > 90, "selected").when(F.col("event_type") == "view", "hover").when((user % 5 == 0) & (value < 20), "dimmed").when(user % 5 == 0, "involved").otherwise("normal")
    score = (value > 50).cast("int") * 3 + (F.col("event_type") == "click").cast("int") * 2 - (value < 5).cast("int") * 9
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"), score.alias("score"))


@query("DTE01", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INTEGER) AS year, regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS ok FROM orders")
def iso_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.year("o_orderdate").alias("year"), day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("ok"))
