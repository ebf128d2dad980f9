"""Overrides and leases on what is shown, modes, selectors, ordered lists, and records, documents and catalogues made of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strataloom.plans.registry import query
from strataloom.sources.tables import table


@query(
    "FLT29",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS op, CAST(floor(value) AS INTEGER) % 10 AS id FROM events),
    b AS (SELECT user_id, coalesce(max(i) FILTER (WHERE op IN ('purchase', 'error')), 0) AS wall FROM e GROUP BY user_id),
    o AS (SELECT e.* FROM e JOIN b USING (user_id) WHERE i >= wall AND op IN ('click', 'view', 'purchase'))
    SELECT user_id, id, arg_max(CASE WHEN op = 'view' THEN 'hidden' ELSE 'shown' END, i) AS state FROM o GROUP BY user_id, id""",
)
def override_sets(spark, sf_dir):
    """What each user's clicks (show), views (hide), purchases (show only this) and errors (back to the defaults) leave overridden.

    Nothing before the last solo or reset matters, and after it the last change
    of an id decides: a maximum over rows, without state in order.
    """
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("i"), F.col("event_type").alias("op"), (F.floor("value").cast("int") % 10).alias("id"))
    wall = F.coalesce(F.max(F.when(F.col("op").isin("purchase", "error"), F.col("i"))).over(w), F.lit(0))
    rows = e.withColumn("wall", wall).filter((F.col("i") >= F.col("wall")) & F.col("op").isin("click", "view", "purchase"))
    state = F.when(F.col("op") == "view", F.lit("hidden")).otherwise(F.lit("shown"))
    return rows.groupBy("user_id", "id").agg(F.max_by(state, "i").alias("state"))


@query(
    "SET09",
    """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'hidden' WHEN p_size % 5 = 1 THEN 'shown' ELSE 'none' END AS was, p_type = 'ECONOMY' AS system FROM part),
    v AS (SELECT *, was = 'shown' OR (was = 'none' AND system) AS visible, id % 3 = 0 AS asked FROM p)
    SELECT id, was, asked AND NOT visible AS leased, CASE WHEN asked AND NOT visible THEN 'shown' ELSE was END AS during, CASE WHEN asked AND NOT visible THEN was WHEN id % 11 = 0 THEN 'hidden' ELSE was END AS after FROM v""",
)
def lease_and_restore(spark, sf_dir):
    """Ids shown for a mode and given back what they had: only those not visible are touched, other changes meanwhile stay."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size") % 5
    rows = p.select(F.col("p_partkey").alias("id"), F.when(n == 0, F.lit("hidden")).when(n == 1, F.lit("shown")).otherwise(F.lit("none")).alias("was"), (F.col("p_type") == "ECONOMY").alias("system"))
    visible = (F.col("was") == "shown") | ((F.col("was") == "none") & F.col("system"))
    leased = (F.col("id") % 3 == 0) & ~visible
    meanwhile = F.when(F.col("id") % 11 == 0, F.lit("hidden")).otherwise(F.col("was"))
    return rows.select("id", "was", leased.alias("leased"), F.when(leased, F.lit("shown")).otherwise(F.col("was")).alias("during"), F.when(leased, F.col("was")).otherwise(meanwhile).alias("after"))


@query("FLT28", "WITH k AS (SELECT DISTINCT lower(p_type) AS k, CASE WHEN lower(p_type) IN ('small', 'large') THEN 'template' ELSE 'subject' END AS kind FROM part UNION SELECT DISTINCT lower(p_brand), CASE WHEN p_brand LIKE '%1' THEN 'subject' ELSE 'other' END FROM part) SELECT k AS key, row_number() OVER (ORDER BY CASE k WHEN 'small' THEN 0 WHEN 'large' THEN 1 ELSE 2 END, k) AS place FROM k WHERE k IN ('small', 'large') OR kind = 'subject'")
def contrast_list(spark, sf_dir):
    """Two fixed keys first where they are there, then all keys of the one kind by name."""
    p = table(spark, sf_dir, "part")
    low = F.lower("p_type")
    fixed = low.isin("small", "large")
    keys = p.select(low.alias("key"), F.when(fixed, F.lit("template")).otherwise(F.lit("subject")).alias("kind")).union(p.select(F.lower("p_brand"), F.when(F.endswith("p_brand", F.lit("1")), F.lit("subject")).otherwise(F.lit("other")))).distinct()
    first = F.when(F.col("key") == "small", 0).when(F.col("key") == "large", 1).otherwise(2)
    return keys.filter(F.col("key").isin("small", "large") | (F.col("kind") == "subject")).select("key", F.row_number().over(Window.orderBy(first, "key")).alias("place"))


@query(
    "FLT34",
    """WITH e AS (SELECT user_id, event_id, row_number() OVER w AS i, event_type AS id, value > 50 AS side, CAST(floor(value) AS INTEGER) % 4 AS step, lag(event_type) OVER w AS before, lag(value > 50) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, CASE WHEN id = 'error' THEN CASE WHEN before IS NOT NULL AND before <> 'error' THEN 'restore' ELSE 'none' END WHEN before IS NULL OR before = 'error' OR before <> id THEN 'first' WHEN was <> side THEN 'relayout' ELSE 'step' END AS move, CASE WHEN id <> 'error' THEN step END AS step FROM e""",
)
def mode_moves(spark, sf_dir):
    """What entering a mode does: place it first, lay it out again when only the side changed, or take a step; leaving restores."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("id"), (F.col("value") > 50).alias("side"), (F.floor("value").cast("int") % 4).alias("step"), F.lag("event_type").over(w).alias("before"), F.lag(F.col("value") > 50).over(w).alias("was"))
    left = F.col("id") == "error"
    out = F.coalesce(F.col("before") == "error", F.lit(True))  # nothing is placed
    move = F.when(left & ~out, F.lit("restore")).when(left, F.lit("none")).when(out | (F.col("before") != F.col("id")), F.lit("first")).when(F.col("was") != F.col("side"), F.lit("relayout")).otherwise(F.lit("step"))
    return e.select("user_id", "event_id", move.alias("move"), F.when(~left, F.col("step")).alias("step"))


@dataclass(frozen=True)
class Selector:
    """A part of the state, and when two of its values count as equal."""

    name: str
    part: str
    equal: str


SELECTORS = (
    Selector("kind", "event_type", "now IS NOT DISTINCT FROM before"),
    Selector("level", "CAST(floor(value / 25) AS STRING)", "now IS NOT DISTINCT FROM before"),
    Selector("near", "CAST(value AS STRING)", "abs(CAST(now AS DOUBLE) - CAST(before AS DOUBLE)) <= 10"),
)


def _selector_sql(s: Selector) -> str:
    part = s.part.replace("STRING", "VARCHAR")
    return f"SELECT user_id, '{s.name}' AS selector, count(*) AS fired FROM (SELECT user_id, {part} AS now, lag({part}) OVER w AS before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i > 1 AND NOT coalesce({s.equal}, false) GROUP BY 1"


@query("UDF05", " UNION ALL ".join(_selector_sql(s) for s in SELECTORS))
def selector_changes(spark, sf_dir):
    """How often each subscription fires: a selector gives the part that is watched, and its equality what counts as no change."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("i"), *[F.expr(s.part).alias(s.name) for s in SELECTORS], *[F.lag(F.expr(s.part)).over(w).alias(f"{s.name}_before") for s in SELECTORS])

    def fires(s: Selector) -> Column:
        same = s.equal.replace("IS NOT DISTINCT FROM", "<=>").replace("now", s.name).replace("before", f"{s.name}_before")
        return F.count_if((F.col("i") > 1) & ~F.coalesce(F.expr(same), F.lit(False))).alias(s.name)

    counted = e.groupBy("user_id").agg(*[fires(s) for s in SELECTORS])
    return counted.unpivot(["user_id"], [s.name for s in SELECTORS], "selector", "fired").filter("fired > 0")


@query(
    "SNK12",
    """WITH l AS (SELECT row_number() OVER (ORDER BY source) AS line, coalesce(source, '-') || ': ' || count(*) || ' texts in ' || string_agg(DISTINCT lang, ', ' ORDER BY lang) AS fresh FROM documents GROUP BY source),
    o AS (SELECT row_number() OVER (ORDER BY source) AS line, coalesce(source, '-') || ': ' || count(*) || ' texts in ' || string_agg(DISTINCT lang, ', ' ORDER BY lang) AS held FROM documents WHERE doc_id % 17 <> 3 AND source <> 'src9' GROUP BY source)
    SELECT line, fresh, held, fresh IS DISTINCT FROM held AS stale FROM l FULL JOIN o USING (line)""",
)
def attribution_lines(spark, sf_dir):
    """A notice with one line a source, against the one that is held, line by line: stale where they differ or one is missing."""

    def rendered(rows, name: str):
        langs = F.array_join(F.array_sort(F.collect_set("lang")), ", ")
        made = rows.groupBy("source").agg(F.concat(F.coalesce("source", F.lit("-")), F.lit(": "), F.count("*"), F.lit(" texts in "), langs).alias(name))
        return made.select(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).alias("line"), name)  # one row a source

    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    both = rendered(d, "fresh").join(rendered(d.filter("doc_id % 17 <> 3 and source <> 'src9'"), "held"), "line", "full_outer")
    return both.select("line", "fresh", "held", (~F.col("fresh").eqNullSafe(F.col("held"))).alias("stale"))


#: Sentences of a handbook with the counts they state, by table.
SENTENCES = (
    ("region", "The atlas has 5 regions."),
    ("nation", "There are 24 nations in all."),
    ("supplier", "Goods come from 100 suppliers over 25 places."),
    ("part", "No count is given here."),
)


@query(
    "SNK14",
    f"""WITH t(name, says) AS (VALUES {", ".join(f"('{n}', '{s}')" for n, s in SENTENCES)}), n AS (SELECT 'region' AS name, count(*) AS has FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part)
    SELECT name, has, TRY_CAST(nullif(regexp_extract(says, '([0-9]+)', 1), '') AS BIGINT) AS stated, CASE WHEN NOT regexp_matches(says, '[0-9]') THEN 'gone' WHEN CAST(regexp_extract(says, '([0-9]+)', 1) AS BIGINT) = has THEN 'same' ELSE 'drift' END AS status, regexp_replace(says, '[0-9]+', CAST(has AS VARCHAR)) AS rewritten FROM t JOIN n USING (name)""",
)
def stated_counts(spark, sf_dir):
    """Counts that sentences state against the tables: the same, drifted or gone; and the sentence with the right one."""
    has = None
    for name, _ in SENTENCES:
        one = table(spark, sf_dir, name).agg(F.count("*").alias("has")).withColumn("name", F.lit(name))
        has = one if has is None else has.unionByName(one)
    rows = spark.createDataFrame(list(SENTENCES), "name string, says string").join(has, "name")
    stated = F.regexp_extract("says", "([0-9]+)", 1).try_cast("long")
    status = F.when(stated.isNull(), F.lit("gone")).when(stated == F.col("has"), F.lit("same")).otherwise(F.lit("drift"))
    return rows.select("name", "has", stated.alias("stated"), status.alias("status"), F.regexp_replace(F.col("says"), F.lit("^([^0-9]*)[0-9]+"), F.concat(F.lit("$1"), F.lit("\u0000"), F.col("has").cast("string"))).alias("r")).select("name", "has", "stated", "status", F.replace("r", F.lit("\u0000"), F.lit("")).alias("rewritten"))


#: The order of the domain, in which members are listed.
DOMAIN = ("signup", "view", "click", "purchase", "refund", "error")


@query(
    "SNK18",
    f"""WITH d(k, o) AS (VALUES {", ".join(f"('{k}', {o})" for o, k in enumerate(DOMAIN))})
    SELECT user_id, string_agg(event_type, ',' ORDER BY coalesce(o, 999), event_type) AS members, count(*) AS n, round(min(lo), 4) AS lo, round(max(hi), 4) AS hi, CASE WHEN sum(measured) > 0 THEN 'measured' ELSE 'estimated' END AS method FROM (SELECT user_id, event_type, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE value > 200) AS measured FROM events GROUP BY 1, 2) LEFT JOIN d ON k = event_type GROUP BY user_id""",
)
def provenance_records(spark, sf_dir):
    """One record a subject: its members once each in the order of the domain (others after, by name), its extent, and how it was made."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value") > 200).alias("measured"))
    place = F.array_position(F.array(*[F.lit(k) for k in DOMAIN]), F.col("event_type"))
    order = F.when(place > 0, place - 1).otherwise(999)
    members = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col("event_type").alias("k")))), lambda x: x["k"]), ",")
    method = F.when(F.sum("measured") > 0, F.lit("measured")).otherwise(F.lit("estimated"))
    return e.groupBy("user_id").agg(members.alias("members"), F.count("*").alias("n"), F.round(F.min("lo"), 4).alias("lo"), F.round(F.max("hi"), 4).alias("hi"), method.alias("method"))


@dataclass(frozen=True)
class Output:
    """One product of the catalogue: rows of a table that meet a condition, and what is added up."""

    name: str
    table: str
    where: str
    measure: str


def both_sides(name: str, of: str, measure: str, side: str) -> tuple[Output, Output]:
    """The same product for each half of a condition."""
    return Output(f"{name}-l", of, side, measure), Output(f"{name}-r", of, f"NOT ({side})", measure)


CATALOGUE = (
    Output("open-orders", "orders", "o_orderstatus = 'O'", "o_totalprice"),
    *both_sides("parts", "part", "p_retailprice", "p_size <= 25"),
    *both_sides("balance", "customer", "c_acctbal", "c_acctbal >= 0"),
    Output("fast-lines", "lineitem", "l_quantity > 40 AND l_discount < 0.05", "l_extendedprice"),
)


@query("UDF03", " UNION ALL ".join(f"SELECT '{o.name}' AS name, count(*) AS n, round(coalesce(sum({o.measure}), 0), 2) AS total FROM {o.table} WHERE {o.where}" for o in CATALOGUE))
def catalogue_outputs(spark, sf_dir):
    """All products of the catalogue, each from its row of the table of outputs."""
    out = None
    for o in CATALOGUE:
        one = table(spark, sf_dir, o.table).filter(o.where).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(o.measure), F.lit(0.0)), 2).alias("total")).withColumn("name", F.lit(o.name))
        out = one if out is None else out.unionByName(one)
    return out.select("name", "n", "total")


#: The schema of each kind of record; a kind that is not here is unknown.
KIND_SCHEMAS = {"click": "k int", "view": "k long, seen boolean", "purchase": "k int, price double"}


@query(
    "UDF04",
    f"""SELECT event_id, event_type AS kind, CASE WHEN event_type NOT IN ({", ".join(f"'{k}'" for k in KIND_SCHEMAS)}) THEN 'unknown kind' WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'no k' ELSE 'ok' END AS status, CASE WHEN event_type IN ({", ".join(f"'{k}'" for k in KIND_SCHEMAS)}) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def kinds_by_schema(spark, sf_dir):
    """Records read by the schema registered for their kind; adding a kind is adding a schema."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "props")
    read = F.coalesce(*[F.when(F.col("kind") == k, F.from_json("props", s)["k"].cast("long")) for k, s in KIND_SCHEMAS.items()])
    known = F.col("kind").isin(*KIND_SCHEMAS)
    status = F.when(~known, F.lit("unknown kind")).when(read.isNull(), F.lit("no k")).otherwise(F.lit("ok"))
    return e.select("event_id", "kind", status.alias("status"), read.alias("k"))


#: Templates that come before all others, in this order.
PRECEDENCE = ("large", "economy")


@query("SRC31", "WITH t AS (SELECT lower(p_type) AS name, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT lower(p_brand), count(*) FROM part GROUP BY 1) SELECT name, n, row_number() OVER (ORDER BY CASE name WHEN 'large' THEN 0 WHEN 'economy' THEN 1 ELSE 999 END, name) AS place FROM t")
def template_order(spark, sf_dir):
    """Templates in a fixed precedence, then by name."""
    p = table(spark, sf_dir, "part")
    names = p.groupBy(F.lower("p_type").alias("name")).agg(F.count("*").alias("n")).unionByName(p.groupBy(F.lower("p_brand").alias("name")).agg(F.count("*").alias("n")))
    place = F.array_position(F.array(*[F.lit(x) for x in PRECEDENCE]), F.col("name"))
    rank = F.when(place > 0, place - 1).otherwise(999)
    return names.select("name", "n", F.row_number().over(Window.orderBy(rank, "name")).alias("place"))  # a row a template


@query(
    "SRC29",
    """WITH m AS (SELECT 'p' || page_id AS id, html AS body FROM pages UNION ALL SELECT 'e' || event_id, CASE WHEN event_id % 4 = 0 THEN '{"version": 2, "meshes": [' || event_id || ']}' WHEN event_id % 4 = 1 THEN '{"version": 1, "meshes": []}' WHEN event_id % 4 = 2 THEN props ELSE 'not json' END FROM events)
    SELECT id, CASE WHEN body IS NULL OR regexp_matches(body, '^\\s*<') THEN 'missing data' WHEN NOT json_valid(body) THEN 'not json' WHEN json_extract_string(body, '$.version') IS NULL THEN 'no version' WHEN TRY_CAST(json_extract_string(body, '$.version') AS INTEGER) <> 2 THEN 'old version' WHEN json_array_length(body, '$.meshes') = 0 THEN 'empty' ELSE 'ok' END AS status FROM m""".replace("\\\\", "\\"),
)
def manifest_status(spark, sf_dir):
    """Manifests by version and shape; a page where JSON was asked for means that the data is missing."""
    n = F.col("event_id") % 4
    body = F.when(n == 0, F.concat(F.lit('{"version": 2, "meshes": ['), "event_id", F.lit("]}"))).when(n == 1, F.lit('{"version": 1, "meshes": []}')).when(n == 2, F.col("props")).otherwise(F.lit("not json"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("body"))
    rows = pages.union(table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id"), body))
    version = F.get_json_object("body", "$.version")
    status = (
        F.when(F.col("body").isNull() | F.col("body").rlike(r"^\s*<"), F.lit("missing data"))
        .when(F.get_json_object("body", "$").isNull(), F.lit("not json"))
        .when(version.isNull(), F.lit("no version"))
        .when(version.try_cast("int") != 2, F.lit("old version"))
        .when(F.json_array_length(F.get_json_object("body", "$.meshes")) == 0, F.lit("empty"))
        .otherwise(F.lit("ok"))
    )
    return rows.select("id", status.alias("status"))


@query(
    "SRC32",
    """WITH j AS (SELECT event_id, '{"markups": [{"controlPoints": [{"label": "' || event_type || '", "position": [' || user_id || ', ' || (event_id % 9) || ', 1.5]}, {"label": "end", "position": [0, ' || user_id || ', -2]}]}]}' AS body FROM events),
    p AS (SELECT event_id, unnest(CAST(json_extract(body, '$.markups[0].controlPoints') AS JSON[])) AS c FROM j)
    SELECT event_id, json_extract_string(c, '$.label') AS label, CAST(json_extract_string(c, '$.position[0]') AS DOUBLE) AS x, CAST(json_extract_string(c, '$.position[1]') AS DOUBLE) AS y, CAST(json_extract_string(c, '$.position[2]') AS DOUBLE) AS z FROM p""",
)
def markup_points(spark, sf_dir):
    """The control points of markup documents, one row a point."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"markups": [{"controlPoints": [{"label": "'), "event_type", F.lit('", "position": ['), "user_id", F.lit(", "), F.col("event_id") % 9, F.lit(', 1.5]}, {"label": "end", "position": [0, '), "user_id", F.lit(", -2]}]}]}"))
    read = F.from_json(body, "markups array<struct<controlPoints:array<struct<label:string,position:array<double>>>>>")
    points = e.select("event_id", F.explode(F.flatten(F.transform(read["markups"], lambda m: m["controlPoints"]))).alias("c"))
    return points.select("event_id", "c.label", *[F.get("c.position", F.lit(i)).alias(a) for i, a in enumerate("xyz")])


#: Columns of a page by where a word starts, and the pattern of an id, which opens a row.
COLUMNS = (("id", 0.0, 12.0), ("term", 12.0, 40.0), ("note", 40.0, 999.0))


@query(
    "SRC17",
    """WITH w AS (SELECT l_suppkey AS book, l_orderkey // 50 AS page, l_orderkey % 50 AS y, CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 2.0 ELSE 12 + l_quantity END AS x, CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 'A' || l_orderkey ELSE 'w' || l_partkey END AS word, l_linenumber AS n, l_extendedprice AS tie FROM lineitem),
    c AS (SELECT *, CASE WHEN x < 12 THEN 'id' WHEN x < 40 THEN 'term' ELSE 'note' END AS col FROM w), r AS (SELECT *, last_value(CASE WHEN col = 'id' THEN word END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, y, x, word, n, tie ROWS UNBOUNDED PRECEDING) AS row_id FROM c)
    SELECT book, row_id, string_agg(word, ' ' ORDER BY page, y, x, word, n, tie) FILTER (WHERE col = 'term') AS term, string_agg(word, ' ' ORDER BY page, y, x, word, n, tie) FILTER (WHERE col = 'note') AS note, max(page) - min(page) AS turns FROM r WHERE row_id IS NOT NULL GROUP BY book, row_id""",
)
def words_to_rows(spark, sf_dir):
    """Words on pages put into columns by where they start; an id opens a row, which goes on over pages until the next one."""
    lines = table(spark, sf_dir, "lineitem")
    opens = (F.col("l_linenumber") == 1) & (F.col("l_partkey") % 3 == 0)
    x = F.when(opens, F.lit(2.0)).otherwise(12 + F.col("l_quantity"))
    word = F.when(opens, F.concat(F.lit("A"), "l_orderkey")).otherwise(F.concat(F.lit("w"), "l_partkey"))
    w = lines.select(F.col("l_suppkey").alias("book"), F.floor(F.col("l_orderkey") / 50).alias("page"), (F.col("l_orderkey") % 50).alias("y"), x.alias("x"), word.alias("word"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("tie"))
    column = F.coalesce(*[F.when((F.col("x") >= lo) & (F.col("x") < hi), F.lit(name)) for name, lo, hi in COLUMNS])
    order = ["page", "y", "x", "word", "n", "tie"]
    w = w.withColumn("col", column)
    opened = F.last(F.when(F.col("col") == "id", F.col("word")), True).over(Window.partitionBy("book").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = w.withColumn("row_id", opened).filter("row_id is not null")
    said = lambda name: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("col") == name, F.struct(*order)))), lambda t: t["word"]), " "), F.lit(""))
    return rows.groupBy("book", "row_id").agg(said("term").alias("term"), said("note").alias("note"), (F.max("page") - F.min("page")).alias("turns"))
