"""Gates of several checks, lookups at borders, anchors and boxes, paths to ancestors, choices by precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators import graphs, spatial, stats
from strataloom.plans.registry import query
from strataloom.sources.tables import table


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query(
    "FLT31",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 AND lower(c_mktsegment) IN ('building', 'machinery') THEN lower(c_mktsegment) END, CASE WHEN c_nationkey % 3 = 0 THEN 'stored' END, CASE WHEN c_acctbal > 5000 THEN 'browser' END, 'default') AS locale FROM customer""",
)
def locale_choice(spark, sf_dir):
    """Link over stored over browser over default; a link that names none of the known ones does not count."""
    c = table(spark, sf_dir, "customer")
    named = F.lower("c_mktsegment")
    link = F.when((F.col("c_custkey") % 7 == 0) & named.isin("building", "machinery"), named)
    return c.select("c_custkey", F.coalesce(link, F.when(F.col("c_nationkey") % 3 == 0, F.lit("stored")), F.when(F.col("c_acctbal") > 5000, F.lit("browser")), F.lit("default")).alias("locale"))


@query(
    "AGG36",
    """WITH p AS (SELECT l_linenumber AS g, l_extendedprice AS v, (l_quantity - 25) ** 2 + (l_discount * 100 - 5) ** 2 AS r2 FROM lineitem),
    c AS (SELECT g, quantile_cont(v, 0.5) FILTER (WHERE r2 < 64) AS core, quantile_cont(v, 0.9) FILTER (WHERE r2 >= 64 AND r2 < 225) AS ring FROM p GROUP BY g)
    SELECT g, round(core, 4) AS core, round(ring, 4) AS ring, round(ring / core, 6) AS contrast, ring / core > 1.5 AS ok FROM c WHERE core IS NOT NULL AND ring IS NOT NULL""",
)
def annulus_contrast(spark, sf_dir):
    """A high percentile in the ring around a centre against the median inside it."""
    r2 = (F.col("l_quantity") - 25) ** 2 + (F.col("l_discount") * 100 - 5) ** 2
    p = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_extendedprice").alias("v"), r2.alias("r2"))
    core = stats.percentiles(p.filter("r2 < 64"), "v", {"core": 0.5}, "g")
    ring = stats.percentiles(p.filter("r2 >= 64 and r2 < 225"), "v", {"ring": 0.9}, "g")
    ratio = F.col("ring") / F.col("core")
    return core.join(ring, "g").select("g", F.round("core", 4).alias("core"), F.round("ring", 4).alias("ring"), F.round(ratio, 6).alias("contrast"), (ratio > 1.5).alias("ok"))


@query(
    "AGG45",
    """WITH p AS (SELECT l_linenumber AS g, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem), q AS (SELECT g, quantile_cont(a, 0.02) AS a0, quantile_cont(a, 0.98) AS a1, quantile_cont(b, 0.02) AS b0, quantile_cont(b, 0.98) AS b1 FROM p GROUP BY g)
    SELECT g, round(b0 - a0, 4) AS low_moved, round(b1 - a1, 4) AS high_moved, abs(b1 - a1) > 0.01 * a1 AS moved FROM q""",
)
def correction_extremes(spark, sf_dir):
    """The low and high 2 percent ends of each group before and after a correction."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    ends = lambda c: stats.percentiles(p, c, {f"{c}0": 0.02, f"{c}1": 0.98}, "g")
    low, high = F.col("b0") - F.col("a0"), F.col("b1") - F.col("a1")
    return ends("a").join(ends("b"), "g").select("g", F.round(low, 4).alias("low_moved"), F.round(high, 4).alias("high_moved"), (F.abs(high) > 0.01 * F.col("a1")).alias("moved"))


@query(
    "AGG50",
    """WITH b AS (SELECT l_suppkey AS s, min(l_quantity) AS x0, max(l_quantity) AS x1, avg(l_quantity) AS mx, min(l_tax * 100) AS y0, max(l_tax * 100) AS y1, avg(l_tax * 100) AS my FROM lineitem GROUP BY 1)
    SELECT s, x0, x1, round(mx, 5) AS mx, round(y0, 5) AS y0, round(y1, 5) AS y1, round(my, 5) AS my, round(max(CASE WHEN abs(l_quantity - mx) <= 3 THEN l_extendedprice END), 4) AS roof FROM b JOIN lineitem ON l_suppkey = s GROUP BY ALL""",
)
def anchor_boxes(spark, sf_dir):
    """The box and centre of each structure, and its roof: the greatest height within 3 of the centre."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_extendedprice").alias("z"))
    box = rows.groupBy("s").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("x").alias("mx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("y").alias("my"))
    roof = rows.join(box.select("s", "mx"), "s").groupBy("s").agg(F.max(F.when(F.abs(F.col("x") - F.col("mx")) <= 3, F.col("z"))).alias("roof"))
    cut = lambda c, n=5: F.round(c, n).alias(c)
    return box.join(roof, "s").select("s", "x0", "x1", cut("mx"), cut("y0"), cut("y1"), cut("my"), cut("roof", 4))


@query(
    "JON43",
    """WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    n AS (SELECT DISTINCT a.vec_id, a.label, a.x, a.y, a.z FROM v a JOIN v b ON a.label <> 0 AND b.label = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.1)
    SELECT label, count(*) AS n, arg_min(vec_id, (z, vec_id)) AS lowest, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM n GROUP BY label""",
)
def root_zone(spark, sf_dir):
    """Points of each set within a distance of a parent set: their number, the lowest, and their mean."""
    axes = ["x", "y", "z"]
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(axes)])
    near = spatial.radius_pairs(v.filter("label <> 0"), v.filter("label = 0").withColumnRenamed("vec_id", "parent"), "vec_id", "parent", axes, 0.1).select("vec_id").distinct()
    got = v.join(near, "vec_id").groupBy("label")
    return got.agg(F.count("*").alias("n"), F.min_by("vec_id", F.struct("z", "vec_id")).alias("lowest"), *[F.round(F.avg(a), 6).alias(a) for a in axes])


_RASTER = "SELECT p_size AS i, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS j, avg(p_retailprice) AS v FROM part GROUP BY 1, 2"


@query(
    "JON26",
    f"""WITH r AS ({_RASTER}), e AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM r), p AS (SELECT event_id, value / 2 AS x, user_id / 3.0 AS y FROM events),
    q AS (SELECT event_id, CAST(least(greatest(floor(x + 0.5), i0), i1) AS INTEGER) AS i, CAST(least(greatest(floor(y + 0.5), j0), j1) AS INTEGER) AS j, floor(x + 0.5) < i0 OR floor(x + 0.5) > i1 OR floor(y + 0.5) < j0 OR floor(y + 0.5) > j1 AS outside FROM p, e)
    SELECT event_id, q.i, q.j, outside, round(v, 6) AS v FROM q LEFT JOIN r USING (i, j)""",
)
def clamped_lookup(spark, sf_dir):
    """The nearest cell of a field for each point, at its border for points outside it."""
    part = table(spark, sf_dir, "part")
    r = part.groupBy(F.col("p_size").alias("i"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("j")).agg(F.avg("p_retailprice").alias("v"))
    ends = r.agg(*[f(c).alias(f"{c}{n}") for c in "ij" for n, f in enumerate((F.min, F.max))])  # one row
    p = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") / 2 + 0.5).alias("x"), F.floor(F.col("user_id") / 3.0 + 0.5).alias("y")).crossJoin(F.broadcast(ends))
    clamp = lambda c, a: F.least(F.greatest(F.col(c), F.col(f"{a}0")), F.col(f"{a}1")).cast("int").alias(a)
    out = ~(F.col("x").between(F.col("i0"), F.col("i1")) & F.col("y").between(F.col("j0"), F.col("j1")))
    return p.select("event_id", clamp("x", "i"), clamp("y", "j"), out.alias("outside")).join(r, ["i", "j"], "left").select("event_id", "i", "j", "outside", F.round("v", 6).alias("v"))


@query(
    "STR16",
    """WITH RECURSIVE n AS (SELECT user_id AS id, min(event_id) % 40 AS parent FROM events GROUP BY user_id),
    r(id, cur, path, depth) AS (SELECT id, id, [id], 0 FROM n UNION ALL SELECT r.id, n2.parent, list_append(path, n2.parent), depth + 1 FROM r JOIN n n2 ON n2.id = r.cur WHERE depth < 3 AND NOT list_contains(path, n2.parent) AND n2.parent IN (SELECT id FROM n))
    SELECT id, array_to_string(arg_max(path, depth), ' < ') AS crumbs FROM r GROUP BY id""",
)
def breadcrumbs(spark, sf_dir):
    """Up to three ancestors of each row, joined; a row that is on the path already ends it."""
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((F.min("event_id") % 40).alias("parent"))
    found = graphs.ancestors(n, "id", "parent", 3)
    return found.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), " < ").alias("crumbs"))


@query(
    "GAT01 GAT05",
    """WITH d AS (SELECT doc_id, text, lang, source, n_chars FROM documents), f AS (
      SELECT 'schema' AS check_name, 'error' AS level, doc_id FROM d WHERE doc_id IS NULL OR lang IS NULL OR NOT regexp_matches(lang, '^[a-z]{2}$') OR source IS NULL
      UNION ALL SELECT 'length', 'warn', doc_id FROM d WHERE n_chars <> length(text) OR n_chars < 20
      UNION ALL SELECT 'duplicate', 'error', doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i FROM d WHERE text IS NOT NULL) WHERE i > 1
      UNION ALL SELECT 'label', 'warn', l.doc_id FROM labels l ANTI JOIN d USING (doc_id)
      UNION ALL SELECT 'cited', 'error', doc_id FROM d WHERE regexp_matches(text, '(?i)lorem ipsum|todo:|password')
      UNION ALL SELECT 'wide line', 'warn', doc_id FROM d WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 2000)) > 0)
    SELECT check_name, level, count(*) AS n, min(doc_id) AS first, level = 'error' AND count(*) > 0 AS stops FROM f GROUP BY 1, 2""",
)
def content_gate(spark, sf_dir):
    """Six checks of the content as one report: how many rows each finds, the first, and whether it stops the build."""
    d = table(spark, sf_dir, "documents")
    hit = lambda name, level, rows: rows.select(F.lit(name).alias("check_name"), F.lit(level).alias("level"), "doc_id")
    again = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))
    valid = F.coalesce(F.col("lang").rlike("^[a-z]{2}$"), F.lit(False)) & F.col("doc_id").isNotNull() & F.col("source").isNotNull()
    found = _all(
        [
            hit("schema", "error", d.filter(~valid)),
            hit("length", "warn", d.filter((F.col("n_chars") != F.length("text")) | (F.col("n_chars") < 20))),
            hit("duplicate", "error", d.filter("text is not null").withColumn("i", again).filter("i > 1")),
            hit("label", "warn", table(spark, sf_dir, "labels").join(d.select("doc_id"), "doc_id", "left_anti")),
            hit("cited", "error", d.filter(F.col("text").rlike("(?i)lorem ipsum|todo:|password"))),
            hit("wide line", "warn", d.filter(F.exists(F.split("text", "\n"), lambda x: F.length(x) > 2000))),
        ]
    )
    return found.groupBy("check_name", "level").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), ((F.first("level") == "error") & (F.count("*") > 0)).alias("stops"))


@query(
    "GAT03",
    """WITH m AS (SELECT o_orderkey AS id, o_custkey % 9 AS listed, o_orderpriority AS kind FROM orders), f AS (SELECT l_orderkey AS id, count(*) AS has FROM lineitem GROUP BY 1),
    j AS (SELECT coalesce(m.id, f.id) AS id, m.id IS NULL AS unknown, f.id IS NULL AS missing, abs(listed - has) > 2 AS off, m.id IS NOT NULL AND kind NOT IN ('1-URGENT', '2-HIGH', '5-LOW') AS odd FROM m FULL JOIN f ON f.id = m.id)
    SELECT problem, count(*) AS n, min(id) AS first FROM (SELECT id, unnest(list_filter([CASE WHEN unknown THEN 'not listed' END, CASE WHEN missing THEN 'no file' END, CASE WHEN off THEN 'count off' END, CASE WHEN odd THEN 'unknown kind' END], lambda x: x IS NOT NULL)) AS problem FROM j) GROUP BY problem""",
)
def data_gate(spark, sf_dir):
    """Listed against present: not listed, no file, counts apart by more than two, kinds that are not known."""
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9).alias("listed"), F.col("o_orderpriority").alias("kind"), F.lit(True).alias("in_list"))
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("has"))
    j = m.join(f, "id", "full_outer")
    checks = {"not listed": F.col("in_list").isNull(), "no file": F.col("has").isNull(), "count off": F.abs(F.col("listed") - F.col("has")) > 2, "unknown kind": F.col("in_list") & ~F.col("kind").isin("1-URGENT", "2-HIGH", "5-LOW")}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return j.select("id", F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(
    "GAT07",
    """WITH x AS (SELECT 'src' || i AS secret FROM (SELECT unnest([3, 7, 999]) AS i)), b AS (SELECT lang, CAST(to_json(list({'id': doc_id, 'source': source} ORDER BY doc_id)) AS VARCHAR) AS body FROM documents WHERE source NOT IN ('src3') GROUP BY lang)
    SELECT lang, secret, contains(body, '"' || secret || '"') AS leaks FROM b, x""",
)
def blob_check(spark, sf_dir):
    """Whether the written form of what is left after a filter still names an excluded id, as a quoted string."""
    d = table(spark, sf_dir, "documents").filter("source <> 'src3'")
    named = d.withColumn("body", F.to_json(F.struct(F.col("doc_id").alias("id"), "source")))
    secrets = F.array(*[F.lit(f"src{i}") for i in (3, 7, 999)])
    hits = named.select("lang", "body", F.explode(secrets).alias("secret"))
    quoted = F.contains("body", F.concat(F.lit('"'), "secret", F.lit('"')))
    return hits.groupBy("lang", "secret").agg(F.max(quoted).alias("leaks"))  # a blob holds the name just if a row of it does


@query(
    "GAT09",
    """WITH en AS (SELECT p_partkey AS k, p_name || ' ' || p_size || ' [a](u' || p_size % 3 || ')' AS t FROM part), tr AS (SELECT p_partkey AS k, md5(p_name || ' ' || (p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END) || ' [a](u' || p_size % 3 || ')') AS hash, 'x ' || (p_size + CASE WHEN p_partkey % 13 = 0 THEN 5 ELSE 0 END) || ' [b](u' || (p_size + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END) % 3 || ')' AS t FROM part WHERE p_partkey % 6 > 0 UNION ALL SELECT -1 - n_nationkey, 'none', 'x' FROM nation),
    j AS (SELECT coalesce(en.k, tr.k) AS k, CASE WHEN en.k IS NULL THEN 'unknown' WHEN tr.k IS NULL THEN 'missing' WHEN md5(en.t) <> hash THEN 'stale' WHEN list_sort(regexp_extract_all(en.t, '\\]\\(([^)]*)\\)', 1)) <> list_sort(regexp_extract_all(tr.t, '\\]\\(([^)]*)\\)', 1)) THEN 'links' WHEN list_sort(regexp_extract_all(en.t, '[0-9]+')) <> list_sort(regexp_extract_all(tr.t, '[0-9]+')) THEN 'numbers' ELSE 'ok' END AS status FROM en FULL JOIN tr ON en.k = tr.k)
    SELECT status, count(*) AS n, min(k) AS first FROM j GROUP BY status""".replace("\\\\", "\\"),
)
def translation_gate(spark, sf_dir):
    """Translations against their originals: missing, unknown, made from another wording, other links, other numbers."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    worded = lambda n: F.concat("p_name", F.lit(" "), n, F.lit(" [a](u"), size % 3, F.lit(")"))
    plus = lambda of, by: size + F.when(k % of == 0, by).otherwise(0)
    en = p.select(k.alias("k"), worded(size).alias("t"), F.lit(True).alias("known"))
    tr = p.filter(k % 6 > 0).select(k.alias("k"), F.md5(worded(plus(10, 1))).alias("hash"), F.concat(F.lit("x "), plus(13, 5), F.lit(" [b](u"), plus(17, 1) % 3, F.lit(")")).alias("u"))
    tr = tr.union(table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long"), F.lit("none"), F.lit("x")))
    found = lambda c, pattern, g: F.array_sort(F.regexp_extract_all(c, F.lit(pattern), F.lit(g)))
    differ = lambda pattern, g: found("t", pattern, g) != found("u", pattern, g)
    status: Column = F.when(F.col("known").isNull(), F.lit("unknown")).when(F.col("hash").isNull(), F.lit("missing")).when(F.md5("t") != F.col("hash"), F.lit("stale"))
    status = status.when(differ(r"\]\(([^)]*)\)", 1), F.lit("links")).when(differ("[0-9]+", 0), F.lit("numbers")).otherwise(F.lit("ok"))
    return en.join(tr, "k", "full_outer").select("k", status.alias("status")).groupBy("status").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query(
    "SRC05",
    "SELECT e.event_id AS id, e.event_type AS kind, coalesce(p.event_type || ' ' || p.event_id, '-') AS parent FROM events e LEFT JOIN events p ON p.event_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT) AND p.event_type <> 'error' WHERE e.event_type IN ('click', 'view', 'purchase')",
)
def parent_names(spark, sf_dir):
    """Entries of three kinds with the name of the entry that they name as their parent."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    parents = e.filter("event_type <> 'error'").select(F.col("event_id").alias("k"), F.concat("event_type", F.lit(" "), "event_id").alias("parent"))
    return e.filter(F.col("event_type").isin("click", "view", "purchase")).join(parents, "k", "left").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.coalesce("parent", F.lit("-")).alias("parent"))
