"""Common projections, classification, colours, paths and remaining record operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import paths, sequences
from strataloom.plans.registry import query
from strataloom.sources.files import side_and_stem
from strataloom.sources.tables import table


@query(
    "SRC04 SRC05 FLT02 FLT25 SRC37",
    """SELECT 'doc' AS kind, doc_id AS id, source AS name, left(text, 40) AS summary FROM documents UNION ALL SELECT 'item', item_id, 'item ' || item_id, left(text, 40) FROM benchmark UNION ALL SELECT 'page', page_id, url, '' FROM pages""",
)
def common_projection(spark, sf_dir):
    """Three kinds in one projection with fall-back columns."""
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "source", "text")
    items = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    every = docs.unionByName(items, allowMissingColumns=True).unionByName(pages, allowMissingColumns=True)
    name = F.coalesce("source", "url", F.concat_ws(" ", "kind", "id"))
    return every.select("kind", "id", name.alias("name"), F.left(F.coalesce("text", F.lit("")), F.lit(40)).alias("summary"))


@query("SRC06 SRC16 SRC15", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'l' WHEN c_custkey % 3 = 1 THEN 'r' END AS side, c_name AS stem FROM customer")
def side_grammar(spark, sf_dir):
    """Names with a side token at the end, taken apart."""
    end = F.when(F.col("c_custkey") % 3 == 0, "-Left").when(F.col("c_custkey") % 3 == 1, "_R").otherwise("")
    named = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", end).alias("name"))
    return named.select("c_custkey", *side_and_stem(F.col("name")))


@query("FLT04 FLT26 FLT30", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'NONE') AS segment, coalesce(CASE WHEN c_nationkey % 4 = 0 THEN 'N' || c_nationkey END, CASE WHEN c_acctbal < 0 THEN 'debt' END, 'plain') AS look, c_acctbal > 5000 AS rich FROM customer")
def defaults(spark, sf_dir):
    segment = F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.lit("NONE"))
    look = F.coalesce(F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("N"), "c_nationkey")), F.when(F.col("c_acctbal") < 0, F.lit("debt")), F.lit("plain"))
    return table(spark, sf_dir, "customer").select("c_custkey", segment.alias("segment"), look.alias("look"), (F.col("c_acctbal") > 5000).alias("rich"))


@query("FLT17 FLT32", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND NOT (event_type = 'view' AND user_id % 10 = 0) AND user_id NOT IN (3, 7)")
def group_filter(spark, sf_dir):
    wanted, restricted, off = ["click", "view"], F.col("event_type") == "view", [3, 7]
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin(wanted) & ~(restricted & (F.col("user_id") % 10 == 0)) & ~F.col("user_id").isin(off)).select("event_id")


@query("FLT33", "SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'shape' WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) <= 1e-3 THEN 'unit' ELSE 'free' END AS kind FROM embeddings")
def alignment(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    kind = F.when(F.size("embedding") != 64, "shape").when(F.abs(norm - 1) <= 1e-3, "unit").otherwise("free")
    return table(spark, sf_dir, "embeddings").select("vec_id", kind.alias("kind"))


@query(
    "JON28 GEO11",
    """WITH a AS (SELECT l_linenumber AS k, avg(l_quantity) + l_linenumber * 10 AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linenumber AS k, avg(l_extendedprice) / 1000 + l_linenumber * 12 AS y FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
    l AS (SELECT k, x, y, lag(x) OVER (ORDER BY k) AS px, lead(x) OVER (ORDER BY k) AS nx, lead(y) OVER (ORDER BY k) AS ny FROM a JOIN b USING (k)) SELECT k, round((ny - y) / (nx - x), 6) AS stretch FROM l WHERE px IS NULL OR x - px > 1e-6""",
)
def ladder(spark, sf_dir):
    """Two ladders joined on their rungs; rungs must rise, and each gap has its stretch."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.filter("l_returnflag = 'A'").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_quantity").alias("x")).withColumn("x", F.col("x") + F.col("k") * 10)
    b = lines.filter("l_returnflag = 'N'").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_extendedprice").alias("y")).withColumn("y", F.col("y") / 1000 + F.col("k") * 12)
    w = Window.orderBy("k")  # seven rungs
    both = a.join(b, "k").select("k", "x", "y", F.lag("x").over(w).alias("px"), F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))
    return both.filter("px is null or x - px > 1e-6").select("k", F.round((F.col("ny") - F.col("y")) / (F.col("nx") - F.col("x")), 6).alias("stretch"))


@query(
    "JON42",
    """SELECT o_orderkey, round((o_totalprice * 0.001) * (1 - CASE WHEN n_regionkey = 1 THEN 0.4 ELSE 0 END) * (1 - CASE WHEN c_mktsegment = 'BUILDING' THEN 0.3 ELSE 0 END) + CASE WHEN n_regionkey = 1 THEN 0.4 ELSE 0 END * 10 * (1 - CASE WHEN c_mktsegment = 'BUILDING' THEN 0.3 ELSE 0 END) + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.3 ELSE 0 END * 20, 6) AS mixed
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def layered_mix(spark, sf_dir):
    """Layers mixed in order, each over what lies below by its own share."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    mixed = F.col("o_totalprice") * 0.001
    for share, colour in ((F.when(F.col("n_regionkey") == 1, 0.4).otherwise(0.0), 10), (F.when(F.col("c_mktsegment") == "BUILDING", 0.3).otherwise(0.0), 20)):
        mixed = mixed * (1 - share) + share * colour
    return both.select("o_orderkey", F.round(mixed, 6).alias("mixed"))


@query(
    "MTH06",
    """WITH c AS (SELECT p_partkey, (p_size * 5 % 256) / 255.0 AS r, (p_partkey % 256) / 255.0 AS g, 0.5 AS b FROM part), l AS (SELECT p_partkey, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE ((r + 0.055) / 1.055) ** 2.4 END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE ((g + 0.055) / 1.055) ** 2.4 END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE ((b + 0.055) / 1.055) ** 2.4 END AS b FROM c),
    x AS (SELECT p_partkey, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM l),
    f AS (SELECT p_partkey, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16.0 / 116 END AS x, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16.0 / 116 END AS y, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16.0 / 116 END AS z FROM x)
    SELECT p_partkey, round(116 * y - 16, 4) AS l, round(500 * (x - y), 4) AS a, round(200 * (y - z), 4) AS b FROM f""",
)
def lab_colours(spark, sf_dir):
    colour = table(spark, sf_dir, "part").select("p_partkey", *paths.lab((F.col("p_size") * 5 % 256) / 255.0, (F.col("p_partkey") % 256) / 255.0, F.lit(0.5)))
    return colour.select("p_partkey", *[F.round(c, 4).alias(c) for c in ("l", "a", "b")])


@query("WIN18")
def separated_colours(spark, sf_dir):
    """Colours taken in order if they are far enough from all taken before, by brand: state over sorted rows, checked in tests."""
    part = table(spark, sf_dir, "part")
    colour = part.select("p_brand", "p_partkey", *paths.lab((F.col("p_size") * 5 % 256) / 255.0, (F.col("p_partkey") % 256) / 255.0, F.lit(0.5)))
    return sequences.streamed(colour, "p_brand", ["p_partkey"], paths.separated(3.0), "p_brand string, p_partkey long, taken int")


@query("WIN15")
def best_paths(spark, sf_dir):
    """The best path through a score plane a user: score of a place each day less a penalty on squared steps; checked in tests."""
    score = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("long").alias("day"), F.least(F.floor(F.col("value") / 10), F.lit(10)).cast("int").alias("x")).agg(F.count("*").cast("double").alias("score"))
    return paths.viterbi(score, "user_id", "day", "x", "score", penalty=0.1, places=11)


@query(
    "AGG47 AGG49 AGG50",
    """WITH c AS (SELECT l_linenumber AS z, avg(l_quantity) AS x, avg(l_discount * 100) AS y FROM lineitem GROUP BY 1) SELECT z, round(c.x, 6) AS x, round(c.y, 6) AS y, round(avg(sqrt((l_quantity - c.x) ** 2 + (l_discount * 100 - c.y) ** 2)), 6) AS radius, max(l_quantity) AS roof FROM lineitem JOIN c ON z = l_linenumber GROUP BY z, c.x, c.y""",
)
def outlines(spark, sf_dir):
    """Each slice's centre, mean distance from it and top."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("z"), F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v"))
    centre = lines.groupBy("z").agg(F.avg("u").alias("x"), F.avg("v").alias("y"))
    around = lines.join(F.broadcast(centre), "z")  # one row a slice
    radius = F.avg(F.sqrt((F.col("u") - F.col("x")) ** 2 + (F.col("v") - F.col("y")) ** 2))
    return around.groupBy("z", "x", "y").agg(F.round(radius, 6).alias("radius"), F.max("u").alias("roof")).select("z", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "radius", "roof")


@query("SNK04 SNK09", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'keep' WHEN 0 THEN 'drop' END, '') AS decision FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.n_chars > 500")
def carried_decisions(spark, sf_dir):
    from strataloom.sources.sinks import carried_over

    previous = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "drop").alias("decision"))
    return carried_over(table(spark, sf_dir, "documents").filter("n_chars > 500").select("doc_id"), previous, "doc_id", "decision")


@query("JSN03 SRC07", "SELECT event_id, k, k IN (SELECT k FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 3 = 0) AS kept FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def pruned_references(spark, sf_dir):
    """References out of nested records, each with whether its target is kept."""
    refs = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).filter("k is not null")
    keep = refs.filter("k % 3 = 0").select("k").distinct().withColumn("kept", F.lit(True))
    return refs.join(keep, "k", "left").select("event_id", "k", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("SRT06", None)
def unicode_order(spark, sf_dir):
    """All words of letters of any script in the order of a Unicode collation, which DuckDB orders otherwise; words it holds equal go by code point."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).filter(F.col("w").rlike(r"^\p{L}[\p{L}\p{M}]*$")).distinct()
    return words.orderBy(F.collate("w", "UNICODE"), "w")
