"""Further rules of gates: marks and lengths of translations, boxes and byte lengths of data, file lists; pages of a corpus; kept components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import graphs
from strataloom.plans.registry import query
from strataloom.sources import files
from strataloom.sources.tables import table

#: Fixed values (inventory row GAT09): the least and the largest ratio of a translation's length to its original's.
RATIO = (0.6, 2.2)


@query(
    "GAT09",
    f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER w AS other, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, turn, text AS o, other AS t FROM t WHERE next = turn + 1), c AS (SELECT *, length(t)::DOUBLE / greatest(1, length(o)) AS r FROM p),
    x AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN t IS NULL OR trim(t) = '' THEN 'empty' END,
      CASE WHEN trim(t) = trim(o) AND len(string_split_regex(trim(o), '\\s+')) > 3 THEN 'identical' END,
      CASE WHEN list_sort(list_transform(regexp_extract_all(o, '[0-9]+([.,][0-9]+)?'), lambda n: replace(n, ',', '.'))) IS DISTINCT FROM list_sort(list_transform(regexp_extract_all(t, '[0-9]+([.,][0-9]+)?'), lambda n: replace(n, ',', '.'))) THEN 'numbers' END,
      CASE WHEN length(o) - length(replace(o, '**', '')) <> length(t) - length(replace(t, '**', '')) THEN 'bold' END,
      CASE WHEN r < {RATIO[0]} OR r > {RATIO[1]} THEN 'length' END], lambda v: v IS NOT NULL)) AS problem FROM c)
    SELECT problem, count(*) AS n, min(conv_id) AS first FROM x GROUP BY problem""",
)
def translation_marks(spark, sf_dir):
    """Each turn against the one before as if it were its translation: empty, the same, other numbers, other bold marks, a length out of bounds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("o"), F.lead("text").over(w).alias("t"), F.lead("turn").over(w).alias("next")).filter("next = turn + 1")
    ratio = F.length("t") / F.greatest(F.lit(1), F.length("o"))
    numbers = lambda c: F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+([.,][0-9]+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("."))))
    bold = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("**"), F.lit("")))
    same = (F.trim("t") == F.trim("o")) & (F.size(F.split(F.trim("o"), r"\s+")) > 3)
    rules = {"empty": F.col("t").isNull() | (F.trim("t") == ""), "identical": same, "numbers": ~numbers("o").eqNullSafe(numbers("t")), "bold": bold("o") != bold("t"), "length": (ratio < RATIO[0]) | (ratio > RATIO[1])}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return turns.select("conv_id", F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


#: Box that everything placed has to lie in, and how far a listed centre may lie beyond its own box.
FIELD, LOOSE = ((1.5, 49.5), (0.0, 10.0), (0.0, 7.5)), 1.0


@query(
    "GAT03",
    f"""WITH b AS (SELECT l_suppkey AS id, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount * 100) AS y0, max(l_discount * 100) AS y1, min(l_tax * 100) AS z0, max(l_tax * 100) AS z1, count(*) AS has FROM lineitem GROUP BY 1),
    s AS (SELECT s_suppkey AS id, 25 + s_acctbal / 200 AS x, 5 + s_acctbal / 1500 AS y, 4.0 AS z, s_nationkey % 3 AS space FROM supplier),
    m AS (SELECT b.*, x, y, z, space, s.id IS NULL AS loose FROM b LEFT JOIN s USING (id)),
    g AS (SELECT space, count(*) AS n, min(x0) AS gx FROM m WHERE space IS NOT NULL GROUP BY space),
    v AS (SELECT p_partkey AS id, p_size AS nx, p_partkey % 7 + 1 AS ny, CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 1 END AS bytes, CAST(round(p_retailprice) AS BIGINT) % 40 AS off FROM part),
    r AS (SELECT id, unnest(list_filter([CASE WHEN NOT (x BETWEEN x0 - {LOOSE} AND x1 + {LOOSE} AND y BETWEEN y0 - {LOOSE} AND y1 + {LOOSE} AND z BETWEEN z0 - {LOOSE} AND z1 + {LOOSE}) THEN 'centre outside box' END,
      CASE WHEN x0 < {FIELD[0][0]} OR x1 > {FIELD[0][1]} OR y0 < {FIELD[1][0]} OR y1 > {FIELD[1][1]} OR z0 < {FIELD[2][0]} OR z1 > {FIELD[2][1]} THEN 'outside field' END, CASE WHEN loose THEN 'no attribution' END,
      CASE WHEN x0 <> gx THEN 'not on the grid of its space' END], lambda c: c IS NOT NULL)) AS problem FROM m LEFT JOIN g USING (space)
      UNION ALL SELECT id, 'byte length' FROM v WHERE nx * ny * 3 * bytes <> nx * ny * 3 * bytes + CASE WHEN off < 2 THEN off + 1 ELSE 0 END)
    SELECT problem, count(*) AS n, min(id) AS first FROM r GROUP BY problem""",
)
def placement_gate(spark, sf_dir):
    """Placed things: listed centre in the own box, box in the field of view, the origin that their space's grid has, attribution, byte lengths."""
    axes = {"x": F.col("l_quantity"), "y": F.col("l_discount") * 100, "z": F.col("l_tax") * 100}
    boxes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(*[f(c).alias(f"{a}{i}") for a, c in axes.items() for i, f in enumerate((F.min, F.max))])
    listed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (25 + F.col("s_acctbal") / 200).alias("x"), (5 + F.col("s_acctbal") / 1500).alias("y"), F.lit(4.0).alias("z"), (F.col("s_nationkey") % 3).alias("space"), F.lit(True).alias("known"))
    both = boxes.join(listed, "id", "left")
    grid = both.filter("space is not null").groupBy("space").agg(F.min("x0").alias("gx"))  # a handful of spaces
    rows = both.join(grid, "space", "left")
    inside = lambda a: F.col(a).between(F.col(f"{a}0") - LOOSE, F.col(f"{a}1") + LOOSE)
    beyond = lambda a, lo, hi: (F.col(f"{a}0") < lo) | (F.col(f"{a}1") > hi)
    out = beyond("x", *FIELD[0]) | beyond("y", *FIELD[1]) | beyond("z", *FIELD[2])
    rules = {"centre outside box": ~(inside("x") & inside("y") & inside("z")), "outside field": out, "no attribution": F.col("known").isNull(), "not on the grid of its space": F.col("x0") != F.col("gx")}
    placed = rows.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("problem"))
    part = table(spark, sf_dir, "part")
    expected = F.col("p_size") * (F.col("p_partkey") % 7 + 1) * 3 * F.when(F.col("p_type") == "ECONOMY", 2).otherwise(1)
    off = F.round("p_retailprice").cast("long") % 40
    stored = expected + F.when(off < 2, off + 1).otherwise(0)
    lengths = part.filter(expected != stored).select(F.col("p_partkey").alias("id"), F.lit("byte length").alias("problem"))
    return placed.unionByName(lengths).groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first"))


#: Folders that may not be listed, endings of binary and image files, the folder for images, and most bytes of a file.
FORBIDDEN, BINARY, IMAGES, DOCS, MOST = ("fr/", "de/"), (".zip", ".pdf", "7"), (".png", "3"), "en/", 9000


@query(
    "GAT05",
    f"""WITH f AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?]*)', 1) AS path, length(html) AS bytes, html FROM pages),
    r AS (SELECT page_id, unnest(list_filter([CASE WHEN {" OR ".join(f"starts_with(path, '{p}')" for p in FORBIDDEN)} THEN 'forbidden folder' END, CASE WHEN {" OR ".join(f"suffix(lower(path), '{e}')" for e in BINARY)} THEN 'binary' END,
      CASE WHEN bytes > {MOST} THEN 'too large' END, CASE WHEN ({" OR ".join(f"suffix(lower(path), '{e}')" for e in IMAGES)}) AND NOT starts_with(path, '{DOCS}') THEN 'image outside docs' END,
      CASE WHEN regexp_matches(html, '"?(track|source|license)"?\\s*[:(]\\s*"?(0|core)') THEN 'restricted id' END, CASE WHEN regexp_matches(html, '<meta charset="[^"]*">.*<article>') THEN 'built file' END], lambda c: c IS NOT NULL)) AS problem FROM f)
    SELECT problem, count(*) AS n, min(page_id) AS first FROM r GROUP BY problem""",
)
def tree_rules(spark, sf_dir):
    """A list of files: forbidden folders, binaries, size, images outside their folder, restricted ids as field values, built files."""
    f = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1).alias("path"), F.length("html").alias("bytes"), "html")
    path = F.col("path")
    starts = lambda names: F.greatest(*[F.startswith(path, F.lit(p)) for p in names], F.lit(False))
    ends = lambda names: F.greatest(*[F.endswith(F.lower(path), F.lit(e)) for e in names], F.lit(False))
    rules = {
        "forbidden folder": starts(FORBIDDEN), "binary": ends(BINARY), "too large": F.col("bytes") > MOST, "image outside docs": ends(IMAGES) & ~starts((DOCS,)),
        "restricted id": F.col("html").rlike(r'"?(track|source|license)"?\s*[:(]\s*"?(0|core)'), "built file": F.col("html").rlike(r'<meta charset="[^"]*">.*<article>'),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return f.select("page_id", F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query(
    "SRC19 STR27",
    """WITH b AS (SELECT conv_id, string_agg('⟦conv p.' || turn || ' | pdf ' || (turn + 3) || '⟧' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, 'conv' AS book, CAST(c.turn AS INTEGER) AS printed, CAST(c.turn + 3 AS INTEGER) AS pdf, md5(coalesce(c.text, '')) AS body FROM conversations c JOIN b USING (conv_id)""",
)
def corpus_pages(spark, sf_dir):
    """Texts of many pages with marks between them, split into a row a page: the turns of a conversation as one text and back."""
    c = table(spark, sf_dir, "conversations")
    page = F.concat(F.format_string("⟦conv p.%d | pdf %d⟧\n", "turn", F.col("turn") + 3), F.coalesce("text", F.lit("")))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("page")))).alias("pages"))
    text = F.array_join(F.transform("pages", lambda p: p["page"]), "\n")
    return files.pages(whole.select("conv_id", text.alias("text")), "text").select("conv_id", "book", "printed", "pdf", F.md5("body").alias("body"))


_CELLS = "SELECT DISTINCT p_size AS i, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS j, CAST(p_partkey % 6 AS INTEGER) AS k FROM part WHERE p_partkey % 13 < 4"


@query(
    "GEO03",
    f"""WITH RECURSIVE c AS (SELECT *, (i * 100 + j) * 10 + k AS id FROM ({_CELLS})), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.k = b.k AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND a.id <> b.id),
    r(n, m) AS (SELECT id, id FROM c UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m), s AS (SELECT component, component % 10 AS k, count(*) AS size FROM (SELECT n, min(m) AS component FROM r GROUP BY n) GROUP BY component),
    t AS (SELECT *, max(size) OVER (PARTITION BY k) AS most, max(CASE WHEN size >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS any_large FROM s)
    SELECT CAST(k AS INTEGER) AS k, component, size FROM t WHERE CASE WHEN any_large = 1 THEN size >= greatest(5, 0.4 * most) ELSE size = most END""",
)
def kept_components(spark, sf_dir):
    """Components of each layer of cells without the small ones; of a layer that has only small ones the largest stay."""
    cells = table(spark, sf_dir, "part").filter("p_partkey % 13 < 4").select(F.col("p_size").alias("i"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("j"), (F.col("p_partkey") % 6).cast("int").alias("k")).distinct()
    cells = cells.withColumn("id", (F.col("i") * 100 + F.col("j")) * 10 + F.col("k"))
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)]
    around = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in steps]))
    edges = cells.select(F.col("id").alias("a"), "k", around.alias("n")).select("a", "k", "n.*").join(cells.withColumnRenamed("id", "b"), ["i", "j", "k"]).select("a", "b")
    size = graphs.connected(cells.select("id"), edges, "id").groupBy("component").agg(F.count("*").alias("size")).withColumn("k", (F.col("component") % 10).cast("int"))
    return graphs.without_small(size, "size", 5, 0.4, "k").select("k", "component", "size")


@query(
    "STR20",
    """WITH t AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '{name} of ' || n_name || ' owes {balance}' WHEN 1 THEN n_name || ': {place}/{name}/{none}' ELSE n_name END AS template FROM nation),
    v AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN '{place}' ELSE s_name END AS name, CASE WHEN s_suppkey % 7 > 0 THEN 'r' || s_nationkey % 4 END AS place, CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) AS balance FROM supplier),
    k AS (SELECT s_suppkey, template, name, place, balance, regexp_extract_all(template, '\\{([A-Za-z_]+)\\}', 1) AS names, string_split_regex(template, '\\{[A-Za-z_]+\\}') AS parts FROM v JOIN t ON s_nationkey = n_nationkey)
    SELECT s_suppkey, array_to_string(list_transform(parts, lambda p, i: p || coalesce(CASE names[i] WHEN 'name' THEN name WHEN 'place' THEN coalesce(place, '{place}') WHEN 'balance' THEN balance ELSE '{' || names[i] || '}' END, '')), '') AS text FROM k""",
)
def rendered(spark, sf_dir):
    """Templates from a table filled by name in one pass; a value that looks like a name stays, and so does a name without a value."""
    n = table(spark, sf_dir, "nation")
    one, two = F.concat(F.lit("{name} of "), "n_name", F.lit(" owes {balance}")), F.concat("n_name", F.lit(": {place}/{name}/{none}"))
    templates = n.select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_nationkey") % 3 == 0, one).when(F.col("n_nationkey") % 3 == 1, two).otherwise(F.col("n_name")).alias("template"))
    name = F.when(F.col("s_suppkey") % 5 == 0, "{place}").otherwise(F.col("s_name"))
    place = F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit("r"), F.col("s_nationkey") % 4))
    values = F.create_map(F.lit("name"), name, F.lit("place"), place, F.lit("balance"), F.round("s_acctbal").cast("long").cast("string"))
    return table(spark, sf_dir, "supplier").join(templates, "s_nationkey").select("s_suppkey", T.filled(F.col("template"), values).alias("text"))
