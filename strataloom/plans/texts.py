"""Normalising, tokenising, scoring, hashing and parsing of text, JSON and URLs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.plans.registry import query
from strataloom.session import durable
from strataloom.sources.tables import table


@query(
    "STR01 STR07 STR03",
    """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '\\([^)]*\\)', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS title,
    rtrim(left(array_to_string(list_slice(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-'), lambda x: x <> ''), 1, 8), '-'), 64), '-') AS slug FROM part""",
)
def normalise_title(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_title(name).alias("title"), T.slug(F.concat("p_name", F.lit(" "), "p_type", F.lit("!"))).alias("slug"))


@query(
    "STR02 STR10",
    """SELECT doc_id, left(regexp_replace(replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'), 60) AS key, regexp_matches(text, '[éèêç]') AS marked FROM documents""",
)
def match_keys(spark, sf_dir):
    """Matching keys of texts, accents folded by a fixed table on both sides."""
    key = F.left(F.regexp_replace(T.fold(F.col("text")), "[^a-z0-9]+", " "), F.lit(60))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.col("text").rlike("[éèêç]").alias("marked"))


@query("STR04 AGG01 FLT22", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS words, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) < CASE lang WHEN 'en' THEN 60 WHEN 'fr' THEN 80 ELSE 40 END AS short FROM documents WHERE length(text) > 30")
def word_count(spark, sf_dir):
    words = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))).cast("long")
    least = F.when(F.col("lang") == "en", 60).when(F.col("lang") == "fr", 80).otherwise(40)
    return table(spark, sf_dir, "documents").filter(F.length("text") > 30).select("doc_id", words.alias("words"), (words < least).alias("short"))


@query(
    "STR05 STR29 STR30",
    """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE lang = 'en'),
    t AS (SELECT doc_id, CASE WHEN regexp_matches(w, '[a-z]{2}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, 'ses$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[a-z]{2}[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS token FROM w)
    SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE length(token) > 2 AND token NOT IN ('the', 'and', 'that', 'with') GROUP BY token HAVING count(*) >= 2""",
)
def lexicon(spark, sf_dir):
    """Tokens in singular form that are seen twice or more, without stop words."""
    words = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.explode(T.plain_words(F.col("text"))).alias("w"))
    tokens = words.select("doc_id", T.singular(F.col("w")).alias("token")).filter((F.length("token") > 2) & ~F.col("token").isin("the", "and", "that", "with"))
    per_doc = tokens.groupBy("token", "doc_id").agg(F.count("*").alias("n"))  # counted in two steps: no set of ids per token
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter("n >= 2")


_TOKENS = """t AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS w FROM documents),
idf AS (SELECT w, ln((SELECT count(*) FROM documents) * 1.0 / count(*)) + 1 AS idf FROM t GROUP BY w)"""


def _tokens(spark, sf_dir, name, key):
    return table(spark, sf_dir, name).select(F.col(key), F.explode(F.array_distinct(T.plain_words(F.col("text")))).alias("w"))


def _idf(spark, sf_dir, tokens):
    total = F.broadcast(table(spark, sf_dir, "documents").agg(F.count("*").alias("total")))
    df = tokens.groupBy("w").agg(F.count("*").alias("df"))
    return df.crossJoin(total).select("w", (F.log(F.col("total") / F.col("df")) + 1).alias("idf"))  # one row of totals


@query("AGG27", f"WITH {_TOKENS} SELECT w, round(idf, 6) AS idf FROM idf")
def idf(spark, sf_dir):
    return _idf(spark, sf_dir, _tokens(spark, sf_dir, "documents", "doc_id")).select("w", F.round("idf", 6).alias("idf"))


@query(
    "JON17 SRT03",
    f"""WITH {_TOKENS}, b AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS w FROM benchmark),
    bw AS (SELECT item_id, w, coalesce(idf, 1) AS idf FROM b LEFT JOIN idf USING (w)), bs AS (SELECT item_id, sum(idf) AS s FROM bw GROUP BY 1), ds AS (SELECT doc_id, sum(idf) AS s FROM t JOIN idf USING (w) GROUP BY 1),
    c AS (SELECT item_id, doc_id, sum(bw.idf) AS common FROM bw JOIN t USING (w) WHERE bw.idf > 4 GROUP BY 1, 2), f AS (SELECT item_id, doc_id, round(92 * 2 * common / (bs.s + ds.s), 6) AS score FROM c JOIN bs USING (item_id) JOIN ds USING (doc_id))
    SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM f) WHERE r <= 8""",
)
def tfidf_f1_rank(spark, sf_dir):
    """The eight documents most like each item: weighted F1 over informative shared tokens, by an inverted index.

    Texts are cut into words once; frequencies, weights and the index read the written words.
    """
    docs, items = durable(_tokens(spark, sf_dir, "documents", "doc_id"), "words"), _tokens(spark, sf_dir, "benchmark", "item_id")
    weight = durable(_idf(spark, sf_dir, docs), "weights")
    item = items.join(weight, "w", "left").select("item_id", "w", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    item_sum = item.groupBy("item_id").agg(F.sum("idf").alias("is"))
    doc_sum = docs.join(weight, "w").groupBy("doc_id").agg(F.sum("idf").alias("ds"))
    common = item.filter("idf > 4").join(docs, "w").groupBy("item_id", "doc_id").agg(F.sum("idf").alias("common"))
    score = F.round(92 * 2 * F.col("common") / (F.col("is") + F.col("ds")), 6).alias("score")
    scored = common.join(item_sum, "item_id").join(doc_sum, "doc_id").select("item_id", "doc_id", score)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("r", rank).filter("r <= 8").drop("r")


@query("SRT01 FLT11", "SELECT p_partkey, p_name FROM (SELECT * FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_retailprice DESC, p_partkey LIMIT 40) WHERE p_type = 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
def limit_then_filter(spark, sf_dir):
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    top = table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("a"))).orderBy(*order).limit(40)
    return top.filter("p_type = 'PROMO'").orderBy(*order).limit(12).select("p_partkey", "p_name")


@query("FLT08 FLT09 FLT10", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 're') OR contains(lower(p_type), 're')) AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') AND p_size > 10")
def haystack(spark, sf_dir):
    has = lambda c, s: F.contains(F.lower(c), F.lit(s))
    return table(spark, sf_dir, "part").filter((has("p_name", "re") | has("p_type", "re")) & has(F.concat_ws(" ", "p_name", "p_brand", "p_type"), "brand") & (F.col("p_size") > 10)).select("p_partkey")


@query("SRT08", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), c AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)) SELECT doc_id, n, left(coalesce(before, ''), 40) AS before, left(coalesce(after, ''), 40) AS after FROM c WHERE regexp_matches(line, '(?i)licen[sc]ed')")
def grep_context(spark, sf_dir):
    """Lines that match a pattern with the lines around them; only those leave their document's array."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    near = lambda i: F.left(F.coalesce(F.get("lines", i), F.lit("")), F.lit(40))
    places = F.transform("lines", lambda x, i: F.when(x.rlike("(?i)licen[sc]ed"), i))
    met = F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: F.struct((i + 1).cast("long").alias("n"), near(i - 1).alias("before"), near(i + 1).alias("after")))
    return docs.select("doc_id", F.inline(met))


@query(
    "SRC26 STR23",
    "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS heading, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages",
)
def html_headings(spark, sf_dir):
    heading = T.squeeze(F.regexp_replace(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    paragraphs = F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", heading.alias("heading"), paragraphs.alias("paragraphs"), F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("STR21", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, len(string_split(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '/')) - 1 AS depth, try_cast(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) AS first_number FROM pages")
def url_params(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/?#]+", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        (F.size(F.split(path, "/")) - 1).cast("long").alias("depth"), F.regexp_extract("url", "([0-9]+)", 1).try_cast("long").alias("first_number"),
    )


@query("STR22 GAT09", "WITH h AS (SELECT conv_id, left(sha1(string_agg(turn || '=' || text, chr(10) ORDER BY turn, role, text)), 16) AS hash FROM conversations GROUP BY 1) SELECT conv_id, hash, hash < '8' AS stale FROM h")
def source_hash(spark, sf_dir):
    """The first 16 hex digits over the ordered parts of each conversation."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))  # the turns of one conversation
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["turn"].cast("string"), F.lit("="), x["text"])), "\n")
    hashed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.left(F.sha1(joined), F.lit(16)).alias("hash"))
    return hashed.select("conv_id", "hash", (F.col("hash") < "8").alias("stale"))


@query("JSN01 JSN02 JSN04", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) % 7 AS bucket FROM events")
def json_paths(spark, sf_dir):
    parsed = F.from_json("props", "k bigint, none string")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["none"].alias("none"), (F.coalesce(parsed["k"], F.lit(-1)) % 7).alias("bucket"))


@query("STR26", "SELECT p_partkey, CAST(('0x' || left(md5(p_name), 8)) AS BIGINT) % 12 AS hue, CAST(('0x' || left(md5(p_name), 8)) AS BIGINT) // 12 % 5 AS light FROM part")
def hash_jitter(spark, sf_dir):
    n = F.conv(F.left(F.md5("p_name"), F.lit(8)), 16, 10).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", (n % 12).alias("hue"), (F.floor(n / 12) % 5).alias("light"))


@query("STR17 STR18 STR19", "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand || ', ' || p_type || ', et al.' ELSE p_brand || ', ' || p_type END AS cited, CASE WHEN length(p_name) > 12 THEN left(p_name, 11) || '…' ELSE p_name END AS short, regexp_replace(p_name, '(^| )([a-z])', '\\1<\\2>', 'g') AS marked FROM part")
def citation_format(spark, sf_dir):
    cited = F.when(F.col("p_size") > 40, F.concat_ws(", ", "p_brand", "p_type", F.lit("et al."))).otherwise(F.concat_ws(", ", "p_brand", "p_type"))
    short = F.when(F.length("p_name") > 12, F.concat(F.left("p_name", F.lit(11)), F.lit("…"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", cited.alias("cited"), short.alias("short"), F.regexp_replace("p_name", "(^| )([a-z])", "$1<$2>").alias("marked"))


@query("STR14 FLT20 STR15", "SELECT doc_id, length(regexp_replace(regexp_replace(lower(text), 'tion\\b', 'cion', 'g'), '\\bthe ', '', 'g')) AS rewritten, regexp_matches(text, '(?i)\\b(fig|table)\\b') AS cites, len(list_filter(string_split(text, ';'), lambda x: trim(x) <> '')) AS cells FROM documents")
def spelling_rules(spark, sf_dir):
    changed = F.regexp_replace(F.regexp_replace(F.lower("text"), "tion\\b", "cion"), "\\bthe ", "")
    cells = F.size(F.filter(F.split("text", ";"), lambda x: F.trim(x) != "")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(changed).cast("long").alias("rewritten"), F.col("text").rlike("(?i)\\b(fig|table)\\b").alias("cites"), cells.alias("cells"))


@query("JON40 SNK13", "SELECT k.page_id, count(*) AS docs FROM (SELECT min(page_id) AS page_id, regexp_extract(url, '/([a-z]+)/', 1) AS w FROM pages GROUP BY 2) k JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) d ON d.w = k.w GROUP BY 1")
def token_in_text(spark, sf_dir):
    """Whole tokens of one table in the texts of another, by an equi join on tokens instead of a scan per pair."""
    keys = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "/([a-z]+)/", 1).alias("w")).agg(F.min("page_id").alias("page_id"))
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    return tokens.join(keys, "w").groupBy("page_id").agg(F.count("*").alias("docs"))
