"""The registered queries of this subpackage: name -> callable (spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontamination, importance, jaccard, language, packing, periodic, quality, secrets, sharding, substrings, templates, toxicity, vectors
from strataloom.llm.exprs import let, words
from strataloom.sources.tables import table


def fold(of: int) -> Column:
    """The remainder that sets rows apart for testing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % of


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs.filter(fold(3) != 1), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine, 0.7)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), 4, 85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), every_id=True, short_items=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(fold(4) != 2))
    return language.identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = templates.strip(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return done.select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def with_period(doc_id: Column, text: Column) -> Column:
    """The text, or for one doc_id in ten its words with a tail that repeats with a period from the doc_id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        a = g % F.size(w)
        return let(F.struct(a.cast("int").alias("a"), (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int").alias("p")), lambda at: told(w, at["a"], at["p"]))

    def told(w: Column, a: Column, p: Column) -> Column:
        return F.array_join(F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, a + (i - a) % p))), " ")

    return F.when(h % 10 == 0, let(words(text), lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_period(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = periodic.collapse(docs).withColumn("longest", longest)
    length, period = -F.col("longest.less"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(table(spark, sf_dir, "embeddings"), 0.98)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_REPEATS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, i AS start, array_to_string(w[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(w) - 18)) r(i)),
again AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(start, start + 20)) r(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS c FROM (SELECT doc_id, p, w[p] AS word FROM w, unnest(range(1, len(w) + 1)) r(p)) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_SIMILAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 1) + 1 END)) r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(x, m) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.m)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(m) AS component FROM r GROUP BY x) c ON c.x = d.doc_id
"""


_IMPORTANCE = """
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
txt AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS word FROM txt),
c AS (SELECT side, doc_id, word, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM c)),
k AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::BIGINT), lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM h, crc),
f AS (SELECT side, doc_id, bucket, sum(n) AS n FROM c JOIN k USING (word) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM f GROUP BY bucket),
a AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM g),
gain AS (SELECT bucket, floor(1000 * ln((g.t + 1.0::DOUBLE) * (a.s + 10000) / ((g.s + 1.0::DOUBLE) * (a.t + 10000))))::BIGINT AS v FROM g, a),
d AS (SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * v), 0)::BIGINT AS weight FROM documents LEFT JOIN (SELECT * FROM f JOIN gain USING (bucket) WHERE side = 'd') USING (doc_id) GROUP BY doc_id),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""


_NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r(x, m) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT x, min(m) AS m FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept FROM v LEFT JOIN n ON a = vec_id LEFT JOIN c ON x = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators it can express in reasonable time.

    The others need a tokenizer, a trained model, fingerprints or a
    parse that depends on the order of templates; tests hold them against
    brute-force versions or held-out labels.
    """
    return {"op2_substring_dedup": _REPEATS, "op4_ngram_jaccard": _SIMILAR, "op11_importance": _IMPORTANCE, "op13_near_vectors": _NEAR_VECTORS}
