"""Plans of writes: what changed in a bundle, what is retired, what is reused, and where upserted rows go."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.plans.registry import query
from strataloom.sources import bundles
from strataloom.sources.tables import table


@query(
    "SNK02 SNK11 SNK03",
    """WITH old AS (SELECT lang, source, doc_id, text FROM documents WHERE n_chars < 4000), new AS (SELECT lang, source, d.doc_id, rtrim(text, '!') AS text FROM documents d LEFT JOIN labels USING (doc_id) WHERE n_chars < 3000 AND coalesce(toxic, 0) = 0),
    o AS (SELECT lang, source, count(*) AS old_rows, md5(string_agg(doc_id || ':' || md5(text), ',' ORDER BY doc_id, text)) AS h FROM old GROUP BY 1, 2), n AS (SELECT lang, source, count(*) AS new_rows, md5(string_agg(doc_id || ':' || md5(text), ',' ORDER BY doc_id, text)) AS h FROM new GROUP BY 1, 2)
    SELECT coalesce(o.lang, n.lang) AS lang, coalesce(o.source, n.source) AS source, old_rows, new_rows, CASE WHEN n.h IS NULL THEN 'retire' WHEN o.h = n.h THEN 'keep' ELSE 'write' END AS action FROM o FULL JOIN n ON o.lang IS NOT DISTINCT FROM n.lang AND o.source IS NOT DISTINCT FROM n.source""",
)
def bundle_changes(spark, sf_dir):
    """Which parts of an export by language and source are written anew, kept or retired: fingerprints of before and after."""
    d = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    before = bundles.fingerprints(d.filter("n_chars < 4000").select("lang", "source", "doc_id", "text"), "lang", "source")
    after = d.filter("n_chars < 3000").join(toxic, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    after = bundles.fingerprints(after.select("lang", "source", "doc_id", F.rtrim("text", F.lit("!")).alias("text")), "lang", "source")
    old = before.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("rows").alias("old_rows"), F.col("fingerprint").alias("was"))
    both = old.join(after, F.col("l").eqNullSafe(F.col("lang")) & F.col("s").eqNullSafe(F.col("source")), "full")
    action = F.when(F.col("fingerprint").isNull(), "retire").when(F.col("was") == F.col("fingerprint"), "keep").otherwise("write")
    return both.select(F.coalesce("lang", "l").alias("lang"), F.coalesce("source", "s").alias("source"), "old_rows", F.col("rows").alias("new_rows"), action.alias("action"))


@query(
    "SNK06 SNK13",
    """WITH m AS (SELECT DISTINCT lower(p_type) || '/' || p_brand || '/' || p_size AS path FROM part WHERE p_size <= 30), f AS (SELECT lower(p_type) || '/' || p_brand || '/' || p_size AS path, count(*) AS bytes FROM part WHERE p_partkey % 7 <> 2 GROUP BY 1)
    SELECT path, CASE WHEN m.path IS NULL THEN 'delete' WHEN f.path IS NULL THEN 'missing' ELSE 'keep' END AS action, bytes FROM m FULL JOIN f USING (path)""",
)
def retire_plan(spark, sf_dir):
    """Files against the manifest that names what stays: kept, to be deleted, or named and missing."""
    path = F.concat_ws("/", F.lower("p_type"), "p_brand", "p_size").alias("path")
    p = table(spark, sf_dir, "part")
    named = p.filter("p_size <= 30").select(path).distinct().withColumn("named", F.lit(True))
    files = p.filter("p_partkey % 7 <> 2").groupBy(path).agg(F.count("*").alias("bytes"))
    action = F.when(F.col("named").isNull(), "delete").when(F.col("bytes").isNull(), "missing").otherwise("keep")
    return named.join(files, "path", "full").select("path", action.alias("action"), "bytes")


@query(
    "SNK05",
    """WITH old AS (SELECT c_custkey AS id, c_custkey AS place, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 1), new AS (SELECT o_custkey AS id, o_orderkey AS batch, o_totalprice AS v FROM orders WHERE o_orderkey % 4 = 0),
    l AS (SELECT id, arg_max(v, batch) AS v, min(batch) AS first FROM new GROUP BY id), f AS (SELECT l.*, row_number() OVER (ORDER BY first, id) AS r FROM l ANTI JOIN old USING (id))
    SELECT id, place, coalesce(l.v, old.v) AS v FROM old LEFT JOIN l USING (id) UNION ALL SELECT id, (SELECT max(place) FROM old) + r, v FROM f""",
)
def upsert_in_order(spark, sf_dir):
    """Records with later ones written over them: the last of a key counts, the first one's place stays, new keys follow."""
    old = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"), F.col("c_acctbal").alias("v"))
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("batch"), F.col("o_totalprice").alias("v"))
    return bundles.upserted_in_order(old, new, "id", "place", "batch")


@query(
    "SNK07",
    """WITH w AS (SELECT doc_id, md5(text) AS digest FROM documents), r AS (SELECT DISTINCT d.doc_id, md5(CASE WHEN quality = 0 THEN text || ' ' ELSE text END) AS digest, d.doc_id AS path FROM documents d JOIN labels USING (doc_id)), a AS (SELECT DISTINCT doc_id AS path FROM documents WHERE source <> 'web')
    SELECT doc_id, EXISTS (SELECT 1 FROM r JOIN a USING (path) WHERE r.doc_id = w.doc_id AND r.digest = w.digest) AS reuse FROM w""",
)
def reuse_plan(spark, sf_dir):
    """Which records need no work: one with the same key and digest is stored, and its artefact is there."""
    d = table(spark, sf_dir, "documents")
    wanted = d.select("doc_id", F.md5("text").alias("digest"))
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    records = d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.md5(text).alias("digest"), F.col("doc_id").alias("path"))
    artefacts = d.filter("source <> 'web'").select(F.col("doc_id").alias("path"))
    return bundles.reusable(wanted, records, "doc_id", "digest", artefacts).select("doc_id", "reuse")
