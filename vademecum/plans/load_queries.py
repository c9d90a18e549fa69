"""Queries of the vector table's load: documents as chunks against an older state of the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vademecum import vocabulary as V
from vademecum.functions import vectors
from vademecum.operators import evaluation, loading
from vademecum.plans.registry import query, table
from vademecum.plans.text_queries import _CHUNK, _KEY, keyed_corpus, point_sql
from vademecum.sources import tables
from vademecum.sources.vector_table import VectorTable

_BASE = f"base AS (SELECT doc_id, {point_sql('k')} AS point_id, sha256(k || '::' || text) AS content_hash, k AS logical_key, text, drug_name FROM (SELECT *, {_KEY} AS k FROM ({_CHUNK})))"
_OLD = "old AS (SELECT doc_id, point_id, CASE WHEN doc_id % 11 = 0 THEN md5(content_hash) WHEN doc_id % 17 = 0 THEN NULL ELSE content_hash END AS content_hash, logical_key, drug_name FROM base WHERE doc_id % 7 <> 0)"
_NEW = "new AS (SELECT * FROM base WHERE doc_id % 13 <> 0)"
_ACT = """act AS (SELECT coalesce(n.point_id, o.point_id) AS point_id, CASE WHEN n.point_id IS NULL THEN 'prune' WHEN n.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'skip' ELSE 'upsert' END AS action
  FROM new n FULL JOIN (SELECT * FROM old WHERE content_hash IS NOT NULL) o ON n.point_id = o.point_id)"""
_ALL = f"WITH {_BASE}, {_OLD}, {_NEW}, {_ACT} "


def existing(spark, sf_dir):
    edited = F.when(F.col("doc_id") % 11 == 0, F.md5(F.col("content_hash").cast("binary"))).when(F.col("doc_id") % 17 == 0, None).otherwise(F.col("content_hash"))
    return keyed_corpus(spark, sf_dir).where("doc_id % 7 <> 0").withColumn("content_hash", edited)


def desired(spark, sf_dir):
    return keyed_corpus(spark, sf_dir).where("doc_id % 13 <> 0")


def embed(rows):
    return rows.withColumn("vector", vectors.hash_vector(F.col("text"), 8).cast("array<float>"))


@query(_ALL + "SELECT point_id, content_hash FROM old WHERE content_hash IS NOT NULL")
def s9_existing_hashes(spark, sf_dir):
    return loading.existing_hashes(existing(spark, sf_dir))


@query(_ALL + "SELECT point_id, action FROM act")
def j6_load_diff(spark, sf_dir):
    return loading.actions(desired(spark, sf_dir), existing(spark, sf_dir))


@query(_ALL + "SELECT count(*) FILTER (action = 'upsert') AS upserted, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'prune') AS pruned FROM act")
def a7_load_report(spark, sf_dir):
    return loading.load_report(loading.actions(desired(spark, sf_dir), existing(spark, sf_dir)))


@query(_ALL + "SELECT point_id, count(*) AS n FROM (SELECT point_id FROM base UNION ALL SELECT point_id FROM base WHERE doc_id % 19 = 0) GROUP BY 1 HAVING count(*) > 1")
def a8_duplicate_guard(spark, sf_dir):
    rows = keyed_corpus(spark, sf_dir)
    return loading.duplicate_points(rows.unionByName(rows.where("doc_id % 19 = 0")))


@query(
    f"WITH {_BASE} SELECT substr(sha256(concat_ws('|', count(*), "
    + ", ".join(f"coalesce(sum(('0x' || substr(content_hash, {1 + 15 * i}, 15))::BIGINT::HUGEINT), 0)" for i in range(4))
    + ")), 1, 16) AS fingerprint FROM base"
)
def a9_corpus_fingerprint(spark, sf_dir):
    return loading.fingerprint(keyed_corpus(spark, sf_dir))


_MERGED = """SELECT point_id, content_hash FROM old WHERE point_id NOT IN (SELECT point_id FROM act WHERE action IN ('upsert', 'prune'))
  UNION ALL SELECT n.point_id, n.content_hash FROM new n JOIN act USING (point_id) WHERE action = 'upsert'"""


@query(_ALL + _MERGED)
def o5_merged_table(spark, sf_dir):
    new, old = desired(spark, sf_dir), existing(spark, sf_dir)
    todo = loading.actions(new, old)
    changed = new.join(todo.where("action = 'upsert'").select("point_id"), "point_id", "left_semi")
    return loading.merged(old.select("point_id", "content_hash"), changed, todo)


def _points(spark, sf_dir):
    return keyed_corpus(spark, sf_dir).select("drug_name", "section_type", "species", F.col("book_page").cast("int"), "text", "ordinal", "doc_id")


@query(f"WITH {_BASE} SELECT point_id, content_hash, logical_key FROM base WHERE doc_id % 13 <> 0 UNION ALL SELECT point_id, content_hash, logical_key FROM base WHERE false")
def s8_vector_table(spark, sf_dir):
    """Two loads into a new table: all documents, then most of them, so that the rest is pruned."""
    store = VectorTable(spark, tables.scratch(spark, "vectors"))
    rows = _points(spark, sf_dir)
    store.load(rows.drop("doc_id"), embed)
    store.load(rows.where("doc_id % 13 <> 0").drop("doc_id"), embed)
    return store.read().select("point_id", "content_hash", "logical_key")


@query(f"WITH {_BASE} SELECT 0 AS upserted, count(*) FILTER (doc_id % 13 <> 0) AS skipped, count(*) FILTER (doc_id % 13 = 0) AS pruned FROM base")
def g4_load(spark, sf_dir):
    """The report of a second load that drops some documents."""
    store = VectorTable(spark, tables.scratch(spark, "vectors"))
    rows = _points(spark, sf_dir)
    store.load(rows.drop("doc_id"), embed)
    return store.load(rows.where("doc_id % 13 <> 0").drop("doc_id"), embed).select(*[F.col(c).cast("bigint").alias(c) for c in ("upserted", "skipped", "pruned")])


@query(f"WITH {_BASE} SELECT count(*) AS n, count(DISTINCT content_hash) AS hashes FROM base")
def s6_embedding_cache(spark, sf_dir):
    """Embeds once and reads the saved vectors the second time."""
    folder = tables.scratch(spark, "cache")
    rows = keyed_corpus(spark, sf_dir)
    tables.cached_embeddings(rows, "hash", folder, embed)
    return tables.cached_embeddings(rows, "hash", folder, embed).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content_hash").alias("hashes"))


@query(f"WITH {_BASE} SELECT count(*) AS n, sum(CAST(length(text) AS BIGINT)) AS chars FROM base")
def s2_read_chunks(spark, sf_dir):
    """Writes chunks as JSON and reads them back with the declared schema and the section check."""
    path = tables.scratch(spark, "chunks")
    keyed_corpus(spark, sf_dir).withColumn("section_type", F.lit(V.SECTION_TYPES[1])).withColumn("book_id", F.lit("b")).write.json(path)
    rows = tables.read_chunks(spark, path)
    return rows.agg(F.count("section_type").alias("n"), F.sum(F.length("text")).alias("chars"))


def _cases(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("dose").alias("flow"), F.lit("d").alias("drug"), F.lit("doses").alias("section"),
        F.array().cast("array<string>").alias("species"), F.array(F.concat(F.lit("k"), F.col("item_id").cast("string"))).alias("relevant_logical_keys"),
    )


@query("SELECT item_id AS query_id, text AS query, 'k' || item_id AS relevant FROM benchmark")
def s4_read_eval_set(spark, sf_dir):
    path = tables.scratch(spark, "cases")
    _cases(spark, sf_dir).write.json(path)
    return tables.read_eval_set(spark, path).select("query_id", "query", F.array_join("relevant_logical_keys", ",").alias("relevant"))


@query("SELECT count(*) AS n FROM benchmark")
def s5_promote_eval_set(spark, sf_dir):
    draft, final = tables.scratch(spark, "draft"), tables.scratch(spark, "final")
    _cases(spark, sf_dir).write.json(draft)
    tables.promote_eval_set(spark, draft, final)
    return spark.read.json(final).agg(F.count("query_id").alias("n"))


_SAMPLE = "SELECT source AS drug, lang AS section, substr(arg_min(text, doc_id), 1, 600) AS sample_text FROM documents GROUP BY 1, 2"


@query(f"SELECT drug, section, md5(sample_text) AS sample_md5 FROM ({_SAMPLE})")
def w9_sample_text(spark, sf_dir):
    return evaluation.sample_text(keyed_corpus(spark, sf_dir), "doc_id").select("drug", "section", F.md5(F.col("sample_text").cast("binary")).alias("sample_md5"))


@query("SELECT doc_id, hex(md5(text)) AS h FROM documents WHERE false UNION ALL SELECT doc_id, array_to_string(list_transform(range(8), lambda i: ('0x' || substr(sha256(text), 2 * i + 1, 2))::INT), ',') FROM documents")
def u1_hash_embedder(spark, sf_dir):
    """The stand-in embedder before scaling: the first bytes of each text's SHA-256."""
    digest = F.sha2(F.col("text"), 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), byte), ",").alias("h"))


@query(f"WITH {_BASE} SELECT count(*) AS n FROM base")
def g2_embed(spark, sf_dir):
    """The embedding job over all chunks; the saved vectors are counted."""
    rows = tables.cached_embeddings(keyed_corpus(spark, sf_dir), "Hash/32", tables.scratch(spark, "cache"), embed)
    return rows.where("size(vector) = 8").agg(F.count(F.lit(1)).alias("n"))
