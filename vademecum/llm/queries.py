"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vademecum.llm.shared import text_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import sentencepiece_bpe as sp

    model = tokenizer_path("piece_bpe_32k.model")
    both = sp.encode_and_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import simple8b

    rows = simple8b.id_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, with_ids=False)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    field = toxicity.fit(docs, labels, "crc32(cast(doc_id AS string)) % 3 <> 1")
    held = F.coalesce(remainder == 1, F.lit(False))
    return toxicity.score(docs, field, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import bin_packing

    packed = bin_packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import quality

    rows = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"]
    return rows.select(*columns)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import warc

    rows = warc.round_trip(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SHARD_DIMENSIONS = ["source", "lang", "n_chars"]


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import hilbert

    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", *SHARD_DIMENSIONS, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = hilbert.shards(rows, SHARD_DIMENSIONS, 8, ties=("text_crc32",))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import licences

    rows = licences.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"), "unknown_notices")


def op9_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import impact_topk

    rows = impact_topk.quantised(_table(spark, sf_dir, "embeddings"))
    return impact_topk.top_k(rows, rows.where("id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS x
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op10_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import near_duplicates

    return near_duplicates.groups(_table(spark, sf_dir, "documents"))

def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import whitening

    rows = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import filter_audit

    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return filter_audit.audit(filter_audit.patterns(docs, labels))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.llm import mixing

    rows = mixing.sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixing.mixed(rows, mixing.plan(rows)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * coalesce(CAST(w.doc_id > first AS INT), 0) AS p
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, p, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(k, b)),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, list_sum(list_slice(bits, 1, step)) - bits[step] AS prev FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN p & CAST(prev + own AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN p & CAST(prev AS BIGINT) = 0 AND p & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN p & CAST(prev AS BIGINT) > 0 AND p & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN p = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN p & CAST(prev AS BIGINT) = 0 AND p & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN p & CAST(prev AS BIGINT) = 0 AND p & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

OP13_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, 3 * n / w AS full_at, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS i,
    (SELECT sum(n) FROM s) AS total FROM s),
c AS (
  SELECT *, coalesce(sum(3 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM o),
v AS (SELECT arg_min(CAST(CAST(total - stopped AS BIGINT) AS DOUBLE) / CAST(CAST(open AS BIGINT) AS DOUBLE), i) AS level FROM c WHERE CAST(total - stopped AS DOUBLE) / CAST(open AS DOUBLE) <= full_at),
t AS (SELECT source, n, CASE WHEN w * level > 3 * n THEN CAST(3 * n AS DOUBLE) ELSE w * level END AS target FROM s, v),
b AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS times FROM t),
g AS (SELECT source, key, sum(size) AS words FROM d GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
k AS (
  SELECT r.source, r.key, CAST(b.target - b.times * b.n > 0 AND (r.before + r.words <= b.target - b.times * b.n
    OR (r.before <= b.target - b.times * b.n AND r.before + r.words - (b.target - b.times * b.n) < (b.target - b.times * b.n) - r.before)) AS BIGINT) AS more
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.n AS source_size, b.target, CAST(d.size * (b.times + k.more) AS BIGINT) AS taken, d.source, CAST(b.times + k.more AS BIGINT) AS copies
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
"""


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_warc_zstd": op2_warc_zstd,
        "op3_hilbert_shards": op3_hilbert_shards,
        "op4_simple8b": op4_simple8b,
        "op5_toxicity_crf": op5_toxicity_crf,
        "op6_minimum_bin_slack": op6_minimum_bin_slack,
        "op7_quality_rules": op7_quality_rules,
        "op8_license_rules": op8_license_rules,
        "op9_impact_topk": op9_impact_topk,
        "op10_odd_sketches": op10_odd_sketches,
        "op11_block_whitening": op11_block_whitening,
        "op12_filter_audit": op12_filter_audit,
        "op13_source_mix": op13_source_mix,
    }


def oracle_sql() -> dict[str, str]:
    from vademecum.llm import licences

    return {"op2_warc_zstd": OP2_SQL, "op8_license_rules": licences.oracle(), "op9_impact_topk": OP9_SQL, "op10_odd_sketches": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_source_mix": OP13_SQL}
