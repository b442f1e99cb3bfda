"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, importance, mixing, mtree, negatives, ngram_join, order_minhash, pii, quality, secret_scan, shards, suffix_dedup, toxicity
from .common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.annotate(docs, pii.fit(docs)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shards.shard(read(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digests(secret_scan.annotate(docs))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return order_minhash.edits(read(spark, sf_dir, "documents"), parts)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_position(mixing.mix(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance.resample(docs, read(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(negatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return negatives.mine(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_pii, op3_sharding, op4_secrets, op5_fingerprints, op6_mixing, op7_quality, op8_ngram_join, op9_toxicity, op10_topk, op11_importance, op12_suffixes, op13_negatives)
}
#: For each pair of documents that share a shingle the size of the intersection; components by all that links reach.
NGRAM_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END s FROM w),
e AS (SELECT doc_id, len(s) n, unnest(s) x FROM s),
l AS (SELECT a, b FROM (SELECT p.doc_id a, q.doc_id b, any_value(p.n) n, any_value(q.n) m, count(*) c FROM e p JOIN e q ON p.x = q.x AND p.doc_id != q.doc_id GROUP BY 1, 2) WHERE 100 * c >= 80 * (n + m - c)),
r AS (SELECT doc_id, doc_id reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT s.doc_id, len(s.s)::BIGINT n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(reached) component_id FROM r GROUP BY 1) c USING (doc_id)"""
TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT q.vec_id query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id)::INT rank FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id != x.vec_id) WHERE rank <= 5"""
#: Windows of 50 bytes as 100 hexadecimal digits.
SUFFIX_SQL = """WITH d AS (SELECT row_number() OVER () r, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) w FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) i FROM d)),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY w) least FROM w) WHERE doc_id > least),
e AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) p FROM m),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) g FROM e),
s AS (SELECT r, g, min(i) a, max(i) + 50 b FROM g GROUP BY ALL),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) p FROM s),
t AS (SELECT r, sum(b - a)::BIGINT n, count(*) c, max(b) last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT n_bytes, coalesce(n, 0)::BIGINT n_removed, coalesce(c, 0)::BIGINT n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256 FROM d LEFT JOIN t USING (r)"""
NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id a, x.vec_id x, a.l = x.l same, list_inner_product(a.v, x.v)::BIGINT s FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.vec_id != x.vec_id),
p AS (SELECT a, x p, s ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, x) <= 5)
SELECT p.a anchor_id, p positive_id, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, x)::INT rank, x negative_id, ps positive_score, s negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps QUALIFY row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, x) <= 5"""
ORACLE_SQL: dict[str, str] = {"op8_ngram_join": NGRAM_SQL, "op10_topk": TOPK_SQL, "op12_suffixes": SUFFIX_SQL, "op13_negatives": NEGATIVES_SQL}
