"""Registered queries of stand-in encoders, the stored vectors, the third leg of retrieval, and steps of sessions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import encoders as N
from tessera.operators import retrieval as R
from tessera.operators import store as S
from tessera.plans import catalog  # whole by the time it imports this
from tessera.plans.registry import new_folder, query, stored, table
from tessera.plans.sql import TOK
from tessera.sources.keyed import KeyedTable
from tessera.streaming import events

#: A token's number in SQL: eight hexadecimal digits of its digest.
NUMBER = "(" + " + ".join(f"(instr('0123456789abcdef', substr(sha256({{t}}), {i + 1}, 1)) - 1)::BIGINT * {16 ** (7 - i)}" for i in range(8)) + ")"


def vectors_sql(source: str, key: str, out: str) -> str:
    """Named steps: the buckets of every text of source with their counts, and its squared length."""
    return f"""{out}t AS (SELECT {key}, {NUMBER.format(t="t")} % 64 b, count(*) n FROM (SELECT {key}, unnest({TOK}) t FROM {source}) GROUP BY 1, 2), {out}n AS (SELECT {key}, sum(n * n)::DOUBLE s FROM {out}t GROUP BY 1)"""


@query(f"""WITH {vectors_sql("documents", "doc_id", "v")}, m AS (SELECT doc_id, map_from_entries(list((b, n))) m, any_value(s) s FROM vt JOIN vn USING (doc_id) GROUP BY 1)
SELECT doc_id, list_transform(range(64), lambda b: round(coalesce(m[b]::DOUBLE / sqrt(s), 0), 6)) vector FROM documents LEFT JOIN m USING (doc_id)""")
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a vector of hashed tokens."""
    return table(spark, d, "documents").select("doc_id", F.transform(N.hashed(F.col("text")), lambda x: F.round(x, 6)).alias("vector"))


@query(f"""SELECT doc_id, {NUMBER.format(t="t")}::BIGINT "index", round(max(ln(1 + n)), 6) "value" FROM (SELECT doc_id, t, count(*) n FROM (SELECT doc_id, unnest({TOK}) t FROM documents) GROUP BY 1, 2) GROUP BY 1, 2""")
def sparse_encode(spark: SparkSession, d: str) -> DataFrame:
    """Every document's weights by index."""
    return N.sparse_encode(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "index", F.round("value", 6).alias("value"))


def dense_leg(spark: SparkSession, d: str, k: int) -> DataFrame:
    """item_id, doc_id, rnk over hashed vectors; questions get negative ids, so that none is taken for the document of its number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), N.hashed(F.col("text")).alias("embedding"))
    asked = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("qid"), N.hashed(F.col("text")).alias("q"))
    return R.dense(asked, docs, k).select((-1 - F.col("qid")).alias("item_id"), F.col("vec_id").alias("doc_id"), "rnk")


DENSE = f"""{vectors_sql("documents", "doc_id", "v")}, {vectors_sql("benchmark", "item_id", "u")}, dt AS (SELECT item_id, doc_id, sum(ut.n * vt.n) dot FROM ut JOIN vt USING (b) GROUP BY 1, 2),
dn AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(dot / (sqrt(un.s) * sqrt(vn.s)), 0), 6) DESC, doc_id)::INT rnk FROM benchmark b CROSS JOIN documents d LEFT JOIN dt USING (item_id, doc_id) LEFT JOIN un USING (item_id) LEFT JOIN vn USING (doc_id)) WHERE rnk <= 50)"""


@query(f"""{catalog.LEGS}, {DENSE}, f3 AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rnk)), 8) rrf FROM (SELECT * FROM bm UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM dn) GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, doc_id, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id)::INT rnk FROM f3) WHERE rnk <= 10""")
def retrieve_three_legs(spark: SparkSession, d: str) -> DataFrame:
    """Lexical, sparse and dense rankings fused."""
    legs = catalog.ranking(spark, d, 50).select("item_id", "doc_id", "rnk").unionByName(catalog.sparse(spark, d, 50).drop("s")).unionByName(dense_leg(spark, d, 50))
    return R.rrf(legs)


@query(f"""SELECT doc_id, len({TOK})::BIGINT n_tokens, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END ELSE 2 END::INT batch FROM documents""")
def store_build(spark: SparkSession, d: str) -> DataFrame:
    """A collection of points written in parts and again: the batch tells that a repeated write stored nothing."""
    size = F.size(T.tokens(F.col("text"))).cast("bigint")
    key = S.point_id(F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select(key.alias("point"), "doc_id", size.alias("n_tokens"))
    kept = KeyedTable(spark, new_folder(spark, "points"), "point", "point string, doc_id bigint, n_tokens bigint")
    changed = F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("n_tokens"))
    kept.upsert(rows.where("doc_id % 2 = 0").withColumn("n_tokens", changed))
    kept.upsert(rows.withColumn("n_tokens", changed))
    kept.upsert(rows)
    kept.upsert(rows.unionByName(rows.where("doc_id % 3 = 0")))
    return kept.read(batch=True).select("doc_id", "n_tokens", "batch")


@query("""SELECT user_id AS session, cursor, cursor seq, event_type step, total, 'step' kind FROM (SELECT user_id, row_number() OVER w::INT cursor, event_type, (sum(event_id % 100) OVER w)::BIGINT total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))""")
def step_events(spark: SparkSession, d: str) -> DataFrame:
    """Steps that arrive in four files, out of order, told in order with running totals."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("int")
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), seq.alias("seq"), F.col("event_type").alias("step"), (F.col("event_id") % 100).alias("tokens"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    path = new_folder(spark, "steps")
    schema = None
    for part in range(4):
        own = rows.where(F.col("event_id") % 4 == 3 - part).drop("event_id").coalesce(1)
        schema = own.schema
        own.write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return events.drain(events.ordered(stream, delay="36500 days", timeout_s=10**9), spark)
