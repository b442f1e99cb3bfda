"""Registered queries of ledgers, caches and arms, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.streaming import ledger as L

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
TOTALS = f"SELECT event_type step, count(*)::BIGINT calls, sum({K})::BIGINT tokens FROM events GROUP BY 1"
DECLARED = ", ".join(f"('{s}')" for s in L.STEPS)


def tokens() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def stream(spark: SparkSession, d: str) -> DataFrame:
    # the file source reads folders: the glob names the one table
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "false").parquet(f"{d}/events*.parquet").select(F.col("event_type").alias("step"), tokens().alias("tokens"))


@query(TOTALS)
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    return L.drain(stream(spark, d), spark)


@query(f"""WITH t AS ({TOTALS}), s(step) AS (VALUES {DECLARED})
SELECT step, CASE WHEN calls IS NULL THEN 'skipped' ELSE 'run' END state, coalesce(calls, 0)::BIGINT calls, coalesce(tokens, 0)::BIGINT tokens FROM s FULL JOIN t USING (step)""")
def live_steps(spark: SparkSession, d: str) -> DataFrame:
    return L.live_steps(L.totals(table(spark, d, "events").select(F.col("event_type").alias("step"), tokens().alias("tokens"))))


@query(f"SELECT event_id, user_id, sum({K}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT tokens_so_far FROM events")
def session_running_total(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.sum(tokens()).over(w).alias("tokens_so_far"))


@query("""WITH c AS (SELECT event_type, user_id, min(event_id) first, min_by(value, event_id) latency FROM events GROUP BY 1, 2)
SELECT event_id, event_id != first cached, latency FROM events JOIN c USING (event_type, user_id)""")
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Calls with equal keys replay the first call's latency."""
    calls = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    kept = calls.groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"), F.min_by("value", "event_id").alias("latency"))
    return calls.join(kept, ["event_type", "user_id"]).select("event_id", (F.col("event_id") != F.col("first")).alias("cached"), "latency")


@query(f"""SELECT event_type step, coalesce(sum(CASE WHEN user_id % 2 = 0 THEN {K} END), 0)::BIGINT basic, coalesce(sum(CASE WHEN user_id % 2 = 1 THEN {K} END), 0)::BIGINT adaptive,
CASE WHEN coalesce(sum(CASE WHEN user_id % 2 = 0 THEN {K} END), 0) <= coalesce(sum(CASE WHEN user_id % 2 = 1 THEN {K} END), 0) THEN 'basic' ELSE 'adaptive' END lowest FROM events GROUP BY 1""")
def arm_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each step by arm; missing ones are 0 and ties go to the basic arm."""
    part = lambda arm: F.coalesce(F.sum(F.when(F.col("user_id") % 2 == arm, tokens())), F.lit(0))
    cells = table(spark, d, "events").groupBy(F.col("event_type").alias("step")).agg(part(0).alias("basic"), part(1).alias("adaptive"))
    return cells.withColumn("lowest", F.when(F.col("basic") <= F.col("adaptive"), "basic").otherwise("adaptive"))


@query("""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY abs(delta) DESC, source)::INT rnk FROM (
SELECT source, (count(*) FILTER (doc_id % 2 = 1) - count(*) FILTER (doc_id % 2 = 0))::BIGINT delta FROM documents GROUP BY 1)) WHERE rnk <= 5""")
def route_delta(spark: SparkSession, d: str) -> DataFrame:
    """The five sources whose counts differ most between two routes; one row a source reaches the ranking."""
    odd = F.col("doc_id") % 2 == 1
    by = table(spark, d, "documents").groupBy("source").agg((F.count_if(odd) - F.count_if(~odd)).alias("delta"))
    best = by.orderBy(F.abs("delta").desc(), "source").limit(5)
    return best.withColumn("rnk", F.row_number().over(Window.orderBy(F.abs("delta").desc(), "source")).cast("int"))
