"""Documents and chunks as files: a JSON envelope of text and metadata, and a cache of calls.

Spark keeps no order of lines in files, so order is a column, `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CALL = "key string, answer string, prompt_tokens bigint, completion_tokens bigint, latency_s double"


def save(rows: DataFrame, path: str, text: str = "text") -> None:
    """Writes {text, metadata: all other columns} as JSON lines; null values are written, not left out."""
    rest = [c for c in rows.columns if c != text]
    rows.select(F.col(text).alias("text"), F.struct(*rest).alias("metadata")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load(spark: SparkSession, path: str, metadata: str) -> DataFrame:
    """The inverse of save, with a stated schema of metadata: no pass over the files infers it."""
    inner = StructType.fromDDL(metadata)
    return spark.read.schema(StructType().add("text", "string").add("metadata", inner)).json(path).select("text", "metadata.*")


def load_array(spark: SparkSession, path: str, metadata: str) -> DataFrame:
    """Reads files that are one JSON array each; seq is the place in the array."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<struct<text: string, metadata: struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(metadata))}>>>")
    return whole.select(F.posexplode(items).alias("seq", "item")).select("seq", "item.text", "item.metadata.*")


def call_key(*parts: Column) -> Column:
    """The first 12 hex digits of the request's digest; null parts count, so that no two requests share a key by leaving parts out."""
    named = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return F.substring(F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256), 1, 12)


def store(calls: DataFrame, path: str) -> None:
    calls.select("key", "answer", "prompt_tokens", "completion_tokens", "latency_s").write.mode("append").parquet(path)


def read_through(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) with the answer, tokens and latency of the fastest stored call, and whether there was one.

    A key that was stored more than once, as after a lost task, counts once."""
    once = cache.groupBy("key").agg(F.min(F.struct("latency_s", "prompt_tokens", "completion_tokens", "answer")).alias("_hit"))
    met = requests.join(once, "key", "left").withColumn("cached", F.col("_hit").isNotNull())
    return met.select(*requests.columns, "_hit.answer", "_hit.prompt_tokens", "_hit.completion_tokens", "_hit.latency_s", "cached")
