"""Where registered queries and their SQL are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def over(spark: SparkSession, d: str, sql: str, *names: str, key: str | None = None) -> DataFrame:
    """sql with the tables that it names after FROM taken from d, dealt by key if it has one; no view of the session is touched."""
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    of = lambda n: dealt(table(spark, d, n), key) if key else table(spark, d, n)
    return spark.sql(sql, **{n: of(n) for n in names})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and latest change of a table's files: what is kept for a table goes by this, so that a table written anew is read anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return 0, 0
    files = list(fs.listStatus(where)) if fs.getFileStatus(where).isDirectory() else [fs.getFileStatus(where)]
    return sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


#: What queries of this driver stored for others, by application.
_STORED: dict[tuple, Any] = {}


def scratch(spark: SparkSession, key: tuple, build: Callable[[str], Any]) -> Any:
    """build(path) once for an application and key; path is a new folder below spark.checkpoint.dir, which all executors share.

    Only a local master may fall back to a temporary folder."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _STORED:
        _STORED[key] = build(new_folder(spark, key[1]))
    return _STORED[key]


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/{label}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker.
BATCH = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends its workers batches of BATCH bytes: what a worker holds follows neither a partition nor the length of its texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


#: Rows of a plan's tables for a partition of its shuffles.
SHARE = 100_000


def stored(df: DataFrame, label: str, rows: int = 0) -> DataFrame:
    """df as a table in the shared folder: a plan that several branches read is worked out once, and a lost executor costs none of it.

    rows: of the tables that df reads. Its shuffles have a partition for each SHARE of them, if the session's number is less, so
    that what a task sorts does not grow with the tables; adaptive execution joins small ones again. Nothing else runs the plan
    again: the files of its shuffles go once the table is written, so that the disk holds those of one step at a time."""
    spark = df.sparkSession
    path, parts = new_folder(spark, label), "spark.sql.shuffle.partitions"
    own = {parts: max(int(spark.conf.get(parts)), -(-rows // SHARE)), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    was = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        with small_batches(spark):
            df.write.parquet(path)
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over a partition for each SHARE of its rows, where the session has fewer; for tables, whose files tell their rows."""
    parts = -(-df.count() // SHARE)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
