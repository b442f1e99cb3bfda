"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master may fall back to a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(path)
    return path


#: What this driver wrote to the shared folder and broadcast, in order, for sweep().
_MADE: list = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: a lost executor costs no recomputation
    of what came before, and values that depend on the task (row numbers) are fixed."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_clean(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """cut() of a plan that nothing else runs again: the files of its shuffles go once the table is written, so that the disk
    holds those of one step at a time."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """value as a broadcast; callers prove its bound."""
    made = spark.sparkContext.broadcast(value)
    _MADE.append(made)
    return made


def made() -> int:
    return len(_MADE)


def sweep(spark: SparkSession, since: int) -> None:
    """Removes the tables and broadcasts made after the first `since`, but for the last table; nothing may read them any more."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    last = max((i for i in range(since, len(_MADE)) if isinstance(_MADE[i], str)), default=-1)
    for i in range(since, len(_MADE)):
        if not isinstance(_MADE[i], str):
            _MADE[i].unpersist()
        elif i != last:
            where = path(_MADE[i])
            where.getFileSystem(conf).delete(where, True)
    _MADE[since:] = [_MADE[last]] if last >= 0 else []


def sliced(batches, text: str = "text", rows: int = 256, size: int = 1 << 20):
    """Arrow batches in slices of at most `rows` rows, a slice ending after the row that reaches `size` bytes of text: what a
    worker holds beside a batch depends on a slice, not on the batch."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64")
        part = (np.cumsum(lengths) - lengths) // size * batch.num_rows + np.arange(batch.num_rows) // rows
        starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def read_bytes(column):
    """UTF-8 bytes of each text of an Arrow column as views of its buffer; null as none."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]]


def word_lcp(words):
    """Leading bytes that each row of big-endian 8-byte digits shares with the row before it; 0 for the first."""
    import numpy as np

    out = np.zeros(len(words), np.int64)
    if len(words) > 1:
        x = words[1:] ^ words[:-1]
        same = np.append(x == 0, np.zeros((len(x), 1), bool), axis=1)
        at = np.argmin(same, axis=1)
        digit = np.append(x, np.full((len(x), 1), (1 << 64) - 1, np.uint64), axis=1)[np.arange(len(x)), at]
        out[1:] = at * 8 + sum((digit < np.uint64(1 << (8 * i))).astype(np.int64) for i in range(1, 8))
    return out


def lean(run):
    """The task function `run` over Arrow batches; at its end the worker, which lives on, returns what it no longer holds to the system."""

    def own(batches):
        yield from run(batches)
        give_back()

    return own


def give_back() -> None:
    """Free pages of this process go back to the system, where its C library can do so."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ranked(df: DataFrame, *order: Column, name: str = "rank", label: str = "ranked") -> DataFrame:
    """Adds the gapless 0-based position in a global order, without a one-partition window.

    A range exchange splits by sampled bounds, so a hot leading key is split by the keys after it. Rows
    are numbered inside their partition; one small row for each partition carries its offset."""
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a partition: its size is bound by the number of partitions
    offsets = F.broadcast(before(sizes, "_part", "_n", "_before"))
    return (
        placed.withColumn("_part", part)
        .join(offsets.select("_part", "_before"), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_before", "_at")
    )


def before(sizes: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Exclusive running sum of n by key, for a table of one row a partition."""
    from pyspark.sql import Window

    return sizes.withColumn(
        name, F.coalesce(F.sum(n).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
