"""Mixing sources to target weights over a time-varying curriculum.

Targets share the corpus's words by weight, no source above `most` times its size: the level L with
sum(min(most * size, L * weight)) = all words, found by a few sums over the table of sources. A source's weight falls or rises linearly in training time u,
w(u) = target * (1 + a * (1 - 2u)), so its cumulative demand is target * ((1 + a) u - a u^2). A document that begins after x of
its source's words (in a hashed order, pass after pass) is trained on at the u that solves demand(u) = x.
Documents are range-sorted by that position.

Running sums are worked out inside range partitions and shifted by one sum for each partition and source, so a source with any share of the
rows is spread over partitions. Null texts have size 0; a null source is a source of its own, last in order. Sources without words
have target 0. Repeated rows are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked, text_of

WEIGHTS, MOST, SLOPES = (5.0, 2.0, 1.0), 3, (0.5, 0.0, -0.5)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, place (from 0, by code point, null last) and target of each source."""
    table = ranked(sources, F.col("source").asc_nulls_last(), name="place", label="sources")
    of = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("place") % len(xs)).cast("int"))
    table = cut(table.withColumn("weight", of(weights)), "weights")
    cap, level, capped = F.col("source_size") * most, None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level >= cap
        row = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.count_if(over).alias("capped"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        level, capped = (row["all"] - row["full"]) / row["open"], row["capped"]
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * (level or 0.0)))


def _runs(batches):
    """Adds each row's partition and the sum of sizes so far of its source in that partition; rows come by source."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, last, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        place = batch.column("place").to_numpy(zero_copy_only=False)
        size = batch.column("size").to_numpy(zero_copy_only=False)
        sums = np.cumsum(size)
        if len(place):
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            base = np.where(starts > 0, sums[starts - 1], 0)
            base[0] -= total if place[0] == last else 0
            sums = sums - np.repeat(base, np.diff(np.r_[starts, len(place)]))
            last, total = place[-1], sums[-1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(place), part, "int32")), pa.array(sums.astype("int64"))],
            [*batch.schema.names, "_part", "_run"],
        )


def position(done: Column, slope: Column) -> Column:
    """The time u in [0, 1] at which the part `done` of a source's demand is met: (1 + a) u - a u^2 = done."""
    b = slope + 1
    root = F.sqrt(F.greatest(b * b - slope * done * 4, F.lit(0.0)))
    return F.when(slope == 0, done).otherwise((b - root) / F.when(slope == 0, 1.0).otherwise(slope * 2))


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = "mix",
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, place, target, taken, begin (words of the source before it in a pass), a slope and first position."""
    sized = cut(
        df.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), F.col(key)).alias("_order"), F.xxhash64(text_of(text)).alias("_tie"),
        ),
        "sized",
    )
    table = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    table = cut(table.withColumnRenamed("source", "_source"), "targets")
    docs = sized.join(table, sized["source"].eqNullSafe(table["_source"])).drop("_source", "weight")
    by = [F.col("place"), F.col("_order"), F.col("doc_id"), F.col("_tie")]
    sorted_ = docs.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    line = cut(sorted_.mapInArrow(_runs, schema + ", _part int, _run bigint"), "line")
    sums = line.groupBy("place", "_part").agg(F.max("_run").alias("_sum"))
    earlier = Window.partitionBy("place").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("place", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    begin = F.col("_before") + F.col("_run") - F.col("size")
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.floor("target") - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begin")))
    slope = F.get(F.array(*map(F.lit, SLOPES)), (F.col("place") % len(SLOPES)).cast("int"))
    return (
        line.join(shift, ["place", "_part"])
        .withColumn("begin", begin)
        .withColumn("taken", (full * F.col("size") + part).cast("bigint"))
        .withColumn("slope", slope)
        .withColumn("position", F.when(F.col("taken") > 0, position(F.col("begin") / F.col("target"), F.col("slope"))))
        .drop("_part", "_run", "_before", "_order")
    )


def passes(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is trained on: pass (from 0), words and position. Documents not taken have none."""
    count = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    out = mixed.filter("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), count - 1)))
    at = (F.col("pass") * F.col("source_size") + F.col("begin")) / F.col("target")
    return out.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))).withColumn(
        "position", position(F.least(at, F.lit(1.0)), F.col("slope"))
    )


def by_position(df: DataFrame) -> DataFrame:
    return df.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("_tie")).sortWithinPartitions(
        F.col("position").asc_nulls_last(), "doc_id", "_tie"
    )
