"""Chunk operators: table kinds, running ids, titles, filters with fall back, differences of builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def table_kind(rows: Column, cols: Column, top: Column, bottom: Column, page_height: Column) -> Column:
    """header, container or data by shape and place on the page; the order of the rules matters."""
    header = (rows == 3) & (bottom < 0.12 * page_height)
    container = (cols <= 2) & (bottom - top > 0.6 * page_height)
    return F.when(header, "header").when(container, "container").otherwise("data")


def finalise(chunks: DataFrame, order: str) -> DataFrame:
    """Adds chunk_id: source, page, type and a running number inside them."""
    w = Window.partitionBy("source", "page", "type").orderBy(order)
    return chunks.withColumn("chunk_id", F.format_string("%s_p%02d_%s_%02d", "source", "page", "type", F.row_number().over(w) - 1))


def titles(pages: DataFrame, order: str) -> DataFrame:
    """source, title: of the rows of page 1 the last one's."""
    return pages.filter("page = 1").groupBy("source").agg(F.max_by("title", order).alias("title"))


def cover_title(text: Column, word: str) -> Column:
    """The cleaned rest of a cover from its third non-blank line on, whole; null unless the first holds word and three lines or more are there."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rest = T.clean(F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), " "))
    return F.when((F.size(lines) >= 3) & F.contains(F.get(lines, F.lit(0)), F.lit(word)) & (rest != ""), rest)


def allowed(chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """filter_id, n_allowed, fell_back: how many chunks pass each row of filters (filter_id, source, lang; null: any).

    A filter that nothing passes falls back to no filter: all chunks are allowed. Chunks are counted by source and language before they meet filters."""
    seen = chunks.groupBy("source", "lang").agg(F.count("*").alias("n"))
    f = filters.select("filter_id", F.col("source").alias("_source"), F.col("lang").alias("_lang"))
    on = (F.col("_source").isNull() | (F.col("source") == F.col("_source"))) & (F.col("_lang").isNull() | (F.col("lang") == F.col("_lang")))
    every = F.broadcast(seen.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("_all")))  # one row
    met = f.join(seen, on, "left").groupBy("filter_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_allowed")).crossJoin(every)
    fell = F.col("n_allowed") == 0
    return met.select("filter_id", F.when(fell, F.col("_all")).otherwise(F.col("n_allowed")).alias("n_allowed"), fell.alias("fell_back"))


def build_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed or changed rows between two builds; equal rows are left out."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_old")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")
