"""Vector store as tables: point ids, payloads, cache keys, fingerprints, and the gates of a filled collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The namespace of URLs for name-based ids, the prefix of collections, and the payload of a point.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
COLLECTION = "gbg_"
PAYLOAD = (
    "chunk_id", "source", "page", "end_page", "section_path", "chunk_type", "actor", "unit", "table_id", "doc_version",
    "issue_date", "review_date", "extraction_quality", "char_count", "context_prefix", "llm_source",
)


def point_id(chunk_id: Column) -> Column:
    """The name-based UUID (version 5) of a chunk id: building a collection again overwrites the same points."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(chunk_id, "utf-8")))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.translate(at(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def payload(chunks: DataFrame) -> DataFrame:
    """Each point's payload: its named fields, null where the chunks have none, and its text."""
    have = set(chunks.columns)
    return chunks.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in PAYLOAD], "text")


def cache_key(text: Column, **made_by: str | int) -> Column:
    """16 hex digits over all that determines a vector: how it is made, and the text itself, no id."""
    parts = sorted([*made_by, "text"])
    return F.substring(F.sha2(F.to_json(F.struct(*[(text if p == "text" else F.lit(made_by[p])).alias(p) for p in parts])), 256), 1, 16)


def fingerprint(rows: DataFrame, key: str, text: str, width: int = 4096, levels: int = 4) -> DataFrame:
    """chunk_count and sha256 of all rows, whatever order they are stored in.

    Digests are joined by blocks of `width` ids, blocks by blocks of blocks: no task sees more than `width` of them while ids
    are unique. Null texts count as empty ones, null ids as -1."""
    h = rows.select(F.coalesce(F.col(key), F.lit(-1)).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"), F.lit(1).cast("bigint").alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256)
    for _ in range(levels):
        h = h.groupBy(F.floor(F.col("k") / width).alias("k")).agg(whole.alias("h"), F.sum("n").alias("n"))
    return h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), whole.alias("sha256"))


def verify(chunks: DataFrame, points: DataFrame, key: str, fields: list[str], first: int = 5) -> DataFrame:
    """gate, failing, first: the gate of counts, and that of payload fields that a point lacks or has otherwise. No rows: clean."""
    sizes = chunks.agg(F.count("*").alias("a")).join(points.agg(F.count("*").alias("b"))).filter("a != b")
    count = sizes.select(F.lit("count").alias("gate"), F.abs(F.col("a") - F.col("b")).alias("failing"), F.lit(None).cast("array<bigint>").alias("first"))
    there = points.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same &= F.col(f).eqNullSafe(F.col(f"_{f}"))
    bad = chunks.join(there, F.col(key) == F.col("_key"), "left").filter(F.col("_key").isNull() | ~same)
    some = bad.select(key).orderBy(key).limit(first).agg(F.sort_array(F.collect_list(key)).alias("first"))
    field = bad.agg(F.count("*").alias("failing")).filter("failing > 0").join(some).select(F.lit("payload").alias("gate"), "failing", "first")
    return count.unionByName(field)


def cls_pool(states: Column) -> Column:
    """The first token's state."""
    return F.get(states, F.lit(0))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the states that the mask lets through; null where it lets none."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    zero = F.transform(F.get(states, F.lit(0)), lambda x: F.lit(0.0))
    parts = F.zip_with(states, mask, lambda s, m: F.transform(s, lambda x: x.cast("double") * m))
    total = F.aggregate(parts, zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def pca_2d(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, tuple[float, float]]:
    """key, x, y (four places) on the first two principal axes of the centred vectors, and the shares of variance that these explain (0 if none).

    Only the covariance, as wide as a vector, reaches the driver. An axis points where its largest part is positive."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = vectors.filter(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    fed = rows.select(array_to_vector("v").alias("v"))
    mean = fed.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"]
    if mean is None:
        return rows.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), (0.0, 0.0)
    model = PCA(k=2, inputCol="v", outputCol="p").fit(fed)
    axes = model.pc.toArray().T
    axes = [a * (1 if a[np.abs(a).argmax()] > 0 else -1) for a in axes]
    shares = tuple(float(s) if np.isfinite(s) else 0.0 for s in model.explainedVariance.toArray())

    def along(axis) -> Column:
        parts = F.zip_with("v", F.array(*map(F.lit, axis.tolist())), lambda x, a: x * a)
        return F.round(F.aggregate(parts, F.lit(-float(mean.toArray() @ axis)), lambda s, x: s + x), 4)

    return rows.select(key, along(axes[0]).alias("x"), along(axes[1]).alias("y")), shares
