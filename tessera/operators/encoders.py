"""Stand-ins for encoders: vectors of hashed tokens, and weights of tokens by a hashed index.

Null texts are empty; an empty text has the zero vector and no weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R

WIDTH = 64


def token_number(token: Column) -> Column:
    """The first four bytes of a token's digest as a whole number."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint")


def hashed(text: Column, width: int = WIDTH) -> Column:
    """How many tokens of text fall into each of `width` buckets, at unit length; each token is looked at once."""

    @F.arrow_udf("array<double>")
    def unit(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        sizes = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(n), sizes) * width + buckets.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(cells, minlength=n * width).reshape(n, width)
        norm = np.sqrt((counts * counts).sum(1).astype("float64"))[:, None]
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype="int32") * width, pa.array((counts / np.where(norm > 0, norm, 1)).ravel()))

    return unit(F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda t: (token_number(t) % width).cast("int")))


def sparse_encode(docs: DataFrame, key: str, level: str = T.PLAIN) -> DataFrame:
    """key, index, value: ln(1 + tf) of each token at its number; tokens that share a number leave the greatest."""
    counted = R.postings(R.counted(docs.withColumn("text", F.coalesce("text", F.lit(""))), key, "text", level), key)
    return counted.groupBy(key, token_number(F.col("term")).alias("index")).agg(F.max(F.log1p("tf")).alias("value"))
