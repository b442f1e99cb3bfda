"""Order MinHash fingerprints: minimal occurrence-numbered k-mers in text order, hashed as tuples.

Tokens are runs without white space of at most CHARS code points; of longer runs every code point starts a token, of up to PIECE
code points, so tokens overlap. A k-mer is K tokens in a row, so shifts inside a text or a long run leave most k-mers alone.
Texts of up to SHORT tokens add k-mers of overlapping characters: all up to FULL tokens, beyond a sample by hash of
the share (FULL / tokens)^2, so that texts of nearly equal length sample nearly alike. Each k-mer gets its occurrence number in the text:
hashes and places are packed into longs and sorted, equal hashes stand together by place, and the number is the distance from
the start of that run (binary search). A hash of k-mer and number chooses one of BINS and a value. The two smallest
values of each bin, in the order in which they stand in the text, are hashed together: moving text around changes tuples even where
the set of k-mers stays. Likeness is the share of equal tuples.

Every k-mer of a text takes part in the choice, whatever its length. Only built-in functions. Null and empty texts have an empty fingerprint, alike (1) to each other and
unlike (0) all else; equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_of

K, CHARS, BIN_BITS = 3, 24, 5
PIECE, FULL, SHORT = 3, 8, 64
INK = r"[^\x20\x09-\x0D]"
WORD = rf"(?<!{INK}){INK}{{1,{CHARS}}}+(?!{INK})"
TOKENS = rf"(?=({WORD}|{INK}{{1,{PIECE}}}+))(?:{WORD}|{INK})"
PIECES = rf"(?s)(?=(.{{1,{PIECE}}}+))."
PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
VALUE_BITS = 64 - BIN_BITS - PLACE_BITS


def _key(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~PLACE))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE))


def _value(x: Column) -> Column:
    return F.shiftrightunsigned(F.shiftleft(x, BIN_BITS), 64 - VALUE_BITS)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _number(s: Column, x: Column, j: Column) -> Column:
    """How many earlier elements of the sorted array s have x's key; x stands at j."""
    half = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")
    step = lambda a, _: let(
        half(a),
        lambda m: let(
            (a["lo"] < a["hi"]) & (F.get(s, m) < _key(x)),
            lambda low: F.struct(
                F.when(low, m + 1).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(m).alias("hi")
            ),
        ),
    )
    start = F.struct(F.lit(0).alias("lo"), j.alias("hi"))
    search = F.aggregate(F.sequence(F.lit(1), F.lit(PLACE_BITS + 1)), start, step, lambda a: j - a["hi"])
    return F.when((j == 0) | (_key(F.get(s, j - 1)) != _key(x)), F.lit(0)).otherwise(search)


def signature(text: Column) -> Column:
    """array<bigint>: one hash for each bin that got a k-mer."""

    def grams(tokens: Column, from_: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(tokens) - K, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(tokens, i + d) for d in range(K)]).bitwiseAND(F.lit(~PLACE)).bitwiseOR(_place((i + from_).cast("bigint"))),
        )

    def sampled(words: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(1)), lambda p: F.xxhash64(p))
        most = F.least(F.lit(1.0), F.pow(F.lit(float(FULL)) / F.size(words), 2)) * (1 << 20)
        return F.filter(let(pieces, lambda p: grams(p, F.size(words))), lambda x: F.shiftrightunsigned(x, 44) < most)

    def of(words: Column) -> Column:
        own = grams(words, F.lit(0))
        return let(F.when(F.size(words) <= SHORT, F.concat(own, sampled(words))).otherwise(own), signed)

    def signed(packed: Column) -> Column:
        chosen = let(
            F.sort_array(packed),
            lambda s: F.transform(
                s, lambda x, j: F.xxhash64(_key(x), _number(s, x, j)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(_place(x))
            ),
        )

        def pair(b: Column, x: Column, j: Column) -> Column:
            def made(y: Column) -> Column:
                first, second = _value(x), F.when(_bin(y) == _bin(x), _value(y)).otherwise(F.lit(-1).cast("bigint"))
                swap = (second >= 0) & (_place(y) < _place(x))
                return F.xxhash64(_bin(x), F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second))

            head = (j == 0) | (_bin(F.get(b, j - 1)) != _bin(x))
            return F.when(head, let(F.coalesce(F.get(b, j + 1), F.bitwise_not(x)), made))

        return let(F.sort_array(chosen), lambda b: F.array_compact(F.transform(b, lambda x, j: pair(b, x, j))))

    words = F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1)), lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return let(words, lambda w: F.when(F.size(w) > 0, of(w)).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(most, F.lit(1)))


def shown(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.hex(x)), ".")


def with_next(df: DataFrame, key: str, carried: list[str], parts: int, made=lambda rows: rows) -> DataFrame:
    """Adds next_<c> of the row that follows in descending order of key (after the last: the first).

    made adds the dear ones among the carried columns: to each row once, and to the copies after they are chosen.

    Rows go once to buckets between quantiles of the key, `parts` of them; a copy of each bucket's first
    row closes the bucket before it. Rows with equal keys follow by their first carried column; null keys come last."""
    cuts = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    if cuts:
        bounds = F.array(*[F.lit(c) for c in cuts])
        step = lambda a, _: let(
            ((a["lo"] + a["hi"]) / 2).cast("int"),
            lambda m: let(
                (a["lo"] < a["hi"]) & (F.get(bounds, m) < F.col(key)),
                lambda low: F.struct(F.when(low, m + 1).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(m).alias("hi")),
            ),
        )
        rounds = F.sequence(F.lit(0), F.lit(math.ceil(math.log2(len(cuts) + 1)) + 1))
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
        bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.aggregate(rounds, start, step, lambda a: a["lo"]))
    else:
        bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0))
    firsts = df.select(key, bucket.alias("_b")).groupBy("_b").agg(F.max(key).alias("_first"))
    order = Window.orderBy(F.col("_b").desc())  # one row a bucket, at most parts + 1
    into = F.coalesce(F.lag("_b").over(order), F.min("_b").over(Window.partitionBy()))
    ghosts = F.broadcast(firsts.select("_first", into.alias("_into")))
    own = made(df.withColumns({"_b": bucket, "_ghost": F.lit(0)}))
    copies = made(df.join(ghosts, df[key].eqNullSafe(ghosts["_first"])).select(*df.columns, F.col("_into").alias("_b"), F.lit(1).alias("_ghost")))
    w = Window.partitionBy("_b").orderBy("_ghost", F.col(key).desc_nulls_last(), carried[0])
    return (
        own.unionByName(copies)
        .withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
        .filter("_ghost = 0")
        .drop("_b", "_ghost")
    )


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds signature, and fingerprint as text."""
    return df.withColumn("signature", signature(text_of(text))).withColumn("fingerprint", shown(F.col("signature")))


def edits(df: DataFrame, parts: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its text with the last third replaced by the start of the next one's."""
    docs = df.select(F.col(key), text_of(text).alias("text"))
    signed = lambda rows: rows.withColumn("signature", signature(F.col("text")))
    near = with_next(docs, key, ["text", "signature"], parts, signed).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    made = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third),
                                              F.substring("next_text", F.lit(1), third)))
    made = made.withColumn("edited_signature", signature(F.col("edited")))
    return made.select(
        key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("signature")).alias("fingerprint"), shown(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
