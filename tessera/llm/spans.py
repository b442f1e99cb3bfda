"""Positions of pattern matches in a text, with built-in functions only.

Spark returns matches without their places. The pieces between matches come from split() with the same
pattern, so a match starts where all pieces and matches before it end. Places count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"
BLOCK = 64


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of bigint.

    Sums of whole blocks first, then inside each block: m * (BLOCK + m / BLOCK^2) steps for m elements."""

    def blocks(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / F.lit(BLOCK)).cast("int")
        part = lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sum(part(b)))
        return let(
            sums,
            lambda s: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), count - 1),
                    lambda b: F.flatten(
                        F.transform(
                            F.array(F.struct(_sum(F.slice(s, F.lit(1), b)).alias("base"), part(b).alias("own"))),
                            lambda w: F.transform(
                                w["own"], lambda x, i: w["base"] + _sum(F.slice(w["own"], F.lit(1), i))
                            ),
                        )
                    ),
                )
            ),
        )

    return let(lengths, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(blocks(xs)))


def found(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, hit>>; patterns never match nothing.

    gate: a cheap test that is true of every text with a match."""

    def placed(s: Column) -> Column:
        own = F.slice(s["gaps"], F.lit(1), F.size(s["hits"]))
        steps = F.zip_with(own, s["hits"], lambda g, h: (F.char_length(g) + F.char_length(h)).cast("bigint"))
        return let(
            F.struct(running(steps).alias("at"), own.alias("own")),
            lambda p: F.transform(
                s["hits"],
                lambda h, i: F.struct(
                    (F.get(p["at"], i) + F.char_length(F.get(p["own"], i))).alias("start"),
                    (F.get(p["at"], i) + F.char_length(F.get(p["own"], i)) + F.char_length(h)).alias("end"),
                    h.alias("hit"),
                ),
            ),
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)
    none = F.array().cast(SPAN)
    some = text.rlike(pattern) if gate is None else gate
    return F.when(F.coalesce(some, F.lit(False)), out.cast(SPAN)).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    weighed = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    parts = F.transform(F.split(F.reverse(number), ""), lambda c, i: weighed(F.ascii(c) - 48, i).cast("bigint"))
    return _sum(parts) % 10 == 0


def told(spans: Column, kind: Column | None = None) -> Column:
    """kind:start:end of an array of structs, comma-joined in its order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"] if kind is None else kind, s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
