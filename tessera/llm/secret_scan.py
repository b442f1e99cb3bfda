"""Secrets: three fixed patterns, and windows of high Shannon entropy inside candidate strings.

A candidate is a run of one character class (hex, alphanumeric, base64, or letters of one case with digits such as base36
and base32); it may begin after '.' and '='. Of one case with digits, letters and digits must change at least twice, so
that a word beside a number is none, and pure hex is left to its own class. A window slides over it and keeps a count for
each symbol: the symbol that enters adds f(c+1) - f(c), the one that leaves adds f(c-1) - f(c), with f(c) = c log2 c
from a table, so the entropy log2(W) - S/W of each window costs a constant. The span runs from the first to
the last window that reaches its class's bound. Allow-listed strings (UUIDs, placeholders, paths, spelled-out alphabets, plain
words) add none. Base matches are never suppressed.

Only built-in functions. Null and empty texts have no spans; repeated rows are treated alike; a clashing column
`spans` is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of
from .spans import found, told

BASE = ("assign", "access", "hex")
# The base patterns. Equal lengths, case and order of matches as with the plain forms.
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
# Of each class its symbols, window, least entropy, and what a candidate must hold.
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 24, 3.2, r"(?<![A-Za-z0-9+/_-])(?:[0-9a-f]{24,}+|[0-9A-F]{24,}+)(?![A-Za-z0-9+/_=-])", (r"[0-9]", r"[A-Fa-f]")),
    "entropy_alnum": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 3.7, r"(?<![A-Za-z0-9+/_@-])[A-Za-z0-9]{20,}+(?![A-Za-z0-9+/_=@-])", (r"[0-9]", r"[A-Z]", r"[a-z]")),
    "entropy_base64": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-", 24, 4.1, r"(?<![A-Za-z0-9+/_@-])[A-Za-z0-9+/_=-]{24,}+(?![A-Za-z0-9+/_=@-])", (r"[0-9]", r"[A-Z]", r"[a-z]", r"[+/_=-]")),
    "entropy_lower": ("0123456789abcdefghijklmnopqrstuvwxyz", 24, 3.4, r"(?<![A-Za-z0-9+/@])[a-z0-9]{24,}+(?![A-Za-z0-9+/@])", (r"[g-z]", r"[0-9][a-z]+[0-9]|[a-z][0-9]+[a-z]")),
    "entropy_upper": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 24, 3.4, r"(?<![A-Za-z0-9+/@])[A-Z0-9]{24,}+(?![A-Za-z0-9+/@])", (r"[G-Z]", r"[0-9][A-Z]+[0-9]|[A-Z][0-9]+[A-Z]")),
}
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|your[_-]?(?:key|token)|xxxx|changeme|redacted",
    r"(?i)abcdefgh|0123456789|1234567890|qwerty",
    r"^/?(?:[A-Za-z_]+/){2,}[A-Za-z_]+$",
    r"^[-_=+/]*[A-Za-z]+(?:[-_][A-Za-z]+)*[-_=+/]*$",
)


def _allowed(hit: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | hit.rlike(pattern)
    return out


def windows(hit: Column, symbols: str, width: int, least: float) -> Column:
    """struct<first, last>: ends (exclusive) of the first and last window of hit that reach the bound; 0 for none."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    f = lambda c: F.get(table, c)
    code = lambda c: F.instr(F.lit(symbols), c) - 1
    start = F.struct(
        F.array_repeat(F.lit(0), len(symbols)).alias("n"), F.lit(0.0).alias("s"),
        F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last"),
    )

    def slide(codes: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            gone = F.when(a["i"] >= width, F.get(codes, a["i"] - width)).otherwise(F.lit(-1))

            def moved(g: Column) -> Column:
                out = F.when(g >= 0, f(F.get(a["n"], g) - 1) - f(F.get(a["n"], g))).otherwise(F.lit(0.0))
                held = F.get(a["n"], c) - F.when(g == c, 1).otherwise(0)
                s = a["s"] + out + f(held + 1) - f(held)
                n = F.transform(a["n"], lambda v, j: v + F.when(j == c, 1).otherwise(0) - F.when(j == g, 1).otherwise(0))
                hot = (a["i"] + 1 >= width) & (math.log2(width) - s / width >= least)
                return let(
                    F.struct(n.alias("n"), s.alias("s"), hot.alias("hot")),
                    lambda r: F.struct(
                        r["n"].alias("n"), r["s"].alias("s"), (a["i"] + 1).alias("i"),
                        F.when(r["hot"] & (a["first"] == 0), a["i"] + 1).otherwise(a["first"]).alias("first"),
                        F.when(r["hot"], a["i"] + 1).otherwise(a["last"]).alias("last"),
                    ),
                )

            return let(gone, moved)

        return F.aggregate(codes, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    own = F.lower(hit) if symbols == symbols.lower() else hit
    return let(F.transform(F.split(own, ""), code), slide)


def entropy_spans(text: Column, kind: str) -> Column:
    symbols, width, least, pattern, needs = CLASSES[kind]
    holds = lambda hit: reduce(lambda a, b: a & b, [hit.rlike(need) for need in needs])
    runs = F.filter(found(text, pattern), lambda s: holds(s["hit"]) & ~_allowed(s["hit"]))
    hot = F.transform(
        runs,
        lambda s: let(
            windows(s["hit"], symbols, width, least),
            lambda w: F.struct((s["start"] + w["first"] - width).alias("start"), (s["start"] + w["last"]).alias("end"), w["last"].alias("last")),
        ),
    )
    return F.filter(hot, lambda s: s["last"] > 0)


def base_spans(text: Column, kind: str) -> Column:
    """Base matches of a kind, by start."""
    gate = {"access": F.contains(text, F.lit("AKIA"))}.get(kind)
    spans = found(text, PATTERNS[kind], gate)
    if kind == "assign":
        return F.filter(spans, lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 6)
    return spans


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds spans: array<struct<kind, start, end, base>> by start, then kind as listed, base kinds first."""
    t = text_of(text)
    named = lambda spans, kind, place: F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"),
                           F.lit(kind).alias("kind"), F.lit(place < len(BASE)).alias("base")),
    )
    parts = [named(base_spans(t, k), k, i) for i, k in enumerate(BASE)]
    parts += [named(entropy_spans(t, k), k, len(BASE) + i) for i, k in enumerate(CLASSES)]
    made = df.drop("spans").withColumn("spans", F.concat(*parts))
    return made.withColumn(
        "spans",
        F.transform(F.array_sort("spans"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                              s["end"].alias("end"), s["base"].alias("base"))),
    )


def digests(found_: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found_.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(told(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
