"""What models say, read tolerantly: JSON answers as variants, names against closed lists, the gate before any call, and guards after."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# Closed vocabularies.
ROUTES = ("simple", "basic_rag", "advanced_rag")
TECHNIQUES = ("Rewriting", "Multi-Query", "Decomposition", "HyDE", "Self-Query", "Reranking", "Compression", "CRAG")
GRADES = ("correct", "ambiguous", "incorrect")
KINDS = ("direct", "grounded", "refused")
MEMORY_ERRORS = ("out of memory", "cudamalloc", "insufficient memory", "requires more system memory", "memory layout", "allocation")


def parsed(raw: Column) -> Column:
    """A variant; null where raw is no JSON."""
    return F.try_parse_json(raw)


def field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def is_text(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "STRING", F.lit(False))


def strings(v: Column, path: str) -> Column:
    """The strings of a list; null where there is no list."""
    items = F.try_variant_get(v, f"$.{path}", "array<variant>")
    kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(kept, lambda x: F.try_variant_get(x, "$", "string"))


def as_bool(value: Column, default: bool = True) -> Column:
    """A string is false if it says so; null is the default."""
    return F.when(value.isNull(), F.lit(default)).otherwise(~F.lower(F.trim(value)).isin("false", "no", "0", ""))


def as_year(value: Column) -> Column:
    return F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).try_cast("int"))


def issue_year(date: Column) -> Column:
    return F.when(F.contains(date, F.lit("/")), F.trim(F.substring_index(date, "/", -1)).try_cast("int"))


def routed(raw: Column) -> Column:
    """struct<route, requested, dropped, refusal>: unreadable answers and unknown routes go to the widest route."""
    v = parsed(raw)
    known = F.coalesce(is_text(v, "route") & field(v, "route").isin(*ROUTES), F.lit(False))
    names = F.coalesce(strings(v, "techniques"), F.array().cast("array<string>"))
    vocabulary = F.array(*map(F.lit, TECHNIQUES))
    none = F.array().cast("array<string>")
    route = F.when(known, field(v, "route")).otherwise("advanced_rag")
    return F.struct(
        route.alias("route"),
        F.when(known, F.filter(names, lambda t: F.array_contains(vocabulary, t))).otherwise(none).alias("requested"),
        F.when(known, F.filter(names, lambda t: ~F.array_contains(vocabulary, t))).otherwise(none).alias("dropped"),
        F.when((route == "simple") & ~as_bool(field(v, "in_scope")), "out_of_domain").alias("refusal"),
    )


def text_list(raw: Column, path: str, most: int, otherwise: Column | None = None) -> Column:
    """The first `most` strings that are not blank; otherwise (or an empty list) where there are none."""
    found = F.slice(F.filter(F.coalesce(strings(parsed(raw), path), F.array().cast("array<string>")), lambda s: F.trim(s) != ""), 1, most)
    return found if otherwise is None else F.when(F.size(found) > 0, found).otherwise(F.array(otherwise))


def grade(raw: Column, n_candidates: Column) -> Column:
    v = parsed(raw)
    return F.when(n_candidates == 0, "incorrect").otherwise(F.coalesce(F.when(field(v, "verdict").isin(*GRADES), field(v, "verdict")), F.lit("ambiguous")))


def filters(raw: Column, question: Column, sources: tuple[str, ...], types: tuple[str, ...]) -> Column:
    """struct<query, source, chunk_type, before, after, page>: values outside their lists, and years that are none, are dropped."""
    v = parsed(raw)
    asked = F.when(is_text(v, "semantic_query") & (F.trim(field(v, "semantic_query")) != ""), field(v, "semantic_query")).otherwise(question)
    one = lambda name, values: F.when(field(v, f"filters.{name}").isin(*values), field(v, f"filters.{name}"))
    return F.struct(
        F.trim(asked).alias("query"), one("source", sources).alias("source"), one("chunk_type", types).alias("chunk_type"),
        *[as_year(field(v, f"filters.{n}")).alias(a) for n, a in (("issue_date_before", "before"), ("issue_date_after", "after"), ("page", "page"))],
    )


def matches(f: Column, source: Column, type_: Column, year: Column, page: Column) -> Column:
    """Whether a chunk passes all filters that are set; a chunk without a year passes no filter of years."""
    ok = lambda test, value: value.isNull() | F.coalesce(test, F.lit(False))
    return ok(source == f["source"], f["source"]) & ok(type_ == f["chunk_type"], f["chunk_type"]) & ok(year < f["before"], f["before"]) & ok(year > f["after"], f["after"]) & ok(page == f["page"], f["page"])


def pre_gate(message: Column) -> Column:
    """simple for empty messages, greetings and short ones without a question mark of either script; else pass."""
    bare = F.regexp_replace(message, r"^\s+|\s+$", "")
    key = T.gate_key(bare)
    words = F.regexp_count(key, F.lit(r"\S+"))
    return (
        F.when(bare == "", "simple").when(key.isin(*T.GREETINGS), "simple").when(bare.rlike("[?؟]"), "pass").when(words < 3, "simple").otherwise("pass")
    )


def guard(allowed: Column, presented: Column, refusal: bool = False) -> Column:
    """struct<tokens, citations, passed>: tokens and markers of a text that the text it was made from lacks, sorted.

    In a refusal every marker is one too many."""
    tokens = F.sort_array(F.array_except(T.alnum_set(presented), T.alnum_set(allowed)))
    marks = T.citation_set(presented)
    marks = F.sort_array(marks if refusal else F.array_except(marks, T.citation_set(allowed)))
    return F.struct(tokens.alias("tokens"), marks.alias("citations"), ((F.size(tokens) == 0) & (F.size(marks) == 0)).alias("passed"))


def drift(allowed: Column, presented: Column) -> Column:
    """array<struct<segment, words>>: Arabic words, by segment, that the allowed text has nowhere."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[ء-ي]+"), F.lit(0)))
    parts = F.filter(F.transform(F.split(presented, r"[.!؟،؛\n]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    new = F.transform(parts, lambda s: F.struct(s.alias("segment"), F.sort_array(F.array_except(words(s), words(allowed))).alias("words")))
    return F.filter(new, lambda x: F.size(x["words"]) > 0)


def sound_answer(kind: Column, refusal: Column, n_citations: Column) -> Column:
    """A known kind; a refusal kind exactly for refusals; citations only where grounded."""
    return kind.isin(*KINDS) & ((kind == "refused") == refusal.isNotNull()) & ((kind == "grounded") | (n_citations == 0))


def memory_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(MEMORY_ERRORS))
