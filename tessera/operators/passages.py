"""Passages: names of pages, prefixes, segments and pieces of prose, markers and what a model is shown; Column expressions unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

MOST, LEAST = 1200, 40
RULE = r"^\s*[-_]\s*[0-9]{1,2}\s"
#: The line end before a line that RULE finds; its blanks are none that end a line.
CUT = r"\n(?=[^\S\n]*[-_][^\S\n]*[0-9]{1,2}[^\S\n])"
ROUTES = {"simple": "Direct", "basic_rag": "Basic RAG", "advanced_rag": "Advanced RAG"}


def page_ref(slug: Column, page: Column) -> Column:
    return F.format_string("%s:p%02d", slug, page)


def parse_page_ref(ref: Column) -> list[Column]:
    return [F.split_part(ref, F.lit(":p"), F.lit(1)).alias("slug"), F.split_part(ref, F.lit(":p"), F.lit(2)).try_cast("int").alias("page")]


def page_range(arg: Column) -> Column:
    """References of slug:a-b or slug:a; null where no pages are named or the range is empty."""
    part = lambda i: F.regexp_extract(arg, r"^(.+):([0-9]+)(?:-([0-9]+))?$", i)
    low, high = part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), part(2).try_cast("int"))
    return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda p: page_ref(part(1), p)))


def page_label(page: Column, end: Column) -> Column:
    return F.when(end.isNotNull() & (end != page), F.format_string("pages %d-%d", page, end)).otherwise(F.format_string("page %d", page))


def compose(prefix: Column, body: Column) -> Column:
    return F.when(prefix == "", body).otherwise(F.concat(prefix, F.lit("\n\n"), body))


def decompose(prefix: Column, text: Column) -> Column:
    """The body; null where text doesn't begin as composed."""
    lead = F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("\n\n")))
    return F.when(F.startswith(text, lead), F.substring(text, F.char_length(lead) + 1, F.lit(2**31 - 1)))


def template(*parts: Column) -> Column:
    return F.concat_ws("، ", *parts)


def join_lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def score_text(score: Column) -> Column:
    return F.coalesce(F.format_string("%.3f", score).substr(F.lit(1), F.when(score.isNotNull(), F.lit(99))), F.lit("N/A"))


def route_shown(route: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ROUTES.items() for x in p]), route), route)


def segments(body: Column) -> Column:
    """A body cut before each line that opens a numbered rule; trimmed, none blank."""
    return F.filter(F.transform(F.split(body, CUT), lambda s: F.btrim(s, F.lit(" \t\n\r\f\v"))), lambda s: s != "")


def packed(segment: Column, limit: int = MOST) -> Column:
    """Whole lines put together up to limit characters, a line's end counted with each; a longer line stands alone.

    One pass over the lines' sizes finds where pieces begin; each piece is put together once."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"))

    def step(a: Column, line: Column) -> Column:
        return F.when((line["i"] > 0) & (a["n"] + line["size"] <= limit), F.struct(a["starts"].alias("starts"), (a["n"] + line["size"]).alias("n"))).otherwise(
            F.struct(F.array_append(a["starts"], line["i"]).alias("starts"), line["size"].alias("n"))
        )

    def pieces(lines: Column) -> Column:
        sizes = F.transform(lines, lambda x, i: F.struct(i.alias("i"), (F.char_length(x) + 1).alias("size")))
        piece = lambda starts: lambda s, j: F.array_join(F.slice(lines, s + 1, F.coalesce(F.get(starts, j + 1), F.size(lines)) - s), "\n")
        return T.let(F.aggregate(sizes, start, step, lambda a: a["starts"]), lambda starts: F.transform(starts, piece(starts)))

    return F.when(F.char_length(segment) <= limit, F.array(segment)).otherwise(T.let(F.split(segment, "\n"), pieces))


def prose(body: Column, limit: int = MOST, least: int = LEAST) -> Column:
    """Pieces of at least `least` characters; none of a body that is shorter itself."""
    pieces = F.filter(F.flatten(F.transform(segments(body), lambda s: packed(s, limit))), lambda p: F.char_length(p) >= least)
    return F.when(F.char_length(body) >= least, pieces).otherwise(F.array().cast("array<string>"))


def content_words(text: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text, r"\[[0-9]+\]", " "), F.lit(r"\S+"))


def arabic_fraction(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[ء-ي]")) / F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))


def mutate_number(text: Column) -> Column:
    """The first number, digits folded, made 37 greater; null without one. Numbers of up to 37 digits."""
    t = T.fold_digits(text)
    first = F.regexp_extract(t, "[0-9]+", 0)
    at = F.instr(t, first)
    more = (first.try_cast("decimal(38,0)") + 37).cast("decimal(38,0)").cast("string")
    return F.when(first != "", F.concat(F.substring(t, F.lit(1), at - 1), more, F.substring(t, at + F.char_length(first), F.lit(2**31 - 1))))


def leaks(text: Column, ids: Column) -> Column:
    return F.exists(ids, lambda i: F.contains(text, i))


def citations(text: Column, sent: Column) -> Column:
    """struct<cited, invalid>: ids of the markers 1 to size(sent), each once by first place; all other markers."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda v: v.try_cast("int"))
    valid = lambda i: F.coalesce((i >= 1) & (i <= F.size(sent)), F.lit(False))
    return F.struct(F.array_distinct(F.transform(F.filter(numbers, valid), lambda i: F.get(sent, i - 1))).alias("cited"), F.filter(numbers, lambda i: ~valid(i)).alias("invalid"))


def renumbered(text: Column, sent: Column, cited: Column, before: str = "[", after: str = "]") -> Column:
    """Markers shown by the place of their id among the cited ones; markers that resolve to none stay as text."""
    parts = F.regexp_extract_all(text, F.lit(r"\[[0-9]+\]|[^\[]+|\["), F.lit(0))

    def shown(p: Column) -> Column:
        number = F.when(p.rlike(r"^\[[0-9]+\]$"), F.regexp_extract(p, "[0-9]+", 0).try_cast("int"))
        place = F.when((number >= 1) & (number <= F.size(sent)), F.array_position(cited, F.get(sent, number - 1)))
        return F.when(place > 0, F.concat(F.lit(before), place.cast("string"), F.lit(after))).otherwise(p)

    return F.array_join(F.transform(parts, shown), "")


def rendered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, context, judged: numbered blocks of a question's chunks (chunk_id, text), which are few by the budget of a prompt."""
    blocks = F.sort_array(F.collect_list(F.struct(order, "chunk_id", "text")))
    numbered = lambda make: F.array_join(F.transform("_b", lambda b, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), make(b))), "\n\n")
    out = rows.groupBy(key).agg(blocks.alias("_b"))
    return out.select(key, numbered(lambda b: F.concat(F.lit("("), b["chunk_id"], F.lit(")\n"), b["text"])).alias("context"), numbered(lambda b: b["text"]).alias("judged"))
