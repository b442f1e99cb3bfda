"""Prefixes that give a chunk its context: tidied answers, checks, the budget of a section's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Labels, quotes and openings that models add, bounds of a prefix, and characters that a prompt may hold.
LABEL = r"^(السياق|الجملة|جملة\s+السياق|الوصف)\s*[:：]\s*"
QUOTES = "\"'«»“”‘’"
OPENINGS = ("بالتأكيد", "بالطبع", "إليك", "الجملة هي", "هذا النص", "here is", "sure,", "certainly")
SHORTEST, LONGEST, ARABIC_LEAST, FOREIGN_MOST, COPIED, COMPRESSED = 20, 300, 0.5, 0.01, 0.9, 0.75
MIXED = r"[؀-ۿ][A-Za-z]|[A-Za-z][؀-ۿ]"
PAGE_WORDS = ("صفحة", "صفحات")
PROMPT = 16_800


def tidy(raw: Column) -> Column:
    """An answer in one line, without the label and the quotes that models wrap it in."""
    line = F.regexp_replace(F.translate(T.clean(T.nfkc(raw)), "\n", " "), LABEL, "")
    return F.regexp_replace(line, rf"^[{QUOTES}\s]+|[{QUOTES}\s]+$", "")


def rejected(prefix: Column, chunk: Column) -> Column:
    """Why a prefix cannot be used, the first of the rules that it breaks; null if it breaks none. Beside an empty chunk nothing counts as copied."""
    n, q = F.char_length(prefix), T.assessed(prefix)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[^\s]+"), F.lit(0)))
    own = words(prefix)
    copied = (n / F.nullif(F.char_length(chunk), F.lit(0)) > COMPRESSED) & (F.size(F.array_intersect(own, words(chunk))) / F.nullif(F.size(own), F.lit(0)) > COPIED)
    opened = F.lit(False)
    for o in OPENINGS:
        opened |= F.lower(prefix).startswith(o)
    return (
        F.when(n == 0, "empty").when((n < SHORTEST) | (n > LONGEST), "length").when(q["arabic_ratio"] < ARABIC_LEAST, "arabic_ratio")
        .when(q["off_script_ratio"] > FOREIGN_MOST, "off_script_ratio").when(prefix.rlike(MIXED), "mixed_script")
        .when(F.contains(chunk, prefix), "verbatim").when(copied, "copied").when(opened, "preamble")
    )


def template_gate(prefix: Column, title: Column, section: Column) -> Column:
    """Why a template's prefix fails: it names a manual, a section where there is one, and a page. Null if it does."""
    p = F.coalesce(prefix, F.lit(""))
    paged = F.contains(p, F.lit(PAGE_WORDS[0])) | F.contains(p, F.lit(PAGE_WORDS[1]))
    return (
        F.when(p == "", "empty").when(F.contains(p, F.lit("None")), "None").when(title.isNull(), "untitled").when(~F.contains(p, title), "manual")
        .when((F.coalesce(section, F.lit("")) != "") & ~F.contains(p, section), "section").when(~paged, "page")
    )


def section_budget(chunks: DataFrame, section: str, order: str, header: Column, scaffold: int, gap: str = "\n\n") -> DataFrame:
    """section, body (its chunks' texts in order, cut to what the prompt leaves beside header, largest chunk and scaffold) and whether it was cut.

    A body holds PROMPT characters at most, so PROMPT / len(gap) + 1 chunks reach it; the others count by their lengths only."""
    rows = chunks.withColumn("_t", F.coalesce("text", F.lit("")))
    most = rows.groupBy(section).agg(F.sum(F.char_length("_t") + len(gap)).alias("_sum"), F.max(F.char_length("_t")).alias("_most"))
    place = F.row_number().over(Window.partitionBy(section).orderBy(order, "_t"))
    few = rows.withColumn("_n", place).filter(F.col("_n") <= PROMPT // len(gap) + 1).select(section, "_n", F.substring("_t", 1, PROMPT).alias("_t"))
    joined = few.groupBy(section).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), gap).alias("_all"))
    allowed = F.greatest(F.lit(PROMPT) - F.char_length(header) - F.col("_most") - scaffold, F.lit(0))
    cut = F.col("_sum") - len(gap) > F.lit(PROMPT) - F.char_length(header) - F.col("_most") - scaffold
    body = F.when(cut, F.substring(F.col("_all"), F.lit(1), allowed)).otherwise(F.col("_all"))
    return joined.join(most, section).select(section, body.alias("body"), cut.alias("cut"))
