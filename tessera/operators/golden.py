"""Gates of a question set against the corpus that it was read from, each as rows of what fails, and what the set reaches.

Questions (seq, id, question, expect, expected_route, tests, refusal_kind, depends_on, answer, answer_en, pages_read, evidence, gold,
distractors, page_vs_chunk): seq is their order, evidence an array of (chunk_id, quote). Chunks (chunk_id, text, source, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Closed lists and limits of the gates.
EXPECT, ROUTES, REFUSALS = ("answerable", "refuse"), ("simple", "basic_rag", "advanced_rag"), ("out_of_domain", "non_answering_retrieval")
COUNT, LEAST_ARABIC = 20, 0.10


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _none(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _failures(df: DataFrame, gate: int, detail: Column) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), "id", detail.alias("detail"))


def missing_fields(q: DataFrame) -> Column:
    """Names of fields that a question lacks, by what it expects."""
    kind = F.coalesce("refusal_kind", F.lit(""))
    answers, refuses = F.coalesce(F.col("expect") == "answerable", F.lit(False)), (F.coalesce(F.col("expect") == "refuse", F.lit(False)) & (kind == "non_answering_retrieval"))
    name = lambda c, when: F.when(when, F.lit(c))
    return F.array_compact(F.array(
        name("answer", _empty("answer")), name("answer_en", answers & _empty("answer_en")), name("evidence", answers & _none("evidence")),
        name("distractor_chunk_ids", refuses & _none("distractors")), name("pages_read", (answers | refuses) & _none("pages_read")),
    ))


def schema_gate(q: DataFrame, count: int = COUNT) -> DataFrame:
    """Gate 1: the number of questions, repeated ids, closed lists, and fields by what is expected."""
    total = q.agg(F.count("*").alias("n")).where(F.col("n") != count).select(F.lit(1).alias("gate"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("count "), F.col("n").cast("string")).alias("detail"))
    twice = _failures(q.groupBy("id").count().where("count > 1"), 1, F.lit("repeated id"))
    in_ = lambda c, of: F.coalesce(F.col(c).isin(*of), F.lit(False))
    refuse = F.coalesce(F.col("expect") == "refuse", F.lit(False))
    told = F.array_compact(F.array(
        F.when(_empty("question"), "no question"), F.when(~in_("expect", EXPECT), "expect"), F.when(~in_("expected_route", ROUTES), "expected_route"), F.when(_empty("tests"), "no tests"),
        F.when((refuse & ~in_("refusal_kind", REFUSALS)) | (~refuse & F.col("refusal_kind").isNotNull()), "refusal_kind"),
        F.when(F.size(missing_fields(q)) > 0, F.concat(F.lit("missing "), F.array_join(missing_fields(q), ","))),
    ))
    return total.unionByName(twice).unionByName(_failures(q.select("id", F.explode(told).alias("d")), 1, F.col("d")))


def referenced(q: DataFrame) -> DataFrame:
    """id, field, chunk_id of all chunks that a question names."""
    part = lambda field, c: q.select("id", F.lit(field).alias("field"), F.explode(c).alias("chunk_id"))
    cited = F.transform("evidence", lambda e: e["chunk_id"])
    return part("gold_chunk_ids", F.col("gold")).unionByName(part("distractor_chunk_ids", F.col("distractors"))).unionByName(part("evidence", cited))


def reference_gate(q: DataFrame, chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """Gate 2: named chunks that the corpus lacks, and of the others those that a variant (variant, chunk_id) lacks."""
    named = referenced(q)
    at = F.concat_ws(" ", "field", F.col("chunk_id").cast("string"))
    lost = _failures(named.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), 2, at)
    there = named.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    # the variants are the few ways in which a corpus is built
    each = there.crossJoin(F.broadcast(variants.select("variant").distinct()))
    gone = each.join(variants, ["variant", "chunk_id"], "left_anti")
    return lost.unionByName(_failures(gone, 2, F.concat_ws(" ", "field", F.col("chunk_id").cast("string"), F.lit("not in"), "variant")))


def gold_gate(q: DataFrame) -> DataFrame:
    """Gate 3: an answer needs gold, a refusal has none."""
    bad = F.when((F.col("expect") == "answerable") & _none("gold"), "no gold").when((F.col("expect") == "refuse") & ~_none("gold"), "refuse with gold")
    return _failures(q.withColumn("_d", bad).where("_d is not null"), 3, F.col("_d"))


def evidence_gate(q: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gate 4: quotes stand in their chunk, blanks aside; an answer has some. Unknown chunks are gate 2's."""
    none = _failures(q.where((F.col("expect") == "answerable") & _none("evidence")), 4, F.lit("no evidence"))
    e = q.select("id", F.explode("evidence").alias("e")).select("id", F.col("e")["chunk_id"].alias("chunk_id"), F.col("e")["quote"].alias("quote"))
    met = e.join(chunks.select("chunk_id", "text"), "chunk_id").where(~F.contains(T.squeezed(F.coalesce("text", F.lit(""))), T.squeezed(F.coalesce("quote", F.lit("")))))
    return none.unionByName(_failures(met, 4, F.concat_ws(" ", F.lit("quote not in"), F.col("chunk_id").cast("string"))))


def quality_gate(q: DataFrame) -> DataFrame:
    """Gate 5: question and answer, where there are any, on script."""
    said = q.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("t")) for c in ("question", "answer")])).alias("x")).select("id", "x.*").where("t != ''")
    graded = said.withColumn("_q", T.assessed(F.col("t")))
    told = F.array_compact(F.array(F.when(F.col("_q")["verdict"] == "degraded", "degraded"), F.when(F.col("_q")["arabic_ratio"] < LEAST_ARABIC, "arabic_ratio")))
    return _failures(graded.select("id", "name", F.explode(told).alias("d")), 5, F.concat_ws(" ", "name", "d"))


def order_gate(q: DataFrame) -> DataFrame:
    """Gate 6: what a question depends on came before it."""
    first = q.groupBy(F.col("id").alias("depends_on")).agg(F.min("seq").alias("_seq"))
    bad = q.where("depends_on is not null").join(first, "depends_on", "left").where(F.col("_seq").isNull() | (F.col("_seq") >= F.col("seq")))
    return _failures(bad, 6, F.concat(F.lit("depends on "), "depends_on"))


def coverage_gate(q: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gate 7: sources that no gold chunk is from."""
    gold = q.select(F.explode("gold").alias("chunk_id")).distinct().join(chunks.select("chunk_id", "source"), "chunk_id").select("source").distinct()
    lost = chunks.select("source").distinct().join(gold, "source", "left_anti").where("source is not null")
    return lost.select(F.lit(7).alias("gate"), F.lit(None).cast("string").alias("id"), F.col("source").alias("detail"))


def fingerprint_gate(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Gate 8: the corpus is the one that was read: one row each of chunk_count and sha256."""
    both = stored.select(F.col("chunk_count").alias("_n"), F.col("sha256").alias("_h")).crossJoin(F.broadcast(current))
    bad = both.where(~(F.col("_n").eqNullSafe(F.col("chunk_count")) & F.col("_h").eqNullSafe(F.col("sha256"))))
    return bad.select(F.lit(8).alias("gate"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("read against "), F.col("_n").cast("string")).alias("detail"))


def gates(q: DataFrame, chunks: DataFrame, variants: DataFrame, stored: DataFrame, current: DataFrame, count: int = COUNT) -> DataFrame:
    """gate, id, detail of all that fails; no rows: clean."""
    parts = (schema_gate(q, count), reference_gate(q, chunks, variants), gold_gate(q), evidence_gate(q, chunks), quality_gate(q), order_gate(q), coverage_gate(q, chunks), fingerprint_gate(stored, current))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(q: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunk types and paths that gold reaches, the median (rounded down), least and most gold of an answerable question, and the disagreements between page and chunk."""
    reached = q.select(F.explode("gold").alias("chunk_id")).join(chunks, "chunk_id").agg(F.count_distinct("chunk_type").alias("types"), F.count_distinct("section_path").alias("paths"))
    n = F.when(F.col("expect") == "answerable", F.greatest(F.coalesce(F.size("gold"), F.lit(0)), F.lit(0)))
    own = q.agg(F.floor(F.median(n)).alias("median_gold"), F.min(n).alias("least_gold"), F.max(n).alias("most_gold"), F.count_if(~F.coalesce("page_vs_chunk", F.lit("")).isin("", "none")).alias("disagreements"))
    return reached.crossJoin(own)


def worksheet(q: DataFrame, pages: str = "pages_read") -> DataFrame:
    """ref, asked: page references with the ids of the questions that point to them, in the order of the questions."""
    pointing = q.select("seq", "id", F.explode(F.array_distinct(pages)).alias("ref"))
    return pointing.groupBy("ref").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ", ").alias("asked"))
