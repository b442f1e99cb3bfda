"""Claims and what they rest on: sentences with the chunks they cite, a benchmark from answers and their gold, scores, summaries,
and extracts that must stand in what they were taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import passages as P

#: Characters of a token, for estimates.
CHARS = 2.5
BLANK = " \t\r\n\f\v"


def numbered(df: DataFrame, key: str, name: str = "nth", parts: int = 1024) -> DataFrame:
    """df with the gapless place (from 0) of each row in the order of a whole number that no two rows share.

    Rows are counted in `parts` equal stretches of the number's range; only the counts of stretches meet in one window."""
    whole = F.broadcast(df.agg(F.min(key).alias("_low"), F.max(key).alias("_high")))  # one row
    at = F.floor((F.col(key) - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low") + 1) * parts).cast("int")
    own = df.crossJoin(whole).withColumn("_part", F.least(at, F.lit(parts - 1))).drop("_low", "_high")
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))  # at most `parts` rows
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return own.join(starts, "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")


def benchmark(questions: DataFrame) -> DataFrame:
    """question_id, kind, nth, premise, hypothesis, label of questions (qid, answer, premise).

    Each sentence of an answer is entailed by its own gold, not by that of the question half the list away, nor with its first
    number changed. Questions without gold stand in the list but give no cases; a list of one has no other question."""
    placed = numbered(questions, "qid", "_i")
    n = F.broadcast(questions.agg(F.count("*").alias("_n")))  # one row
    placed = placed.crossJoin(n)
    other = placed.select(F.col("_i").alias("_o"), F.col("premise").alias("_other"), F.col("qid").alias("_oid"))
    own = placed.where("premise != ''").withColumn("_o", (F.col("_i") + F.floor(F.col("_n") / 2)) % F.col("_n")).join(other, "_o")
    said = own.select("qid", "premise", "_other", "_oid", F.posexplode(T.sentences(F.col("answer"))).alias("nth", "s"))
    case = lambda kind, premise, hypothesis, label: F.struct(F.lit(kind).alias("kind"), premise.alias("premise"), hypothesis.alias("hypothesis"), F.lit(label).alias("label"))
    topic = F.when((F.col("_other") != "") & (F.col("_oid") != F.col("qid")), case("negative_topic", F.col("_other"), F.col("s"), False))
    changed = P.mutate_number(F.col("s"))
    number = F.when(changed.isNotNull(), case("negative_number", F.col("premise"), changed, False))
    cases = F.array_compact(F.array(case("positive", F.col("premise"), F.col("s"), True), topic, number))
    return said.select(F.col("qid").alias("question_id"), "nth", F.explode(cases).alias("c")).select("question_id", "c.kind", "nth", "c.premise", "c.hypothesis", "c.label")


def contained_share(premise: Column, hypothesis: Column) -> Column:
    """Stands in for a model: the share of a claim's tokens that the premise has, 0 where a number of the claim is not among its."""
    claim, held = F.array_distinct(T.tokens(hypothesis)), F.array_distinct(T.tokens(premise))
    share = F.when(F.size(claim) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(claim, held)) / F.size(claim))
    digits = lambda t: F.array_distinct(F.regexp_extract_all(T.fold_digits(t), F.lit("[0-9]+"), F.lit(0)))
    return F.when(F.size(F.array_except(digits(hypothesis), digits(premise))) > 0, 0.0).otherwise(F.round(share, 6))


def premise_pairs(answers: DataFrame, markers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, nth, premise, hypothesis of sentences that cite: answers (answer_id, text), markers (answer_id, marker, chunk_id)
    and chunks (chunk_id, text). Chunks count once, in the order of their first citation; unknown markers and chunks are
    passed over; a sentence whose chunks are all unknown or empty, or that says nothing beside its markers, gives no pair."""
    said = answers.select("answer_id", F.posexplode(F.split("text", "[.!؟]+")).alias("nth", "_s")).withColumn("_s", F.btrim("_s", F.lit(BLANK))).where("_s != ''")
    marks = F.regexp_extract_all("_s", F.lit(r"\[([0-9]+)\]"), F.lit(1))
    cited = said.select("answer_id", "nth", F.posexplode(marks).alias("at", "_m")).withColumn("marker", F.col("_m").try_cast("int"))
    # a marker is its text: [01] is not [1]
    cited = cited.where(F.col("marker").cast("string") == F.col("_m")).join(markers.select("answer_id", "marker", "chunk_id"), ["answer_id", "marker"])
    first = cited.groupBy("answer_id", "nth", "chunk_id").agg(F.min("at").alias("at"))
    texts = first.join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id")
    # a sentence's few chunks
    premise = texts.groupBy("answer_id", "nth").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "_t"))), lambda x: x["_t"]), "\n").alias("premise"))
    claim = F.btrim(F.regexp_replace("_s", r"\[[0-9]+\]", ""), F.lit(BLANK))
    return said.join(premise, ["answer_id", "nth"]).select("answer_id", "nth", "premise", claim.alias("hypothesis")).where("premise != '' and hypothesis != ''")


def summary(pairs: DataFrame, score: Column, threshold: float) -> DataFrame:
    """answer_id, checked, entailed and the sentences that failed, in order; a score equal to the threshold passes."""
    own = pairs.withColumn("_ok", score >= threshold)
    failed = F.transform(F.sort_array(F.collect_list(F.when(~F.col("_ok"), F.struct("nth", "hypothesis")))), lambda x: x["hypothesis"])
    return own.groupBy("answer_id").agg(F.count("*").alias("checked"), F.count_if("_ok").alias("entailed"), failed.alias("failed_sentences"))


def bare(extract: Column) -> Column:
    """An extract without the blanks and quotation marks around it."""
    out = F.btrim(F.btrim(extract, F.lit(BLANK)), F.lit('"'))
    return F.btrim(F.btrim(out, F.lit("“”")), F.lit(BLANK))


def verified(chunk: Column, extract: Column) -> Column:
    """struct<text, rewritten>: the extract where it stands word for word in the chunk, blanks aside; the whole chunk where it
    doesn't, is empty or says that there is none."""
    words = lambda c: F.regexp_replace(F.btrim(c, F.lit(BLANK)), r"\s+", " ")
    return T.let(bare(extract), lambda e: T.let(
        F.coalesce((words(e) != "") & (F.upper(e) != "NONE") & F.contains(words(chunk), words(e)), F.lit(False)),
        lambda ok: F.struct(F.when(ok, e).otherwise(chunk).alias("text"), ok.alias("rewritten")),
    ))


def compress_trace(rows: DataFrame, key: str) -> DataFrame:
    """key, chars before and after, the tokens that went by estimate, and how many chunks were rewritten or kept; rows (key, text, kept)
    where kept is verified()."""
    size = lambda c: F.sum(F.char_length(c))
    out = rows.groupBy(key).agg(size("text").alias("chars_before"), size(F.col("kept")["text"]).alias("chars_after"), F.count_if(F.col("kept")["rewritten"]).alias("rewritten"), F.count_if(~F.col("kept")["rewritten"]).alias("kept_whole"))
    return out.withColumn("tokens_removed", ((F.col("chars_before") - F.col("chars_after")) / CHARS).cast("bigint"))
