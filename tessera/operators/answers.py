"""From what a question's techniques left to an answer: sentences with the chunks they are from, their presentation, the guard over
it, and one row a question. Answers of models in two shapes, and scores of judges.

The writer and the presenter are deterministic stand-ins; whatever writes, citations are resolved and the guard compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import parsing as X
from tessera.operators import passages as P

# Chunks that an answer draws on, what is said without one, and what a judge gives.
DRAWN = 3
REFUSAL, DIRECT = "The corpus does not answer this question.", "Hello. Ask about the manuals."
SCORES = ("context_relevance", "faithfulness", "answer_relevance", "correctness")


def best_sentence(question: Column, text: Column) -> Column:
    """The sentence of text that shares most distinct tokens with the question, of equals the first, on one line; null for a text without any."""
    pieces = F.filter(F.transform(F.split(text, "[.!؟]+"), T.squeezed), lambda s: s != "")
    shared = lambda s, asked: F.size(F.array_intersect(asked, T.tokens(s)))
    return T.let(F.array_distinct(T.tokens(question)), lambda asked: F.get(F.array_sort(F.transform(pieces, lambda s, i: F.struct((-shared(s, asked)).alias("n"), i.alias("i"), s.alias("s")))), F.lit(0))["s"])


def synthesised(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, sent, text: a line for each of the best DRAWN chunks (qid, rnk, doc_id, text), marked by its place among those sent.
    sent are the ids of all chunks of the question, in order; chunks that say nothing give no line."""
    own = rows.join(questions.select("qid", F.col("text").alias("_q")), "qid")
    place = F.struct("rnk", F.col("doc_id").alias("doc_id"), F.when(F.col("rnk") <= DRAWN, best_sentence(F.col("_q"), F.coalesce("text", F.lit("")))).alias("said"))
    # a question's few chunks
    out = own.groupBy("qid").agg(F.sort_array(F.collect_list(place)).alias("_r"))
    lines = F.filter(F.transform("_r", lambda r, i: F.concat(r["said"], F.lit(" ["), (i + 1).cast("string"), F.lit("]"))), lambda x: x.isNotNull())
    return out.select("qid", F.transform("_r", lambda r: r["doc_id"]).alias("sent"), F.array_join(lines, "\n").alias("text"))


def presented(text: Column) -> Column:
    """Each line as an item of a list."""
    return F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")


def answered(questions: DataFrame, trace: DataFrame, rows: DataFrame, present=presented) -> DataFrame:
    """qid, status, answer, cited, invalid, guarded of every question: direct for simple ones, refused where correction refused,
    nothing was left or nothing could be cited, else the presented text, or the plain one where the guard finds that presenting
    changed a token or a citation (guarded false)."""
    said = synthesised(rows, questions).withColumn("_c", P.citations(F.col("text"), F.col("sent"))).withColumn("_p", present(F.col("text")))
    said = said.withColumn("_ok", X.guard(F.col("text"), F.col("_p"))["passed"])
    own = questions.select("qid").join(trace.select("qid", "route", "refused"), "qid").join(said.drop("sent"), "qid", "left")
    status = F.when(F.col("route") == "simple", "direct").when(F.col("refused") | F.coalesce(F.size("_c.cited") <= 0, F.lit(True)), "refused").otherwise("answered")
    own = own.withColumn("status", status)
    full = F.col("status") == "answered"
    return own.select(
        "qid", "status", F.when(F.col("status") == "direct", DIRECT).when(~full, REFUSAL).when(F.col("_ok"), F.col("_p")).otherwise(F.col("text")).alias("answer"),
        F.when(full, F.col("_c")["cited"]).otherwise(F.array().cast("array<bigint>")).alias("cited"), F.when(full, F.size(F.col("_c")["invalid"])).otherwise(0).alias("invalid"),
        F.when(full, F.col("_ok")).otherwise(True).alias("guarded"),
    )


def response(body: Column) -> Column:
    """struct<text, finish, prompt_tokens, completion_tokens, error> of a model's answer as JSON, in either of two shapes: choices
    with a usage block, or a message with counts of its own. An answer that is no such JSON, was cut off by its length or has no
    count of the prompt's tokens has an error and no text: it can be neither trusted nor costed."""
    v = F.try_parse_json(body)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    listed = at("$.choices", "variant").isNotNull()
    text = F.when(listed, at("$.choices[0].message.content", "string")).otherwise(at("$.message.content", "string"))
    finish = F.coalesce(F.when(listed, at("$.choices[0].finish_reason", "string")).otherwise(at("$.done_reason", "string")), F.lit(""))
    prompt = F.when(listed, at("$.usage.prompt_tokens", "bigint")).otherwise(at("$.prompt_eval_count", "bigint"))
    done = F.coalesce(F.when(listed, at("$.usage.completion_tokens", "bigint")).otherwise(at("$.eval_count", "bigint")), F.lit(0))
    error = F.when(text.isNull(), F.when(listed, "no choices").otherwise("no message")).when(finish == "length", "cut off").when(prompt.isNull(), "no usage")
    return T.let(F.struct(text.alias("t"), finish.alias("f"), prompt.alias("p"), done.alias("d"), error.alias("e")), lambda r: F.struct(
        F.when(r["e"].isNull(), r["t"]).alias("text"), r["f"].alias("finish"), F.when(r["e"].isNull(), r["p"]).alias("prompt_tokens"), F.when(r["e"].isNull(), r["d"]).alias("completion_tokens"), r["e"].alias("error"),
    ))


def judged(raw: Column) -> Column:
    """The four scores of a judge's JSON: numbers as they are, anything else null, all null where it can't be read."""
    v = F.try_parse_json(raw)
    number = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.coalesce(F.try_variant_get(v, f"$.{k}", "double"), F.try_variant_get(v, f"$.{k}", "boolean").cast("double")))
    return F.struct(*[number(k).alias(k) for k in SCORES])
