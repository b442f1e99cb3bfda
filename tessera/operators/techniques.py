"""Techniques around a ranking, for many questions at once: which run, one way of retrieving for each question, reranking, and
corrective rounds in which settled questions leave.

A retriever takes questions (qid, text) and k and returns qid, doc_id, score, rnk: one call ranks the texts of all questions that
need it. What a model would write (a rephrased question, a hypothetical passage, sub-questions, a verdict) comes from Column
functions that callers give; the stand-ins here are deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entailment as N
from tessera.operators import parsing as X
from tessera.operators import retrieval as R

#: Candidates for a reranker, results, rounds of correction, and the order in which ways of retrieving are preferred.
WIDE, NARROW, REQUERIES = 20, 10, 1
STRATEGIES = ("Decomposition", "Multi-Query", "HyDE")
Retriever = Callable[[DataFrame, int], DataFrame]


def resolved(route: Column, requested: Column, override: Column | None = None, reranking: bool = True) -> Column:
    """Techniques that a question runs, in their one order: an override as it is, else none off the widest route, else those
    requested and, where that is the default, reranking. Unknown names count for nothing."""
    known = lambda names: F.filter(F.array(*map(F.lit, X.TECHNIQUES)), lambda t: F.array_contains(names, t))
    asked = F.coalesce(requested, F.array().cast("array<string>"))
    wide = F.array_append(asked, F.lit("Reranking")) if reranking else asked
    usual = F.when(route == "advanced_rag", known(wide)).otherwise(F.array().cast("array<string>"))
    return usual if override is None else F.when(override.isNotNull(), known(override)).otherwise(usual)


def strategy(techniques: Column) -> Column:
    """The first way of retrieving, in order of preference, among techniques; null for the plain one."""
    return F.coalesce(*[F.when(F.array_contains(techniques, s), s) for s in STRATEGIES])


def low_confidence(score: Column, absolute: Column, threshold: float) -> Column:
    """Whether a best score is known to be low: fused ones say nothing, none at all does."""
    return F.when(score.isNull(), True).otherwise(F.coalesce(absolute, F.lit(False)) & (score < threshold))


def covered(question: Column, text: Column) -> Column:
    """The share of a question's tokens that a text has."""
    asked = F.array_distinct(T.tokens(question))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(asked, T.tokens(text))) / F.size(asked), 6))


def verdict(question: Column, best: Column) -> Column:
    """Stands in for a grader: by the share of the question that the best text covers; without a text, incorrect."""
    share = F.coalesce(covered(question, best), F.lit(0.0))
    return F.when(share >= 0.5, "correct").when(share >= 0.2, "ambiguous").otherwise("incorrect")


def likeness(question: Column, text: Column) -> Column:
    """Stands in for a cross-encoder: Jaccard of the tokens."""
    a, b = F.array_distinct(T.tokens(question)), F.array_distinct(T.tokens(F.coalesce(text, F.lit(""))))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 6))


def reranked(ranked: DataFrame, questions: DataFrame, docs: DataFrame, score: Callable[[Column, Column], Column] = likeness, k: int = NARROW) -> DataFrame:
    """The k best of each question's candidates by score(question, text), ties by their rank before; prior is that rank."""
    own = ranked.select("qid", "doc_id", F.col("rnk").alias("prior")).join(questions.select("qid", F.col("text").alias("_q")), "qid").join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    return R.top(own.select("qid", "doc_id", "prior", score(F.col("_q"), F.col("_t")).alias("score")), "qid", "score", "prior", k)


def crag(questions: DataFrame, ranked: DataFrame, docs: DataFrame, retrieve: Retriever, rephrase: Callable[[Column], Column], grade: Callable[[Column, Column], Column] = verdict,
         requeries: int = REQUERIES, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(ranked, trace): the rankings of questions whose best text is graded correct, at once or after `requeries` rounds.

    Each round rephrases the questions that are left, ranks them anew in one call, whatever restricted the first ranking, and grades
    them; those that turn out correct leave with that ranking. What is left at the end is refused: it keeps no rows. The trace
    has a row a question: verdict of the first round, requeried, requery_text, requery_verdict, refused. keep() may store what a
    round leaves, so that later rounds do not plan it again."""

    def graded(asked: DataFrame, found: DataFrame) -> DataFrame:
        best = found.where("rnk = 1").join(docs.select("doc_id", F.col("text").alias("_best")), "doc_id").select("qid", "_best")
        return asked.join(best, "qid", "left").withColumn("verdict", grade(F.col("text"), F.col("_best"))).drop("_best")

    first = keep(graded(questions.select("qid", "text"), ranked))
    settled = ranked.join(first.where("verdict = 'correct'").select("qid"), "qid", "left_semi")
    trace = first.select("qid", "verdict", F.lit("").alias("requery_text"), F.lit("").alias("requery_verdict"))
    left = first.where("verdict != 'correct'")
    for _ in range(requeries):
        said = rephrase(F.col("text"))
        left = left.select("qid", F.when(F.trim(said) != "", F.trim(said)).otherwise(F.col("text")).alias("text"))
        found = keep(retrieve(left, NARROW))
        now = keep(graded(left, found))
        settled = settled.unionByName(found.join(now.where("verdict = 'correct'").select("qid"), "qid", "left_semi").select(settled.columns))
        told = now.select("qid", F.col("text").alias("_text"), F.col("verdict").alias("_verdict"))
        trace = trace.join(told, "qid", "left").select("qid", "verdict", F.coalesce("_text", "requery_text").alias("requery_text"), F.coalesce("_verdict", "requery_verdict").alias("requery_verdict"))
        left = now.where("verdict != 'correct'")
    asked = F.col("requery_verdict") != ""
    last = F.when(asked, F.col("requery_verdict")).otherwise(F.col("verdict"))
    return settled, trace.withColumn("requeried", asked).withColumn("refused", last != "correct")


def variants(asked: DataFrame, sub_questions: Callable[[Column], Column], paraphrases: Callable[[Column], Column], hypothetical: Callable[[Column], Column]) -> DataFrame:
    """qid, nth, text: what is ranked for each question (qid, text, strategy): its parts, its paraphrases, a passage, or itself."""
    text = F.col("text")
    said = F.when(F.col("strategy") == "Decomposition", sub_questions(text)).when(F.col("strategy") == "Multi-Query", paraphrases(text)).when(F.col("strategy") == "HyDE", F.array(hypothetical(text))).otherwise(F.array(text))
    return asked.select("qid", F.posexplode(said).alias("nth", "text"))


def pipeline(questions: DataFrame, docs: DataFrame, retrieve: Retriever, rewrite: Column, sub_questions, paraphrases, hypothetical, rephrase, extract: Callable[[Column, Column], Column],
             most: int = 8, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(answers, trace) of questions (qid, text, route, techniques and what rewrite names): qid, rnk, doc_id, text of what an answer would rest on.

    Simple questions retrieve nothing. Rewriting comes first; then all texts that any question's way of retrieving asks for are
    ranked in one call, questions with several fused by rank; then reranking from twenty candidates, verified extracts, and
    correction. A question has at most `most` texts. trace: qid, executed, refused."""
    has = lambda t: F.array_contains("techniques", t)
    asked = questions.where("route != 'simple'").withColumn("text", F.when(has("Rewriting"), rewrite).otherwise(F.col("text"))).withColumn("strategy", strategy(F.col("techniques")))
    asked = keep(asked.select("qid", "text", "techniques", "strategy"))
    # one call for all texts: a text's key is its question's and its place
    texts = variants(asked, sub_questions, paraphrases, hypothetical).where(F.col("nth") < most)
    found = retrieve(texts.select((F.col("qid") * most + F.col("nth")).alias("qid"), "text"), WIDE)
    # read several times by the fusion: stored, or each reading would rank anew
    found = keep(found.select(F.expr(f"qid div {most}").alias("qid"), (F.col("qid") % most).alias("sub"), "doc_id", "rnk", "score"))
    fused = keep(R.fuse_queries(found, "qid", "sub", WIDE).select("qid", "doc_id", "rnk", "score"))
    reranks = asked.where(has("Reranking"))
    best = reranked(fused.join(reranks.select("qid"), "qid", "left_semi"), reranks, docs)
    plain = fused.join(reranks.select("qid"), "qid", "left_anti").where(F.col("rnk") <= NARROW)
    ranked = keep(plain.unionByName(best.select("qid", "doc_id", "rnk", "score")))
    corrects = asked.where(has("CRAG"))
    mended, told = crag(corrects, ranked.join(corrects.select("qid"), "qid", "left_semi"), docs, retrieve, rephrase, keep=keep)
    rest = ranked.join(corrects.select("qid"), "qid", "left_anti")
    rows = rest.unionByName(mended.select(rest.columns)).join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").join(asked.select("qid", "techniques", F.col("text").alias("_q")), "qid")
    kept = N.verified(F.coalesce("_t", F.lit("")), extract(F.col("_q"), F.coalesce("_t", F.lit(""))))["text"]
    answers = rows.select("qid", "rnk", "doc_id", F.when(has("Compression"), kept).otherwise(F.col("_t")).alias("text"))
    # of several ways of retrieving only the preferred one ran
    ran = F.filter("techniques", lambda t: ~t.isin(*STRATEGIES) | (t == F.col("strategy")))
    trace = questions.select("qid", "route").join(asked.select("qid", "techniques", "strategy"), "qid", "left").join(told.select("qid", "refused"), "qid", "left")
    return answers, trace.select("qid", "route", F.coalesce(ran, F.array().cast("array<string>")).alias("executed"), F.coalesce("refused", F.lit(False)).alias("refused"))
