"""Registered queries of claims and extracts, over conversations: a turn stands for a chunk, the turns of the assistant for answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import entailment as N
from tessera.plans.registry import query, table
from tessera.plans.sql import DIGITS, tokens_sql

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
#: A conversation as a question: what is said in it is its gold, what the assistant said its answer; every seventh has no gold.
QUESTIONS = """SELECT conv_id qid, CASE WHEN conv_id % 7 = 3 THEN '' ELSE string_agg("text", chr(10) ORDER BY turn) END premise, coalesce(string_agg("text", '. ' ORDER BY turn) FILTER (role = 'assistant'), '') answer FROM conversations GROUP BY 1"""
SENTENCES = r"""list_filter(list_transform(regexp_split_to_array({x}, '[.!؟]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: len(string_split(s, ' ')) >= 3)"""
FIRST = "regexp_extract(f, '[0-9]+')"
MUTATED = f"CASE WHEN {FIRST} != '' THEN substr(f, 1, instr(f, {FIRST}) - 1) || CAST(CAST({FIRST} AS HUGEINT) + 37 AS VARCHAR) || substr(f, instr(f, {FIRST}) + length({FIRST})) END"
CASES = f"""q AS ({QUESTIONS}), i AS (SELECT *, row_number() OVER (ORDER BY qid) - 1 i, count(*) OVER () n FROM q),
o AS (SELECT a.qid, a.premise, a.answer, b.premise other, b.qid oid FROM i a JOIN i b ON b.i = (a.i + a.n // 2) % a.n WHERE a.premise != ''),
s AS (SELECT qid, premise, other, oid, unnest(ss) s, generate_subscripts(ss, 1) - 1 nth FROM (SELECT *, {SENTENCES.format(x="answer")} ss FROM o)), m AS (SELECT *, translate(s, {DIGITS}) f FROM s),
c AS (SELECT qid question_id, 'positive' kind, nth::INT nth, premise, s hypothesis, true AS label FROM m UNION ALL SELECT qid, 'negative_topic', nth::INT, other, s, false FROM m WHERE other != '' AND oid != qid
UNION ALL SELECT qid, 'negative_number', nth::INT, premise, {MUTATED}, false FROM m WHERE {FIRST} != '')"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    joined = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"]), by)
    said = F.struct("turn", "text")
    out = turns.groupBy(F.col("conv_id").alias("qid")).agg(joined(said, "\n").alias("premise"), joined(F.when(F.col("role") == "assistant", said), ". ").alias("answer"))
    return out.withColumn("premise", F.when(F.col("qid") % 7 == 3, "").otherwise(F.col("premise")))


@query(f"WITH {CASES} SELECT * FROM c")
def entail_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with their own gold, that of another question, and a changed number."""
    return N.benchmark(questions(spark, d))


def _scored(premise: str, claim: str) -> str:
    """The score in SQL."""
    t, p = f"list_distinct({tokens_sql(claim)})", f"list_distinct({tokens_sql(premise)})"
    digits = lambda x: f"list_distinct(regexp_extract_all(translate({x}, {DIGITS}), '[0-9]+'))"
    lost = f"len(list_filter({digits(claim)}, lambda x: NOT list_contains({digits(premise)}, x)))"
    return f"CASE WHEN {lost} > 0 THEN 0.0 WHEN len({t}) = 0 THEN 0.0 ELSE round(len(list_intersect({t}, {p})) / len({t})::DOUBLE, 6) END::DOUBLE"


@query(f"WITH {CASES} SELECT question_id, kind, nth, {_scored('premise', 'hypothesis')} score, label FROM c")
def nli_containment(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in's score of every case."""
    score = N.contained_share(F.col("premise"), F.col("hypothesis")).alias("score")
    return N.benchmark(questions(spark, d)).select("question_id", "kind", "nth", score, "label")


#: An answer cites turns by number, itself and the one before; turns above 5 are no marker, and every fourth chunk is unknown.
CITES = """SELECT conv_id answer_id, string_agg(rtrim("text", '.') || ' [' || turn || ']' || CASE WHEN turn % 3 = 1 THEN ' [' || (turn - 1) || '] [' || turn || '] [09]' ELSE '' END, '. ' ORDER BY turn) "text" FROM conversations GROUP BY 1"""
PAIRS = f"""a AS ({CITES}), s AS (SELECT answer_id, nth, trim(x, {BLANKS}) s FROM (SELECT answer_id, unnest(l) x, generate_subscripts(l, 1) - 1 nth FROM (SELECT answer_id, regexp_split_to_array("text", '[.!؟]+') l FROM a)) WHERE trim(x, {BLANKS}) != ''),
m AS (SELECT answer_id, nth, unnest(l) m, generate_subscripts(l, 1) place FROM (SELECT *, regexp_extract_all(s, '\\[([0-9]+)\\]', 1) l FROM s)),
f AS (SELECT m.answer_id, nth, turn, min(place) place, any_value("text") t FROM m JOIN conversations c ON c.conv_id = m.answer_id AND CAST(c.turn AS VARCHAR) = m.m WHERE turn <= 5 AND (conv_id + turn) % 4 != 3 GROUP BY ALL),
p AS (SELECT answer_id, nth, string_agg(t, chr(10) ORDER BY place) premise FROM f GROUP BY ALL), pairs AS (SELECT * FROM (SELECT answer_id, nth::INT nth, premise, trim(regexp_replace(s, '\\[[0-9]+\\]', '', 'g'), {BLANKS}) hypothesis FROM s JOIN p USING (answer_id, nth)) WHERE premise != '' AND hypothesis != '')"""


def cited(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    more = F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" ["), (F.col("turn") - 1).cast("string"), F.lit("] ["), turn, F.lit("] [09]"))).otherwise("")
    said = F.struct("turn", F.concat(F.rtrim("text", F.lit(".")), F.lit(" ["), turn, F.lit("]"), more).alias("t"))
    answers = turns.groupBy(F.col("conv_id").alias("answer_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["t"]), ". ").alias("text"))
    chunk = F.concat_ws(":", "conv_id", "turn").alias("chunk_id")
    markers = turns.where("turn <= 5").select(F.col("conv_id").alias("answer_id"), F.col("turn").cast("int").alias("marker"), chunk)
    return N.premise_pairs(answers, markers, turns.where("(conv_id + turn) % 4 != 3").select(chunk, "text"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def premise_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with the chunks they cite."""
    return cited(spark, d)


@query(f"""WITH {PAIRS}, g AS (SELECT *, {_scored("premise", "hypothesis")} >= 0.75::DOUBLE ok FROM pairs)
SELECT answer_id, count(*) checked, count(*) FILTER (ok) entailed, coalesce(list(hypothesis ORDER BY nth) FILTER (NOT ok), []) failed_sentences FROM g GROUP BY 1""")
def entail_summary(spark: SparkSession, d: str) -> DataFrame:
    """What each answer's citing sentences came to."""
    return N.summary(cited(spark, d), N.contained_share(F.col("premise"), F.col("hypothesis")), 0.75)


#: What a model may give back for a turn: part of it, the part in marks and on other lines, nothing, that there is none, or other words.
EXTRACT = r"""CASE (conv_id + turn) % 6 WHEN 0 THEN substr("text", 3, 40) WHEN 1 THEN concat(' "', replace(substr("text", 1, 30), ' ', chr(10)), '" ') WHEN 2 THEN '' WHEN 3 THEN ' none ' WHEN 4 THEN concat(substr("text", 1, 20), ' and more') ELSE concat('“', "text", '”') END"""
WORDS = f"regexp_replace(trim({{x}}, {BLANKS}), '\\s+', ' ', 'g')"
KEPT = f"""e AS (SELECT *, trim(trim(trim(trim({EXTRACT}, {BLANKS}), '"'), '“”'), {BLANKS}) e FROM conversations), v AS (SELECT *, {WORDS.format(x="e")} != '' AND upper(e) != 'NONE' AND contains({WORDS.format(x='"text"')}, {WORDS.format(x="e")}) rewritten FROM e),
k AS (SELECT *, CASE WHEN rewritten THEN e ELSE "text" END kept FROM v)"""


def extracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("kept", N.verified(F.col("text"), F.expr(EXTRACT.replace('"text"', "text"))))


@query(f"WITH {KEPT} SELECT conv_id, turn, kept, rewritten FROM k")
def compress_verify(spark: SparkSession, d: str) -> DataFrame:
    """Extracts that stand in their turn, and whole turns for the others."""
    return extracts(spark, d).select("conv_id", "turn", F.col("kept")["text"].alias("kept"), F.col("kept")["rewritten"].alias("rewritten"))


@query(f"""WITH {KEPT} SELECT conv_id, sum(length("text"))::BIGINT chars_before, sum(length(kept))::BIGINT chars_after, count(*) FILTER (rewritten) rewritten, count(*) FILTER (NOT rewritten) kept_whole,
trunc((sum(length("text")) - sum(length(kept))) / 2.5::DOUBLE)::BIGINT tokens_removed FROM k GROUP BY 1""")
def compress_trace(spark: SparkSession, d: str) -> DataFrame:
    """What compression took off each conversation."""
    return N.compress_trace(extracts(spark, d), "conv_id")
