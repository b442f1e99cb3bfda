"""Registered queries of techniques on deterministic stand-ins. Passages of the benchmark stand for questions; routes and requests follow from their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import parsing as X
from tessera.operators import retrieval as R
from tessera.operators import techniques as Q
from tessera.plans import catalog
from tessera.plans.registry import query, stored, table
from tessera.plans.sql import TOK, tokens_sql

NAMES = "[" + ", ".join(f"'{t}'" for t in X.TECHNIQUES) + "]"
ROUTE = "CASE item_id % 5 WHEN 0 THEN 'simple' WHEN 1 THEN 'basic_rag' ELSE 'advanced_rag' END"
ASKED = "CASE item_id % 7 WHEN 0 THEN {o}'HyDE', 'CRAG', 'Magic'{c} WHEN 1 THEN {o}'Multi-Query', 'HyDE', 'Compression'{c} WHEN 2 THEN {o}'Decomposition', 'Multi-Query'{c} WHEN 3 THEN {o}'CRAG', 'Rewriting'{c} WHEN 4 THEN NULL WHEN 5 THEN {o}'Compression', 'CRAG'{c} ELSE {o}'Self-Query'{c} END"
FORCED = "CASE WHEN item_id % 11 = 3 THEN {o}'CRAG', 'Compression'{c} WHEN item_id % 11 = 5 THEN {o}'HyDE'{c} END"
#: Every third question is asked so that little of it stands anywhere.
TEXT = "CASE item_id % 3 WHEN 0 THEN \"text\" WHEN 1 THEN concat('zzq1 zzq2 zzq3 zzq4 zzq5 ', substr(\"text\", 1, 40)) ELSE concat('zzq1 zzq2 zzq3 zzq4 ', substr(\"text\", 1, 12)) END"
SQL = lambda s: s.replace("{o}", "[").replace("{c}", "]")
SPARK = lambda s: s.replace("{o}", "array(").replace("{c}", ")").replace('"text"', "text")
SET = f"""CASE WHEN forced IS NOT NULL THEN list_filter({NAMES}, lambda t: list_contains(forced, t)) WHEN route = 'advanced_rag' THEN list_filter({NAMES}, lambda t: t = 'Reranking' OR list_contains(asked, t)) ELSE [] END"""
BASE = f"""b AS (SELECT item_id, "text" said, {TEXT} "text", {ROUTE} route, coalesce({SQL(ASKED)}, []) asked, {SQL(FORCED)} forced FROM benchmark), s AS (SELECT *, {SET}::VARCHAR[] techniques FROM b),
sg AS (SELECT *, CASE WHEN list_contains(techniques, 'Decomposition') THEN 'Decomposition' WHEN list_contains(techniques, 'Multi-Query') THEN 'Multi-Query' WHEN list_contains(techniques, 'HyDE') THEN 'HyDE' END strategy FROM s)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    own = b.select("item_id", F.expr(SPARK(TEXT)).alias("text"), F.col("text").alias("said"), F.expr(ROUTE).alias("route"), F.expr(SPARK(ASKED)).alias("asked"), F.expr(SPARK(FORCED)).alias("forced"))
    return own.select(F.col("item_id").alias("qid"), "text", "said", "route", Q.resolved(F.col("route"), F.col("asked"), F.col("forced")).alias("techniques"))


@query(f"WITH {BASE} SELECT item_id qid, route, techniques, strategy FROM sg")
def resolve_techniques(spark: SparkSession, d: str) -> DataFrame:
    """What each question runs, and how it retrieves."""
    return questions(spark, d).select("qid", "route", "techniques", Q.strategy(F.col("techniques")).alias("strategy"))


# -- stand-ins, in both dialects ------------------------------------------------


def words(text: Column) -> Column:
    return F.split(text, " ")


def rephrase(text: Column) -> Column:
    """The second half of the words."""
    return T.let(words(text), lambda w: F.array_join(F.slice(w, (F.floor(F.size(w) / 2) + 1).cast("int"), F.size(w)), " "))


def halves(text: Column) -> Column:
    half = lambda w: F.floor((F.size(w) + 1) / 2).cast("int")
    return T.let(words(text), lambda w: F.array(F.array_join(F.slice(w, F.lit(1), half(w)), " "), F.array_join(F.slice(w, half(w) + 1, F.size(w)), " ")))


def paraphrases(text: Column) -> Column:
    return F.concat(F.array(text), halves(text))


def hypothetical(text: Column) -> Column:
    return F.concat(text, F.lit(" "), F.get(words(text), F.lit(0)))


def extract(question: Column, text: Column) -> Column:
    """The first sentence that shares a token with the question."""
    asked = T.tokens(question)
    return F.coalesce(F.get(F.filter(F.split(text, r"\."), lambda s: F.arrays_overlap(T.tokens(s), asked)), F.lit(0)), F.lit("NONE"))


W, HALF = "string_split({x}, ' ')", "((len(string_split({x}, ' ')) + 1) // 2)"
REPHRASED = lambda x: f"array_to_string({W.format(x=x)}[len({W.format(x=x)}) // 2 + 1:], ' ')"
REQUERY = lambda x: f"CASE WHEN trim({REPHRASED(x)}) != '' THEN trim({REPHRASED(x)}) ELSE {x} END"
_HALVES = "[array_to_string({w}[:{h}], ' '), array_to_string({w}[{h} + 1:], ' ')]".format(w=W.format(x='"text"'), h=HALF.format(x='"text"'))
VARIANTS = f"""CASE strategy WHEN 'Decomposition' THEN {_HALVES} WHEN 'Multi-Query' THEN ["text"] || {_HALVES} WHEN 'HyDE' THEN ["text" || ' ' || {W.format(x='"text"')}[1]] ELSE ["text"] END"""
INDEX = f"""tf AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({TOK}) term FROM documents) GROUP BY 1, 2), len AS (SELECT doc_id, len({TOK}) len FROM documents), nst AS (SELECT count(*) n, avg(len::DOUBLE) avgdl FROM len), df AS (SELECT term, count(*) df FROM tf GROUP BY 1)"""


def ranked_sql(source: str, out: str, k: int) -> str:
    """Named steps: the k best documents of every (item_id, text) of source."""
    return f"""{out}q AS (SELECT item_id, term, count(*) qtf FROM (SELECT item_id, unnest({TOK}) term FROM {source}) GROUP BY 1, 2),
{out}s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) * qtf), 6) score FROM {out}q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id), nst GROUP BY 1, 2),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT rnk FROM (SELECT b.item_id, d.doc_id, coalesce(s.score, 0) score FROM {source} b CROSS JOIN documents d LEFT JOIN {out}s s ON s.item_id = b.item_id AND s.doc_id = d.doc_id)) WHERE rnk <= {k})"""


def _share(q: str, t: str) -> str:
    a = f"list_distinct({tokens_sql(q)})"
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE round(len(list_intersect({a}, {tokens_sql(t)})) / len({a})::DOUBLE, 6) END"


def _verdict(q: str, t: str) -> str:
    return f"CASE WHEN {t} IS NULL THEN 'incorrect' WHEN {_share(q, t)} >= 0.5 THEN 'correct' WHEN {_share(q, t)} >= 0.2 THEN 'ambiguous' ELSE 'incorrect' END"


def crag_sql(source: str, ranked: str) -> str:
    """Named steps ct (trace) and cr (rankings that stay) of questions source (item_id, text) and their rankings."""
    return f"""cg AS (SELECT q.item_id, q."text", {_verdict('q."text"', 'd."text"')} verdict FROM {source} q LEFT JOIN {ranked} r ON r.item_id = q.item_id AND r.rnk = 1 LEFT JOIN documents d ON d.doc_id = r.doc_id),
cq AS (SELECT item_id, {REQUERY('"text"')} "text" FROM cg WHERE verdict != 'correct'), {ranked_sql("cq", "cx", Q.NARROW)},
cv AS (SELECT q.item_id, q."text", {_verdict('q."text"', 'd."text"')} verdict FROM cq q LEFT JOIN cx r ON r.item_id = q.item_id AND r.rnk = 1 LEFT JOIN documents d ON d.doc_id = r.doc_id),
ct AS (SELECT cg.item_id qid, cg.verdict, coalesce(cv."text", '') requery_text, coalesce(cv.verdict, '') requery_verdict, cv.verdict IS NOT NULL requeried, coalesce(cv.verdict, cg.verdict) != 'correct' refused FROM cg LEFT JOIN cv USING (item_id)),
cr AS (SELECT r.* FROM {ranked} r JOIN cg USING (item_id) WHERE verdict = 'correct' UNION ALL SELECT cx.* FROM cx JOIN cv USING (item_id) WHERE verdict = 'correct')"""


def retriever(spark: SparkSession, d: str) -> Q.Retriever:
    index = catalog.lexical(spark, d)
    return lambda asked, k: R.bm25(index, asked, "qid", k)


def _keep(df: DataFrame) -> DataFrame:
    return stored(df, "technique")


@query(f"""WITH {BASE}, {INDEX}, {ranked_sql("b", "rk", Q.NARROW)}, {crag_sql("b", "rk")}, f AS (SELECT item_id qid, count(*) n, sum(doc_id)::BIGINT docs FROM cr GROUP BY 1)
SELECT ct.*, coalesce(n, 0) n, docs FROM ct LEFT JOIN f USING (qid)""")
def crag(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts, the round of correction, and how much is left of each question's ranking."""
    own, retrieve, docs = _keep(questions(spark, d).select("qid", "text")), retriever(spark, d), table(spark, d, "documents")
    ranked, trace = Q.crag(own, _keep(retrieve(own, Q.NARROW)), docs, retrieve, rephrase, keep=_keep)
    left = ranked.groupBy("qid").agg(F.count("*").alias("n"), F.sum("doc_id").alias("docs"))
    return trace.join(left, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_EXTRACT = f"""coalesce(list_filter(string_split(t, '.'), lambda s: len(list_intersect({tokens_sql("s")}, {tokens_sql("q")})) > 0)[1], 'NONE')"""
_A, _B = f"list_distinct({tokens_sql('q')})", f"list_distinct({tokens_sql('t')})"
JACCARD = f"CASE WHEN len({_A}) + len({_B}) = 0 THEN 0.0 ELSE round(len(list_intersect({_A}, {_B})) / (len({_A}) + len({_B}) - len(list_intersect({_A}, {_B})))::DOUBLE, 6) END"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_WORDS = f"regexp_replace(trim({{x}}, {_BLANKS}), '\\s+', ' ', 'g')"
PIPELINE = f"""{BASE}, {INDEX}, a AS (SELECT item_id, CASE WHEN list_contains(techniques, 'Rewriting') THEN said || ' ' || "text" ELSE "text" END "text", techniques, strategy FROM sg WHERE route != 'simple'),
v AS (SELECT item_id * 8 + n - 1 item_id, "text" FROM (SELECT item_id, unnest(l) "text", generate_subscripts(l, 1) n FROM (SELECT item_id, {VARIANTS} l FROM a))), {ranked_sql("v", "vr", Q.WIDE)},
vf AS (SELECT item_id // 8 qid, item_id % 8 sub, doc_id, rnk, score, min(item_id) OVER w = max(item_id) OVER w one FROM vr WINDOW w AS (PARTITION BY item_id // 8)),
fu AS (SELECT qid, doc_id, rnk FROM vf WHERE one UNION ALL SELECT qid, doc_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id)::INT rnk FROM (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rnk)), 8) s FROM vf WHERE NOT one GROUP BY 1, 2)) WHERE rnk <= {Q.WIDE}),
rj AS (SELECT fu.*, a."text" q, d."text" t, list_contains(techniques, 'Reranking') rr FROM fu JOIN a ON item_id = qid JOIN documents d USING (doc_id)),
rk AS (SELECT qid item_id, doc_id, rnk FROM rj WHERE NOT rr AND rnk <= {Q.NARROW} UNION ALL SELECT qid, doc_id, r FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY {JACCARD} DESC, rnk)::INT r FROM rj WHERE rr) WHERE r <= {Q.NARROW}),
ca AS (SELECT * FROM a WHERE list_contains(techniques, 'CRAG')), ck AS (SELECT rk.item_id, doc_id, 0::DOUBLE score, rnk FROM rk JOIN ca USING (item_id)), {crag_sql("ca", "ck")},
al AS (SELECT item_id, doc_id, rnk FROM rk ANTI JOIN ca USING (item_id) UNION ALL SELECT item_id, doc_id, rnk FROM cr),
at_ AS (SELECT al.*, techniques, a."text" q, d."text" t FROM al JOIN a USING (item_id) JOIN documents d USING (doc_id)), ex AS (SELECT *, CASE WHEN list_contains(techniques, 'Compression') THEN trim(trim(trim(trim({_EXTRACT}, {_BLANKS}), '"'), '“”'), {_BLANKS}) END e FROM at_),
an AS (SELECT item_id qid, rnk, doc_id, CASE WHEN e IS NOT NULL AND {_WORDS.format(x="e")} != '' AND upper(e) != 'NONE' AND contains({_WORDS.format(x="t")}, {_WORDS.format(x="e")}) THEN e ELSE t END "text" FROM ex)"""


def run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = questions(spark, d)
    rewrite = F.concat("said", F.lit(" "), "text")
    docs = table(spark, d, "documents").select("doc_id", "text")
    return Q.pipeline(own, docs, retriever(spark, d), rewrite, halves, paraphrases, hypothetical, rephrase, extract, keep=_keep)


@query(f"WITH {PIPELINE} SELECT qid, rnk, doc_id, md5(\"text\") digest, length(\"text\")::INT n_chars FROM an")
def technique_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """What every question's answer would rest on after all techniques that it runs."""
    answers, _ = run(spark, d)
    return answers.select("qid", "rnk", "doc_id", F.md5("text").alias("digest"), F.char_length("text").alias("n_chars"))


@query(f"""WITH {PIPELINE} SELECT sg.item_id qid, route, CASE WHEN route = 'simple' THEN []::VARCHAR[] ELSE list_filter(techniques, lambda t: t NOT IN ('Decomposition', 'Multi-Query', 'HyDE') OR t = strategy) END executed, coalesce(refused, false) refused FROM sg LEFT JOIN ct ON ct.qid = sg.item_id""")
def technique_trace(spark: SparkSession, d: str) -> DataFrame:
    """Which techniques each question ran, and whether correction refused it."""
    return run(spark, d)[1]
