"""Registered queries of what models say: answers stand in JSON that documents and turns give rise to, the same in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import parsing as P
from tessera.plans.registry import query, table
from tessera.plans.sql import DIGITS, fold
from tessera.plans.texts import TURN, VARCHAR

ROUTED = """CASE doc_id % 9 WHEN 0 THEN '{"route": "simple", "in_scope": false}' WHEN 1 THEN '{"route": "simple", "in_scope": "no", "techniques": ["HyDE"]}' WHEN 2 THEN '{"route": "basic_rag", "techniques": "HyDE"}'
WHEN 3 THEN '{"route": "advanced_rag", "techniques": ["HyDE", "Magic", "CRAG", "HyDE"]}' WHEN 4 THEN '{"route": "fast", "techniques": ["CRAG"]}' WHEN 5 THEN 'no json' WHEN 6 THEN '{"techniques": []}' WHEN 7 THEN '{"route": "simple"}' ELSE concat('{"route": "', lang, '"}') END"""
LISTED = """CASE doc_id % 6 WHEN 0 THEN '{"queries": ["a", " ", "b c", "d", "e", "f"]}' WHEN 1 THEN '{"queries": "a"}' WHEN 2 THEN '{"queries": [1, "x"]}' WHEN 3 THEN '[1' WHEN 4 THEN '{}' ELSE concat('{"queries": ["', lang, '", "', source, '"]}') END"""
ASKED = """CASE doc_id % 6 WHEN 0 THEN '{"semantic_query": " q ", "filters": {"source": "src1", "page": 4, "issue_date_after": "2019"}}' WHEN 1 THEN '{"filters": {"source": "nowhere", "chunk_type": "en", "issue_date_before": "x1"}}' WHEN 2 THEN '{"semantic_query": 5, "filters": []}'
WHEN 3 THEN 'oops' WHEN 4 THEN '{"semantic_query": "", "filters": {"chunk_type": "de", "issue_date_before": 2024}}' ELSE concat('{"semantic_query": "', lang, '"}') END"""
JUDGED = """CASE doc_id % 5 WHEN 0 THEN '{"verdict": "correct", "entailed": true, "score": 0.5}' WHEN 1 THEN '{"verdict": "sure", "entailed": "no", "score": "0.25"}' WHEN 2 THEN 'broken' WHEN 3 THEN '{"verdict": "incorrect", "score": "n/a"}' ELSE '{"entailed": false}' END"""
SOURCES, TYPES = tuple(f"src{i}" for i in range(20)), ("en", "de", "fr", "es")
TECHNIQUES = "[" + ", ".join(f"'{t}'" for t in P.TECHNIQUES) + "]"


def _json(x: str) -> str:
    return f"CASE WHEN json_valid({x}) THEN {x} END"


def _strings(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{path}') = 'ARRAY' THEN list_transform(list_filter(CAST(json_extract({x}, '$.{path}') AS JSON[]), lambda v: json_type(v) = 'VARCHAR'), lambda v: v ->> '$') ELSE [] END"


TRUTH = "CASE WHEN {x} IS NULL THEN true ELSE lower(trim({x})) NOT IN ('false', 'no', '0', '') END"


@query(f"""SELECT doc_id, CASE WHEN known THEN j ->> '$.route' ELSE 'advanced_rag' END route, CASE WHEN known THEN array_to_string(list_filter(names, lambda t: list_contains({TECHNIQUES}, t)), ',') ELSE '' END requested,
CASE WHEN known THEN array_to_string(list_filter(names, lambda t: NOT list_contains({TECHNIQUES}, t)), ',') ELSE '' END dropped, CASE WHEN known AND j ->> '$.route' = 'simple' AND NOT ({TRUTH.format(x="(j ->> '$.in_scope')")}) THEN 'out_of_domain' END refusal
FROM (SELECT doc_id, j, coalesce(json_type(j, '$.route') = 'VARCHAR' AND (j ->> '$.route') IN ('simple', 'basic_rag', 'advanced_rag'), false) known, {_strings("j", "techniques")} names FROM (SELECT doc_id, {_json(ROUTED)} j FROM documents))""")
def router_parse(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", P.routed(F.expr(ROUTED)).alias("r"))
    return got.select("doc_id", "r.route", F.array_join("r.requested", ",").alias("requested"), F.array_join("r.dropped", ",").alias("dropped"), "r.refusal")


@query(f"""SELECT doc_id, array_to_string(l[1:3], '|') paraphrases, CASE WHEN len(l) = 0 THEN source ELSE array_to_string(l[1:4], '|') END sub_questions FROM (
SELECT doc_id, source, list_filter({_strings("j", "queries")}, lambda s: trim(s) != '') l FROM (SELECT doc_id, source, {_json(LISTED)} j FROM documents))""")
def parse_list_json(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(LISTED)
    return table(spark, d, "documents").select("doc_id", F.array_join(P.text_list(raw, "queries", 3), "|").alias("paraphrases"), F.array_join(P.text_list(raw, "queries", 4, F.col("source")), "|").alias("sub_questions"))


YEAR = "CASE WHEN regexp_matches(trim({x}), '^[0-9]+$') THEN trim({x})::INT END"
SELF = f"""p AS (SELECT doc_id, lang, source, doc_id % 7 page, 2015 + doc_id % 12 y, trim(CASE WHEN json_type(j, '$.semantic_query') = 'VARCHAR' AND trim(j ->> '$.semantic_query') != '' THEN j ->> '$.semantic_query' ELSE 'question ' || lang END) query,
CASE WHEN (j ->> '$.filters.source') IN {SOURCES} THEN j ->> '$.filters.source' END f_source, CASE WHEN (j ->> '$.filters.chunk_type') IN {TYPES} THEN j ->> '$.filters.chunk_type' END f_type,
{YEAR.format(x="(j ->> '$.filters.issue_date_before')")} f_before, {YEAR.format(x="(j ->> '$.filters.issue_date_after')")} f_after, {YEAR.format(x="(j ->> '$.filters.page')")} f_page FROM (SELECT *, {_json(ASKED)} j FROM documents))"""


@query(f"""WITH {SELF} SELECT doc_id, query, f_source source, f_type chunk_type, f_before "before", f_after "after", f_page page,
(f_source IS NULL OR source = f_source) AND (f_type IS NULL OR lang = f_type) AND (f_before IS NULL OR coalesce(y < f_before, false)) AND (f_after IS NULL OR coalesce(y > f_after, false)) AND (f_page IS NULL OR page = f_page) matches FROM p""")
def selfquery_parse(spark: SparkSession, d: str) -> DataFrame:
    """A question's filters, and whether its own document would pass them; the year is that of a date of issue."""
    docs = table(spark, d, "documents").withColumn("f", P.filters(F.expr(ASKED), F.concat(F.lit("question "), "lang"), SOURCES, TYPES))
    year = P.issue_year(F.concat(F.lit("03/"), (F.col("doc_id") % 12 + 2015).cast("string")))
    fits = P.matches(F.col("f"), F.col("source"), F.col("lang"), year, F.col("doc_id") % 7)
    return docs.select("doc_id", "f.*", fits.alias("matches"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'incorrect' WHEN (j ->> '$.verdict') IN ('correct', 'ambiguous', 'incorrect') THEN j ->> '$.verdict' ELSE 'ambiguous' END verdict,
CASE WHEN j IS NULL THEN false ELSE coalesce({TRUTH.format(x="(j ->> '$.entailed')")}, false) AND (j ->> '$.entailed') IS NOT NULL END entailed, round(TRY_CAST(j ->> '$.score' AS DOUBLE), 6) score FROM (SELECT doc_id, {_json(JUDGED)} j FROM documents)""")
def crag_parse(spark: SparkSession, d: str) -> DataFrame:
    """Grades, entailment and a judge's number; none can be read from a broken answer."""
    v = P.parsed(F.expr(JUDGED))
    entailed = P.field(v, "entailed").isNotNull() & P.as_bool(P.field(v, "entailed"))
    return table(spark, d, "documents").select("doc_id", P.grade(F.expr(JUDGED), F.when(F.col("doc_id") % 10 == 9, 0).otherwise(5)).alias("verdict"), entailed.alias("entailed"),
                                               F.round(P.field(v, "score").try_cast("double"), 6).alias("score"))


GREETED = "CASE WHEN turn % 5 = 0 THEN ' Thanks! ' WHEN turn % 5 = 1 THEN 'أهلا وسهلا' WHEN turn % 5 = 2 THEN concat(substr(text, 1, 6), '؟') WHEN turn % 5 = 3 THEN '  ' ELSE text END"


@query(f"""SELECT conv_id, turn, CASE WHEN b = '' THEN 'simple' WHEN k IN ({", ".join(f"'{g}'" for g in T.GREETINGS)}) THEN 'simple' WHEN regexp_matches(b, '[?؟]') THEN 'pass' WHEN len(regexp_extract_all(k, '[^\\s]+')) < 3 THEN 'simple' ELSE 'pass' END decision
FROM (SELECT *, lower(trim({fold("b")}, '{T.GATE_EDGES}')) k FROM (SELECT conv_id, turn, regexp_replace({GREETED}, '^\\s+|\\s+$', '', 'g') b FROM conversations))""")
def pre_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", P.pre_gate(F.expr(GREETED)).alias("decision"))


ALNUM = f"list_distinct(regexp_extract_all(translate({{x}}, {DIGITS}), '[A-Za-z0-9]+'))"
MARKS = "list_distinct(regexp_extract_all({x}, '\\[([0-9]+)\\]', 1))"
LACKS = "list_sort(list_filter({a}, lambda v: NOT list_contains({b}, v)))"
PAIRS = f"(SELECT conv_id, turn, x, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) p FROM (SELECT conv_id, turn, {VARCHAR} x FROM conversations))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(TURN).alias("x"))
    return rows.withColumn("p", F.lag("x").over(w)).filter("p is not null")


def _guarded(spark: SparkSession, d: str, refusal: bool) -> DataFrame:
    got = _pairs(spark, d).select("conv_id", "turn", P.guard(F.col("p"), F.col("x"), refusal).alias("g"))
    return got.select("conv_id", "turn", F.array_join("g.tokens", ",").alias("tokens"), F.array_join("g.citations", ",").alias("citations"), "g.passed")


def _guard_sql(citations: str) -> str:
    return f"""SELECT conv_id, turn, array_to_string(t, ',') tokens, array_to_string(c, ',') citations, len(t) = 0 AND len(c) = 0 passed FROM (
SELECT conv_id, turn, {LACKS.format(a=ALNUM.format(x="x"), b=ALNUM.format(x="p"))} t, {citations} c FROM {PAIRS} WHERE p IS NOT NULL)"""


@query(_guard_sql(LACKS.format(a=MARKS.format(x="x"), b=MARKS.format(x="p"))))
def guard_diff(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and markers of a turn that the one before lacks."""
    return _guarded(spark, d, False)


@query(_guard_sql(f"list_sort({MARKS.format(x='x')})"))
def guard_refusal(spark: SparkSession, d: str) -> DataFrame:
    return _guarded(spark, d, True)


@query(f"""SELECT conv_id, turn, seg segment, array_to_string(w, ',') words FROM (SELECT conv_id, turn, seg, {LACKS.format(a="list_distinct(regexp_extract_all(seg, '[ء-ي]+'))", b="list_distinct(regexp_extract_all(p, '[ء-ي]+'))")} w FROM (
SELECT conv_id, turn, p, regexp_replace(unnest(regexp_split_to_array(x, '[.!؟،؛\\n]+')), '^\\s+|\\s+$', '', 'g') seg FROM {PAIRS} WHERE p IS NOT NULL) WHERE seg != '') WHERE len(w) > 0""")
def guard_drift(spark: SparkSession, d: str) -> DataFrame:
    got = _pairs(spark, d).select("conv_id", "turn", F.explode(P.drift(F.col("p"), F.col("x"))).alias("s"))
    return got.select("conv_id", "turn", "s.segment", F.array_join("s.words", ",").alias("words"))


ANSWER = ("CASE doc_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'grounded' WHEN 2 THEN 'refused' ELSE lang END", "CASE WHEN doc_id % 3 = 0 THEN 'out_of_domain' END", "doc_id % 2")


@query(f"""SELECT doc_id, k IN ('direct', 'grounded', 'refused') AND (k = 'refused') = (r IS NOT NULL) AND (k = 'grounded' OR n = 0) sound, regexp_matches(lower(m), '{"|".join(P.MEMORY_ERRORS)}') memory FROM (
SELECT doc_id, {ANSWER[0]} k, {ANSWER[1]} r, {ANSWER[2]} n, CASE WHEN doc_id % 5 = 0 THEN 'CUDA Out of Memory' ELSE lang END m FROM documents)""")
def answer_invariants(spark: SparkSession, d: str) -> DataFrame:
    kind, refusal, n = map(F.expr, ANSWER)
    message = F.when(F.col("doc_id") % 5 == 0, "CUDA Out of Memory").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", P.sound_answer(kind, refusal, n).alias("sound"), P.memory_error(message).alias("memory"))
