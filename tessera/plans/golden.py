"""Registered queries of question sets: every document gives rise to a question about chunks of its neighbours by stated rules, some
of which break a gate, and stands for a chunk itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import golden as G
from tessera.operators import store as S
from tessera.plans.registry import query, table

#: Columns in SQL of both engines; {o} and {c} open and close an array.
SET_OF = """SELECT doc_id AS seq, concat('Q', CAST(doc_id % 990 AS STRING)) AS id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 3 = 0 THEN concat('ما هو الجرد السنوي في المستودع ', substr("text", 1, 30)) ELSE substr("text", 1, 30) END AS question,
CASE WHEN doc_id % 29 = 0 THEN 'maybe' WHEN doc_id % 5 = 0 THEN 'refuse' ELSE 'answerable' END AS expect, CASE doc_id % 13 WHEN 0 THEN 'fast' WHEN 1 THEN NULL WHEN 2 THEN 'simple' ELSE 'basic_rag' END AS expected_route,
CASE WHEN doc_id % 31 = 0 THEN '' ELSE lang END AS tests, CASE WHEN doc_id % 10 = 0 THEN 'out_of_domain' WHEN doc_id % 15 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'non_answering_retrieval' WHEN doc_id % 37 = 1 THEN 'out_of_domain' END AS refusal_kind,
CASE doc_id % 19 WHEN 0 THEN concat('Q', CAST((doc_id + 1) % 990 AS STRING)) WHEN 1 THEN concat('Q', CAST((doc_id + 989) % 990 AS STRING)) WHEN 2 THEN 'Q-' END AS depends_on,
CASE WHEN doc_id % 23 = 0 THEN '' ELSE concat('الجواب في الدليل ', substr("text", 1, 12)) END AS answer, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS answer_en,
CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {o}concat(source, ':p', CAST(doc_id % 50 AS STRING)), 'all:p1', concat(source, ':p', CAST(doc_id % 50 AS STRING)){c} END AS pages_read,
CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {o}{s1}doc_id{s2}CASE WHEN doc_id % 8 = 0 THEN 'no such words' ELSE replace(substr("text", 5, 25), ' ', '  ') END{s3}, {s1}doc_id + 3{s2}lang{s3}{c} END AS evidence,
CASE WHEN doc_id % 12 = 0 THEN NULL WHEN doc_id % 5 = 0 AND doc_id % 4 != 0 THEN NULL WHEN source = 'src3' THEN NULL ELSE {o}doc_id, doc_id + 1{c} END AS gold,
CASE WHEN doc_id % 6 = 0 THEN {o}doc_id + 5{c} END AS distractors, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'page says more' WHEN 2 THEN '' END AS page_vs_chunk FROM {docs}"""
DUCK = SET_OF.format(o="[", c="]", s1="{'chunk_id': ", s2=", 'quote': ", s3="}", docs="documents")
CHUNKS = "SELECT doc_id chunk_id, \"text\", source, lang chunk_type, CAST(doc_id % 40 AS VARCHAR) section_path FROM documents WHERE source != 'src3' OR doc_id % 2 = 0"


def questions(spark: SparkSession, d: str) -> DataFrame:
    sql = SET_OF.format(o="array(", c=")", s1="named_struct('chunk_id', ", s2=", 'quote', ", s3=")", docs="{docs}").replace('"text"', "text")
    return spark.sql(sql, docs=table(spark, d, "documents"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source != 'src3' or doc_id % 2 = 0")
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", "source", F.col("lang").alias("chunk_type"), (F.col("doc_id") % 40).cast("string").alias("section_path"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Three ways of building the corpus, two of which lost a chunk now and then."""
    own = chunks(spark, d).select("chunk_id")
    named = lambda name, df: df.select(F.lit(name).alias("variant"), "chunk_id")
    return named("none", own).unionByName(named("template", own.where("chunk_id % 41 != 3"))).unionByName(named("llm", own.where("chunk_id % 43 != 4")))


ARABIC = f"len(regexp_extract_all(t, '{T.ARABIC_ALL}')) / length(t)::DOUBLE"
OFF = f"len(regexp_extract_all(t, '{T.FOREIGN}')) / length(t)::DOUBLE"
SQUEEZE = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
LACKS = """list_filter([CASE WHEN coalesce(answer, '') = '' THEN 'answer' END, CASE WHEN expect = 'answerable' AND coalesce(answer_en, '') = '' THEN 'answer_en' END, CASE WHEN expect = 'answerable' AND coalesce(len(evidence), 0) = 0 THEN 'evidence' END,
CASE WHEN nar AND coalesce(len(distractors), 0) = 0 THEN 'distractor_chunk_ids' END, CASE WHEN (expect = 'answerable' OR nar) AND coalesce(len(pages_read), 0) = 0 THEN 'pages_read' END], lambda x: x IS NOT NULL)"""
GATES = f"""q AS (SELECT *, expect = 'refuse' AND coalesce(refusal_kind, '') = 'non_answering_retrieval' nar FROM ({DUCK})), c AS ({CHUNKS}),
va AS (SELECT 'none' variant, chunk_id FROM c UNION ALL SELECT 'template', chunk_id FROM c WHERE chunk_id % 41 != 3 UNION ALL SELECT 'llm', chunk_id FROM c WHERE chunk_id % 43 != 4),
rf AS (SELECT id, 'gold_chunk_ids' field, unnest(gold) chunk_id FROM q UNION ALL SELECT id, 'distractor_chunk_ids', unnest(distractors) FROM q UNION ALL SELECT id, 'evidence', unnest(evidence).chunk_id FROM q),
g AS (SELECT 1 gate, NULL id, 'count ' || count(*) detail FROM q HAVING count(*) != 20 UNION ALL SELECT 1, id, 'repeated id' FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 1, id, unnest(list_filter([CASE WHEN question = '' THEN 'no question' END, CASE WHEN expect NOT IN ('answerable', 'refuse') THEN 'expect' END, CASE WHEN coalesce(expected_route, '') NOT IN ('simple', 'basic_rag', 'advanced_rag') THEN 'expected_route' END, CASE WHEN tests = '' THEN 'no tests' END,
CASE WHEN CASE WHEN expect = 'refuse' THEN coalesce(refusal_kind, '') NOT IN ('out_of_domain', 'non_answering_retrieval') ELSE refusal_kind IS NOT NULL END THEN 'refusal_kind' END, CASE WHEN len({LACKS}) > 0 THEN 'missing ' || array_to_string({LACKS}, ',') END], lambda x: x IS NOT NULL)) FROM q
UNION ALL SELECT 2, id, field || ' ' || chunk_id FROM rf WHERE chunk_id NOT IN (SELECT chunk_id FROM c) UNION ALL SELECT 2, id, field || ' ' || rf.chunk_id || ' not in ' || v FROM rf SEMI JOIN c USING (chunk_id) CROSS JOIN (VALUES ('none'), ('template'), ('llm')) n(v) WHERE NOT EXISTS (SELECT 1 FROM va WHERE va.variant = n.v AND va.chunk_id = rf.chunk_id)
UNION ALL SELECT 3, id, CASE WHEN expect = 'answerable' THEN 'no gold' ELSE 'refuse with gold' END FROM q WHERE (expect = 'answerable' AND coalesce(len(gold), 0) = 0) OR (expect = 'refuse' AND coalesce(len(gold), 0) > 0)
UNION ALL SELECT 4, id, 'no evidence' FROM q WHERE expect = 'answerable' AND coalesce(len(evidence), 0) = 0
UNION ALL SELECT 4, id, 'quote not in ' || c.chunk_id FROM (SELECT id, unnest(evidence) e FROM q) x JOIN c ON c.chunk_id = e.chunk_id WHERE NOT contains({SQUEEZE.format(x='c."text"')}, {SQUEEZE.format(x="e.quote")})
UNION ALL SELECT 5, id, n || ' ' || d FROM (SELECT id, n, unnest(list_filter([CASE WHEN contains(t, chr(65533)) OR {OFF} > 0.01 THEN 'degraded' END, CASE WHEN round({ARABIC}, 6) < 0.10::DOUBLE THEN 'arabic_ratio' END], lambda x: x IS NOT NULL)) d FROM (SELECT id, 'question' n, question t FROM q UNION ALL SELECT id, 'answer', answer FROM q) WHERE t != '')
UNION ALL SELECT 6, q.id, 'depends on ' || q.depends_on FROM q LEFT JOIN (SELECT id, min(seq) s FROM q GROUP BY 1) f ON f.id = q.depends_on WHERE q.depends_on IS NOT NULL AND (f.s IS NULL OR f.s >= q.seq)
UNION ALL SELECT DISTINCT 7, NULL, source FROM c WHERE source NOT IN (SELECT c.source FROM (SELECT unnest(gold) i FROM q) JOIN c ON i = chunk_id) UNION ALL SELECT 8, NULL, 'read against 7')"""


@query(f"WITH {GATES} SELECT * FROM g")
def question_gates(spark: SparkSession, d: str) -> DataFrame:
    """All eight gates over a set that breaks each of them."""
    own, corpus = questions(spark, d), chunks(spark, d)
    stored = spark.range(1).select(F.lit(7).cast("long").alias("chunk_count"), F.lit("stale").alias("sha256"))
    return G.gates(own, corpus, variants(spark, d), stored, S.fingerprint(corpus, "chunk_id", "text"))


@query(f"WITH {GATES} SELECT DISTINCT chunk_id FROM rf")
def referenced_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that any question depends on."""
    return G.referenced(questions(spark, d)).select("chunk_id").distinct()


@query(f"""WITH {GATES} SELECT types, paths, median_gold, least_gold, most_gold, disagreements FROM (SELECT count(DISTINCT chunk_type) types, count(DISTINCT section_path) paths FROM (SELECT unnest(gold) chunk_id FROM q) JOIN c USING (chunk_id)),
(SELECT floor(median(coalesce(len(gold), 0)) FILTER (expect = 'answerable'))::BIGINT median_gold, (min(coalesce(len(gold), 0)) FILTER (expect = 'answerable'))::INT least_gold, (max(coalesce(len(gold), 0)) FILTER (expect = 'answerable'))::INT most_gold, count(*) FILTER (coalesce(page_vs_chunk, '') NOT IN ('', 'none')) disagreements FROM q)""")
def golden_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the set reaches."""
    return G.coverage(questions(spark, d), chunks(spark, d))


@query(f"WITH q AS ({DUCK}) SELECT ref, string_agg(id, ', ' ORDER BY seq) asked FROM (SELECT seq, id, unnest(list_distinct(pages_read)) ref FROM q) GROUP BY 1")
def worksheet(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the questions that point to them."""
    return G.worksheet(questions(spark, d))
