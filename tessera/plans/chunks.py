"""Registered queries of chunk operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.plans.registry import query, table
from tessera.plans.sql import CLEAN

FILTERS = [(1, None, None), (2, None, "en"), (3, "no such source", None), (4, None, "de")]


@query("""SELECT l_orderkey, l_linenumber, kind FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 AND l_discount < 0.12 * 1.0::DOUBLE AND l_discount + l_tax < 0.12::DOUBLE THEN 'header'
WHEN l_partkey % 5 + 1 <= 2 AND (l_discount + l_tax) - l_discount > 0.6::DOUBLE THEN 'container' ELSE 'data' END kind FROM lineitem)""")
def classify_table(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for tables: their number for rows, discount and tax for places on a page of height 1."""
    kind = C.table_kind(F.col("l_linenumber"), F.col("l_partkey") % 5 + 1, F.col("l_discount"), F.col("l_discount") + F.col("l_tax"), F.lit(1.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("SELECT doc_id, printf('%s_p%02d_%s_%02d', source, doc_id % 50, lang, row_number() OVER (PARTITION BY source, doc_id % 50, lang ORDER BY doc_id) - 1) chunk_id FROM documents")
def chunk_finalise(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 50).alias("page"), F.col("lang").alias("type"))
    return C.finalise(docs, "doc_id").select("doc_id", "chunk_id")


@query(r"""SELECT source, arg_max({'t': CASE WHEN len(l) >= 3 AND contains(l[1], 'e') THEN nullif(""" + CLEAN.replace("(text,", "(t,") + r""", '') END}, doc_id).t title FROM (SELECT *, array_to_string(l[3:], ' ') t FROM (
SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '') l FROM documents WHERE doc_id % 50 = 1)) GROUP BY 1""")
def manual_titles(spark: SparkSession, d: str) -> DataFrame:
    """The rule of covers over whole texts, 'e' in place of the bank's word."""
    pages = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 50).alias("page"), F.struct(C.cover_title(F.col("text"), "e").alias("t")).alias("title"))
    return C.titles(pages, "doc_id").select("source", "title.t").withColumnRenamed("t", "title")

@query("""WITH f(filter_id, s, l) AS (VALUES (1, NULL, NULL), (2, NULL, 'en'), (3, 'no such source', NULL), (4, NULL, 'de'))
SELECT filter_id, CASE WHEN count(doc_id) = 0 THEN (SELECT count(*) FROM documents) ELSE count(doc_id) END::BIGINT n_allowed, count(doc_id) = 0 fell_back FROM f LEFT JOIN documents ON (s IS NULL OR source = s) AND (l IS NULL OR lang = l) GROUP BY 1""")
def selfquery_fallback(spark: SparkSession, d: str) -> DataFrame:
    return C.allowed(table(spark, d, "documents"), spark.createDataFrame(FILTERS, "filter_id int, source string, lang string"))


@query("SELECT doc_id FROM documents WHERE length(concat('source ', source, ', language ', lang)) > length(text)")
def oversized_prefixes(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.concat(F.lit("source "), "source", F.lit(", language "), "lang")
    return table(spark, d, "documents").filter(F.char_length(prefix) > F.char_length("text")).select("doc_id")


@query("""SELECT slot, change FROM (SELECT coalesce(a.slot, b.slot) slot, CASE WHEN a.slot IS NULL THEN 'added' WHEN b.slot IS NULL THEN 'removed' WHEN a.lang IS DISTINCT FROM b.lang THEN 'changed' END change
FROM (SELECT doc_id // 2 slot, lang FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id // 2 slot, lang FROM documents WHERE doc_id % 2 = 1) b USING (slot)) WHERE change IS NOT NULL""")
def build_diff(spark: SparkSession, d: str) -> DataFrame:
    """Even and odd documents stand for two builds of the same slots."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 2").alias("slot"), "lang", (F.col("doc_id") % 2).alias("build"))
    return C.build_diff(docs.filter("build = 0"), docs.filter("build = 1"), "slot", "lang")
