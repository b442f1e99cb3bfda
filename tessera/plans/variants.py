"""Registered queries of the variants of a corpus; documents stand for chunks, and prefixes follow from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import variants as V
from tessera.plans.registry import query, stored, table

#: Prefixes in SQL of both engines; some lack a part, and what a model says first is too short for half of the documents.
TEMPLATE = "CASE WHEN doc_id % 31 = 5 THEN '' ELSE concat('الدليل ', source, '، ', CASE WHEN doc_id % 37 = 2 THEN 'xx' ELSE lang END, '، صفحة ', CAST(doc_id % 50 AS STRING)) END"
WRITTEN = "concat('هذا المقطع من الدليل يشرح إجراءات الجرد السنوي في المستودعات وطريقة التعامل مع السجلات رقم ', CAST(doc_id % 90 AS STRING))"
FIRST = f"CASE doc_id % 4 WHEN 0 THEN {WRITTEN} WHEN 1 THEN 'قصير' ELSE '' END"
SECOND = f"CASE doc_id % 3 WHEN 0 THEN {WRITTEN} ELSE NULL END"
OF = "CASE WHEN doc_id % 4 = 0 THEN 'clean' WHEN doc_id % 3 = 0 THEN 're_asked' ELSE 'template_fallback' END"


def base(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"), "doc_id", "source", "lang", F.col("lang").alias("section_path"), "text")


def built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    own = base(spark, d)
    return {
        "none": V.applied(own, F.lit("")), "template": V.applied(own, F.expr(TEMPLATE)),
        "llm": stored(V.written(own, F.expr(FIRST), F.expr(SECOND), F.expr(TEMPLATE)), "written"),
    }


PREFIX = f"CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN {WRITTEN} ELSE {TEMPLATE} END"
COMPOSED = "CASE WHEN p = '' THEN coalesce(\"text\", '') ELSE p || chr(10) || chr(10) || coalesce(\"text\", '') END"
ROWS = f"""SELECT variant, doc_id, p context_prefix, source_of, {COMPOSED} "text" FROM (SELECT 'none' variant, doc_id, '' p, NULL source_of, "text" FROM documents UNION ALL SELECT 'template', doc_id, {TEMPLATE}, NULL, "text" FROM documents UNION ALL SELECT 'llm', doc_id, {PREFIX}, {OF}, "text" FROM documents)"""


@query(f'SELECT variant, doc_id, context_prefix, source_of, sha256("text") text_sha256 FROM ({ROWS})')
def context_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every document in three variants, with what its prefix came from."""
    rows = [v.select(F.lit(n).alias("variant"), "doc_id", "context_prefix", "source_of", F.sha2("text", 256).alias("text_sha256")) for n, v in built(spark, d).items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH v AS ({ROWS}) SELECT * FROM (SELECT 1 gate, 'none' variant, count(*) failing FROM documents WHERE doc_id % 41 = 7 UNION ALL SELECT 1, 'template', count(*) FROM documents WHERE doc_id % 43 = 8
UNION ALL SELECT 2, 'none', count(*) FROM documents WHERE doc_id % 17 = 3 AND doc_id % 41 != 7 UNION ALL SELECT 3, 'llm', count(*) FROM v WHERE variant = 'llm' AND doc_id % 19 = 4 AND context_prefix != ''
UNION ALL SELECT 4, 'template', count(*) FROM documents WHERE doc_id % 31 = 5 OR source = 'src3' OR doc_id % 37 = 2 UNION ALL SELECT 5, 'llm', count(*) FROM v WHERE source_of = 'template_fallback' HAVING count(*) > 0.1 * (SELECT count(*) FROM documents)
UNION ALL SELECT 5, 'llm', count(*) FROM v WHERE variant = 'llm' AND context_prefix = '' UNION ALL SELECT 6, 'llm', count(*) FROM documents WHERE n_chars >= 8192 * 0.9) WHERE failing > 0""")
def context_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates over variants that lost rows, moved some, changed a text, or lack a part of a prefix."""
    own = built(spark, d)
    hurt = {
        "none": own["none"].where("doc_id % 41 != 7").withColumn("text", F.when(F.col("doc_id") % 17 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text"))),
        "template": own["template"].withColumn("seq", F.when(F.col("doc_id") % 43 == 8, F.col("seq") + 1).otherwise(F.col("seq"))),
        "llm": own["llm"].withColumn("text", F.when((F.col("doc_id") % 19 == 4) & (F.col("context_prefix") != ""), F.expr("substring(text, 2)")).otherwise(F.col("text"))),
    }
    titles = table(spark, d, "documents").where("source != 'src3'").select("source", F.col("source").alias("title")).distinct()
    return V.gates(base(spark, d), hurt, titles, table(spark, d, "documents").select(F.col("n_chars").alias("prompt_tokens")))
