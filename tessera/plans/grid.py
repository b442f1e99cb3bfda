"""Registered queries of retrieval over a grid of ways, and of the gates of a run of several arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.plans import catalog
from tessera.plans import encoders as V
from tessera.plans.registry import query, table

#: Ways of retrieving: which legs are fused.
MODES = {"dense": ("dn",), "sparse": ("sp",), "bm25": ("bm",), "dense_sparse": ("dn", "sp"), "dense_bm25": ("dn", "bm"), "all": ("dn", "sp", "bm")}
PER_SOURCE, PER_PAGE, K = 5, 3, 10


def legs(spark: SparkSession, d: str) -> DataFrame:
    """leg, item_id, doc_id, rnk to DEEP."""
    own = {"bm": catalog.ranking(spark, d, catalog.DEEP), "sp": catalog.sparse(spark, d, catalog.DEEP), "dn": catalog.leg(spark, d, "dense-hashed", lambda: V.dense_leg(spark, d, catalog.DEEP))}
    rows = [df.select(F.lit(n).alias("leg"), "item_id", "doc_id", "rnk") for n, df in own.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def cells(spark: SparkSession, d: str) -> DataFrame:
    """mode, capped, item_id, doc_id, rnk: each way of retrieving with and without caps, all ways in one plan.

    A leg alone keeps its order: fusing one ranking ranks it by the same places."""
    used = F.create_map(*[x for m, ls in MODES.items() for x in (F.lit(m), F.array(*map(F.lit, ls)))])
    rows = legs(spark, d).withColumn("mode", F.explode(F.filter(F.array(*map(F.lit, MODES)), lambda m: F.array_contains(F.element_at(used, m), F.col("leg")))))
    keyed = rows.withColumn("cell", F.struct("mode", "item_id"))
    fused = R.rrf(keyed, "cell", catalog.DEEP).select("cell", "doc_id", "rnk")
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 50).alias("page"))
    capped = R.caps(fused.join(docs, "doc_id"), "cell", PER_SOURCE, PER_PAGE).select("cell", "doc_id", F.col("new_rnk").alias("rnk"), F.lit(True).alias("capped"))
    both = fused.withColumn("capped", F.lit(False)).unionByName(capped).where(F.col("rnk") <= K)
    return both.select("cell.mode", "capped", "cell.item_id", "doc_id", "rnk")


FUSED = " UNION ALL ".join(f"SELECT '{m}' \"mode\", item_id, doc_id, rnk FROM ({' UNION ALL '.join(f'SELECT item_id, doc_id, rnk FROM {x}' for x in ls)})" for m, ls in MODES.items())
CELLS = f"""{catalog.LEGS}, {V.DENSE}, lg AS ({FUSED}), fz AS (SELECT *, row_number() OVER (PARTITION BY "mode", item_id ORDER BY r DESC, doc_id)::INT rnk FROM (SELECT "mode", item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rnk)), 8) r FROM lg GROUP BY 1, 2, 3) QUALIFY rnk <= 50),
cp AS (SELECT f.*, source, doc_id % 50 page FROM fz f JOIN documents USING (doc_id)), c1 AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY "mode", item_id, source, page ORDER BY rnk) <= {PER_PAGE}), c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY "mode", item_id, source ORDER BY rnk) <= {PER_SOURCE}),
ce AS (SELECT "mode", false capped, item_id, doc_id, rnk FROM fz UNION ALL SELECT "mode", true, item_id, doc_id, row_number() OVER (PARTITION BY "mode", item_id ORDER BY rnk)::INT FROM c2), ck AS (SELECT * FROM ce WHERE rnk <= {K})"""


@query(f"{CELLS} SELECT * FROM ck")
def retrieval_cells(spark: SparkSession, d: str) -> DataFrame:
    """Six ways of retrieving, with and without caps, for every question."""
    return cells(spark, d)


@query(f"""{CELLS}, {catalog.GOLD}, tot AS (SELECT item_id, count(*) n_gold FROM gold GROUP BY 1), hits AS (SELECT "mode", capped, item_id, count(*) hits, min(rnk) best, sum(1.0::DOUBLE / log2(rnk + 1.0)) dcg FROM ck JOIN gold USING (item_id, doc_id) GROUP BY 1, 2, 3),
bk AS (SELECT "mode", capped, item_id, count(*) n FROM ck GROUP BY 1, 2, 3), m AS (SELECT b."mode", b.capped, round(coalesce(hits::DOUBLE / n_gold, 0), 6) recall, round(coalesce(hits::DOUBLE / n, 0), 6) prec, round(coalesce(1.0::DOUBLE / best, 0), 6) mrr,
round(coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0))), 0), 6) ndcg FROM bk b JOIN tot USING (item_id) LEFT JOIN hits h ON h."mode" = b."mode" AND h.capped = b.capped AND h.item_id = b.item_id)
SELECT "mode", capped, count(*) n, round(avg(recall), 4) recall, round(avg(prec), 4) "precision", round(avg(mrr), 4) mrr, round(avg(ndcg), 4) ndcg FROM m GROUP BY 1, 2""")
def retrieval_cell_means(spark: SparkSession, d: str) -> DataFrame:
    """The grid: means of every cell over the questions that have gold."""
    keyed = cells(spark, d).withColumn("cell", F.struct("mode", "capped", "item_id"))
    ways = keyed.select("mode", "capped").distinct()
    gold = catalog.gold(spark, d).crossJoin(F.broadcast(ways)).select(F.struct("mode", "capped", "item_id").alias("cell"), "doc_id")  # twelve ways
    per = R.metrics(keyed.select("cell", "doc_id", "rnk"), gold, "cell")
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return per.groupBy("cell.mode", "cell.capped").agg(F.count("*").alias("n"), *map(mean, ("recall", "precision", "mrr", "ndcg")))


#: Records of a run: every question of each arm but some; a record may be an error or have retrieved nothing.
RECORDS_OF = """SELECT CASE doc_id % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'adaptive' ELSE 'forced' END AS arm, CAST(floor(doc_id / 3) AS BIGINT) AS qid, CASE WHEN doc_id % 13 = 0 THEN 'error' ELSE 'grounded' END AS kind, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 3 END AS n_chunks,
CASE WHEN doc_id % 17 = 0 THEN 'missing step' END AS ledger_failure FROM {docs} WHERE doc_id % 19 != 0"""


@query(f"""WITH r AS ({RECORDS_OF.format(docs="documents")}), q AS (SELECT DISTINCT CAST(floor(doc_id / 3) AS BIGINT) qid, CAST(floor(doc_id / 3) AS BIGINT) % 4 != 0 answerable FROM documents)
SELECT 'missing' gate, arm, q.qid FROM q CROSS JOIN (VALUES ('basic'), ('adaptive'), ('forced')) a(arm) WHERE (arm != 'forced' OR q.qid % 3 = 0) AND NOT EXISTS (SELECT 1 FROM r WHERE r.arm = a.arm AND r.qid = q.qid)
UNION ALL SELECT 'error', arm, qid FROM r WHERE kind = 'error' UNION ALL SELECT 'ledger', arm, qid FROM r WHERE ledger_failure IS NOT NULL UNION ALL SELECT 'empty', arm, qid FROM r JOIN q USING (qid) WHERE arm = 'basic' AND answerable AND kind != 'error' AND n_chunks = 0""")
def harness_gate(spark: SparkSession, d: str) -> DataFrame:
    """Records that a run owes, errors, ledgers that failed, and basic runs that retrieved nothing for a question with an answer."""
    docs = table(spark, d, "documents")
    records = spark.sql(RECORDS_OF, docs=docs)
    asked = docs.select(F.floor(F.col("doc_id") / 3).alias("qid")).distinct().withColumn("answerable", F.col("qid") % 4 != 0)
    owed = asked.withColumn("arm", F.explode(F.array(*map(F.lit, E.ARMS)))).where("arm != 'forced' or qid % 3 = 0")
    return E.harness_gates(owed, records, asked)


@query("""SELECT round(count(*) FILTER (lang = coalesce(w, ''))::DOUBLE / count(*), 6) agreement, count(*) FILTER (lang = coalesce(w, '')) same, count(*) n FROM (SELECT lang, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN lang END w FROM documents)""")
def route_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often a route that was given is the one expected; none given is none right."""
    given = F.when(F.col("doc_id") % 4 == 0, "en").when(F.col("doc_id") % 4 == 1, "de").when(F.col("doc_id") % 4 == 2, F.col("lang"))
    return E.agreement(table(spark, d, "documents").select(F.col("lang").alias("expected"), given.alias("given")), "expected", "given")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) r FROM documents) WHERE r = 1")
def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    """The first of each value in a stated order."""
    return E.first_of(table(spark, d, "documents"), "source", "n_chars", "doc_id").select("source", "doc_id")


@query("""WITH j AS (SELECT arm, qid, max(s) s FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'adaptive' ELSE 'forced' END arm, CAST(floor(doc_id / 3) AS BIGINT) qid, n_chars s FROM documents WHERE doc_id % 5 != 1) GROUP BY 1, 2)
SELECT r.arm, r.qid, r.kind, s score FROM (""" + RECORDS_OF.format(docs="documents") + """) r LEFT JOIN j USING (arm, qid)""")
def judge_index(spark: SparkSession, d: str) -> DataFrame:
    """Records with their judgement, by arm and question; those never judged have none."""
    docs = table(spark, d, "documents")
    arm = F.when(F.col("doc_id") % 3 == 0, "basic").when(F.col("doc_id") % 3 == 1, "adaptive").otherwise("forced").alias("arm")
    judged = docs.where("doc_id % 5 != 1").select(arm, F.floor(F.col("doc_id") / 3).alias("qid"), F.col("n_chars").alias("score"))
    return E.judged_runs(spark.sql(RECORDS_OF, docs=docs), judged, "arm", "qid").select("arm", "qid", "kind", "score")
