"""Every registered query of the engine proper, by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.plans import chunks, corpus, entailment, evaluation, golden as golden_sets, layout, ledgers, parsing, rows, store, texts  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES, query, scratch, small_batches, stamp, table  # noqa: F401
from tessera.plans.sql import CLEAN, MARKED, TOK, tokens_sql

SCORED = f"""WITH tf AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({TOK}) term FROM documents) GROUP BY 1, 2),
len AS (SELECT doc_id, len({TOK}) len FROM documents), st AS (SELECT count(*) n, avg(len::DOUBLE) avgdl FROM len),
df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
qtf AS (SELECT item_id, term, count(*) qtf FROM (SELECT item_id, unnest({TOK}) term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) * qtf), 6) score
  FROM qtf JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT rnk FROM (SELECT b.item_id, d.doc_id, coalesce(s.score, 0) score
  FROM benchmark b CROSS JOIN documents d LEFT JOIN scored s ON s.item_id = b.item_id AND s.doc_id = d.doc_id))"""
GOLD = "gold AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = f"""{SCORED}, {GOLD}, tot AS (SELECT item_id, count(*) n_gold FROM gold GROUP BY 1),
hits AS (SELECT item_id, count(*) hits, min(rnk) best, sum(1.0::DOUBLE / log2(rnk + 1.0)) dcg FROM ranked JOIN gold USING (item_id, doc_id) WHERE rnk <= 10 GROUP BY 1),
met AS (SELECT item_id, round(coalesce(hits::DOUBLE / n_gold, 0), 6) recall, round(coalesce(hits / least(10, (SELECT count(*) FROM documents))::DOUBLE, 0), 6) "precision", round(coalesce(1.0::DOUBLE / best, 0), 6) mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0))), 0), 6) ndcg, CASE WHEN hits = n_gold THEN 1.0 ELSE 0.0 END::DOUBLE strict FROM tot LEFT JOIN hits USING (item_id))"""


@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean(T.nfkc(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, length(text)::BIGINT n_before, {MARKED} stripped, length({MARKED})::BIGINT n_after FROM documents")
def strip_marks(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.char_length(c).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n("text").alias("n_before"), T.strip_marks(F.col("text")).alias("stripped"), n(T.strip_marks(F.col("text"))).alias("n_after"))


# Raw shares of the whole text; the patterns are the gate's own.
ASSESSED = f"""a AS (SELECT doc_id, source, n, CASE WHEN n = 0 THEN 0 ELSE len(regexp_extract_all(t, '{T.ARABIC_ALL}')) / n::DOUBLE END ar, CASE WHEN n = 0 THEN 0 ELSE len(regexp_extract_all(t, '{T.FOREIGN}')) / n::DOUBLE END off,
regexp_extract_all(t, '{T.ARABIC_WORD}') w, (n - length(replace(t, chr(65533), '')))::BIGINT bad FROM (SELECT doc_id, source, coalesce(text, '') t, length(coalesce(text, ''))::BIGINT n FROM documents)),
q AS (SELECT doc_id, source, n, round(ar, 6) arabic_ratio, round(off, 6) off_script_ratio, round(CASE WHEN len(w) >= 20 THEN len(list_filter(w, lambda x: length(x) <= 2)) / len(w)::DOUBLE ELSE 0 END, 6) fragment_ratio, bad replacement_chars,
CASE WHEN n = 0 THEN 'empty' WHEN bad > 0 OR off > 0.01 THEN 'degraded' WHEN ar < 0.1 AND n > 200 THEN 'suspicious' ELSE 'ok' END verdict FROM a)"""


@query(f"WITH {ASSESSED} SELECT doc_id, arabic_ratio, off_script_ratio, fragment_ratio, replacement_chars, verdict FROM q")
def quality(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the whole text and the verdict of the gate."""
    return table(spark, d, "documents").select("doc_id", T.assessed(F.col("text")).alias("q")).select("doc_id", "q.*")


@query(f"SELECT doc_id, len({TOK})::BIGINT n_tokens, len(list_distinct({TOK}))::BIGINT n_distinct FROM documents")
def tokenize_plain(spark: SparkSession, d: str) -> DataFrame:
    got = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(got).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(got)).cast("bigint").alias("n_distinct"))


@query(f"""SELECT token, count(*)::BIGINT df, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) ratio, token IN ({", ".join(f"'{w}'" for w in T.STOPWORDS)}) stopword
FROM (SELECT unnest(list_distinct({TOK})) token FROM documents) GROUP BY 1 ORDER BY df DESC, token LIMIT 100""")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    df = lexical(spark, d).df.crossJoin(F.broadcast(lexical(spark, d).stats))
    return df.select(F.col("term").alias("token"), "df", F.round(F.col("df") / F.col("n_docs"), 6).alias("ratio"), F.col("term").isin(*T.STOPWORDS).alias("stopword")).orderBy(F.col("df").desc(), "token").limit(100)


@query(f"""WITH p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({TOK}) term FROM documents)), n AS (SELECT count(*) n FROM documents)
SELECT term, count(*)::BIGINT df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) idf FROM p, n GROUP BY 1""")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d).terms().select("term", "df", F.round("idf", 6).alias("idf"))


def lexical(spark: SparkSession, d: str, level: str = T.PLAIN) -> R.LexicalIndex:
    """The stored index of the documents, built by the first query of an application that asks for it; other levels from the plain one."""
    built = lambda: R.LexicalIndex.of(table(spark, d, "documents")) if level == T.PLAIN else lexical(spark, d).at(level)

    def build(path: str) -> R.LexicalIndex:
        own = built()
        with small_batches(spark):
            return own.stored(path)

    return scratch(spark, ("lexical", d, level, stamp(spark, f"{d}/documents.parquet")), build)


#: Ranks that a leg keeps; what asks for fewer cuts the same leg.
DEEP = 50


def leg(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A ranking to DEEP, made by the first query of an application that asks for it."""
    key = (name, d, stamp(spark, f"{d}/documents.parquet"), stamp(spark, f"{d}/benchmark.parquet"))
    return scratch(spark, key, lambda path: _stored(build(), path))


def ranking(spark: SparkSession, d: str, k: int = 10, level: str = T.PLAIN) -> DataFrame:
    return leg(spark, d, f"bm25-{level}", lambda: R.bm25(lexical(spark, d, level), table(spark, d, "benchmark"), k=DEEP)).where(F.col("rnk") <= k)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage, kept for the application's other queries."""
    return scratch(spark, ("gold", d, stamp(spark, f"{d}/documents.parquet"), stamp(spark, f"{d}/benchmark.parquet")), lambda path: _stored(R.contained(table(spark, d, "benchmark"), table(spark, d, "documents")), path))


def _stored(df: DataFrame, path: str) -> DataFrame:
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(f"{SCORED} SELECT item_id, doc_id, score, rnk FROM ranked WHERE rnk <= 10")
def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d)


@query(f"""{SCORED}, f AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT rnk
FROM ranked JOIN documents USING (doc_id) WHERE lang = 'en') SELECT * FROM f WHERE rnk <= 10""")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """idf of the whole corpus; only documents that may be ranked are scored."""
    allowed = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return R.bm25(lexical(spark, d), table(spark, d, "benchmark"), allowed=allowed)


@query(" UNION ALL ".join(f"SELECT '{level}' \"level\", * FROM ({SCORED.replace(TOK, tokens_sql('text', level))} SELECT item_id, doc_id, score, rnk FROM ranked WHERE rnk <= 10)" for level in (T.PLAIN, T.STOPPED, T.STRIPPED)))
def bm25_levels(spark: SparkSession, d: str) -> DataFrame:
    """The ranking at each level of the tokeniser."""
    parts = [ranking(spark, d, level=level).select(F.lit(level).alias("level"), "item_id", "doc_id", "score", "rnk") for level in (T.PLAIN, T.STOPPED, T.STRIPPED)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{METRICS} SELECT * FROM met")
def question_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.metrics(ranking(spark, d), gold(spark, d))


@query(f"{METRICS} SELECT item_id, recall FROM met")
def bm25_recall(spark: SparkSession, d: str) -> DataFrame:
    return R.metrics(ranking(spark, d), gold(spark, d)).select("item_id", "recall")


@query(f"{METRICS} SELECT count(*)::BIGINT n, round(avg(recall), 6) recall, round(avg(\"precision\"), 6) \"precision\", round(avg(mrr), 6) mrr, round(avg(ndcg), 6) ndcg, round(avg(strict), 6) strict FROM met")
def mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = ("recall", "precision", "mrr", "ndcg", "strict")
    return R.metrics(ranking(spark, d), gold(spark, d)).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in names])


KNN = """SELECT * FROM (SELECT qid, vec_id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id)::INT rnk FROM (
SELECT a.vec_id qid, b.vec_id vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) cos FROM embeddings a, embeddings b
WHERE a.vec_id % 50 = 0 AND a.vec_id != b.vec_id {more})) WHERE rnk <= 10"""


def _questions(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query(KNN.format(more=""))
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.dense(_questions(e), e)


@query(KNN.format(more="AND b.label < 5"))
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.dense(_questions(e), e.filter("label < 5"))


LEGS = f"""{SCORED}, bm AS (SELECT item_id, doc_id, rnk FROM ranked WHERE rnk <= 50),
sp AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id)::INT rnk FROM (
  SELECT item_id, doc_id, round(sum(ln(1 + qtf) * ln(1 + tf)), 6) s FROM qtf JOIN tf USING (term) GROUP BY 1, 2)) WHERE rnk <= 50),
fused AS (SELECT item_id, doc_id, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id)::INT rnk FROM (
  SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rnk)), 8) rrf FROM (SELECT * FROM bm UNION ALL SELECT * FROM sp) GROUP BY 1, 2))"""


def sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    def build() -> DataFrame:
        q = R.postings(R.counted(table(spark, d, "benchmark"), "item_id", "text", T.PLAIN), "item_id")
        return R.products(lexical(spark, d).docs, q.select("item_id", "term", F.log1p("tf").alias("weight")), "item_id", DEEP).withColumnRenamed("score", "s")

    return leg(spark, d, "sparse", build).where(F.col("rnk") <= k)


@query(f"{LEGS} SELECT * FROM sp WHERE rnk <= 10")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse(spark, d, 10).drop("s")


def fused(spark: SparkSession, d: str, k: int) -> DataFrame:
    return R.rrf(ranking(spark, d, 50).select("item_id", "doc_id", "rnk").unionByName(sparse(spark, d, 50).drop("s")), k=k)


@query(f"{LEGS} SELECT * FROM fused WHERE rnk <= 10")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, 10)


@query(f"""{SCORED}, r AS (SELECT item_id // 3 question, item_id, doc_id, rnk, score, count(DISTINCT item_id) OVER (PARTITION BY item_id // 3) subs FROM ranked WHERE rnk <= 10)
SELECT question, doc_id, rnk, score, true absolute FROM r WHERE subs = 1 UNION ALL SELECT question, doc_id, n, s, false FROM (
SELECT question, doc_id, s, row_number() OVER (PARTITION BY question ORDER BY s DESC, doc_id)::INT n FROM (SELECT question, doc_id, round(sum(1.0::DOUBLE / (60 + rnk)), 8) s FROM r WHERE subs > 1 GROUP BY 1, 2)) WHERE n <= 10""")
def fuse_queries(spark: SparkSession, d: str) -> DataFrame:
    """Three passages are the sub-questions of one question; a question left with one keeps its ranking."""
    rows = ranking(spark, d).withColumn("question", F.expr("item_id div 3"))
    return R.fuse_queries(rows, "question", "item_id")


@query(f"{SCORED} SELECT item_id, count(*)::BIGINT hits, array_to_string(list(doc_id ORDER BY doc_id), ' ') distractors FROM ranked WHERE rnk <= 10 AND doc_id % 7 = item_id % 7 GROUP BY 1")
def distractor_hits(spark: SparkSession, d: str) -> DataFrame:
    """A question's distractors among its ten answers, by id."""
    hits = ranking(spark, d).filter("doc_id % 7 = item_id % 7").groupBy("item_id")
    return hits.agg(F.count("*").alias("hits"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("distractors"))


MODES = f"""{LEGS}, modes AS (SELECT 'bm25' "mode", item_id, doc_id, rnk FROM bm WHERE rnk <= 10 UNION ALL SELECT 'sparse', item_id, doc_id, rnk FROM sp WHERE rnk <= 10
UNION ALL SELECT 'hybrid', item_id, doc_id, rnk FROM fused WHERE rnk <= 10)"""


def modes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"bm25": ranking(spark, d), "sparse": sparse(spark, d, 10), "hybrid": fused(spark, d, 10)}


@query(f"{MODES} SELECT * FROM modes")
def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    parts = [df.select(F.lit(m).alias("mode"), "item_id", "doc_id", "rnk") for m, df in modes(spark, d).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{MODES}, {GOLD}, tot AS (SELECT item_id, count(*) n_gold FROM gold GROUP BY 1), hit AS (SELECT "mode", item_id, count(*) hits, min(rnk) best FROM modes JOIN gold USING (item_id, doc_id) GROUP BY 1, 2)
SELECT m."mode", round(avg(round(coalesce(hits::DOUBLE / n_gold, 0), 6)), 4) recall, round(avg(round(coalesce(1.0::DOUBLE / best, 0), 6)), 4) mrr
FROM (VALUES ('bm25'), ('sparse'), ('hybrid')) m("mode") CROSS JOIN tot LEFT JOIN hit ON hit."mode" = m."mode" AND hit.item_id = tot.item_id GROUP BY 1""")
def retrieval_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall and reciprocal rank of each mode over the questions that have gold."""
    want = gold(spark, d)
    means = [R.metrics(df, want).agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr")).select(F.lit(m).alias("mode"), "recall", "mrr") for m, df in modes(spark, d).items()]
    return means[0].unionByName(means[1]).unionByName(means[2])


@query(f"""{LEGS}, a AS (SELECT f.item_id, f.doc_id, f.rnk, source, doc_id % 50 page FROM fused f JOIN documents USING (doc_id) WHERE rnk <= 50),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id, source, page ORDER BY rnk) p FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY rnk) s FROM b WHERE p <= 3)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rnk)::INT new_rnk FROM c WHERE s <= 5""")
def diversity_caps(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 50).alias("page"))
    return R.caps(fused(spark, d, 50).join(docs, "doc_id"), "item_id", 5, 3).select("item_id", "doc_id", "new_rnk")


@query(f"""{SCORED} SELECT item_id, doc_id FROM (SELECT item_id, doc_id, sum(n_chars) OVER (PARTITION BY item_id ORDER BY rnk) used
FROM ranked JOIN documents USING (doc_id) WHERE rnk <= 10) WHERE used <= 16800""")
def fit_budget(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0)
    met = ranking(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return met.withColumn("used", F.sum("n_chars").over(w)).filter("used <= 16800").select("item_id", "doc_id")


@query(f"""WITH {ASSESSED} SELECT source, count(*)::BIGINT pages, sum(n)::BIGINT chars, (sum(n) // count(*))::BIGINT chars_per_page, round(avg(arabic_ratio), 6) mean_arabic_ratio, round(avg(off_script_ratio), 6) mean_off_script_ratio, round(avg(fragment_ratio), 6) mean_fragment_ratio,
count(*) FILTER (verdict = 'degraded')::BIGINT degraded FROM q GROUP BY 1""")
def source_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), T.assessed(F.col("text")).alias("q"))
    mean = lambda c: F.round(F.avg(f"q.{c}"), 6).alias(f"mean_{c}")
    return rows.groupBy("source").agg(F.count("*").alias("pages"), F.sum("n").cast("bigint").alias("chars"), F.floor(F.sum("n") / F.count("*")).alias("chars_per_page"),
                                      mean("arabic_ratio"), mean("off_script_ratio"), mean("fragment_ratio"),
                                      F.count_if(F.col("q.verdict") == "degraded").alias("degraded"))


@query("""SELECT lang, n, ((max(CASE WHEN r = (n - 1) // 2 THEN n_chars END) + max(CASE WHEN r = n // 2 THEN n_chars END)) // 2)::BIGINT median, max(CASE WHEN r = n * 9 // 10 THEN n_chars END) p90, max(n_chars) most FROM (
SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 r, count(*) OVER (PARTITION BY lang) n FROM documents) GROUP BY 1, 2""")
def chunk_census(spark: SparkSession, d: str) -> DataFrame:
    """Median (the mean of the middle two, cut to a whole number) and the pick sorted[n * 9 // 10], from counts of each size.

    Rows are counted by language and size first; the running sums then see one row for each size that occurs."""
    sizes = table(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    up = Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    run = sizes.withColumns({"hi": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy("lang"))}).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda i: F.max(F.when((F.col("lo") <= F.expr(i)) & (F.expr(i) < F.col("hi")), F.col("n_chars")))
    middle = F.floor((at("(n - 1) div 2") + at("n div 2")) / 2)
    return run.groupBy("lang", "n").agg(middle.alias("median"), at("n * 9 div 10").alias("p90"), F.max("n_chars").alias("most"))


@query("SELECT doc_id, printf('%s_p%02d_%s', source, doc_id % 50, lang) chunk_id FROM documents")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.format_string("%s_p%02d_%s", "source", F.col("doc_id") % 50, "lang").alias("chunk_id"))


@query(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!؟]+'), lambda s: len(regexp_extract_all(s, '[^\s]+')) >= 3))::BIGINT n_sentences FROM documents")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


@query("SELECT source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INT place, doc_id FROM documents")
def section_outline(spark: SparkSession, d: str) -> DataFrame:
    """Members of each section in order, a row each: no section has to fit into one value."""
    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")).cast("int")
    return table(spark, d, "documents").select("source", "lang", place.alias("place"), "doc_id")


@query("""SELECT doc_id, concat('source ', source, ', language ', lang) prefix, length(concat_ws(chr(10), concat('source ', source, ', language ', lang), text))::BIGINT text_len FROM documents""")
def context_template(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.concat(F.lit("source "), "source", F.lit(", language "), "lang")
    return table(spark, d, "documents").select("doc_id", prefix.alias("prefix"), F.char_length(F.concat_ws("\n", prefix, "text")).cast("bigint").alias("text_len"))


@query("""SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) prev_role, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT prev_len FROM conversations""")
def prior_turn(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("prev_role"), F.lag(F.char_length("text")).over(w).cast("bigint").alias("prev_len"))


@query("""SELECT coalesce(event_type, 'TOTAL') step, count(*)::BIGINT calls, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT tokens, round(sum(value), 4) latency,
round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / 1000000.0::DOUBLE * 5, 6) cost FROM events GROUP BY ROLLUP (event_type)""")
def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    rolled = table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.sum(k).alias("tokens"), F.round(F.sum("value"), 4).alias("latency"), F.round(F.sum(k) / 1e6 * 5, 6).alias("cost"))
    return rolled.select(F.coalesce("event_type", F.lit("TOTAL")).alias("step"), "calls", "tokens", "latency", "cost")


@query("""WITH t AS (SELECT unnest(range(1, 10)) / 10.0::DOUBLE threshold), s AS (SELECT toxic, least(n_chars / 10000.0::DOUBLE, 1) score FROM labels JOIN documents USING (doc_id))
SELECT threshold, round((sum(CASE WHEN toxic = 1 AND score >= threshold THEN 1 ELSE 0 END) / nullif(sum(toxic), 0)::DOUBLE + sum(CASE WHEN toxic = 0 AND score < threshold THEN 1 ELSE 0 END) / nullif(sum(1 - toxic), 0)::DOUBLE) / 2, 6) accuracy
FROM s, t GROUP BY 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy at nine thresholds, which are columns of one pass, not copies of the rows."""
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    score, pos = F.least(F.col("n_chars") / 10000.0, F.lit(1.0)), F.col("toxic") == 1
    part = lambda t: (F.count_if(pos & (score >= t)) / F.nullif(F.count_if(pos), F.lit(0)) + F.count_if(~pos & (score < t)) / F.nullif(F.count_if(~pos), F.lit(0))) / 2
    cells = [F.struct(F.lit(i / 10.0).alias("threshold"), F.round(part(i / 10.0), 6).alias("accuracy")) for i in range(1, 10)]
    return s.agg(F.array(*cells).alias("x")).select(F.inline("x"))


@query(f"WITH {GOLD} SELECT b.item_id, count(g.doc_id)::BIGINT n_docs FROM benchmark b LEFT JOIN gold g USING (item_id) GROUP BY 1")
def evidence_containment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").join(gold(spark, d), "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))


@query(f"WITH {GOLD} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM gold)")
def gate_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").join(gold(spark, d), "item_id", "left_anti").select("item_id")


@query(r"SELECT page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) body FROM pages")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    body = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\f\r]+", " "))
    return table(spark, d, "pages").select("page_id", "url", body.alias("body"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) fingerprint FROM documents")
def fingerprint_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("fingerprint"))


@query("SELECT doc_id, printf('%s_p%03d_300dpi', substr(sha256(text), 1, 12), doc_id % 50) cache_key FROM documents")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.format_string("%s_p%03d_300dpi", F.substring(F.sha2("text", 256), 1, 12), F.col("doc_id") % 50).alias("cache_key"))


@query("""SELECT source, value, votes FROM (SELECT source, value, votes, row_number() OVER (PARTITION BY source ORDER BY votes DESC, first) r FROM (
SELECT source, value, count(value)::BIGINT votes, min({'doc': doc_id, 'pos': pos}) first FROM (SELECT source, doc_id, unnest(v) value, generate_subscripts(v, 1) pos FROM (
SELECT source, doc_id, CASE WHEN len(v) = 0 THEN [NULL] ELSE v END v FROM (SELECT source, doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+') v FROM documents))) GROUP BY 1, 2)) WHERE r = 1""")
def field_vote(spark: SparkSession, d: str) -> DataFrame:
    """Of all matches in a source the most frequent; ties go to the value seen first."""
    return R.votes(table(spark, d, "documents"), "[0-9]+")


@query("""SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 2 = 0)""")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.join(e.filter("user_id % 2 = 0").select("event_id"), "event_id", "left_anti").select("event_id")


# these read the index and the rankings above
from tessera.plans import answers, encoders, grid, techniques, variants  # noqa: E402, F401
