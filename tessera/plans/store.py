"""Registered queries of the vector store, of prefixes and of decisions; documents stand for chunks, suppliers and lineitems for measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.operators import prefixes as P
from tessera.operators import store as S
from tessera.plans.evaluation import RUNS, runs
from tessera.plans.registry import over, query, table
from tessera.plans.sql import CLEAN

CHUNK = "printf('%s_p%02d_%d', source, doc_id % 50, doc_id)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    named = F.format_string("%s_p%02d_%d", "source", F.col("doc_id") % 50, "doc_id")
    return table(spark, d, "documents").select("doc_id", named.alias("chunk_id"), "source", F.col("doc_id").alias("page"), F.col("lang").alias("unit"), F.col("n_chars").alias("char_count"), "text")


@query(f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) point_id
FROM (SELECT doc_id, sha1(unhex('{S.URL_SPACE}') || encode({CHUNK})) h FROM documents)""")
def point_id(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", S.point_id(F.col("chunk_id")).alias("point_id"))


FIELDS = {"chunk_id": CHUNK, "source": "source", "page": "doc_id", "unit": "lang", "char_count": "n_chars"}
PAYLOAD = ", ".join(f"{FIELDS.get(f, 'NULL::VARCHAR')} {f}" for f in S.PAYLOAD)


@query(f"SELECT '{S.COLLECTION}none' \"collection\", {PAYLOAD}, text FROM documents")
def payload_projection(spark: SparkSession, d: str) -> DataFrame:
    """The points of the collection of the variant without prefixes."""
    return S.payload(chunks(spark, d)).select(F.lit(S.COLLECTION + "none").alias("collection"), "*")


@query(f"SELECT {PAYLOAD}, coalesce(text, '') AS \"text\" FROM documents")
def browse_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.payload(chunks(spark, d)).withColumn("text", F.coalesce("text", F.lit("")))


@query(f"SELECT {PAYLOAD}, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The points that a list of ids names, ids without a point left out."""
    asked = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("page"))
    return S.payload(chunks(spark, d).join(asked, "page", "left_semi"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 89 = 0 THEN upper(lang) ELSE lang END lang, source FROM documents WHERE doc_id % 97 != 0),
b AS (SELECT c.doc_id FROM documents c LEFT JOIN p USING (doc_id) WHERE p.doc_id IS NULL OR p.lang IS DISTINCT FROM c.lang OR p.source IS DISTINCT FROM c.source)
SELECT 'count' gate, abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM p))::BIGINT failing, NULL::BIGINT[] "first" WHERE failing > 0
UNION ALL SELECT 'payload', count(*)::BIGINT, list_sort(list(doc_id ORDER BY doc_id)[1:5]) FROM b HAVING count(*) > 0""")
def store_verify(spark: SparkSession, d: str) -> DataFrame:
    """The gates over a collection that lacks some points and has others changed."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    points = docs.filter("doc_id % 97 != 0").withColumn("lang", F.when(F.col("doc_id") % 89 == 0, F.upper("lang")).otherwise(F.col("lang")))
    return S.verify(docs, points, "doc_id", ["lang", "source"])


DENSE = {"model": "small", "pooling": "cls", "prefix": "", "max_length": 8190, "device": "cpu", "dtype": "float32"}
SPARSE = {"model": "small", "kind": "passage", "formula_version": 2, "max_length": 8190, "device": "cpu", "dtype": "float32"}


def _key_sql(made_by: dict) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    pairs = ", ".join(f"'{k}', {'text' if k == 'text' else value(made_by[k])}" for k in sorted([*made_by, "text"]))
    return f"substr(sha256(json_object({pairs})::VARCHAR), 1, 16)"


@query(f"SELECT doc_id, {_key_sql(DENSE)} dense_key, {_key_sql(SPARSE)} sparse_key FROM documents WHERE text IS NOT NULL")
def vector_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the cached vectors of each text; a row without text has no vector."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", S.cache_key(F.col("text"), **DENSE).alias("dense_key"), S.cache_key(F.col("text"), **SPARSE).alias("sparse_key"))


LEVEL = "SELECT floor(k / 4096)::BIGINT k, sha256(string_agg(h, '' ORDER BY k, h)) h, sum(n) n FROM ({}) GROUP BY 1"
LEVELS = LEVEL.format(LEVEL.format(LEVEL.format(LEVEL.format("SELECT coalesce(doc_id, -1) k, sha256(coalesce(text, '')) h, 1 n FROM documents"))))


@query(f"SELECT coalesce(sum(n), 0)::BIGINT chunk_count, sha256(coalesce(string_agg(h, '' ORDER BY k, h), '')) sha256 FROM ({LEVELS})")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return S.fingerprint(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT vec_id, i::INT i, round(embedding[i + 1]::DOUBLE, 6) cls, round(list_sum(list_transform(range(0, 4), lambda j: embedding[16 * j + i + 1]::DOUBLE * ((vec_id >> j) % 2))) / n, 6) "mean"
FROM (SELECT vec_id, embedding, nullif(bit_count(vec_id % 16), 0) n, unnest(range(0, 16)) i FROM embeddings WHERE embedding IS NOT NULL)""")
def pooled(spark: SparkSession, d: str) -> DataFrame:
    """Each vector read as the states of four tokens, of which the id's lowest bits mask some."""
    e = table(spark, d, "embeddings").filter("embedding is not null")
    states = F.array(*[F.slice("embedding", 16 * j + 1, 16) for j in range(4)])
    mask = F.array(*[F.shiftright("vec_id", j) % 2 for j in range(4)])
    both = F.arrays_zip(S.cls_pool(states).alias("c"), F.coalesce(S.mean_pool(states, mask), F.array_repeat(F.lit(None).cast("double"), 16)).alias("m"))
    rows = e.select("vec_id", F.posexplode(both).alias("i", "b"))
    return rows.select("vec_id", "i", F.round(F.col("b")["c"].cast("double"), 6).alias("cls"), F.round(F.col("b")["m"], 6).alias("mean"))


@query()
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    """Vectors on their first two axes; a decomposition has no SQL, pytest holds it against numpy."""
    points, shares = S.pca_2d(table(spark, d, "embeddings"), "vec_id", "embedding")
    return points.withColumns({"explained_x": F.lit(round(shares[0], 6)), "explained_y": F.lit(round(shares[1], 6))})


# Literal answers of a model: what wraps them, and pairs of a prefix and its chunk that meet each rule.
BEFORE, AFTER = ("السياق: ", "جملة  السياق : ", '"', "« "), ("", ' "', "”", " »")
SENTENCE = "يوضح هذا القسم خطوات طلب المواد من المستودع والجهات المسؤولة عنها"
TURNED = "المسؤولة عنها والجهات يوضح هذا القسم خطوات طلب المواد من المستودع"
PAIRS = (
    ("", SENTENCE), ("وصف قصير", SENTENCE), (SENTENCE, "نص آخر " * 40), ("This section tells how goods are ordered", SENTENCE), (SENTENCE + " 漢字", SENTENCE * 3),
    (SENTENCE + " تنفahi", SENTENCE * 3), (SENTENCE, "أولا " + SENTENCE + " ثم"), (TURNED, SENTENCE), ("بالتأكيد " + SENTENCE, "نص آخر " * 40), (SENTENCE * 5, SENTENCE), (SENTENCE, ""),
)


def _literal(values, index: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.expr(index).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_TIDIED = rf"""regexp_replace(translate(c, chr(10), ' '), '{P.LABEL}', '')"""
_QUOTED = P.QUOTES.replace("'", "''")


@query(rf"""SELECT doc_id, regexp_replace({_TIDIED}, '^[{_QUOTED}\s]+|[{_QUOTED}\s]+$', '', 'g') tidied FROM (SELECT doc_id, {CLEAN} c FROM (
SELECT doc_id, {_sql_list(BEFORE)}[doc_id % 4 + 1] || coalesce(text, '') || {_sql_list(AFTER)}[doc_id % 4 + 1] AS "text" FROM documents))""")
def prefix_tidy(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(_literal(BEFORE, "doc_id % 4"), F.coalesce("text", F.lit("")), _literal(AFTER, "doc_id % 4"))
    return table(spark, d, "documents").select("doc_id", P.tidy(raw).alias("tidied"))


_OPENED = " OR ".join(f"starts_with(lower(p), '{o}')" for o in P.OPENINGS)
_WORDS = r"list_distinct(regexp_extract_all({}, '[^\s]+'))"


@query(f"""SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < {P.SHORTEST} OR n > {P.LONGEST} THEN 'length'
WHEN round(len(regexp_extract_all(p, '{T.ARABIC_ALL}')) / n::DOUBLE, 6) < 0.5 THEN 'arabic_ratio' WHEN round(len(regexp_extract_all(p, '{T.FOREIGN}')) / n::DOUBLE, 6) > 0.01 THEN 'off_script_ratio'
WHEN regexp_matches(p, '{P.MIXED}') THEN 'mixed_script' WHEN contains(c, p) THEN 'verbatim'
WHEN n / nullif(length(c), 0)::DOUBLE > 0.75 AND len(list_intersect({_WORDS.format('p')}, {_WORDS.format('c')})) / len({_WORDS.format('p')})::DOUBLE > 0.9 THEN 'copied' WHEN {_OPENED} THEN 'preamble' END reason
FROM (SELECT *, length(p) n FROM (SELECT doc_id, {_sql_list(p for p, _ in PAIRS)}[doc_id % {len(PAIRS)} + 1] p, {_sql_list(c for _, c in PAIRS)}[doc_id % {len(PAIRS)} + 1] c FROM documents))""")
def validate_prefix(spark: SparkSession, d: str) -> DataFrame:
    at = f"doc_id % {len(PAIRS)}"
    return table(spark, d, "documents").select("doc_id", P.rejected(_literal([p for p, _ in PAIRS], at), _literal([c for _, c in PAIRS], at)).alias("reason"))


_SHAPES = ["concat('دليل ', source, '، ', lang, '، صفحة ', doc_id)", "concat('دليل ', source, '، صفحة ', doc_id)", "concat(lang, '، صفحة ', doc_id)", "concat(source, '، ', lang)", "concat(source, ' None ')", "''"]
_SHAPE = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES))
_PREFIXED = f"SELECT doc_id, lang, CASE WHEN doc_id % 31 != 0 THEN source END title, CASE doc_id % 6 {_SHAPE} END prefix FROM documents"


@query(f"""SELECT doc_id, CASE WHEN coalesce(prefix, '') = '' THEN 'empty' WHEN contains(prefix, 'None') THEN 'None' WHEN title IS NULL THEN 'untitled' WHEN NOT contains(prefix, title) THEN 'manual'
WHEN coalesce(lang, '') != '' AND NOT contains(prefix, lang) THEN 'section' WHEN NOT contains(prefix, 'صفحة') AND NOT contains(prefix, 'صفحات') THEN 'page' END reason FROM ({_PREFIXED})""")
def template_gate(spark: SparkSession, d: str) -> DataFrame:
    return over(spark, d, _PREFIXED, "documents").select("doc_id", P.template_gate(F.col("prefix"), F.col("title"), F.col("lang")).alias("reason"))


@query(f"""SELECT source, cut, sha256(CASE WHEN cut THEN substr(t, 1, greatest(allowed, 0)) ELSE t END) body_sha256 FROM (SELECT *, length(t) > allowed cut FROM (
SELECT source, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) t, {P.PROMPT} - length(source) - max(length(coalesce(text, ''))) - 400 allowed FROM documents WHERE source IS NOT NULL GROUP BY 1))""")
def section_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source is not null")
    return P.section_budget(docs, "source", "doc_id", F.col("source"), 400).select("source", "cut", F.sha2("body", 256).alias("body_sha256"))


@query("""SELECT source, count(*)::BIGINT prefixes, max(CASE WHEN r = n // 2 THEN l END)::BIGINT median, max(l)::BIGINT longest FROM (SELECT source, l, row_number() OVER (PARTITION BY source ORDER BY l) - 1 r, count(*) OVER (PARTITION BY source) n
FROM (SELECT source, length(concat('source ', source, ', language ', lang, ', ', n_chars)) l FROM documents)) GROUP BY 1""")
def prefix_stats(spark: SparkSession, d: str) -> DataFrame:
    """Upper median and longest prefix of each source, from counts of each length."""
    n = F.char_length(F.concat(F.lit("source "), F.coalesce("source", F.lit("")), F.lit(", language "), F.coalesce("lang", F.lit("")), F.lit(", "), F.coalesce(F.col("n_chars").cast("string"), F.lit(""))))
    sizes = table(spark, d, "documents").groupBy("source", n.alias("l")).agg(F.count("*").alias("c"))
    run = sizes.withColumns({"hi": F.sum("c").over(Window.partitionBy("source").orderBy("l")), "n": F.sum("c").over(Window.partitionBy("source"))})
    middle = F.max(F.when((F.col("hi") - F.col("c") <= F.expr("n div 2")) & (F.expr("n div 2") < F.col("hi")), F.col("l")))
    return run.groupBy("source").agg(F.max("n").alias("prefixes"), middle.cast("bigint").alias("median"), F.max("l").cast("bigint").alias("longest"))


@query(r"SELECT source, count(*) FILTER (len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 512)::BIGINT over_limit, count(*)::BIGINT total FROM documents GROUP BY 1")
def truncation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of more words than an encoder reads, of all."""
    over = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) > 512
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(over).alias("over_limit"), F.count("*").alias("total"))


# A supplier is a measured candidate: differences of two metrics with the half width of their intervals.
MEASURED = """SELECT s_suppkey, s_nationkey, round(s_acctbal / 10000 - 0.2, 4) recall, round(s_acctbal / 8000 - 0.1 + (s_suppkey % 5 - 2) / 10, 4) mrr, (s_suppkey % 7) / 10 half FROM supplier"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    return over(spark, d, MEASURED.replace("/ 10 ", "/ 10.0D ").replace("/ 10,", "/ 10.0D,"), "supplier")


_CLEAR = "(recall - half > 0 OR recall + half < 0) AND (mrr - half > 0 OR mrr + half < 0)"


@query(f"""SELECT s_suppkey, CASE WHEN clear AND (recall > 0) = (mrr > 0) AND recall <= 0 THEN 'b' ELSE 'a' END winner, CASE WHEN clear AND (recall > 0) = (mrr > 0) THEN 'measurement' WHEN clear THEN 'disagreed' ELSE 'tie' END basis
FROM (SELECT *, {_CLEAR} clear FROM ({MEASURED}))""")
def decide(spark: SparkSession, d: str) -> DataFrame:
    """The preferred model a, unless both intervals exclude zero and both lead to b."""
    return measured(spark, d).select("s_suppkey", *E.decided("recall", "mrr", "half"))


@query(f"""SELECT n_nationkey nation, coalesce(arg_max(s_suppkey, (recall, -s_suppkey)) FILTER (recall - half > 0 AND mrr - half > 0)::VARCHAR, 'baseline') chosen
FROM nation LEFT JOIN ({MEASURED}) ON s_nationkey = n_nationkey GROUP BY 1""")
def choose_shipping(spark: SparkSession, d: str) -> DataFrame:
    """Of the candidates that beat the baseline on both metrics the one that gains most recall, the first of equals; else the baseline."""
    wins = F.expr("recall - half > 0 and mrr - half > 0")
    best = F.max_by("s_suppkey", F.when(wins, F.struct("recall", -F.col("s_suppkey"))))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey")).join(measured(spark, d), "s_nationkey", "left")
    return rows.groupBy(F.col("s_nationkey").alias("nation")).agg(F.coalesce(best.cast("string"), F.lit("baseline")).alias("chosen"))


@query("""SELECT l_returnflag kind, count(*)::BIGINT n, round(avg(CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE END), 6) recall, round(avg(CASE WHEN l_quantity > 25 THEN 0.0 ELSE 1.0 END::DOUBLE), 6) block_rate FROM lineitem GROUP BY 1""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the positive class by kind (null where a kind has none) and the share that a gate blocks."""
    said = F.col("l_quantity") > 25
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(*E.calibrated(said, F.col("l_linestatus") == "O"))


METRICS = ("click", "purchase", "signup", "view")
_SHOWN = ", ".join(f"coalesce(printf('%.3f', max(CASE WHEN metric = '{m}' THEN round(score, 3) END)), 'N/A') {m}" for m in METRICS)


@query(f"""SELECT CASE WHEN place <= 10 THEN 'required' ELSE 'supplementary' END part, place, arm, {_SHOWN} FROM (SELECT *, substr(qid, 2)::INT place FROM {RUNS}) GROUP BY place, arm""")
def result_tables(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question and arm, scores to three places or N/A, in the required table or the supplementary one."""
    return E.result_rows(runs(spark, d), "qid", "arm", METRICS)
