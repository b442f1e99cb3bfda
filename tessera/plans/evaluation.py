"""Registered queries of evaluation, ledgers, gates and layout; events stand for calls and runs, lineitems for fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.plans.registry import over, query, table
from tessera.plans.sql import TOK

NAMES = ", ".join(f"({i}, '{s}')" for i, s in enumerate((*E.STEPS, "TOTAL")))
CALL = "SELECT event_id, user_id, ['{}'][CAST(event_id % 13 + 1 AS INT)] step, CAST(CASE WHEN event_id % 13 = 6 AND event_id % 4 != 0 OR event_id % 29 = 0 THEN 0 ELSE event_id % 97 + 1 END AS BIGINT) prompt_tokens, event_id % 31 completion_tokens, value latency FROM events".format("', '".join(E.STEPS[:13]))
SPARK_CALL = CALL.replace("['", "array('", 1).replace("'][", "')[", 1).replace("13 + 1", "13", 1)
COST = "(prompt_tokens * 1.0::DOUBLE + completion_tokens * 5.0::DOUBLE) / 1000000.0::DOUBLE"
LEDGER = f"""c AS ({CALL}), l AS (SELECT CASE WHEN grouping(step) = 1 THEN 'TOTAL' ELSE step END step, count(*) calls, sum(prompt_tokens + completion_tokens) tokens, sum(latency) latency, sum({COST}) cost FROM c GROUP BY ROLLUP (step)),
w AS (SELECT s.step, place::INT place, calls IS NOT NULL executed, coalesce(calls, 0)::BIGINT calls, coalesce(tokens, 0)::BIGINT tokens, coalesce(round(latency, 4), 0) latency, coalesce(round(cost, 6), 0) cost FROM (VALUES {NAMES}) s(place, step) LEFT JOIN l ON l.step = s.step)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    return over(spark, d, SPARK_CALL, "events")


@query(f"WITH {LEDGER} SELECT * FROM w")
def ledger_steps(spark: SparkSession, d: str) -> DataFrame:
    """One row for each declared step in order, zeros where it never ran, and the total."""
    return E.ledger_rows(calls(spark, d))


@query(f"WITH {LEDGER} SELECT * FROM w WHERE step IN {(*E.SPEC, 'TOTAL')}")
def ledger_spec(spark: SparkSession, d: str) -> DataFrame:
    """The short table; its total still sums every step."""
    return E.ledger_rows(calls(spark, d)).filter(F.col("step").isin(*E.SPEC, "TOTAL"))


@query(f"""WITH c AS ({CALL}) SELECT user_id, 'Final generation never ran' failure FROM c GROUP BY 1 HAVING bool_or(step NOT IN ('Contextualisation', 'Evaluation judge')) AND NOT bool_or(step = 'Final generation')
UNION ALL SELECT user_id, CASE WHEN step = 'Reranking' THEN step || ' is a local step but spent tokens' ELSE step || ' recorded a call with no input tokens' END FROM c WHERE (step = 'Reranking') = (prompt_tokens > 0)""")
def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    return E.ledger_failures(calls(spark, d), "user_id")


@query("""SELECT event_id, """ + ", ".join(f"round((event_id % 97 * {a}::DOUBLE + event_id % 31 * {b}::DOUBLE) / 1000000.0::DOUBLE, 9) {name}_usd" for name, (a, b) in E.CARDS.items()) + " FROM events")
def price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *[F.round(E.price(F.col("event_id") % 97, F.col("event_id") % 31, c), 9).alias(f"{c}_usd") for c in E.CARDS])


@query(f"""WITH c AS ({CALL}) SELECT step, count(*)::BIGINT n_runs, round(sum(cost), 6) cost, round(sum(latency), 4) latency FROM (SELECT user_id, step, sum({COST}) cost, sum(latency) latency FROM c GROUP BY 1, 2) GROUP BY 1""")
def technique_cost(spark: SparkSession, d: str) -> DataFrame:
    """Totals of steps over runs; n_runs counts runs that used the step, not its calls."""
    runs = calls(spark, d).groupBy("user_id", "step").agg(F.sum(E.price(F.col("prompt_tokens"), F.col("completion_tokens"))).alias("cost"), F.sum("latency").alias("latency"))
    return runs.groupBy("step").agg(F.count("*").alias("n_runs"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.sum("latency"), 4).alias("latency"))


RUNS = "(SELECT ['basic', 'adaptive', 'forced'][CAST(event_id % 3 + 1 AS INT)] arm, concat('Q', CAST(event_id // 3 % 40 + 1 AS VARCHAR)) qid, event_type metric, avg(CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END) score FROM events WHERE event_id % 11 != 0 GROUP BY 1, 2, 3)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    arm = F.element_at(F.array(*map(F.lit, E.ARMS)), (F.col("event_id") % 3 + 1).cast("int"))
    qid = F.concat(F.lit("Q"), F.expr("event_id div 3 % 40 + 1").cast("string"))
    rows = table(spark, d, "events").filter("event_id % 11 != 0")
    return rows.groupBy(arm.alias("arm"), qid.alias("qid"), F.col("event_type").alias("metric")).agg(F.avg(F.when(F.col("user_id") % 5 != 0, F.col("value"))).alias("score"))


@query(f"""SELECT coalesce(arg_max(arm, (m, -o)), 'not determinable') best FROM (SELECT arm, list_position(['basic', 'adaptive', 'forced'], arm) o, avg(score) m FROM {RUNS} GROUP BY 1) WHERE m IS NOT NULL""")
def best_arm(spark: SparkSession, d: str) -> DataFrame:
    return E.best_arm(runs(spark, d), "score")


@query(f"""SELECT metric, count(*)::BIGINT n, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, round(avg(a - b), 6) diff, count(*) FILTER (a > b)::BIGINT a_wins FROM (
SELECT x.metric, x.score a, y.score b FROM {RUNS} x JOIN {RUNS} y ON x.qid = y.qid AND x.metric = y.metric AND x.arm = 'adaptive' AND y.arm = 'basic' WHERE x.score IS NOT NULL AND y.score IS NOT NULL) GROUP BY 1""")
def compare_arms(spark: SparkSession, d: str) -> DataFrame:
    keyed = runs(spark, d).withColumn("k", F.struct("metric", "qid"))
    paired = E.pairs(keyed, "adaptive", "basic", "k", "score")
    return paired.groupBy("k.metric").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("diff"), F.count_if(F.col("a") > F.col("b")).alias("a_wins"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the paired differences, by metric; resampling has no SQL, pytest holds it against numpy."""
    keyed = runs(spark, d).withColumn("k", F.struct("metric", "qid"))
    return E.bootstrap(E.pairs(keyed, "adaptive", "basic", "k", "score").select("k.metric", "k.qid", "a", "b"), "metric", "qid")


@query(f"""SELECT e.arm, e.qid, CASE WHEN r.qid IS NULL THEN 'MISSING' ELSE coalesce(r.shown, 'N/A') END shown FROM (SELECT arm, concat('Q', q) qid FROM (SELECT unnest(['basic', 'adaptive', 'forced']) arm), (SELECT unnest(range(1, 46)) q)) e
LEFT JOIN (SELECT arm, qid, round(score, 2)::DECIMAL(18,2)::VARCHAR shown FROM {RUNS} WHERE metric = 'purchase') r ON r.arm = e.arm AND r.qid = e.qid""")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """Every question of every arm, those without a run among them."""
    expected = spark.range(1, 46).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("qid")).withColumn("arm", F.explode(F.array(*map(F.lit, E.ARMS))))
    found = runs(spark, d).filter("metric = 'purchase'").select("arm", "qid", F.round("score", 2).cast("decimal(18,2)").alias("shown"))
    return E.fill_missing(expected, found, ["arm", "qid"], ["shown"])


SCORES = "(SELECT vec_id, label, round(embedding[1]::DOUBLE, 3) s FROM embeddings)"


@query(f"""SELECT vec_id, round((s + coalesce(n, s + 0.02)) / 2, 6) threshold, below::BIGINT others_below FROM {SCORES} JOIN (SELECT s, lead(s) OVER (ORDER BY s) n, coalesce(sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM (SELECT s, count(*) c FROM {SCORES} GROUP BY 1)) USING (s)""")
def crag_threshold(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("s"))
    return E.crag_threshold(scores, "vec_id", "s")


@query(f"""SELECT label, round((coalesce(tp / nullif(p, 0)::DOUBLE, 0) + coalesce(tn / nullif(q, 0)::DOUBLE, 0)) / 2, 6) balanced, round((tp + tn) / (p + q)::DOUBLE, 6) share FROM (
SELECT label, count(*) FILTER (t) p, count(*) FILTER (NOT t) q, count(*) FILTER (t AND s > 0) tp, count(*) FILTER (NOT t AND s <= 0) tn FROM (SELECT label, s, vec_id % 3 = 0 t FROM {SCORES}) GROUP BY 1)""")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy and share right, by kind; a class without rows counts 0."""
    t, s = F.col("vec_id") % 3 == 0, F.round(F.get("embedding", F.lit(0)).cast("double"), 3)
    rate = lambda right, of: F.coalesce(F.count_if(right & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.round((rate(s > 0, t) + rate(s <= 0, ~t)) / 2, 6).alias("balanced"), F.round(F.count_if((s > 0) == t) / F.count("*"), 6).alias("share"))


@query("""SELECT conv_id, coalesce(sum(length(text)), 0) / 2.5::DOUBLE > 6692 too_long, (16980 - 500 - coalesce(sum(length(text)) FILTER (role = 'user'), 0))::BIGINT budget FROM conversations GROUP BY 1""")
def over_budget(spark: SparkSession, d: str) -> DataFrame:
    """Whether a context is too long, and the characters left beside a template and the history."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n"), F.sum(F.when(F.col("role") == "user", F.char_length("text"))).alias("h"))
    return g.select("conv_id", E.over_budget(F.col("n")).alias("too_long"), E.budget(F.col("h"), 500).cast("bigint").alias("budget"))


@query("""SELECT doc_id, lang "type", source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1 f FROM documents) ORDER BY f DESC, CASE WHEN f THEN lang END, CASE WHEN f THEN source END, doc_id LIMIT 60""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("type"), "source")
    return E.stratified(rows, 60).select(F.col("seq").alias("doc_id"), "type", "source")


PAGED = "(SELECT doc_id chunk_id, source slug, doc_id % 40 page, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE doc_id % 40 + 2 END end_page FROM documents)"


@query(f"""SELECT q.slug, q.asked, chunk_id FROM (SELECT DISTINCT source slug, doc_id % 45 asked FROM documents) q JOIN {PAGED} c ON c.slug = q.slug AND page <= asked AND asked <= coalesce(nullif(end_page, 0), page)""")
def chunks_on_page(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    page = F.col("doc_id") % 40
    end = F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 2, page + 2)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("slug"), page.alias("page"), end.alias("end_page"))
    asked = docs.select(F.col("source").alias("slug"), (F.col("doc_id") % 45).alias("asked")).distinct()
    return E.chunks_on_page(chunks, asked).select("slug", "asked", "chunk_id")


@query("""SELECT field, count(*)::BIGINT moved FROM (SELECT 'lang' field, a.lang x, b.lang y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0
UNION ALL SELECT 'source', a.source, b.source FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0
UNION ALL SELECT 'n_chars', a.n_chars::VARCHAR, b.n_chars::VARCHAR FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0) WHERE x IS DISTINCT FROM y GROUP BY 1""")
def metadata_moves(spark: SparkSession, d: str) -> DataFrame:
    """How many of the same chunks differ between two builds (even and odd documents), by field."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 2").alias("slot"), (F.col("doc_id") % 2).alias("build"), F.posexplode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in ("lang", "source", "n_chars")])).alias("i", "f"))
    sides = docs.select("slot", "build", "f.field", "f.v")
    both = sides.filter("build = 0").withColumnRenamed("v", "a").join(sides.filter("build = 1").withColumnRenamed("v", "b"), ["slot", "field"])
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("field").agg(F.count("*").alias("moved"))


@query("""SELECT source FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 5)""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the corpus that no gold chunk is from."""
    docs = table(spark, d, "documents")
    return docs.select("source").distinct().join(docs.filter("doc_id % 97 = 5").select("source"), "source", "left_anti")


@query("""SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) = 0 THEN 'no text' WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN n > 1 THEN 'duplicate' WHEN turn > 0 AND prev IS NULL THEN 'order' ELSE 'ok' END gate FROM (
SELECT *, count(*) OVER (PARTITION BY conv_id, turn) n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) prev FROM conversations)""")
def golden_gates(spark: SparkSession, d: str) -> DataFrame:
    """The first gate that each question fails: text, closed lists, duplicates, and that what it depends on came before."""
    w = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").withColumns({"n": F.count("*").over(w.partitionBy("conv_id", "turn")), "prev": F.lag("turn").over(w.orderBy("turn"))})
    gate = (
        F.when(F.char_length(F.coalesce("text", F.lit(""))) == 0, "no text").when(~F.col("role").isin("user", "assistant"), "role").when(F.col("n") > 1, "duplicate")
        .when((F.col("turn") > 0) & F.col("prev").isNull(), "order").otherwise("ok")
    )
    return rows.select("conv_id", "turn", gate.alias("gate"))


@query(f"""SELECT lang variant, n::BIGINT n, (CASE WHEN n % 2 = 1 THEN l[n // 2 + 1] ELSE (l[n // 2] + l[n // 2 + 1]) / 2.0 END)::DOUBLE median, l[(0.9 * (n - 1))::DECIMAL(18,1)::DOUBLE::INT + CASE WHEN (0.9 * (n - 1))::DECIMAL(18,1)::DOUBLE::INT > 0.9 * (n - 1) THEN 0 ELSE 1 END]::BIGINT p90, l[n]::BIGINT most, len(list_filter(l, lambda t: t > 400))::BIGINT n_over FROM (
SELECT lang, count(*) n, list_sort(list(len({TOK}))) l FROM documents GROUP BY 1)""")
def token_census(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a text by variant (here language): median, sorted[int(0.9 * (n - 1))], the most, and how many are over a limit.

    From counts of each length, as the chunk census."""
    sizes = table(spark, d, "documents").groupBy(F.col("lang").alias("variant"), F.size(T.tokens(F.col("text"))).cast("bigint").alias("t")).agg(F.count("*").alias("c"))
    up = Window.partitionBy("variant").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = sizes.withColumns({"hi": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy("variant"))}).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda i: F.max(F.when((F.col("lo") <= F.expr(i)) & (F.expr(i) < F.col("hi")), F.col("t")))
    return run.groupBy("variant", "n").agg(((at("(n - 1) div 2") + at("n div 2")) / 2).alias("median"), at("9 * (n - 1) div 10").alias("p90"), F.max("t").alias("most"), F.coalesce(F.sum(F.when(F.col("t") > 400, F.col("c"))), F.lit(0)).alias("n_over"))


BOX = "[l_discount * 10, l_tax * 10, l_discount * 10 + l_quantity, l_tax * 10 + l_quantity / 2]"


@query(f"""SELECT l_orderkey, list_min(list_transform(b, lambda x: x[1])) x0, list_min(list_transform(b, lambda x: x[2])) y0, list_max(list_transform(b, lambda x: x[3])) x1, list_max(list_transform(b, lambda x: x[4])) y1,
len(list_filter(b, lambda x: abs(x[1] - b[1][1]) <= 2 AND abs(x[2] - b[1][2]) <= 2 AND abs(x[3] - b[1][3]) <= 2 AND abs(x[4] - b[1][4]) <= 2))::BIGINT alike FROM (SELECT l_orderkey, list_sort(list({BOX})) b FROM lineitem GROUP BY 1)""")
def rect_union(spark: SparkSession, d: str) -> DataFrame:
    """The rectangle around an order's lines, and how many lie as the first one does, within two points."""
    box = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_discount") * 10 + F.col("l_quantity"), F.col("l_tax") * 10 + F.col("l_quantity") / 2)
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(box)).alias("b"))
    whole = E.union_box(F.col("b"))
    alike = F.size(F.filter("b", lambda x: E.boxes_match(x, F.get("b", F.lit(0))))).cast("bigint")
    return g.select("l_orderkey", *[F.get(whole, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], alike.alias("alike"))


@query("""SELECT l_orderkey, l_suppkey, l_quantity, i::INT band, round(l_tax + l_quantity / greatest(n, 1) * i, 6) top, round(l_tax + l_quantity / greatest(n, 1) * (i + 1), 6) bottom FROM (SELECT *, l_partkey % 5 - 1 n, unnest(range(0, greatest(l_partkey % 5 - 1, 1))) i FROM lineitem)""")
def row_bands(spark: SparkSession, d: str) -> DataFrame:
    """A table's box in equal bands, one a row."""
    li = table(spark, d, "lineitem")
    box = F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_discount"), F.col("l_tax") + F.col("l_quantity"))
    made = li.select("l_orderkey", "l_suppkey", "l_quantity", F.posexplode(E.bands(box, (F.col("l_partkey") % 5 - 1).cast("int"))).alias("band", "b"))
    return made.select("l_orderkey", "l_suppkey", "l_quantity", "band", F.round(F.get("b", F.lit(1)), 6).alias("top"), F.round(F.get("b", F.lit(3)), 6).alias("bottom"))


@query("""SELECT f.o_orderkey fragment_id, min(s.s_suppkey) rect_id FROM orders f JOIN supplier s ON f.o_custkey % 10 = s.s_suppkey % 10 WHERE f.o_totalprice % 1000 BETWEEN s.s_acctbal % 500 AND s.s_acctbal % 500 + 300 AND f.o_totalprice % 70 BETWEEN 5 AND 60 GROUP BY 1""")
def claim_in_rect(spark: SparkSession, d: str) -> DataFrame:
    """Fragments (orders) whose centre lies in rectangles (suppliers) of their page, each claimed once."""
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    x, y = F.col("o_totalprice") % 1000, F.col("o_totalprice") % 70
    fragments = o.select((F.col("o_custkey") % 10).alias("page"), F.col("o_orderkey").alias("fragment_id"), x.alias("x0"), x.alias("x1"), y.alias("y0"), y.alias("y1"))
    left = F.col("s_acctbal") % 500
    rects = s.select((F.col("s_suppkey") % 10).alias("page"), F.col("s_suppkey").alias("rect_id"), left.alias("rx0"), (left + 300).alias("rx1"), F.lit(5.0).alias("ry0"), F.lit(60.0).alias("ry1"))
    return E.claimed(fragments, rects)


@query("""SELECT page, line::INT line, string_agg(t, ' ' ORDER BY x DESC, id) "text" FROM (SELECT *, sum(CASE WHEN abs(cy - p) > 3.6 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY cy, id) line FROM (
SELECT *, lag(cy) OVER (PARTITION BY page ORDER BY cy, id) p FROM (SELECT o_custkey page, o_orderkey id, o_orderstatus || o_orderkey t, o_totalprice % 90 x, o_totalprice % 700 cy FROM orders))) GROUP BY 1, 2""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a page (here a customer's orders) from the places of its fragments."""
    y, x = F.col("o_totalprice") % 700, F.col("o_totalprice") % 90
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("fragment_id"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("text"), x.alias("x1"), y.alias("y0"), y.alias("y1"))
    return E.reading_lines(rows, 3.6)


@query()
def mmr(spark: SparkSession, d: str) -> DataFrame:
    """Ten diverse picks of each question's fifty nearest vectors; greedy, so pytest holds it against a plain walk."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    near = R.dense(asked, e, 50).select("qid", "vec_id")
    return R.mmr(near.join(asked, "qid").join(e.select("vec_id", "embedding"), "vec_id"))
