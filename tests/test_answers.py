"""Claims, extracts, techniques, stores that are written again, encoders and steps of sessions, by hand and by plain walks."""

import hashlib
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import encoders as V
from tessera.operators import entailment as N
from tessera.operators import techniques as Q
from tessera.sources.keyed import KeyedTable, read_through
from tessera.streaming import events


def test_numbers_without_gaps(spark):
    keys = [-5, 0, 3, 4, 10**12, 10**12 + 1]
    got = N.numbered(spark.createDataFrame([(k,) for k in keys], "qid long"), "qid", parts=4).collect()
    assert {r.qid: r.nth for r in got} == {k: i for i, k in enumerate(keys)}
    assert N.numbered(spark.createDataFrame([], "qid long"), "qid").count() == 0


def test_benchmark_turns_half_the_list(spark):
    rows = [(1, "it costs 5 coins today. no", "gold one"), (2, "two words here.", ""), (7, "nothing is said in it", "gold seven"), (9, None, "gold nine"), (12, "last one speaks ٣ times", "gold twelve")]
    got = N.benchmark(spark.createDataFrame(rows, "qid long, answer string, premise string")).collect()
    assert sorted((r.question_id, r.kind, r.nth, r.premise, r.hypothesis, r.label) for r in got) == sorted([
        # five questions: two places on, so the first meets the third, the last the second, which has no gold
        (1, "positive", 0, "gold one", "it costs 5 coins today", True), (1, "negative_topic", 0, "gold seven", "it costs 5 coins today", False), (1, "negative_number", 0, "gold one", "it costs 42 coins today", False),
        (7, "positive", 0, "gold seven", "nothing is said in it", True), (7, "negative_topic", 0, "gold twelve", "nothing is said in it", False),
        (12, "positive", 0, "gold twelve", "last one speaks ٣ times", True), (12, "negative_number", 0, "gold twelve", "last one speaks 40 times", False),
    ])
    alone = N.benchmark(spark.createDataFrame([(4, "only one question here", "gold")], "qid long, answer string, premise string")).collect()
    assert [r.kind for r in alone] == ["positive"]


def test_premises_scores_and_summaries(spark):
    answers = [(1, "pay five coins [2][1] [2]. wait [9]. [1]! plain. take 7 days [1] [01]"), (2, "[1]"), (3, None), (4, "lost words [1]")]
    markers = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (4, 1, "gone")]
    chunks = [("a", "coins and 7 long days"), ("b", "pay five"), ("c", "x")]
    pairs = N.premise_pairs(spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame(markers, "answer_id long, marker int, chunk_id string"), spark.createDataFrame(chunks, "chunk_id string, text string"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 0, "pay five\ncoins and 7 long days", "pay five coins"), (1, 4, "coins and 7 long days", "take 7 days")]
    score = N.contained_share(F.col("premise"), F.col("hypothesis"))
    assert {r.nth: r.s for r in pairs.select("nth", score.alias("s")).collect()} == {0: 1.0, 4: 0.666667}
    got = N.summary(pairs, score, 0.9).first()
    assert (got.checked, got.entailed, got.failed_sentences) == (2, 1, ["take 7 days"])
    # a number that the premise lacks outweighs all words
    assert spark.range(1).select(N.contained_share(F.lit("pay 5 coins"), F.lit("pay 50 coins"))).first()[0] == 0.0


def test_extracts_must_stand_in_their_chunk(spark):
    chunk = "First  line\nof the text. Second line."
    tries = {"line of the": ("line of the", True), '  "First line\n of" ': ("First line\n of", True), "": (chunk, False), " none ": (chunk, False), "“”": (chunk, False), "another": (chunk, False), None: (chunk, False), "Second line.": ("Second line.", True)}
    df = spark.createDataFrame([(t, chunk) for t in tries], "e string, text string").withColumn("kept", N.verified(F.col("text"), F.col("e")))
    assert {r.e: tuple(r.kept) for r in df.collect()} == tries
    trace = N.compress_trace(df.withColumn("k", F.lit(1)), "k").first()
    n = len(chunk)
    after = 11 + 14 + 12 + 5 * n
    assert (trace.chars_before, trace.chars_after, trace.rewritten, trace.kept_whole, trace.tokens_removed) == (8 * n, after, 3, 5, int((8 * n - after) / 2.5))


def test_techniques_by_route(spark):
    cases = [("basic_rag", ["CRAG"], None, []), ("advanced_rag", None, None, ["Reranking"]), ("advanced_rag", ["CRAG", "Magic", "HyDE"], None, ["HyDE", "Reranking", "CRAG"]), ("simple", [], ["Compression", "Rewriting"], ["Rewriting", "Compression"]), ("advanced_rag", ["CRAG"], [], [])]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, r string, a array<string>, o array<string>")
    got = {x.i: (x.t, x.s) for x in df.select("i", Q.resolved(F.col("r"), F.col("a"), F.col("o")).alias("t")).withColumn("s", Q.strategy(F.col("t"))).collect()}
    assert [got[i][0] for i in range(len(cases))] == [c[3] for c in cases] and got[2][1] == "HyDE" and got[0][1] is None
    low = [(None, None, True), (0.5, True, True), (0.5, False, False), (0.7, True, False), (0.6, True, False)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(low)], "i int, s double, a boolean").select("i", Q.low_confidence(F.col("s"), F.col("a"), 0.6).alias("l")).collect()
    assert {r.i: r.l for r in rows} == {i: c for i, (_, _, c) in enumerate(low)}


DOCS = [(1, "alpha beta gamma delta"), (2, "one two three four"), (3, None)]


def retrieve(spark, calls):
    """Ranks by shared words; remembers what it was asked."""
    def run(asked, k):
        rows = asked.collect()
        calls.append({r.qid: r.text for r in rows})
        out = []
        for r in rows:
            scored = sorted((-len(set(r.text.split()) & set((t or "").split())), i) for i, t in DOCS)[:k]
            out += [(r.qid, i, float(-s), n + 1) for n, (s, i) in enumerate(scored)]
        return spark.createDataFrame(out, "qid long, doc_id long, score double, rnk int")
    return run


def test_correction_settles_or_refuses(spark):
    calls = []
    asked = spark.createDataFrame([(1, "alpha beta x y"), (2, "q w e r t one two"), (3, "z z z"), (4, "only unknown words here")], "qid long, text string")
    docs, find = spark.createDataFrame(DOCS, "doc_id long, text string"), retrieve(spark, calls)
    half = lambda c: F.array_join(F.slice(F.split(c, " "), 6, 9), " ")
    ranked, trace = Q.crag(asked, find(asked, 2).where("qid != 4"), docs, find, half)
    got = {r.qid: (r.verdict, r.requery_text, r.requery_verdict, r.requeried, r.refused) for r in trace.collect()}
    # a rephrasing that comes out blank asks the same again; a question without candidates is graded incorrect
    assert got == {1: ("correct", "", "", False, False), 2: ("ambiguous", "one two", "correct", True, False), 3: ("incorrect", "z z z", "incorrect", True, True), 4: ("incorrect", "only unknown words here", "incorrect", True, True)}
    assert {r.qid for r in ranked.collect()} == {1, 2} and calls[1] == {2: "one two", 3: "z z z", 4: "only unknown words here"}
    ranked, trace = Q.crag(asked, find(asked, 2), docs, find, half, requeries=0)
    assert {r.qid for r in ranked.collect()} == {1} and not any(r.requeried for r in trace.collect())


def test_pipeline_asks_once_for_all(spark):
    calls = []
    rows = [(1, "alpha beta", "simple", []), (2, "one two", "basic_rag", []), (3, "gamma delta", "advanced_rag", ["Multi-Query", "HyDE", "Reranking"]), (4, "zzz", "advanced_rag", ["Rewriting", "Compression", "CRAG"])]
    asked = spark.createDataFrame(rows, "qid long, text string, route string, techniques array<string>").withColumn("history", F.lit("four one"))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    same = lambda c: F.array(c, F.lit("three"))
    answers, trace = Q.pipeline(asked, docs, retrieve(spark, calls), F.concat("history", F.lit(" two"), F.lit("")), same, same, lambda c: c, lambda c: c, lambda q, t: F.lit("two three"))
    assert calls[0] == {16: "one two", 24: "gamma delta", 25: "three", 32: "four one two"}
    top = {(r.qid, r.doc_id): r.text for r in answers.where("rnk = 1").collect()}
    assert top == {(2, 2): "one two three four", (3, 1): "alpha beta gamma delta", (4, 2): "two three"}
    assert {r.qid: (r.executed, r.refused) for r in trace.collect()} == {1: ([], False), 2: ([], False), 3: (["Multi-Query", "Reranking"], False), 4: (["Rewriting", "Compression", "CRAG"], False)}


def test_a_table_written_again(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path / "t"), "k", "k string, v int")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert kept.read().count() == 0 and kept.upsert(rows(("a", 1), ("b", 2), ("a", 1), (None, 5)))
    assert not kept.upsert(rows(("b", 2), ("a", 1))) and kept.batches() == [1]
    assert kept.upsert(rows(("b", 3), ("a", 1), ("c", None), ("b", 4))) and kept.batches() == [1, 2]
    want = [("a", 1, 1), ("b", 4, 2), ("c", None, 2)]
    assert sorted(map(tuple, kept.read(batch=True).collect())) == want
    # a run killed while it wrote: files, but no mark that they are whole
    rows(("a", 9), ("d", 9)).write.parquet(str(tmp_path / "t" / "batch=3"))
    (tmp_path / "t" / "batch=3" / "_SUCCESS").unlink()
    assert sorted(map(tuple, kept.read(batch=True).collect())) == want and not kept.upsert(rows(("a", 1)))
    assert kept.upsert(rows(("d", 1))) and sorted(map(tuple, kept.read().collect())) == [("a", 1), ("b", 4), ("c", None), ("d", 1)]
    kept.compact()
    assert kept.batches() == [4] and kept.read().count() == 4 and not kept.upsert(rows(("d", 1), ("b", 4)))


def test_misses_are_filled_once(spark, tmp_path):
    kept, asked = KeyedTable(spark, str(tmp_path / "c"), "key", "key string, answer string"), []

    def fill(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        return keys.where("key != 'never'").withColumn("answer", F.upper("key"))

    requests = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "never")], "n int, key string")
    first = {r.n: (r.answer, r.cached) for r in read_through(requests, kept, fill).collect()}
    assert first == {1: ("X", False), 2: ("Y", False), 3: ("X", False), 4: (None, False), 5: (None, False)}
    again = {r.n: (r.answer, r.cached) for r in read_through(requests.where("key != 'never'"), kept, fill).collect()}
    assert again == {1: ("X", True), 2: ("Y", True), 3: ("X", True)} and asked == [["never", "x", "y"]]


def test_vectors_of_hashed_tokens(spark):
    texts = ["a b a", "", None, "x"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", V.hashed(F.col("t"))).collect():
        want = [0.0] * 64
        for w in (r.t or "").split():
            want[int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % 64] += 1
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert r.v == pytest.approx([x / norm for x in want])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r["index"]): r["value"] for r in V.sparse_encode(df, "doc_id").collect()}
    number = lambda w: int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big")
    assert got == pytest.approx({(0, number("a")): math.log(3), (0, number("b")): math.log(2), (3, number("x")): math.log(2)})


def test_steps_in_order_gaps_and_late_rows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    minutes = lambda m: at + timedelta(minutes=m)
    batches = [
        [(1, 3, "c", 30, minutes(2)), (1, 1, "a", 10, minutes(0)), (2, 1, "a", 1, minutes(1))],
        # event time moves on: what came before minute 120 is late from the next batch on, and session 1 is out of time
        [(9, 1, "x", 1, minutes(180)), (2, 2, "b", 2, minutes(119))],
        [(1, 2, "b", 20, minutes(1)), (9, 1, "x", 1, minutes(181)), (9, 2, "y", 5, minutes(181))],
    ]
    path, schema = str(tmp_path / "in"), "session long, seq int, step string, tokens long, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    told = events.drain(events.ordered(stream, "1 hour", 1800), spark).collect()
    by = {}
    for r in sorted(told, key=lambda r: (r.session, r.cursor)):
        by.setdefault(r.session, []).append((r.cursor, r.seq, r.step, r.total, r.kind))
    assert by[1] == [(1, 1, "a", 10, "step"), (2, 3, "c", 40, "gap"), (3, -1, "", 40, "timeout")]
    assert by[2][:2] == [(1, 1, "a", 1, "step"), (2, 2, "b", 3, "step")] and by[9] == [(1, 1, "x", 1, "step"), (2, 2, "y", 6, "step")]
