"""Gates of question sets, answers in models' shapes and judges' scores, by hand and over empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.operators import evaluation as E
from tessera.operators import golden as G
from tessera.operators import layout as L
from tessera.plans.registry import stamp

SCHEMA = """seq long, id string, question string, expect string, expected_route string, tests string, refusal_kind string, depends_on string, answer string, answer_en string,
pages_read array<string>, evidence array<struct<chunk_id: string, quote: string>>, gold array<string>, distractors array<string>, page_vs_chunk string"""
AR = "ما هو الجرد السنوي"
GOOD = (1, "Q1", AR, "answerable", "basic_rag", "t", None, None, AR, "en", ["a:p1"], [("c1", "some  quoted\ntext")], ["c1"], None, "none")


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("c1", "x some quoted text y", "a", "prose", "p"), ("c2", None, "b", "grid", "q")], "chunk_id string, text string, source string, chunk_type string, section_path string")


def failures(spark, chunks, rows, variants=(("v", "c1"), ("v", "c2")), count=None):
    q = spark.createDataFrame(rows, SCHEMA)
    same = spark.createDataFrame([(2, "h")], "chunk_count long, sha256 string")
    out = G.gates(q, chunks, spark.createDataFrame(list(variants), "variant string, chunk_id string"), same, same, len(rows) if count is None else count)
    return [(r.gate, r.id, r.detail) for r in out.where("gate != 7").collect()], [r.detail for r in out.where("gate = 7").collect()]


def test_gates_one_by_one(spark, chunks):
    change = lambda **new: tuple(new.get(n, v) for n, v in zip([f.split()[0] for f in SCHEMA.replace("\n", " ").replace("struct<chunk_id: string, quote: string>", "s").split(", ")], GOOD))
    assert failures(spark, chunks, [GOOD]) == ([], ["b"])
    rows = [
        GOOD, change(seq=2, id="Q2", expect="refuse", refusal_kind="non_answering_retrieval", evidence=None, gold=["c2"], pages_read=None),
        change(seq=3, id="Q3", question=None, answer="latin", evidence=[("c1", "quoted words"), ("c9", "z")], depends_on="Q4"), change(seq=4, id="Q1", depends_on="Q2", refusal_kind="out_of_domain", expected_route=None),
    ]
    got, sources = failures(spark, chunks, rows, variants=(("v", "c1"), ("w", "c1"), ("w", "c2")), count=20)
    assert len(got) == 12 and set(got) == {
        (1, None, "count 4"), (1, "Q1", "repeated id"), (1, "Q2", "missing distractor_chunk_ids,pages_read"), (1, "Q3", "no question"), (1, "Q1", "expected_route"), (1, "Q1", "refusal_kind"),
        (2, "Q2", "gold_chunk_ids c2 not in v"), (2, "Q3", "evidence c9"), (3, "Q2", "refuse with gold"), (4, "Q3", "quote not in c1"), (5, "Q3", "answer arabic_ratio"), (6, "Q3", "depends on Q4"),
    } and sources == []
    assert {r.ref: r.asked for r in G.worksheet(spark.createDataFrame(rows, SCHEMA)).collect()} == {"a:p1": "Q1, Q3, Q1"}
    reach = G.coverage(spark.createDataFrame(rows, SCHEMA), chunks).first()
    assert (reach.types, reach.paths, reach.median_gold, reach.least_gold, reach.most_gold, reach.disagreements) == (2, 2, 1, 1, 1, 0)


def test_answers_of_models(spark):
    chat = lambda content, finish="stop", usage=True: json.dumps({"choices": [{"message": {"content": content}, "finish_reason": finish}], **({"usage": {"prompt_tokens": 3}} if usage else {})})
    cases = {
        chat("hi"): ("hi", "stop", 3, 0, None), chat("", "stop"): ("", "stop", 3, 0, None), chat("hi", "length"): (None, "length", None, None, "cut off"), chat("hi", usage=False): (None, "stop", None, None, "no usage"),
        '{"message": {"content": "n"}, "prompt_eval_count": 4, "eval_count": 2}': ("n", "", 4, 2, None), "{": (None, "", None, None, "no message"), '{"choices": []}': (None, "", None, None, "no choices"), None: (None, "", None, None, "no message"),
    }
    got = spark.createDataFrame([(c,) for c in cases], "b string").select("b", A.response(F.col("b")).alias("r")).collect()
    assert {r.b: tuple(r.r) for r in got} == cases
    marks = {'{"faithfulness": 1, "correctness": 0.5, "context_relevance": "1", "answer_relevance": null}': (None, 1.0, None, 0.5), "[1]": (None,) * 4, "x": (None,) * 4, None: (None,) * 4}
    got = spark.createDataFrame([(c,) for c in marks], "b string").select("b", A.judged(F.col("b")).alias("r")).collect()
    assert {r.b: tuple(r.r) for r in got} == marks


def test_answers_are_cited_or_refused(spark):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["hi", "two coins", "lost", "blank", "many"])], "qid long, text string")
    trace = spark.createDataFrame([(0, "simple", False), (1, "basic_rag", False), (2, "advanced_rag", True), (3, "basic_rag", False), (4, "basic_rag", False)], "qid long, route string, refused boolean")
    rows = [(1, 1, 7, "No.\nPay two\n coins now. Two coins."), (1, 2, 8, ""), (1, 3, 9, "Coins"), (1, 4, 5, "two coins"), (2, 1, 7, "x"), (3, 1, 6, " .. "), (4, 2, 3, "a b"), (4, 1, 4, None)]
    got = {r.qid: tuple(r)[1:] for r in A.answered(asked, trace, spark.createDataFrame(rows, "qid long, rnk int, doc_id long, text string")).collect()}
    assert got == {
        0: ("direct", A.DIRECT, [], 0, True), 1: ("answered", "- Pay two coins now [1]\n- Coins [3]", [7, 9], 0, True), 2: ("refused", A.REFUSAL, [], 0, True),
        3: ("refused", A.REFUSAL, [], 0, True), 4: ("answered", "- a b [2]", [3], 0, True),
    }
    # a presenter that says more is passed over
    more = A.answered(asked, trace, spark.createDataFrame(rows, "qid long, rnk int, doc_id long, text string"), lambda t: F.concat(t, F.lit(" 99"))).where("qid = 1").first()
    assert (more.answer, more.guarded) == ("Pay two coins now [1]\nCoins [3]", False)


def test_highlights_on_each_branch(spark):
    chunks = spark.createDataFrame([("r", "a", 1, "grid", 0, 1, 1), ("band", "a", 2, "grid", 0, 0, 9), ("one", "a", 3, "grid", 0, 0, 0), ("past", "a", 2, "grid", 0, 7, 8), ("gone", "a", 1, "grid", 4, 0, 0), ("prose", "a", 1, "prose", None, None, None)], "chunk_id string, source string, page int, chunk_type string, table_no long, first int, last int")
    box = [10.0, 20.0, 110.0, 60.0]
    tables = spark.createDataFrame([("a", 1, 0, box, 4), ("a", 2, 0, box, 4), ("a", 3, 0, box, 1)], "source string, page int, table_no long, box array<double>, n_rows int")
    live = spark.createDataFrame([("a", 1, 0, [12.0, 21.0, 110.0, 60.5], [[10.0, 20.0, 110.0, 30.0], [10.0, 30.0, 110.0, 60.25]]), ("a", 2, 0, [13.0, 20.0, 110.0, 60.0], [[0.0, 0.0, 1.0, 1.0]])], "source string, page int, found_no int, box array<double>, rows array<array<double>>")
    asked = spark.createDataFrame([(c,) for c in ("r", "band", "one", "past", "gone", "prose", "who")], "chunk_id string")
    got = {r.chunk_id: (r.x, r.y, r.w, r.h, r.covered, r.precision) for r in L.highlight(asked, chunks, tables, live, 144).collect()}
    none = (None, None, None, None, False, "none")
    # halves go to the even pixel
    assert got == {"r": (20, 60, 200, 60, True, "row"), "band": (20, 40, 200, 80, True, "row"), "one": (20, 40, 200, 80, True, "table"), "past": (20, 40, 200, 80, True, "table"), "gone": none, "prose": none, "who": none}


def test_runs_that_owe_records(spark):
    owed = spark.createDataFrame([("basic", 1), ("basic", 2), ("adaptive", 1)], "arm string, qid long")
    records = spark.createDataFrame([("basic", 1, "error", 0, None), ("basic", 2, "grounded", 0, "step")], "arm string, qid long, kind string, n_chunks int, ledger_failure string")
    asked = spark.createDataFrame([(1, True), (2, True)], "qid long, answerable boolean")
    got = sorted(map(tuple, E.harness_gates(owed, records, asked).collect()))
    assert got == [("empty", "basic", 2), ("error", "basic", 1), ("ledger", "basic", 2), ("missing", "adaptive", 1)]


def test_tables_are_told_by_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stamp(spark, path) == (0, 0)
    spark.range(5).write.parquet(path)
    before = stamp(spark, path)
    spark.range(5000).write.mode("overwrite").parquet(path)
    assert before[0] > 0 and stamp(spark, path) != before
