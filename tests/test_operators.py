"""Sources, chunk operators and the stream on small fixtures: nulls, empty tables, repeats."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import retrieval as R
from tessera.sources import envelopes as E
from tessera.streaming import ledger as L


def test_envelopes_round_trip(spark, tmp_path):
    rows = [("é\n\"x\"", "s", 1), (None, None, None), ("", "s", 2)]
    E.save(spark.createDataFrame(rows, "text string, source string, page int"), str(tmp_path / "docs"))
    got = E.load(spark, str(tmp_path / "docs"), "source string, page int")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_array_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": t, "metadata": {"page": i}} for i, t in enumerate("cab")], indent=2))
    got = E.load_array(spark, str(tmp_path / "a.json"), "page int").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(0, "c", 0), (1, "a", 1), (2, "b", 2)]


def test_cache_reads_through(spark, tmp_path):
    asked = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "q string, seed int").withColumn("key", E.call_key(F.col("q"), F.col("seed")))
    keys = [r.key for r in asked.collect()]
    assert len(set(keys)) == 3 and all(len(k) == 12 for k in keys)
    path = str(tmp_path / "cache")
    for _ in range(2):
        E.store(spark.createDataFrame([(keys[0], "yes", 3, 4, 0.5)], E.CALL), path)
    got = {(r.q, r.seed): (r.answer, r.cached) for r in E.read_through(asked, spark.read.parquet(path)).collect()}
    assert got == {("a", 1): ("yes", True), ("a", None): (None, False), ("b", 1): (None, False)}


def test_build_diff_and_filters(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    got = C.build_diff(make([(1, "a"), (2, None), (3, "c"), (4, None)]), make([(1, "b"), (2, None), (5, "e"), (4, "d")]), "k", "v").collect()
    assert {(r.k, r.change) for r in got} == {(1, "changed"), (3, "removed"), (5, "added"), (4, "changed")}
    docs = spark.createDataFrame([("s", "en"), ("s", None), (None, "en")], "source string, lang string")
    asked = spark.createDataFrame([(1, None, None), (2, "s", "en"), (3, "t", None)], "filter_id int, source string, lang string")
    assert {tuple(r) for r in C.allowed(docs, asked).collect()} == {(1, 3, False), (2, 1, False), (3, 3, True)}
    assert {tuple(r) for r in C.allowed(docs.limit(0), asked).collect()} == {(1, 0, True), (2, 0, True), (3, 0, True)}


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([("a", 1), ("b", None)], [("a", 2), (None, 5)]):
        spark.createDataFrame(part, "step string, tokens bigint").coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert {tuple(r) for r in L.drain(stream, spark).collect()} == {tuple(r) for r in L.totals(batch).collect()} == {("a", 2, 3), ("b", 1, None), (None, 1, 5)}
    shown = {r.step: r.state for r in L.live_steps(L.totals(batch.filter("step is not null")), ("a", "z")).collect()}
    assert shown == {"a": "run", "z": "skipped", "b": "run"}


def test_quality_gives_four_verdicts(spark):
    arabic = "كلمة عربية " * 30
    texts = [None, "", arabic, arabic + "\ufffd", arabic + "жжжжжжж", "plain words " * 30, "short", arabic + "\u2013\u00a0\u00ab" * 9, "من " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", T.assessed(F.col("text")).alias("q")).orderBy("i")
    got = [r.q for r in df.collect()]
    assert [q.verdict for q in got] == ["empty", "empty", "ok", "degraded", "degraded", "suspicious", "ok", "ok", "ok"]
    assert [q.replacement_chars for q in got] == [0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert got[8].fragment_ratio == 1.0 and got[4].off_script_ratio == round(7 / len(texts[4]), 6) and got[2].arabic_ratio == round(270 / 330, 6)


def test_every_match_votes_and_titles_are_whole(spark):
    rows = [(1, "s", "1 7 7"), (2, "s", "2 and 7"), (3, "t", "9 8"), (4, "t", "8 9"), (5, "u", None), (6, "v", "none")]
    got = {r.source: (r.value, r.votes) for r in R.votes(spark.createDataFrame(rows, "doc_id long, source string, text string"), "[0-9]+").collect()}
    assert got == {"s": ("7", 3), "t": ("9", 2), "u": (None, 0), "v": (None, 0)}
    title = "A very long title of the manual that does not end at forty characters"
    texts = [f" The Bank \n\nits name\n {title}\n second  line ", "The Bank\nname", f"a\nb\n{title}", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", C.cover_title(F.col("text"), "Bank").alias("t")).orderBy("i")
    assert [r.t for r in df.collect()] == [f"{title} second line", None, None, None, None]


def test_batches_are_worked_off_in_slices():
    bags = pa.array([["a"] * n for n in (3, 0, 4, 50, 1, 0)], pa.list_(pa.string()))
    parts = list(R.slices(pa.RecordBatch.from_arrays([bags], ["t"]), "t", 7))
    assert [p.column("t").value_lengths().to_pylist() for p in parts] == [[3, 0, 4], [50], [1, 0]]
