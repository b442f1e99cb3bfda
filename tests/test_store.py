"""Store, prefixes and decisions against plain walks and values worked out by hand."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import prefixes as P
from tessera.operators import retrieval as R
from tessera.operators import store as S
from tessera.plans import store as plans

SF = "/root/testdata/sf0.001"


def test_point_ids_are_name_based(spark):
    names = ["a_p01_1", "", "صفحة", "x" * 5000]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.point_id(F.col("n")).alias("i")).collect()
    assert {r["n"]: r["i"] for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_keys_follow_all_that_makes_a_vector(spark):
    row = spark.createDataFrame([("t",)], "t string")
    keys = [row.select(S.cache_key(F.col("t"), **kw)).first()[0] for kw in ({"model": "m", "kind": "q"}, {"kind": "q", "model": "m"}, {"model": "m", "kind": "p"})]
    assert keys[0] == keys[1] != keys[2] and all(len(k) == 16 for k in keys)


def test_fingerprint_ignores_order_but_no_change(spark):
    rows = [(i, f"t{i % 3}") for i in range(50)] + [(None, None), (7, "t1")]
    made = lambda x: tuple(S.fingerprint(spark.createDataFrame(x, "k long, t string"), "k", "t", 4, 3).first())
    assert made(rows) == made(rows[::-1]) and made(rows)[0] == 52
    assert made(rows) != made([*rows[:-1], (7, "t2")])
    assert S.fingerprint(spark.createDataFrame([], "k long, t string"), "k", "t").first()["chunk_count"] == 0


def test_a_clean_collection_has_no_failures(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, f string")
    assert S.verify(rows, rows, "k", ["f"]).collect() == []
    bad = S.verify(rows, rows.filter("k = 1").withColumn("f", F.lit(None).cast("string")), "k", ["f"]).collect()
    assert [tuple(r) for r in bad] == [("count", 1, None), ("payload", 2, [1, 2])]


def test_axes_are_those_of_numpy(spark):
    points, shares = S.pca_2d(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    _, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in axes[:2]]
    want = (x - x.mean(0)) @ np.array(axes).T
    got = {r["vec_id"]: (r["x"], r["y"]) for r in points.collect()}
    assert np.allclose([got[r["vec_id"]] for r in rows], want, atol=1e-4)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:2])
    assert S.pca_2d(spark.createDataFrame([(1, [1.0, 2.0])] * 2, "k long, v array<double>"), "k", "v")[1] == (0.0, 0.0)


def test_pooling(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], [0, 0, 0])], "s array<array<double>>, m array<int>, z array<int>")
    assert tuple(row.select(S.cls_pool(F.col("s")), S.mean_pool(F.col("s"), F.col("m")), S.mean_pool(F.col("s"), F.col("z"))).first()) == ([1.0, 2.0], [2.0, 3.0], None)


def test_each_rule_rejects_its_prefix(spark):
    got = [r["r"] for r in spark.createDataFrame(list(plans.PAIRS), "p string, c string").select(P.rejected(F.col("p"), F.col("c")).alias("r")).collect()]
    assert got == ["empty", "length", None, "arabic_ratio", "off_script_ratio", "mixed_script", "verbatim", "copied", "preamble", "length", None]


def test_tidied_answers(spark):
    raw = ["السياق: «نص»", '"a\nb"', "جملة السياق：x", "", "plain"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "t string").select(P.tidy(F.col("t"))).collect()]
    assert got == ["نص", "a b", "x", "", "plain"]


@pytest.mark.parametrize(("texts", "scaffold"), [(["ab", "c" * 9000, "d" * 9000, None], 100), (["a", "b"], 0), (["x" * 20_000], 5), ([""] * 9000, 0)])
def test_section_budget_is_the_cut_of_the_whole(spark, texts, scaffold):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "s string, i long, text string")
    got = P.section_budget(rows, "s", "i", F.lit("head"), scaffold).first()
    whole = "\n\n".join(t or "" for t in texts)
    allowed = P.PROMPT - 4 - max(len(t or "") for t in texts) - scaffold
    want = (whole, False) if len(whole) <= allowed else (whole[: max(allowed, 0)], True)
    assert (got["body"], got["cut"]) == want


def test_decisions(spark):
    rows = [(0.3, 0.3, 0.1), (-0.3, -0.3, 0.1), (0.3, -0.3, 0.1), (0.05, 0.3, 0.1)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "r double, m double, h double").select(*E.decided("r", "m", "h")).collect()]
    assert got == [("a", "measurement"), ("b", "measurement"), ("a", "disagreed"), ("a", "tie")]


def test_fusion_of_one_query_keeps_its_list(spark):
    rows = [(1, 0, 10, 1, 0.5), (1, 0, 11, 2, 0.4), (2, 0, 10, 1, 0.9), (2, 1, 12, 1, 0.8), (2, 1, 10, 2, 0.1)]
    got = R.fuse_queries(spark.createDataFrame(rows, "qid long, sub long, doc_id long, rnk int, score double"), "qid", "sub", 2).collect()
    want = {(1, 10, 1, 0.5, True), (1, 11, 2, 0.4, True), (2, 10, 1, round(1 / 61 + 1 / 62, 8), False), (2, 12, 2, round(1 / 61, 8), False)}
    assert {(r["qid"], r["doc_id"], r["rnk"], r["score"], r["absolute"]) for r in got} == want
