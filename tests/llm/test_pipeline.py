"""Each stage of the pipeline against a plain version of it, and rows that are null, empty, repeated or have clashing columns."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import common, mixing, pii

CLASHING = ("spans", "words", "position", "pass", "score", "_score", "_tie", "_nth", "_node", "size", "begin", "ids", "decoded", "_row", "node", "component_id", "_none")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def rows(texts):
    return [(i, t, "en", [None, "s1", "s2"][i % 3], len(t or ""), *CLASHING) for i, t in enumerate(texts)]


TEXTS = [None, "", " \t", "one word", *[" ".join(f"w{i}x{j}" for j in range(40)) for i in range(9)], "mail a@b.cd or 1.2.3.4 now", "x" * 50_000, "y z " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with documents that hold clashing columns, and labels: half of the texts with a bad word are told."""
    path = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(90)]
    texts = [*TEXTS, *[" ".join([*rng.choice(plain, 20), *(["zorqwyt"] if i % 4 == 3 else []), *rng.choice(plain, 20)]) for i in range(400)]]
    spark.createDataFrame(rows(texts), SCHEMA).write.parquet(f"{path}/documents.parquet")
    marks = [(len(TEXTS) + i, int(i % 4 == 3)) for i in range(400)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts


def test_toxic_documents_go(spark, sf):
    path, texts = sf
    docs = common.read(spark, path, "documents")
    got = P.toxicity_stage(spark, docs, path)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [i for i, t in enumerate(texts) if "zorqwyt" not in (t or "")]
    again = P.toxicity_stage(spark, docs.limit(0), path)
    assert again.count() == 0


def test_masked_texts_and_their_lengths(spark, docs):
    got = P.pii_stage(spark, docs, "")
    found = {r.doc_id: r.spans for r in pii.annotate(docs, pii.fit(docs)).select("doc_id", "spans").collect()}
    assert got.columns == docs.columns
    for r in got.collect():
        want, at = "", 0
        for s in sorted(found[r.doc_id], key=lambda s: (s.start, s.end)):
            if s.start >= at:
                want += TEXTS[r.doc_id][at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        want = None if TEXTS[r.doc_id] is None else want + TEXTS[r.doc_id][at:]
        assert (r.text, r.n_chars, r.spans) == (want, len(want or ""), "spans")
    assert P.pii_stage(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_keep_the_least_id(spark):
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 50)) for _ in range(6)]
    texts = [None, "", *base, *[b + " tail" for b in base], base[0], "", " ".join(base[1].split()[:20])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for t in texts for w in [(t or "").split()]]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = P.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [i for i in range(len(texts)) if top[i] == i]
    assert P.near_duplicate_stage(spark, docs.limit(0), "").count() == 0
    alike = docs.withColumn("doc_id", F.lit(7).cast("long")).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    kept = collections.Counter(r.text for r in P.near_duplicate_stage(spark, alike, "").collect())
    assert sum(bool((t or "").split()) * n for t, n in kept.items()) == len({top[i] for i in range(len(texts)) if sets[i]})


def test_mixing_repeats_and_cuts_texts(spark, docs):
    repeated = docs.union(docs.filter("doc_id in (5, 6)")).union(docs.filter("doc_id = 7").withColumn("source", F.lit("s1")))
    got = P.mixing_stage(spark, repeated, "")
    assert got.columns == docs.columns
    want = collections.Counter()
    for r in mixing.mix(repeated).collect():
        t, left = TEXTS[r.doc_id] or "", r.taken
        while left > 0:
            n = min(r.size, left)
            spots = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)]
            want[(r.doc_id, r.source, t if n == r.size else t[: spots[n - 1]])] += 1
            left -= n
    assert collections.Counter((r.doc_id, r.source, r.text) for r in got.collect()) == want
    assert all(r.n_chars == len(r.text) and r.pass_ == "pass" for r in got.withColumnRenamed("pass", "pass_").collect())
    assert P.mixing_stage(spark, docs.limit(0), "").count() == 0


def test_the_whole_pipeline_removes_what_it_wrote(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, texts = sf
    had = common.made()
    got = P.run(spark, path)
    assert common.made() - had <= 1 + 1  # the last stage's input and the vocabulary
    lib = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    counts = collections.defaultdict(set)
    for r in got.collect():
        counts[r.doc_id].add(r.n_tokens)
    clean = [i for i, t in enumerate(texts) if (t or "").split() and "zorqwyt" not in t]
    assert set(counts) <= set(clean) and len(counts) >= 0.5 * len(clean)
    for i in list(counts)[:40]:
        if i != 13:  # the one with personal data
            assert max(counts[i]) <= len(lib.encode(texts[i], add_special_tokens=False).ids)
