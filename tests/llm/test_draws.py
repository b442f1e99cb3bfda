"""Importance resampling, suffix deduplication and hard negatives against brute force, with hostile tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, importance, negatives, suffix_dedup

NEAR = "the committee met on tuesday to hear what had been said about the harbour and its old cranes "
DOCS = [
    (5, None), (6, ""), (7, "short"), (8, NEAR * 3), (9, "Prefix " + NEAR * 2 + "tail"), (9, "Prefix " + NEAR * 2 + "tail"), (9, "another " + NEAR), (None, NEAR * 3),
    (10, "x" * 300), (11, "x" * 120 + "y"), (12, "zähes Öl " * 40 + NEAR), (13, "漢字" * 200), (14, "q" + "漢字" * 150), (15, "a\0b" * 40), (16, "a\0b" * 20 + "\0"),
    (17, " ".join(f"word{i % 977}" for i in range(4000))), (18, " ".join(f"word{i % 977}" for i in range(500, 3000))), (3, NEAR[:60] + "new"), (4, NEAR[20:69]), (-2, NEAR[10:61]),
    (19, "w" * 700 + " " + "v" * 300 + " end w1 w2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "l", "h", 7, 0) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lows string, text_hash string, bucket int, kind int").repartition(3)


def plain_removal(rows, length):
    least = collections.defaultdict(lambda: math.inf)
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1) if i is not None else ():
            least[raw[p : p + length]] = min(least[raw[p : p + length]], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = {q for p in range(len(raw) - length + 1) if i is not None and least[raw[p : p + length]] < i for q in range(p, p + length)}
        kept = bytes(b for q, b in enumerate(raw) if q not in gone)
        out.append((i, len(raw), len(gone), sum(q - 1 not in gone for q in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("suffixes,length", [(200_000, 50), (3, 50), (5, 37)])
def test_removal_equals_all_windows(docs, monkeypatch, suffixes, length):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", suffixes)
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    got = suffix_dedup.digests(suffix_dedup.dedup(docs, length)).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(DOCS, length)


def test_removal_of_many_slices(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", 1)
    got = suffix_dedup.digests(suffix_dedup.dedup(docs.repartition(7))).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(DOCS, 50)


def test_removal_of_random_texts(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ab "), 4000))
    rows = [(i, "".join(base[a : a + n] + str(i) for a, n in zip(rng.integers(0, 3900, 6), rng.integers(20, 120, 6)))) for i in range(60)]
    got = suffix_dedup.digests(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(rows, 50)


def test_removal_of_no_rows(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_quicksort_and_shared_bytes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (3000, 3)).astype(np.uint64) << np.uint64(56)
    order = suffix_dedup.multikey_order(words)
    assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))
    strings = [b"abcdefghij", b"abcdefghik", b"abc", b"b"]
    assert suffix_dedup.word_lcp(suffix_dedup._digits(strings, 10)).tolist() == [0, 9, 3, 0]


def plain_draw(rows, target, percent=5, least=20, buckets=10000):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    made = [(i, *grams(t)) for i, t in rows]
    s, t = collections.Counter(b for m in made for b in m[2]), collections.Counter(b for x in target for b in grams(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    for k, o in enumerate(fit[: percent * len(fit) // 100]):
        o[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_importance_equals_a_plain_draw(spark, docs):
    target = [None, "", NEAR, "Word12 WORD13 zähes öl"]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    for percent, least in ((50, 3), (5, 20)):
        got = importance.resample(docs, aims, percent, least).select(columns).collect()
        want = plain_draw(DOCS, target, percent, least)
        # equal rows share their ranks among them
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((w[:5] for w in want), key=str)
        assert sorted((r.rank, r.score) for r in got if r.rank) == sorted((w[5], w[4]) for w in want if w[5])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, aims).count() == 0
    assert importance.resample(docs, aims.limit(0)).count() == len(DOCS)


def test_grams_of_long_words():
    data = ("a" * 300 + " b " + "c" * 255 + " d " + "e" * 256).encode()
    starts, lengths, doc = np.array([0, 301, 303, 559, 561]), np.array([300, 1, 255, 1, 256]), np.array([0, 0, 0, 0, 1])
    crc, of = importance.gram_hashes(np.frombuffer(data, np.uint8), starts, lengths, doc, importance._shifts(), 3)
    words = data.split()
    want = [zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1) if i + n <= 4 or i == 4]
    assert sorted(crc.tolist()) == sorted(want) and (of == 1).sum() == 1


def plain_negatives(rows, anchor, k=5):
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    use = [r for r in rows if None not in r]
    out = []
    for a, la, va in use:
        if not anchor(a):
            continue
        scored = sorted((-dot(va, v), i, lab == la) for i, lab, v in use if i != a)
        for ps, p, _ in [s for s in scored if s[2]][:k]:
            hits = [(n, s) for s, n, same in scored if not same and 80 * -ps <= 100 * -s <= 100 * -ps]
            out += [(a, p, r + 1, n, -ps, -s) for r, (n, s) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("anchors,rows_,chunks", [(512, 2048, 2), (3, 7, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, anchors, rows_, chunks):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "ROWS", rows_)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-3, 9, 5).tolist()) for i in range(90)]
    rows += [(7, 1, [1, 1, 1, 1, 1]), (7, 2, [2, 2, 2, 2, 2]), (200, None, [1] * 5), (201, 1, None), (None, 1, [1] * 5), (203, 0, [9, 9, 9]), (205, 1, []), (206, 5, [3] * 5)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "vec_id long, label int, vector array<long>, block int, chunk string")
    from pyspark.sql import functions as F

    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, chunks=chunks).select(*names).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    huge = spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], "vec_id long, label int, vector array<long>")
    with pytest.raises(Exception, match="63 bits"):
        negatives.mine(huge, F.col("vec_id") == 0).count()


def test_unusable_vectors(spark):
    rows = [(1, [1.0, None]), (2, None), (3, [float("nan")]), (4, [float("-inf")]), (5, [0.5]), (6, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [r.id for r in df.where(negatives.usable(df.v)).collect()] == [5, 6]


def test_importance_keeps_no_table_of_blocks(spark, docs):
    """A reader's batch of wide rows holds a whole partition, so blocks live in their task, a slice of documents each."""
    before = len(common._MADE)
    importance.resample(docs, docs.select("text"), 50, 3).count()
    assert [m.rsplit("/", 1)[1].split("-")[0] for m in common._MADE[before:] if isinstance(m, str)] == ["scores", "ranked"]
    texts = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(["some words of a text " * 50] * 3000)], ["doc_id", "text"])
    sizes = [len(b.doc_id) for b in importance.blocks([texts], 10000, 3)]
    assert sum(sizes) == 3000 and max(sizes) == 999
