"""Importance resampling towards a target's distribution of hashed word n-grams.

Texts become a sparse matrix of documents by buckets, in blocks of compressed rows (CSR). Column sums of the blocks give the
corpus distribution, those of the target's blocks the target's; a bucket's gain is the rounded-down log ratio of both, smoothed
by one; the product of each block with the gains gives weights. Blocks are made anew for the product: stored, they were wide
rows, of which a reader's batch held a whole partition. Ranks come from one global sort by weight
plus a Gumbel value drawn from the id, so the draw is without replacement and alike in every run.

Defined cases: a null or empty text has no words and no features (weight 0); too short documents get a score but no rank;
a null id hashes as an empty one and comes last among equal scores; repeated rows are drawn each for itself; an empty
corpus gives no rows, an empty target a gain from smoothing alone; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_clean, lean, ranked, read_bytes, share, sliced

#: Longer words are hashed one by one.
LONG = 255

_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
_STEP ^= _STEP[0]


def _shifts() -> np.ndarray:
    """[n, lane, byte]: what a checksum register holding the byte in the lane becomes after n zero bytes; registers are sums (xor) of lanes."""
    out = np.empty((LONG + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG + 2):
        out[n] = _STEP[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


def _moved(shifts: np.ndarray, register: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce([shifts[n, lane, (register >> np.uint32(8 * lane)) & np.uint32(255)] for lane in range(4)])


def _classes() -> tuple[np.ndarray, np.ndarray]:
    lower, word = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


def gram_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, shifts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of each run of 1 to `most` words of a document, joined by a space, and the document of each."""
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -LONG) :]
    own, at, size = np.zeros(len(starts), np.uint32), starts[order], lengths[order]
    state, active = np.zeros(len(order), np.uint32), len(order)
    for j in range(int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size, -j, "left"))
        s = state[:active]
        state[:active] = _STEP[(s ^ data[at[:active] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    own[order] = state
    long = lengths > LONG
    short = np.where(long, 0, lengths)
    ones = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    register = _moved(shifts, ones, short) ^ own
    after_space = _moved(shifts, np.full(len(starts), _STEP[32], np.uint32), short) ^ own
    crcs, docs, clean = [], [], ~long
    for n in range(1, most + 1):
        last = len(starts) - n + 1
        if last <= 0:
            break
        if n > 1:
            # a register moves on over the space and the next word
            register = _moved(shifts, register[:last], short[n - 1 :] + 1) ^ after_space[n - 1 :]
            clean = clean[:last] & ~long[n - 1 :]
        crc, inside = register ^ np.uint32(0xFFFFFFFF), doc[:last] == doc[n - 1 :]
        for i in np.flatnonzero(inside & ~clean):
            crc[i] = zlib.crc32(b" ".join(data[starts[k] : starts[k] + lengths[k]].tobytes() for k in range(i, i + n)))
        crcs.append(crc[inside]), docs.append(doc[:last][inside])
    return np.concatenate(crcs or [np.empty(0, np.uint32)]), np.concatenate(docs or [np.empty(0, np.int64)])


@dataclass
class Block:
    """Compressed rows of a slice of documents: where each one's cells begin, and column and count of every cell."""

    doc_id: pa.Array
    words: np.ndarray
    starts: np.ndarray
    column: np.ndarray
    count: np.ndarray


def blocks(batches, buckets: int, most: int):
    """The count matrix of batches (doc_id, text), a block for a slice: at most 1024 documents, of about 1 MB of text or one longer
    document. A block lives in its task only, so what a task holds depends neither on a partition nor on a table of blocks."""
    lower, word = _classes()
    shifts = _shifts()
    for batch in sliced(batches, rows=1024):
        parts = list(read_bytes(batch.column("text")))
        ends = np.cumsum([len(p) + 1 for p in parts])
        data = np.empty(int(ends[-1]), np.uint8)
        for p, end in zip(parts, ends):
            data[end - 1 - len(p) : end - 1], data[end - 1] = lower[p], 32
        edge = np.flatnonzero(np.diff(word[data].astype(np.int8), prepend=0))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        doc = np.searchsorted(ends, starts, "right")
        crc, of = gram_hashes(data, starts, lengths, doc, shifts, most)
        cells, counts = np.unique(of.astype(np.int64) * buckets + crc % np.uint32(buckets), return_counts=True)
        row, column = cells // buckets, cells % buckets
        yield Block(batch.column("doc_id"), np.bincount(doc, minlength=len(parts)), np.searchsorted(row, np.arange(len(parts) + 1)), column, counts)


def column_sums(docs: DataFrame, buckets: int, most: int) -> np.ndarray:
    """Features of docs(doc_id, text) in each bucket. A task adds its blocks up first; one number a bucket comes to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for block in blocks(batches, buckets, most):
            total += np.bincount(block.column, block.count, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + n) / ((int(s) + 1) * (t_all + n)))) for s, t in zip(corpus, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_words, n_features, weight: each block times the gains, whose number is that of the buckets."""
    shared, buckets = share(docs.sparkSession, gain), len(gain)

    def run(batches):
        for block in blocks(batches, buckets, most):
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (block.count * shared.value[block.column], block.count)]
            weight, features = (s[block.starts[1:]] - s[block.starts[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays(
                [block.doc_id, pa.array(block.words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight.astype(np.int64))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10000, most: int = 3, seed: int = 42) -> DataFrame:
    """docs(doc_id, text) with n_words, n_features, weight, score and rank: of those with least_words words or more, `percent` of
    a hundred (rounded down) have ranks from 1 in descending order of scores; the others null. target(text) states the target."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aims = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    weighed = weigh(own, gains(column_sums(own, buckets, most), column_sums(aims, buckets, most)), most)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut_clean(weighed.withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count() * percent // 100
    rank = F.when(F.col("rank") < n, F.col("rank") + 1).cast("long")
    placed = ranked(scored.where(fit), F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("rank", rank)
    return placed.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
