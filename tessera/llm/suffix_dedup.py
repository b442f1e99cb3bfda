"""Removal of repeated passages by a distributed sparse suffix array.

Which bytes go: those covered by a string of `length` bytes that also starts in a document with a smaller id. Suffixes
start at anchors: places whose K bytes hash lowest in some window of `length` bytes. A window chooses its anchor by its own
content, so equal windows have equal anchors at the same place, and comparing what surrounds anchors finds every match.

1. Slices of documents list anchors with a hash of the K bytes (the suffix's leading token) and one of everything that a
   window through the anchor can hold. Buckets by hash settle anchors whose whole surroundings stand in a smaller document,
   and keep those whose K bytes stand elsewhere with other surroundings. All else has no match.
2. The suffixes kept are range-partitioned by their bytes at splitters sampled from them; a bucket sorts them by multikey
   quicksort, compares neighbours, and does the same to the bytes before the anchor. Runs of equal prefixes at a bucket's
   ends may go on in the next bucket: their smallest ids are compared across boundaries.
3. What is covered meets the texts again.

The surroundings are equal by 80 hash bits and more (K bytes and all that surrounds them hashed apart), the rest by bytes.

Defined cases: a null or empty text has no bytes; a row without an id neither loses bytes nor costs others any; rows that
share an id cost each other none; a text shorter than `length` loses none; other columns are not read; an empty table gives
no rows. Bytes are judged on the input, so a text may lose all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_clean as cut, lean, read_bytes, sliced, text_of, word_lcp

#: Bytes of the leading token.
K = 20
#: Bytes of text whose anchors a task holds before it sends them, and bytes of text a bucket of anchors stands for.
FLUSH, BUCKET = 8 << 20, 48 << 20
#: Suffixes in a bucket of the second step.
SUFFIXES = 200_000
#: Bytes of a text that are hashed at once; pieces overlap by what surrounds an anchor.
PIECE = 1 << 20

ENTRY = np.dtype([("hash", "<u4"), ("near_low", "<u4"), ("near_high", "<u2"), ("doc", "<u4"), ("pos", "<u4"), ("sent", "u1")])
SETTLED, OPEN, KNOWN = 1, 2, 3
REPLY = "doc_id long, text_hash long, pos int, kind byte"


def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(_mixed(x))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _blocks(data: np.ndarray, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes modulo 2^64 of the strings of each width (powers of two) at each place; no text holds the byte 255 that lies between texts."""
    base = 0xA24BAED4963EE407
    h, width, out = _table()[data], 1, {}
    while True:
        if width in widths:
            out[width] = h
        if width >= max(widths):
            return out
        factor = np.uint64(pow(base, width, 1 << 64))
        h = h[:-width] * factor + h[width:]
        width *= 2


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the pieces [start, end) of data, which have at least `length` bytes between and around them: places, hashes
    of the K bytes there, hashes of all that a window of `length` bytes through them can hold."""
    window = length - K + 1
    fits = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= length
    np.add.at(fits, starts[long], 1)
    np.add.at(fits, ends[long] - length + 1, -1)
    fits = np.cumsum(fits[:-1], dtype=np.int8).astype(bool)
    h = _blocks(data, (4, 16))
    four, sixteen = h[4], h[16]
    token = _mixed(sixteen[: len(four) - 16] * np.uint64(pow(0xA24BAED4963EE407, 4, 1 << 64)) + four[16:])
    lowest = _slide(token, window, np.minimum)
    lowest[~fits[: len(lowest)]] = 0
    highest = _slide(np.concatenate([np.zeros(window - 1, np.uint64), lowest, np.zeros(window - 1, np.uint64)]), window, np.maximum)
    at = np.flatnonzero((highest[: len(token)] == token) & (token != 0))
    near = np.zeros(len(at), np.uint64)
    for step in sorted({*range(-(length - K), length - 15, 16), length - 16}):
        near = near * np.uint64(0x9FB21C651E98DF25) + sixteen[at + step]
    return at, token[at], _mixed(near)


def _pieces(batch, length: int):
    """(row, place of the piece's first byte, first and last place whose anchors count, bytes) of each text, long ones in pieces."""
    around = 2 * length
    for row, raw in enumerate(read_bytes(batch.column("text"))):
        for at in range(0, len(raw), PIECE):
            low = max(0, at - around)
            yield row, low, at, min(at + PIECE, len(raw)), raw[low : at + PIECE + around]


def _found(batch, length: int) -> np.ndarray:
    """Anchors of a batch as (row, pos, token, near)."""
    rows, lows, firsts, lasts, parts = [], [], [], [], [np.full(2 * length, 255, np.uint8)]
    starts, at = [], 2 * length
    for row, low, first, last, raw in _pieces(batch, length):
        rows.append(row), lows.append(low), firsts.append(first), lasts.append(last), starts.append(at)
        parts += [raw, np.full(2 * length, 255, np.uint8)]
        at += len(raw) + 2 * length
    out = np.dtype([("row", "i8"), ("pos", "i8"), ("token", "u8"), ("near", "u8")])
    if not rows:
        return np.empty(0, out)
    data, starts = np.concatenate(parts), np.array(starts)
    ends = starts + np.array([len(p) for p in parts[1::2]])
    places, token, near = anchors(data, starts, ends, length)
    piece = np.searchsorted(starts, places, "right") - 1
    pos = places - starts[piece] + np.array(lows)[piece]
    keep = (pos >= np.array(firsts)[piece]) & (pos < np.array(lasts)[piece])
    made = np.empty(int(keep.sum()), out)
    made["row"], made["pos"], made["token"], made["near"] = np.array(rows)[piece[keep]], pos[keep], token[keep], near[keep]
    return made


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the last first, and whether each place of the order starts a group of all but the first key."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys[1:]])
    return order, new


def _settle(doc: np.ndarray, near: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Which anchors have the surroundings of an anchor in a smaller document."""
    order, new = _groups(doc, near, token)
    out = np.empty(len(order), bool)
    least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out[order] = doc[order] > least
    return out


def _several(doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors' tokens stand in two documents or more, and one anchor of each such token."""
    order, new = _groups(doc, token)
    several, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    if len(order):
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(order)) - 1
        run = np.cumsum(new) - 1
        spread = doc[order][begin] != doc[order][end]
        several[order] = spread[run]
        first[order[begin[spread]]] = True
    return several, first


def _sender(length: int, buckets: int):
    import pyarrow as pa

    def packed(docs: np.ndarray, hashes: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> tuple[bytes, bytes]:
        used, entries["doc"] = np.unique(rows, return_inverse=True)
        return np.stack([docs[used], hashes[used]]).tobytes(), b"".join(entries[f].tobytes() for f in ENTRY.names)

    def flush(held: list) -> pa.RecordBatch:
        docs, hashes = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        found = np.concatenate([h[2] for h in held])
        row = np.concatenate([h[2]["row"] + b for h, b in zip(held, base)])
        kind = np.zeros(len(found), np.uint8)
        kind[_settle(docs[row], found["near"], found["token"])] = SETTLED
        left = np.flatnonzero(kind == 0)
        several, first = _several(docs[row[left]], found["token"][left])
        kind[left[several]] = OPEN
        entries = np.zeros(len(found), ENTRY)
        entries["hash"], entries["pos"], entries["sent"] = found["token"] & np.uint64(0xFFFFFFFF), found["pos"], kind
        entries["near_low"], entries["near_high"] = found["near"] & np.uint64(0xFFFFFFFF), found["near"] >> np.uint64(48)
        bucket = ((found["token"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        # one anchor of a token that this slice knows in several documents tells the others; what is decided goes beside the buckets
        told = left[first]
        index = np.concatenate([np.flatnonzero(kind == 0), told, np.flatnonzero(kind != 0)])
        to = np.concatenate([bucket[kind == 0], bucket[told], np.full((kind != 0).sum(), -1 - int(docs[0] + len(found)) % buckets)])
        sent = entries[index]
        sent["sent"][(kind == 0).sum() : (kind == 0).sum() + len(told)] = KNOWN
        order = np.lexsort((sent["pos"], row[index], to))
        ends = np.flatnonzero(np.diff(to[order], append=to[order][-1] - 1)) + 1 if len(order) else []
        out, begin = [], 0
        for end in ends:
            part = order[begin:end]
            out.append((int(to[part[0]]), *packed(docs, hashes, row[index][part], sent[part])))
            begin = end
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[i] for o in out], pa.binary()) for i in (1, 2))], names=["bucket", "docs", "entries"]
        )

    def run(batches):
        held, size = [], 0
        for batch in sliced(batches, rows=4096):
            held.append((batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy(), _found(batch, length)))
            size += batch.column("text").nbytes
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return lean(run)


def _answers(table):
    """Settled and open anchors of one bucket."""
    import pyarrow as pa

    docs, hashes, parts, base = [], [], [], 0
    for d, e in zip(table.column("docs").to_pylist(), table.column("entries").to_pylist()):
        pair = np.frombuffer(d, np.int64).reshape(2, -1)
        n, at = len(e) // ENTRY.itemsize, 0
        part = np.empty(n, ENTRY)
        for f in ENTRY.names:
            kind = ENTRY[f]
            part[f] = np.frombuffer(e, kind, n, at)
            at += n * kind.itemsize
        part["doc"] += base
        base += pair.shape[1]
        docs.append(pair[0]), hashes.append(pair[1]), parts.append(part)
    docs, hashes, all_ = np.concatenate(docs), np.concatenate(hashes), np.concatenate(parts)
    kind, doc = all_["sent"].copy(), docs[all_["doc"]]
    if int(table.column("bucket")[0].as_py()) >= 0:
        near = all_["near_low"].astype(np.uint64) | all_["near_high"].astype(np.uint64) << np.uint64(32)
        settled = _settle(doc, near, all_["hash"]) & (kind == 0)
        kind[settled] = SETTLED
        left = np.flatnonzero(kind != SETTLED)
        several, _ = _several(doc[left], all_["hash"][left])
        known = np.isin(all_["hash"][left], all_["hash"][kind == KNOWN])
        kind[left[(several | known) & (kind[left] == 0)]] = OPEN
    keep = (kind == SETTLED) | (kind == OPEN)
    return pa.table(
        [pa.array(doc[keep]), pa.array(hashes[all_["doc"][keep]]), pa.array(all_["pos"][keep].astype(np.int32)), pa.array(kind[keep].astype(np.int8))],
        names=["doc_id", "text_hash", "pos", "kind"],
    )


def multikey_order(words: np.ndarray, small: int = 48) -> np.ndarray:
    """Order of rows of 8-byte digits by multikey quicksort: parts below, at and above a digit's pivot, the middle one a digit deeper."""
    order, deep = np.arange(len(words)), words.shape[1]
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == deep:
            continue
        part = order[low:high]
        if high - low <= small:
            order[low:high] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        digit = words[part, depth]
        pivot = np.sort(digit[[0, len(digit) // 2, -1]])[1]
        below, above = digit < pivot, digit > pivot
        order[low:high] = np.concatenate([part[below], part[~(below | above)], part[above]])
        first, last = low + int(below.sum()), high - int(above.sum())
        todo += [(low, first, depth), (first, last, depth + 1), (last, high, depth)]
    return order


def _digits(strings: list[bytes], width: int) -> np.ndarray:
    wide = -(-width // 8) * 8
    return np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), ">u8").reshape(len(strings), wide // 8).astype(np.uint64)


def compare(right: list[bytes], left: list[bytes], doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """For each suffix the least and greatest number of bytes before its anchor at which a window of `length` bytes also stands
    in a smaller document of this bucket (-1: none), and by that number the suffixes to be compared with other buckets."""
    n, before = len(doc), length - K
    order = multikey_order(_digits(right, length))
    words = _digits(right, length)[order]
    shared = word_lcp(words)
    doc, rlen = doc[order], np.array([len(right[i]) for i in order])
    reverse = _digits([left[i] for i in order], before)
    llen = np.array([len(left[i]) for i in order])
    order2 = multikey_order(reverse)
    shared2 = word_lcp(reverse[order2])
    least, most, across = np.full(n, -1), np.full(n, -1), {}
    for o in range(before + 1):
        run = np.cumsum(shared < length - o)
        size = np.bincount(run)
        border = (run == run[0]) | (run == run[-1])
        index = np.flatnonzero((llen >= o) & (rlen >= length - o) & ((size[run] > 1) | border))
        if not len(index):
            continue
        side = np.empty(n, np.int64)
        side[order2] = np.cumsum(shared2 < o)
        key = run[index] * np.int64(n + 1) + side[index]
        by, new = _groups(doc[index], key)
        lowest = doc[index][by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        hit = index[by[doc[index][by] > lowest]]
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
        rest = index[by[doc[index][by] == lowest]]
        rest = rest[border[rest]]
        if len(rest):
            across[o] = order[rest]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return least[back], most[back], across


SUFFIX = "doc_id long, text_hash long, pos int, after binary, before binary"
FOUND = "doc_id long, text_hash long, low int, high int, window binary"


def _suffixes(length: int):
    """What surrounds each open anchor: bytes from it on, and bytes before it, backwards."""
    import pyarrow as pa

    before = length - K

    def run(batches):
        for batch in sliced(batches):
            docs, hashes, rows, places, after, ahead = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy(), [], [], [], []
            for row, (raw, at) in enumerate(zip(read_bytes(batch.column("text")), batch.column("places").to_pylist())):
                raw = raw.tobytes()
                for p in at:
                    rows.append(row), places.append(p), after.append(raw[p : p + length]), ahead.append(raw[max(p - before, 0) : p][::-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[rows]), pa.array(hashes[rows]), pa.array(places, pa.int32()), pa.array(after, pa.binary()), pa.array(ahead, pa.binary())],
                names=["doc_id", "text_hash", "pos", "after", "before"],
            )

    return lean(run)


def _buckets(length: int):
    """Sorts and compares a bucket of suffixes; rows with a window are to be compared across boundaries."""
    import pyarrow as pa

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        doc, hashes, pos = (t.column(c).to_numpy() for c in ("doc_id", "text_hash", "pos"))
        right, left = t.column("after").to_pylist(), t.column("before").to_pylist()
        least, most, across = compare(right, left, doc, length)
        hit = np.flatnonzero(most >= 0)
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("window", pa.binary())])
        low, high = (pos[hit] - most[hit]).astype(np.int32), (pos[hit] - least[hit] + length).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(hashes[hit]), pa.array(low), pa.array(high), pa.nulls(len(hit), pa.binary())], schema=schema)
        for o, index in across.items():
            low = (pos[index] - o).astype(np.int32)
            windows = [left[i][:o][::-1] + right[i][: length - o] for i in index]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[index]), pa.array(hashes[index]), pa.array(low), pa.array((low + length).astype(np.int32)), pa.array(windows, pa.binary())], schema=schema
            )

    return lean(run)


def covered(docs: DataFrame, length: int = 50) -> DataFrame:
    """Intervals [low, high) of bytes to be removed, overlapping, by doc_id and text_hash, for rows (doc_id, text, text_hash) with ids."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-size // BUCKET))
    sent = docs.mapInArrow(_sender(length, buckets), "bucket int, docs binary, entries binary")
    # a bucket holds anchors of about BUCKET bytes of text, and a slice sends a token known in several documents once
    replies = cut(sent.groupBy("bucket").applyInArrow(_answers, REPLY), "replies")
    n = replies.where(F.col("kind") == OPEN).count()
    places = replies.where(F.col("kind") == OPEN).groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("places"))
    suffixes = docs.join(places, ["doc_id", "text_hash"]).mapInArrow(_suffixes(length), SUFFIX)
    compared = cut(suffixes.repartitionByRange(max(1, -(-n // SUFFIXES)), "after", "doc_id").mapInArrow(_buckets(length), FOUND), "compared")
    across = compared.where(F.col("window").isNotNull())
    least = across.groupBy("window").agg(F.min("doc_id").alias("least"))
    across = across.join(least, "window").where(F.col("doc_id") > F.col("least"))
    settled = replies.where(F.col("kind") == SETTLED).select(
        "doc_id", "text_hash", F.greatest(F.col("pos") - (length - K), F.lit(0)).alias("low"), (F.col("pos") + length).alias("high")
    )
    columns = ["doc_id", "text_hash", "low", "high"]
    return settled.union(compared.where(F.col("window").isNull()).select(columns)).union(across.select(columns))


def _cleaner():
    import pyarrow as pa

    def run(batches):
        for batch in sliced(batches, rows=1024):
            spans, kept = [], []
            for raw, lows, highs in zip(read_bytes(batch.column("text")), batch.column("lows").to_pylist(), batch.column("highs").to_pylist()):
                if not lows:
                    spans.append([]), kept.append(raw.tobytes())
                    continue
                depth = np.zeros(len(raw) + 1, np.int32)
                np.add.at(depth, lows, 1)
                np.add.at(depth, np.minimum(highs, len(raw)), -1)
                gone = np.cumsum(depth)[:-1] > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                spans.append([{"start": a, "end": b} for a, b in edge]), kept.append(raw[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "text", "spans", "kept"]
            )

    return lean(run)


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, text, spans (removed runs of bytes, maximal) and kept (what stays, as bytes) of each row of docs(doc_id, text)."""
    if not 36 <= length <= 255:
        raise ValueError("length must be from 36 to 255 bytes")
    base = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    found = covered(base.where(F.col("doc_id").isNotNull()), length)
    by = found.groupBy("doc_id", "text_hash").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    return base.join(by, ["doc_id", "text_hash"], "left").select("doc_id", "text", "lows", "highs").mapInArrow(
        _cleaner(), "doc_id long, text string, spans array<struct<start:int,end:int>>, kept binary"
    )


def removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), removed(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
