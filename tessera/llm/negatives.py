"""Hard negatives by a two-dimensional block matrix product.

Rows and anchors lie in blocks, in order of label and id, and each block's vectors in chunks of dimensions. A cell (anchor block,
row block, chunk) makes a tile of partial integer scores; the tiles of a block pair are shuffled together and added. Pairs whose
labels meet give each anchor its positives, those whose labels differ its negatives: a tile keeps the first few of each
anchor, later of each window between an anchor's and a positive's score, and a ranking over what tiles kept ends it.

Defined cases: a row with a null id, label or vector, or a null or non-finite component, takes no part; a missing component
counts as 0; rows with the anchor's id are not its others; repeated rows count each; ties go to the smaller id; other columns
are not read; an empty table gives no rows. Products that could pass 2^63 raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_clean, lean, ranked

#: Rows of a tile, and its columns: 8 MB of sums.
ANCHORS, ROWS = 512, 2048
#: Chunks of dimensions.
CHUNKS = 2

BLOCK = "block long, chunk int, low long, high long, width int, vectors binary, ids binary, labels binary"
TILE = "a long, b long, tile binary, kind string, ids binary, labels binary, aids binary, alabels binary, asked binary"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def _blocked(rows: DataFrame, size: int, chunks: int) -> DataFrame:
    """rows(vec_id, label, vector) as blocks of `size`, a row of the result for each chunk of a block's dimensions."""
    import pyarrow as pa

    def pack(t):
        order = np.lexsort((t.column("vec_id").to_numpy(), t.column("label").to_numpy()))
        vectors = t.column("vector").to_pylist()
        width = max((len(v) for v in vectors), default=0)
        x = np.zeros((len(order), width), np.int64)
        for i, k in enumerate(order):
            x[i, : len(vectors[k])] = vectors[k]
        ids, labels = (t.column(c).to_numpy()[order] for c in ("vec_id", "label"))
        step = max(1, -(-int(t.column("width")[0].as_py()) // chunks))
        parts = [np.ascontiguousarray(x[:, c * step : (c + 1) * step]) for c in range(chunks)]
        n, block = len(parts), t.column("block")[0].as_py()
        return pa.table({
            "block": pa.array([block] * n, pa.int64()), "chunk": pa.array(range(n), pa.int32()),
            "low": pa.array([int(labels[0])] * n, pa.int64()), "high": pa.array([int(labels[-1])] * n, pa.int64()),
            "width": pa.array([p.shape[1] for p in parts], pa.int32()), "vectors": pa.array([p.tobytes() for p in parts], pa.binary()),
            "ids": pa.array([ids.tobytes()] * n, pa.binary()), "labels": pa.array([labels.tobytes()] * n, pa.binary()),
        })

    placed = ranked(rows, F.col("label"), F.col("vec_id"), F.xxhash64("vector"), name="at", label="vectors")
    blocks = placed.withColumn("block", F.floor(F.col("at") / size)).select("block", "vec_id", "label", "vector", "width")
    return cut_clean(blocks.groupBy("block").applyInArrow(pack, BLOCK), "blocks")


def narrow(x: np.ndarray) -> tuple[bytes, str]:
    """Integers in the least width that holds them."""
    most = int(max(x.max(initial=0), -x.min(initial=0)))
    kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 64)) if most < top)
    return x.astype(kind).tobytes(), kind


def _product(chunks: int):
    """The partial tile of one cell."""
    import pyarrow as pa

    def run(key, left, right):
        a, b = left.to_pylist()[0], right.to_pylist()[0]
        x = np.frombuffer(a["vectors"], np.int64).reshape(len(a["ids"]) // 8, a["width"])
        y = np.frombuffer(b["vectors"], np.int64).reshape(len(b["ids"]) // 8, b["width"])
        wide = min(x.shape[1], y.shape[1])
        most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * max(wide, 1) * chunks
        if most >= 2.0**63:
            raise OverflowError("scores beyond 63 bits")
        x, y = x[:, :wide], y[:, :wide]
        # products below 2^53 are exact in doubles
        tile = (x.astype(float) @ y.astype(float).T).astype(np.int64) if most < 2.0**53 else x @ y.T
        raw, kind = narrow(tile)
        one = {"a": key[0], "b": key[1], "tile": raw, "kind": kind, **dict.fromkeys(("ids", "labels", "aids", "alabels", "asked"))}
        if key[2].as_py() == 0:
            one |= {"ids": b["ids"], "labels": b["labels"], "aids": a["ids"], "alabels": a["labels"], "asked": a.get("asked")}
        one["a"], one["b"] = key[0].as_py(), key[1].as_py()
        kinds = [pa.int64()] * 2 + [pa.binary(), pa.string()] + [pa.binary()] * 5
        return pa.table({n: pa.array([v], k) for (n, v), k in zip(one.items(), kinds)})

    return run


def _added(table) -> tuple:
    """Sum of a block pair's tiles, with what their first chunk carries."""
    tiles = table.to_pylist()
    first = next(t for t in tiles if t["ids"] is not None)
    ids, labels, aids, alabels = (np.frombuffer(first[c], np.int64) for c in ("ids", "labels", "aids", "alabels"))
    total = np.zeros((len(aids), len(ids)), np.int64)
    for t in tiles:
        total += np.frombuffer(t["tile"], t["kind"]).reshape(total.shape)
    order = np.argsort(ids, kind="stable")
    return total[:, order], ids[order], labels[order], aids, alabels, first["asked"]


def _tiles(anchors: DataFrame, rows: DataFrame, cells: DataFrame, chunks: int) -> DataFrame:
    """Partial tiles of cells(a, b): each side's chunks go to every cell that asks for its block."""
    left = cells.join(anchors.withColumnRenamed("block", "a"), "a").select("a", "b", "chunk", "width", "vectors", "ids", "labels", *[c for c in ("asked",) if c in anchors.columns])
    right = cells.join(rows.withColumnRenamed("block", "b"), "b").select("a", "b", "chunk", "width", "vectors", "ids", "labels")
    # columns of both sides come from the same cells: give each side its own
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy("a", "b", "chunk").cogroup(right.groupBy("a", "b", "chunk")).applyInArrow(_product(chunks), TILE)


def _firsts(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, greatest first, ties by place."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
        return at[np.argsort(-score[at], kind="stable")][:k]
    return np.argsort(-score, kind="stable")


def _positives(k: int):
    import pyarrow as pa

    def run(table):
        total, ids, labels, aids, alabels, _ = _added(table)
        out = []
        for i, (aid, label) in enumerate(zip(aids, alabels)):
            at = np.flatnonzero((labels == label) & (ids != aid))
            for j in at[_firsts(total[i, at], k)]:
                out.append((i, int(aid), int(ids[j]), int(total[i, j])))
        a = table.column("a")[0].as_py()
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), **{
            n: pa.array([o[c] for o in out], pa.int64()) for c, n in enumerate(("place", "anchor_id", "positive_id", "positive_score"))
        }})

    return run


def _negatives(k: int, low: int, high: int):
    import pyarrow as pa

    names = ("place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(table):
        total, ids, labels, aids, alabels, asked = _added(table)
        windows, out, last = np.frombuffer(asked, np.int64).reshape(-1, 4), [], None
        for place, nth, positive, score in windows.tolist():
            if place != last:
                at = np.flatnonzero(labels != alabels[place])
                at = at[np.argsort(-total[place, at], kind="stable")]
                own, last = -total[place, at], place
            # low * score <= 100 * x <= high * score
            least, most = -((-low * score) // 100), (high * score) // 100
            begin, end = np.searchsorted(own, -most, "left"), np.searchsorted(own, -least, "right")
            for j in range(begin, min(end, begin + k)):
                out.append((place, nth, int(aids[place]), positive, score, int(ids[at[j]]), -int(own[j])))
        a = table.column("a")[0].as_py()
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), **{n: pa.array([o[c] for o in out], pa.int64()) for c, n in enumerate(names)}})

    return run


def _packed(table):
    """Windows of an anchor block, at most its anchors times the positives of one."""
    import pyarrow as pa

    x = np.stack([table.column(c).to_numpy() for c in ("place", "nth", "positive_id", "positive_score")], axis=1)
    x = np.ascontiguousarray(x[np.lexsort((x[:, 1], x[:, 0]))])
    return pa.table({"block": pa.array([table.column("a")[0].as_py()], pa.int64()), "asked": pa.array([x.tobytes()], pa.binary())})


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, chunks: int = CHUNKS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, label, vector of integers)."""
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    base = rows.where(known).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector", anchor.alias("anchor"))
    width = base.agg(F.max(F.size("vector"))).first()[0] or 0
    base = base.withColumn("width", F.lit(width))
    all_, asking = _blocked(base.drop("anchor"), ROWS, chunks), _blocked(base.where("anchor").drop("anchor"), ANCHORS, chunks)
    meta = all_.where("chunk = 0").select(F.col("block").alias("b"), F.col("low").alias("blow"), F.col("high").alias("bhigh"))
    n = meta.count()
    # every anchor block meets every row block: the stated queries against all rows, in blocks
    cells = asking.where(F.lit(n) > 0).where("chunk = 0").select(
        F.col("block").alias("a"), "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))).alias("b")
    ).join(meta, "b")
    same = cells.where("low <= bhigh and blow <= high").select("a", "b")
    kept = "a long, place long, anchor_id long, positive_id long, positive_score long"
    found = _tiles(asking, all_, same, chunks).groupBy("a", "b").applyInArrow(_positives(positives), kept)
    order = Window.partitionBy("a", "place").orderBy(F.desc("positive_score"), "positive_id")
    pairs = cut_clean(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "positives")
    windows = pairs.withColumn("nth", F.col("nth").cast("long")).groupBy("a").applyInArrow(_packed, "block long, asked binary")
    other = cells.where("not (low = high and blow = bhigh and low = blow)").select("a", "b")
    kept = "a long, place long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    tiles = _tiles(asking.join(windows, "block"), all_, other, chunks)
    found = tiles.groupBy("a", "b").applyInArrow(_negatives(negatives, low, high), kept)
    order = Window.partitionBy("a", "place", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
