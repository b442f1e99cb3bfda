"""Exact n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are classes of documents with equal sets of 5-word shingles, columns are shingles. A row of
size n can only reach the bound with a partner that shares one of its first n - ceil(bound * n) + 1 shingles
in a fixed order of all shingles, so only those cells enter the product; any order is right. The order puts the
shingles that fill many of these cells last: counts over all documents find them, and each round counts the cells
that the new order brings in. Cells meet by column in hashed blocks.

The product is taken in two steps, so that a group of near copies costs no pair for each two members:
  1. in each column every row meets its neighbour by size and the column's hub; each row's most frequent neighbour and hub,
     if met in a third of the row's cells, are verified, and links make components;
  2. columns that still hold several components give their cross-component pairs of fitting sizes, where the cell
     may be the first common one of a linked pair, with overlap counts added up. A sketch of parities bounds how many shingles two sets share; pairs below the size-derived bound are discarded in the join; pairs whose count plus all that can follow stays below the size-derived bound are discarded, the
     rest verified.
Verified means: intersection of the whole sets. Every link either is verified or joins rows already in one component.

Null and empty texts have no shingles and stay alone. Rows that repeat a doc_id belong to one component. Rows with a null
doc_id get a stand-in for each class: where there are such rows, ids and then stand-ins are numbered in order, so a stand-in sorts last,
takes part like any other node, and gives a null component if it is the least of its component. Any long is an id like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_clean, lean, ranked, share, sliced
from .components import components

WORDS, BOUND = 5, 80  # words of a shingle; per cent of the union
HOT, HINTS, ROUNDS = 24, 1 << 18, 2
LANES = 8
PARTS = 2  # of the pairs to be verified
BROADCAST = 1_000_000  # rows of a few longs


class Hasher:
    """64-bit hashes of the shingles of texts, a whole text at a time.

    A word's hash is a polynomial over random numbers of its bytes, taken from running sums and mixed."""

    BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self, words: int = WORDS):
        import numpy as np

        self.words, self.size = words, 0
        table = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype="uint64")
        lower = np.frombuffer(bytes(range(256)).lower(), "uint8")
        self.value = table[lower]  # A-Z count as a-z
        self.space = np.isin(np.arange(256), [32, *range(9, 14)])
        self.grow(1 << 18)

    def grow(self, size: int) -> None:
        import numpy as np

        powers = lambda x: np.cumprod(np.concatenate([np.ones(1, "uint64"), np.full(size, x, "uint64")]), dtype="uint64")
        self.power, self.inverse, self.size = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64)), size

    def mixed(self, x):
        import numpy as np

        x = (x ^ (x >> np.uint64(32))) * np.uint64(self.MIX)
        return x ^ (x >> np.uint64(29))

    def shingles(self, text: str | None):
        """Sorted distinct hashes; fewer words than a shingle has make one."""
        import numpy as np

        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "uint8")
        if len(raw) > self.size:
            self.grow(2 * len(raw))
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = self.space[raw]
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = turns[::2], turns[1::2]
        if not len(starts):
            return np.empty(0, "int64")
        sums = np.zeros(len(raw) + 1, "uint64")
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=sums[1:])
        ids = self.mixed((sums[ends] - sums[starts]) * self.inverse[starts])
        n = max(1, len(ids) - self.words + 1)
        out = np.full(n, min(len(ids), self.words), "uint64")
        for i in range(min(self.words, len(ids))):
            out = self.mixed(out + ids[i : i + n])
        out = out.view("int64")
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Order:
    """Hot shingles, sorted, with how many cells each fills. All others come before them, by hash."""

    def __init__(self, hot, times):
        import numpy as np

        self.hot, self.times = hot, times
        self.maybe = np.zeros(1 << 22, bool)  # by the lowest bits: most shingles are told apart without a search
        self.maybe[hot & ((1 << 22) - 1)] = True

    def weights(self, own):
        """How many cells each shingle fills if it is hot, else 0; None if none is."""
        import numpy as np

        at = np.flatnonzero(self.maybe[own & ((1 << 22) - 1)])
        if not len(at):
            return None
        some = own[at]
        place = np.minimum(np.searchsorted(self.hot, some), len(self.hot) - 1)
        out = np.zeros(len(own), "int64")
        out[at] = np.where(self.hot[place] == some, self.times[place], 0)
        return out


def prefix(own, order: Order, bound: int = BOUND):
    """The cells of a sorted set that enter the product: the first in the order."""
    import numpy as np

    n = len(own)
    p = n - -(-bound * n // 100) + 1 if n else 0
    weight = order.weights(own)
    return own[:p] if weight is None else own[np.argsort(weight, kind="stable")[:p]]


def parity(own):
    """64 * LANES bits, each the parity of the shingles that hash to it: two sets differ in as many shingles as bits, at least."""
    import numpy as np

    bits = np.bincount(own & (64 * LANES - 1), minlength=64 * LANES) & 1
    return np.packbits(bits.astype("uint8")).view("int64")


def _documents(batches):
    """Each batch with the whole sets of its rows."""
    hasher = Hasher()
    for batch in sliced(batches, rows=1024):
        yield batch, [hasher.shingles(t) for t in batch.column("text").to_pylist()]


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, "int64")])))


def _fresh_cells(docs: DataFrame, old, new) -> DataFrame:
    """The cells under the order `new` that the order `old` did not have; old None: all."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        order, before = new.value, None if old is None else old.value
        for _, sets in _documents(batches):
            cells = [prefix(s, order) for s in sets]
            if before is not None:
                cells = [
                    np.setdiff1d(c, prefix(s, before), assume_unique=True) for c, s in zip(cells, sets) if len(c) and order.weights(s[: len(c)]) is not None
                ]
            flat = np.concatenate([*cells, np.empty(0, "int64")])
            yield pa.RecordBatch.from_arrays([pa.array(flat)], ["h"])

    return docs.select("text").mapInArrow(lean(run), "h bigint")


def _order(docs: DataFrame):
    """The broadcast order. It lists at most HINTS shingles, the most frequent, whatever
    the data; shingles beyond keep their place by hash, which changes the cost of the product, never its result."""
    import numpy as np

    spark = docs.sparkSession
    hot, times = np.empty(0, "int64"), np.empty(0, "int64")
    old, new = None, share(spark, Order(hot, times))
    for _ in range(ROUNDS):
        counts = _fresh_cells(docs, old, new).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT)
        top = cut_clean(counts.orderBy(F.col("n").desc(), "h").limit(HINTS), "hot").toPandas()
        if top.empty:
            break
        both = np.concatenate([hot, top["h"].to_numpy("int64")])
        add = np.concatenate([times, top["n"].to_numpy("int64")])
        keys, inverse = np.unique(both, return_inverse=True)
        total = np.bincount(inverse, weights=add).astype("int64")
        keep = np.sort(np.lexsort((keys, -total))[:HINTS])
        hot, times = keys[keep], total[keep]
        old, new = new, share(spark, Order(hot, times))
    return new


def _rows(docs: DataFrame, order) -> DataFrame:
    """doc_id, size, class key (16 bytes of the whole set's hash) and cells of every document; the text where the id is null."""
    import pyarrow as pa

    def run(batches):
        import hashlib

        own = order.value
        for batch, sets in _documents(batches):
            keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            ids = batch.column("doc_id")
            texts = batch.column("text")
            bare = pa.array([None if i.is_valid else t.as_py() for i, t in zip(ids, texts)] if ids.null_count else [None] * len(ids), pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 _lists([prefix(s, own) for s in sets]), _lists([parity(s) for s in sets]), bare],
                ["doc_id", "n", "class", "cells", "bits", "bare"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, n bigint, class binary, cells array<bigint>, bits array<bigint>, bare string")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast if its rows, already counted, are few; else joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST else df


def _verified(docs: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """Pairs (a, b) with whether their whole sets reach the bound; docs: node, text.

    Each set is worked out from its text and sent to each pair that asks for it: one exchange of sets, none of texts while the
    pairs are few enough to broadcast."""
    import pyarrow as pa

    count = pairs.count()

    def run(batches):
        for batch, sets in _documents(batches):
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), _lists(sets)], ["a", "b", "own"])

    def side(part: DataFrame, end: str, name: str) -> DataFrame:
        texts = docs.join(small(part, count), docs["node"] == part[end]).select("a", "b", "text")
        return texts.mapInArrow(lean(run), "a bigint, b bigint, own array<bigint>").withColumnRenamed("own", name)

    common = F.size(F.array_intersect("x", "y"))
    reach = 100 * common >= BOUND * (F.size("x") + F.size("y") - common)
    # an id that stands for several texts links if any of them does; one part of the pairs after the other, so that the disk holds the
    # sets of one
    told = lambda part: cut_clean(side(part, "a", "x").join(side(part, "b", "y"), ["a", "b"]).groupBy("a", "b").agg(F.max(reach).alias("link")), label)
    parts = [pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(PARTS)) == i) for i in range(PARTS)] if count > PARTS else [pairs]
    return reduce(lambda x, y: x.union(y), map(told, parts))


def link(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of df (doc_id, text)."""
    docs = df.select("doc_id", "text")
    rows = cut(_rows(docs, _order(docs)), "rows")
    nameless = F.col("doc_id").isNull() & F.col("class").isNotNull()
    some = not rows.filter(nameless).isEmpty()
    if some:
        stand_in = F.when(nameless, F.col("class"))
        names = ranked(rows.filter("doc_id is not null or class is not null").select("doc_id", stand_in.alias("_class")).distinct(), F.col("doc_id").asc_nulls_last(), F.col("_class"), name="node", label="nodes")
        names = cut(names.withColumnsRenamed({"doc_id": "_id"}), "names")
        on = rows["doc_id"].eqNullSafe(names["_id"]) & stand_in.eqNullSafe(names["_class"])
        bare = F.col("doc_id").isNull() & F.col("class").isNull()
        rows = cut(rows.filter(~bare).join(names, on).drop("_id", "_class").unionByName(rows.filter(bare).withColumn("node", F.lit(None).cast("bigint"))), "named")
        docs = docs.join(names.filter("_id is not null").select("_id", "node"), docs["doc_id"] == F.col("_id")).select("node", "text")
    else:
        rows = rows.withColumn("node", F.col("doc_id"))
        docs = docs.filter("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    # the least doc_id of a class stands for it
    classes = rows.filter("class is not null").groupBy("class").agg(F.min("node").alias("node"))
    member = rows.filter("class is not null").select("class", F.col("node").alias("member")).distinct()
    same = cut_clean(classes.join(member, "class").filter("node != member").select("node", "member", "class"), "same")
    copies = small(same.select("class", F.col("member").alias("node")), same.count())
    # rows without an id share their class's stand-in, so one row and one text of a class do
    texts, told = docs, rows.filter("class is not null and doc_id is not null")
    if some:
        bare = cut(rows.filter("class is not null and doc_id is null").dropDuplicates(["class"]), "bare")
        texts, told = texts.union(bare.select("node", F.col("bare").alias("text"))), told.union(bare)
    chosen = told.join(copies, ["class", "node"], "left_anti").select("node", "n", F.posexplode("cells").alias("at", "h"))
    line = Window.partitionBy("h").orderBy("n", "node")
    column = Window.partitionBy("h")
    cells = cut_clean(
        chosen.withColumns({"prev": F.lag("node").over(line), "prev_n": F.lag("n").over(line), "df": F.count("*").over(column)})
        .filter("df > 1"),
        "cells",
    )
    # a row's hub in a column is the member with the most cells shared by others: the one that near copies are copies of
    shared = cells.groupBy("node").agg(F.count("*").alias("s"))
    rank = F.struct("s", F.bitwise_not("node").alias("low"), "n")
    hubs = cells.join(shared, "node").groupBy("h").agg(F.max(rank).alias("m")).select("h", F.bitwise_not("m.low").alias("hub"), F.col("m.n").alias("hub_n"))
    near = cells.filter("prev is not null").select("node", "n", F.col("prev").alias("to"), F.col("prev_n").alias("to_n"), F.lit(0).alias("kind"))
    far = cells.join(hubs, "h").select("node", "n", F.col("hub").alias("to"), F.col("hub_n").alias("to_n"), F.lit(1).alias("kind"))
    fits = F.least("n", "to_n") * 100 >= F.greatest("n", "to_n") * BOUND
    # near copies meet in most of their columns; other pairs are left to the second step
    votes = near.union(far).filter(fits & (F.col("to") != F.col("node"))).groupBy("node", "to", "kind", "n").agg(F.count("*").alias("c"))
    best = votes.filter(F.col("c") * 15 >= F.col("n")).groupBy("node", "kind").agg(F.max(F.struct("c", F.bitwise_not("to").alias("low"))).alias("m"))
    to = F.bitwise_not("m.low")
    first = cut_clean(best.select(F.least("node", to).alias("a"), F.greatest("node", to).alias("b")).distinct(), "first")
    tested = _verified(texts, first, "tested")
    made = components(tested.filter("link"))
    seen = cells.join(made, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("prev", "prev_n", "df")
    mixed = seen.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("h")
    open_ = seen.join(mixed, "h", "left_semi")
    lanes = [f"b{i}" for i in range(LANES)]
    sketch = rows.filter("class is not null").groupBy("node", "n").agg(*[F.min(F.get("bits", F.lit(i))).alias(b) for i, b in enumerate(lanes)], F.min("class").alias("lo"), F.max("class").alias("hi"))
    # an id that stands for several texts has no sketch of its own: nulls discard nothing
    sketch = sketch.select("node", "n", *[F.when(F.col("lo") == F.col("hi"), F.col(b)).alias(b) for b in lanes])
    open_ = cut_clean(open_.join(sketch, ["node", "n"]), "open")
    kept = ("node", "n", "at", "component", *lanes)
    x = open_.select("h", *[F.col(c).alias(f"{c}_a") for c in kept])
    y = open_.select("h", *[F.col(c).alias(f"{c}_b") for c in kept])
    fewer = F.least("n_a", "n_b")
    # an overlap o reaches the bound when o * (100 + BOUND) >= BOUND * (n_a + n_b); the first common cell leaves room for it
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in lanes])
    least = F.ceil((F.col("n_a") + F.col("n_b")) * BOUND / (100 + BOUND) - 1e-9)
    met = (
        x.join(y, "h")
        .filter("node_a < node_b and component_a != component_b")
        .filter(fewer * 100 >= F.greatest("n_a", "n_b") * BOUND)
        .filter(F.coalesce(differ, F.lit(0)) <= F.col("n_a") + F.col("n_b") - least * 2)
        .filter((F.col("at_a") + least <= F.col("n_a")) & (F.col("at_b") + least <= F.col("n_b")))
        .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b")
        .agg(F.count("*").alias("c"), F.max("at_a").alias("last_a"), F.max("at_b").alias("last_b"))
    )
    can = F.col("c") + F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    rest = met.filter(can * (100 + BOUND) >= BOUND * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    rest = cut_clean(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    more = _verified(texts, rest, "more")
    links = tested.filter("link").select("a", "b").union(more.filter("link").select("a", "b"))
    # a repeated id stands for all its texts; copies hang on their class's least id
    done = components(links.union(same.select(F.col("node").alias("a"), F.col("member").alias("b")).distinct()))
    out = rows.select("doc_id", "node", F.col("n").alias("n_shingles")).join(done, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    if some:
        back = names.filter("_id is not null").select(F.col("node").alias("_node"), F.col("_id"))
        out = out.join(back, out["component_id"] == back["_node"], "left").select("doc_id", "n_shingles", F.col("_id").alias("component_id"))
    return out
