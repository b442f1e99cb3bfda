"""Exact top-k by inner product: M-trees searched best-first.

Components become floor(256 * x). Inner products turn into distances by one more coordinate that gives all vectors of a tree the same
norm M: d^2 = |q|^2 + M^2 - 2 q.x, so the nearest have the highest scores. Equal vectors are one object that keeps its k + 1
smallest ids: no answer needs more.

Objects go to the nearest of a bounded number of pivots, large clusters are split by hash, and each part of at most BLOCK objects becomes
one M-tree: pages of PAGE entries, each entry with covering radius and distance to its parent. A search opens the leaf with
the least possible distance first, then those next to it, until a leaf lies beyond its reach. |d(q, parent) - d(entry, parent)| - radius
bounds a distance from below without working it out, and so does d(q, entry) - radius. Up to MANY queries search together: all that
open a page meet it as one matrix. Every query first searches a tree of its own cluster; its k-th score is the
floor for all others. With a pivot p and the distance r of its cluster's furthest member, q.x is at most q.p + |q| r: queries are not
sent to trees of clusters that lie below their floor.

Products are exact: in doubles while the greatest squared norm, which bounds every product, is below 2^53, beyond that in 64-bit
integers, up to 2^63; above, top_k raises an error.

Vectors that are null, empty or hold a null or non-finite component take no part; shorter ones count as padded with zeros. Rows that repeat
id and vector count once. Columns besides id and vector are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, share

K, STEP, SCALE, BLOCK, PAGE, PIVOTS, PANEL, MANY = 5, 50, 256.0, 16_384, 48, 1024, 32_768, 1024
LOWEST = {"f": float("-inf"), "i": -(1 << 63)}  # below all scores


class MTree:
    """An M-tree over integer vectors (n, d) as float64; exact: the same as int64, for products that doubles can't hold."""

    def __init__(self, objects, page: int = PAGE, exact=None):
        import numpy as np

        self.exact = exact

        norms = (objects * objects).sum(1)
        self.most = float(norms.max(initial=0.0))
        self.lifted = np.concatenate([objects, np.sqrt(np.maximum(self.most - norms, 0.0))[:, None]], 1)
        self.page, self.nodes = page, []
        self.order = np.arange(len(objects))
        if len(objects):
            self.top = self.build(self.order.copy(), None)

    def away(self, idx, center):
        import numpy as np

        diff = self.lifted[idx] - center
        return np.sqrt(np.maximum((diff * diff).sum(1), 0.0))

    def build(self, idx, parent):
        """A node (center, radius, to parent, children or None, members, their distances)."""
        import numpy as np

        center = self.lifted[idx].mean(0)
        far = self.away(idx, center)
        up = 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum()))
        if len(idx) <= self.page or far.max() == 0.0:
            self.nodes.append((center, float(far.max(initial=0.0)), up, None, idx, far))
            return len(self.nodes) - 1
        # routing objects: farthest from those chosen so far
        count = min(self.page, -(-len(idx) // self.page) + 1, 16)
        chosen, near = [int(far.argmax())], None
        label = np.zeros(len(idx), "int64")
        for c in range(count):
            d = self.away(idx, self.lifted[idx[chosen[c]]])
            if near is None:
                near = d
            else:
                closer = d < near
                label[closer], near = c, np.minimum(near, d)
            if near.max() == 0.0:
                break
            chosen.append(int(near.argmax()))
        groups = [idx[label == c] for c in np.unique(label)]
        kids = [self.build(g, center) for g in groups]
        self.nodes.append((center, float(far.max()), up, np.array(kids), None, None))
        return len(self.nodes) - 1

    def pack(self):
        import numpy as np

        for at, (_, _, _, kids, _, _) in enumerate(self.nodes):
            if kids is not None:
                centers = np.stack([self.nodes[k][0] for k in kids])
                self.nodes[at] += (centers, np.array([self.nodes[k][1] for k in kids]), np.array([self.nodes[k][2] for k in kids]))
        return self

    def search(self, queries, first_id, k: int, floor, whole=None):
        """Of each query up to k objects, by score and then first_id, none below its floor, as arrays: query, score, object. whole: the
        queries as int64 where products must be; floor is of the type of the scores."""
        import numpy as np

        parts = [self.some(queries[i : i + MANY], first_id, k, floor[i : i + MANY], None if whole is None else whole[i : i + MANY]) for i in range(0, len(queries), MANY)]
        if not self.nodes or not parts:
            return np.empty(0, "int64"), np.empty(0, floor.dtype), np.empty(0, "int64")
        return tuple(np.concatenate(x) for x in zip(*[(q + i * MANY, s, m) for i, (q, s, m) in enumerate(parts)]))

    def some(self, queries, first_id, k: int, floor, whole):
        """search() of MANY queries at most: what they open together, they meet as one matrix."""
        import numpy as np

        n, lowest = len(queries), LOWEST[floor.dtype.kind]
        lift = np.append(queries, np.zeros((n, 1)), 1)
        own = (queries * queries).sum(1)
        total = own + self.most
        slack = 1e-6 + 1e-6 * np.sqrt(total)  # distances come from products
        best, found = np.full((n, k), lowest, floor.dtype), np.full((n, k), -1)

        def reach(rows):
            """The distances beyond which scores lie below what a query has or asks for."""
            least = np.maximum(floor[rows], best[rows, -1])
            far = np.sqrt(np.maximum(total[rows] - 2 * np.where(least == lowest, 0, least).astype("float64"), 0.0)) + slack[rows]
            return least, np.where(least == lowest, np.inf, far)

        def away(rows, centers):
            return np.sqrt(np.maximum(own[rows, None] + (centers * centers).sum(1) - 2 * (lift[rows] @ centers.T), 0.0))

        # the leaves that each query can reach, and their least possible distances
        bound, every = reach(np.arange(n))[1], np.arange(n)
        leaves, spots = [], []
        todo = [(self.top, every, away(every, self.nodes[self.top][0][None])[:, 0])] if self.nodes else []
        while todo:
            at, rows, d = todo.pop()
            node = self.nodes[at]
            if node[3] is None:
                leaves.append(at), spots.append((rows, np.maximum(d - node[1], 0.0)))
                continue
            _, _, _, kids, _, _, centers, radii, ups = node
            maybe = np.abs(d[:, None] - ups) - radii <= bound[rows, None]
            rows, some = rows[maybe.any(1)], np.flatnonzero(maybe.any(0))
            d = away(rows, centers[some])
            for j, c in enumerate(some):
                near = d[:, j] - radii[c] <= bound[rows]
                if near.any():
                    todo.append((int(kids[c]), rows[near], d[near, j]))
        low = np.full((n, len(leaves)), np.inf)
        for i, (rows, least_away) in enumerate(spots):
            low[rows, i] = least_away
        order = low.argsort(1, kind="stable")
        low = np.take_along_axis(low, order, 1)
        # each query opens its nearest leaf, then as many of the next as so far, until one lies beyond its reach
        rows, at, width = every, 0, 1
        while at < len(leaves) and len(rows):
            least, far = reach(rows)
            part = low[rows, at : at + width]
            open_ = (part <= far[:, None]) & (part < np.inf)
            q, j = np.nonzero(open_)
            self.meet(queries if whole is None else whole, [leaves, order[rows[q], at + j]], rows[q], least[q], first_id, best, found)
            rows, at, width = rows[open_[:, -1]], at + width, max(1, at + width)
        q, j = np.nonzero(found >= 0)
        return q, best[q, j], found[q, j]

    def meet(self, queries, opened, rows, least, first_id, best, found) -> None:
        """Products of queries (rows) and the members of the leaves that they opened; those that count go into best and found."""
        import numpy as np

        leaves, leaf = opened
        by = np.argsort(leaf, kind="stable")
        leaf, rows, least = leaf[by], rows[by], least[by]
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else []
        objects, got = self.lifted[:, :-1] if self.exact is None else self.exact, []
        for a, b in zip(starts, [*starts[1:], len(leaf)]):
            members = self.nodes[leaves[leaf[a]]][4]
            scores = queries[rows[a:b]] @ objects[members].T
            q, j = np.nonzero(scores >= least[a:b, None])
            got.append((rows[a:b][q], scores[q, j], members[j]))
        if not got:
            return
        row, score, member = (np.concatenate(x) for x in zip(*got))
        k, had = best.shape[1], np.unique(row)
        row, score, member = np.r_[row, np.repeat(had, k)], np.r_[score, best[had].ravel()], np.r_[member, found[had].ravel()]
        row, score, member = row[member >= 0], score[member >= 0], member[member >= 0]
        by = np.lexsort((first_id[member], ~score if score.dtype.kind == "i" else -score, row))
        row, score, member = row[by], score[by], member[by]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        top = nth < k
        best[row[top], nth[top]], found[row[top], nth[top]] = score[top], member[top]


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (integers as doubles) of the rows that take part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    rows = rows.filter(F.forall(vector, lambda x: F.coalesce(sound(x.cast("double")), F.lit(False))))
    return rows.select(F.col(key).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(column, width: int, kind: str = "float64"):
    """A list column as a matrix, shorter lists padded with zeros."""
    import numpy as np

    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(kind)
    out = np.zeros((len(lists), width), kind)
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] : ends[-1]]
    return out


def top_k(df: DataFrame, k: int = K, step: int = STEP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of each row whose id is divisible by step."""
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    rows = vectors(df, key, vector)
    firsts = Window.partitionBy("v").orderBy("vec_id")
    # a group limit runs before the shuffle too: k + 1 rows of a vector leave each task
    few = rows.dropDuplicates(["v", "vec_id"]).withColumn("_n", F.row_number().over(firsts)).filter(F.col("_n") <= k + 1)
    objects = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    objects = cut(objects.withColumn("obj", F.monotonically_increasing_id()), "objects")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = objects.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width"), F.max(norm).alias("norm")).first()
    total, width, most = facts["n"], facts["width"], facts["norm"] or 0.0
    if most >= 2**63:
        raise ArithmeticError("an inner product may exceed 64 bits")
    large = most >= 2**52
    asked = rows.filter(F.col("vec_id") % step == 0).distinct()
    asking = cut(asked.join(objects.select("v", "obj"), "v").select(F.col("vec_id").alias("query_id"), "obj"), "asking")
    heads = min(PIVOTS, max(1, total // BLOCK))
    drawn = objects.orderBy(F.xxhash64("v"), "obj").limit(heads).select("v").toArrow()  # PIVOTS rows at most
    pivots = _matrix(drawn.column("v"), width) if len(drawn) else np.zeros((1, width))
    shared = share(spark, pivots)  # PIVOTS vectors at most

    def place(batches):
        p = shared.value
        own = (p * p).sum(1) / 2
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            near = (x @ p.T - own).argmax(1) if len(x) else np.empty(0, "int64")
            far = np.sqrt(((x - p[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype("int32")), pa.array(far)], [*batch.schema.names, "cluster", "far"])

    placed = cut(objects.mapInArrow(place, "v array<bigint>, ids array<bigint>, obj bigint, cluster int, far double"), "placed")
    known = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # PIVOTS rows at most
    sizes, radius = {c: r["n"] for c, r in known.items()}, np.array([known[c]["far"] if c in known else -np.inf for c in range(len(pivots))])
    split = [max(1, -(-sizes.get(c, 0) // BLOCK)) for c in range(len(pivots))]
    start = np.concatenate([[0], np.cumsum(split)]).astype(int).tolist()
    ints = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    part = F.pmod(F.xxhash64("obj"), F.get(ints(split), F.col("cluster"))).cast("int")
    placed = placed.withColumn("tree", F.get(ints(start), F.col("cluster")) + part)
    trees = start[-1]
    queries = placed.join(asking.select("obj").distinct(), "obj", "left_semi").select(
        "obj", "v", F.get(ints(start), F.col("cluster")).alias("home")
    )
    panel = F.pmod(F.xxhash64("obj"), F.lit(max(1, -(-total // step // PANEL)))).cast("int")
    panels = max(1, -(-total // step // PANEL))
    queries = cut(queries.withColumn("panel", panel), "queries")

    def run(_, left, right):
        import pyarrow.compute as pc

        kind = "int64" if large else "float64"
        x, ids = _matrix(left.column("v"), width), left.column("ids").combine_chunks()
        first = pc.list_element(ids, 0).to_numpy(zero_copy_only=False) if len(ids) else np.empty(0, "int64")
        tree = MTree(x, exact=_matrix(left.column("v"), width, kind) if large else None).pack()
        least = right.column("floor")
        floor = np.where(least.is_null().to_numpy(), LOWEST[np.dtype(kind).kind], least.fill_null(0).to_numpy().astype(kind))
        row, score, member = tree.search(_matrix(right.column("v"), width), first, k + 1, floor.astype(kind), _matrix(right.column("v"), width, kind) if large else None)
        obj = right.column("obj").to_numpy()[row]
        return pa.table([pa.array(obj, pa.int64()), pa.array(score.astype("int64")), ids.take(pa.array(member))], ["obj", "score", "ids"])

    def searched(asked_: DataFrame):
        """Each tree meets the queries sent to it, a panel of queries at a time."""
        blocks = placed.withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))).select("tree", "panel", "v", "ids")
        return blocks.groupBy("tree", "panel").cogroup(asked_.groupBy("tree", "panel")).applyInArrow(run, "obj bigint, score bigint, ids array<bigint>")

    home = cut(searched(queries.select(F.col("home").alias("tree"), "panel", "obj", "v", F.lit(None).cast("bigint").alias("floor"))), "home")
    best = Window.partitionBy("obj").orderBy(F.col("score").desc(), F.get("ids", F.lit(0)))
    floors = home.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k + 1).select("obj", F.col("score").alias("floor"))

    def reachable(batches):
        p = shared.value
        for batch in batches:
            q = _matrix(batch.column("v"), width)
            least = batch.column("floor").to_numpy(zero_copy_only=False).astype("float64")  # null: not a number, so nothing is below
            bound = q @ p.T + np.sqrt((q * q).sum(1))[:, None] * radius
            slack = 1 + 1e-9 * (np.abs(bound) + most)
            ends = [np.flatnonzero(~(row < x)).astype("int32") for row, x in zip(bound + slack, least)]
            lists = pa.array([e.tolist() for e in ends], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "clusters"])

    away = queries.join(floors, "obj", "left").select("obj", "v", "home", "panel", "floor")
    away = away.mapInArrow(reachable, "obj bigint, v array<bigint>, home int, panel int, floor bigint, clusters array<int>")
    away = away.withColumn("cluster", F.explode("clusters")).filter(F.get(ints(split), F.col("cluster")) > 0)
    first_tree = F.get(ints(start), F.col("cluster"))
    away = away.withColumn("tree", F.explode(F.sequence(first_tree, first_tree + F.get(ints(split), F.col("cluster")) - 1))).filter("tree != home")
    rest = searched(away.select("tree", "panel", "obj", "v", "floor"))
    kept = home.unionByName(rest).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    answers = asking.join(kept, "obj").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id").distinct()
    line = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(line).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
