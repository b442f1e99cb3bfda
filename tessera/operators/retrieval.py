"""Retrieval operators on DataFrames: lexical index and ranking, exact dense search, fusion, caps, metrics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

K1, B, RRF_K, MMR_LAMBDA = 1.2, 0.75, 60, 0.5


def slices(batch, lists: str, entries: int = 100_000):
    """Slices of an Arrow batch with at most `entries` elements in the column `lists`, or of one row with more: what a worker makes of a
    slice depends neither on the batch nor on the partition."""
    import numpy as np

    ends, at = np.cumsum(batch.column(lists).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + entries, "right")))
        yield batch.slice(at, end - at)
        at = end


def counted(docs: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """key, len, terms, tfs: one tokenisation of each text, its terms counted where it stands, without a shuffle; rows without a key are none."""
    import pyarrow as pa

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "_t")):
            bags = [Counter(t or ()) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(b.values()) for b in bags], pa.int64()), pa.array([list(b) for b in bags], pa.list_(pa.string())),
                 pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))], [key, "len", "terms", "tfs"])

    own = docs.where(F.col(key).isNotNull()).select(key, T.tokens(F.col(text), level).alias("_t"))
    return own.mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, len bigint, terms array<string>, tfs array<bigint>")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: rows are dealt anew only where a scan has fewer partitions than there are cores, as a single file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def postings(bags: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf, len of counted()'s rows."""
    return bags.select(key, "len", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))


@dataclass
class LexicalIndex:
    """doc_id, len, terms, tfs and ids (64-bit hashes of the terms) of every document, a row each; those without terms too.

    Rankings meet terms by hash: two of a billion terms share one with a chance of 3 in 100."""

    docs: DataFrame
    level: str = T.PLAIN
    kept: DataFrame | None = None  # term, df, where they are stored

    @classmethod
    def of(cls, docs: DataFrame, level: str = T.PLAIN) -> LexicalIndex:
        return cls(counted(spread(docs.select("doc_id", "text")), "doc_id", "text", level).withColumn("ids", F.transform("terms", lambda t: F.xxhash64(t))), level)

    def at(self, level: str) -> LexicalIndex:
        """This plain index at a level that drops or shortens terms: from the counted terms, no text is read again."""
        stop, arabic = F.array(*map(F.lit, T.STOPWORDS)), lambda t: t >= "ء"
        kept = F.filter(F.arrays_zip("terms", "tfs"), lambda p: ~arabic(p["terms"]) | ~F.array_contains(stop, p["terms"]))
        own = self.docs.select("doc_id", kept.alias("_p"))
        if level == T.STRIPPED:
            short = lambda t: F.when(arabic(t), T.strip_clitics(t)).otherwise(t)
            own = own.withColumn("_p", F.transform("_p", lambda p: F.struct(short(p["terms"]).alias("terms"), p["tfs"].alias("tfs"))))
            total = lambda t: F.aggregate(F.filter("_p", lambda p: p["terms"] == t), F.lit(0).cast("bigint"), lambda a, p: a + p["tfs"])
            merged = F.transform(F.array_distinct("_p.terms"), lambda t: F.struct(t.alias("terms"), total(t).alias("tfs")))
            own = own.withColumn("_p", F.when(F.size(F.array_distinct("_p.terms")) < F.size("_p"), merged).otherwise(F.col("_p")))
        size = F.aggregate("_p.tfs", F.lit(0).cast("bigint"), lambda a, n: a + n)
        own = own.select("doc_id", size.alias("len"), F.col("_p.terms").alias("terms"), F.col("_p.tfs").alias("tfs"))
        return LexicalIndex(own.withColumn("ids", F.transform("terms", lambda t: F.xxhash64(t))), level)

    def stored(self, path: str) -> LexicalIndex:
        """The same, written once and read by all that rank: later questions scan counted terms, not texts."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        own = LexicalIndex(spark.read.schema(self.docs.schema).parquet(f"{path}/docs"), self.level)
        own.df.write.mode("overwrite").parquet(f"{path}/terms")
        own.kept = spark.read.schema(own.df.schema).parquet(f"{path}/terms")
        return own

    @property
    def df(self) -> DataFrame:
        """term, df."""
        return self.kept if self.kept is not None else self.tf.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def tf(self) -> DataFrame:
        return postings(self.docs)

    @property
    def stats(self) -> DataFrame:
        """n_docs, avgdl; one row."""
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.col("len").cast("double")), F.lit(0.0)).alias("avgdl"))

    def terms(self) -> DataFrame:
        """term, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
        return self.df.crossJoin(F.broadcast(self.stats)).select("term", "df", _idf().alias("idf"))


def _idf() -> Column:
    return F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25(index: LexicalIndex, questions: DataFrame, qid: str = "item_id", k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, rnk <= k. Repeated question tokens count repeatedly; ties go to the smaller doc_id; documents that share
    no term with a question have score 0 and follow by id.

    allowed (doc_id): what may be ranked; idf and lengths stay those of the whole corpus, other documents go before they are scored."""
    qtf = postings(counted(questions, qid, "text", index.level), qid).select(qid, "term", F.col("tf").alias("qtf"))
    asked = qtf.join(index.df, "term").crossJoin(F.broadcast(index.stats)).select(qid, "term", (_idf() * F.col("qtf")).alias("weight"), "avgdl")
    docs = index.docs if allowed is None else index.docs.join(allowed, "doc_id", "left_semi")
    best = products(docs, asked, qid, k)
    # a question that met fewer than k: the least ids fill up, so 2 * k rows a question are enough
    short = questions.select(qid).where(F.col(qid).isNotNull()).join(best.filter(F.col("rnk") == k).select(qid), qid, "left_anti")
    fill = short.crossJoin(F.broadcast(docs.select("doc_id").orderBy("doc_id").limit(2 * k))).join(best.select(qid, "doc_id"), [qid, "doc_id"], "left_anti")
    return top(best.drop("rnk").unionByName(fill.withColumn("score", F.lit(0.0))), qid, "score", "doc_id", k)


def products(docs: DataFrame, asked: DataFrame, qid: str, k: int, entries: int = 2_000_000) -> DataFrame:
    """qid, doc_id, score, rnk <= k: sums of weight * saturated tf (with avgdl in asked) or weight * ln(1 + tf) over shared terms.

    asked (qid, term, weight[, avgdl]) goes to the workers as numbers, at most `entries` rows of 32 bytes, and there becomes blocks of
    a terms x questions matrix. A slice of documents becomes a matrix of its own, documents x terms of the block, and their
    product leaves k rows a question. Beyond that many rows, terms meet in a join."""
    saturated = "avgdl" in asked.columns
    rows = asked.select(qid, F.xxhash64("term").alias("id"), "weight", *(["avgdl"] if saturated else [])).limit(entries + 1).toPandas()
    if len(rows) > entries:
        one = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))) if saturated else F.log1p("tf")
        met = asked.join(postings(docs), "term").groupBy(qid, "doc_id").agg(F.round(F.sum(F.col("weight") * one), 6).alias("score"))
        return top(met, qid, "score", "doc_id", k)
    avgdl = float(rows["avgdl"].iloc[0]) if saturated and len(rows) else 1.0
    rows = rows.sort_values(qid)
    shared = docs.sparkSession.sparkContext.broadcast((rows[qid].to_numpy("int64"), rows["id"].to_numpy("int64"), rows["weight"].to_numpy("float64")))
    cells = 1_000_000  # doubles of a block's matrix and of a slice's

    def blocks(asked_ids, ids, weights):
        """Vocabulary, cells and questions of each block, cut where its matrix or its questions would grow too many."""
        import numpy as np

        names, starts = np.unique(asked_ids, return_index=True)
        ends, at = np.append(starts[1:], len(asked_ids)), 0
        while at < len(names):
            width = max(1, min(512, len(names) - at))
            while width > 1 and len(np.unique(ids[starts[at] : ends[at + width - 1]])) * width > cells:
                width //= 2
            part = slice(starts[at], ends[at + width - 1])
            vocabulary, row = np.unique(ids[part], return_inverse=True)
            yield vocabulary, row.astype("int32"), np.searchsorted(names[at : at + width], asked_ids[part]).astype("int16"), weights[part], names[at : at + width]
            at += width

    def run(batches):
        import numpy as np
        import pyarrow as pa

        # blocks stay lists of cells; one at a time is a matrix
        made = list(blocks(*shared.value))
        for batch in (part for whole in batches for part in slices(whole, "ids", 250_000)):
            docs_, length, bags, tfs = (batch.column(c) for c in ("doc_id", "len", "ids", "tfs"))
            ids, length = docs_.to_numpy(zero_copy_only=False), length.to_numpy(zero_copy_only=False)
            sizes = bags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, n = bags.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), sizes)
            worth = n * (K1 + 1) / (n + K1 * (1 - B + B * length[row] / avgdl)) if saturated else np.log1p(n)
            for vocabulary, at, column, weights, own in made:
                matrix = np.zeros((len(vocabulary), len(own)))
                np.add.at(matrix, (at, column), weights)
                place = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                hit = vocabulary[place] == flat
                rows_, columns, values = row[hit], place[hit], worth[hit]
                step = max(1, cells // len(vocabulary))
                for low in range(0, len(ids), step):
                    a, b = np.searchsorted(rows_, (low, low + step))
                    slice_ids = ids[low : low + step]
                    bag = np.zeros((len(slice_ids), len(vocabulary)))
                    bag[rows_[a:b] - low, columns[a:b]] = values[a:b]
                    scores = np.round(bag @ matrix, 6)
                    out = ([], [], [])
                    for j, name in enumerate(own):
                        found = np.flatnonzero(scores[:, j] > 0)
                        if len(found) > k:
                            found = found[scores[found, j] >= np.partition(scores[found, j], -k)[-k]]
                            found = found[np.lexsort((slice_ids[found], -scores[found, j]))[:k]]
                        out[0].append(np.full(len(found), name)), out[1].append(slice_ids[found]), out[2].append(scores[found, j])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(t)) for o, t in zip(out, ("int64", "int64", "float64"))], [qid, "doc_id", "score"])

    own = docs if "ids" in docs.columns else docs.withColumn("ids", F.transform("terms", lambda t: F.xxhash64(t)))
    return top(own.select("doc_id", "len", "ids", "tfs").mapInArrow(run, f"{qid} bigint, doc_id bigint, score double"), qid, "score", "doc_id", k)


def top(scored: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The k best of each group; a group limit runs before the exchange."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), key)
    return scored.withColumn("rnk", F.row_number().over(w).cast("int")).filter(F.col("rnk") <= k)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return vector.isNotNull() & F.forall(F.coalesce(vector, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 4096, panel: int = 2048) -> DataFrame:
    """qid, vec_id, cos, rnk: a stated query set (qid, q) against all vectors, as matrix products of blocks and panels.

    A block of vectors and a panel of queries are one row each, so what meets are rows of some MB; each product leaves k rows a query.
    Rows without an id or a vector, or with a null or non-finite component, take no part on either side."""
    import numpy as np
    import pyarrow as pa

    def packed(df: DataFrame, key: str, vector: str, size: int, names: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size)
                    wide = max(part.column(1).value_lengths().to_pylist(), default=0)
                    m = np.array([list(x) + [0.0] * (wide - len(x)) for x in part.column(1).to_pylist()], "float64").reshape(part.num_rows, wide)
                    norm = np.sqrt((m * m).sum(1))
                    m = m / np.where(norm > 0, norm, 1)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype("int64").tobytes()]), pa.array([wide], pa.int32()), pa.array([m.tobytes()])], [f"{names}_ids", f"{names}_w", f"{names}_m"])

        return df.select(F.col(key).cast("bigint"), vector).filter(F.col(key).isNotNull() & finite(F.col(vector))).mapInArrow(run, f"{names}_ids binary, {names}_w int, {names}_m binary")

    def product(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, q = (np.frombuffer(r[f"{n}_m"]).reshape(-1, r[f"{n}_w"]) for n in "xq")
                ids, asked = (np.frombuffer(r[f"{n}_ids"], "int64") for n in "xq")
                wide = min(x.shape[1], q.shape[1])
                cos = np.round(q[:, :wide] @ x[:, :wide].T, 6)
                out = ([], [], [])
                for row, own in zip(cos, asked):
                    own_rows = np.flatnonzero(ids != own)
                    # all that reach the k-th score, so that ties are settled by id
                    if len(own_rows) > k:
                        own_rows = own_rows[row[own_rows] >= np.partition(row[own_rows], -k)[-k]]
                        own_rows = own_rows[np.lexsort((ids[own_rows], -row[own_rows]))[:k]]
                    out[0].extend([own] * len(own_rows))
                    out[1].extend(ids[own_rows])
                    out[2].extend(row[own_rows])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qid", "vec_id", "cos"])

    met = packed(vectors, "vec_id", "embedding", block, "x").crossJoin(packed(queries, "qid", "q", panel, "q"))
    return top(met.mapInArrow(product, "qid bigint, vec_id bigint, cos double"), "qid", "cos", "vec_id", k)


def mmr(candidates: DataFrame, k: int = 10, lambda_: float = MMR_LAMBDA) -> DataFrame:
    """qid, vec_id, pick (from 1): greedy choice of lambda * relevance - (1 - lambda) * greatest likeness to what is chosen.

    candidates: qid, q, vec_id, embedding, few a question (a leg's top). The first pick is the most relevant; ties go to the smaller id."""
    import numpy as np

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(-1, keepdims=True)), 1e-12)
        x, q = unit(np.array(group["embedding"].tolist(), "float64")), unit(np.array(group["q"].iloc[0], "float64"))
        rel, left, near, picks = x @ q, list(range(len(x))), np.full(len(x), -np.inf), []
        while left and len(picks) < k:
            worth = rel[left] if not picks else lambda_ * rel[left] - (1 - lambda_) * near[left]
            i = left.pop(int(np.argmax(np.round(worth, 9))))
            picks.append(i)
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({"qid": group["qid"].iloc[0], "vec_id": group["vec_id"].to_numpy()[picks], "pick": range(1, len(picks) + 1)})

    return candidates.groupBy("qid").applyInPandas(chosen, "qid bigint, vec_id bigint, pick int")


def contained(passages: DataFrame, docs: DataFrame, words: int = 3) -> DataFrame:
    """item_id, doc_id: documents whose text holds a passage (item_id, text), by anchors.

    An anchor is `words` words of a passage after its first: between blanks inside it, so they stand whole in each text that holds it.
    Texts and passages meet on anchors, then the texts that met are tested. Passages with fewer words meet all texts."""
    split = lambda c: F.split(c, " ")
    gram = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(words)])
    p = passages.select("item_id", F.col("text").alias("passage")).filter("passage is not null").withColumn("_w", split("passage"))
    long, short = p.filter(F.size("_w") >= words + 2), p.filter(F.size("_w") < words + 2)
    anchors = long.select("item_id", "passage", gram(F.col("_w"), F.lit(1)).alias("_g"))
    texts = docs.select("doc_id", "text").filter("text is not null")
    spots = texts.select("doc_id", split("text").alias("_w")).filter(F.size("_w") >= words)
    spots = spots.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("_w") - words), lambda i: gram(F.col("_w"), i))).alias("_g"))
    met = spots.join(anchors.select("item_id", "_g"), "_g").select("item_id", "doc_id").distinct().join(long.select("item_id", "passage"), "item_id")
    tested = met.join(texts, "doc_id").filter(F.contains("text", "passage")).select("item_id", "doc_id")
    rest = texts.join(short, F.contains(texts["text"], short["passage"])).select("item_id", "doc_id")
    return tested.unionByName(rest).distinct()


def rrf(legs: DataFrame, qid: str = "item_id", k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of (qid, doc_id, rnk) rows of any number of legs."""
    fused = legs.groupBy(qid, "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rnk"))), 8).alias("rrf"))
    return top(fused, qid, "rrf", "doc_id", k)


def fuse_queries(ranked: DataFrame, qid: str, sub: str, k: int = 10) -> DataFrame:
    """qid, doc_id, rnk, score and absolute from (qid, sub, doc_id, rnk, score): the rankings of a question's sub-questions fused
    by rank. A question with one ranking keeps it, cut at k, and its scores stay absolute; fused ones are not."""
    single = ranked.groupBy(qid).agg((F.min(sub) == F.max(sub)).alias("_one"))
    rows = ranked.join(single, qid)
    alone = rows.filter(F.col("_one") & (F.col("rnk") <= k)).select(qid, "doc_id", "rnk", "score", F.lit(True).alias("absolute"))
    fused = rrf(rows.filter(~F.col("_one")), qid, k).select(qid, "doc_id", "rnk", F.col("rrf").alias("score"), F.lit(False).alias("absolute"))
    return alone.unionByName(fused)


def caps(ranked: DataFrame, qid: str, per_source: int, per_page: int) -> DataFrame:
    """Keeps of each question per_source rows of a source and per_page of a page, and ranks anew."""
    by_page = Window.partitionBy(qid, "source", "page").orderBy("rnk")
    by_source = Window.partitionBy(qid, "source").orderBy("rnk")
    kept = ranked.withColumn("_p", F.row_number().over(by_page)).filter(F.col("_p") <= per_page)
    kept = kept.withColumn("_s", F.row_number().over(by_source)).filter(F.col("_s") <= per_source)
    return kept.withColumn("new_rnk", F.row_number().over(Window.partitionBy(qid).orderBy("rnk")).cast("int")).drop("_p", "_s")


def metrics(ranked: DataFrame, gold: DataFrame, qid: str = "item_id", k: int = 10) -> DataFrame:
    """recall, precision (of what was returned, k at most), mrr, ndcg and strict recall at k of each question that has gold (qid, doc_id)."""
    total = gold.groupBy(qid).agg(F.count("*").alias("n_gold"))
    returned = ranked.filter(F.col("rnk") <= k).groupBy(qid).agg(F.count("*").alias("n_back"))
    hits = ranked.filter(F.col("rnk") <= k).join(gold, [qid, "doc_id"]).groupBy(qid).agg(
        F.count("*").alias("hits"), F.min("rnk").alias("best"), F.sum(F.lit(1.0) / F.log2(F.col("rnk") + 1.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(hits, qid, "left").join(returned, qid, "left").select(
        qid, F.round(zero(F.col("hits") / F.col("n_gold")), 6).alias("recall"), F.round(zero(F.col("hits") / F.col("n_back")), 6).alias("precision"),
        F.round(zero(1.0 / F.col("best")), 6).alias("mrr"), F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"), zero((F.col("hits") == F.col("n_gold")).cast("double")).alias("strict"),
    )


def votes(docs: DataFrame, pattern: str) -> DataFrame:
    """source, value, votes: of all matches in a source's texts the most frequent, of equals the one seen first; null and 0 where none matches."""
    found = F.posexplode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))).alias("pos", "value")
    rows = docs.select("source", "doc_id", found).groupBy("source", "value").agg(F.count("value").alias("votes"), F.min(F.struct("doc_id", "pos")).alias("first"))
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.col("votes").desc(), "first"))
    return rows.withColumn("_r", best).filter("_r = 1").select("source", "value", "votes")
