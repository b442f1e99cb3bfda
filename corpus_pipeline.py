"""A training corpus from raw documents: toxic ones go, one of each near-duplicate group stays, personal data is
masked, sources are mixed to their target weights in training order, and texts become tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Extra columns of documents pass
through to the last stage, whatever their names: a stage carries them packed as one. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, ngram_join, pii, toxicity
from tessera.llm.common import cut, cut_clean, ranked, made, read, sweep

VOCABULARY = "word_bpe_49k.json"
LIMIT = 0.5


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns `used`, and all others as one, `_row`: their names meet none of a stage's own."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*others or [F.lit(0).alias("_none")]).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    """Those columns again, with the changed ones."""
    apart = rows.schema["_row"].dataType.names
    return rows.select(*[(changed[c] if c in changed else F.col("_row")[c] if c in apart else F.col(c)).alias(c) for c in columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the network scores below LIMIT."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs, "text"), model).filter(F.col("score") < LIMIT), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of 0.8-similar documents the one with the least id; documents without words stay.

    Rows that share an id, or have none, are documents of their own: where there are such rows, all are numbered by id
    (none last) and text, and rows with words that equal another in both leave the first by their other columns."""
    if not docs.filter("doc_id is null").isEmpty() or not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _one_of_each(docs)
    linked = cut(ngram_join.link(docs), "linked")
    gone = linked.filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _one_of_each(docs: DataFrame) -> DataFrame:
    """The same for rows that their ids do not tell apart."""
    text = F.coalesce("text", F.lit(""))
    keys = ["doc_id", "_h1", "_h2"]
    tagged = packed(docs, "doc_id", "text").withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text), "_words": text.rlike(r"[^\x20\x09-\x0D]")})
    worded = tagged.filter("_words")
    numbers = ranked(worded.select(*keys).distinct(), F.col("doc_id").asc_nulls_last(), F.col("_h1"), F.col("_h2"), name="_node", label="numbers")
    by = F.to_json("_row")
    first = worded.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).filter("_nth = 1")
    on = first["doc_id"].eqNullSafe(numbers["doc_id"]) & (first["_h1"] == numbers["_h1"]) & (first["_h2"] == numbers["_h2"])
    once = cut(first.join(numbers, on).select(first["doc_id"], "text", "_row", "_node"), "once")
    linked = cut(ngram_join.link(once.select(F.col("_node").alias("doc_id"), "text")), "linked")
    gone = linked.filter("component_id != doc_id").select(F.col("doc_id").alias("_node"))
    kept = once.join(gone, "_node", "left_anti").drop("_node").unionByName(tagged.filter("not _words").select("doc_id", "text", "_row"))
    return unpacked(kept, docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets and counts n_chars anew."""
    rows = packed(docs, "text")
    masked = pii.redact(pii.annotate(rows, pii.fit(rows)))
    return unpacked(masked, docs.columns, n_chars=_length("text"))


def _length(text: str):
    return F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each pass that trains on it, in training order; a last pass that needs only
    part of a document has its first words. Documents without words are never trained on."""
    keys = ["doc_id", "source", "_tie"]
    slim = packed(docs, "doc_id", "text", "source")
    # rows with equal id, source and text are told apart by a number, on both sides; only where there are such rows are texts sorted for it
    tied = slim.withColumn("_tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    alike = not tied.groupBy(*keys).count().filter("count > 1").isEmpty()
    nth = lambda *by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order)) if alike else F.lit(1)
    turns = mixing.passes(mixing.mix(slim))
    turns = turns.select(*keys, "size", "words", "position", nth(*keys, "pass", order="begin").alias("_nth"))
    turns = turns.withColumnsRenamed({k: f"_{k}_" for k in keys} | {"_nth": "_nth_"})
    rows = tied.withColumn("_nth", nth(*keys, order=F.to_json("_row")))
    on = [rows[k].eqNullSafe(turns[f"_{k}_"]) for k in keys] + [rows["_nth"] == turns["_nth_"]]
    # each text is dealt twice: to its turns, whose files go once they are written, and to its place
    met = cut_clean(rows.join(turns, on), "met")
    first = F.regexp_extract(F.col("text"), r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.greatest(F.col("words"), F.lit(0)).cast("int"))
    part = F.concat(first, F.array_join(words, ""))
    placed = met.withColumn("text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text")))
    return unpacked(mixing.by_position(placed), docs.columns, n_chars=_length("text"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, a row for each pass."""
    import public_tokenizers

    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage wrote on its way, and its input, go once its result is written."""
    docs, had = read(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(spark, had)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network and the labelers of the first and third stage cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
