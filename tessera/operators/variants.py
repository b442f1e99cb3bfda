"""Variants of a corpus by the prefix before each chunk: none, a template, or what a model wrote with one more try and the template
to fall back on; and the gates that hold variants to the corpus they were built from.

Chunks (chunk_id, seq, text, ...): seq is their order. A variant has the same rows with context_prefix, source_of and the composed text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import passages as P
from tessera.operators import prefixes as X

# The share of fallbacks that is too high, the context of the model and how much of it a prompt may take.
FALLBACK, CONTEXT, FULL = 0.10, 8192, 0.9


def applied(chunks: DataFrame, prefix: Column, source_of: Column | None = None) -> DataFrame:
    """chunks with context_prefix, where it came from, and the text composed with it; a null prefix is an empty one."""
    own = chunks.withColumn("context_prefix", F.coalesce(prefix, F.lit("")))
    own = own.withColumn("source_of", F.lit(None).cast("string") if source_of is None else source_of)
    return own.withColumn("text", P.compose(F.col("context_prefix"), F.coalesce("text", F.lit(""))))


def written(chunks: DataFrame, first: Column, second: Column, template: Column, tidy: Callable[[Column], Column] = X.tidy) -> DataFrame:
    """The model's variant: the first answer that no rule rejects, else the second, else the template; source_of tells which."""
    said = chunks.withColumns({"_a": tidy(F.coalesce(first, F.lit(""))), "_b": tidy(F.coalesce(second, F.lit(""))), "_t": template})
    text = F.coalesce("text", F.lit(""))
    said = said.withColumns({"_ra": X.rejected(F.col("_a"), text), "_rb": X.rejected(F.col("_b"), text)})
    from_ = F.when(F.col("_ra").isNull(), "clean").when(F.col("_rb").isNull(), "re_asked").otherwise("template_fallback")
    prefix = F.when(F.col("_ra").isNull(), F.col("_a")).when(F.col("_rb").isNull(), F.col("_b")).otherwise(F.col("_t"))
    return applied(said, prefix, from_).drop("_a", "_b", "_t", "_ra", "_rb")


def gates(base: DataFrame, variants: dict[str, DataFrame], titles: DataFrame, prompts: DataFrame) -> DataFrame:
    """gate, variant, failing of variants none, template and llm, those that are given: other ids or another order (1), a none
    variant that differs (2), texts that don't come back without their prefix (3), templates that lack a part (4), fallbacks over
    FALLBACK (5) and empty prefixes (5) of the model's, and prompts (prompt_tokens) near the context (6). No rows: clean."""
    of = lambda gate, name, df: df.agg(F.count("*").alias("failing")).where("failing > 0").select(F.lit(gate).alias("gate"), F.lit(name).alias("variant"), "failing")
    own = base.select("chunk_id", F.col("seq").alias("_seq"), F.coalesce("text", F.lit("")).alias("_text"))
    found = []
    for name, v in variants.items():
        both = own.join(v, "chunk_id", "full")
        # rows are compared by id: one that is only here or there, or stands elsewhere
        found.append(of(1, name, both.where(~F.col("_seq").eqNullSafe(F.col("seq")))))
        met = v.join(own, "chunk_id")
        if name == "none":
            found.append(of(2, name, met.where((F.col("text") != F.col("_text")) | ~F.col("context_prefix").eqNullSafe(F.lit("")))))
        else:
            found.append(of(3, name, met.where(~P.decompose(F.coalesce("context_prefix", F.lit("")), F.col("text")).eqNullSafe(F.col("_text")))))
    if "template" in variants:
        titled = variants["template"].join(titles.select("source", "title"), "source", "left")
        found.append(of(4, "template", titled.where(X.template_gate(F.col("context_prefix"), F.col("title"), F.col("section_path")).isNotNull())))
    if "llm" in variants:
        fell = F.count_if(F.col("source_of") == "template_fallback")
        high = variants["llm"].agg(fell.alias("failing"), F.count("*").alias("_n")).where(F.col("failing") > F.col("_n") * FALLBACK)
        found.append(high.select(F.lit(5).alias("gate"), F.lit("llm").alias("variant"), "failing"))
        found.append(of(5, "llm", variants["llm"].where(F.coalesce("context_prefix", F.lit("")) == "")))
    found.append(of(6, "llm", prompts.where(F.col("prompt_tokens") >= CONTEXT * FULL)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
