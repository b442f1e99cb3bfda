"""Evaluation: ledgers and prices, arms and their comparison, thresholds, gates of a golden set, layout rectangles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Steps in order, those of the short table, those without tokens, those that answer no question; prices per million tokens.
STEPS = ("Router", "Rewriter", "Multi-Query", "Decomposition", "HyDE", "Self-Query", "Reranking", "Compression", "CRAG evaluator", "Final generation", "Grounding guard", "Presenter", "Contextualisation", "Evaluation judge")
SPEC = ("Router", "Rewriter", "Decomposition", "HyDE", "Compression", "CRAG evaluator", "Final generation")
LOCAL, OFFLINE = ("Reranking",), ("Contextualisation", "Evaluation judge")
CARDS = {"small": (1.0, 5.0), "middle": (2.0, 10.0), "large": (5.0, 25.0), "open": (0.15, 0.6)}
ARMS = ("basic", "adaptive", "forced")
CHARS_A_TOKEN, CONTEXT, RESERVE, OWN_RESERVE = 2.5, 8192, 1500, 1400
RESAMPLES, ALPHA = 10_000, 0.05


def price(prompt: Column, completion: Column, card: str = "small") -> Column:
    into, out = CARDS[card]
    return (prompt * into + completion * out) / 1e6


def ledger_rows(entries: DataFrame) -> DataFrame:
    """step, place, executed, calls, tokens, latency, cost: each declared step in order, zeros where it never ran, then TOTAL.

    entries: step, prompt_tokens, completion_tokens, latency."""
    declared = entries.sparkSession.createDataFrame([(s, i) for i, s in enumerate((*STEPS, "TOTAL"))], "step string, place int")
    sums = [F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("latency").alias("latency"), F.sum(price(F.col("prompt_tokens"), F.col("completion_tokens"))).alias("cost")]
    rolled = entries.rollup("step").agg(F.grouping("step").alias("_g"), *sums).withColumn("step", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("step"))).drop("_g")
    zero = lambda c, n: F.coalesce(F.round(c, n), F.lit(0.0))
    return declared.join(rolled, "step", "left").select(
        "step", "place", F.col("calls").isNotNull().alias("executed"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        zero(F.col("latency"), 4).alias("latency"), zero(F.col("cost"), 6).alias("cost"),
    )


def ledger_failures(entries: DataFrame, key: str) -> DataFrame:
    """key, failure: ledgers of questions without a final answer, local steps with tokens, other steps without."""
    local = F.col("step").isin(*LOCAL)
    never = entries.groupBy(key).agg(F.max(~F.col("step").isin(*OFFLINE)).alias("_asked"), F.max(F.col("step") == "Final generation").alias("_done")).filter("_asked and not _done").select(key, F.lit("Final generation never ran").alias("failure"))
    spent = F.when(local & (F.col("prompt_tokens") > 0), F.concat("step", F.lit(" is a local step but spent tokens"))).when(~local & (F.col("prompt_tokens") == 0), F.concat("step", F.lit(" recorded a call with no input tokens")))
    return never.unionByName(entries.select(key, spent.alias("failure")).filter("failure is not null"))


def budget(history_chars: Column, template_chars: int) -> Column:
    return F.lit(int((CONTEXT - OWN_RESERVE) * CHARS_A_TOKEN) - template_chars) - F.coalesce(history_chars, F.lit(0))


def over_budget(chars: Column) -> Column:
    return F.coalesce(chars / CHARS_A_TOKEN > CONTEXT - RESERVE, F.lit(False))


def fill_missing(expected: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every expected key with its values as text, MISSING where there is no row and N/A where a value is null."""
    found = rows.withColumn("_here", F.lit(True))
    shown = lambda c: F.when(F.col("_here").isNull(), "MISSING").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("N/A"))).alias(c)
    return expected.join(found, keys, "left").select(*keys, *[shown(v) for v in values])


def best_arm(means: DataFrame, value: str) -> DataFrame:
    """The arm of the greatest mean of what is not null; ties go to the first declared; one row."""
    order = F.array_position(F.array(*map(F.lit, ARMS)), F.col("arm"))
    best = means.groupBy("arm").agg(F.avg(value).alias("_m")).filter("_m is not null").agg(F.max_by("arm", F.struct("_m", (-order).alias("o"))).alias("best"))
    return best.select(F.coalesce("best", F.lit("not determinable")).alias("best"))


def pairs(runs: DataFrame, a: str, b: str, key: str, metric: str) -> DataFrame:
    """key, a, b: values of two arms on the questions where both have one."""
    arm = lambda name, c: runs.filter((F.col("arm") == name) & F.col(metric).isNotNull()).select(key, F.col(metric).alias(c))
    return arm(a, "a").join(arm(b, "b"), key)


def bootstrap(paired: DataFrame, by: str, key: str, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0, entries: int = 1 << 22) -> DataFrame:
    """by, n, diff, low, high: mean difference a - b and the bounds of its resampled means. A group holds one number a question;
    resamples are drawn `entries` at a time, so memory grows with the questions, not with the resamples."""
    import numpy as np

    def interval(g: pd.DataFrame) -> pd.DataFrame:
        d = (g.sort_values(key)["a"] - g.sort_values(key)["b"]).to_numpy("float64")
        rng, step = np.random.default_rng(seed), max(1, entries // len(d))
        means = np.concatenate([d[rng.integers(0, len(d), (min(step, resamples - i), len(d)))].mean(1) for i in range(0, resamples, step)])
        low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return pd.DataFrame({by: [g[by].iloc[0]], "n": [len(d)], "diff": [d.mean()], "low": [low], "high": [high]})

    return paired.groupBy(by).applyInPandas(interval, f"{by} string, n bigint, diff double, low double, high double")


def crag_threshold(scores: DataFrame, key: str, score: str, step: float = 0.02, parts: int = 1024) -> DataFrame:
    """key, threshold: halfway to the next higher score (or step above), for every row; others_below counts lower ones.

    Scores lie in `parts` equal stretches between the least and the greatest; windows run inside a stretch, and one over the
    stretches' counts and least scores, a row each, tells what lies before and after."""
    ends = F.broadcast(scores.agg(F.min(score).alias("_low"), F.max(score).alias("_high")))  # one row
    at = F.coalesce(F.floor((F.col(score) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0)) * parts), F.lit(0)).cast("int")
    levels = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n")).crossJoin(ends).withColumn("_part", at).drop("_low", "_high")
    over = Window.orderBy("_part")
    sizes = levels.groupBy("_part").agg(F.sum("_n").alias("_all"), F.min(score).alias("_first"))
    around = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_all").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(over).alias("_after")))
    w = Window.partitionBy("_part").orderBy(score)
    below = F.col("_before") + F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = levels.join(around, "_part").withColumns({"_next": F.coalesce(F.lead(score).over(w), F.col("_after")), "others_below": below})
    level = (F.col(score) + F.coalesce("_next", F.col(score) + step)) / 2
    return scores.join(ranked.select(score, level.alias("threshold"), "others_below"), score).select(key, F.round("threshold", 6).alias("threshold"), "others_below")


def stratified(rows: DataFrame, n: int) -> DataFrame:
    """The first row (by seq) of each (type, source), in their order, then others by seq, n in all. Rows with the least seq are found by aggregation."""
    first = rows.groupBy("type", "source").agg(F.min("seq").alias("seq")).withColumn("_first", F.lit(True))
    same = (F.col("f.seq") == F.col("r.seq")) & F.col("f.type").eqNullSafe(F.col("r.type")) & F.col("f.source").eqNullSafe(F.col("r.source"))
    marked = rows.alias("r").join(first.alias("f"), same, "left").select("r.*", F.coalesce("f._first", F.lit(False)).alias("_first"))
    order = [F.col("_first").desc(), F.when(F.col("_first"), F.col("type")), F.when(F.col("_first"), F.col("source")), F.col("seq")]
    return marked.orderBy(*order).limit(n).drop("_first")


def chunks_on_page(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (slug, asked) with the chunks whose pages reach over it; an end of 0 or null is the start. A chunk goes to each page
    that it reaches, so pages meet their own chunks."""
    end = F.coalesce(F.nullif("end_page", F.lit(0)), F.col("page"))
    pages = chunks.where(end >= F.col("page")).withColumn("asked", F.explode(F.sequence("page", end)))
    return asked.join(pages, ["slug", "asked"])


def union_box(boxes: Column) -> Column:
    """[x0, y0, x1, y1] around an array of such."""
    side = lambda i, pick: pick(F.transform(boxes, lambda b: F.get(b, F.lit(i))))
    return F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))


def boxes_match(a: Column, b: Column, within: float = 2.0) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda x: x <= within)


def bands(box: Column, n: Column) -> Column:
    """n equal bands of a box from top to bottom; the box itself for n below 1."""
    height = (F.get(box, F.lit(3)) - F.get(box, F.lit(1))) / F.greatest(n, F.lit(1))
    cut = lambda i: F.array(F.get(box, F.lit(0)), F.get(box, F.lit(1)) + height * i, F.get(box, F.lit(2)), F.get(box, F.lit(1)) + height * (i + 1))
    return F.when(n < 1, F.array(box)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), cut))


#: About so many different sides of rectangles lie between two cuts of a page, and a side that so many rectangles share is a cut itself.
SIDES, SHARED = 128, 32


def cuts(rects: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """page, name (sorted values that cut the page) and name_steps (powers of two for a search in them): a share of the sides of
    rectangles chosen by hash, and each side that many share. Pages of few rectangles have few or none."""
    sides = rects.select("page", F.explode(F.array(low, high)).alias("_v")).groupBy("page", "_v").agg(F.count("*").alias("_n"))
    chosen = sides.where((F.pmod(F.xxhash64("page", "_v"), F.lit(SIDES)) == 0) | (F.col("_n") >= SHARED))
    found = chosen.groupBy("page").agg(F.array_sort(F.collect_list("_v")).alias(name))
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(name))), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return found.select("page", name, steps.alias(f"{name}_steps"))


def slab(value: Column, name: str) -> Column:
    """The place of a value among the cuts of its page: 2 i + 1 on cut i, 2 i between cuts i - 1 and i."""
    below = F.aggregate(f"{name}_steps", F.lit(0), lambda lo, s: F.when(F.get(F.col(name), lo + s - 1) < value, lo + s).otherwise(lo))
    at = F.coalesce(below, F.lit(0))
    return T.let(at, lambda i: i * 2 + F.coalesce(F.get(F.col(name), i) == value, F.lit(False)).cast("int"))


def nodes(low: Column, high: Column, name: str) -> Column:
    """array<struct<level, at>>: the slabs between two sides as at most two nodes a level of the binary tree over slabs, and at level -1
    the slabs that a side runs through: values there are inside or not."""
    first, last = F.when(low % 2 == 1, low).otherwise(low + 1), F.when(high % 2 == 1, high).otherwise(high - 1)
    node = lambda level, at: F.struct(level.alias("level"), at.cast("int").alias("at"))

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2), level)
        a, b = F.ceil(first / size), F.floor((last + 1) / size)
        return F.when(a < b, F.array(F.when(a % 2 == 1, node(level, a)), F.when(b % 2 == 1, node(level, b - 1))))

    whole = F.flatten(F.filter(F.transform(levels(name), of), lambda x: x.isNotNull()))
    through = F.array(F.when(low % 2 == 0, node(F.lit(-1), low)), F.when((high % 2 == 0) & (high != low), node(F.lit(-1), high)))
    return F.array_compact(F.concat(whole, through))


def levels(name: str) -> Column:
    """Levels of the tree over a page's slabs."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(name), F.lit(0)) * 2 + 1)).cast("int"))


def above(at: Column, name: str) -> Column:
    """The nodes that hold a slab, and at level -1 the slab itself where sides may run through it."""
    held = F.transform(levels(name), lambda level: F.struct(level.alias("level"), F.floor(at / F.pow(F.lit(2), level)).cast("int").alias("at")))
    return F.array_compact(F.array_append(held, F.when(at % 2 == 0, F.struct(F.lit(-1).alias("level"), at.alias("at")))))


def claimed(fragments: DataFrame, rects: DataFrame) -> DataFrame:
    """fragment_id, rect_id: each fragment whose centre lies in rectangles of its page goes to the first of them in order.

    Some sides cut a page into slabs both ways, and a cell is where two slabs meet. A rectangle covers cells whole, as few nodes of
    two binary trees, where the first of a node's rectangles is all that counts; through the other cells one of its
    sides runs. A cell with fragments asks the nodes above it for the first rectangle that covers it whole. Only
    rectangles before that one whose sides run through the cell are tested against its fragments: some hundreds at most where
    sides differ, so work grows with fragments and rectangles, not with their product. Cuts, some numbers for a hundred
    rectangles, are broadcast."""
    r = rects.where("page is not null and rx0 <= rx1 and ry0 <= ry1").select("page", "rect_id", "rx0", "rx1", "ry0", "ry1")
    lines = F.broadcast(cuts(r, "rx0", "rx1", "_cx").join(cuts(r, "ry0", "ry1", "_cy"), "page", "full"))
    none, cut_columns = F.array(), ("_cx", "_cx_steps", "_cy", "_cy_steps")
    known = lambda df: df.join(lines, "page", "left").withColumns({c: F.coalesce(c, none.cast(lines.schema[c].dataType)) for c in cut_columns})
    f = fragments.select("page", "fragment_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    f = known(f.where("page is not null and cx is not null and cy is not null"))
    f = f.withColumns({"_sx": slab(F.col("cx"), "_cx"), "_sy": slab(F.col("cy"), "_cy")})
    cell = ["page", "_sx", "_sy"]
    cells = known(f.select(*cell).distinct()).select(*cell, F.explode(above(F.col("_sx"), "_cx")).alias("_nx"), above(F.col("_sy"), "_cy").alias("_ny"))
    cells = cells.select(*cell, "_nx", F.explode("_ny").alias("_ny"))
    sides = known(r).withColumns({"_ax": slab(F.col("rx0"), "_cx"), "_bx": slab(F.col("rx1"), "_cx"), "_ay": slab(F.col("ry0"), "_cy"), "_by": slab(F.col("ry1"), "_cy")})
    placed = sides.select(*r.columns, F.explode(nodes(F.col("_ax"), F.col("_bx"), "_cx")).alias("_nx"), nodes(F.col("_ay"), F.col("_by"), "_cy").alias("_ny"))
    placed = placed.select(*r.columns, "_nx", F.explode("_ny").alias("_ny"))
    node = ["page", "_nx", "_ny"]
    through = (F.col("_nx.level") < 0) | (F.col("_ny.level") < 0)
    covers = placed.where(~through).groupBy(*node).agg(F.min("rect_id").alias("_first"))
    covered = cells.where(~through).join(covers, node).groupBy(*cell).agg(F.min("_first").alias("_first"))
    maybe = cells.where(through).join(placed.where(through), node).select(*cell, *r.columns[1:]).join(covered, cell, "left")
    maybe = maybe.where(F.col("_first").isNull() | (F.col("rect_id") < F.col("_first"))).drop("_first")
    inside = F.col("cx").between(F.col("rx0"), F.col("rx1")) & F.col("cy").between(F.col("ry0"), F.col("ry1"))
    points = f.select(*cell, "fragment_id", "cx", "cy")
    found = points.join(covered, cell).select("fragment_id", F.col("_first").alias("rect_id")).unionByName(points.join(maybe, cell).where(inside).select("fragment_id", "rect_id"))
    return found.groupBy("fragment_id").agg(F.min("rect_id").alias("rect_id"))


def reading_lines(fragments: DataFrame, tolerance: float) -> DataFrame:
    """page, line, text: a new line where a centre is more than tolerance below the one before; right to left inside a line."""
    cy = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy("page").orderBy("cy", "fragment_id")
    rows = fragments.withColumn("cy", cy).withColumn("_new", (F.abs(F.col("cy") - F.lag("cy").over(w)) > tolerance).cast("int"))
    rows = rows.withColumn("line", F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("int"))
    # a line of a page holds few fragments
    parts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("x1")).alias("x"), "fragment_id", "text"))), lambda s: s["text"])
    return rows.groupBy("page", "line").agg(F.array_join(parts, " ").alias("text"))


def decided(recall: str, mrr: str, half: str, preferred: str = "a", other: str = "b") -> list[Column]:
    """winner and basis from two differences (preferred minus other) and the half width of their intervals: measured only
    where both intervals exclude zero on the same side; otherwise the preferred one, as metrics disagreed or tied."""
    clear = (F.abs(recall) > F.col(half)) & (F.abs(mrr) > F.col(half))
    agree = (F.col(recall) > 0) == (F.col(mrr) > 0)
    winner = F.when(clear & agree & (F.col(recall) <= 0), other).otherwise(preferred)
    return [winner.alias("winner"), F.when(clear & agree, "measurement").when(clear, "disagreed").otherwise("tie").alias("basis")]


def calibrated(said: Column, label: Column) -> list[Column]:
    """n, recall of the positive class (null without positives) and the share of cases not passed."""
    return [
        F.count("*").alias("n"), F.round(F.avg(F.when(label, said.cast("double"))), 6).alias("recall"),
        F.round(F.avg((~said).cast("double")), 6).alias("block_rate"),
    ]


def result_rows(scores: DataFrame, question: str, arm: str, metrics: tuple[str, ...], required: int = 10) -> DataFrame:
    """part, place, arm and a text for each metric: three places, or N/A where it was not judged."""
    place = F.substring(question, 2, 20).cast("int")
    shown = lambda m: F.coalesce(F.format_string("%.3f", F.round(F.max(F.when(F.col("metric") == m, F.col("score"))), 3)), F.lit("N/A"))
    shown_or = lambda m: F.when(F.max(F.when(F.col("metric") == m, F.col("score"))).isNull(), "N/A").otherwise(shown(m)).alias(m)
    rows = scores.groupBy(place.alias("place"), F.col(arm).alias("arm")).agg(*map(shown_or, metrics))
    return rows.select(F.when(F.col("place") <= required, "required").otherwise("supplementary").alias("part"), "*")


def harness_gates(owed: DataFrame, records: DataFrame, questions: DataFrame) -> DataFrame:
    """gate, arm, qid: records (arm, qid, kind, n_chunks, ledger_failure) that are owed (arm, qid) and missing, errors, failed
    ledgers, and runs of the basic arm that retrieved nothing for an answerable question (qid, answerable). Errors are told, but
    fail nothing by themselves; their empty retrieval is not counted."""
    of = lambda gate, df: df.select(F.lit(gate).alias("gate"), "arm", "qid")
    empty = records.where("arm = 'basic' and kind != 'error' and n_chunks = 0").join(questions.where("answerable").select("qid"), "qid", "left_semi")
    return (
        of("missing", owed.join(records.select("arm", "qid"), ["arm", "qid"], "left_anti")).unionByName(of("error", records.where("kind = 'error'")))
        .unionByName(of("ledger", records.where("ledger_failure is not null"))).unionByName(of("empty", empty))
    )


def agreement(rows: DataFrame, expected: str, given: str) -> DataFrame:
    """One row: the share of rows whose given value is the expected one (null without rows), how many, and of how many."""
    same = F.count_if(F.coalesce(F.col(expected) == F.col(given), F.lit(False)))
    return rows.agg(F.round(same / F.nullif(F.count("*"), F.lit(0)), 6).alias("agreement"), same.alias("same"), F.count("*").alias("n"))


def first_of(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """The first row of each value in the order of other columns, by aggregation; nulls are one value."""
    rest = [c for c in rows.columns if c != value]
    return rows.groupBy(value).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(value, "_r.*")


def judged_runs(runs: DataFrame, judged: DataFrame, *keys: str) -> DataFrame:
    """runs with their judgement by keys; a key judged more than once counts once, by its greatest row."""
    rest = [c for c in judged.columns if c not in keys]
    once = judged.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_j"))
    return runs.join(once, list(keys), "left").select(*runs.columns, "_j.*")
