"""Quality: overlapping heuristic labellers, weighed by expectation-maximisation, train a hashed linear scorer.

Eight labellers vote good (1), poor (-1) or nothing (0) on a text's length, word lengths, symbols, repeated lines, variety of
words, sentence ends, capitals and runs of marks. Counts of vote patterns over all documents (3^8 rows at most) go to the
driver, where EM estimates each labeller's accuracy. Labellers look for different defects, so a poor text is seldom poor by the
majority: there is a poor class for each defect, and rounds begin from the opinion that any poor vote is a bad sign. The patterns' posteriors are the labels of a logistic
scorer over hashed words and shape features, trained on about SAMPLE distinct texts chosen by hash; every whole text is scored.

Null and empty texts are poor by their votes; copies are trained on once and scored alike; an empty table gives an empty table;
an own column `score` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, share, text_of

SAMPLE, BUCKETS, LABELLERS, LONGEST = 4000, 1 << 12, 8, 20_000


def votes(text: Column) -> list[Column]:
    words, lines = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.filter(F.split(text, "\n"), lambda s: s != "")
    n, chars = F.size(words), F.greatest(F.char_length(text), F.lit(1))
    mean, symbols = chars / F.greatest(n, F.lit(1)), F.char_length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:'\"!?-]", "")) / chars
    repeated = 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    variety, ends = F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)), F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) / F.greatest(n, F.lit(1))
    letters, capitals = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    shout, marks = capitals / F.greatest(letters, F.lit(1)), F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}")) / F.greatest(n, F.lit(1))
    vote = lambda good, poor: F.when(poor, -1).when(good, 1).otherwise(0)
    return [vote(n >= 50, n < 1), vote(mean.between(3.5, 9), (mean < 2.5) | (mean > 14)), vote(symbols < 0.01, symbols > 0.04),
            vote(repeated < 0.1, repeated > 0.5), vote(variety > 0.35, variety < 0.15), vote(ends > 0.02, ends < 0.002),
            vote(shout < 0.15, shout > 0.4), vote(marks < 0.1, marks > 0.25)]


def posteriors(patterns: dict[tuple[int, ...], int], rounds: int = 3) -> dict[tuple[int, ...], float]:
    """The chance that each vote pattern is good, by EM over one good class and one poor class for each labeller's defect.

    Each class has its own accuracy of each labeller. Few rounds: more of them let the good class take up a defect whose texts
    are otherwise well formed. Rounds begin from the opinion that any poor vote is a bad sign."""
    import numpy as np

    v, n = np.array(sorted(patterns)).reshape(-1, LABELLERS), np.array([patterns[k] for k in sorted(patterns)], "float64")
    poor = v < 0
    alarms = poor.sum(1, keepdims=True)
    share = np.where(alarms > 0, poor / np.maximum(alarms, 1), 1 / LABELLERS)
    p = np.hstack([np.where(alarms > 0, 0.1, 0.9), np.where(alarms > 0, 0.9, 0.1) * share])
    for _ in range(rounds if len(v) else 0):
        size = n @ p
        logit = np.log(size + 1) - np.log(size.sum() + LABELLERS + 1) + np.zeros(p.shape)
        for i in range(LABELLERS):
            for x in (-1, 0, 1):
                lean = np.ones(LABELLERS + 1)
                if x == 1:
                    lean[0] += 4
                if x == -1:
                    lean[i + 1] += 4
                own, total = v[:, i] == x, np.full(LABELLERS + 1, 3.0)
                total[[0, i + 1]] += 4
                logit += np.outer(own, np.log(((n * own) @ p + lean) / (size + total)))
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    return {tuple(int(x) for x in k): float(q) for k, q in zip(v, p[:, 0])}


def features(text: str):
    """Bucket numbers and weights: distinct words by hash, each the root of its share, and four of shape."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    own = set(words)
    ids = [xxhash.xxh3_64_intdigest(w) % BUCKETS for w in own]
    lines = [x for x in text.split("\n") if x]
    odd = sum(not (c.isalnum() or c.isspace() or c in ".,;:'\"!?-") for c in text) / max(1, len(text))
    shape = [min(1.0, len(words) / 50), len(own) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), min(1.0, 20 * odd), 1.0]
    return np.array(ids + [BUCKETS + i for i in range(5)]), np.array([max(1, len(own)) ** -0.5] * len(ids) + shape)


def train(df: DataFrame, key: str = "doc_id", text: str = "text"):
    """Weights of the scorer."""
    import numpy as np

    cols = [c.cast("int").alias(f"v{i}") for i, c in enumerate(votes(text_of(text)))]
    names = [f"v{i}" for i in range(LABELLERS)]
    seen = df.select(*cols).groupBy(*names).agg(F.count("*").alias("n")).collect()
    chance = posteriors({tuple(r[x] for x in names): r["n"] for r in seen})
    # a text is chosen by its own hash, so copies count once and nothing has to be sorted; the share keeps the sample near SAMPLE
    share = min(1.0, SAMPLE / max(1, sum(r["n"] for r in seen)))
    pick = F.xxhash64(F.lit("quality"), text_of(text))
    few = df.filter((F.char_length(text_of(text)) <= LONGEST) & (pick <= F.lit(int(-(2**63) + share * (2**64 - 1025)))))
    rows = few.groupBy(pick.alias("h")).agg(F.first(text_of(text)).alias("t")).select("h", "t", *[c.cast("int").alias(f"v{i}") for i, c in enumerate(votes(F.col("t")))])
    rows = sorted(rows.collect(), key=lambda r: r["h"])
    made = [(*features(r["t"]), chance[tuple(r[x] for x in names)]) for r in rows]
    w, square, rng = np.zeros(BUCKETS + 5), np.ones(BUCKETS + 5), np.random.default_rng(1)
    for _ in range(8):
        for i in rng.permutation(len(made)):
            ids, x, y = made[i]
            step = (y - 1 / (1 + np.exp(-np.clip(w[ids] @ x, -30, 30)))) * x
            np.add.at(square, ids, step * step)
            np.add.at(w, ids, 0.3 * step / np.sqrt(square[ids]))
    return w


def score(df: DataFrame, weights, text: str = "text") -> DataFrame:
    """Adds score, 0 to 1: higher is better."""
    import pyarrow as pa

    shared, kept = share(df.sparkSession, weights), [c for c in df.columns if c != "score"]  # BUCKETS + 5 numbers
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]

    def run(batches):
        import numpy as np

        w = shared.value
        for batch in batches:
            made = (features(t or "") for t in batch.column(text).to_pylist())
            out = [float(1 / (1 + np.exp(-np.clip(w[i] @ x, -30, 30)))) for i, x in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return df.select(*kept).mapInArrow(lean(run), ", ".join([*schema, "score double"]))
