"""Balanced label propagation: linked documents gather in shards of equal row counts.

Documents with equal texts are linked. A group and the shard its members began in make one part, so a group of any size has at most
as many parts as there are shards, counted before any shuffle. Each round joins the parts with their group's fullest shard,
ties by a hash of group and shard. Those elsewhere want to move there; how many may is set for each pair of shards by a small matrix: as many as
come back the other way, and a share of the room left under the capacity for linked rows. Parts within that share, by hash, move.

Then groups settle whole, the largest first: as many of each size as fit stay at the shard that holds most of them, and those refused go to
whichever shards have room for a whole group. Groups above a shard's quota take whole shards, and one more for what is left.

The law is `rows`: single documents, with the few groups that no shard had room for, fill all shards up, so counts
differ by one at most. A group is cut only where it is larger than a shard, or than the room that larger groups
left in any.

Only built-in functions. Null and empty texts are equal texts of size 1; repeated rows are separate
documents; null ids are allowed. Columns besides the id and the text are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, text_of

SHARDS, ROUNDS = 16, 4


def _fraction(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(1 << 30)) / float(1 << 30)


def _quotas(wants: dict[tuple[int, int], int], load: list[int], room: float) -> dict[tuple[int, int], float]:
    """The part of each pair's wish that may move: swaps, then shares of the target's free room."""
    n = len(load)
    share = {}
    for t in range(n):
        asked = sum(max(0, wants.get((s, t), 0) - wants.get((t, s), 0)) for s in range(n) if s != t)
        free = max(0.0, room - load[t])
        for s in range(n):
            if want := wants.get((s, t), 0):
                swap = min(want, wants.get((t, s), 0))
                more = (want - swap) * min(1.0, free / asked) if asked else 0.0
                share[s, t] = min(1.0, (swap + more) / want)
    return share


def _fullest(parts: DataFrame) -> DataFrame:
    """h1, h2, all (rows) and to: the shard that holds most of each group."""
    held = parts.groupBy("h1", "h2", "at").agg(F.sum("n").alias("c"))
    turn = F.xxhash64(F.lit(3), "h1", "h2", "at")
    best = held.groupBy("h1", "h2").agg(F.sum("c").alias("all"), F.max(F.struct("c", turn.alias("turn"), "at")).alias("m"))
    return best.select("h1", "h2", "all", F.col("m.at").alias("to"))


def propagate(docs: DataFrame, shards: int, rounds: int, total: int) -> DataFrame:
    """Parts (h1, h2, began) of groups of two documents or more, with the shard they end at.

    docs: h1, h2, began. What reaches the driver are matrices of shards by shards."""
    parts = docs.groupBy("h1", "h2", "began").agg(F.count("*").alias("n"))
    many = parts.groupBy("h1", "h2").agg(F.sum("n").alias("all")).filter("all > 1").drop("all")
    parts = cut(parts.join(many, ["h1", "h2"], "left_semi").withColumn("at", F.col("began")), "parts")
    for _ in range(rounds):
        wish = cut(parts.join(_fullest(parts).drop("all"), ["h1", "h2"]), "wish")
        flows = {(r["at"], r["to"]): r["n"] for r in wish.groupBy("at", "to").agg(F.sum("n").alias("n")).collect()}
        wants = {k: n for k, n in flows.items() if k[0] != k[1]}
        if not wants:
            break
        load = [sum(n for (s, _), n in flows.items() if s == t) for t in range(shards)]
        share = _quotas(wants, load, total / shards)
        table = F.array(*[F.array(*[F.lit(share.get((s, t), 0.0)) for t in range(shards)]) for s in range(shards)])
        goes = _fraction(F.col("h1"), F.col("h2"), F.col("began")) < F.get(F.get(table, F.col("at")), F.col("to"))
        parts = wish.withColumn("at", F.when(goes, F.col("to")).otherwise(F.col("at"))).drop("to")
    return parts


def _reserve(size: int, loads: list[int], free: list[int]) -> list[tuple[int, int]]:
    """Shards and rows for a group above every quota: whole ones that hold most of it, then the tightest that takes what is left."""
    out = []
    while size:
        fits = [s for s in range(len(free)) if free[s] >= size]
        s = min(fits, key=lambda s: (free[s], -loads[s], s)) if fits else max(range(len(free)), key=lambda s: (free[s], loads[s], -s))
        out.append((s, min(size, free[s])))
        free[s] -= out[-1][1]
        size -= out[-1][1]
    return out


def _places(counts: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For groups of each size and wanted shard, in a line: up to which place they go to which shard; those beyond fit nowhere."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    by_size: dict[int, list[int]] = {}
    for z, t in sorted(counts):
        by_size.setdefault(z, []).append(t)
    for z in sorted(by_size, reverse=True):
        for t in by_size[z]:
            stay = min(counts[z, t], free[t] // z)
            free[t] -= stay * z
            out[z, t] = [(stay, t)] if stay else []
        for t in by_size[z]:
            done = out[z, t][-1][0] if out[z, t] else 0
            for s in sorted(range(len(free)), key=lambda s: (-free[s], s)):
                if more := min(counts[z, t] - done, free[s] // z):
                    free[s] -= more * z
                    done += more
                    out[z, t].append((done, s))
    return out


def settle(parts: DataFrame, quota: list[int]) -> tuple[DataFrame, list[tuple[int, int, list[tuple[int, int]]]]]:
    """Parts (h1, h2, began) of groups that found a shard whole, with it (at); and (h1, h2, [(shard, rows)]) of those above all quotas.

    The driver holds a row for each size and shard; sizes that differ are at most the root of twice the rows."""
    groups = cut(_fullest(parts), "groups")
    free, most = list(quota), max(quota)
    hot = []
    for g in sorted(groups.filter(F.col("all") > most).collect(), key=lambda g: (-g["all"], g["h1"], g["h2"])):  # fewer than shards
        own = parts.filter((F.col("h1") == g["h1"]) & (F.col("h2") == g["h2"])).groupBy("at").agg(F.sum("n").alias("n"))
        held = {r["at"]: r["n"] for r in own.collect()}
        hot.append((g["h1"], g["h2"], _reserve(g["all"], [held.get(s, 0) for s in range(len(quota))], free)))
    whole = groups.filter(F.col("all") <= most)
    counts = {(r["all"], r["to"]): r["n"] for r in whole.groupBy("all", "to").agg(F.count("*").alias("n")).collect()}
    rows, first = [], 0
    places = _places(counts, free)
    for z, t in sorted(counts, key=lambda k: (-k[0], k[1])):
        rows.append((z, t, first, [u for u, _ in places[z, t]], [s for _, s in places[z, t]]))
        first += counts[z, t]
    if not rows:
        return parts.select("h1", "h2", "began", "at").limit(0), hot
    table = parts.sparkSession.createDataFrame(rows, "all bigint, to int, first bigint, until array<bigint>, shard array<int>")
    line = ranked(whole, F.col("all").desc(), F.col("to"), F.col("h1"), F.col("h2"), label="groups_line")
    nth = F.size(F.filter("until", lambda u: u <= F.col("rank") - F.col("first")))
    placed = line.join(F.broadcast(table), ["all", "to"]).select("h1", "h2", F.get("shard", nth).alias("at")).filter("at is not null")
    return parts.select("h1", "h2", "began").join(placed, ["h1", "h2"]), hot


def shard(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    t = text_of(text)
    docs = cut(
        df.select(
            F.col(key), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"),
            F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"),
            F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int").alias("began"),
        ),
        "docs",
    )
    total = docs.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    parts, hot = settle(propagate(docs, shards, rounds, total), quota)
    turn = F.lit(len(hot))  # groups above a quota come first in the rest
    for i, (a, b, _) in enumerate(hot):
        turn = F.when((F.col("h1") == a) & (F.col("h2") == b), i).otherwise(turn)
    placed = docs.join(parts, ["h1", "h2", "began"], "left").withColumn("turn", turn)
    order = [F.col("at").isNull(), F.col("at"), F.col("turn"), F.col("h1"), F.col("h2"), F.col(key), F.col("text_crc32")]
    line = ranked(placed, *order, label="line")
    held = {r["at"]: r["n"] for r in line.groupBy("at").agg(F.count("*").alias("n")).collect()}  # shards + 1 rows
    first = [sum(held.get(s, 0) for s in range(t)) for t in range(shards)]
    kept = [held.get(s, 0) for s in range(shards)]  # never above the quota
    ints = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    slot = F.col("rank") - F.get(ints(first), F.col("at"))
    stay = line.filter("at is not null").select(key, "size", "text_crc32", F.col("at").alias("shard"), slot.alias("slot"))
    # the rest fills stretches: those of the groups above a quota, then each shard up from where its documents end
    rest = ranked(line.filter("at is null").drop("rank"), *order[2:], label="rest")
    stretches, used = [], list(kept)
    for s, n in [x for _, _, own in hot for x in own] + [(s, None) for s in range(shards)]:
        n = quota[s] - used[s] if n is None else n
        stretches.append((s, n, used[s]))
        used[s] += n
    until = [sum(n for _, n, _ in stretches[: i + 1]) for i in range(len(stretches))]
    nth = F.size(F.filter(ints(until), lambda u: u <= F.col("rank"))).cast("int")
    to = F.get(F.array(*[F.lit(s) for s, _, _ in stretches]), nth)
    slot = F.col("rank") - F.get(ints([u - n - k for u, (_, n, k) in zip(until, stretches)]), nth)
    return stay.unionByName(rest.select(key, "size", "text_crc32", to.alias("shard"), slot.alias("slot")))
