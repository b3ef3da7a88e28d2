"""Minimax contiguous sharding with DataFrame operations only.

Rows are laid out in one order that keeps equal texts together. The smallest
capacity for which a greedy walk fits the groups into the shards is found by binary
search on run totals: the order is summed up into some ten thousand runs, the walk
over them bounds the capacity and the places of the cuts from both sides, and only
the neighbourhood of the cuts is summed up again in finer runs until every run there
is one group. So the result is exact for the group sizes, while the driver sees a
bounded number of totals. Rows learn their shard by comparing their key with the cut
keys; no row is joined or gathered.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroquant.llm.common import Scratch, running_totals, sheltered

RUNS = 20_000  # run totals the driver sees at once
HEAVY_PARTS = 128  # a group above 1/128 of a shard is laid out by size


def _walk(ends: list[int], atomic: list[bool], capacity: int, shards: int, total: int, relaxed: bool) -> list[int] | None:
    """Greedy cuts for a capacity: the end of each shard, None if the shards do not do.

    ``ends`` are run ends from the first on. A relaxed walk may also cut inside a run
    of several groups, so it fits wherever the true walk fits.
    """
    cuts, at = [], 0
    for _ in range(shards):
        reach = at + capacity
        if reach >= total:
            cuts.append(total)
            return cuts
        i = bisect_right(ends, reach)
        to = ends[i - 1] if i else 0
        if relaxed and i < len(ends) and not atomic[i]:
            to = reach
        if to <= at:
            return None
        cuts.append(to)
        at = to
    return None


def _smallest(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def cut_points(groups: DataFrame, total: int, largest: int, shards: int, runs: int = RUNS) -> list[int]:
    """Ends (in weight) of the shards of the minimax contiguous partition.

    ``groups`` has ``_before`` and ``weight`` in order; groups stay whole. At most
    ``shards`` ends come back; the last is ``total``. Where a hundred shards and more
    keep the search from closing in, the capacity may exceed the least one by a run,
    1/200 of a shard.
    """
    if total <= 0:
        return []
    windows, width = [(0, total)], total
    runs = max(runs, 200 * shards)
    known: dict[int, bool] = {}  # run end: is that run a single group
    end = F.col("_before") + F.col("weight")
    while True:
        step = max(1, width // runs)
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | ((F.col("_before") >= a) & (F.col("_before") < b))
        found = (
            groups.where(inside).groupBy(F.floor(F.col("_before") / step).alias("k"))
            .agg(F.min("_before").alias("lo"), F.max(end).alias("hi"), F.count("*").alias("n")).collect()
        )  # one row per run
        # the runs of this pass replace those they lie in
        known = {e: one for e, one in known.items() if not any(a < e <= b for a, b in windows)}
        for r in found:
            known[r["hi"]] = r["n"] == 1
            if r["lo"]:
                known.setdefault(r["lo"], False)
        ends = sorted(e for e in known if e > 0)
        atomic = [known[e] for e in ends]
        floor = max(-(-total // shards), largest)
        upper = _smallest(floor, total, lambda c: _walk(ends, atomic, c, shards, total, False) is not None)
        lower = _smallest(floor, upper, lambda c: _walk(ends, atomic, c, shards, total, True) is not None)
        if lower == upper and all(
            _whole(ends, atomic, c) for c in _walk(ends, atomic, upper, shards, total, False)[:-1]
        ):
            return _even(ends, upper, shards, total)
        # where the true cuts can lie: between the walk that knows too few cuts and the one that knows too many
        low, high, lo_at, hi_at = [], [], 0, 0
        for _ in range(shards):
            i = bisect_right(ends, lo_at + lower)
            lo_at = max(lo_at, ends[i - 1] if i else 0)
            hi_at = min(total, hi_at + upper)
            j = bisect_right(ends, hi_at)
            low.append(lo_at)
            high.append(ends[min(j, len(ends) - 1)])
        def split(a: int, b: int) -> bool:
            """Is there a run of several groups between a and b?"""
            return not all(atomic[bisect_right(ends, a): bisect_right(ends, b)])

        windows = _merge([(a, b) for a, b in zip(low, high) if a < b and split(a, b)])
        left = sum(b - a for a, b in windows)
        if not windows or left > width // 2:
            return _even(ends, upper, shards, total)
        width = left


def _even(ends: list[int], capacity: int, shards: int, total: int) -> list[int]:
    """Cuts within the capacity that come as near to equal shares as the known ends allow.

    The walk from the right tells how early a cut may lie, so that the rest still fits.
    """
    earliest, at = [total], total
    for _ in range(shards - 1):
        i = bisect_left(ends, at - capacity) if at > capacity else -1
        at = ends[i] if i >= 0 else 0
        earliest.append(at)
    earliest.reverse()
    cuts, at = [], 0
    for k in range(shards):
        if at >= total:
            break
        if k == shards - 1:
            cuts.append(total)
            break
        goal = at + (total - at) // (shards - k)
        last = bisect_right(ends, at + capacity) - 1
        first = max(bisect_left(ends, earliest[k]), bisect_right(ends, at))
        i = min(max(bisect_left(ends, goal), first), last)
        if i - 1 >= first and goal - ends[i - 1] < ends[i] - goal:
            i -= 1
        at = ends[i]
        cuts.append(at)
    return cuts


def _whole(ends: list[int], atomic: list[bool], cut: int) -> bool:
    """Is the run after a cut a single group, so that the cut could not lie further on?"""
    i = bisect_right(ends, cut)
    return i >= len(ends) or atomic[i]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@sheltered("id_col", "text_col", added=("size", "text_crc32", "shard", "slot"))
def shard_documents(
    documents: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row with its ``shard``: sizes near equal, equal texts together.

    A row weighs its text's UTF-8 bytes plus ``overhead``. Groups are rows of equal
    text and stay whole. Large groups come first, by falling size, the others follow
    in the order of their digest; the minimax partition of that order gives the
    shards. A group heavier than an equal share gets a shard of its own, and the
    partition goes on with what is left. Adds ``size text_crc32 shard slot``; slots
    count the rows of a shard from 0 without gaps.

    - Null text weighs ``overhead`` alone, has the checksum 0 and belongs with the
      empty texts.
    - Repeated rows and null ids are rows like others: they weigh and get slots.
    - Fewer groups than shards leave the last shards empty; an empty table gives an
      empty one. Input columns named like an added one are replaced.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = documents.drop(*[c for c in ("size", "text_crc32", "shard", "slot") if c in documents.columns and c not in (id_col, text_col)])
    slim = [c for c in base.columns if c != text_col]
    rows = scratch.stage(
        base.select(
            *slim, (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_group"),
        ), "rows",
    )
    weights = scratch.stage(rows.groupBy("_group").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "weights")
    total, count = weights.agg(F.sum("weight"), F.sum("n")).first()
    if not count:
        return rows.select(*slim, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # fewer than shards * HEAVY_PARTS groups can weigh that much, so the list is bounded
    heavy = (
        weights.where(F.col("weight") * shards * HEAVY_PARTS > total)
        .orderBy(F.desc("weight"), "_group").collect()
    )
    alone, left, rest = 0, total, shards
    while alone < len(heavy) and rest > 1 and heavy[alone]["weight"] * rest > left:
        left, rest, alone = left - heavy[alone]["weight"], rest - 1, alone + 1
    ranks = spark.createDataFrame([(r["_group"], i) for i, r in enumerate(heavy)], "_group string, _heavy int")
    rank = F.coalesce(F.col("_heavy"), F.lit(len(heavy)))
    groups = running_totals(
        scratch, weights.join(F.broadcast(ranks), "_group", "left").withColumn("_heavy", rank)
        .where(F.col("_heavy") >= alone).select("_heavy", "_group", "weight"),
        ["_heavy", "_group"], "groups", "weight",
    )
    largest = heavy[alone]["weight"] if alone < len(heavy) else left // (shards * HEAVY_PARTS)
    ends = cut_points(groups, left, largest, rest)
    starts = ends[:-1]
    keys = (
        groups.where(F.col("_before").isin(starts)).select("_before", "_heavy", "_group").collect() if starts else []
    )  # the first group of each shard but the first
    keys = sorted((k["_heavy"], k["_group"]) for k in keys)

    def shard_of(heavy_col: Column, group_col: Column) -> Column:
        after = F.lit(0)
        for h, g in keys:
            after = after + F.when((heavy_col > h) | ((heavy_col == h) & (group_col >= g)), 1).otherwise(0)
        return F.when(heavy_col < alone, heavy_col).otherwise(F.lit(alone) + after).cast("int")

    dealt = (
        rows.join(F.broadcast(ranks), "_group", "left").withColumn("_heavy", rank)
        .withColumn("shard", shard_of(F.col("_heavy"), F.col("_group")))
        .withColumn("_id", F.col(id_col)).withColumn("_tie", F.xxhash64(*slim))
    )
    placed = running_totals(scratch, dealt, ["shard", "_group", "_id", "_tie"], "placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return (
        placed.join(F.broadcast(first), "shard")
        .select(*slim, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
    )
