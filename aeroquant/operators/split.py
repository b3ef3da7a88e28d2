"""Chronological splits and walk-forward folds without a global sort.

A split by row count needs one thing per population: the order key at a few
ranks. Rows are counted per hour, the hours that hold a wanted rank are found from
that small table, and only those hours are ordered. Every row then learns its
segment by comparing its own key with the boundary keys; nothing else moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroquant.session import settle

# share of the newest rows held out, as an exact fraction (fixed value)
TEST_PARTS, ALL_PARTS = 1, 5
MIN_COMPLETE_YEARS = 2
BLOCK = 1 << 16  # copies of a row made from one block


class SplitError(ValueError):
    """A population is too small to be split."""


def order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def join_populations(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by population; a null key is a population of its own."""
    named = {k: f"_right_{k}" for k in keys}
    same = F.lit(True)
    for k, other in named.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(named), same, how).drop(*named.values())


def hour_counts(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows per population and hour, with the rows before; small and stored."""
    w = Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(*keys, F.date_trunc("hour", F.col(time)).alias("h")).agg(F.count("*").alias("size"))
    return settle(counts.withColumn("before", F.sum("size").over(w) - F.col("size")))


def boundary_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hours: DataFrame, ranks: DataFrame
) -> DataFrame:
    """Order key at each wanted zero-based rank: keys, ``rank``, ``key``, ``skip``.

    ``ranks`` has the keys and an array column ``ranks``. ``order`` starts with
    the time column. Where rows tie in the whole order, ``skip`` of them lie before
    the rank.
    """
    inside = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size"))
    hit = settle(
        join_populations(hours, ranks.select(*keys, "ranks"), keys)
        .withColumn("picks", F.filter("ranks", inside))
        .where(F.size("picks") > 0)
        .select(*keys, "h", "before", "picks")
    )
    on = [*keys, "h"]
    keyed = df.select(*keys, F.date_trunc("hour", F.col(order[0])).alias("h"), order_key(order).alias("key"))
    w = Window.partitionBy(*on).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    # copies are counted first, so a hot group of them is one row here
    counted = join_populations(keyed, hit.select(*on), on, "left_semi").groupBy(*on, "key").agg(F.count("*").alias("c"))
    ordered = (
        join_populations(counted, hit, on)
        .withColumn("first", F.col("before") + F.sum("c").over(w) - F.col("c"))
    )
    chosen = F.filter("picks", lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("c")))
    found = ordered.withColumn("rank", F.explode(chosen))
    return found.select(*keys, "rank", "key", (F.col("rank") - F.col("first")).alias("skip"))


def place_ties(tied: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Segments of rows whose whole order key is that of a boundary inside the tie.

    ``tied`` adds ``_key``, ``_base`` (boundaries before the tie) and ``_skips`` (rows of
    the tie before each boundary in it). Such rows are ranked by a hash of the whole row,
    so reruns agree. Hash prefixes are counted first, and only a prefix that a boundary
    cuts is ordered: there copies of a row count as one, and as many of them as belong
    before the boundary go there.
    """
    group = [*keys, "_key"]
    rows = tied.withColumn("_h", F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]))
    rows = rows.withColumn("_b", F.shiftrightunsigned("_h", 48))
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 prefixes a tie at most
    totals = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"), F.first("_skips").alias("_s"))
    totals = totals.withColumn("_start", F.sum("_n").over(upto) - F.col("_n"))
    within = lambda s: (s > F.col("_start")) & (s < F.col("_start") + F.col("_n"))
    totals = settle(totals.withColumn("_cut", F.exists("_s", within)).drop("_s"))
    rows = join_populations(rows, totals, [*group, "_b"])
    before = F.size(F.filter("_skips", lambda s: s <= F.col("_start")))
    whole = rows.where("not _cut").select(*columns, (F.col("_base") + before).alias(name))
    same = rows.where("_cut").groupBy(*columns, "_key", "_base", "_skips", "_h", "_b", "_start").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*group, "_b").orderBy("_h", F.struct(*columns)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_start") + F.sum("_c").over(order) - F.col("_c")
    far = F.lit((1 << 63) - 1)
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("_skips"), F.array(far))
    share = lambda j: F.struct(
        j.alias("j"),
        (F.least(F.col("_at") + F.col("_c"), F.element_at("_edges", j + 2)) - F.greatest("_at", F.element_at("_edges", j + 1))).alias("n"),
    )
    parts = same.withColumn("_at", at).withColumn("_edges", edges).select(
        *columns, "_base", F.inline(F.transform(F.sequence(F.lit(0), F.size("_skips")), share))
    ).where("n > 0")
    # many copies of one row come back in blocks
    blocks = parts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK), F.col("n") - F.col("_k") * BLOCK))
    again = blocks.withColumn("_copy", F.explode(copies)).select(*columns, (F.col("_base") + F.col("j")).alias(name))
    return whole.unionByName(again)


def assign_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ranks_of: Callable[[DataFrame], DataFrame],
    name: str = "segment",
) -> DataFrame:
    """Add how many boundary ranks lie at or before each row (0 to len(ranks)).

    ``ranks_of`` turns the population sizes (keys, ``n``) into ``ranks``; further
    columns it returns are added to the rows. Populations it leaves out are
    dropped; rows with null keys are a population like any other. The rows themselves are only joined with one small table.
    """
    keys = list(keys)
    hours = hour_counts(df, keys, order[0])
    ranks = ranks_of(hours.groupBy(*keys).agg(F.sum("size").alias("n")))
    extra = [c for c in ranks.columns if c not in (*keys, "ranks")]
    found = boundary_keys(df, keys, order, hours, ranks)
    bounds = found.groupBy(*keys).agg(F.collect_list(F.struct("key", "skip")).alias("bounds"))  # one entry per rank
    bounds = settle(join_populations(bounds, ranks.select(*keys, *extra), keys))
    time = F.col(order[0])
    # times differ for nearly all rows, so whole keys are seldom compared
    reached = lambda b: (b["key"]["o0"] < time) | ((b["key"]["o0"] == time) & (b["key"] <= order_key(order)))
    rows = join_populations(df, bounds, keys)
    segment = F.size(F.filter("bounds", reached))
    if not bounds.where(F.exists("bounds", lambda b: b["skip"] > 0)).take(1):
        return rows.withColumn(name, segment).drop("bounds")
    here = lambda b: (b["skip"] > 0) & (b["key"]["o0"] == time) & b["key"].eqNullSafe(order_key(order))
    columns = [*df.columns, *extra]
    skips = F.array_sort(F.transform(F.filter("bounds", here), lambda b: b["skip"]))
    marked = rows.withColumn("_skips", skips)
    free = marked.where(F.size("_skips") == 0).select(*columns, segment.alias(name))
    ahead = F.size(F.filter("bounds", lambda b: reached(b) & ~here(b)))
    tied = marked.where(F.size("_skips") > 0).select(*columns, "_skips", ahead.alias("_base"), order_key(order).alias("_key"))
    return free.unionByName(place_ties(tied, keys, columns, name))


def population_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def split_rank(n: Column) -> Column:
    """First rank of the holdout: the whole part of n times the train share."""
    return F.floor(n * (ALL_PARTS - TEST_PARTS) / F.lit(ALL_PARTS)).cast("bigint")


def chronological_split(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``role``: the oldest 80 % of each population train, the rest test.

    A population whose train or test side would be empty fails.
    """
    cut = split_rank(F.col("n"))
    small = F.raise_error(F.lit("population too small for a chronological split")).cast("bigint")
    rank = F.when((cut > 0) & (cut < F.col("n")), cut).otherwise(small)
    marked = assign_segments(df, keys, order, lambda sizes: sizes.select(*keys, F.array(rank).alias("ranks")), "_segment")
    return marked.withColumn("role", F.when(F.col("_segment") == 0, "train").otherwise("test")).drop("_segment")


def complete_years(df: DataFrame, keys: Sequence[str], time: str = "firstSeen") -> DataFrame:
    """Years with rows in January and in December; gaps between are allowed."""
    return (
        df.groupBy(*keys, F.year(time).alias("year"))
        .agg(F.min(F.month(time)).alias("first_month"), F.max(F.month(time)).alias("last_month"))
        .where((F.col("first_month") == 1) & (F.col("last_month") == 12))
        .select(*keys, "year")
    )


def fold_counts(df: DataFrame, keys: Sequence[str], time: str = "firstSeen") -> DataFrame:
    """Number of folds per population, with its complete years."""
    years = complete_years(df, keys, time).groupBy(*keys).agg(
        F.count("*").alias("n_folds"), F.array_sort(F.collect_list("year")).alias("complete_years")
    )
    return join_populations(population_sizes(df, keys).select(*keys), years, keys, "left").select(
        *keys,
        F.coalesce("n_folds", F.lit(0)).alias("n_folds"),
        F.coalesce("complete_years", F.array().cast("array<int>")).alias("complete_years"),
    )


def feasible(n_folds: Column) -> Column:
    return n_folds >= MIN_COMPLETE_YEARS


def infeasible_reason(n_folds: Column) -> Column:
    return F.when(
        ~feasible(n_folds),
        F.concat(F.lit("Only "), n_folds.cast("string"), F.lit(" complete calendar year(s); at least "),
                 F.lit(MIN_COMPLETE_YEARS).cast("string"), F.lit(" are required.")),
    )


def fold_ranks(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First test rank of each expanding fold, from columns n and n_folds."""
    k, n = F.col("n_folds").cast("bigint"), F.col("n")
    size = F.floor(n / (k + 1)).cast("bigint")
    starts = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: n - (k - i) * size)
    return sizes.where((F.col("n_folds") > 0) & (size > 0)).select(*keys, "n_folds", starts.alias("ranks"))


def fold_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: DataFrame
) -> DataFrame:
    """Add ``segment`` and ``n_folds``; fold i tests segment i and trains on
    every earlier one. ``folds`` has the keys and ``n_folds``.
    """
    counted = folds.select(*keys, "n_folds")
    return assign_segments(
        df, keys, order, lambda sizes: fold_ranks(join_populations(sizes, counted, keys), keys)
    )


def expand_folds(segmented: DataFrame) -> DataFrame:
    """One row per fold a row takes part in, with ``fold`` from 1 and ``role``."""
    first = F.greatest(F.col("segment"), F.lit(1))
    return (
        segmented.where(F.col("segment") <= F.col("n_folds"))
        .withColumn("fold", F.explode(F.sequence(first, F.col("n_folds").cast("int"))))
        .withColumn("role", F.when(F.col("segment") == F.col("fold"), "test").otherwise("train"))
        .drop("segment", "n_folds")
    )
