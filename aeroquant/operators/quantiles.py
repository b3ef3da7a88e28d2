"""Exact group quantiles that never hold a whole group in one task.

Spark's own ``percentile`` keeps one value-count map per group in one reducer,
which breaks when a group holds a third of all rows. Here ranks are found by counted
refinement. A first pass counts rows per group and prefix of the value (a bucket of
its magnitude); only these counts are shuffled. The buckets that hold a wanted rank
are few. While one of them holds more rows than a task should sort, a further pass
splits those buckets by value and counts again. A last pass reads the rows of the
buckets left, and only their values are shuffled and sorted. Interpolation is linear
between the two closest ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroquant.session import settle

# buckets per factor e of the magnitude; about 0.1 % of a value wide
RESOLUTION = 1024
# equal-width parts of a bucket that is split
PARTS = 4096
# rows of a bucket whose values may be sorted together
SMALL = 100_000

_ALL = "_all"
Spread = Callable[[DataFrame], DataFrame]


def _coarse(value: Column) -> Column:
    """Monotone in the value and free of data-dependent bounds; never null."""
    return F.coalesce(F.floor(F.signum(value) * F.log1p(F.abs(value)) * RESOLUTION), F.lit(0))


def present_values(df: DataFrame, keys: Sequence[str], value: str, optional: Sequence[str] = ()) -> DataFrame:
    """Keys, value ``v`` and its prefix ``b``.

    Rows with a missing value are left out, and rows with a null key unless that
    key is ``optional``.
    """
    v = F.col(value).cast("double")
    present = v.isNotNull() & ~F.isnan(v)
    for key in keys:
        if key not in optional:
            present = present & F.col(key).isNotNull()
    return df.where(present).select(*keys, v.alias("v")).withColumn("b", _coarse(F.col("v")))


def _picks(before: Column, size: Column, n: Column, qs: Sequence[float]) -> Column:
    """Ranks wanted by ``qs`` that fall in [before, before + size)."""
    ranks = []
    for q in qs:
        at = (n - 1).cast("double") * q
        ranks += [F.floor(at), F.ceil(at)]
    return F.filter(F.array_distinct(F.array(*ranks)), lambda r: (r >= before) & (r < before + size))


def _located(totals: DataFrame, groups: Sequence[str], order: str, start: Column, n: Column, qs: Sequence[float]) -> DataFrame:
    """The buckets of each group that hold a wanted rank, with ``start``, the rows before them."""
    upto = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = totals.withColumn("start", start + F.sum("size").over(upto) - F.col("size")).withColumn("n", n)
    found = placed.withColumn("picks", _picks(F.col("start"), F.col("size"), F.col("n"), qs))
    return found.where(F.size("picks") > 0)


_HIT = ["b", "low", "high", "start", "n"]


def _inside(rows: DataFrame, hits: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Rows whose value lies in a hit bucket of their group."""
    named = {c: f"_hit_{c}" for c in [*on, "b"]}
    same = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    for own, other in named.items():
        same = same & (F.col(own) == F.col(other))
    joined = rows.join(hits.withColumnsRenamed(named), same, how)
    return joined.drop(*named.values())


def ranked_values(
    rows: DataFrame, raw: Sequence[str], qs: Sequence[float], keys: Sequence[str] | None = None, spread: Spread | None = None
) -> DataFrame:
    """Quantiles of ``present_values``: keys, ``n`` and array ``q``.

    Rows are counted by their ``raw`` keys. ``spread`` turns a table of them into one
    by ``keys``, such as a segment into the folds that train on it; it is applied to
    counts, or to the few rows of buckets that are split, never to all rows.
    """
    spread = spread or (lambda table: table)
    raw, keys = list(raw), list(raw if keys is None else keys)
    groups, shown = keys or [_ALL], keys
    if not keys:
        rows, raw = rows.withColumn(_ALL, F.lit(1)), [*raw, _ALL]
    common = [k for k in raw if k in groups]
    counted = rows.groupBy(*raw, "b").agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))
    totals = spread(counted).groupBy(*groups, "b").agg(
        F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = F.sum("size").over(Window.partitionBy(*groups))
    hits = settle(_located(totals, groups, "b", F.lit(0), whole, qs).select(*groups, *_HIT, "size"))
    while (hits.where("low < high").agg(F.max("size")).first()[0] or 0) > SMALL:
        on = [*groups, *_HIT]
        near = _inside(rows, hits.select(*common, "b", "low", "high"), common, "left_semi")
        part = F.floor((F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(5e-324)) * PARTS)
        split = _inside(spread(near.withColumn("size", F.lit(1))), hits.drop("size"), groups, "inner").groupBy(
            *on, F.coalesce(part, F.lit(0)).alias("part")
        ).agg(F.sum("size").alias("size"), F.min("v").alias("_low"), F.max("v").alias("_high"))
        finer = _located(split.withColumnsRenamed({"start": "_start", "n": "_n"}), [*groups, "b", "low"], "part",
                         F.col("_start"), F.col("_n"), qs)
        hits = settle(finer.drop("low", "high").withColumnsRenamed({"_low": "low", "_high": "high"}).select(*groups, *_HIT, "size"))
    near = _inside(rows, hits.select(*common, "b", "low", "high"), common, "left_semi")
    counts = spread(near.groupBy(*raw, "b", "v").agg(F.count("*").alias("size")))
    values = counts.groupBy(*groups, "b", "v").agg(F.sum("size").alias("size"))
    last = _located(
        _inside(values, hits.drop("size").withColumnsRenamed({"start": "_start", "n": "_n"}), groups, "inner"),
        [*groups, "b", "low"], "v", F.col("_start"), F.col("_n"), qs,
    )
    found = last.select(*groups, "n", "v", F.explode("picks").alias("rank")).groupBy(*groups).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")  # two per wanted rank
    )

    def interpolate(q: float) -> Column:
        position = (F.col("n") - 1).cast("double") * q
        low = F.element_at("at", F.floor(position))
        high = F.element_at("at", F.ceil(position))
        share = position - F.floor(position)
        return low + (high - low) * share

    return found.select(*shown, "n", F.array(*[interpolate(q) for q in qs]).alias("q"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles per group: keys, ``n`` (non-missing rows) and array ``q``."""
    return ranked_values(present_values(df, keys, value), keys, qs)


def quantiles_with_total(
    df: DataFrame, keys: Sequence[str], column: str, value: str, qs: Sequence[float], total_qs: Sequence[float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Quantiles per ``column`` and over all of its values, from the same passes.

    The total includes rows where ``column`` is null.
    """
    keys, kind = list(keys), df.schema[column].dataType
    rows = present_values(df, [*keys, column], value, optional=[column])
    every = list(dict.fromkeys([*qs, *(total_qs or qs)]))
    own = F.struct(F.col(column).cast("string").alias("_name"), F.lit(False).alias("_total"))
    total = F.struct(F.lit("").alias("_name"), F.lit(True).alias("_total"))

    def spread(table: DataFrame) -> DataFrame:
        both = F.array_compact(F.array(F.when(F.col(column).isNotNull(), own), total))
        return table.select("*", F.inline(both)).drop(column)

    found = settle(ranked_values(rows, [*keys, column], every, [*keys, "_name", "_total"], spread))
    pick = lambda wanted: F.array(*[F.col("q")[every.index(q)] for q in wanted]).alias("q")
    per = found.where("not _total").select(*keys, F.col("_name").cast(kind).alias(column), "n", pick(qs))
    return per, found.where("_total").select(*keys, "n", pick(total_qs or qs))


def named_quantiles(df: DataFrame, keys: Sequence[str], value: str, names: Mapping[str, float]) -> DataFrame:
    """As ``exact_quantiles`` with one column per name."""
    found = exact_quantiles(df, keys, value, list(names.values()))
    return found.select(*keys, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return named_quantiles(df, keys, value, {name: 0.5})


def bucket_quantiles(df: DataFrame, keys: Sequence[str], value: Column, q: str, name: str) -> DataFrame:
    """Quantile of each group at its own level, the key column ``q``.

    The rank is exact, the value is placed linearly inside one bucket of about
    0.1 % width. Only bucket totals are shuffled, so neither a hot group nor the
    number of tasks matters.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    totals = rows.groupBy(*keys, _coarse(F.col("v")).alias("b")).agg(
        F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    w = Window.partitionBy(*keys).orderBy("b")
    inside = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    at = (F.col("n") - 1).cast("double") * F.col(q)
    share = (at - F.col("before")) / F.greatest(F.col("size") - 1, F.lit(1))
    return (
        totals.withColumn("n", F.sum("size").over(Window.partitionBy(*keys)))
        .withColumn("before", inside)
        .where((F.floor(at) >= F.col("before")) & (F.floor(at) < F.col("before") + F.col("size")))
        .select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * F.least(share, F.lit(1.0))).alias(name))
    )


def approximate_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], accuracy: int
) -> DataFrame:
    """Explicit opt-in: rank error of at most n / accuracy, no interpolation."""
    found = F.percentile_approx(F.col(value).cast("double"), [float(q) for q in qs], accuracy)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), found.alias("q"))


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns to rows of (keys, column, value), for statistics of many columns."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "column", "value"
    )


def column_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Median per column, and per group where keys are given; nulls ignored.

    A column without any value has no row.
    """
    return medians(melt(df, keys, columns), [*keys, "column"], "value")


def qcut_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row: the distinct edges of equal-count bins, and the distinct count."""
    rows = present_values(df, [], value)
    qs = [i / bins for i in range(bins + 1)]
    n_distinct = rows.select("v").distinct().agg(F.count("*")).scalar()
    return ranked_values(rows, [], qs).select(F.array_distinct("q").alias("edges"), n_distinct.alias("n_distinct"))


def qcut(df: DataFrame, value: str, bins: int = 6, max_raw: int = 10) -> DataFrame:
    """Add ``bin``: right-closed, lowest value included, equal edges merged.

    A column with at most ``max_raw`` distinct values is its own grouping; then
    ``bin`` is null and ``raw`` holds the value.
    """
    v = F.col(value).cast("double")
    facts = qcut_edges(df, value, bins).select(F.struct("edges", "n_distinct")).scalar()
    edges, few = F.col("_facts")["edges"], F.col("_facts")["n_distinct"] <= max_raw
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    bin_no = F.size(F.filter(inner, lambda edge: edge < v))
    return (
        df.withColumn("_facts", facts)
        .withColumn("bin", F.when(~few & v.isNotNull(), bin_no))
        .withColumn("raw", F.when(few, v))
        .drop("_facts")
    )
