"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is shuffled by a hash and cut into blocks of equal token counts. The
mix is a row of slots; slot i goes to the source into whose part of the cumulative
weights the fraction of i times the golden ratio falls, so any stretch of the mix
holds every source in its share, off by a few slots at most. The r-th slot of a
source takes its r-th block, and begins anew when the blocks are used up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroquant.llm.common import Scratch, running_totals, sheltered

# weights of the sources in the order of their names, null last, repeating (fixed values)
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK = 64
GOLDEN = (5**0.5 - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    weight: int
    target: float
    start: int  # words of all sources before
    blocks: int
    upper: float  # end of its part of the unit interval


def targets(sizes: list[int], weights: list[int], passes: int = MAX_PASSES) -> list[float]:
    """Shares of the total by weight, none above ``passes`` times its source's size.

    What a full source cannot take goes to the others by their weights.
    """
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    full: set[int] = set()
    while len(full) < len(sizes):
        left = total - sum(passes * sizes[i] for i in full)
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        for i, w in enumerate(weights):
            out[i] = float(passes * sizes[i]) if i in full else left * w / open_weight
        above = {i for i in range(len(sizes)) if i not in full and out[i] > passes * sizes[i]}
        if not above:
            break
        full |= above
    else:
        out = [float(passes * s) for s in sizes]
    return out


def shares(totals: list[tuple[str | None, int]], weights=WEIGHTS, passes: int = MAX_PASSES, block: int = BLOCK) -> tuple[list[Share], int]:
    """The plan of all sources and the number of slots."""
    ordered = sorted(totals, key=lambda t: (t[0] is None, (t[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in ordered]
    by_weight = [weights[i % len(weights)] for i in range(len(ordered))]
    goal = targets(sizes, by_weight, passes)
    blocks = [-(-n // block) for n in sizes]
    # slots a source needs: its target over the mean length of its blocks
    need = [g * b / n if n else 0.0 for g, b, n in zip(goal, blocks, sizes)]
    slots, whole = round(sum(need)), sum(need) or 1.0
    plan, start, upper = [], 0, 0.0
    for (source, size), weight, target, b, slot_need in zip(ordered, by_weight, goal, blocks, need):
        upper += slot_need / whole
        plan.append(Share(source, size, weight, target, start, b, upper))
        start += size
    return plan, slots


def golden_fraction(i: Column) -> Column:
    """Fraction of i times the golden ratio; split in two so that large i stay exact enough."""
    half = 1 << 20
    low, high = F.pmod(i, F.lit(half)), F.floor(i / half)
    step = (half * GOLDEN) % 1.0
    return F.pmod(F.pmod(high * F.lit(step), F.lit(1.0)) + F.pmod(low * F.lit(GOLDEN), F.lit(1.0)), F.lit(1.0))


def schedule(scratch: Scratch, plan: list[Share], slots: int, passes: int = MAX_PASSES) -> DataFrame:
    """(slot, source number, rank, epoch, block) of the whole mix."""
    spark = scratch.spark
    bounds = F.array(*[F.lit(s.upper) for s in plan[:-1]]) if len(plan) > 1 else F.array().cast("array<double>")
    u = golden_fraction(F.col("slot") + 1)
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn(
        "_s", F.size(F.filter(bounds, lambda b: b <= u)).cast("int")
    )
    ranked = running_totals(scratch, drawn, ["_s", "slot"], "slots")
    first = ranked.groupBy("_s").agg(F.min("_row").alias("_first"))
    counts = spark.createDataFrame([(i, s.blocks) for i, s in enumerate(plan)], "_s int, _blocks long")
    rank = F.col("_row") - F.col("_first")
    return (
        ranked.join(first, "_s").join(counts, "_s").where(F.col("_blocks") > 0)
        .select("slot", "_s", rank.alias("rank"), F.floor(rank / F.col("_blocks")).alias("epoch"),
                (rank % F.col("_blocks")).alias("block"))
        .where(F.col("epoch") < passes)
    )


@sheltered("id_col", "text_col", "source_col", added=("size", "source_size", "target", "taken", "_row"))
def mix_documents(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, block: int = BLOCK, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents: (rows with their take, the mix itself).

    Rows: every input row without its text, with ``size`` (words), ``source_size``,
    ``target``, ``taken`` (words the mix takes, repeats counted; at most ``passes`` times
    the size) and ``_row`` (its number in the mix). Mix: (slot, epoch, row, start, length), the words of
    row ``_row`` that stand at a slot.

    - Null or empty text has no words: size and taken are 0.
    - Null sources are one source after all others; a source without words has the
      target 0.
    - Repeated rows are rows of their own. The order inside a source follows a hash
      of the id, then the id and the row's other columns, so reruns agree.
    - An empty table gives empty ones. Input columns named like an added one are
      replaced, all others pass through.
    - The driver sees one total per source and nothing per row.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    added = ("size", "source_size", "target", "taken")
    slim = [c for c in documents.columns if c != text_col and (c not in added or c in (id_col, source_col))]
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = scratch.stage(documents.select(*slim, words.alias("size"), F.xxhash64(text_col).alias("_text")), "rows")
    totals = [(r[0], r[1]) for r in rows.groupBy(source_col).agg(F.sum("size")).collect()]
    plan, slots = shares(totals, weights, passes, block)
    numbers = spark.createDataFrame(
        [(s.source, i, s.size, s.target, s.start) for i, s in enumerate(plan)],
        "_source string, _s int, source_size long, target double, _start long",
    )
    dealt = (
        rows.join(numbers, F.col(source_col).cast("string").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_at", F.xxhash64(F.lit(seed), id_col)).withColumn("_id", F.col(id_col))
        .withColumn("_tie", F.xxhash64(*slim, "_text")).drop("_text")
    )
    laid = running_totals(scratch, dealt, ["_s", "_at", "_id", "_tie"], "laid", "size")
    laid = laid.withColumn("_from", F.col("_before") - F.col("_start"))
    lo, hi = F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block)
    parts = (
        laid.where("size > 0").select("_row", "_s", "_from", "size", F.explode(F.sequence(lo, hi)).alias("block"))
        .select(
            "_row", "_s", "block",
            F.greatest(F.col("block") * block - F.col("_from"), F.lit(0)).alias("start"),
            F.least((F.col("block") + 1) * block - F.col("_from"), F.col("size")).alias("stop"),
        )
    )
    mix = scratch.stage(
        schedule(scratch, plan, slots, passes).join(parts, ["_s", "block"])
        .select("slot", "epoch", "_row", "start", (F.col("stop") - F.col("start")).alias("length")),
        "mix",
    )
    taken = mix.groupBy("_row").agg(F.sum("length").alias("taken"))
    out = laid.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return out.select(*slim, "size", "source_size", "target", "taken", "_row"), mix
