"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to the signs of 64 random projections and orders all vectors
of a label by these bits, first bit first. Near vectors agree on long prefixes, so they
stand near each other; a window of neighbours is compared exactly by one matrix product.
Passes are independent, and the pairs they find are united.

The window is one block of the order and the next, so a task compares blocks and never a
whole group. Where the window's far end still links in the first pass, the window moves
on until it does not, so crowds larger than a window are compared in full as well.
A pair counts in the first pass that compares it: every vector carries its block of all
passes. A task returns one row per linked vector, its number of new links and the least
vector of its local component, so nothing grows with the number of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroquant.llm.common import NO_ID, Scratch, components, running_totals, sheltered

BLOCK = 1024
BLOCKS_A_TASK = 8
RECALL = 0.9999
MIN_PASSES = 4
BITS = 64


def passes_for(largest: int, threshold: float, block: int = BLOCK, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold with probability ``recall``.

    A projection separates two vectors with probability angle / pi. A pair shares a
    window if it agrees on as many bits as it takes to cut a label into blocks.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = max(0.0, math.log2(max(1, largest) / block))
    found = agree**bits
    if found >= 1:
        return MIN_PASSES
    return max(MIN_PASSES, math.ceil(math.log(1 - recall) / math.log1p(-found)))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(passes: int):
    """(pass, grp, bits, node) of every vector for every pass."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            node, grp = batch.column("node").to_numpy(), batch.column("grp").to_numpy()
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([17, int(d)]).standard_normal((int(d), passes * BITS))
                signs = (_unit([vectors[i] for i in at]) @ planes[d] >= 0).reshape(len(at), passes, BITS)
                # the first projection is the highest bit; bit 63 flipped sorts as a signed long
                key = np.packbits(signs, axis=2).view(">u8").reshape(len(at), passes).astype(np.uint64)
                key = (key ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(passes, dtype=np.int32), len(at))), pa.array(np.repeat(grp[at], passes)),
                     pa.array(key.reshape(-1)), pa.array(np.repeat(node[at], passes))], ["pass", "grp", "bits", "node"],
                )

    return run


class _Task:
    """What one task finds: new links per vector, and local components."""

    def __init__(self, rows: pd.DataFrame, threshold: float):
        self.node = rows["node"].to_numpy()
        self.grp = rows["grp"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        self.blocks = np.stack(rows["blocks"].to_numpy())
        self.unit = _unit(rows["vector"]) if rows["vector"].map(len).nunique() == 1 else None
        self.rows, self.threshold = rows, threshold
        self.links = np.zeros(len(rows), np.int64)
        self.root = np.arange(len(rows))
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.far = set()

    def compare(self, left: np.ndarray, right: np.ndarray, before: int, same: bool) -> int:
        """Compare two lists of rows; ``before``: passes that came earlier. Returns all links seen."""
        seen = 0
        for g in np.unique(self.grp[left]):
            a, b = left[self.grp[left] == g], right[self.grp[right] == g]
            if not len(a) or not len(b):
                continue
            unit = self.unit
            one, two = (unit[a], unit[b]) if unit is not None else (_unit(self.rows["vector"].iloc[a]), _unit(self.rows["vector"].iloc[b]))
            i, j = np.nonzero(one @ two.T >= self.threshold)
            i, j = a[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            seen += len(i)
            if before and len(i):
                new = (np.abs(self.blocks[i, :before] - self.blocks[j, :before]) > 1).all(axis=1)
                i, j = i[new], j[new]
            np.add.at(self.links, i, self.copies[j])
            np.add.at(self.links, j, self.copies[i])
            self.pairs.append((i, j))
        return seen

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.concatenate([p[0] for p in self.pairs]) if self.pairs else np.zeros(0, np.int64)
        j = np.concatenate([p[1] for p in self.pairs]) if self.pairs else np.zeros(0, np.int64)
        order = np.argsort(np.argsort(self.node, kind="stable"), kind="stable")
        label = order.copy()
        while len(i):
            low = np.minimum(label[i], label[j])
            old = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            label = label[back[label]]  # jump to the label's own label
            if (label == old).all():
                break
        by_rank = np.sort(self.node, kind="stable")
        hit = np.flatnonzero(self.links)
        return self.node[hit], self.links[hit], by_rank[label[hit]]


RESULT = "node long, links long, root long, block long, reach long"


def _frame(task: _Task, reach: list[tuple[int, int]]) -> pd.DataFrame:
    node, links, root = task.result()
    found = pd.DataFrame({"node": node, "links": links, "root": root, "block": -1, "reach": 0})
    far = pd.DataFrame({
        "node": -1, "links": 0, "root": -1, "block": [b for b, _ in reach], "reach": [n for _, n in reach],
    }, columns=list(found.columns))
    return pd.concat([found, far], ignore_index=True).astype("int64")


def _compare_blocks(threshold: float):
    """Blocks of a task, each against itself and the next one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        task, reach = _Task(rows, threshold), []
        block, own, turn = rows["block"].to_numpy(), rows["own"].to_numpy(), rows["pass"].to_numpy()
        for b in np.unique(block[own]):
            for p in np.unique(turn[block == b]):  # passes meet where one order ends
                left = np.flatnonzero((block == b) & (turn == p))
                task.compare(left, left, int(p), True)
                right = np.flatnonzero((block == b + 1) & (turn == p))
                if len(right) and task.compare(left, right, int(p), False) and p == 0:
                    reach.append((int(b), 1))
        return _frame(task, reach)

    return run


def _compare_far(threshold: float, passes: int):
    """One block of the first order against one further on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        task, reach = _Task(rows, threshold), []
        side = rows["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if task.compare(left, right, passes, False):
            reach.append((int(rows["at"].iloc[0]), int(rows["step"].iloc[0])))
        return _frame(task, reach)

    return run


@sheltered("id_col", "vector_col", "label_col", added=("n_links", "component_id", "kept"))
def near_duplicates(
    embeddings: DataFrame, threshold: float = 0.93, block: int = BLOCK, passes: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Every row with ``n_links``, ``component_id`` and ``kept``; the vector is not returned.

    Two vectors link when their labels are equal and not null and the cosine, in
    double precision, is at least ``threshold``. ``component_id`` is the least id
    reachable by links, ``kept`` says whether that is the row's own.

    - Vectors that are null, empty, zero or hold null or non-finite components, and
      those with a null label, link with nothing: no links, a component of their own.
      Vectors of different length do not link.
    - Equal vectors of a label are one class; they link with each other and share
      the class's links, so copies are compared once, however many there are.
    - Null ids come after all others. Rows that share an id are rows of their own.
    - An empty table gives an empty one; input columns named like an added one are
      replaced, others pass through.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "neighbours")
    added = ("n_links", "component_id", "kept")
    slim = [c for c in embeddings.columns if c != vector_col and c not in added]
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(
        F.col(label_col).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False)
    )
    keys = ["_grp", "_h1", "_h2"]
    rows = embeddings.select(
        *slim, F.when(usable, vector).alias("_vector"),
        F.when(usable, F.xxhash64(F.col(label_col), F.size(vector))).alias("_grp"),
        F.when(usable, F.xxhash64(vector)).alias("_h1"), F.when(usable, F.xxhash64(F.lit(3), vector)).alias("_h2"),
    )
    keyed = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    classes = running_totals(
        scratch, rows.where(F.col("_grp").isNotNull()).groupBy(*keys)
        .agg(F.min(keyed).alias("least"), F.count("*").alias("copies"), F.first("_vector").alias("vector")),
        keys, "ranked",
    ).withColumnRenamed("_row", "node").withColumnRenamed("_grp", "grp")
    classes = scratch.stage(classes, "classes")
    largest = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    passes = passes or passes_for(largest, threshold, block)

    hashed = classes.select("node", "grp", "vector").mapInArrow(_hash(passes), "pass int, grp long, bits long, node long")
    order = running_totals(scratch, hashed, ["pass", "grp", "bits", "node"], "order").withColumn(
        "block", F.floor(F.col("_row") / block)
    )
    # the block of each pass, and the row, of every class: arrays of as many entries as passes
    places = order.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pass", "block", "_row"))).alias("p"))
    placed = scratch.stage(
        classes.join(places, "node").select("node", "grp", "vector", "copies", F.col("p.block").alias("blocks"), "p"), "placed"
    )
    task_rows = block * BLOCKS_A_TASK
    shown = placed.select("node", "grp", "vector", "copies", "blocks", F.explode("p").alias("p")).select(
        "node", "grp", "vector", "copies", "blocks", F.col("p.pass").alias("pass"), F.col("p.block").alias("block"),
        F.col("p._row").alias("row"),
    )
    home = F.floor(F.col("row") / task_rows)
    guest = (F.col("block") % BLOCKS_A_TASK == 0) & (home > 0)  # its first block closes the task before
    dealt = shown.withColumn(
        "task", F.explode(F.when(guest, F.array(home, home - 1)).otherwise(F.array(home)))
    ).withColumn("own", F.col("task") == home)
    found = scratch.stage(dealt.groupBy("task").applyInPandas(_compare_blocks(threshold), RESULT), "found-1")

    # crowds larger than a window: move on while the far end links
    results, step, reach = found, 1, found.where("block >= 0").select("block")
    first_order = placed.select("node", "grp", "vector", "copies", "blocks", F.col("blocks")[0].alias("block"))
    while reach.limit(1).count():
        step += 1
        pairs = reach.select(F.col("block").alias("at")).distinct()
        sides = first_order.join(pairs, F.col("block") == F.col("at")).withColumn("side", F.lit(0)).unionByName(
            first_order.join(pairs, F.col("block") == F.col("at") + step).withColumn("side", F.lit(1))
        )
        more = scratch.stage(
            sides.withColumn("step", F.lit(step)).groupBy("at").applyInPandas(_compare_far(threshold, passes), RESULT),
            f"found-{step}",
        )
        results, reach = results.unionByName(more), more.where("block >= 0").select("block")

    hits = results.where("node >= 0")
    links = hits.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(scratch, hits.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "components")
    marked = scratch.stage(
        classes.select("node", F.col("grp").alias("_grp"), "_h1", "_h2", "least", "copies")
        .join(links, "node", "left").join(joined, "node", "left")
        .withColumn("comp", F.coalesce("component", "node")), "marked",
    )
    least = marked.groupBy("comp").agg(F.min("least").alias("_least"))
    answer = scratch.stage(
        marked.join(least, "comp").select(
            *keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("_least") != NO_ID, F.col("_least")).alias("_least"), F.lit(True).alias("_met"),
        ), "answer",
    )
    component = F.when(F.col("_met"), F.col("_least")).otherwise(F.col(id_col).cast("long"))
    return (
        rows.drop("_vector").join(answer, keys, "left")
        .select(
            *slim, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
            F.col(id_col).cast("long").eqNullSafe(component).alias("kept"),
        )
    )


ORACLE = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select a.vec_id a, b.vec_id b from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select a, b from p union select reach.a, p.b from reach join p on reach.b = p.a),
low as (select a, min(b) b from reach group by a),
n as (select a, count(*) n from p group by a)
select vec_id, coalesce(n.n, 0) n_links, least(vec_id, coalesce(low.b, vec_id)) component_id,
  least(vec_id, coalesce(low.b, vec_id)) = vec_id kept
from embeddings left join low on low.a = vec_id left join n on n.a = vec_id
"""
