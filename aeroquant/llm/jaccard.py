"""Exact n-gram Jaccard join by universe partition and pigeonhole.

Two sets of similarity t differ in a bounded number of tokens. The token universe is
hashed into more segments than that, so some segments of a linked pair agree; two of
them at least, as the plan always spends two units more than the bound. Sets meet by
the subsets they hold in a segment. In bands of small sets a segment may also carry
its one-deletion neighbourhood, which still agrees after one difference and counts
as two units; a cost model picks the allocation of each band. A set uses segments in
order until it has spent what its own size asks for, so pairs across sizes meet in
the prefix both use. A set meets larger ones in the next band's partition.

Meetings are verified exactly on the texts. A subset held by thousands of sets does
not become all pairs: its sets are first tested against one hub, then against
another, and only sets still unconnected are paired. Where a crowd is left, the texts
come to the subset in blocks and are compared there; a pair that meets in several
places is compared in the first of them only, and only links come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroquant.llm.common import NO_ID, Scratch, SpanHash, components, mix64, pieces, text_bytes, word_bounds

SPARE_UNITS = 2
BAND_RATIO = 1.4
CROWD = 24  # sets of a more crowded subset are compared where they meet
CROWD_BLOCK = 512
SMALL_COST = 20.0  # weight of meetings by nearly empty segments in the cost model

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z
STEP = np.uint64(0x9FB21C651E98DF25)
CONTENT, PLACE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# --- sets ----------------------------------------------------------------------


def shingle_sets(raw: np.ndarray, at: np.ndarray, hasher: SpanHash, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of every row; a short row is one shingle."""
    raw = FOLD[raw]
    start, end, row = word_bounds(raw, at)
    docs = len(at) - 1
    if not len(start):
        return [np.zeros(0, np.uint64)] * docs
    word = hasher.spans(hasher.sums(raw), start, end)
    total = len(word)
    value = np.zeros(total, np.uint64)
    for k in range(n):
        shifted = np.zeros(total, np.uint64)
        shifted[: total - k] = word[k:] if k < total else 0
        value = value * STEP + shifted
    first = np.searchsorted(row, np.arange(docs), "left")
    last = np.searchsorted(row, np.arange(docs), "right")
    value = mix64(value + np.uint64(n))
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= n:
            out.append(np.unique(value[a: b - n + 1]))
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    short = short * STEP + w
            out.append(mix64(np.array([short], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit keys of a set."""
    a = mix64(tokens ^ CONTENT).sum(dtype=np.uint64)
    b = mix64(tokens ^ PLACE).sum(dtype=np.uint64)
    with np.errstate(over="ignore"):
        key = mix64(np.array([a + np.uint64(len(tokens)), b], np.uint64)).view(np.int64)
    return int(key[0]), int(key[1])


# --- the partition plan ----------------------------------------------------------


@dataclass(frozen=True)
class Band:
    low: int  # sizes from low to below high
    high: int
    segments: int
    double: int  # the first of them carry their one-deletion neighbourhood


def units(size: int, percent: int) -> int:
    """Units a set of this size has to spend: more than any linked set differs in, and two."""
    return (100 - percent) * size // percent + 1 + SPARE_UNITS


def _cost(size: float, segments: int, double: int) -> float:
    mean = size / segments
    few = math.exp(-mean) * (1 + mean)
    few_after = few + math.exp(-mean) * mean * mean / 2
    plain = segments - double
    return plain + double * (mean + 1) + SMALL_COST * (plain * few + double * few_after)


def band_plan(low: int, percent: int) -> Band:
    high = max(low + 1, math.ceil(low * max(BAND_RATIO, 1.02 * 100 / percent)))
    need = units(high - 1, percent)
    need += 1 + need // 16  # room for segments that hold nothing
    size = (low + high - 1) / 2
    best = min(
        ((_cost(size, need - d, d), d) for d in range(need // 2 + 1)), key=lambda c: (c[0], c[1])
    )[1]
    return Band(low, high, need - best, best)


class Plan:
    """Bands over all sizes, made when first asked for."""

    def __init__(self, percent: int):
        self.percent = percent
        # below this size no two different sets are linked
        self.least = next(s for s in range(1, 200) if (100 - percent) * s // percent >= 1)
        self.bands = [band_plan(self.least, percent)]

    def of(self, size: int) -> list[int]:
        """Numbers of the bands in which a set of this size takes part."""
        if size < self.least:
            return []
        while self.bands[-1].high <= size:
            self.bands.append(band_plan(self.bands[-1].high, self.percent))
        i = next(k for k in range(len(self.bands) - 1, -1, -1) if self.bands[k].low <= size)
        if i + 1 == len(self.bands):
            self.bands.append(band_plan(self.bands[i].high, self.percent))
        return [i, i + 1] if 100 * size >= self.percent * self.bands[i + 1].low else [i]


def signatures(tokens: np.ndarray, plan: Plan) -> np.ndarray:
    """The subsets by which a set meets others, as 64-bit keys."""
    found = []
    size = len(tokens)
    for number in plan.of(size):
        band = plan.bands[number]
        salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        own = mix64(tokens + salt)
        segment = ((own >> np.uint64(20)) % np.uint64(band.segments)).astype(np.int64)
        count = np.bincount(segment, minlength=band.segments)
        value = np.where(np.arange(band.segments) < band.double, np.minimum(count, 2), np.minimum(count, 1))
        spent = np.cumsum(value)
        need = units(size, plan.percent)
        used = int(np.searchsorted(spent, need)) + 1
        with np.errstate(over="ignore"):
            place = np.uint64(number << 32) + np.arange(band.segments, dtype=np.uint64)
            if used > band.segments:  # too uneven: such sets of the band all meet
                used = band.segments
                found.append(mix64(np.array([(number << 32) + (1 << 31), (number << 32) + (1 << 31) + 1], np.uint64)))
            take = segment < used
            order = np.argsort(segment[take], kind="stable")
            seg, tok = segment[take][order], own[take][order]
            if not len(seg):
                continue
            head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            sums = np.add.reduceat(tok, head)
            here = seg[head]
            size_here = count[here].astype(np.uint64)
            found.append(mix64(sums * CONTENT + place[here] * PLACE + size_here))
            if band.double:
                wide = (seg < band.double) & (count[seg] >= 2)
                which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(seg))))
                less = sums[which[wide]] - tok[wide]
                found.append(
                    mix64(less * CONTENT + place[seg[wide]] * PLACE + (count[seg[wide]] - 1).astype(np.uint64))
                )
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


# --- tasks -----------------------------------------------------------------------


def _sets_of(batch: pa.RecordBatch, hasher: SpanHash, words: int):
    for part in pieces(batch, "text", 1 << 20):
        column = part.column(part.schema.get_field_index("text"))
        yield part, shingle_sets(*text_bytes(column), hasher, words)


def _describe(words: int, row_col: str | None = None):
    """(doc_id, size, node, check): the set of every document by its keys; ``row_col`` comes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            for part, sets in _sets_of(batch, hasher, words):
                keys = [set_key(s) for s in sets]
                made = {
                    "doc_id": part.column("doc_id"), "size": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([k[0] for k in keys], pa.int64()), "check": pa.array([k[1] for k in keys], pa.int64()),
                }
                if row_col:
                    made[row_col] = part.column(row_col)
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return run


def _meet(words: int, percent: int):
    """(sig, node, size) of every different set a task sees; copies in a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, plan, seen = SpanHash(), Plan(percent), set()
        for batch in batches:
            for _, sets in _sets_of(batch, hasher, words):
                sigs, nodes, sizes = [], [], []
                for tokens in sets:
                    if len(tokens) < plan.least:
                        continue
                    node = set_key(tokens)[0]
                    if node in seen:
                        continue
                    seen.add(node)
                    if len(seen) > 1_000_000:  # only saves rows; forgetting repeats some
                        seen.clear()
                    own = signatures(tokens, plan)
                    sigs.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
                    sizes.append(np.full(len(own), len(tokens), np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes)),
                         pa.array(np.concatenate(sizes))], ["sig", "node", "size"],
                    )

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, to be moved to the pairs that need them."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in pieces(batch, "text"):
            packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        loose = zstandard.ZstdDecompressor()
        last: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                packed = dict(zip(a, part.column("pa"))) | dict(zip(b, part.column("pb")))
                sets = {k: last[k] for k in packed if k in last}
                new = [k for k in packed if k not in sets]
                texts = [loose.decompress(packed[k].as_py()) for k in new]
                if texts:
                    raw = np.frombuffer(b"".join(texts), np.uint8)
                    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                    sets |= dict(zip(new, shingle_sets(raw, at, hasher, words)))
                last = sets
                keep = []
                for x, y in zip(a, b):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(keep)], ["a", "b", "linked"])

    return run


def _shared(lists: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Which rows of two lists have an element in common."""
    flat = np.concatenate(lists + other) if lists and other else np.zeros(0, np.int64)
    if not len(flat):
        return np.zeros((len(lists), len(other)), bool)
    values, code = np.unique(flat, return_inverse=True)
    sizes = [len(x) for x in lists + other]
    row = np.repeat(np.arange(len(sizes)), sizes)
    table = np.zeros((len(sizes), len(values)), np.float32)
    table[row, code] = 1
    return table[: len(lists)] @ table[len(lists):].T > 0


def _crowd(words: int, percent: int):
    """Links of unconnected sets that meet in a crowded place; (i, j) names two of its blocks."""

    def run(rows):
        import pandas as pd

        sig, i, j = (int(rows[c].iloc[0]) for c in ("sig", "i", "j"))
        rows = rows.sort_values("node", ignore_index=True)
        block, node, comp, size = (rows[c].to_numpy() for c in ("block", "node", "comp", "size"))
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        # places that come before this one: pairs that share one were compared there
        before = [np.asarray(s, np.int64)[np.asarray(s, np.int64) < sig] for s in rows["sigs"]]
        fit = (comp[left][:, None] != comp[right][None, :]) & (
            100 * np.minimum(size[left][:, None], size[right][None, :])
            >= percent * np.maximum(size[left][:, None], size[right][None, :])
        )
        if i == j:
            fit &= node[left][:, None] < node[right][None, :]
        fit &= ~_shared([before[k] for k in left], [before[k] for k in right])
        a, b = np.nonzero(fit)
        a, b = left[a], right[b]
        needed = np.unique(np.concatenate([a, b]))
        loose, hasher, links = zstandard.ZstdDecompressor(), SpanHash(), []
        if len(needed):
            texts = [loose.decompress(rows["packed"].iloc[k]) for k in needed]
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            sets = dict(zip(needed.tolist(), shingle_sets(np.frombuffer(b"".join(texts), np.uint8), at, hasher, words)))
            root = {int(c): int(c) for c in np.unique(comp)}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(a.tolist(), b.tolist()):
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p == q:
                    continue  # connected by links found here
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    root[max(p, q)] = min(p, q)
                    links.append((node[x], node[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


# --- the join ----------------------------------------------------------------------


def jaccard_classes(
    documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) of every row, and links between different sets.

    A document's set: distinct shingles of ``words`` words, A-Z lower-cased; with
    fewer words the whole sequence is one shingle. Two documents link when
    100 * common >= ``percent`` * united. ``component_id`` is the least id reachable
    by links. Documents of equal sets are one node; the links returned, (a, b) by
    node, connect all nodes of a component.

    - Null or empty texts, or texts of white space, have no set and link with
      nothing, not even with each other.
    - Null ids count after all others; a component of null ids alone has a null id.
    - Rows that share an id are judged by their own texts. Ids name no component
      then; with ``row_col``, a column of longs, the first table also has that column
      of each row and ``component``, the component's least node (null without a set).
    - An empty table gives empty ones; only the id and the text are read.
    - Copies collapse to one node before anything is paired, on the map side first.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    carried = slim if not row_col else documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(row_col).cast("long").alias(row_col)
    )
    described = "doc_id long, size long, node long, check long" + (f", {row_col} long" if row_col else "")
    rows = scratch.stage(carried.mapInArrow(_describe(words, row_col), described), "rows")
    keyed = F.coalesce("doc_id", F.lit(NO_ID))
    classes = scratch.stage(rows.where("size > 0").groupBy("node").agg(F.min(keyed).alias("doc")), "classes")

    by_sig = Window.partitionBy("sig")
    met = slim.mapInArrow(_meet(words, percent), "sig long, node long, size long")
    # sizes travel with the sets, so pairs they rule out are never made
    members = scratch.stage(
        met.withColumns({"lo": F.min(F.struct("node", "size")).over(by_sig), "hi": F.max("node").over(by_sig)})
        .where("lo.node < hi").select("sig", "node", "size", "lo"), "members",
    )

    wanted = members.select("node").distinct().join(classes, "node").select(F.col("doc").alias("doc_id"), "node")
    packed = slim.where(F.length("text") > 0).mapInArrow(_squeeze, "doc_id long, packed binary")
    # one text per node: any document of the class will do
    texts = scratch.stage(
        packed.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(wanted, "doc_id")
        .select("node", "packed"), "texts",
    ) if _ids_are_unique(rows) else _texts_by_set(scratch, slim, words, members)

    def near(a: str, b: str):
        """Sizes allow a link."""
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def judge(pairs: DataFrame, name: str) -> DataFrame:
        joined = (
            pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")
            .select("a", "b", "pa", "pb")
        )
        return scratch.stage(joined.mapInArrow(_verify(words, percent), "a long, b long, linked boolean"), name)

    first = members.where((F.col("node") != F.col("lo.node")) & near("lo.size", "size")).select(
        F.col("lo.node").alias("a"), F.col("node").alias("b")
    ).distinct()
    tested = judge(scratch.stage(first, "pairs-1"), "tested-1")
    links = tested.where("linked").select("a", "b")
    joined = components(scratch, links, "components-1")

    def still_open(joined: DataFrame, groups: DataFrame, name: str) -> DataFrame:
        """Meeting places where unconnected sets are left: (sig, node, size, comp, n)."""
        w = Window.partitionBy("sig")
        marked = groups.select("sig", "node", "size").distinct().join(joined, "node", "left").select(
            "sig", "node", "size", F.coalesce("component", "node").alias("comp")
        )
        return scratch.stage(
            marked.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w), "n": F.count("*").over(w)})
            .where("lo < hi").select("sig", "node", "size", "comp", "n"), name,
        )

    def grown(joined: DataFrame, new: DataFrame, name: str) -> DataFrame:
        """Components after new links; those known enter as stars, which settle in few rounds."""
        stars = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return components(scratch, stars.unionByName(new.select("a", "b")), name)

    def fresh(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return ordered.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")

    def hubs(groups: DataFrame) -> DataFrame:
        """Each set with a hub of its meeting place, by another order than the first."""
        w = Window.partitionBy("sig")
        hub = F.min(F.struct(F.xxhash64(F.lit(2), "node").alias("h"), "node", "size", "comp")).over(w)
        return groups.withColumn("hub", hub).where((F.col("comp") != F.col("hub.comp")) & near("hub.size", "size")).select(
            F.col("node").alias("a"), F.col("hub.node").alias("b")
        )

    def all_pairs(groups: DataFrame) -> DataFrame:
        """Pairs of unconnected sets of a meeting place."""
        other = groups.select("sig", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"))
        return groups.select("sig", F.col("node").alias("a"), "comp", "size").join(other, "sig").where(
            F.expr("a < b and comp <> comp_b") & near("size", "size_b")
        ).select("a", "b")

    def in_place(groups: DataFrame) -> DataFrame:
        """Links found by bringing the texts of a crowd to where it meets, block by block.

        Linked sets meet twice at least, so every set may leave out its most crowded
        place: two sets that share it and another still meet in the other. Texts are
        joined once per set, not once per place.
        """
        place = F.struct("n", "sig")
        own = groups.groupBy("node", "comp", "size").agg(F.sort_array(F.collect_list(place)).alias("places"))  # as many as a set has signatures
        own = own.withColumn("places", F.slice("places", 1, F.size("places") - 1)).where("size(places) > 0")
        rows = own.join(texts, "node").withColumn("sigs", F.col("places.sig")).select(
            "node", "comp", "size", "packed", "sigs", F.inline("places")
        )
        blocks = F.ceil(F.col("n") / CROWD_BLOCK).cast("long")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn(
            "with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        )
        dealt = rows.select(
            "sig", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "comp",
            "size", "sigs", "packed",
        )
        return dealt.groupBy("sig", "i", "j").applyInPandas(_crowd(words, percent), "a long, b long")

    left = still_open(joined, members, "open-1")
    if left.limit(1).count():
        more = judge(scratch.stage(fresh(hubs(left), tested), "pairs-2"), "tested-2")
        tested = tested.unionByName(more)
        joined = grown(joined, more.where("linked"), "components-2")
        left = still_open(joined, left, "open-2")
        pairs = all_pairs(left.where(F.col("n") <= CROWD))
        more = judge(scratch.stage(fresh(pairs, tested), "pairs-3"), "tested-3")
        tested = tested.unionByName(more)
        crowds = scratch.stage(in_place(left.where(F.col("n") > CROWD)), "crowds")
        links = tested.where("linked").select("a", "b").unionByName(crowds)
        joined = grown(joined, more.where("linked").select("a", "b").unionByName(crowds), "components-3")

    placed = scratch.stage(
        classes.join(joined, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("comp")), "placed"
    )
    least = placed.groupBy("comp").agg(F.min("doc").alias("component_id"))
    answer = scratch.stage(placed.join(least, "comp").select("node", "comp", "component_id"), "answer")
    more = [row_col, F.when(F.col("size") > 0, F.col("comp")).alias("component")] if row_col else []
    out = rows.join(answer, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(
            F.when(F.col("component_id") != NO_ID, F.col("component_id"))
        ).alias("component_id"), *more,
    )
    return out, links


def _ids_are_unique(rows: DataFrame) -> bool:
    """No two rows share an id, so an id stands for one text."""
    return not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()


def _texts_by_set(scratch: Scratch, slim: DataFrame, words: int, members: DataFrame) -> DataFrame:
    """The text of each node that meets others, found by its set and not by an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, squeeze, seen = SpanHash(), zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            for part, sets in _sets_of(batch, hasher, words):
                nodes, packed = [], []
                for text, tokens in zip(part.column("text").to_pylist(), sets):
                    node = set_key(tokens)[0] if len(tokens) else None
                    if node is None or node in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    packed.append(squeeze.compress(text.encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "packed"])

    found = slim.mapInArrow(run, "node long, packed binary").join(members.select("node").distinct(), "node")
    return scratch.stage(found.groupBy("node").agg(F.first("packed").alias("packed")), "texts")
