"""Removal of long repeated byte strings with a run-length suffix index.

Every window of ``length`` bytes is named by the least hash of its grams, so equal
windows have equal names, and neighbouring windows named by the same place form a run.
Only runs whose name occurs again matter. Runs whose whole context occurs again are repeated
throughout; of the others, one context of each kind goes to the task of its name,
which indexes all contexts it gets:

- the Burrows-Wheeler transform of the joined contexts, compressed to its runs, with
  the text positions of the run ends sampled;
- the match length with the suffix next in order is computed at sampled run heads
  only. From one sampled position to the next it falls by one a byte, and the partner
  moves along, so the matching statistics of the whole text stream from the samples.

Windows with a match of ``length`` bytes, and their partners, are repeated. Repetitive
text has few runs, so there is little to compute. A name with more contexts than a
task should hold is dealt out by what its windows have in common, part by part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.llm.common import NO_ID, Scratch, SpanHash, pieces, sheltered, text_bytes, with_fields

LENGTH = 200
GRAM = 40
INDEX_BYTES = 2 << 20  # contexts indexed at once
NAME_BYTES = 8 << 20  # contexts of one name before it is dealt out
GAP = 0xFF  # no byte of UTF-8


# --- windows, names, runs --------------------------------------------------------


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def window_runs(raw: np.ndarray, at: np.ndarray, hasher: SpanHash, length: int, gram: int):
    """Runs of all texts: text, first window, number of windows, bytes from the first window
    to the place that names it, name, context hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = hasher.sums(raw)
    n = len(raw) - gram + 1
    grams = hasher.spans(sums, np.arange(n), np.arange(gram, len(raw) + 1))
    # the low bits hold the place, so the least value is the leftmost least gram
    low = np.uint64(n.bit_length())
    placed = ((grams >> low) << low) | np.arange(n, dtype=np.uint64)
    chosen = (_slide(placed, length - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(chosen))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(chosen)]
    inside = start + length <= at[text + 1]  # no window crosses texts
    head = np.empty(len(chosen), bool)
    head[0] = True
    head[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    head &= inside
    stop = np.append(np.flatnonzero(head | ~inside), len(chosen))
    first = np.flatnonzero(head)
    size = stop[np.searchsorted(stop, first, "right")] - first
    context = hasher.spans(sums, first, first + size + length - 1)
    return text[first], first - at[text[first]], size, chosen[first] - first, grams[chosen[first]], context


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                column = part.column(part.schema.get_field_index("text"))
                text, first, size, away, name, context = window_runs(*text_bytes(column), hasher, length, gram)
                doc, mark = part.column("doc").to_numpy(), part.column("mark").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[text]), pa.array(mark[text]), pa.array(first.astype(np.int64)),
                     pa.array(size.astype(np.int32)), pa.array(away.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(context.view(np.int64))],
                    ["doc", "mark", "first", "size", "away", "name", "context"],
                )

    return run


def _squeeze(text_col: str, names: list[str]):
    """Texts compressed, for the way to the task that needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, text_col):
                packed = [
                    squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(text_col).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(packed, pa.binary()) if n == text_col else part.column(n) for n in names], names
                )

    return run


UNIT = "name long, context long, n long, doc long, mark long, first long, size int, away int, body binary"
UNIT_NAMES = [c.split(" ")[0] for c in UNIT.split(", ")]


def _units(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], UNIT_NAMES)


def _bodies(length: int):
    """Cut the contexts out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, rows = batch.slice(lo, 64), []
                for doc, mark, packed, asked in zip(*(part.column(c).to_pylist() for c in ("doc", "mark", "packed", "asked"))):
                    raw = loose.decompress(packed)
                    for a in asked:
                        body = raw[a["first"]: a["first"] + a["size"] + length - 1]
                        rows.append((a["name"], a["context"], a["n"], doc, mark, a["first"], a["size"], a["away"], body))
                yield _units(rows)

    return run


def _parts(length: int, width: int):
    """Runs cut where the distance to the naming place passes a multiple of ``width``.

    So equal windows stay together wherever their runs begin. A part is named by the
    bytes that all windows of its distances have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, away = 0, r["away"]
                while a < r["size"]:
                    near = (away - a) // width * width
                    size = min(away - a - near + 1, r["size"] - a)
                    body = r["body"][a: a + size + length - 1]
                    shared = r["body"][away - near: away - near - width + 1 + length]
                    name = xxhash.xxh3_64_intdigest(shared, seed=near * length + width) - (1 << 63)
                    context = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    rows.append((name, context, r["n"], r["doc"], r["mark"], r["first"] + a, size, away - a, body))
                    a += size
            yield _units(rows)

    return run


# --- the index -------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order by prefix doubling, and the 8 bytes that begin at each position."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k: n + k]
    order = np.argsort(eight, kind="stable")
    sorted_keys = eight[order]
    new = np.ones(n, bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    # the last suffixes hold padding; they are shorter than what they equal
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    width = 8
    alone = np.empty(n, bool)
    while True:
        alone[:-1], alone[-1] = new[:-1] & new[1:], new[-1]
        slots = np.flatnonzero(~alone)
        if not len(slots) or width > 2 * n:
            return order, eight
        at = order[slots]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at].astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        first = np.flatnonzero(fresh)
        rank[at] = np.repeat(slots[first], np.diff(np.append(first, len(slots))))
        width *= 2


class RunIndex:
    """The run-compressed transform of a text: runs, and text positions at their ends."""

    def __init__(self, text: np.ndarray):
        order, self.eight = suffix_order(text)
        self.n = len(text)
        before = np.where(order > 0, text[order - 1], GAP)
        head = np.ones(self.n, bool)
        head[1:] = before[1:] != before[:-1]
        head |= order == 0  # nothing stands before the first byte
        head[1:] |= order[:-1] == 0
        at = np.flatnonzero(head)
        self.symbols = before[at]
        self.run_head = order[at]  # text position of the first suffix of each run
        self.run_tail = order[np.append(at[1:] - 1, self.n - 1)]  # and of the last one

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at a and b, eight bytes a step."""
        out = np.zeros(len(a), np.int64)
        active = np.arange(len(a))
        limit = self.n - np.maximum(a, b)
        while len(active):
            x, y = a[active] + out[active], b[active] + out[active]
            room = np.maximum(x, y) < self.n
            active, x, y = active[room], x[room], y[room]
            differ = self.eight[x] ^ self.eight[y]
            same = differ == 0
            last = active[~same]
            if len(last):
                high = np.zeros(len(last), np.int64)
                d = differ[~same]
                for bits in (32, 16, 8):  # leading zero bytes
                    small = d < (np.uint64(1) << np.uint64(64 - bits))
                    high[small] += bits // 8
                    d = np.where(small, d << np.uint64(bits), d)
                out[last] += high
            active = active[same]
            out[active] += 8
        return np.minimum(out, limit)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Match length with the suffix before it in order, and that suffix, at every byte."""
        head, partner = self.run_head, np.concatenate([[-1], self.run_tail[:-1]])
        common = np.zeros(len(head), np.int64)
        common[1:] = self._common(head[1:], partner[1:])
        by = np.argsort(head)
        head, partner, common = head[by], partner[by], common[by]
        gap = np.diff(np.append(head, self.n))
        away = np.arange(self.n) - np.repeat(head, gap)
        length = np.maximum(np.repeat(common, gap) - away, 0)
        return length, np.repeat(partner, gap) + away


def repeated_windows(bodies: list[bytes], sizes: list[int], length: int) -> list[np.ndarray]:
    """For each context: which of its windows also stand elsewhere among the contexts."""
    joined = bytes([GAP]).join(bodies) + bytes([GAP])
    text = np.frombuffer(joined, np.uint8)
    match, partner = RunIndex(text).stream()
    mark = match >= length
    hit = np.flatnonzero(mark)
    mark[partner[hit]] = True
    starts = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])[:-1]])
    return [mark[s: s + k] for s, k in zip(starts.tolist(), sizes)]


SPAN = "doc long, mark long, start long, stop long"


def _index(length: int):
    """Index whole names, some megabytes at a time, and stream out the repeated spans."""

    def spans(units: list[dict]) -> pa.RecordBatch:
        marks = repeated_windows([u["body"] for u in units], [u["size"] for u in units], length)
        rows = []
        for u, mark in zip(units, marks):
            if u["n"] > 1 or not mark.any():
                continue  # a context that occurs again is known to be repeated
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                rows.append((u["doc"], u["mark"], u["first"] + a, u["first"] + b + length - 1))
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc", "mark", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, None
        for batch in batches:
            for u in batch.to_pylist():
                if u["name"] != name and size >= INDEX_BYTES:
                    yield spans(held)
                    held, size = [], 0
                name = u["name"]
                held.append(u)
                size += len(u["body"])
        if held:
            yield spans(held)

    return run


def _cut(text_col: str, names: list[str]):
    """Drop the spans from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                kept, total, removed, count = [], [], [], []
                for packed, spans in zip(part.column(text_col).to_pylist(), part.column("__spans").to_pylist()):
                    raw = loose.decompress(packed)
                    out, at, runs, end = [], 0, 0, -1
                    for s in sorted((s["start"], s["stop"]) for s in spans or []):
                        if s[0] > end:  # apart from the last one, not even touching it
                            runs += 1
                            out.append(raw[at: s[0]])
                            at = s[1]
                        at, end = max(at, s[1]), max(end, s[1])
                    out.append(raw[at:])
                    kept.append(b"".join(out))
                    total.append(len(raw))
                    removed.append(len(raw) - len(kept[-1]))
                    count.append(runs)
                made = {
                    text_col: pa.array(kept, pa.binary()), "n_bytes": pa.array(total, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([made[n] if n in made else part.column(n) for n in names], names)

    return run


# --- the job -----------------------------------------------------------------------


def repeated_spans(
    documents: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, name_bytes: int = NAME_BYTES,
) -> DataFrame:
    """(doc, mark, start, stop) of repeated bytes of ``documents`` (doc, mark, text); spans may overlap."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = documents.where(F.octet_length("text") >= length).mapInArrow(
        _runs(length, gram), "doc long, mark long, first long, size int, away int, name long, context long"
    )
    # contexts are counted on the map side first, so a passage in many texts is a row per task
    kinds = scratch.stage(
        runs.groupBy("name", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("doc", "mark", "first", "size", "away")).alias("at")
        ), "kinds",
    )
    names = kinds.groupBy("name").agg(F.sum("n").alias("all"), F.min("n").alias("least"), F.count("*").alias("kinds"))
    stop = F.col("first") + F.col("size") + (length - 1)
    known = runs.join(kinds.where("n > 1").select("name", "context"), ["name", "context"])
    spans = known.select("doc", "mark", F.col("first").alias("start"), stop.cast("long").alias("stop"))
    # a name with several contexts, one of them met but once, has to be looked into
    kinds = kinds.join(names.where("kinds > 1 and least = 1").select("name"), "name").select("name", "context", "n", "at")
    asked = kinds.select("at.doc", "at.mark", F.struct("name", "context", "n", "at.first", "at.size", "at.away").alias("a")).groupBy(
        "doc", "mark"
    ).agg(F.collect_list("a").alias("asked"))
    packed = documents.mapInArrow(_squeeze("text", ["doc", "mark", "text"]), "doc long, mark long, text binary")
    units = scratch.stage(
        packed.withColumnRenamed("text", "packed").join(asked, ["doc", "mark"])
        .select("doc", "mark", "packed", "asked").mapInArrow(_bodies(length), UNIT), "units-0",
    )
    step, width = 0, length - gram + 1
    while True:  # deal out names with more contexts than a task should hold
        heavy = units.groupBy("name").agg(F.sum(F.length("body")).alias("bytes")).where(F.col("bytes") > name_bytes)
        heavy = scratch.stage(heavy.select("name"), f"heavy-{step}")
        if not heavy.limit(1).count():
            break
        step, width = step + 1, -(-width // 2)
        halves = scratch.stage(units.join(heavy, "name").select(*UNIT_NAMES).mapInArrow(_parts(length, width), UNIT), f"halves-{step}")
        total = halves.groupBy("name", "context").agg(
            F.sum("n").alias("sum"), F.min(F.struct("doc", "mark", "first", "size", "away")).alias("at"), F.first("body").alias("body")
        )
        known = halves.where("n = 1").join(total.where("sum > 1").select("name", "context"), ["name", "context"])
        spans = spans.unionByName(
            known.select("doc", "mark", F.col("first").alias("start"), stop.cast("long").alias("stop"))
        )
        open_names = total.groupBy("name").agg(F.count("*").alias("kinds"), F.min("sum").alias("least")).where(
            "kinds > 1 and least = 1"
        )
        rest = total.join(open_names.select("name"), "name").select(
            "name", "context", F.col("sum").alias("n"), "at.doc", "at.mark", "at.first", "at.size", "at.away", "body"
        )
        units = scratch.stage(units.join(heavy, "name", "left_anti").unionByName(rest), f"units-{step}")
    found = units.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(_index(length), SPAN)
    return spans.unionByName(scratch.stage(found, "found"))


@sheltered("id_col", "text_col", added=("n_bytes", "n_removed", "n_spans"))
def remove_repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, name_bytes: int = NAME_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row with the bytes gone that a repeated string of ``length`` bytes covers.

    A byte goes if any string of ``length`` bytes over it starts anywhere else too, in
    another text or in its own; overlaps count, and strings are judged on the input.
    The text column becomes binary, as a cut may fall inside a character; adds
    ``n_bytes n_removed n_spans`` (maximal removed runs).

    - Null text is empty; texts below ``length`` bytes stay whole.
    - Exact copies lose all their bytes in every copy, as each one starts elsewhere.
    - Repeated rows, also with the same id, are texts of their own. Null ids are
      allowed. An empty table gives an empty one.
    - Input columns named like an added one are replaced, all others pass through.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "passages")
    added = ("n_bytes", "n_removed", "n_spans")
    base = documents.drop(*[c for c in added if c in documents.columns])
    text = F.coalesce(F.col(text_col), F.lit(""))
    # an id and the text's checksum name a text; equal ones have equal spans
    doc, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text)
    slim = base.select(doc.alias("doc"), mark.alias("mark"), text.alias("text"))
    spans = repeated_spans(slim, scratch, length, gram, name_bytes)
    by_text = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("__spans")).select(
        F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), "__spans"
    )
    keyed = base.withColumns({"__doc": doc, "__mark": mark})
    packed_schema = with_fields(keyed.schema, T.StructField(text_col, T.BinaryType()))
    packed = keyed.mapInArrow(_squeeze(text_col, packed_schema.names), packed_schema)
    joined = packed.join(by_text, ["__doc", "__mark"], "left").drop("__doc", "__mark")
    schema = with_fields(
        base.schema, T.StructField(text_col, T.BinaryType()), *[T.StructField(c, T.LongType()) for c in added]
    )
    return joined.mapInArrow(_cut(text_col, schema.names), schema)
