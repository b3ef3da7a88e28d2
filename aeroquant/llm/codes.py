"""Vector code compression: product codes trained by equal-average nearest-entry search.

Vectors become integers and are cut into equal parts; each part position has a codebook
of a fixed number of entries, so the codebooks travel with the tasks and only their new
sums come back: one row per entry and component, whatever the number of vectors.

The nearest entry is found without comparing all: entries are sorted by the sum of their
components, and for d components the squared distance is at least the squared gap of
the sums over d. From a part's own sum the search goes outward on both sides; a side
ends when that bound strictly exceeds the best distance, so ties are seen too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroquant.llm.common import Scratch

ADDED = ["code", "error", "label_error", "codebooks_sha256"]
BATCH = 20_000  # parts searched at once
# a squared distance must stay below 2 to the 62nd
SQUARES = 1 << 60


class SortedBook:
    """The entries of one part position in the order of their sums."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), sums))
        self.sums, self.sorted = sums[self.order], entries[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each part's nearest entry, ties to the lower index.

        The third value is the number of distances computed.
        """
        n, d = parts.shape
        best = np.full(n, np.iinfo(np.int64).max, np.int64)
        index = np.full(n, len(self.entries), np.int64)
        own = parts.sum(axis=1)
        right = np.searchsorted(self.sums, own)
        looked = 0
        sides = [(right - 1, -1, np.arange(n)), (right.copy(), 1, np.arange(n))]
        while any(len(rows) for _, _, rows in sides):
            for s, (at, step, rows) in enumerate(sides):
                inside = (at >= 0) & (at < len(self.sums))
                at, rows = at[inside], rows[inside]
                gap = self.sums[at] - own[rows]
                # the margin for rounding only lets more through
                near = gap.astype(np.float64) ** 2 <= best[rows].astype(np.float64) * (d * (1 + 1e-9))
                at, rows = at[near], rows[near]
                away = parts[rows] - self.sorted[at]
                distance = np.einsum("ij,ij->i", away, away)
                looked += len(rows)
                which = self.order[at]
                better = (distance < best[rows]) | ((distance == best[rows]) & (which < index[rows]))
                best[rows[better]], index[rows[better]] = distance[better], which[better]
                sides[s] = (at + step, step, rows)
        return index, best, looked


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assign(batch: pa.RecordBatch, books: list[SortedBook]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts (row, part, component), the codes and the distances (row, part)."""
    values = _matrix(batch.column("q"))
    parts = values.reshape(len(values), len(books), -1)
    codes, away = (np.zeros(parts.shape[:2], np.int64) for _ in range(2))
    for p, book in enumerate(books):
        for lo in range(0, len(parts), BATCH):
            codes[lo: lo + BATCH, p], away[lo: lo + BATCH, p], _ = book.nearest(parts[lo: lo + BATCH, p])
    return parts, codes, away


def _sums(entries: list[np.ndarray]):
    """Per task the sums of the parts assigned to each entry: (part, entry, place, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [SortedBook(e) for e in entries]
        size, (_, width) = len(entries[0]), entries[0].shape
        total = np.zeros((len(books), size, width), np.int64)
        count = np.zeros((len(books), size), np.int64)
        for batch in batches:
            if batch.num_rows:
                parts, codes, _ = _assign(batch, books)
                for p in range(len(books)):
                    np.add.at(total[p], codes[:, p], parts[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=size)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), pa.array(np.repeat(count[p, e], width)),
                pa.array(total[p, e].ravel()),
            ], ["part", "entry", "place", "n", "total"])

    return run


def _encode(entries: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [SortedBook(e) for e in entries]
        digits = [f"{i:02x}" for i in range(len(entries[0]))]
        for batch in batches:
            _, codes, away = _assign(batch, books)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(["".join([digits[c] for c in r]) for r in codes.tolist()], pa.string()),
                pa.array(away.sum(axis=1)),
            ], ["row", "code", "error"])

    return run


def quantized(vectors: DataFrame, scale: int, parts: int, vector_col: str, kept: list[str]) -> DataFrame:
    """(id, doc, q): the usable vectors as integers ``floor(scale * x)``."""
    vector = F.col(f"`{vector_col}`")
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    limit = F.sqrt(F.lit(float(SQUARES * parts)) / F.size(vector)) / scale
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= limit))
    return (
        vectors.where(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
        .where(F.coalesce(sound, F.lit(False)))
        .select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), numbers.alias("q"))
    )


def compress_vectors(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(every usable vector with its code, the codebooks by part, entry and component).

    A component x becomes ``floor(scale * x)``. The codebook of a part position starts as
    that part of the vectors with the smallest ids; each round assigns all parts to the
    nearest entry by squared distance, ties to the lower index, and replaces an entry by
    the rounded down mean of its parts; an entry without parts stays. Adds ``code`` (two
    hex digits a part), ``error`` (the final squared distances), ``label_error`` (errors
    summed over equal labels, nulls together) and ``codebooks_sha256``.

    - Vectors that are null, empty, or hold null or non-finite components are left out;
      so are those whose length is no multiple of ``parts`` or differs from that of the
      smallest id, and those with a component so large that a squared distance could
      leave 62 bits (beyond 262144 for 64 components).
    - Ids may be null (last in order) or repeat (then by the vector's integers).
    - Fewer usable vectors than ``entries`` give smaller codebooks; none give an empty
      table and empty codebooks.
    - Input columns named like an added one are replaced, all others pass through.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits holds 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "codes")
    kept = [c for c in vectors.columns if c not in ADDED or c in (id_col, vector_col, label_col)]
    usable = quantized(vectors, scale, parts, vector_col, kept)
    key = F.col(f"doc.`{id_col}`")
    lowest = usable.orderBy(key.asc_nulls_last(), "q").select(F.size("q").alias("n")).limit(1).collect()
    width = lowest[0]["n"] if lowest else 0
    rows = scratch.stage(
        usable.where(F.size("q") == width).select(F.monotonically_increasing_id().alias("row"), "doc", "q"), "rows"
    )
    # a codebook is bounded by the number of its entries
    first = rows.orderBy(key.asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, -1) if first else np.zeros((0, parts, 0))
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    slim = rows.select("row", "q")
    for _ in range(rounds if first else 0):
        sums = slim.mapInArrow(_sums(books), "part int, entry int, place int, n long, total long")
        means = sums.groupBy("part", "entry", "place").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        )
        books = [b.copy() for b in books]
        for r in means.collect():  # at most one row per entry and component
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    lists = [b.tolist() for b in books]
    digest = hashlib.sha256(",".join(str(x) for b in lists for e in b for x in e).encode()).hexdigest()
    if first:
        codes = scratch.stage(slim.mapInArrow(_encode(books), "row long, code string, error long"), "codes")
    else:
        codes = scratch.stage(slim.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "codes")
    label = F.col(f"doc.`{label_col}`").alias("label")
    coded = rows.select("row", "doc", label).join(codes, "row")
    totals = scratch.stage(
        coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "totals"
    )
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        *[F.col(f"doc.`{c}`") for c in kept], "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
    return out, lists


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by plain joins; one block of tables a round."""
    steps = [f"""
kept as (
  select vec_id, label, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as materialized (
  select vec_id, (i - 1) // (len(q) // {parts}) part, (i - 1) % (len(q) // {parts}) place, q[i] v
  from (select vec_id, q, unnest(range(1, len(q) + 1)) i from kept)),
ranked as (select vec_id, row_number() over (order by vec_id) - 1 entry from kept),
book0 as materialized (
  select part, entry, place, v c from cells join ranked using (vec_id) where entry < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} as materialized (
  select vec_id, part, min(d) d, arg_min(entry, d * 1000 + entry) entry from (
    select vec_id, a.part, entry, sum((v - c) * (v - c))::bigint d
    from cells a join book{r} b on a.part = b.part and a.place = b.place group by vec_id, a.part, entry)
  group by vec_id, part)""")
        if r < rounds:
            steps.append(f"""
book{r + 1} as materialized (
  select part, entry, place, coalesce(m, c) c from book{r} left join (
    select part, entry, place,
      cast((sum(v)::bigint - (((sum(v)::bigint % count(*)) + count(*)) % count(*))) // count(*) as bigint) m
    from cells join near{r} using (vec_id, part) group by part, entry, place) using (part, entry, place))""")
    steps.append(f"""
coded as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error
  from near{rounds} group by vec_id),
digest as (select sha256(string_agg(c, ',' order by part, entry, place)) codebooks_sha256 from book{rounds})""")
    return "with " + ",".join(steps) + """
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256
from coded join kept using (vec_id), digest
"""


ORACLE = oracle()
