"""Helpers the operators share: staged tables, row ranks, components, text bytes."""

from __future__ import annotations

import functools
import inspect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.session import checkpoint_dir

# the white space that separates words: space and \t \n \v \f \r (fixed value)
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

NO_ID = (1 << 63) - 1


class Scratch:
    """A folder of staged tables below ``spark.checkpoint.dir``.

    Staging cuts lineage, so a lost executor costs the tasks it held and no more,
    and later joins know the true size of what they join.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/aeroquant-llm/{name}-{uuid.uuid4().hex[:12]}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sheltered(*named: str, added: tuple[str, ...]):
    """Keep the caller's columns apart from an operator's own.

    ``named`` are the operator's parameters that name columns it reads, ``added`` the
    columns it adds; one of that name in the input goes. All others travel under names
    no operator uses, and get theirs back in the (first) result.
    """

    def wrap(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(df: DataFrame, *args, **kwargs):
            bound = signature.bind(df, *args, **kwargs)
            bound.apply_defaults()
            read = {bound.arguments[n] for n in named}
            hidden = {c: f"caller~{i}" for i, c in enumerate(df.columns) if c not in read and c not in added}
            shown = {v: k for k, v in hidden.items()}
            inside = df.select(*[
                F.col(f"`{c}`").alias(hidden.get(c, c)) for c in df.columns if c in hidden or c in read
            ])
            out = operator(inside, *args, **kwargs)
            first = out[0] if isinstance(out, tuple) else out
            first = first.select(*[F.col(f"`{c}`").alias(shown.get(c, c)) for c in first.columns])
            return (first, *out[1:]) if isinstance(out, tuple) else first

        return run

    return wrap


HINT_ROWS = 1_000_000  # rows of a few numbers that may be sent to every executor


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """A table of few short columns, broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= HINT_ROWS else df


def text_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the whole text, a null text as an empty one."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """The schema with fields added; one of the same name is replaced."""
    names = {f.name for f in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + list(fields))


def running_totals(
    scratch: Scratch, df: DataFrame, order: list[str], name: str, weight: str | None = None, parts: int | None = None
) -> DataFrame:
    """Add ``_row`` (rank from 0 in the order) and ``_before`` (weight of all rows before).

    The order must be total. Rows are dealt out by range and sorted where they lie;
    only one total per partition is needed to place each partition, so neither a hot
    key nor a large table meets in one task.
    """
    spark = scratch.spark
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = F.col(weight) if weight else F.lit(0)
    laid = scratch.stage(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    totals = laid.groupBy("_part").agg(F.count("*").alias("n"), F.sum(w.cast("long")).alias("w")).collect()
    rows, weights, n, total = {}, {}, 0, 0
    for t in sorted(totals, key=lambda r: r["_part"]):  # one row per partition
        rows[t["_part"]], weights[t["_part"]] = n, total
        n, total = n + t["n"], total + (t["w"] or 0)
    if not totals:
        rows, weights = {0: 0}, {0: 0}
    offsets = spark.createDataFrame(
        [(p, rows[p], weights[p]) for p in rows], "_part int, _rows long, _weights long"
    )
    # the low 33 bits of the id count the rows of a partition from 0
    placed = laid.join(F.broadcast(offsets), "_part")
    placed = placed.withColumn("_row", F.col("_rows") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if weight:
        from pyspark.sql import Window

        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn(
            "_before", F.col("_weights") + F.coalesce(F.sum(w.cast("long")).over(inside), F.lit(0))
        )
    return placed.drop("_part", "_at", "_rows", "_weights")


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b); component is the least node reached.

    Alternating large and small stars: each round hangs neighbours on the least node
    they see. Only aggregates and joins by node, one stored table per round; the
    driver sees a count and a checksum.
    """
    cur = scratch.stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{name}-0",
    )
    stamp = None
    for step in range(1, rounds + 1):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        nxt = scratch.stage(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        seen = nxt.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        cur, last, stamp = nxt, stamp, (seen["n"], seen["h"])
        if stamp == last or not seen["n"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


# --- texts inside tasks --------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row, without a copy.

    A null row is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; no word crosses rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    row = np.searchsorted(at, start, "right") - 1
    return start, end, row


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of byte spans by one prefix sum, the same in every task.

    Each byte maps to a random word, weighted by a power of an odd base; the
    inverse power makes the value independent of the place.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        spread = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        self.table = mix64(spread) | np.uint64(1)
        self.size = 0

    def _grow(self, n: int) -> None:
        if n <= self.size:
            return
        n = max(n, 1 << 16)
        inverse = pow(self.BASE, -1, 1 << 64)

        def powers(base: int) -> np.ndarray:
            out = np.ones(n, np.uint64)
            done = 1
            while done < n:
                step = np.uint64(pow(base, done, 1 << 64))
                more = min(done, n - done)
                out[done: done + more] = out[:more] * step
                done += more
            return out

        self.up, self.down, self.size = powers(self.BASE), powers(inverse), n

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (sums[end] - sums[start]) * self.down[start]
        return mix64(value + (end - start).astype(np.uint64))
