"""Line de-duplication through a sharded minimal perfect hash.

Distinct line keys become 128-bit hashes. Those held by several documents are dealt
to shards by hash; each shard numbers its keys with a minimal perfect hash, and
compact arrays indexed by that number hold a fingerprint, the count of documents and
the owner. Documents probe the arrays with the hashes of their lines; no line text is
ever shuffled or joined.

The hash function is a cascade of bit arrays: a key that is alone on its position of
a level is placed there, the others go on to the next level, and the rank of its bit
is its number. The first half of the 128 bits feeds the cascade, the second half is
the fingerprint, so a line that is not indexed fails the comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.llm.common import NO_ID, SPACE, Scratch, mix64, pieces, sheltered, with_fields

LEVELS = 40
ROOM = 2  # bits per key on each level


# --- the minimal perfect hash --------------------------------------------------


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after the other, and keys no level placed.

    ``keys`` are distinct 64-bit values. Each level places more than half of what
    reaches it, so the last list is nearly always empty.
    """
    sizes, bits, left = [], [], keys
    for level in range(LEVELS):
        if not len(left):
            break
        size = ROOM * len(left) + 1
        slot = _slot(left, level, size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[slot]]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return np.array(sizes, np.int64), flat, np.sort(left)


def probe_mph(mph: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number of each key, -1 where no level and no list holds it."""
    sizes, flat, rest = mph
    out = np.full(len(keys), -1, np.int64)
    rank = np.cumsum(flat) - 1
    at, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(at):
            break
        slot = _slot(keys[at], level, int(size)) + base
        hit = flat[slot]
        out[at[hit]] = rank[slot[hit]]
        at, base = at[~hit], base + int(size)
    if len(rest) and len(at):
        place = np.searchsorted(rest, keys[at]).clip(max=len(rest) - 1)
        found = rest[place] == keys[at]
        out[at[found]] = (int(rank[-1]) + 1 if len(rank) else 0) + place[found]
    return out


# --- line keys -----------------------------------------------------------------


def line_hashes(text: str, min_chars: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of lines; index and two 64-bit hashes of the lines whose key is long enough."""
    lines = text.encode("utf-8", "surrogatepass").lower().split(b"\n")  # bytes.lower() touches A-Z only
    at, digests = [], []
    for i, line in enumerate(lines):
        key = line.strip(SPACE)
        n = len(key)
        if n >= 4 * min_chars or (n >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return len(lines), np.array(at, np.int64), np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _doc_keys(min_chars: int):
    """Distinct keys of every document: (h1, h2, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found, docs = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        keys = line_hashes(text, min_chars)[2]
                        if len(keys):
                            if len(keys) > 1:
                                keys = np.unique(keys, axis=0) if len(keys) < 3 else _distinct(keys)
                            found.append(keys)
                            docs.append(np.full(len(keys), NO_ID if doc is None else doc, np.int64))
                if found:
                    keys, docs = np.concatenate(found), np.concatenate(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(docs)],
                        ["h1", "h2", "doc"],
                    )

    return run


def _distinct(keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return keys[new]


INDEX = "shard int, sizes binary, bits binary, n_bits long, rest binary, prints binary, counts binary, owners binary"


def _build_shard(rows):
    import pandas as pd

    keys = rows["h1"].to_numpy().view(np.uint64)
    # equal first halves cannot both be placed; the shard keeps them apart by its list
    keys, first = np.unique(keys, return_index=True)
    twins = np.setdiff1d(np.arange(len(rows)), first)
    rows_kept = rows.iloc[first]
    mph = build_mph(keys)
    number = probe_mph(mph, keys)
    prints, counts, owners = (np.zeros(len(keys), t) for t in (np.int64, np.int64, np.int64))
    prints[number], counts[number], owners[number] = rows_kept["h2"], rows_kept["n"], rows_kept["lo"]
    if len(twins):
        raise RuntimeError("two lines share 64 bits; take another seed")
    return pd.DataFrame({
        "shard": [rows["shard"].iloc[0]], "sizes": [mph[0].tobytes()], "bits": [np.packbits(mph[1]).tobytes()],
        "n_bits": [len(mph[1])], "rest": [mph[2].tobytes()], "prints": [prints.tobytes()],
        "counts": [counts.tobytes()], "owners": [owners.tobytes()],
    })


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream probes past the arrays of their shard; the arrays sort before the probes.

    Memory holds one shard's arrays and one batch, however many probes a shard gets.
    """
    shard, index = None, None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        shards = batch.column("shard").to_numpy()
        edges = np.flatnonzero((kind[1:] == 0) | (shards[1:] != shards[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(kind)]):
            if hi <= lo:
                continue
            if kind[lo] == 0:
                row = {name: batch.column(name)[int(lo)].as_py() for name in
                       ("sizes", "bits", "n_bits", "rest", "prints", "counts", "owners")}
                flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["n_bits"]).astype(bool)
                mph = (np.frombuffer(row["sizes"], np.int64), flat, np.frombuffer(row["rest"], np.uint64))
                index = (mph, *(np.frombuffer(row[k], np.int64) for k in ("prints", "counts", "owners")))
                shard = shards[lo]
                lo += 1
                if hi <= lo:
                    continue
            if shard != shards[lo]:
                continue  # no shared line has a hash of this shard
            mph, prints, counts, owners = index
            part = batch.slice(int(lo), int(hi - lo))
            h1, h2, doc = (part.column(k).to_numpy() for k in ("h1", "h2", "doc"))
            number = probe_mph(mph, h1.view(np.uint64))
            hit = number >= 0
            hit[hit] = prints[number[hit]] == h2[hit]
            hit[hit] = owners[number[hit]] != doc[hit]
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[hit]), pa.array(h1[hit]), pa.array(counts[number[hit]])], ["doc", "h1", "n"]
                )


def _rewrite(text_col: str, min_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                texts, totals, dropped = [], [], []
                gone = part.column("__hits").to_pylist()
                for text, hits in zip(part.column(text_col).to_pylist(), gone):
                    text = text or ""
                    if not hits:
                        texts.append(text)
                        totals.append(text.count("\n") + 1)
                        dropped.append(0)
                        continue
                    n, at, keys = line_hashes(text, min_chars)
                    drop = set(at[np.isin(keys[:, 0].view(np.int64), np.array(hits, np.int64))].tolist())
                    texts.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop))
                    totals.append(n)
                    dropped.append(len(drop))
                made = {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(totals, pa.int64()),
                        "n_dropped": pa.array(dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays(
                    [made[n] if n in made else part.column(n) for n in names], names
                )

    return run


def shared_lines(documents: DataFrame, min_docs: int = 2, min_chars: int = 10,
                 id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keys of every document, the keys that several documents hold with owner ``lo`` and count ``n``)."""
    slim = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    keys = slim.mapInArrow(_doc_keys(min_chars), "h1 long, h2 long, doc long")
    shared = (
        keys.groupBy("h1", "h2")
        .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
        .where((F.col("lo") != F.col("hi")) & (F.col("n") >= min_docs))
    )
    return keys, shared


@sheltered("id_col", "text_col", added=("n_lines", "n_dropped"))
def dedup_lines(
    documents: DataFrame, min_docs: int = 2, min_chars: int = 10, shard_keys: int = 50_000, salts: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every document with the lines dropped that an earlier document holds too.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys
    of ``min_chars`` code points or more that ``min_docs`` documents hold lose all
    their lines except those of the smallest id. Returns the input's columns with the
    shortened text, and ``n_lines`` (before) and ``n_dropped``.

    - Null or empty text: one empty line; the text returned is empty.
    - Null ids count as one document that sorts after all others.
    - Rows with the same id are one document and keep the same lines.
    - A line repeated inside its owner stays as often as it is.
    - An empty table gives an empty one; input columns named ``n_lines`` or
      ``n_dropped`` are replaced, all others pass through.
    - A line in a third of all documents is one key of one shard; its probes spread
      over ``salts`` copies of the shard's arrays and stream through bounded memory.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lines")
    keys, shared = shared_lines(documents, min_docs, min_chars, id_col, text_col)
    shared = scratch.stage(shared, "shared")
    shards = max(1, math.ceil(shared.count() / shard_keys))
    shard = F.pmod(F.shiftright("h2", 17), F.lit(shards)).cast("int").alias("shard")
    index = shared.select(shard, "h1", "h2", "lo", "n").groupBy("shard").applyInPandas(_build_shard, INDEX)
    columns = [f.split(" ")[0] for f in INDEX.split(", ")][1:]
    arrays = index.select(
        "shard", F.explode(F.array(*[F.lit(s) for s in range(salts)])).alias("salt"), F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("doc"), *columns,
    )
    # the shard is known before the arrays are: a probe carries its hash and its document
    empty = [F.lit(None).cast("long" if c == "n_bits" else "binary").alias(c) for c in columns]
    probes = keys.select(
        shard, F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"),
        "h1", "h2", "doc", *empty,
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits = (
        arrays.unionByName(probes).repartition(parts, "shard", "salt")
        .sortWithinPartitions("shard", "salt", "kind")
        .mapInArrow(_probe, "doc long, h1 long, n long")
        .groupBy("doc").agg(F.collect_list("h1").alias("__hits"))
        .withColumnRenamed("doc", "__doc")
    )
    base = documents.drop(*[c for c in ("n_lines", "n_dropped") if c in documents.columns])
    joined = base.join(hits, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col("__doc"), "left").drop("__doc")
    schema = with_fields(
        base.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())
    )
    return joined.mapInArrow(_rewrite(text_col, min_chars, schema.names), schema)
