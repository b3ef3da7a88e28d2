"""Phrase collocations by marginalising the longest windows.

At each word begins one window of the longest phrase length, padded where the piece ends.
Every shorter phrase is the prefix of exactly one window per occurrence, so only longest
windows are counted and all shorter counts are sums over them: a Spark ROLLUP over the
lead columns.

Tasks count the windows of some megabytes of text at a time, as columns of word numbers,
and deal the counts out by the first two words, packed with the words they use. So all
that continues a pair of words meets in one place, where windows too rare for a phrase
are folded into the padding before the ROLLUP: the sums stay whole, and little is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.llm.common import Scratch, SpanHash, mix64, pieces, text_bytes

# characters that end a piece, and those that separate words (fixed values)
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"

BUCKET_BYTES = 4 << 20  # text whose windows meet in one bucket
SALTS = 64  # first cut of the ranking: at most this many lists a language

KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(STOPS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)


# --- counting in tasks ---------------------------------------------------------


def split_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and a number of its piece that grows."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    word = KIND[raw] == 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    piece = np.cumsum((KIND[raw] == 2) | edge[:-1])[start]
    return start, end, piece


def longest_windows(piece: np.ndarray, ids: np.ndarray, words: int) -> np.ndarray:
    """The window that begins at each word: ids plus one, 0 where the piece has ended."""
    out = np.zeros((len(ids), words), np.int32)
    out[:, 0] = ids + 1
    for k in range(1, words):
        same = piece[k:] == piece[:-k]
        out[: len(ids) - k, k][same] = ids[k:][same] + 1
    return out


def summed(windows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different windows in order, with their counts added up."""
    if not len(windows):
        return windows, n
    order = np.lexsort(windows.T[::-1])
    windows = windows[order]
    head = np.flatnonzero(np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)]))
    return windows[head], np.add.reduceat(n[order], head)


def pack(words: pa.Array, windows: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The windows with only the words they use, compressed."""
    used, small = np.unique(windows, return_inverse=True)
    small = small.reshape(windows.shape).astype(np.int32) + (used[0] > 0)
    names = words.take(pa.array(used[used > 0] - 1)).to_pylist()
    small[1:, 0] -= small[:-1, 0].copy()  # ordered, so the first column is nearly all 0
    press = zstandard.ZstdCompressor(level=1).compress
    return press(b" ".join(names)), press(np.ascontiguousarray(small.T).tobytes()), press(n.astype(np.int64).tobytes())


def unpack(names: bytes, windows: bytes, n: bytes, words: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    small = np.frombuffer(open_(windows), np.int32).reshape(words, -1).T.copy()
    small[:, 0] = np.cumsum(small[:, 0])
    return pa.array(open_(names).split(b" "), pa.binary()), small, np.frombuffer(open_(n), np.int64)


COUNTS = "bucket int, lang string, names binary, windows binary, n binary"


def _count(words: int, buckets: int):
    """Counted windows of each run of texts of one language, dealt out by their first two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                for part in pieces(own, "text"):
                    raw, at = text_bytes(part.column("text"))
                    raw = LOWER[raw]
                    start, end, piece = split_words(raw, at)
                    if not len(start):
                        continue
                    size = end - start
                    data = raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    ends = np.concatenate([[0], np.cumsum(size)])
                    dictionary = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
                    ).dictionary_encode()
                    names = dictionary.dictionary
                    windows, n = summed(
                        longest_windows(piece, dictionary.indices.to_numpy(), words), np.ones(len(start), np.int64)
                    )
                    flat, cut = text_bytes(names.cast(pa.large_binary()).view(pa.large_string()))
                    sums = hasher.sums(flat)
                    name = np.concatenate([np.zeros(1, np.uint64), hasher.spans(sums, cut[:-1], cut[1:])])
                    salt = hasher.spans(hasher.sums(code := np.frombuffer(lang.encode() + b" ", np.uint8)),
                                        np.zeros(1, np.int64), np.array([len(code)]))[0]
                    pair = mix64(mix64(name[windows[:, 0]] * STEP + salt) + name[windows[:, 1]])
                    bucket = (pair % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    edges = np.flatnonzero(np.diff(bucket[order])) + 1
                    for rows in np.split(order, edges):
                        packed = pack(names, windows[rows], n[rows])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([bucket[rows[0]]], pa.int32()), pa.array([lang], pa.string())]
                            + [pa.array([x], pa.binary()) for x in packed],
                            ["bucket", "lang", "names", "windows", "n"],
                        )

    return run


def fold(windows: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pad what is too rare, from the last word to the second; the sum over any prefix stays."""
    for k in range(windows.shape[1], 1, -1):
        if not len(windows):
            break
        head = np.flatnonzero(np.concatenate([[True], (windows[1:, :k] != windows[:-1, :k]).any(axis=1)]))
        rare = np.add.reduceat(n, head) < least
        windows[np.repeat(rare, np.diff(np.append(head, len(windows)))), k - 1:] = 0
        windows, n = summed(windows, n)
    return windows, n


def _merge(words: int, least: int):
    """One bucket: the counts of all tasks added up, rare windows folded."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, own in rows.groupby("lang", sort=False):
            parts = [unpack(a, b, c, words) for a, b, c in zip(own["names"], own["windows"], own["n"])]
            names = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            ids, at, windows = names.indices.to_numpy(), 0, []
            for own_names, small, _ in parts:
                number = np.concatenate([[0], ids[at: at + len(own_names)] + 1]).astype(np.int32)
                at += len(own_names)
                windows.append(number[small])
            windows, n = fold(*summed(np.concatenate(windows), np.concatenate([p[2] for p in parts])), least)
            spelled = np.array([None, *(x.decode("utf-8", "replace") for x in names.dictionary.to_pylist())], object)
            out.append(pd.DataFrame(
                {"lang": lang} | {f"w{k + 1}": spelled[windows[:, k]] for k in range(words)} | {"n": n}
            ))
        return pd.concat(out)

    return run


# --- the table of phrases -------------------------------------------------------


def phrase_counts(documents: DataFrame, words: int, least: int, lang_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(lang, size, words, f): each single word, and each longer phrase found ``least`` times; size 0 counts all words."""
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // BUCKET_BYTES))
    columns = [f"w{k + 1}" for k in range(words)]
    schema = "lang string, " + ", ".join(f"{c} string" for c in columns) + ", n long"
    dealt = texts.mapInArrow(_count(words, buckets), COUNTS).repartition(buckets, "bucket")
    folded = dealt.groupBy("bucket").applyInPandas(_merge(words, least), schema)
    sums = folded.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # a grouping set keeps its first columns; a null in the last kept one is padding
    kept = F.lit(False)
    size = F.lit(-1)
    for k in range(words + 1):
        level = (1 << (words - k)) - 1
        here = F.col("level") == level
        size = F.when(here, k).otherwise(size)
        kept = kept | (here & (F.col(columns[k - 1]).isNotNull() if k else F.lit(True)))
    frequent = sums.where(kept).select(
        "lang", size.alias("size"), F.array_compact(F.array(*columns)).alias("words"), "f"
    ).where(f"size <= 1 or f >= {least}")
    return scratch.stage(frequent.where(f"size = 0 or f >= {least}"), "phrases")


SCORE = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"


def mine_collocations(
    documents: DataFrame, words: int = 3, least: int = 10, top: int = 2000, swallow_percent: int = 50,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The strongest phrases of 2 to ``words`` words of each language.

    A-Z is lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends, pieces into
    words at spaces and tabs. A phrase found ``a`` times, at least ``least``, is cut after
    its first k words into parts found ``l`` and ``r`` times; its score is the lowest
    floor(1000000 a a / (l r)) over k, ties to the smallest k. A phrase that lies inside a
    longer one with at least ``swallow_percent`` of its count is dropped. Returns ``lang
    rank phrase words a l r n score``, the first ``top`` per language by score, count and
    phrase; ``n`` counts all words of the language.

    - A null language is ``und``; a null or empty text has no words.
    - Repeated rows count again; ids and further columns play no part.
    - Scores are exact up to counts of fifteen digits; ties end in the phrase's bytes.
    - An empty table, or one without frequent phrases, gives an empty one.
    """
    if words < 2:
        raise ValueError("a phrase has two words or more")
    scratch = Scratch(documents.sparkSession, "collocations")
    phrases = phrase_counts(documents, words, least, lang_col, text_col, scratch)
    spelled = phrases.where("size > 0").select("lang", "size", F.concat_ws(" ", "words").alias("phrase"), "words", "f")
    whole = spelled.where("size > 1").withColumnRenamed("f", "a")
    part = spelled.select("lang", "phrase", "f")
    cuts = whole.select(
        "lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", 1, F.col("k"))).alias("head"),
        F.concat_ws(" ", F.slice("words", F.col("k") + 1, words)).alias("tail"),
    )
    heads = part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    places = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(
            F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.concat_ws(" ", F.slice("words", i, m))
        ),
    ))
    inside = whole.where("size > 2").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "a")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scratch.stage(
        best.join(longer, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {swallow_percent} * a")
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "kept",
    )
    # a language may hold most phrases: its best are first looked for in up to SALTS parts
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(f"rank <= {top}")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {top}")
    totals = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.split("phrase", " ").alias("words"),
        "a", "l", "r", "n", "score",
    )


ORACLE = r"""
with tokens as (
  select row_number() over () d, coalesce(lang, 'und') lang, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+') w from documents),
placed as (select d, lang, unnest(w) x, unnest(range(len(w))) i from tokens),
marked as (select *, length(x) = 1 and regexp_matches(x, '^[.,;:!?\x0A-\x0D]$') stop from placed),
pieced as (select *, sum(stop::int) over (partition by d order by i) p from marked),
lead as (
  select lang, x w1, lead(x) over o w2, lead(x, 2) over o w3 from pieced where not stop
  window o as (partition by d, p order by i)),
f1 as materialized (select lang, w1 ph, count(*) f from lead group by all),
f2 as materialized (select lang, w1, w2, w1 || ' ' || w2 ph, count(*) f from lead where w2 is not null group by all having count(*) >= 10),
f3 as materialized (
  select lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 ph, count(*) f from lead where w3 is not null group by all having count(*) >= 10),
part as materialized (
  select lang, ph, f from f1 union all select lang, ph, f from f2 union all select lang, ph, f from f3),
cuts as (
  select lang, ph, f a, 1 k, w1 head, w2 tail from f2
  union all select lang, ph, f, 1, w1, w2 || ' ' || w3 from f3
  union all select lang, ph, f, 2, w1 || ' ' || w2, w3 from f3),
scored as (
  select c.*, h.f l, t.f r, ((1000000::hugeint * a * a) // (h.f::hugeint * t.f))::bigint score
  from cuts c join part h on c.lang = h.lang and c.head = h.ph join part t on c.lang = t.lang and c.tail = t.ph),
best as (
  select * from scored qualify row_number() over (partition by lang, ph order by score, k) = 1),
inside as (
  select lang, ph, max(f) most from (
    select lang, w1 || ' ' || w2 ph, f from f3 union all select lang, w2 || ' ' || w3, f from f3) group by all),
kept as (
  select best.* from best left join inside i on best.lang = i.lang and best.ph = i.ph
  where most is null or 100 * most < 50 * a),
total as (select lang, sum(f)::bigint n from f1 group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, ph) "rank", ph phrase, a, l, r, n, score
from kept join total using (lang)
qualify "rank" <= 2000
"""
