"""Benchmark decontamination: a prefix-filtered join of shingles, with DataFrame functions only.

An item's windows of ``words`` consecutive words are what a document must not hold. A
window is covered by shingles at known offsets. With at most ``k`` changed words, each
change spoils at most ``s`` of the shingles of ``s`` words, so of any ``k * s + 1``
shingles of a window one is left unspoiled: the rarest ones of the corpus are its
prefix, and only they are joined with the documents. A meeting gives the one place where
the window can lie; it must lie inside the document (positional and length bound) and is
then compared word by word.

The corpus is tokenised once and each of its shingles is looked up once. What matches a
shingle of an item is stored, counted, and serves the join, so rarity is exact over all
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroquant.llm.common import Scratch, hinted

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# a word has digits, letters a-z and characters beyond ASCII (fixed value)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ADDED = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; a text of ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: Column, length: Column, size: Column | int) -> Column:
    """Hashes of all runs of ``size`` words, by place; none where the words are fewer."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), length - size + 1)
    return F.when(length >= size, F.transform(places, lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(
        F.array().cast("array<bigint>")
    )


def item_windows(
    scratch: Scratch, benchmark: DataFrame, words: int, shingle: int, max_changed: int, item_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """(win, len, spare, size, ww) of the different windows, and (win, item) of who holds them.

    ``spare`` is the number of words that may differ, ``size`` the words of a shingle.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_in(F.col(text_col)).alias("w")
    ).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    held = scratch.stage(
        items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, words))).alias("ww")).distinct(),
        "held",
    )
    spare = F.least(F.lit(max_changed), F.col("len") - 1)
    windows = scratch.stage(
        held.select("ww").distinct().select(
            F.monotonically_increasing_id().alias("win"), F.size("ww").alias("len"), "ww"
        ).withColumn("spare", spare).withColumn(
            "size", F.least(F.lit(shingle), F.floor(F.col("len") / (F.col("spare") + 1))).cast("int")
        ), "windows",
    )
    return windows, held.join(windows.select("win", "ww"), "ww").select("win", "item")


def candidates(scratch: Scratch, rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, start, win): where a window may lie, by its prefix of rarest shingles."""
    tokens = windows.select(
        "win", "len", "size", "spare",
        F.posexplode(_shingles(F.col("ww"), F.col("len"), F.col("size"))).alias("offset", "sh"),
    )
    keys = scratch.stage(tokens.select("sh").distinct(), "keys")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``shingle`` numbers
    if not sizes:
        return rows.where("false").select("row", F.lit(0).alias("start"), F.lit(0).cast("long").alias("win"))
    laid = rows.select("row", "n", "w").select(
        "row", "n", F.explode(F.array(*[_shingles(F.col("w"), F.col("n"), s) for s in sizes])).alias("all")
    ).select("row", "n", F.posexplode("all").alias("at", "sh"))
    hits = scratch.stage(laid.join(hinted(keys, keys.count()), "sh"), "hits")

    rarity = hits.groupBy("sh").agg(F.count("*").alias("held"))
    ordered = tokens.join(rarity, "sh", "left").groupBy("win", "len", "size", "spare").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "offset", "sh"))).alias("all")
    )  # at most one entry per word of a window
    prefix = scratch.stage(
        ordered.select("win", "len", F.explode(F.slice("all", 1, F.col("spare") * F.col("size") + 1)).alias("t"))
        .where("t.held > 0").select("win", "len", "t.offset", "t.sh"), "prefix",
    )
    met = hits.join(hinted(prefix, prefix.count()), "sh").withColumn("start", F.col("at") - F.col("offset"))
    return met.where("start >= 0 and start + len <= n").select("row", "start", "win").distinct()


def verified(scratch: Scratch, rows: DataFrame, windows: DataFrame, found: DataFrame) -> DataFrame:
    """The candidates whose words are the window's, but for ``spare`` of them."""
    found = scratch.stage(found, "candidates")
    touched = scratch.stage(found.select("row").distinct(), "touched")
    texts = rows.select("row", "w").join(hinted(touched, touched.count()), "row", "left_semi")
    there = F.slice(F.col("w"), F.col("start") + 1, F.col("len"))
    changed = F.size(F.filter(F.zip_with(there, F.col("ww"), lambda a, b: a != b), lambda x: x))
    meant = found.join(windows.select("win", "len", "spare", "ww"), "win")
    return (
        meant.join(texts, "row")
        .where(F.when(F.col("spare") == 0, there == F.col("ww")).otherwise(changed <= F.col("spare")))
        .select("row", "win", "start", (F.col("start") + F.col("len")).alias("stop"))
    )


def spans_of(hits: DataFrame) -> DataFrame:
    """(row, n_hit, spans): the hit words of each row as maximal runs."""
    order = Window.partitionBy("row").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before >= F.col("start"), 0).otherwise(1)
    runs = hits.select("row", "start", "stop").distinct().withColumn("new", new).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("row").agg(
        F.sum(F.col("stop") - F.col("start")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"),
    )


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, words: int = 10, shingle: int = 5, max_changed: int = 0,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Every document with the words that benchmark items share with it.

    A-Z is lower-cased, then words are runs of digits, letters and characters beyond
    ASCII. An item's windows are all runs of ``words`` of its words; an item of fewer is
    one window. A document word inside any occurrence of a window is hit, where at most
    ``max_changed`` words of the window may differ (never all of them). Adds ``n_words
    n_hit n_items items spans contaminated``: ``items`` are the ids with an occurring
    window, as strings in order, ``spans`` the maximal runs of hit words, counted from 0.

    - Null and empty texts have no words; such a document is clean, such an item never
      occurs.
    - Rows are judged one by one, so repeated rows and null ids are rows like others.
    - Rows of the benchmark with one id are one item; a null id is the empty string.
    - An empty benchmark leaves all documents clean, an empty table gives an empty one.
    - Input columns named like an added one are replaced, all others pass through.
    """
    scratch = Scratch(documents.sparkSession, "decontaminate")
    kept = [c for c in documents.columns if c not in ADDED or c == text_col]
    # the caller's columns travel in one struct, so no name of theirs meets one of these
    rows = scratch.stage(
        documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), words_in(F.col(f"`{text_col}`")).alias("w"))
        .select(F.monotonically_increasing_id().alias("row"), "doc", "w", F.size("w").alias("n")), "rows",
    )
    windows, holders = item_windows(scratch, benchmark, words, shingle, max_changed, item_col, item_text_col)
    hits = scratch.stage(verified(scratch, rows, windows, candidates(scratch, rows, windows)), "verified")
    held = hits.select("row", "win").distinct().join(holders, "win").groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )
    found = scratch.stage(spans_of(hits).join(held, "row"), "found")
    for name in ("hits", "candidates", "touched", "prefix", "keys", "verified"):
        scratch.drop(name)
    return rows.select("row", "doc", "n").join(found, "row", "left").select(
        *[F.col(f"doc.`{c}`") for c in kept], F.col("n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


ORACLE = r"""
with texts as (
  select row_number() over () r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
items as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
wins as (
  select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from items where len(w) > 0)),
placed as (select r, unnest(w) x, unnest(range(len(w))) i from texts),
ahead as (select r, i, list(x) over (partition by r order by i rows between current row and 9 following) l from placed),
occurs as (
  select a.r, a.i, s.n, array_to_string(a.l[1:s.n], ' ') k
  from ahead a, (select distinct n from wins) s where len(a.l) >= s.n),
found as (select distinct o.r, o.i, o.n, v.item_id from occurs o join wins v on o.n = v.n and o.k = v.k),
hit as (select r, count(distinct p) h from (select r, unnest(range(i, i + n)) p from (select distinct r, i, n from found)) group by r),
named as (
  select r, count(*) c, string_agg(s, ',' order by s) ids from (select distinct r, cast(item_id as varchar) s from found) group by r)
select t.doc_id, cast(len(t.w) as bigint) n_words, cast(coalesce(h, 0) as bigint) n_hit,
  cast(coalesce(c, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, h is not null contaminated
from texts t left join hit using (r) left join named using (r)
"""
