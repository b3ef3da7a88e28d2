"""Quality rules on repetition: characters inside duplicated n-grams and lines.

A batch of texts is one byte array. Words and lines get 64-bit rolling hashes from
one prefix sum; a window of n words is a polynomial of its word hashes, so moving on
by a word costs a few vector operations for the whole batch. Windows of a longer n
are looked for only where the shorter window was found twice, because a repeated
window starts with a repeated shorter one. Each text is judged alone: nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aeroquant.llm.common import SpanHash, mix64, pieces, text_bytes, with_fields, word_bounds

# the symbols that count as markup or currency noise (fixed values)
SYMBOLS = b"#*$%&|<>"
# words of a window: highest percentage of the text's word characters inside
# windows that an earlier one equals
MAX_NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MAX_LINE_PERCENT = 20
MIN_WORDS = 50
BASE_WORDS = 3
MAX_REPEAT_PERCENT = 50

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is there an equal one, and is there an equal one before it."""
    n = len(keys)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    first = np.minimum.reduceat(order, head)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    many[order] = np.repeat(size > 1, size)
    later[order] = order != np.repeat(first, size)
    return many, later


def _covered(start: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside any of the windows of n words that begin at ``start``."""
    edge = np.zeros(total + 1, np.int64)
    edge[start] += 1
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(raw: np.ndarray, at: np.ndarray, hasher: SpanHash, lengths: list[int]) -> dict[str, np.ndarray]:
    """The figures of all texts of a batch, exact but for 64-bit hash collisions."""
    docs = len(at) - 1
    start, end, row = word_bounds(raw, at)
    total = len(start)
    sums = hasher.sums(raw)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])  # bytes that begin a code point
    size = chars[end] - chars[start]
    symbols = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(IS_SYMBOL[raw], out=symbols[1:])

    def per_doc(mask: np.ndarray | None, weight: np.ndarray | None) -> np.ndarray:
        rows = row if mask is None else row[mask]
        if weight is None:
            return np.bincount(rows, minlength=docs).astype(np.int64)
        got = weight if mask is None else weight[mask]
        run = np.concatenate([[0], np.cumsum(got)])
        return run[np.searchsorted(rows, np.arange(docs), "right")] - run[np.searchsorted(rows, np.arange(docs), "left")]

    out = {
        "n_words": per_doc(None, None), "word_chars": per_doc(None, size),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
    }
    salt = mix64(np.arange(1, docs + 1, dtype=np.uint64))  # keeps texts apart

    # lines: cut after every \n and at every text's start
    newline = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], newline + 1]))
    line_start = line_start[line_start < len(raw)]
    line_end = np.append(line_start[1:], len(raw)) if len(line_start) else line_start
    if len(line_start):
        stops_on_newline = raw[line_end - 1] == 10
        line_end = line_end - stops_on_newline
    first_word = np.searchsorted(start, line_start, "left")
    last_word = np.searchsorted(start, line_end, "left")
    has = last_word > first_word
    line_start, line_end = line_start[has], line_end[has]
    line_row = np.searchsorted(at, line_start, "right") - 1
    _, line_later = _groups(hasher.spans(sums, line_start, line_end) ^ salt[line_row])
    out["n_dup_lines"] = np.bincount(line_row[line_later], minlength=docs).astype(np.int64)
    run = np.concatenate([[0], np.cumsum(size)])
    in_lines = np.zeros(docs, np.int64)
    np.add.at(in_lines, line_row[line_later], (run[last_word[has]] - run[first_word[has]])[line_later])
    out["dup_line_chars"] = in_lines

    # windows
    word = hasher.spans(sums, start, end)
    left = per_doc(None, None).cumsum()  # number of words up to the end of each text
    room = left[row] - np.arange(total) if total else np.zeros(0, np.int64)
    value, n = np.zeros(total, np.uint64), 0
    alive = np.arange(total)
    for want in [BASE_WORDS, *lengths]:
        while n < want:
            shifted = np.zeros(total, np.uint64)
            if n < total:
                shifted[: total - n] = word[n:]
            value = value * STEP + shifted
            n += 1
        alive = alive[room[alive] >= want]
        many, later = _groups(mix64(value[alive] + np.uint64(want)) ^ salt[row[alive]])
        if want == BASE_WORDS:
            out["n_repeat_words"] = per_doc(_covered(alive[many], want, total), None)
        else:
            out[f"dup_{want}"] = per_doc(_covered(alive[later], want, total), size)
        alive = alive[many]
    return out


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(
    documents: DataFrame, text_col: str = "text", ngram_percent: dict[int, int] | None = None,
    line_percent: int = MAX_LINE_PERCENT, min_words: int = MIN_WORDS, repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Measure and judge every whole text; adds the figures, ``base_failed`` and ``kept``.

    Words are runs without space or \\t to \\r. ``n_repeat_words`` counts words in
    windows of three found twice or more, the first included; ``n_dup_lines`` counts
    lines with a word that equal an earlier line of the text. ``dup_line_chars`` and
    ``dup_<n>`` are word characters inside lines or windows of n words that an
    earlier one equals. A text is kept unless it has fewer than ``min_words`` words,
    more than ``repeat_percent`` of its words repeat, more than ``line_percent`` of
    its word characters stand in repeated lines, or more than ``ngram_percent[n]`` in
    repeated windows.

    - Null or empty text: all figures 0, ``base_failed`` true, not kept.
    - Repeated rows are judged alike; a text of any length is measured whole.
    - An empty table gives an empty one. Input columns named like an added one are
      replaced, all others pass through.
    """
    limits = dict(sorted((MAX_NGRAM_PERCENT if ngram_percent is None else ngram_percent).items()))
    lengths = list(limits)
    if lengths and lengths[0] <= BASE_WORDS:
        raise ValueError(f"window lengths must exceed {BASE_WORDS}")
    figures = [*FIELDS, "dup_line_chars", *[f"dup_{n}" for n in lengths]]
    schema = with_fields(
        documents.schema, *[T.StructField(f, T.LongType()) for f in figures],
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            for part in pieces(batch, text_col, 2 << 20):
                m = measure(*text_bytes(part.column(part.schema.get_field_index(text_col))), hasher, lengths)
                base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_percent * m["n_words"])
                bad = 100 * m["dup_line_chars"] > line_percent * m["word_chars"]
                for n, percent in limits.items():
                    bad |= 100 * m[f"dup_{n}"] > percent * m["word_chars"]
                made = {f: pa.array(m[f], pa.int64()) for f in figures}
                made |= {"base_failed": pa.array(base), "kept": pa.array(~base & ~bad)}
                yield pa.RecordBatch.from_arrays(
                    [made[n] if n in made else part.column(n) for n in schema.names], schema.names
                )

    return documents.mapInArrow(run, schema)


def oracle() -> str:
    """The same figures by joins of word windows."""
    sets = ["""
words as (
  select doc_id, coalesce(nullif(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), []), [])  w,
    coalesce(text, '') t from documents),
flat as (
  select doc_id, unnest(w) word, unnest(range(len(w))) i, len(w) total, w from words),
lines_ as (
  select doc_id, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) i from words),
lines as (
  select *, list_sum(list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) c,
    row_number() over (partition by doc_id, line order by i) r
  from lines_ where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
by_line as (
  select doc_id, count(*) filter (r > 1) n_dup_lines, coalesce(sum(c) filter (r > 1), 0) dup_line_chars
  from lines group by 1)"""]
    lengths = [BASE_WORDS, *MAX_NGRAM_PERCENT]
    for n in lengths:
        flag = f"count(*) over (partition by doc_id, g) > 1" if n == BASE_WORDS else \
            "row_number() over (partition by doc_id, g order by i) > 1"
        sets.append(f"""
g{n} as (
  select doc_id, i, cast({flag} as int) f
  from (select doc_id, i, array_to_string(w[i + 1 : i + {n}], ' ') g from flat where i + {n} <= total)),
c{n} as (
  select doc_id, sum(length(word)) c, count(*) k from (
    select a.doc_id, a.i, a.word, max(coalesce(f, 0)) over (
      partition by a.doc_id order by a.i rows between {n - 1} preceding and current row) hit
    from flat a left join g{n} b on a.doc_id = b.doc_id and a.i = b.i)
  where hit = 1 group by 1)""")
    joins = " ".join(f"left join c{n} using (doc_id)" for n in lengths)
    dups = ", ".join(f"cast(coalesce(c{n}.c, 0) as bigint) dup_{n}" for n in MAX_NGRAM_PERCENT)
    bad = " or ".join(f"100 * dup_{n} > {p} * word_chars" for n, p in MAX_NGRAM_PERCENT.items())
    return f"""
with {','.join(sets)},
figures as (
  select doc_id, cast(len(w) as bigint) n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
    cast(length(t) - length(translate(t, '{SYMBOLS.decode()}', '')) as bigint) n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) n_dup_lines,
    cast(coalesce(c{BASE_WORDS}.k, 0) as bigint) n_repeat_words,
    cast(coalesce(dup_line_chars, 0) as bigint) dup_line_chars, {dups}
  from words left join by_line using (doc_id) {joins}),
judged as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from figures)
select *, not (base_failed or 100 * dup_line_chars > {MAX_LINE_PERCENT} * word_chars or {bad}) kept from judged
"""
