"""Vector bin packing of tokenised texts into training sequences.

Every piece of text has a demand vector: tokens, one segment, tokens that bear loss.
A sequence has a limit for each. The open sequence takes, of all pieces that still
fit, the one whose demand has the largest dot product with the room that is left, so
a long piece goes first and a scarce resource is spent on pieces that need it. What
little room stays is filled by cutting pieces of the emptiest sequences.

Texts are tokenised, cut and packed in the task that reads them, block by block; the
blocks are bounded, and nothing is shuffled.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from aeroquant.llm.common import pieces

SEQUENCE = 1024
MAX_SEGMENTS = 128
END = 0  # the id that closes a text
BLOCK_TOKENS = 2_000_000
BLOCK_TEXTS = 1_024
TABLE_BYTES = 240_000_000  # what a worker's table of words may hold, by estimate
ENTRY_BYTES = 180  # of an entry without its word and ids


# --- tokens --------------------------------------------------------------------


class Encoder:
    """Ids of texts, word by word from a table of words met before.

    The vocabulary's pattern always ends a match before a space that follows a
    non-space, so a text falls into words with their leading space, each tokenised
    alone. A text in which a space touches other white space is tokenised whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes | None] = {"": None}
        self.first: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, table: dict, made: dict[str, bytes | None]) -> None:
        if self.held < TABLE_BYTES:
            table.update(made)
            self.held += sum(len(w) + len(ids or b"") + ENTRY_BYTES for w, ids in made.items())

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _begin(self, word: str) -> bytes:
        got = self.first.get(word)
        if got is None:
            got = self._ids(word)
            self._keep(self.first, {word: got})
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        words = text.split(" ")
        if words[0][-1:].isspace() or (not words[0] and len(words) > 1):
            return self._ids(text) if len(words) > 1 else self._begin(words[0])
        rest = words[1:]
        try:
            return self._begin(words[0]) + b"".join(map(self.known.get, rest))
        except TypeError:  # a word not met before, or one that cannot stand alone
            return self._slow(text, words[0], rest)

    def _slow(self, text: str, head: str, rest: list[str]) -> bytes:
        known = self.known
        new = [w for w in dict.fromkeys(rest) if w not in known]
        last = rest[-1]
        made: dict[str, bytes | None] = {}
        alone = [w for w in new if not (w[0].isspace() or w[-1].isspace())]
        for word, got in zip(alone, self.tokenizer.encode_batch_fast([" " + w for w in alone], add_special_tokens=False)):
            made[word] = np.array(got.ids, "<u4").tobytes()
        made |= {w: None for w in new if w not in made}
        self._keep(known, made)
        tail = b""
        if last and last[-1].isspace() and not last[0].isspace():  # nothing follows it
            tail, rest = self._ids(" " + last), rest[:-1]
        parts = [made.get(w) if w in made else known[w] for w in rest]
        if None in parts:
            return self._ids(text)
        return self._begin(head) + b"".join(parts) + tail


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker, so its table of words lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- packing -------------------------------------------------------------------


def pack(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of items by the dot-product heuristic; every item fits an empty bin alone."""
    items = np.lexsort((np.arange(len(demand)), -demand[:, 0]))
    scaled = demand[items] / limits
    own = demand[items]
    open_items = np.ones(len(items), bool)
    bins, left = [], len(items)
    while left:
        room, chosen = limits.astype(np.float64), []
        while left:
            at = np.flatnonzero(open_items)
            if len(at) < len(open_items) // 2:
                items, scaled, own = items[at], scaled[at], own[at]
                open_items = np.ones(len(items), bool)
                at = np.arange(len(items))
            fits = at[(own[at] <= room).all(axis=1)]
            if not len(fits):
                break
            best = fits[np.argmax(scaled[fits] @ (room / limits))]
            chosen.append(int(items[best]))
            open_items[best] = False
            room = room - own[best]
            left -= 1
        bins.append(chosen)
    return bins


def fill(bins: list[list[tuple[int, int, int]]], size: int, segments: int) -> list[list[tuple[int, int, int]]]:
    """Cut pieces (text, start, length) of the emptiest bins into the gaps of the fullest.

    A last bin that stays short is cut at powers of two, which need no padding.
    """
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-used[i], i))
    bins, used = [list(bins[i]) for i in order], [used[i] for i in order]
    giver = len(bins) - 1
    for i in range(len(bins)):
        while i < giver and used[i] < size and len(bins[i]) < segments:
            if not bins[giver]:
                giver -= 1
                continue
            text, start, length = bins[giver].pop()
            take = min(length, size - used[i])
            bins[i].append((text, start, take))
            used[i] += take
            used[giver] -= take
            if take < length:
                bins[giver].append((text, start + take, length - take))
    out = []
    for b, n in zip(bins, used):
        if n in (0, size):
            out += [b] if n else []
            continue
        power = 1 << (n.bit_length() - 1)
        part, got = [], 0
        queue = list(reversed(b))
        while queue:
            text, start, length = queue.pop()
            take = min(length, power - got)
            part.append((text, start, take))
            got += take
            n -= take
            if take < length:
                queue.append((text, start + take, length - take))
            if got == power:
                out.append(part)
                part, got, power = [], 0, 1 << max(n.bit_length() - 1, 0)
    return out


def place(lengths: np.ndarray, prompts: np.ndarray, size: int, segments: int, loss: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (text, start, length); each id lies in exactly one piece."""
    out, rest = [], []
    for text, n in enumerate(lengths):
        at = 0
        while n - at >= size and loss >= size:
            out.append([(text, at, size)])
            at += size
        while at < n:  # the rest, or all of it where the loss limit binds
            bare = max(0, int(prompts[text]) - at)
            take = int(min(n - at, size, bare + loss))
            rest.append((text, at, take, max(0, take - bare)))
            at += take
    if rest:
        demand = np.array([(r[2], 1, r[3]) for r in rest], np.float64)
        bins = pack(demand, np.array([size, segments, loss], np.float64))
        packed = [[rest[i][:3] for i in b] for b in bins]
        out += fill(packed, size, segments) if loss >= size else packed
    return out


OUT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack_documents(
    documents: DataFrame, tokenizer_path: str, size: int = SEQUENCE, segments: int = MAX_SEGMENTS,
    loss: int | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text",
    prompt_col: str | None = None, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of all texts in sequences of at most ``size`` tokens.

    A text's ids are those of the vocabulary at ``tokenizer_path`` and ``end`` after
    them. Texts of more than ``size`` tokens fill sequences of their own, the rest is
    packed under three limits: tokens, ``segments`` pieces, ``loss`` tokens that bear
    loss (all, or those after the first ``prompt_col`` ones). Returns one row per
    piece: ``doc_id start length ids_crc32 doc_tokens sequence_id offset``.

    - Null or empty text: the closing id alone. Null ids pass through.
    - Repeated rows are texts of their own. An empty table gives an empty one.
    - No column of the input but id, text and prompt length is read or returned.
    - Sequences join texts of one input partition; a task run again gives the same.
    """
    loss = size if loss is None else loss
    columns = [id_col, text_col] + ([prompt_col] if prompt_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        ids, docs, prompts, held = [], [], [], 0
        close = np.array([end], "<u4").tobytes()

        def flush():
            nonlocal sequence, ids, docs, prompts, held
            lengths = np.array([len(b) // 4 for b in ids], np.int64)
            rows = []
            for parts in place(lengths, np.array(prompts, np.int64), size, segments, loss):
                offset = 0
                for text, start, length in parts:
                    crc = zlib.crc32(memoryview(ids[text])[4 * start: 4 * (start + length)])
                    rows.append((docs[text], start, length, crc, int(lengths[text]), sequence, offset))
                    offset += length
                sequence += 1
            ids, docs, prompts, held = [], [], [], 0
            names = [c.split(" ")[0] for c in OUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            for part in pieces(batch, text_col):
                texts = part.column(text_col).to_pylist()
                keys = part.column(id_col).to_pylist()
                bare = part.column(prompt_col).to_pylist() if prompt_col else [0] * len(texts)
                for key, text, prompt in zip(keys, texts, bare):
                    ids.append(words.encode(text or "") + close)
                    docs.append(key)
                    prompts.append(prompt or 0)
                    held += len(ids[-1]) // 4
                    if held >= block_tokens or len(ids) >= BLOCK_TEXTS:
                        yield flush()
        if ids:
            yield flush()

    return documents.select(*columns).mapInArrow(run, OUT)
