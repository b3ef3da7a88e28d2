"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what only
toxic text holds. Every window of a text is compressed with the ordinary dictionary
and with both; the bytes that the toxic one saves are the window's gain. Gains over
calibrated thresholds, summed up per text, feed a logistic curve.

The toxic dictionary's training text is found by contrast: short byte strings far
commoner in toxic than in ordinary texts, joined where they overlap. Ordinary text
comes last in the joint dictionary, where it lies as far back as in the ordinary one,
so a window without toxic strings is parsed alike by both and its gain is near zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.llm.common import pieces, with_fields

SAMPLE_TOXIC = 2_000  # labelled texts the fit takes at most, of each class
SAMPLE_ORDINARY = 6_000
GRAM = 5  # bytes of a contrasted string
CONTRAST = 20  # times commoner in toxic texts
SUPPORT = 0.005  # part of the toxic texts that hold it
WINDOW, WINDOW_SLACK = 100, 150  # bytes; a window ends at a space where one is near
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 2_048
THRESHOLDS = (2, 3, 5)  # gains in bytes


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple
    scale: tuple
    weights: tuple  # the last one is the constant


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows that follow each other."""
    out, at = [], 0
    while at < len(text):
        to = text.find(b" ", at + WINDOW, at + WINDOW + WINDOW_SLACK)
        if to < 0:
            to = min(len(text), at + WINDOW + WINDOW_SLACK)
        out.append(text[at:to])
        at = to
    return out


class Scorer:
    def __init__(self, model: Model):
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_BTOPT, min_match=5, window_log=17,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )

        def compressor(content: bytes):
            book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=book, compression_params=settings).compress

        self.ordinary = compressor(model.ordinary) if len(model.ordinary) >= 8 else compressor(bytes(8))
        self.both = compressor(model.toxic + model.ordinary) if model.toxic else self.ordinary
        self.model = model

    def features(self, text: str | None) -> list[float]:
        # A-Z lower-cased: shouting is no evidence
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        ordinary, both = self.ordinary, self.both
        gains = np.array([len(ordinary(w)) - len(both(w)) for w in windows(raw)] or [0], np.float64)
        top = np.sort(gains)[::-1]
        n = len(gains)
        return [
            gains.mean(), min(top[0], 12.0), min(top[:3].sum(), 30.0),
            *[(gains >= t).sum() / n for t in THRESHOLDS], *[np.log1p((gains >= t).sum()) for t in THRESHOLDS],
            np.log1p(n),
        ]

    def score(self, rows: np.ndarray) -> np.ndarray:
        m = self.model
        z = (rows - np.array(m.mean)) / np.array(m.scale)
        return _curve(z @ np.array(m.weights[:-1]) + m.weights[-1])


def _curve(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _grams(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = (value << np.uint64(8)) | raw[k: n + k]
    return value


def _among(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(asked), bool)
    return sorted_values[np.searchsorted(sorted_values, asked).clip(max=len(sorted_values) - 1)] == asked


def contrast_strings(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """Byte strings of toxic texts, made of grams far commoner there than in ordinary ones."""
    if not toxic:
        return Counter()
    grams, held = np.unique(np.concatenate([np.unique(_grams(t)) for t in toxic]), return_counts=True)
    often = held >= max(4, SUPPORT * len(toxic))
    grams, held = grams[often], held[often]
    other = np.zeros(len(grams), np.int64)
    for text in ordinary:
        if len(grams):
            own = np.unique(_grams(text))
            at = np.searchsorted(grams, own).clip(max=len(grams) - 1)
            other[at[grams[at] == own]] += 1
    picked = grams[held / len(toxic) >= CONTRAST * (other + 0.5) / max(1, len(ordinary))]
    found: Counter = Counter()
    for text in toxic:
        at = np.flatnonzero(_among(picked, _grams(text)))
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            for a, b in zip(np.append(at[0], at[cut + 1]), np.append(at[cut], at[-1])):
                found[text[a: b + GRAM]] += 1
    return found


def _dictionary(size: int, samples: list[bytes], **how) -> bytes:
    """A trained dictionary; too few samples for the trainer give their plain text."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries, thresholds' weights and curve from labelled (text, toxic) rows.

    The ordinary dictionary is trained on every window of every ordinary text.
    """
    texts = [((t or ""), (t or "").encode("utf-8", "surrogatepass").lower(), int(y)) for t, y in rows]
    texts = [t for t in texts if t[1]]
    toxic, ordinary = [b for _, b, y in texts if y], [b for _, b, y in texts if not y]
    base = _dictionary(ORDINARY_BYTES, [w for t in ordinary for w in windows(t)], k=50, d=8)
    strings = contrast_strings(toxic, ordinary)
    samples = [s for s, n in strings.items() for _ in range(min(n, 50))]
    own = _dictionary(TOXIC_BYTES, samples, k=16, d=6) if samples else b""
    model = Model(base, own, (0.0,), (1.0,), (0.0, 0.0))
    if not toxic or not ordinary:
        size = len(Scorer(model).features(""))
        # one class or no labels at all: nothing can be told apart
        constant = -5.0 if not toxic else 5.0
        return Model(base, own, (0.0,) * size, (1.0,) * size, (0.0,) * size + (constant,))
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t, _, _ in texts])
    y = np.array([v for _, _, v in texts], np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * (len(w) - 1) + [0.0])
    for _ in range(25):  # Newton steps
        p = _curve(z @ w)
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(base, own, tuple(mean), tuple(scale), tuple(w))


def training_rows(
    documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> list[tuple[str, int]]:
    """At most ``toxic`` and ``ordinary`` labelled texts, those with the least hash of their id.

    Ids whose crc32 is a multiple of 5 stay out. Of rows that share an id the text of the
    least hash counts. The counts bound the rows the driver gets.
    """
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    marked = (
        labels.where(F.col(label_col).isin(0, 1) & (held != 0)).groupBy(id_col)
        .agg(F.max(label_col).alias("__y")).withColumn("__at", F.xxhash64(id_col))
    )
    picked = [
        marked.where(F.col("__y") == y).orderBy("__at", id_col).limit(n) for y, n in ((1, toxic), (0, ordinary))
    ]
    chosen = picked[0].unionByName(picked[1])
    texts = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    # one text per id before anything is collected, on the map side first
    one = F.min(F.struct(F.xxhash64("__text"), "__text"))["__text"].alias("__text")
    rows = texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "__at", "__y").agg(one).collect()
    return [(r["__text"], r["__y"]) for r in sorted(rows, key=lambda r: (r["__at"], r["__text"] or ""))]


def score_toxicity(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Whole texts are read, window by window; nothing but the text counts.

    - Null or empty text: no gain anywhere, the curve's value for that.
    - Repeated texts get equal scores; an empty table gives an empty one.
    - Input columns named like an added one are replaced, all others pass through.
    """
    schema = with_fields(
        documents.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in pieces(batch, text_col):
                rows = np.array([scorer.features(t) for t in part.column(text_col).to_pylist()])
                score = scorer.score(rows)
                made = {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
                yield pa.RecordBatch.from_arrays(
                    [made[n] if n in made else part.column(n) for n in schema.names], schema.names
                )

    return documents.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0).alias("held_out")
