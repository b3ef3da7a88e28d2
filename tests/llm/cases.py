"""Small tables that hold the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# names that operators use for their own columns
EXTRA = {
    "size": "x1", "score": "x2", "shard": "x3", "row": "x4", "node": "x5", "sig": "x6", "n": "x7", "name": "x8",
    "block": "x9", "doc": "x10", "rank": "x11", "start": "x12",
} | {c: f"y{i}" for i, c in enumerate([
    "_part", "_at", "_s", "_id", "_before", "_from", "_tie", "_start", "_blocks", "_source", "_text", "_group", "_heavy", "_first",
    "_rows", "_weights", "__doc", "__hits", "__spans", "__mark", "_grp", "_h1", "_h2", "_least", "_met", "_vector", "caller~0",
])}


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdeghilnorst") for _ in range(rng.randint(2, 8))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    passage = sentence(rng, 60)
    long = "\n".join(sentence(rng, 12) for _ in range(2500))
    texts = [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (5, base), (5, base), (6, " ".join(near)), (None, base),
        (7, "one two"), (8, "One TWO"), (9, "é" * 10 + "\n" + "é" * 9), (10, "É" * 10 + "\nÉ" + "é" * 9),
        (11, passage + " " + sentence(rng, 30)), (12, sentence(rng, 30) + " " + passage), (13, long),
        (14, "ab " * 400), (15, "\n\n\n"), (16, "tail space \n"), (17, "  double  spaces  "), (None, None),
        (18, "#*$%&|<> " + sentence(rng, 60)), (19, "line to repeat\nother\n  LINE to repeat  \nline to repeat"),
        (20, "LINE TO REPEAT"), (21, "x y　z   w"), (22, "<|endoftext|> and <|endoftext|>"),
    ]
    sources = ["b", None, "a", "", "b", "b", "c", "a"]
    return [(i, t, sources[k % len(sources)]) for k, (i, t) in enumerate(texts)]


def awkward(spark):
    names = ", ".join(f"`{c}` string" for c in EXTRA)
    rows = [r + tuple(EXTRA.values()) for r in awkward_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")


def empty(spark):
    return awkward(spark).where("false")


def words_of(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words_of((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(zip(*(w[k:] for k in range(n))))


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
