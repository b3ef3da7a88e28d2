"""Decontamination, vector codes and collocations against plain versions and on awkward cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from aeroquant.llm import codes, collocations, decontaminate
from llm.cases import FOLD, awkward, awkward_rows, empty, sentence

# the names these operators use inside; the caller's columns of the same name stay
OWN = ["row", "doc", "w", "n", "win", "sh", "at", "start", "stop", "len", "size", "spare", "ww", "held", "run", "label",
       "q", "of", "bucket", "n_hit_x"]


def with_own_names(df):
    for c in OWN:
        if c not in df.columns:
            df = df.selectExpr("*", f"'x_{c}' as `{c}`")
    return df


# --- decontamination -------------------------------------------------------------

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(FOLD))


def brute_hits(docs, items, words, changed):
    out = []
    windows = collections.defaultdict(set)
    for name, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - words + 1) if w else 0):
            windows[tuple(w[i: i + words])].add("" if name is None else str(name))
    for d, text in docs:
        w, hit, held = item_words(text), set(), set()
        for win, names in windows.items():
            spare = min(changed, len(win) - 1)
            for i in range(len(w) - len(win) + 1):
                if sum(a != b for a, b in zip(w[i: i + len(win)], win)) <= spare:
                    hit.update(range(i, i + len(win)))
                    held |= names
        runs = []
        for p in sorted(hit):
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        out.append((d, len(w), len(hit), sorted(held), [tuple(r) for r in runs], bool(hit)))
    return out


def contamination_case():
    rng = random.Random(11)
    base = sentence(rng, 40).split(" ")
    items = [
        (1, " ".join(base[:25])), (2, " ".join(base[5:17])), (2, "zulu yankee"), (None, "Xray"), (3, None), (4, "... !"),
        (5, "a a a a a a a a a a a a"), (6, " ".join(base[:25])), (7, sentence(rng, 30)), (8, "ÄÖ éa 12"),
    ]
    changed = list(base)
    changed[12] = "other"
    docs = [r[:2] for r in awkward_rows()] + [
        (100, "Start. " + " ".join(base[3:30]).upper() + " end"), (101, " ".join(changed[:25])), (101, "xray xray"),
        (102, "the zulu; YANKEE and zulu"), (103, "a " * 30), (104, " ".join(base[:9])), (105, " ".join(base[:10])),
        (None, " ".join(base[:10])), (106, "x äö éa12"), (107, "ÄÖ ÉA 12 ÄÖ éA 12"),
        (108, " ".join([*base[:12], "gap", *base[12:25], *base[:10], *base[:10]])),
    ]
    return docs, items


@pytest.mark.parametrize("words,changed", [(10, 0), (10, 2), (6, 1)])
def test_contamination_against_brute_force(spark, words, changed):
    docs, items = contamination_case()
    df = with_own_names(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(df, bench, words=words, max_changed=changed).collect()
    key = lambda r: repr(r)
    assert sorted([
        (r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), [tuple(s) for s in r["spans"]], r["contaminated"]) for r in got
    ], key=key) == sorted(brute_hits(docs, items, words, changed), key=key)
    assert all(r["n_items"] == len(r["items"]) for r in got)
    assert all(r[c] == f"x_{c}" for r in got for c in OWN)


def test_contamination_without_hints(spark, monkeypatch):
    """Beyond the bound of what is broadcast the joins shuffle, with the same result."""
    docs, items = contamination_case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.find_contamination(df, bench).collect()
    monkeypatch.setattr("aeroquant.llm.common.HINT_ROWS", 0)
    assert sorted(map(repr, decontaminate.find_contamination(df, bench).collect())) == sorted(map(repr, want))


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.find_contamination(empty(spark), bench).collect() == []
    for none in (bench.where("false"), spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")):
        got = decontaminate.find_contamination(awkward(spark), none).collect()
        assert len(got) == len(awkward_rows()) and not any(r["contaminated"] or r["n_hit"] or r["items"] for r in got)


def test_contamination_runs_no_python(spark):
    docs, items = contamination_case()
    out = decontaminate.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


# --- vector codes ----------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width: (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for c in cut:
                members[nearest(books[p], c[p])[1]].append(c[p])
            books[p] = [
                [sum(col) // len(members[i]) for col in zip(*members[i])] if i in members else e
                for i, e in enumerate(books[p])
            ]
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = collections.Counter()
    for (_, label, _), e in zip(kept, error):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{c:02x}" for _, c in f), e, by[label], digest) for (i, label, _), f, e in zip(kept, found, error)
    ]


def vector_table(spark, rows):
    return with_own_names(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "vec_id", "embedding", "label as kind"))


@pytest.mark.parametrize("entries", [3, 16, 256])
def test_codes_against_brute_force(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-6, 6, 8) / 8], int(i) % 3 or None) for i in range(150)]
    rows += [(150, rows[3][1], 1), (150, rows[3][1], 1), (None, rows[4][1], 2), (151, None, 1), (152, [None] + [1.0] * 7, 1)]
    rows += [(153, [float("nan")] * 8, 1), (154, [float("-inf")] + [0.0] * 7, 1), (155, [], 1), (156, [0.0] * 8, None)]
    rows += [(157, [-0.0005] * 8, None), (158, [200.0, -200.0] * 4, 2)]
    got, books = codes.compress_vectors(vector_table(spark, rows), entries=entries, label_col="kind")
    out = got.collect()
    want = brute_codes(rows, 4, entries, 4)
    key = lambda r: repr(r)
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out], key=key) == sorted(want, key=key)
    assert len(books) == 4 and all(len(b) == min(entries, 156) for b in books)
    assert all(r[c] == f"x_{c}" for r in out for c in OWN)


def test_codes_leave_out_what_cannot_be_coded(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 6, 1), (3, [0.5] * 12, 1), (4, [1e30] + [0.0] * 7, 1), (5, [0.25] * 8, None)]
    got, _ = codes.compress_vectors(vector_table(spark, rows), label_col="kind")
    assert sorted(r["vec_id"] for r in got.collect()) == [1, 5]
    none, books = codes.compress_vectors(vector_table(spark, rows).where("vec_id = 2"), label_col="kind")
    assert none.collect() == [] and [len(b) for b in books] == [0, 0, 0, 0]
    assert codes.compress_vectors(vector_table(spark, rows).where("false"), label_col="kind")[0].collect() == []
    with pytest.raises(ValueError):
        codes.compress_vectors(vector_table(spark, rows), entries=257)


def test_outward_search_is_exact_and_looks_at_few():
    rng = np.random.default_rng(5)
    level = rng.integers(-4000, 4000, (256, 1))
    entries = level + rng.integers(-60, 60, (256, 16))
    entries[100] = entries[7]  # a tie goes to the lower index
    parts = np.concatenate([entries[rng.integers(0, 256, 3000)] + rng.integers(-40, 40, (3000, 16)), entries])
    index, best, looked = codes.SortedBook(entries).nearest(parts)
    all_ = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == all_.min(axis=1)).all() and (index == all_.argmin(axis=1)).all()
    assert looked < 0.2 * all_.size


# --- collocations ----------------------------------------------------------------


def brute_collocations(rows, words, least, top, percent):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(zip(*(w[i:] for i in range(k))))
    out = []
    for lang, counts in f.items():
        found = []
        most = collections.Counter()
        for p, a in counts.items():
            if a >= least:
                for m in range(2, len(p)):
                    for i in range(len(p) - m + 1):
                        most[p[i: i + m]] = max(most[p[i: i + m]], a)
        for p, a in counts.items():
            if len(p) < 2 or a < least or (most[p] and 100 * most[p] >= percent * a):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def collocation_rows():
    rng = random.Random(4)
    common = [sentence(rng, 1) for _ in range(12)]
    rows = []
    for k in range(120):
        w = [rng.choice(common) for _ in range(rng.randint(0, 60))]
        for _ in range(len(w) // 6):
            w[rng.randrange(len(w))] = rng.choice(["New York City", "new york", "ÉT É", "a.b", "x,\ty", "end.\nStart", "a a a a"])
        rows.append((" ".join(w), rng.choice(["en", "en", "en", "de", None, "und", "x y"])))
    return rows + [(None, "en"), ("", None), (" \t\n.,", "fr"), ("the hot pair " * 5000, "en"), ("one", "es")]


@pytest.mark.parametrize("words,least,top,percent", [(3, 10, 2000, 50), (4, 3, 7, 80), (2, 2, 5, 0)])
def test_collocations_against_brute_force(spark, words, least, top, percent, monkeypatch):
    rows = collocation_rows()
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 20_000)
    df = with_own_names(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    got = collocations.mine_collocations(df, words, least, top, percent).collect()
    assert sorted(
        (r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got
    ) == sorted(brute_collocations(rows, words, least, top, percent))
    assert all(" ".join(r["words"]) == r["phrase"] for r in got)


def test_collocations_of_awkward_texts(spark):
    df = awkward(spark).selectExpr("text", "source as lang")
    got = collocations.mine_collocations(df, least=2).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == sorted(
        brute_collocations([(t, s) for _, t, s in awkward_rows()], 3, 2, 2000, 50))
    assert collocations.mine_collocations(df.where("false")).collect() == []
    assert collocations.mine_collocations(df.where("text is null")).collect() == []
    with pytest.raises(ValueError):
        collocations.mine_collocations(df, words=1)


def test_folding_keeps_every_prefix_sum():
    rng = np.random.default_rng(1)
    windows, n = collocations.summed(rng.integers(1, 6, (4000, 3)).astype(np.int32), rng.integers(1, 4, 4000))
    folded, m = collocations.fold(windows.copy(), n.copy(), 70)
    assert len(folded) < len(windows) and m.sum() == n.sum()

    def sums(w, c, k):
        out = collections.Counter()
        for row, x in zip(w.tolist(), c.tolist()):
            if all(row[:k]):
                out[tuple(row[:k])] += x
        return out

    assert sums(folded, m, 1) == sums(windows, n, 1)
    for k in (2, 3):
        whole = sums(windows, n, k)
        assert sums(folded, m, k) == collections.Counter({p: c for p, c in whole.items() if c >= 70})
