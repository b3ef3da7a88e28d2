"""Array kernels of quantile boosting: binning, histograms, splits, leaves.

They work on the rows of one population, or on a part of them: histograms and leaf
totals of parts add up to those of the whole, because they are counts, minima and
maxima. The gradient of the quantile loss is (y < margin) - q, so a histogram is two
counts per cell and adding up is exact.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa

ROOT = 1
NO_SPLIT_GAIN = 1e-6
# buckets per factor e of a residual's magnitude; about 0.1 % of a value wide
RESOLUTION = 1024

_SPREAD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), _SPREAD):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


def drawn(rid: np.ndarray, seed: int, t: int, share: float) -> np.ndarray:
    """Rows sampled in round t; depends on the row alone, not on where it lies."""
    salt = np.uint64((seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return _mix(rid.view(np.uint64) + salt) < np.uint64(min(int(share * 2.0**64), (1 << 64) - 1))


def column_orders(features: int, rounds: int, seed: int) -> list[list[int]]:
    """The order of the features in each round; a share takes the first of them."""
    rng, out = random.Random(seed), []
    for _ in range(rounds):
        order = list(range(features))
        rng.shuffle(order)
        out.append(order)
    return out


def shown(order: list[int], share: float) -> np.ndarray:
    return np.sort(np.array(order[: max(1, int(np.ceil(share * len(order))))]))


# --- fitted inputs ----------------------------------------------------------------


def quantile(ordered: np.ndarray, q: float) -> float:
    """Linear between the two closest ranks of ordered values."""
    at = (len(ordered) - 1) * q
    low, high = float(ordered[int(np.floor(at))]), float(ordered[int(np.ceil(at))])
    return float(low + (high - low) * (at - np.floor(at)))


@dataclass
class Inputs:
    """What is fitted on the training rows before the trees."""

    quantile: float
    shift: float  # taken off y
    fills: np.ndarray  # per numeric feature, for missing values
    codes: dict[str, float] | None  # category to its training quantile
    fallback: float
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def values(self, x: np.ndarray, category) -> np.ndarray:
        out = np.where(np.isnan(x), self.fills, x)
        if self.codes is None:
            return out
        names, index = coded(category)
        table = np.array([*[self.codes.get(n, self.fallback) for n in names], self.fallback], float)
        return np.column_stack([out, table[index]])

    def bins(self, x: np.ndarray, category) -> np.ndarray:
        """How many edges lie below each value; a missing value lies above all."""
        v = self.values(x, category)
        return np.column_stack([np.searchsorted(e, v[:, f], "left") for f, e in enumerate(self.edges)]).astype(np.int32)

    def codes_only(self) -> Inputs:
        """The same without numeric features."""
        return replace(self, fills=self.fills[:0], edges=self.edges[len(self.fills):])


def coded(category) -> tuple[list, np.ndarray]:
    """The names of an array of categories, and the place of each row's among them, -1 for none."""
    found = (category if isinstance(category, pa.Array) else pa.array(category, pa.string())).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def bin_lines(fitted: list[Inputs], x: np.ndarray, category, kind: type) -> np.ndarray:
    """A line of bins per feature and then one per code, for inputs that differ in their quantile."""
    numeric = replace(fitted[0], codes=None, edges=fitted[0].edges[: x.shape[1]])
    lines = [numeric.bins(x, None).T] if x.shape[1] else []
    lines += [found.codes_only().bins(x[:, :0], category).T for found in fitted if found.codes is not None]
    return np.concatenate([line.astype(kind) for line in lines]) if lines else np.zeros((0, len(x)), kind)


def fit_column(values: np.ndarray, bins: int, impute: bool) -> tuple[float, np.ndarray]:
    """What a missing value is taken for, and the edges of a numeric feature."""
    have, fill = np.sort(values[~np.isnan(values)]), math.nan
    if impute:
        fill = quantile(have, 0.5) if len(have) else 0.0
        missing = len(values) - len(have)
        have = np.insert(have, np.searchsorted(have, fill), np.full(missing, fill))
    return fill, np.unique([quantile(have, i / bins) for i in range(1, bins)]) if len(have) else np.zeros(0)


def fit_levels(x: np.ndarray, y: np.ndarray, category, qs: Sequence[float], bins: int, center: bool, impute: bool, encode: str) -> list[Inputs]:
    """All of it per quantile, from training rows. ``encode`` is ``codes``, ``zero`` or empty for no category."""
    shift = quantile(np.sort(y), 0.5) if center else 0.0
    y = y - shift
    numeric = [fit_column(column, bins, impute) for column in x.T]
    ordered, groups = np.sort(y), {}
    if encode == "codes":
        names, index = coded(category)
        groups = {name: np.sort(y[index == k]) for k, name in enumerate(names)}
    totals = leaf_totals(y, np.full(len(y), ROOT))
    out = []
    for q in qs:
        found = Inputs(q, shift, np.array([fill for fill, _ in numeric], float), {} if encode else None, 0.0, [edges for _, edges in numeric])
        if encode == "codes":
            found.fallback = quantile(ordered, q)
            found.codes = {name: quantile(own, q) for name, own in groups.items()}
        if encode:
            code = np.sort(found.codes_only().values(x[:, :0], category)[:, 0])
            found.edges.append(np.unique([quantile(code, i / bins) for i in range(1, bins)]))
        found.base = leaf_values(*totals, q)[ROOT]
        out.append(found)
    return out


# --- one level and one tree --------------------------------------------------------


def walk(splits: dict[int, tuple[int, int]], bins: np.ndarray) -> np.ndarray:
    """Node each row ends in: children of node i are 2i (at most b) and 2i + 1."""
    node = np.full(len(bins), ROOT, np.int64)
    for at in sorted(splits):
        f, b = splits[at]
        rows = np.flatnonzero(node == at)
        node[rows] = 2 * at + (bins[rows, f] > b)
    return node


def histogram(bins: np.ndarray, below: np.ndarray, node: np.ndarray, level: int, features: np.ndarray, width: int):
    """Rows below the margin and all rows, per node of the level, shown feature and bin."""
    nodes = 1 << level
    here = node >= nodes
    bins, below, node = bins[here][:, features], below[here], node[here] - nodes
    cell = ((node[:, None] * len(features) + np.arange(len(features))) * width + bins).ravel()
    shape, cells = (nodes, len(features), width), nodes * len(features) * width
    n = np.bincount(cell, minlength=cells).reshape(shape)
    return np.bincount(cell, np.repeat(below, len(features)), cells).astype(np.int64).reshape(shape), n


def best_splits(below: np.ndarray, n: np.ndarray, level: int, features: np.ndarray, q: float, p) -> dict[int, tuple[int, int, float]]:
    """Split with the greatest regularised gain per node, if any pays; ties to the lower feature and bin."""

    def score(g, h):
        soft = np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0)
        return soft * soft / np.maximum(h + p.reg_lambda, 1e-300)

    hl, bl = n.cumsum(axis=2), below.cumsum(axis=2)
    ht, bt = hl[:, :, -1:], bl[:, :, -1:]
    gl, gt = bl - q * hl, bt - q * ht
    least = max(float(p.min_child_weight), 1.0)
    gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    fits = (hl >= least) & (ht - hl >= least) & (gain > max(p.gamma, NO_SPLIT_GAIN))
    gain = np.where(fits, gain, -np.inf).reshape(len(n), -1)
    out = {}
    for i, at in enumerate(gain.argmax(axis=1)):
        if gain[i, at] > -np.inf:
            out[(1 << level) + i] = (int(features[at // n.shape[2]]), int(at % n.shape[2]), float(gain[i, at]))
    return out


def coarse(rest: np.ndarray) -> np.ndarray:
    """Bucket of each residual's magnitude."""
    return np.floor(np.sign(rest) * np.log1p(np.abs(rest)) * RESOLUTION).astype(np.int64)


def leaf_totals(rest: np.ndarray, node: np.ndarray):
    """Node, bucket, rows, least and greatest value of every bucket of residuals."""
    order = np.lexsort((rest, node))
    node, rest = node[order], rest[order]
    bucket = coarse(rest)
    head = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])])) if len(rest) else order
    last = np.append(head[1:], len(rest)) - 1 if len(rest) else head
    return node[head], bucket[head], np.diff(np.append(head, len(rest))), rest[head], rest[last]


def leaf_values(node, bucket, size, low, high, q: float) -> dict[int, float]:
    """Quantile of each node's residuals: exact rank, placed linearly inside its bucket.

    The totals come in order of node and bucket.
    """
    out = {}
    for at in np.unique(node):
        rows = np.flatnonzero(node == at)
        upto = np.cumsum(size[rows])
        rank = (upto[-1] - 1) * q
        i = int(np.searchsorted(upto, np.floor(rank), "right"))
        k = rows[i]
        share = min((rank - (upto[i] - size[k])) / max(size[k] - 1, 1), 1.0)
        out[int(at)] = float(low[k] + (high[k] - low[k]) * share)
    return out


# --- rows by column ------------------------------------------------------------------


CHUNK = 1 << 15  # rows worked on at a time, so that what is derived of them stays in the cache
JOINT_CELLS = 1 << 13  # cells of a count of several models at once
SAMPLE = 1 << 14  # rows that tell where a leaf's quantile lies
FAR = 1 << 40  # beyond every bucket


@dataclass
class Rows:
    """Rows of a population and fit: one line per feature, then one per code; training rows come first."""

    bins: np.ndarray
    width: int  # lines before those of the codes
    y: np.ndarray
    rid: np.ndarray
    trained: int

    def column(self, f: int, code: int, part: slice) -> np.ndarray:
        return self.bins[f if f < self.width else self.width + code, part]

    def node(self, splits: dict, code: int, part: slice) -> np.ndarray:
        """As ``walk``, a column at a time."""
        kind = np.uint8 if max(splits, default=0) < 64 else np.uint32
        node = np.full(len(self.y[part]), ROOT, kind)
        for at in sorted(splits):
            f, b = splits[at]
            # a row at the node goes from it to twice the node, or one more
            node += (node == at) * ((self.column(f, code, part) > b) + kind(at))
        return node

    def parts(self, rows: int) -> list[slice]:
        return [slice(at, min(at + CHUNK, rows)) for at in range(0, rows, CHUNK)]

    def advance(self, margin: np.ndarray, grown: tuple[dict, dict], code: int, out: np.ndarray) -> None:
        splits, leaves = grown
        for part in self.parts(len(self.y)):
            out[part] = margin[part] + lookup(leaves, self.node(splits, code, part))


def _joint(places: list[int], kinds: list[int], width: int) -> list[list[int]]:
    """Models whose kinds of rows, taken together, are few enough to be counted at once."""
    out: list[list[int]] = []
    cells = 0
    for i in places:
        if out and cells * kinds[i] <= JOINT_CELLS:
            out[-1].append(i)
            cells *= kinds[i]
        else:
            out.append([i])
            cells = width * kinds[i]
    return out


def level_counts(rows: Rows, margins: list[np.ndarray], models: list[tuple[dict, int]], level: int, features: np.ndarray,
                 width: int, seed: int, t: int, share: float) -> list[np.ndarray]:
    """Sampled rows per model: counts by shown feature, node of the level, side of the margin and bin.

    ``models`` are the splits so far and the code column of each. Models see the same
    sample and, but for the code, the same bins, so a row is counted once for several of
    them: by the combination of its nodes and sides, which is summed up apart afterwards.
    """
    nodes = 1 << level
    # a row may have stopped above the level: then it is of one more kind
    whole = [all(at in splits for at in range(nodes >> 1, nodes)) for splits, _ in models]
    kinds = [2 * nodes + (not w) for w in whole]
    joint = _joint(list(range(len(models))), kinds, width)
    lines = [[(f, c) for f in features.tolist() for c in (sorted({models[i][1] for i in own}) if f >= rows.width else [0])] for own in joint]
    counts = [np.zeros((len(lines[g]), int(np.prod([kinds[i] for i in own])) * width), np.int64) for g, own in enumerate(joint)]
    for part in rows.parts(rows.trained):
        sample = np.flatnonzero(drawn(rows.rid[part], seed, t, share))
        y, columns = rows.y[part], {}
        for g, own in enumerate(joint):
            cells = counts[g].shape[1]
            kind = np.uint8 if cells // width <= 256 else np.uint32
            of = np.zeros(len(y), kind)
            for i in own:
                splits, code = models[i]
                place = (y < margins[i][part]).view(np.uint8).astype(kind, copy=False)
                if level:
                    node = rows.node(splits, code, part).astype(kind, copy=False)
                    place = (node - kind(nodes)) * kind(2) + place
                    if not whole[i]:
                        place[node < nodes] = kinds[i] - 1
                of = of * kind(kinds[i]) + place
            first = of[sample].astype(np.uint16 if cells < 1 << 16 else np.int64) * (np.uint16 if cells < 1 << 16 else np.int64)(width)
            for n, line in enumerate(lines[g]):
                if line not in columns:
                    columns[line] = rows.column(*line, part)[sample]
                counts[g][n] += np.bincount(first + columns[line], minlength=cells)
    out: list = [None] * len(models)
    for g, own in enumerate(joint):
        shape = [kinds[i] for i in own]
        cube = counts[g].reshape(len(lines[g]), *shape, width)
        for k, i in enumerate(own):
            mine = [n for n, (f, c) in enumerate(lines[g]) if f < rows.width or c == models[i][1]]
            summed = cube[mine].sum(axis=tuple(1 + j for j in range(len(own)) if j != k))
            out[i] = summed[:, : 2 * nodes].reshape(len(features), nodes, 2, width)
    return out


def _edge(bucket: int) -> float:
    """The least value of a bucket, up to rounding."""
    return math.copysign(math.expm1(min(abs(bucket) / RESOLUTION, 700.0)), bucket)


def _span(lo: int, hi: int) -> tuple[float, float]:
    """Values around buckets [lo, hi): none of theirs lies outside."""
    low, high = (-math.inf if lo <= -FAR else _edge(lo)), (math.inf if hi >= FAR else _edge(hi))
    slack = lambda v: 0.0 if math.isinf(v) else abs(v) * 1e-9 + 1e-12
    return low - slack(low), high + slack(high)


def tell_leaves(rows: Rows, margin: np.ndarray, splits: dict, code: int, q: float, wanted: dict | None = None) -> list[tuple]:
    """Per leaf with training rows: leaf, buckets [lo, hi), rows below and above them, and totals of each bucket inside.

    The buckets lie around the quantile of the rows here, found on some of them; or they
    are those ``wanted`` of a leaf, and other leaves are left out.
    """
    n = rows.trained
    some = slice(0, n, max(1, n // SAMPLE))
    rest, node = rows.y[some] - margin[some], rows.node(splits, code, some)
    leaves = [at for up in splits for at in (2 * up, 2 * up + 1) if at not in splits] or [ROOT]
    size = max(leaves) + 1
    low, high, held = np.full(size, np.inf), np.full(size, np.inf), {}
    for leaf in sorted(leaves):
        if wanted is not None:
            if leaf not in wanted:
                continue
            lo, hi = wanted[leaf]
        else:
            own = np.sort(rest[node == leaf])
            at, wide = (len(own) - 1) * q, 8 * math.sqrt(q * (1 - q) * len(own)) + 8
            lo = int(coarse(own[int(at - wide)])) if len(own) > 64 and at - wide >= 0 else -FAR
            hi = int(coarse(own[math.ceil(at + wide)])) + 1 if len(own) > 64 and at + wide <= len(own) - 1 else FAR
        held[leaf] = lo, hi
        low[leaf], high[leaf] = _span(lo, hi)
    counts, inside = np.zeros(3 * size, np.int64), []
    for part in rows.parts(n):
        rest, node = rows.y[part] - margin[part], rows.node(splits, code, part)
        place = (rest >= low[node]).view(np.uint8) + (rest > high[node])
        counts += np.bincount(node.astype(np.uint32) * 3 + place, minlength=3 * size)
        near = np.flatnonzero(place == 1)
        inside.append((node[near], rest[near]))
    node, rest = (np.concatenate([x[i] for x in inside]) if inside else np.zeros(0) for i in (0, 1))
    told = []
    for leaf, (lo, hi) in held.items():
        if not counts[3 * leaf : 3 * leaf + 3].any():
            continue
        own = rest[node == leaf]
        bucket = coarse(own)
        here = (bucket >= lo) & (bucket < hi)
        told.append((leaf, lo, hi, int(counts[3 * leaf] + (bucket < lo).sum()), int(counts[3 * leaf + 2] + (bucket >= hi).sum()),
                     leaf_totals(own[here], np.zeros(int(here.sum()), np.int64))[1:]))
    return told


def choose_leaf(parts: list[tuple], q: float) -> float | None:
    """The leaf's value from what all tasks told of it, or None where none is sure."""
    lo, hi = max(p[0] for p in parts), min(p[1] for p in parts)
    bucket, size, low, high = (np.concatenate([p[4][i] for p in parts]) for i in range(4))
    order = np.argsort(bucket, kind="stable")
    bucket, size, low, high = bucket[order], size[order], low[order], high[order]
    if len(bucket):
        head = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        bucket, size = bucket[head], np.add.reduceat(size, head)
        low, high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
    before, after = sum(p[2] for p in parts), sum(p[3] for p in parts)
    rank = (before + after + int(size.sum()) - 1) * q
    i = int(np.searchsorted(before + np.cumsum(size), np.floor(rank), "right"))
    # a bucket is whole where every task has told it
    if not (np.floor(rank) >= before and i < len(bucket) and lo <= bucket[i] < hi):
        return None
    start = before + int(size[:i].sum())
    share = min((rank - start) / max(int(size[i]) - 1, 1), 1.0)
    return float(low[i] + (high[i] - low[i]) * share)


def grow_rows(rows: Rows, margins: list[np.ndarray], levels: list[tuple[float, int]], p, seed: int, width: int, columns: int):
    """All trees of the models of some rows, all of which are here: (trees, gains) per model.

    ``levels`` has the quantile and the code column of each; margins are brought up to the last tree.
    A tree is (splits, leaves): node to (feature, bin), node to value.
    """
    grown, gains = [[] for _ in levels], [[] for _ in levels]
    for t, order in enumerate(column_orders(columns, p.n_estimators, seed)):
        features = shown(order, p.colsample_bytree)
        splits: list[dict] = [{} for _ in levels]
        open_ = list(range(len(levels)))
        for level in range(p.max_depth):
            found = level_counts(rows, [margins[i] for i in open_], [(splits[i], levels[i][1]) for i in open_], level, features,
                                 width, seed, t, p.subsample) if open_ else []
            still = []
            for i, counts in zip(open_, found):
                above, below = counts.transpose(2, 1, 0, 3)
                best = best_splits(below, above + below, level, features, levels[i][0], p)
                splits[i] |= {at: (f, b) for at, (f, b, _) in best.items()}
                gains[i] += [(f, gain) for f, _, gain in best.values()]
                still += [i] if best else []
            open_ = still
        for i, (q, code) in enumerate(levels):
            wanted, leaves = None, {}
            while wanted is None or wanted:
                told = tell_leaves(rows, margins[i], splits[i], code, q, wanted)
                value = {leaf: choose_leaf([rest], q) for leaf, *rest in told}
                leaves |= {at: v * p.learning_rate for at, v in value.items() if v is not None}
                wanted = {at: (-FAR, FAR) for at, v in value.items() if v is None}
            grown[i].append((splits[i], dict(sorted(leaves.items()))))
            rows.advance(margins[i], grown[i][-1], code, margins[i])
    return grown, gains


def grow(bins: np.ndarray, y: np.ndarray, train: np.ndarray, rid: np.ndarray, base: float, q: float, p, seed: int, width: int):
    """All trees of one population whose rows are here: (trees, gains, margin of every row)."""
    order = np.argsort(~train, kind="stable")
    kind = np.uint8 if width <= 256 else np.uint16
    rows = Rows(np.ascontiguousarray(bins[order].T.astype(kind)), bins.shape[1], y[order], rid[order], int(train.sum()))
    margin = np.full(len(y), base)
    (grown,), (gains,) = grow_rows(rows, [margin], [(q, 0)], p, seed, width, bins.shape[1])
    out = np.empty(len(y))
    out[order] = margin
    return grown, gains, out


def lookup(leaves: dict[int, float], node: np.ndarray) -> np.ndarray:
    table = np.zeros(max([*leaves, int(node.max(initial=0))], default=0) + 1)
    table[list(leaves)] = list(leaves.values())
    return table[node]
