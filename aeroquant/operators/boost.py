"""Quantile regression by boosted trees, for many populations at once.

A population is one value of the key columns, such as route and tier; each of its
rows may take part in several fits (folds, holdout, production), and each fit is
trained for several quantiles and candidates. The stored rows are one copy per
population: fits, quantiles and candidates are memberships, not copies.

Populations of at most ``LOCAL_ROWS`` rows, counted first, are trained where they are
grouped, all of them in one Spark job. The rows of a larger population are binned once
and packed into blocks that spread over all tasks: each task adds its rows into
histograms, Spark sums them, and only the chosen splits come back. That takes one job
per level and one for the leaves, whatever the number of populations in the wave, fits,
quantiles and candidates; a leaf whose value no task had near its own takes one more.
Since histograms are counts, both ways grow the same trees.

Edges, medians and codes come from a fit's own training rows alone, so no row of
another split or fold can move them.
"""

from __future__ import annotations

import json
import math
import os
import pickle
import random
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from aeroquant.operators import trees
from aeroquant.operators.quantiles import bucket_quantiles, exact_quantiles, melt, present_values, ranked_values
from aeroquant.operators.split import join_populations
from aeroquant.operators.trees import ROOT
from aeroquant.session import cut_lineage, settle

MOST_BINS = 64
LOCAL_ROWS = 20_000  # rows of a population that one task may hold
COLUMN_ROWS = 1 << 24  # rows of a population of which one task may hold a single column
TASK_ROWS = 1 << 21  # rows of a population that one task may hold once they are bins
WAVE_CELLS = 1 << 25  # histogram cells of a wave of large populations; a task holds those of one model at a time
SENT_TREES = 200_000  # trees, of all models together, that may be sent to every task
CUT_EVERY = 20  # rounds after which trees are broadcast; newer ones go with every job

_TREES = "array<struct<splits:map<int,struct<f:int,b:int>>,leaves:map<int,double>>>"
# what a fit yields: a row with its trees, or a row's predictions per candidate
OUTCOME = (
    "candidate int, shift double, n_train long, fills array<double>, codes map<string,double>, fallback double, "
    f"base double, edges array<array<double>>, trees {_TREES}, gains array<struct<f:int,gain:double>>, "
    "row long, role string, y double, prediction array<double>"
)


@dataclass(frozen=True)
class Params:
    """Boosting parameters with their defaults (fixed values)."""

    n_estimators: int = 200
    learning_rate: float = 0.015
    max_depth: int = 2
    min_child_weight: float = 1
    subsample: float = 0.5
    colsample_bytree: float = 0.4
    reg_alpha: float = 10.0
    reg_lambda: float = 10.0
    gamma: float = 0.0


# search ranges: (kind, low, high) per parameter (fixed values)
SEARCH = {
    "n_estimators": ("int", 100, 600),
    "learning_rate": ("log", 0.005, 0.08),
    "max_depth": ("int", 2, 6),
    "min_child_weight": ("int", 1, 15),
    "subsample": ("float", 0.5, 1.0),
    "colsample_bytree": ("float", 0.4, 1.0),
    "reg_alpha": ("log", 0.01, 30.0),
    "reg_lambda": ("log", 0.1, 50.0),
    "gamma": ("float", 0.0, 10.0),
}


def sample_candidates(n: int, seed: int = 42) -> list[Params]:
    """Seeded random points of the search space."""
    rng = random.Random(seed)

    def draw(kind, low, high):
        if kind == "int":
            return rng.randint(low, high)
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [Params(**{name: draw(*spec) for name, spec in SEARCH.items()}) for _ in range(n)]


def bin_edges(df: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int) -> DataFrame:
    """Distinct inner edges per population: keys and ``edges``, one array per feature.

    Exact quantiles, so always the same. A feature without values has no edges.
    """
    shares = [i / bins for i in range(1, bins)]
    found = exact_quantiles(melt(df, keys, features), [*keys, "column"], "value", shares)
    entry = F.struct("column", F.array_sort(F.array_distinct("q")).alias("cuts"))
    per_column = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # one entry per feature
    none = F.array().cast("array<double>")
    cuts = [F.coalesce(F.try_element_at("m", F.lit(c)), none) for c in features]
    return per_column.select(*keys, F.array(*cuts).alias("edges"))


def add_bins(df: DataFrame, features: Sequence[str], bins: int = MOST_BINS, name: str = "bins") -> DataFrame:
    """Array of bin numbers: how many of the row's ``edges`` lie below each value.

    A missing value lies above all edges.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((bins - 1).bit_length()))])

    def below(value, cuts):  # binary search
        hop = lambda at, step: F.when(F.try_element_at(cuts, at + step) < value, at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), hop).cast("short")

    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    no_edges = F.array().cast("array<array<double>>")
    return df.withColumn(name, F.zip_with(values, F.coalesce("edges", no_edges), below))


def walk(tree_splits: Column, bins: Column, depth: int) -> Column:
    """Node a row ends in: children of node i are 2i (at most b) and 2i + 1."""

    def step(node, _):
        at = F.try_element_at(tree_splits, node)
        right = (F.element_at(bins, at["f"] + 1) > at["b"]).cast("int")
        return F.when(at.isNull(), node).otherwise(node * 2 + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(ROOT), step)


def ensemble_value(trees: Column, bins: Column, depth: int) -> Column:
    """Sum of the leaf values of all trees."""

    def add(total, tree):
        leaf = F.try_element_at(tree["leaves"], walk(tree["splits"], bins, depth))
        return total + F.coalesce(leaf, F.lit(0.0))

    return F.aggregate(trees, F.lit(0.0), add)


def _scorer(model) -> tuple:
    edges = [np.array(e, float) for e in model["edges"] or []]
    grown = [({at: (v["f"], v["b"]) for at, v in t["splits"].items()}, dict(t["leaves"])) for t in model["trees"]]
    return model["base"], edges, grown


def _predict(sent, keys: list[str], features: list[str], name: str, names: list[str]):
    """Add each row's prediction by the model of its population."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            of = list(zip(*[table.column(k).to_pylist() for k in keys])) if keys else [()] * table.num_rows
            x = np.column_stack([
                table.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for f in features
            ]) if features else np.zeros((table.num_rows, 0))
            number = {k: i for i, k in enumerate(dict.fromkeys(of))}
            which = np.array([number[k] for k in of], np.int64)
            value, known = np.zeros(len(of)), np.zeros(len(of), bool)
            for key, i in number.items():
                if key in sent.value:
                    base, edges, grown = sent.value[key]
                    rows = np.flatnonzero(which == i)
                    bins = np.column_stack([np.searchsorted(e, x[rows, f], "left") for f, e in enumerate(edges)])
                    total = np.full(len(rows), float(base))
                    for splits, leaves in grown:
                        total += trees.lookup(leaves, trees.walk(splits, bins))
                    value[rows], known[rows] = total, True
            made = pa.array(value, mask=~known)
            yield pa.RecordBatch.from_arrays(
                [made if n == name else table.column(n).combine_chunks() for n in names], names)

    return run


@dataclass
class BoostedModel:
    """Fitted trees per population.

    ``models`` has the keys, ``base``, ``edges`` and ``trees``; importance sums gains.
    """

    keys: list[str]
    features: list[str]
    bins: int
    depth: int
    models: DataFrame
    gains: DataFrame | None = None
    scored: DataFrame | None = field(default=None, repr=False)

    @staticmethod
    def of(done: DataFrame, keys: list[str], features: list[str], bins: int, depth: int) -> BoostedModel:
        """The models among the outcomes of a ``Trainer``."""
        made = done.where(F.col("trees").isNotNull())
        gains = made.select(*keys, F.inline("gains"))
        return BoostedModel(keys, features, bins, depth, made.select(*keys, "base", "edges", "trees"), gains)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Score rows whose features are complete; unknown populations get null.

        Models of a counted, bounded size travel to the tasks and score whole batches;
        more of them are joined to the rows and walked tree by tree in expressions.
        """
        models = self.models.select(*self.keys, "base", "edges", "trees")
        size = models.agg(F.sum(F.size("trees"))).first()[0] or 0
        if size <= SENT_TREES:
            held = {tuple(r[k] for k in self.keys): _scorer(r) for r in models.collect()}
            sent = df.sparkSession.sparkContext.broadcast(held)
            schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
            return df.mapInArrow(_predict(sent, list(self.keys), list(self.features), name, schema.names), schema)
        joined = df.join(models, self.keys, "left")
        binned = add_bins(joined, self.features, self.bins, "_bins")
        value = F.col("base") + ensemble_value(F.col("trees"), F.col("_bins"), self.depth)
        return binned.withColumn(name, value).drop("base", "edges", "trees", "_bins")

    def feature_importance(self) -> DataFrame:
        """Average gain per split and feature, as shares of one per population."""
        names = F.array(*[F.lit(c) for c in self.features])
        mean = self.gains.groupBy(*self.keys, "f").agg(F.avg("gain").alias("mean_gain"))
        total = F.sum("mean_gain").over(Window.partitionBy(*self.keys))
        return mean.select(*self.keys, F.element_at(names, F.col("f") + 1).alias("feature"),
                           (F.col("mean_gain") / total).alias("importance"))

    def save(self, path: str) -> None:
        self.models.write.mode("overwrite").parquet(f"{path}/models")
        spark = self.models.sparkSession
        meta = [(self.keys, self.features, self.bins, self.depth)]
        spark.createDataFrame(meta, "keys array<string>, features array<string>, bins int, depth int").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/meta")
        if self.gains is not None:
            self.gains.write.mode("overwrite").parquet(f"{path}/gains")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        m = spark.read.parquet(f"{path}/meta").first()
        return BoostedModel(list(m["keys"]), list(m["features"]), m["bins"], m["depth"],
                            spark.read.parquet(f"{path}/models"), spark.read.parquet(f"{path}/gains"))


# --- populations that one task may hold ---------------------------------------------


def _outcome(table: pa.Table, schema: pa.Schema, keys: Sequence[str], rows: list[dict]) -> pa.Table:
    first = {k: table.column(k)[0].as_py() for k in keys}
    return pa.Table.from_pylist([first | r for r in rows], schema=schema)


def _model_row(found: trees.Inputs, n_train: int, candidate: int | None, grown, gains) -> dict:
    return {
        "candidate": candidate, "shift": found.shift, "n_train": n_train, "fills": found.fills.tolist(),
        "codes": None if found.codes is None else list(found.codes.items()), "fallback": found.fallback,
        "base": found.base, "edges": [e.tolist() for e in found.edges],
        "trees": [
            {"splits": [(at, {"f": f, "b": b}) for at, (f, b) in splits.items()], "leaves": list(leaves.items())}
            for splits, leaves in grown
        ],
        "gains": [{"f": f, "gain": g} for f, g in gains],
    }


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Features by row, y, category and the row's hash."""
    x = table.column("x").combine_chunks()
    wide = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
    category = table.column("category").combine_chunks()
    return wide, table.column("y").to_numpy().astype(float), category, table.column("rid").to_numpy()


def _local(keys: list[str], schema: pa.Schema, candidates: list[Params], tuned: bool, levels: Sequence[float] | None, bins: int,
           seed: int, center: bool, impute: bool, roles: tuple[str, ...]):
    """Train one fit of one population, all of whose rows are here, for its quantiles."""

    def run(table: pa.Table) -> pa.Table:
        # the order of rows must not matter
        table = table.append_column("_late", pc.not_equal(table.column("role").fill_null(""), "train"))
        table = table.sort_by([("_late", "ascending"), ("rid", "ascending"), ("y", "ascending"), ("role", "ascending")])
        x, y, category, rid = _columns(table)
        role = np.array(table.column("role").to_pylist(), object)
        n = int((role == "train").sum())
        if not n:
            return _outcome(table, schema, keys, [])
        encode, picks, unit = (table.column(c)[0].as_py() for c in ("encode", "chosen", "unit"))
        qs = [float(q) for q in levels] if levels else [table.column("quantile")[0].as_py()]
        if picks is not None:
            qs = [q for q in qs if q in dict(picks)]
        fitted = trees.fit_levels(x[:n], y[:n], category[:n], qs, bins, center, impute, encode)
        shift = fitted[0].shift if fitted else 0.0
        rows = trees.Rows(trees.bin_lines(fitted, x, category, _bin_type(bins)), x.shape[1], y - shift, rid, n) if fitted else None
        # a model each; without a pick, those of the unit's candidate or of all
        tried = range(len(candidates)) if unit is None else [unit]
        wanted = [(i, dict(picks)[q]) for i, q in enumerate(qs)] if picks is not None else [(i, c) for i in range(len(qs)) for c in tried]
        out, margins = [], {}
        for c in dict.fromkeys(c for _, c in wanted):
            own = [i for i, other in wanted if other == c]
            grown_margins = [np.full(len(y), fitted[i].base) for i in own]
            grown = trees.grow_rows(rows, grown_margins, [(fitted[i].quantile, i) for i in own], candidates[c], seed, bins + 1, len(fitted[0].edges))
            for i, margin, made, gains in zip(own, grown_margins, *grown):
                out.append(_model_row(fitted[i], n, c if tuned else None, made, gains) | {"quantile": qs[i]})
                margins[i, c] = margin
        told = np.flatnonzero(np.isin(role, roles))
        parts = [_outcome(table, schema, keys, out)]
        for i, q in enumerate(qs):
            places = [dict(picks)[q]] if picks is not None else range(len(candidates))
            flat = np.column_stack([margins[i, c][told] if (i, c) in margins else np.zeros(len(told)) for c in places]).ravel()
            empty = np.tile([(i, c) not in margins for c in places], len(told))
            ends = pa.array(np.arange(len(told) + 1, dtype=np.int32) * len(places), pa.int32())
            given = {"row": table.column("row").take(told), "role": pa.array(role[told], pa.string()), "y": pa.array(rows.y[told]),
                     "prediction": pa.ListArray.from_arrays(ends, pa.array(flat, mask=empty)), "quantile": pa.array([q] * len(told), pa.float64())}
            given |= {k: table.column(k).take(told) for k in keys if k not in given}
            parts.append(pa.Table.from_arrays(
                [given[f.name].cast(f.type) if f.name in given else pa.nulls(len(told), f.type) for f in schema], schema=schema))
        return pa.concat_tables(parts)

    return run


# --- populations that spread over the tasks ------------------------------------------


@dataclass
class Member:
    """One fit, quantile and candidate of a large population."""

    fit: str | None
    inputs: trees.Inputs
    n_train: int
    candidate: int
    code: int = 0  # which code column of the fit's rows is that of the quantile
    grown: list = field(default_factory=list)
    gains: list = field(default_factory=list)
    splits: dict = field(default_factory=dict)


@dataclass(frozen=True)
class _Turn:
    """What a task needs of a member for one job."""

    number: int  # among the members of the population
    at: int  # among those of the fit: the row of its margins
    params: Params
    quantile: float
    code: int
    splits: dict
    recent: list  # trees from ``since`` on
    base: float = 0.0
    since: int = 0
    past: Broadcast | None = None  # the trees before, of all members
    candidate: int = 0


Turns = dict[tuple[int, str], list[_Turn]]


def _turns(wave: dict[int, list[Member]], candidates: list[Params], since: int = 0, past: Broadcast | None = None) -> Turns:
    """The members by population and fit; their order is that of the margins."""
    out: Turns = {}
    for pop, ms in wave.items():
        for c, m in enumerate(ms):
            own = out.setdefault((pop, m.fit or ""), [])
            own.append(_Turn(c, len(own), candidates[m.candidate], m.inputs.quantile, m.code, m.splits, m.grown[since:],
                             m.inputs.base, since, past, m.candidate))
    return out


# Rows of one population and fit, packed by columns: bins are one byte each, feature by
# feature, then one code column per quantile; margins are one line per member, or empty at the start.
BLOCK_ROWS = 1 << 14
HELD_ROWS = 1 << 19  # rows a task packs before it lets go of them
PART_BYTES = 256 << 20  # blocks of a task
LEAF_BYTES = 1 << 14  # about what a task tells of a leaf
SENT_BYTES = 64 << 20  # counts that the driver may add up itself; beyond that Spark shuffles them
_BLOCK = "_pop int, fit string, n int, rid binary, y binary, role binary, bins binary, margins binary, row binary"
_USED = ["_pop", "fit", "n", "rid", "y", "role", "bins", "margins", "row"]
_TOLD = "_pop int, fit string, row long, role string, y double, margins array<double>"
_TOLD_NAMES = ["_pop", "fit", "row", "role", "y", "margins"]


def _roles(told: Sequence[str]) -> list[str]:
    """The roles of rows that are kept, as numbered in blocks: the first are trained, the rest only told."""
    return ["train", *[r for r in told if r != "train"]]


def _bin_type(bins: int) -> type:
    return np.uint8 if bins < 256 else np.uint16


class _Block:
    """The rows of one population and fit that a task holds, training rows first."""

    def __init__(self, rows: trees.Rows, role: np.ndarray, row: np.ndarray, margins: np.ndarray | None):
        self.rows, self.role, self.row, self.margins = rows, role, row, margins

    @staticmethod
    def of(parts: list[dict], width: int, kind: type) -> _Block:
        def joined(name: str, dtype) -> np.ndarray:
            return np.concatenate([np.frombuffer(p[name], dtype).reshape(-1, p["n"]) for p in parts], axis=1)

        role = joined("role", np.uint8)[0]
        order = np.argsort(role > 0, kind="stable")
        rows = trees.Rows(np.take(joined("bins", kind), order, axis=1), width, joined("y", float)[0][order],
                          joined("rid", np.int64)[0][order], int((role == 0).sum()))
        stored = all(len(p["margins"]) for p in parts)
        return _Block(rows, role[order], joined("row", np.int64)[0][order], joined("margins", float)[:, order] if stored else None)

    def margin(self, turn: _Turn) -> np.ndarray:
        """The margin of a member: as it is held, or of no tree."""
        return np.full(len(self.rows.y), turn.base) if self.margins is None else self.margins[turn.at]

    def told(self, key: tuple[int, str], roles: tuple[str, ...], margins: Sequence[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        """The rows that are asked for with their margins, which are null where another task has them."""
        names = np.array(_roles(roles), object)
        wanted = np.flatnonzero(np.isin(names, roles)[self.role])
        for at in range(0, len(wanted), BLOCK_ROWS):
            rows = wanted[at : at + BLOCK_ROWS]
            flat = np.column_stack([np.zeros(len(rows)) if m is None else m[rows] for m in margins]).ravel()
            empty = np.tile([m is None for m in margins], len(rows))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(margins), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0]] * len(rows), pa.int32()), pa.array([key[1] or None] * len(rows), pa.string()),
                pa.array(self.row[rows]), pa.array(names[self.role[rows]], pa.string()), pa.array(self.rows.y[rows]),
                pa.ListArray.from_arrays(ends, pa.array(flat, mask=empty)),
            ], _TOLD_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, kind: type) -> Iterator[tuple[tuple[int, str], _Block]]:
    """All blocks of a task, which are of a bounded size, by population and fit."""
    parts: dict[tuple[int, str], list[dict]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            part = {n: batch.column(n)[i] for n in _USED}
            part = {n: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for n, v in part.items()}
            parts.setdefault((part["_pop"], part["fit"]), []).append(part)
    for key in list(parts):
        yield key, _Block.of(parts.pop(key), width, kind)


def _pack(wave: dict[int, list[Member]], width: int, kind: type, roles: list[str]):
    """Rows to blocks: binned once by the inputs of each fit they are in."""
    number = {role: i for i, role in enumerate(roles)}
    absent = len(roles)
    fits: dict[int, dict[str, list[Member]]] = {}
    for pop, ms in wave.items():
        for m in ms:
            fits.setdefault(pop, {}).setdefault(m.fit or "", []).append(m)

    def bins(ms: list[Member], x: np.ndarray, category: pa.Array) -> np.ndarray:
        by_code = {m.code: m.inputs for m in ms}
        return trees.bin_lines([found for _, found in sorted(by_code.items())], x, category, kind)

    def block(pop: int, fit: str, parts: list[tuple]) -> list:
        rid, y, role, row = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3))
        return [pop, fit, len(y), *[a.tobytes() for a in (rid, y, role)], np.concatenate([p[4] for p in parts], axis=1).tobytes(),
                b"", row.tobytes()]

    schema = to_arrow_schema(T._parse_datatype_string(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[tuple]] = {}
        total = 0

        def out(keys: list) -> pa.RecordBatch:
            made = [block(*k, held.pop(k)) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for pop in whole.column("_pop").unique().to_pylist():
                table = whole.filter(pc.equal(whole.column("_pop"), pop))
                x, y, category, rid = _columns(table)
                row = table.column("row").to_numpy()
                # rows in the same fits are told by one text
                told = table.column("told").combine_chunks().dictionary_encode()
                named = [{f.get("fit", ""): number.get(f.get("role"), absent) for f in json.loads(text)} for text in told.dictionary.to_pylist()]
                which = told.indices.to_numpy(zero_copy_only=False)
                for fit, ms in fits.get(pop, {}).items():
                    role = np.array([n.get(fit, absent) for n in named], np.uint8)[which]
                    rows = np.flatnonzero(role < absent)
                    if not len(rows):
                        continue
                    own = (rid[rows], y[rows] - ms[0].inputs.shift, role[rows], row[rows], bins(ms, x[rows], category.take(rows)))
                    held.setdefault((pop, fit), []).append(own)
                    total += len(rows)
                    if sum(len(p[1]) for p in held[pop, fit]) >= BLOCK_ROWS:
                        total -= sum(len(p[1]) for p in held[pop, fit])
                        yield out([(pop, fit)])
            if total >= HELD_ROWS:
                yield out(list(held))
                total = 0
        if held:
            yield out(list(held))

    return run


_PART = "_pop int, member int, part binary"


def _part_batch(pop: int, member: int, part: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pop], pa.int32()), pa.array([member], pa.int32()), pa.array([part], pa.binary())],
                                      ["_pop", "member", "part"])


# --- populations that one task may hold once their rows are bins ---


def _grow_here(turns: Turns, members: int, bins: int, width: int, columns: int, seed: int, roles: tuple[str, ...]):
    """Train a unit, the members of one candidate of a population and fit, all of whose rows are here."""
    schema = to_arrow_schema(T._parse_datatype_string(_GROWN))

    def run(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        ((key, block),) = _blocks(iter(table.to_batches()), width, _bin_type(bins))
        own = turns[key]
        mine = [turn for turn in own if turn.candidate == unit]
        margins = {turn.at: block.margin(turn) for turn in mine}
        grown, gains = [[] for _ in mine], [[] for _ in mine]
        if block.rows.trained:
            grown, gains = trees.grow_rows(block.rows, list(margins.values()), [(turn.quantile, turn.code) for turn in mine],
                                           mine[0].params, seed, bins + 1, columns)
        out = [pa.table({"_pop": pa.array([key[0]], pa.int32()), "member": pa.array([turn.number], pa.int32()),
                         "grown": pa.array([pickle.dumps(made)], pa.binary())}) for turn, made in zip(mine, zip(grown, gains))]
        out += [pa.Table.from_batches([b]) for b in block.told(key, roles, [margins.get(turn.at) for turn in own])]
        filled = [pa.Table.from_arrays([t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema],
                                       schema=schema) for t in out]
        return pa.concat_tables(filled)

    return run


_GROWN = _TOLD + ", member int, grown binary"


def _train_units(packed: DataFrame, wave: dict[int, list[Member]], candidates: list[Params], numeric: int, bins: int, seed: int,
                 columns: int, told: tuple[str, ...]) -> DataFrame:
    """Grow all trees of populations of a bounded size, a unit per task; returns the rows asked for with their margins."""
    spark = packed.sparkSession
    turns = _turns(wave, candidates)
    sizes = {(r["_pop"], r["fit"]): r["n"] for r in packed.groupBy("_pop", "fit").agg(F.sum("n").alias("n")).collect()}  # one row per fit
    cost = {(key, c): n * candidates[c].n_estimators * candidates[c].max_depth for key, n in sizes.items() for c in {t.candidate for t in turns[key]}}
    units = [(*key, c, i) for i, (key, c) in enumerate(sorted(cost, key=lambda u: (-cost[u], u)))]  # the longest begin first
    if not units:
        return spark.createDataFrame([], _TOLD)
    dealt = packed.join(F.broadcast(spark.createDataFrame(units, "_pop int, fit string, unit int, place int")), ["_pop", "fit"])
    run = _grow_here(turns, max(map(len, wave.values())), bins, numeric, columns, seed, told)
    done = cut_lineage(dealt.repartitionByRange(len(units), "place").groupBy("place").applyInArrow(run, _GROWN))
    for r in done.where("member is not null").select("_pop", "member", "grown").collect():  # one row per member
        m = wave[r["_pop"]][r["member"]]
        m.grown, m.gains = pickle.loads(r["grown"])
    return done.where("member is null").drop("member", "grown")


# --- populations that only all tasks together hold ---


class LostRows(Exception):
    """The rows a task has laid down are not where the task runs now."""


def _folder() -> str:
    """A new folder of this executor, among those Spark removes when the executor ends."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.mkdtemp(prefix="aeroquant-", dir=local if os.path.isdir(local) else None)


def _hold(turns: Turns, bins: int, width: int):
    """Lay the blocks of a task down as arrays, with the margins of no tree; yields their folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys = _folder(), []
        for g, (key, block) in enumerate(_blocks(batches, width, _bin_type(bins))):
            rows = block.rows
            for name, values in (("bins", rows.bins), ("y", rows.y), ("rid", rows.rid), ("role", block.role), ("row", block.row)):
                np.save(f"{place}/{g}-{name}.npy", values)
            np.save(f"{place}/{g}-margins0.npy", np.array([block.margin(turn) for turn in turns[key]]))
            keys.append([*key, rows.trained])
        with open(f"{place}/about", "w") as file:
            json.dump({"keys": keys, "width": width}, file)
        _stamp(place, 0)
        yield pa.RecordBatch.from_arrays([pa.array([place])], ["place"])

    return run


def _stamp(place: str, t: int) -> None:
    with open(name := f"{place}/stamp-{uuid.uuid4().hex}", "w") as file:
        file.write(str(t))
    os.replace(name, f"{place}/stamp")


def _held(place: str, turns: Turns, t: int) -> Iterator[tuple[tuple[int, str], _Block]]:
    """The blocks laid down in a folder, with their margins before round t.

    Margins lie in two slots, of this round and of the one before, so that a task that runs
    again finds what it began with. Trees grown since the margins were brought up are applied first.
    """
    try:
        with open(f"{place}/about") as file:
            about = json.load(file)
        with open(f"{place}/stamp") as file:
            at = int(file.read())
    except FileNotFoundError as error:
        raise LostRows(place) from error
    if at > t + 1:
        raise LostRows(f"{place} is at round {at}, not {t}")
    read = lambda g, name: np.load(f"{place}/{g}-{name}.npy", mmap_mode="r")
    blocks = []
    for g, (pop, fit, trained) in enumerate(about["keys"]):
        rows = trees.Rows(read(g, "bins"), about["width"], read(g, "y"), read(g, "rid"), trained)
        blocks.append(((pop, fit), _Block(rows, read(g, "role"), read(g, "row"), None)))
    if at < t:
        for g, (key, block) in enumerate(blocks):
            old = read(g, f"margins{at % 2}")
            name = f"{place}/{g}-margins{t % 2}.npy"
            # a slot is written in place, by the same values if a task runs twice
            new = np.lib.format.open_memmap(name, "r+" if os.path.exists(name) else "w+", old.dtype, old.shape)
            for turn in turns[key]:
                before = turn.past.value.get((key[0], turn.number), []) if turn.since > at else []
                grown = before[at:] + turn.recent[max(at - turn.since, 0) : t - turn.since]
                margin = old[turn.at]
                for tree in grown:
                    block.rows.advance(margin, tree, turn.code, new[turn.at])
                    margin = new[turn.at]
                if not grown:
                    new[turn.at] = margin
            del new
        _stamp(place, t)
    for g, (key, block) in enumerate(blocks):
        block.margins = read(g, f"margins{t % 2}")
        yield key, block


def _of_task(batches: Iterator[pa.RecordBatch], turns: Turns, t: int, bins: int, width: int) -> Iterator[tuple[tuple[int, str], _Block]]:
    """The blocks of a task: those it is given, or those laid down in the folders it is given."""
    for first in batches:
        if "place" not in first.schema.names:
            yield from _blocks(chain([first], batches), width, _bin_type(bins))
            return
        for place in first.column("place").to_pylist():
            yield from _held(place, turns, t)


def _add_histograms(turns: Turns, t: int, level: int, order: list[int], bins: int, width: int, seed: int):
    """Per task and member the counts of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _of_task(batches, turns, t, bins, width):
            for params in dict.fromkeys(turn.params for turn in turns[key]):
                own = [turn for turn in turns[key] if turn.params == params and (not level or turn.splits)]
                if t >= params.n_estimators or level >= params.max_depth or not own or not block.rows.trained:
                    continue
                counts = trees.level_counts(
                    block.rows, [block.margin(turn) for turn in own], [(turn.splits, turn.code) for turn in own], level,
                    trees.shown(order, params.colsample_bytree), bins + 1, seed, t, params.subsample)
                for turn, found in zip(own, counts):
                    yield _part_batch(key[0], turn.number, found.astype(np.int32).tobytes())

    return run


def _choose_splits(turns: Turns, level: int, order: list[int], bins: int):
    of = {(pop, turn.number): turn for (pop, _), own in turns.items() for turn in own}

    def run(table: pa.Table) -> pa.Table:
        pop, c = (table.column(k)[0].as_py() for k in ("_pop", "member"))
        features = trees.shown(order, of[pop, c].params.colsample_bytree)
        total = sum(np.frombuffer(v.as_buffer(), np.int32).astype(np.int64) for v in table.column("part"))
        above, below = total.reshape(len(features), 1 << level, 2, bins + 1).transpose(2, 1, 0, 3)
        best = trees.best_splits(below, above + below, level, features, of[pop, c].quantile, of[pop, c].params)
        f, b, gain = zip(*best.values()) if best else ((), (), ())
        return pa.table({"_pop": pa.array([pop] * len(best), pa.int32()), "member": pa.array([c] * len(best), pa.int32()),
                         "node": pa.array(list(best), pa.int32()), "f": pa.array(f, pa.int32()), "b": pa.array(b, pa.int32()),
                         "gain": pa.array(gain, pa.float64())})

    return run


def _add_leaves(turns: Turns, t: int, bins: int, width: int, wanted: dict | None):
    """Per task, member and leaf the buckets of its residuals around its own quantile.

    Rows of buckets beyond are only counted, below and above. A ``wanted`` bucket of a
    leaf is told instead, where a first pass left it open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _of_task(batches, turns, t, bins, width):
            for turn in turns[key]:
                if t >= turn.params.n_estimators or not block.rows.trained:
                    continue
                if wanted is not None and (key[0], turn.number) not in wanted:
                    continue
                told = trees.tell_leaves(block.rows, block.margin(turn), turn.splits, turn.code, turn.quantile,
                                         None if wanted is None else wanted[key[0], turn.number])
                if told:
                    yield _part_batch(key[0], turn.number, pickle.dumps(told))

    return run


_LEAVES = "_pop int, member int, node int, value double, low long, high long"


def _choose_leaves(turns: Turns):
    """The value of each leaf, or the range of buckets in which it has to be looked for again."""
    of = {(pop, turn.number): turn for (pop, _), own in turns.items() for turn in own}

    def run(table: pa.Table) -> pa.Table:
        pop, c = (table.column(k)[0].as_py() for k in ("_pop", "member"))
        leaves: dict[int, list[tuple]] = {}
        for v in table.column("part"):
            for leaf, *told in pickle.loads(v.as_buffer()):
                leaves.setdefault(leaf, []).append(told)
        rows = []
        for leaf, parts in sorted(leaves.items()):
            value = trees.choose_leaf(parts, of[pop, c].quantile)
            rows.append((leaf, value, *((-trees.FAR, trees.FAR) if value is None else (None, None))))
        leaf, value, low, high = zip(*rows)
        return pa.table({"_pop": pa.array([pop] * len(rows), pa.int32()), "member": pa.array([c] * len(rows), pa.int32()),
                         "node": pa.array(leaf, pa.int32()), "value": pa.array(value, pa.float64()),
                         "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return run


def _tell_rows(turns: Turns, t: int, roles: tuple[str, ...]):
    """The rows asked for with their final margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column("place").to_pylist():
                for key, block in _held(place, turns, t):
                    yield from block.told(key, roles, list(block.margins))

    return run


class _HeldRows:
    """Packed rows that tasks have laid down, each on its executor; what an executor loses is laid down anew elsewhere."""

    def __init__(self, packed: DataFrame, turns: Turns, bins: int, width: int):
        # blocks of about the same size are dealt evenly, so that all cores have some in every round
        size = packed.agg(F.sum(F.length("bins") + F.col("n") * 25)).first()[0] or 0
        self.parts = int(max(packed.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))
        self.made = packed.repartition(self.parts).mapInArrow(_hold(turns, bins, width), "place string")
        self.places = None
        self._lay()

    def _lay(self) -> None:
        if self.places is not None:
            self.places.unpersist()
        # the stored names have Spark prefer the executor that has the folder
        self.places = self.made.rdd.map(lambda r: r["place"]).persist(StorageLevel.MEMORY_AND_DISK)

    def folders(self) -> DataFrame:
        return self.made.sparkSession.createDataFrame(self.places.map(lambda p: (p,)), "place string")

    def again(self, job):
        """The result of a job over the rows, laid down anew if they are lost."""
        for last in (False, False, True):
            try:
                return job()
            except Exception as error:
                if last or LostRows.__name__ not in str(error):
                    raise
                self._lay()

    def sums(self, run, choose, schema: str, size: int) -> list[dict]:
        """What ``choose`` makes of what the tasks tell of each member: parts of ``size`` bytes, all together, at most."""
        def told(places: Iterator[str]) -> Iterator[tuple]:
            for batch in run(pa.RecordBatch.from_arrays([pa.array([place])], ["place"]) for place in places):
                yield from zip(*[column.to_pylist() for column in batch.columns])

        if size * self.parts > SENT_BYTES:
            return self.again(lambda: [r.asDict() for r in self.folders().mapInArrow(run, _PART).groupBy("_pop", "member").applyInArrow(choose, schema).collect()])
        by_member: dict[tuple[int, int], list[bytes]] = {}
        for pop, member, part in self.again(lambda: self.places.mapPartitions(told).collect()):
            by_member.setdefault((pop, member), []).append(part)
        out = []
        for (pop, member), found in by_member.items():
            n = len(found)
            out += choose(pa.table({"_pop": pa.array([pop] * n, pa.int32()), "member": pa.array([member] * n, pa.int32()),
                                    "part": pa.array(found, pa.binary())})).to_pylist()
        return out

    def close(self) -> None:
        self.places.foreach(lambda place: shutil.rmtree(place, ignore_errors=True))
        self.places.unpersist()


def _fit_quantiles(rows: DataFrame, keys: list[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles per fit of rows that name the fits they train in ``own``.

    Rows are counted by the set of their fits, and the counts are expanded.
    """
    raw = ["_pop", "own", *keys]
    spread = lambda table: table.withColumn("fit", F.explode("own")).drop("own")
    return ranked_values(present_values(rows, raw, value), raw, qs, ["_pop", "fit", *keys], spread)


def _large_inputs(data: DataFrame, levels: Sequence[float] | None, bins: int, center: bool, impute: bool) -> DataFrame:
    """One row per population, fit and quantile with what ``trees.fit_inputs`` yields, by grouped jobs."""
    fit = ["_pop", "fit"]
    unit = [*fit, "quantile"]
    shares = [i / bins for i in range(1, bins)]
    named = F.transform(F.filter("fits", lambda f: f["role"] == "train"), lambda f: F.coalesce(f["fit"], F.lit("")))
    trained = data.withColumn("own", F.array_sort(named)).where("size(own) > 0")
    shift = settle(_fit_quantiles(trained, [], "y", [0.5]).select(
        *fit, F.col("n").alias("n_train"), (F.col("q")[0] if center else F.lit(0.0)).alias("shift")))
    tall = trained.select("_pop", "own", F.posexplode("x").alias("f", "v"))
    fills = settle(_fit_quantiles(tall, ["f"], "v", [0.5]).select(*fit, "f", F.col("q")[0].alias("fill")))
    if impute:
        # what is filled in differs by fit, so only rows with a gap go by fit
        gap = F.col("v").isNull() | F.isnan("v")
        gaps = tall.where(gap).select("_pop", F.explode("own").alias("fit"), "f").join(fills, [*fit, "f"], "left")
        tall = tall.where(~gap).unionByName(gaps.select("_pop", F.array("fit").alias("own"), "f", F.coalesce("fill", F.lit(0.0)).alias("v")))
    by_feature = _fit_quantiles(tall, ["f"], "v", shares).groupBy(*fit).agg(
        F.map_from_entries(F.collect_list(F.struct("f", F.array_sort(F.array_distinct("q")).alias("q")))).alias("cuts"))
    filled = fills.groupBy(*fit).agg(F.map_from_entries(F.collect_list(F.struct("f", "fill"))).alias("fills"))
    kept = ["_pop", "y", "category", "encode"] if levels else ["_pop", "y", "category", "encode", "quantile"]
    rows = cut_lineage(trained.select(*kept, F.explode("own").alias("fit")).join(F.broadcast(shift), fit).withColumn("_y", F.col("y") - F.col("shift")))
    quantiles = F.array(*[F.lit(float(q)) for q in sorted(levels)]) if levels else F.array("quantile")
    each = rows.withColumn("quantile", F.explode(quantiles))
    coded = rows.where("encode = 'codes'")

    def per(keys: list[str], name: str) -> DataFrame:
        """All levels from one set of counts."""
        if levels is None:
            at = F.array_position(F.array(F.lit(0.5)), F.col("quantile")).cast("int")
            return exact_quantiles(coded, ["_pop", "fit", "quantile", *keys], "_y", [0.5]).select(*unit, *keys, F.element_at("q", at).alias(name))
        found = exact_quantiles(coded, [*fit, *keys], "_y", sorted(levels))
        return found.select(*fit, *keys, F.inline(F.arrays_zip(quantiles.alias("quantile"), F.col("q").alias(name))))

    codes = settle(per(["category"], "code").select(*unit, "category", "code"))
    overall = settle(per([], "fallback").select(*unit, "fallback"))
    value = each.where("encode = 'codes'").join(overall, unit).join(codes, [*unit, "category"], "left").withColumn("v", F.coalesce("code", "fallback"))
    code_cuts = exact_quantiles(value, unit, "v", shares).select(*unit, F.array_sort(F.array_distinct("q")).alias("code_cuts"))
    coding = codes.groupBy(*unit).agg(F.map_from_entries(F.collect_list(F.struct("category", "code"))).alias("codes"))
    base = bucket_quantiles(each, unit, F.col("_y"), "quantile", "base")
    kind = rows.groupBy("_pop").agg(F.first("encode").alias("encode"))
    return (
        base.join(shift, fit).join(by_feature, fit, "left").join(filled, fit, "left").join(kind, "_pop")
        .join(overall, unit, "left").join(coding, unit, "left").join(code_cuts, unit, "left")
    )


_COLUMN = "_pop int, fit string, f int, n int, encode string, values binary, category binary"


def _by_column(width: int):
    """Training rows to the values of one column each, by population and fit; y, with the categories, is column -1."""
    schema = to_arrow_schema(T._parse_datatype_string(_COLUMN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for pop in whole.column("_pop").unique().to_pylist():
                table = whole.filter(pc.equal(whole.column("_pop"), pop))
                x, y, category, _ = _columns(table)
                encode = table.column("encode")[0].as_py()
                told = table.column("told").combine_chunks().dictionary_encode()
                named = [{f.get("fit", "") for f in json.loads(text) if f.get("role") == "train"} for text in told.dictionary.to_pylist()]
                which = told.indices.to_numpy(zero_copy_only=False)
                out = []
                for fit in sorted(set().union(*named)):
                    rows = np.flatnonzero(np.array([fit in n for n in named])[which])
                    names, index = trees.coded(category.take(rows))
                    out.append((pop, fit, -1, len(rows), encode, y[rows].tobytes(), pickle.dumps((names, index.astype(np.int32)))))
                    out += [(pop, fit, f, len(rows), encode, column.tobytes(), None) for f, column in enumerate(x[rows].T)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _fit_columns(levels: dict[int, list[float]], bins: int, center: bool, impute: bool):
    """What is fitted on one column of a population and fit."""

    def run(table: pa.Table) -> pa.Table:
        pop, fit, f, encode = (table.column(c)[0].as_py() for c in ("_pop", "fit", "f", "encode"))
        values = np.concatenate([np.frombuffer(v.as_buffer()) for v in table.column("values")])
        if f >= 0:
            made = trees.fit_column(values, bins, impute)
        else:
            parts = [pickle.loads(v.as_buffer()) for v in table.column("category")]
            names = sorted(set().union(*[p[0] for p in parts]))
            at = {name: i for i, name in enumerate(names)}
            index = np.concatenate([np.array([*[at[name] for name in own], -1], np.int32)[index] for own, index in parts])
            category = pa.DictionaryArray.from_arrays(pa.array(index, mask=index < 0), pa.array(names, pa.string()))
            made = len(values), trees.fit_levels(np.zeros((len(values), 0)), values, category, levels[pop], bins, center, impute, encode)
        return pa.table({"_pop": pa.array([pop], pa.int32()), "fit": [fit], "f": pa.array([f], pa.int32()), "made": [pickle.dumps(made)]})

    return run


def _column_members(data: DataFrame, levels: dict[int, list[float]], width: int, candidates: list[Params], chosen: dict, bins: int,
                    center: bool, impute: bool) -> dict[int, list[Member]]:
    """The members of populations of which a task may hold a column: each is sorted where it is grouped."""
    tall = data.select("_pop", "rid", "y", "x", "category", "encode", F.to_json("fits").alias("told")).mapInArrow(_by_column(width), _COLUMN)
    found = tall.groupBy("_pop", "fit", "f").applyInArrow(_fit_columns(levels, bins, center, impute), "_pop int, fit string, f int, made binary")
    made = {(r["_pop"], r["fit"], r["f"]): pickle.loads(r["made"]) for r in found.collect()}  # fits times features a population
    wave: dict[int, list[Member]] = {}
    for pop, fit in sorted({key[:2] for key in made}):
        columns = [made[pop, fit, f] for f in range(width)]
        n, fitted = made[pop, fit, -1]
        for code, own in enumerate(sorted(fitted, key=lambda i: i.quantile)):
            inputs = replace(own, fills=np.array([fill for fill, _ in columns], float), edges=[*[edges for _, edges in columns], *own.edges])
            wave.setdefault(pop, []).extend(
                Member(fit or None, inputs, n, c, code) for c in chosen.get((pop, inputs.quantile), range(len(candidates))))
    return wave


def _wave_members(found: DataFrame, width: int, candidates: list[Params], chosen: dict, impute: bool) -> dict[int, list[Member]]:
    """The members of a bounded number of populations."""
    wave: dict[int, list[Member]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["_pop"], r["fit"], r["quantile"])):  # fits times quantiles a population
        fills = np.array([(r["fills"] or {}).get(f, 0.0) if impute else np.nan for f in range(width)])
        codes = {"codes": r["codes"] or {}, "zero": {}}.get(r["encode"])
        edges = [np.array((r["cuts"] or {}).get(f, []), float) for f in range(width)]
        if codes is not None:
            edges.append(np.array(r["code_cuts"] if r["encode"] == "codes" else [0.0], float))
        made = trees.Inputs(r["quantile"], r["shift"], fills, codes, r["fallback"] or 0.0, edges, r["base"])
        own = chosen.get((r["_pop"], r["quantile"]), range(len(candidates)))
        code = len({m.inputs.quantile for m in wave.get(r["_pop"], []) if m.fit == (r["fit"] or None)})
        wave.setdefault(r["_pop"], []).extend(Member(r["fit"] or None, made, r["n_train"], c, code) for c in own)
    return wave


def _packed(data: DataFrame, wave: dict[int, list[Member]], numeric: int, bins: int, told: Sequence[str]) -> DataFrame:
    rows = data.select("_pop", "row", "rid", "y", "x", "category", F.to_json("fits").alias("told"))
    return cut_lineage(rows.mapInArrow(_pack(wave, numeric, _bin_type(bins), _roles(told)), _BLOCK))


def _train_wave(packed: DataFrame, wave: dict[int, list[Member]], candidates: list[Params], numeric: int, bins: int, seed: int,
                columns: int, told: tuple[str, ...]) -> tuple[_HeldRows, DataFrame]:
    """Grow all trees of the wave; returns the rows held and those asked for, with their final margins."""
    orders = trees.column_orders(columns, max(p.n_estimators for p in candidates), seed)
    context = packed.sparkSession.sparkContext
    held, since, past = _HeldRows(packed, _turns(wave, candidates), bins, numeric), 0, None
    members = [candidates[m.candidate] for ms in wave.values() for m in ms]
    for t, order in enumerate(orders):
        if t - since >= CUT_EVERY:
            since, past = t, context.broadcast({(pop, c): m.grown for pop, ms in wave.items() for c, m in enumerate(ms)})
        growing = [p for p in members if t < p.n_estimators]
        for level in range(max(p.max_depth for p in growing)):
            turns = _turns(wave, candidates, since, past)
            size = sum(len(trees.shown(order, p.colsample_bytree)) for p in growing if level < p.max_depth) * (8 << level) * (bins + 1)
            new = held.sums(_add_histograms(turns, t, level, order, bins, numeric, seed), _choose_splits(_shortened(turns), level, order, bins),
                            "_pop int, member int, node int, f int, b int, gain double", size)  # one row per node and member of the wave
            for r in sorted(new, key=lambda r: r["node"]):
                wave[r["_pop"]][r["member"]].splits[r["node"]] = (r["f"], r["b"])
                wave[r["_pop"]][r["member"]].gains.append((r["f"], r["gain"]))
            if not new:
                break
        turns, wanted, leaves = _turns(wave, candidates, since, past), None, []
        while wanted is None or wanted:
            found = held.sums(_add_leaves(turns, t, bins, numeric, wanted), _choose_leaves(_shortened(turns)), _LEAVES,
                              sum(LEAF_BYTES << p.max_depth for p in growing))  # one row per leaf
            leaves += [r for r in found if r["value"] is not None]
            wanted = {}
            for r in found:
                if r["value"] is None:
                    wanted.setdefault((r["_pop"], r["member"]), {})[r["node"]] = (r["low"], r["high"])
        for ms in wave.values():
            for m in ms:
                if t < candidates[m.candidate].n_estimators:
                    m.grown.append((m.splits, {}))
                m.splits = {}
        for r in sorted(leaves, key=lambda r: r["node"]):
            m = wave[r["_pop"]][r["member"]]
            m.grown[-1][1][r["node"]] = r["value"] * candidates[m.candidate].learning_rate
    final = _turns(wave, candidates, since, past)
    return held, held.folders().mapInArrow(_tell_rows(final, len(orders), told), _TOLD)


def _shortened(turns: Turns) -> Turns:
    """Without the trees, which choosing does not need."""
    return {key: [replace(turn, splits={}, recent=[], past=None) for turn in own] for key, own in turns.items()}


# --- the estimator -------------------------------------------------------------------


@dataclass(frozen=True)
class Trainer:
    """Trains all fits of all populations.

    ``data`` has the population's key columns, ``row`` (unique), ``rid`` (a hash of what
    identifies the row), ``y``, ``x`` (features, missing as NaN), ``category``, ``encode``
    (``codes``, ``zero`` or empty) and ``fits`` (name and role of every fit the row is
    in). Without ``levels`` the population's ``quantile`` is one of its columns.
    ``chosen`` (keys, ``quantile``, ``candidate``) picks one candidate each.
    """

    keys: list[str]
    candidates: list[Params]
    levels: Sequence[float] | None = None
    tuned: bool = False
    center: bool = False
    impute: bool = False
    roles: tuple[str, ...] = ("train", "test")
    bins: int = MOST_BINS
    seed: int = 42

    def train(self, data: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
        pop = [*self.keys] if self.levels else [*self.keys, "quantile"]
        sizes = settle(data.groupBy(*pop).agg(F.count("*").alias("n")))
        large, few = sizes.where(F.col("n") > LOCAL_ROWS), sizes.where(F.col("n") <= LOCAL_ROWS)
        some = bool(large.take(1))
        small = join_populations(data, few.drop("n"), pop, "left_semi") if some else data
        units = small.select("*", F.inline("fits"))
        kinds = [*self.keys, "fit"] if self.levels else [*self.keys, "fit", "quantile"]
        apart = chosen is None and len(self.candidates) > 1
        units = units.withColumn("unit", F.explode(F.array(*[F.lit(c) for c in range(len(self.candidates))])) if apart else F.lit(None).cast("int"))
        if chosen is not None:
            picks = chosen.groupBy(*self.keys).agg(F.map_from_entries(F.collect_list(F.struct("quantile", F.col("candidate").cast("int")))).alias("chosen"))
            units = units.join(settle(picks), self.keys)
        else:
            units = units.withColumn("chosen", F.lit(None).cast("map<double,int>"))
        units = units.select(*kinds, "unit", "row", "rid", "role", "y", "x", "category", "encode", "chosen")
        outcome = T.StructType([units.schema[k] for k in [*self.keys, "fit"]] + [T.StructField("quantile", T.DoubleType())]
                               + T._parse_datatype_string(OUTCOME).fields)
        run = _local(kinds, to_arrow_schema(outcome), self.candidates, self.tuned, self.levels, self.bins, self.seed,
                     self.center, self.impute, self.roles)
        if some and not few.take(1):
            done = data.sparkSession.createDataFrame([], outcome)  # no rows have to be regrouped
        else:
            # units take long: enough parts that all cores have some to the end
            spark = data.sparkSession
            parts = min(4 * few.count() * len(self.candidates), 16 * spark.sparkContext.defaultParallelism)
            dealt = units.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *kinds, "unit")
            done = cut_lineage(dealt.groupBy(*kinds, "unit").applyInArrow(run, outcome))
        for wave in self._waves(large, pop) if some else []:
            done = done.unionByName(self._train_large(data, wave, pop, chosen, outcome))
        return done

    def _waves(self, large: DataFrame, pop: list[str]) -> Iterator[list]:
        """The large populations, a bounded number at a time."""
        depth = max(p.max_depth for p in self.candidates)
        cells = len(self.candidates) * len(self.levels or [0]) * 8 * (1 << depth) * 16 * (self.bins + 1)
        rows = large.select(*pop, "n").toLocalIterator()
        while wave := list(islice(rows, max(1, WAVE_CELLS // cells))):
            yield wave

    def _train_large(self, data: DataFrame, wave: list, pop: list[str], chosen: DataFrame | None, outcome: T.StructType) -> DataFrame:
        spark = data.sparkSession
        numbered = spark.createDataFrame(
            [(i, *r[:-1]) for i, r in enumerate(wave)], T.StructType([T.StructField("_pop", T.IntegerType())] + [data.schema[k] for k in pop]))
        own = join_populations(data, F.broadcast(numbered), pop)  # a bounded number of populations
        picks: dict = {}
        if chosen is not None:
            found = chosen.join(F.broadcast(numbered), self.keys).select("_pop", "quantile", "candidate").collect()
            picks = {(r["_pop"], r["quantile"]): [r["candidate"]] for r in found}
        width = len(own.select("x").first()["x"])
        members: dict[int, list[Member]] = {}
        whole, some = ([i for i, r in enumerate(wave) if (r["n"] <= COLUMN_ROWS) == here] for here in (False, True))
        if whole:
            found = _large_inputs(own.where(F.col("_pop").isin(whole)), self.levels, self.bins, self.center, self.impute)
            members |= _wave_members(found, width, self.candidates, picks, self.impute)
        if some:
            levels = {i: sorted(map(float, self.levels)) if self.levels else [wave[i]["quantile"]] for i in some}
            members |= _column_members(own.where(F.col("_pop").isin(some)), levels, width, self.candidates, picks, self.bins, self.center, self.impute)
        if not members:
            return spark.createDataFrame([], outcome)
        columns = max(len(m.inputs.edges) for ms in members.values() for m in ms)
        packed = _packed(own, members, width, self.bins, self.roles)
        args = (self.candidates, width, self.bins, self.seed, columns, self.roles)
        near, far = ({i: ms for i, ms in members.items() if (wave[i]["n"] <= TASK_ROWS) == here} for here in (True, False))
        told = _train_units(packed.where(F.col("_pop").isin(list(near))), near, *args) if near else spark.createDataFrame([], _TOLD)
        held = None
        if far:
            held, more = _train_wave(packed.where(F.col("_pop").isin(list(far))), far, *args)
            told = told.unionByName(more)
        keys_of = {i: dict(zip(pop, r)) for i, r in enumerate(wave)}  # the count is left out
        models, shapes = [], []
        for number, ms in members.items():
            at: dict = {}
            seen: dict = {}
            for m in ms:
                seen[m.fit] = seen.get(m.fit, 0) + 1
                at.setdefault((m.fit, m.inputs.quantile), []).append(seen[m.fit])  # place among the margins of the fit
                row = _model_row(m.inputs, m.n_train, m.candidate if self.tuned else None, m.grown, m.gains)
                row |= keys_of[number] | {"fit": m.fit, "quantile": m.inputs.quantile, "codes": m.inputs.codes}
                for tree in row["trees"]:
                    tree["splits"], tree["leaves"] = dict(tree["splits"]), dict(tree["leaves"])
                models.append(row)
            shapes += [(number, fit, q, places) for (fit, q), places in at.items()]
        made = spark.createDataFrame(models, outcome)
        shape = spark.createDataFrame(shapes, "_pop int, fit string, quantile double, at array<int>")
        rows = join_populations(told, F.broadcast(shape), ["_pop", "fit"]).join(F.broadcast(numbered.drop("quantile")), "_pop")
        predicted = rows.select(
            *self.keys, "fit", "quantile", "row", "role", "y",
            F.transform("at", lambda c: F.element_at("margins", c)).alias("prediction"),
        )
        store = lambda: cut_lineage(made.unionByName(predicted, allowMissingColumns=True).select(*outcome.names))
        if held is None:
            return store()
        done = held.again(store)
        held.close()
        return done


@dataclass(frozen=True)
class QuantileBoostedTrees:
    """Estimator. Rows carry keys, ``quantile``, ``y``, ``role`` and features.

    Rows whose role is ``train`` are fitted; all others are only scored. ``candidates``
    are all trained; the model's key then includes ``candidate``.
    """

    features: Sequence[str]
    keys: Sequence[str]
    id_columns: Sequence[str]
    params: Params = Params()
    candidates: Sequence[Params] | None = None
    bins: int = MOST_BINS
    seed: int = 42

    def fit(self, rows: DataFrame) -> BoostedModel:
        keys = [k for k in self.keys if k not in ("quantile", "candidate")]
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features])
        kept = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
        data = kept.select(
            *keys, F.col("quantile").cast("double"), F.col("_row").alias("row"), F.xxhash64(*self.id_columns).alias("rid"),
            F.col("y").cast("double").alias("y"), x.alias("x"), F.lit(None).cast("string").alias("category"),
            F.lit("").alias("encode"), F.array(F.struct(F.lit(None).cast("string").alias("fit"), "role")).alias("fits"),
        )
        candidates = list(self.candidates or [self.params])
        done = Trainer(keys, candidates, tuned=bool(self.candidates), bins=self.bins, seed=self.seed).train(data)
        group = [*keys, "quantile", *(["candidate"] if self.candidates else [])]
        model = BoostedModel.of(done, group, list(self.features), self.bins, max(p.max_depth for p in candidates))
        each = done.where(F.col("row").isNotNull()).select(F.col("row").alias("_row"), F.posexplode("prediction").alias("candidate", "prediction")).where("prediction is not null")
        scored = kept.join(each, "_row").drop("_row", *([] if self.candidates else ["candidate"]))
        model.scored = scored
        return model
