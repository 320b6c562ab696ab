"""Boosted trees grown leaf by leaf, with a leaf count and L1 and L2 penalties; histograms are summed by Spark."""
from __future__ import annotations

import heapq
import math
import pickle
import random
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..plans.workspace import write_through
from . import boosting, models

#: Gradients are summed as whole multiples of 2^-20, so sums don't depend on the order of rows.  With weights up to w
#: they hold for 2^43 / w rows.
UNIT = float(1 << 20)
#: After so many rounds the margins of all rows are written anew; until then tasks replay the trees since.
REPLAYED = 8
LEAST_HESSIAN = 1e-3


@dataclass(frozen=True)
class Settings:
    """The eight searched parameters, then those that stay."""
    step_size: float = 0.04
    num_leaves: int = 63
    max_depth: int = 7
    min_instances: int = 15
    feature_fraction: float = 0.75
    bagging_fraction: float = 0.80
    reg_alpha: float = 0.1
    reg_lambda: float = 0.1
    rounds: int = 500


# The searched range of every parameter, and whether it is searched by its logarithm
RANGES = {"step_size": (0.01, 0.15, True), "num_leaves": (20, 120, False), "max_depth": (4, 9, False), "min_instances": (10, 50, False),
          "feature_fraction": (0.60, 0.95, False), "bagging_fraction": (0.60, 0.95, False),
          "reg_alpha": (0.01, 1.0, True), "reg_lambda": (0.01, 1.0, True)}
WHOLE = ("num_leaves", "max_depth", "min_instances")


@dataclass
class Tree:
    """Nodes as arrays.  A row goes left if its bin is at most ``cut``; a leaf leads to itself."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        children = np.stack([self.left, self.right], axis=1).ravel()
        while True:
            after = children.take(2 * at + (flat.take(first + self.feature.take(at)) > self.cut.take(at)))
            if np.array_equal(after, at):
                return at
            at = after

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class LeafwiseModel:
    columns: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    #: The weighted logistic loss on the validation rows after 0, 1, 2 ... rounds.
    errors: list[float]

    def margins(self, values: Sequence[np.ndarray]) -> np.ndarray:
        bins = to_bins(values, self.cuts)
        return sum((tree.margins(bins) for tree in self.trees), np.zeros(len(bins)))


def to_bins(values: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 0 holds what is missing, bin i the numbers above cut i-1 up to cut i."""
    out = np.empty((len(values[0]) if len(values) else 0, len(cuts)), np.uint8)
    for i, (x, c) in enumerate(zip(values, cuts)):
        out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x, side="left"))
    return out


def cut_points(df: DataFrame, columns: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every column, from a sketch in one pass; missing values take no part."""
    shares = [i / max_bins for i in range(1, max_bins)]
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), shares, 10_000).alias(f"c{i}") for i, v in enumerate(values)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def best_split(histogram: np.ndarray, allowed: np.ndarray, settings: Settings) -> tuple[float, int, int]:
    """gain, feature and bin of the best split of a node; gain 0 if there is none.  Ties go to the smaller feature and bin.

    ``histogram`` is features x bins x (gradient, hessian, rows) in whole units.
    """
    left = histogram[allowed].cumsum(axis=1)
    total = left[0, -1]
    right = total - left
    fits = (np.minimum(left[..., 2], right[..., 2]) >= settings.min_instances) & (
        np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN * UNIT)
    gain = np.where(fits, _score(left, settings) + _score(right, settings) - _score(total, settings), 0.0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return max(float(gain[f, b]), 0.0), int(allowed[f]), b


def _shrunk(gradient: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0)


def _score(sums: np.ndarray, settings: Settings) -> np.ndarray:
    return _shrunk(sums[..., 0] / UNIT, settings.reg_alpha) ** 2 / np.maximum(sums[..., 1] / UNIT + settings.reg_lambda, 1e-12)


@dataclass
class _Node:
    sums: np.ndarray
    depth: int
    histogram: np.ndarray | None = None
    best: tuple[float, int, int] = (0.0, 0, 0)
    children: tuple[int, int] | None = None


class Growing:
    """A tree under growth: always the leaf of the largest gain is split, up to the leaf count.

    Which leaves will be split is known before all histograms are: of the open
    leaves only as many as splits are left can still be reached.  All of these
    are opened in one pass over the rows, so a tree takes at most as many passes
    as it is deep and is the one that single splits would give.
    """

    def __init__(self, settings: Settings, allowed: np.ndarray):
        self.settings, self.allowed = settings, allowed
        self.nodes: list[_Node] = [_Node(np.zeros(3, np.int64), 0)]
        self.asked: dict[int, tuple[int, int] | None] = {0: None}  # node: its parent and sibling

    def take(self, histograms: dict[int, np.ndarray]) -> None:
        """Histograms of the nodes asked for; a sibling's is what is left of the parent's."""
        for i, family in self.asked.items():
            self._keep(i, histograms[i])
            if family:
                parent, sibling = family
                self._keep(sibling, self.nodes[parent].histogram - histograms[i])
        self.asked = {}
        splits, open_ = self._walk()
        for i in open_[:self.settings.num_leaves - 1 - len(splits)]:
            self._open(i)

    def _keep(self, i: int, histogram: np.ndarray) -> None:
        node = self.nodes[i]
        node.histogram, node.sums = histogram, histogram[0].sum(axis=0)
        if node.depth < self.settings.max_depth:
            node.best = best_split(histogram, self.allowed, self.settings)

    def _walk(self) -> tuple[list[int], list[int]]:
        """The nodes split so far in the order of their gains, and the open leaves from that on, best first."""
        heap, splits = [(-self.nodes[0].best[0], 0)], []
        while heap and heap[0][0] < 0 and len(splits) < self.settings.num_leaves - 1:
            i = heap[0][1]
            if self.nodes[i].children is None:
                return splits, [j for gain, j in sorted(heap) if gain < 0 and self.nodes[j].children is None]
            heapq.heappop(heap)
            splits.append(i)
            for child in self.nodes[i].children:
                heapq.heappush(heap, (-self.nodes[child].best[0], child))
        return splits, []

    def _open(self, i: int) -> None:
        node = self.nodes[i]
        _, f, b = node.best
        left = node.histogram[f, :b + 1].sum(axis=0)
        pair = [_Node(left, node.depth + 1), _Node(node.sums - left, node.depth + 1)]
        node.children = (len(self.nodes), len(self.nodes) + 1)
        self.nodes += pair
        small, large = sorted(node.children, key=lambda j: self.nodes[j].sums[2])
        if node.depth + 1 < self.settings.max_depth and self.nodes[large].sums[2] >= 2 * self.settings.min_instances:
            self.asked[small] = (i, large)

    def tree(self, chosen: set[int] | None = None) -> Tree:
        """The tree of the opened nodes, or of the ``chosen`` of them alone."""
        n = len(self.nodes)
        feature, cut, left, right = (np.zeros(n, np.int64) for _ in range(4))
        left[:] = right[:] = np.arange(n)
        for i, node in enumerate(self.nodes):
            if node.children and (chosen is None or i in chosen):
                _, feature[i], cut[i] = node.best
                left[i], right[i] = node.children
        sums = np.array([node.sums for node in self.nodes]) / UNIT
        value = -self.settings.step_size * _shrunk(sums[:, 0], self.settings.reg_alpha) / np.maximum(
            sums[:, 1] + self.settings.reg_lambda, 1e-12)
        return Tree(feature, cut, left, right, value)

    def finished(self) -> Tree:
        return self.tree(set(self._walk()[0]))


@dataclass
class _Run:
    """One of the models that are trained side by side."""
    settings: Settings
    seed: int
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    growing: Growing | None = None
    done: bool = False

    def begin(self, n_features: int) -> None:
        source = random.Random(f"{self.seed}:{len(self.trees)}")
        kept = max(1, round(self.settings.feature_fraction * n_features))
        self.growing = Growing(self.settings, np.array(sorted(source.sample(range(n_features), kept))))


def _in_bag(keys: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Whether rows belong to a round's bag: by their hash, mixed with the round."""
    mixed = keys.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (1 + number + 1000003 * seed)) % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)).astype(float) / float(1 << 53) < share


def _unpacked(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n_features)
    key, y, w, held = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
    margins = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return bins, key, y, w, held, margins


def _add(total: np.ndarray, first: np.ndarray, bins: np.ndarray, sums: Sequence[np.ndarray | None]) -> None:
    """Adds the sums of rows, and their number, to the histograms that begin at the slots ``first``."""
    n_nodes, n_features, n_bins, _ = total.shape
    columns = np.ascontiguousarray(bins.T)
    for f in range(n_features):
        slots = first + columns[f]
        for i, x in enumerate(sums):
            total[:, f, :, i] += np.bincount(slots, x, n_nodes * n_bins).astype(np.int64).reshape(-1, n_bins)


def _sums(table: DataFrame, runs: list[_Run], judged: bool, written: int, n_features: int, n_bins: int):
    """One pass over the rows: (run, node) -> histogram for all that is asked, and the losses of the runs."""
    asks = []
    for t, run in enumerate(runs):
        if not run.done:
            growing = run.growing
            asks.append((t, run.settings, run.seed, len(run.trees), run.trees[written:],
                         growing and growing.tree(), list(growing.asked) if growing else []))
    width = n_features * n_bins
    places = {(t, node): i for i, (t, node) in enumerate((t, node) for t, *_, nodes in asks for node in nodes)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(places), n_features, n_bins, 3), np.int64)
        losses = np.zeros((len(runs), 3), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, key, y, w, held, margins = _unpacked(batch, n_features)
            for t, settings, seed, number, recent, tree, nodes in asks:
                def margin(rows: np.ndarray) -> np.ndarray:
                    return margins[rows, t] + sum((r.margins(bins[rows]) for r in recent), np.zeros(len(rows)))

                if judged:
                    rows = np.flatnonzero(held)
                    m = margin(rows)
                    loss = w[rows] * np.logaddexp(0.0, np.where(y[rows] == 1, -m, m))
                    losses[t] += np.array([np.rint(loss * UNIT).sum(), np.rint(w[rows] * UNIT).sum(), len(rows)]).astype(np.int64)
                if not nodes:
                    continue
                # only rows in one of the nodes are replayed and summed: after the first pass the smaller children alone
                place = np.full(len(tree.value), -1)
                place[nodes] = np.arange(len(nodes))
                rows = np.flatnonzero(~held & _in_bag(key, seed, number, settings.bagging_fraction))
                at = place.take(tree.leaves(bins[rows]))
                rows, first = rows[at >= 0], at[at >= 0] * n_bins
                p = 1.0 / (1.0 + np.exp(-margin(rows)))
                sums = (np.rint((p - y[rows]) * w[rows] * UNIT), np.rint(p * (1.0 - p) * w[rows] * UNIT), None)
                own = slice(places[t, nodes[0]], places[t, nodes[0]] + len(nodes))
                _add(total[own], first, bins[rows], sums)
        total = total.reshape(-1, 3)
        slots = np.flatnonzero(total[:, 2])
        judged_runs = np.flatnonzero(losses[:, 2])
        found = np.concatenate([total[slots], losses[judged_runs]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([slots, -1 - judged_runs])), *[pa.array(found[:, i]) for i in range(3)]], ["slot", "g", "h", "n"])

    parts = table.mapInArrow(task, "slot long, g long, h long, n long")
    # at most runs x leaves x features x bins rows, whatever the table's size
    rows = parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    whole = np.zeros((len(places) * width, 3), np.int64)
    slots, *sums = (rows[c].to_numpy() for c in ("slot", "g", "h", "n"))
    values = np.stack(sums, axis=1)
    whole[slots[slots >= 0]] = values[slots >= 0]
    histograms = whole.reshape(len(places), n_features, n_bins, 3)
    losses = {-1 - int(s): v[0] / max(v[1], 1) for s, v in zip(slots, values) if s < 0}
    return {place: histograms[i] for place, i in places.items()}, losses


def binned(df: DataFrame, columns: Sequence[str], label: str, cuts: list[np.ndarray], runs: int, key: str,
           validation: str | None) -> DataFrame:
    """The training table: a byte per feature, hash of the key, label, weight, held out or not, a margin per model."""
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    training = df.filter(~held)
    positives = F.count_if(F.col(label) == 1)
    ratio = training.agg(F.coalesce(F.try_divide(F.count_if(F.col(label) == 0), positives), F.lit(1.0))).scalar()
    rows = df.filter(F.col(label).isNotNull()).select(
        F.xxhash64(key).alias("key"), F.col(label).cast("double").alias("y"),
        F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)).alias("w"), held.alias("held"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = to_bins([batch.column(4 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(cuts))], cuts)
            margins = pa.array([[0.0] * runs] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.tobytes() for row in bins], pa.binary()), *batch.columns[:4], margins],
                ["bins", "key", "y", "w", "held", "margins"])

    return rows.mapInArrow(packed, "bins binary, key long, y double, w double, held boolean, margins array<double>")


def _with_margins(table: DataFrame, runs: list[_Run], written: int, n_features: int) -> DataFrame:
    recent = [run.trees[written:] for run in runs]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, *_, margins = _unpacked(batch, n_features)
            added = np.stack([sum((r.margins(bins) for r in trees), np.zeros(len(bins))) for trees in recent], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array((margins + added).tolist(), pa.list_(pa.float64()))], batch.schema.names)

    return write_through(table.mapInArrow(moved, table.schema), "leafwise_margins")


def train(df: DataFrame, columns: Sequence[str], settings: Sequence[Settings], label: str = fv.CONTRACT_LABEL,
          key: str = "user_id", validation: str | None = "is_validation", patience: int = models.PATIENCE,
          max_bins: int = 64, seed: int = models.SEED) -> list[LeafwiseModel]:
    """Boosted trees for a 0/1 label, one model per settings, trained side by side on the same rows.

    Every round adds a tree.  Tasks sum gradients, hessians and rows per leaf,
    feature and bin of their rows as whole numbers, and splits are chosen from the
    sums alone.  A tree costs at most as many passes as it is deep.  A model is one
    job, whose tasks keep their rows; where tasks can't exchange their sums (see
    ``boosting.by_tasks``) a pass is a job for all models together.

    With ``validation`` (a boolean column, NULL counting as false) that is true for some rows a model ends when ``patience`` rounds
    bring no smaller loss and is cut to its best round.  Positive rows weigh as
    much as all negative ones together.  NULL and NaN features are smaller than
    every number; rows without a label take no part.  A round's bag depends on
    the hash of ``key``, its features on the seed: equal tables give equal models
    wherever their cut points are equal.  Without rows, or with one class alone,
    trees have one leaf.
    """
    if not 2 <= max_bins <= 254:
        raise ValueError("max_bins must be from 2 to 254")
    cuts = cut_points(df.filter(~F.coalesce(F.col(validation), F.lit(False))) if validation else df, columns, max_bins)
    n_bins = 2 + max(map(len, cuts))
    spark, n = df.sparkSession, df.filter(F.col(label).isNotNull()).count()
    if not boosting.by_tasks(spark, n):
        table = write_through(binned(df, columns, label, cuts, len(settings), key, validation), "leafwise_rows")
        runs = _by_jobs(table, [_Run(s, seed) for s in settings], patience, len(columns), n_bins)
    else:
        table = binned(df, columns, label, cuts, 1, key, validation)
        if n > boosting.ONE_TASK:  # a checkpoint keeps the parts, which are the tasks
            models.use_checkpoints(spark)
            table = table.repartition(boosting.wanted_tasks(spark, n, len(settings))).checkpoint()
        else:
            table = write_through(table, "leafwise_rows").coalesce(1)
        with ThreadPoolExecutor(max(len(settings), 1)) as pool:  # Spark runs the jobs of all models side by side
            alone = inheritable_thread_target(spark)(lambda s: _by_tasks(table, _Run(s, seed), patience, len(columns), n_bins))
            runs = list(pool.map(alone, settings))
    return [LeafwiseModel(list(columns), cuts, run.trees[:_kept(run.errors, patience)], run.errors) for run in runs]


def _by_jobs(table: DataFrame, runs: list[_Run], patience: int, n_features: int, n_bins: int) -> list[_Run]:
    """All models side by side, a job for every pass over the rows."""
    written = 0
    while not all(run.done for run in runs):
        going = [run for run in runs if not run.done]
        for run in going:
            run.growing = None
            if len(run.trees) < run.settings.rounds:
                run.begin(n_features)
        judged = True
        while True:
            histograms, losses = _sums(table, runs, judged, written, n_features, n_bins)
            for t, run in enumerate(runs):
                if judged and not run.done:
                    run.errors.append(losses.get(t, math.nan))
                    best = _kept(run.errors, patience)
                    run.done = run.growing is None or len(run.trees) - best >= patience
                if not run.done and run.growing.asked:
                    run.growing.take({node: h for (owner, node), h in histograms.items() if owner == t})
            judged = False
            if not any(run.growing.asked for run in runs if not run.done):
                break
        for run in runs:
            if not run.done:
                run.trees.append(run.growing.finished())
        length = max(len(run.trees) for run in runs)
        if length - written >= REPLAYED and not all(run.done for run in runs):
            table, written = _with_margins(table, runs, written, n_features), length
    return runs


def _by_tasks(table: DataFrame, run: _Run, patience: int, n_features: int, n_bins: int) -> _Run:
    """One model in one job, whose tasks keep their rows and exchange their sums."""
    tasks = table.rdd.getNumPartitions()
    folder = boosting.exchange_folder(table.sparkSession) if tasks > 1 else ""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(batch, n_features)[:5] for batch in batches if batch.num_rows]
        parts = parts or [(np.empty((0, n_features), np.uint8), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, bool))]
        made = _grown(run, *(np.concatenate(x) for x in zip(*parts)), patience, n_bins, boosting.exchange(tasks, folder))
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["run"])

    return pickle.loads(table.mapInArrow(task, "run binary", barrier=tasks > 1).collect()[0]["run"])  # all tasks must run


def _grown(run: _Run, bins: np.ndarray, key: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, patience: int, n_bins: int,
           add: Callable[[np.ndarray], np.ndarray]) -> _Run:
    """All rounds of a model over a task's rows; ``add`` adds up what all tasks have."""
    margins, recent = np.zeros((2, len(y)))  # as they are written anew by the passes of jobs
    judged = np.flatnonzero(held)
    while True:
        run.growing = None
        if len(run.trees) < run.settings.rounds:
            run.begin(bins.shape[1])
        m = margins + recent
        loss = w[judged] * np.logaddexp(0.0, np.where(y[judged] == 1, -m[judged], m[judged]))
        lost, weight, _ = add(np.array([np.rint(loss * UNIT).sum(), np.rint(w[judged] * UNIT).sum(), len(judged)]))
        run.errors.append(lost / max(weight, 1) if weight else math.nan)
        if run.growing is None or len(run.trees) - _kept(run.errors, patience) >= patience:
            run.growing, run.done = None, True
            return run
        rows = np.flatnonzero(~held & _in_bag(key, run.seed, len(run.trees), run.settings.bagging_fraction))
        p = 1.0 / (1.0 + np.exp(-m[rows]))
        g, h = np.rint((p - y[rows]) * w[rows] * UNIT), np.rint(p * (1.0 - p) * w[rows] * UNIT)
        own = bins[rows]
        while run.growing.asked:
            tree, nodes = run.growing.tree(), list(run.growing.asked)
            place = np.full(len(tree.value), -1)
            place[nodes] = np.arange(len(nodes))
            at = place.take(tree.leaves(own))
            inside = np.flatnonzero(at >= 0)
            total = np.zeros((len(nodes), bins.shape[1], n_bins, 3), np.int64)
            _add(total, at[inside] * n_bins, own[inside], (g[inside], h[inside], None))
            run.growing.take(dict(zip(nodes, add(total.astype(float)).astype(np.int64))))
        run.trees.append(run.growing.finished())
        recent = recent + run.trees[-1].margins(bins)
        if len(run.trees) % REPLAYED == 0:
            margins, recent = margins + recent, np.zeros(len(y))


def _kept(errors: Sequence[float], patience: int) -> int:
    """The number of trees with the smallest error; all of them if no rows were held out."""
    return len(errors) - 1 if math.isnan(errors[0]) else models.best_round(errors, patience) - 1


def predict(model: LeafwiseModel, df: DataFrame, column: str = "default_probability") -> DataFrame:
    """Adds the probability of label 1."""
    @F.pandas_udf("double")
    def probability(values: pd.DataFrame) -> pd.Series:
        return pd.Series(1.0 / (1.0 + np.exp(-model.margins([values[c].to_numpy(float, na_value=np.nan) for c in values]))))

    features = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(model.columns)]
    return df.withColumn(column, probability(F.struct(*features)))


def root_splits(df: DataFrame, columns: Sequence[str], label: str = fv.CONTRACT_LABEL, settings: Settings = Settings(),
                key: str = "user_id", max_bins: int = 64) -> DataFrame:
    """The best first split of every feature: feature, cut, gain and rows up to the cut; gain 0 and no cut where none fits."""
    cuts = cut_points(df, columns, max_bins)
    run = _Run(replace(settings, bagging_fraction=1.0), models.SEED)
    run.growing = Growing(run.settings, np.arange(len(columns)))
    table = binned(df, columns, label, cuts, 1, key, None)
    histogram = _sums(table, [run], False, 0, len(columns), 2 + max(map(len, cuts)))[0][0, 0]
    rows = []
    for i, name in enumerate(columns):
        gain, _, b = best_split(histogram, np.array([i]), run.settings)
        rows.append((name, float(cuts[i][b - 1]) if gain and b else None, gain, int(histogram[i, :b + 1, 2].sum()) if gain else None))
    return df.sparkSession.createDataFrame(rows, "feature string, cut double, gain double, rows_left long")


# --- tuning ------------------------------------------------------------------------------

def from_unit(places: Sequence[float], rounds: int) -> Settings:
    return Settings(**models.in_ranges(places, RANGES, WHOLE), rounds=rounds)


def random_settings(n: int, seed: int = models.SEED, rounds: int = 500) -> list[Settings]:
    draw = random.Random(seed)
    return [from_unit([draw.random() for _ in RANGES], rounds) for _ in range(n)]


def tune(df: DataFrame, columns: Sequence[str], settings: Sequence[Settings], label: str = fv.CONTRACT_LABEL, proposed: int = 0,
         together: int = 4, key: str = "user_id", seed: int = models.SEED, **options) -> tuple[DataFrame, LeafwiseModel]:
    """Search all eight parameters: the given settings, then ``proposed`` more by tree-structured Parzen estimators.

    ``together`` models are trained side by side.  ``df`` carries ``split``
    with train, val and test.  Returns the trials by validation AUC (the best with
    its test AUC, proposed ones with their log ratio) and the best model.
    """
    training = write_through(df.filter(F.col("split") != "test").withColumn("is_validation", F.col("split") == "val"), "leafwise_tuning")
    held = training.filter("is_validation")
    found: list[tuple[Settings, float | None, LeafwiseModel, float]] = []

    def run(chosen: list[tuple[Settings, float | None]]) -> None:
        for (s, ratio), model in zip(chosen, train(training, columns, [s for s, _ in chosen], label, key, seed=seed, **options)):
            auc = models.classification_metrics(predict(model, held, "_p"), label, "_p")["auc_roc"]
            found.append((s, ratio, model, auc))

    for start in range(0, len(settings), together):
        run([(s, None) for s in settings[start:start + together]])
    for start in range(0, proposed, together):
        ranked = [models.to_places(s, RANGES) for s, _, _, _ in sorted(found, key=lambda x: -x[3])]
        fresh = [models.propose_places(ranked, len(RANGES), seed * 1000 + start + i) for i in range(min(together, proposed - start))]
        run([(from_unit(places, found[0][0].rounds if found else 500), ratio) for places, ratio in fresh])
    best = max(range(len(found)), key=lambda i: found[i][3])
    test = models.classification_metrics(predict(found[best][2], df.filter(F.col("split") == "test"), "_p"), label, "_p")["auc_roc"]
    rows = [(i + 1, auc, test if i == best else None, *asdict(s).values(), len(model.trees), ratio)
            for i, (s, ratio, model, auc) in enumerate(found)]
    table = df.sparkSession.createDataFrame(
        rows, "trial int, auc double, test_auc double, step_size double, num_leaves int, max_depth int, min_instances int, "
              "feature_fraction double, bagging_fraction double, reg_alpha double, reg_lambda double, rounds int, trees int, log_ratio double")
    return table.orderBy(F.desc("auc"), "trial"), found[best][2]
