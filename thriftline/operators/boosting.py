"""The boosted classification trees of MLlib, grown inside tasks that keep their rows.

MLlib runs a job for every level of every tree, and most of such a job is its start.
Here one job trains a model: each task bins its rows once, keeps them, and the tasks
exchange sums per node, feature and bin.  Sampling, splits, stopping
rules and the order of sums are those of MLlib: on a table of one task
the trees are the same.  The cut points are MLlib's own.
"""
from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.workspace import new_path

#: Up to so many rows one task trains, and adds up its rows in the order in which MLlib does.
ONE_TASK = 100_000
#: What all tasks send grows with the square of their number: with so many rows a task's share of the work is worth it.
EXCHANGE_ROWS, MOST_ROWS = 20_000, 2_000_000
INVALID = -np.finfo(float).max
EPSILON = np.finfo(float).eps
NODES = ("tree int, id int, prediction double, impurity double, s0 double, s1 double, s2 double, n long, gain double, "
         "left_child int, right_child int, feature int, cut double")


# --- random numbers of MLlib ---------------------------------------------------------------

_WORD = (1 << 64) - 1


def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def xorshift_start(seed: int) -> int:
    """The first state of a ``XORShiftRandom``."""
    data = (seed & _WORD).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _xorshift(state: int) -> int:
    state ^= state << 21 & _WORD
    state ^= state >> 35
    return state ^ (state << 4 & _WORD)


class _JavaRandom:
    """``java.util.Random``, as far as whole longs go."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self) -> int:
        self.state = self.state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        return self.state >> 16

    def next_long(self) -> int:
        high, low = self._next(), self._next()
        return (high << 32) + (low - (1 << 32) if low >> 31 else low) & _WORD


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """``k`` of the first ``n`` numbers, as ``SamplingUtils`` draws them."""
    kept, state = list(range(k)), xorshift_start(seed)
    for i in range(k, n):
        high = state = _xorshift(state)
        state = _xorshift(state)
        at = int(((high & (1 << 26) - 1) << 27 | state & (1 << 27) - 1) * 2.0 ** -53 * (i + 1))
        if at < k:
            kept[at] = i
    return kept


@lru_cache(maxsize=None)
def _leap(power: int) -> np.ndarray:
    """2 ** ``power`` steps of the generator, which are linear in the bits: a state's bytes look up what to combine."""
    if power:
        half = _leap(power - 1)
        images = _leapt(half, _leapt(half, np.uint64(1) << np.arange(64, dtype=np.uint64)))
    else:
        images = np.array([_xorshift(1 << i) for i in range(64)], np.uint64)
    table = np.zeros((8, 256), np.uint64)
    for byte in range(8):
        for bit in range(8):
            table[byte, 1 << bit:2 << bit] = table[byte, :1 << bit] ^ images[8 * byte + bit]
    return table


def _leapt(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for byte, seen in enumerate(states.astype("<u8").view(np.uint8).reshape(-1, 8).T):
        out ^= table[byte].take(seen)
    return out


def in_bag(n: int, seed: int, share: float) -> np.ndarray:
    """Which of a part's ``n`` rows a round reads: those with the next double below ``share``."""
    if share >= 1.0:
        return np.ones(n, bool)
    states = np.empty(2 * n, np.uint64)
    if n:
        states[0] = _xorshift(xorshift_start(seed))
    made, power = 1, 0
    while made < 2 * n:
        states[made:2 * made] = _leapt(_leap(power), states[:min(made, 2 * n - made)])
        made, power = 2 * made, power + 1
    high, low = states[::2] & np.uint64((1 << 26) - 1), states[1::2] & np.uint64((1 << 27) - 1)
    return (high << np.uint64(27) | low).astype(float) * 2.0 ** -53 < share


# --- trees -----------------------------------------------------------------------------------

def _impurity(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[..., 0] == 0, 0.0, (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0])


class _Node:
    """``sums`` are weight, weighted label and squared label, and rows; ``impurity`` is worked out from them."""
    __slots__ = ("depth", "sums", "impurity", "gain", "valid", "split", "children", "histogram")

    def __init__(self, depth: int, sums: np.ndarray | None):
        self.depth, self.sums, self.gain, self.valid, self.split, self.children, self.histogram = depth, sums, math.nan, True, None, None, None
        self.impurity = math.nan if sums is None else float(_impurity(sums))

    @property
    def prediction(self) -> float:
        return float(self.sums[1] / self.sums[0]) if self.sums[0] else 0.0


class Growing:
    """A tree under growth, a level at a time, in the order in which MLlib takes nodes and draws their features."""

    def __init__(self, seed: int, cuts: Sequence[np.ndarray], settings: dict, differences: bool):
        self.draws, self.cuts, self.settings, self.differences = _JavaRandom(seed), cuts, settings, differences
        self.nodes, self.open, self.asked = [_Node(0, None)], [0], [0]
        self.rest: dict[int, tuple[int, int]] = {}  # node: its parent and sibling, whose difference it is

    def take(self, histograms: np.ndarray) -> None:
        """Histograms of the nodes asked for: the open nodes are split, and their children are asked for."""
        for i, histogram in zip(self.asked, histograms):
            self.nodes[i].histogram = histogram
        for i, (parent, sibling) in self.rest.items():
            self.nodes[i].histogram = self.nodes[parent].histogram - self.nodes[sibling].histogram
        for node in self.nodes:
            if node.children:
                node.histogram = None
        level, stack, self.rest = self.open, [], {}
        for i in level:
            children = self._split(self.nodes[i])
            stack += children
            if self.differences and len(children) == 2:
                small, large = sorted(children, key=lambda j: self.nodes[j].sums[3])
                self.rest[large] = (i, small)
        self.open = stack[::-1]  # the last child comes first
        self.asked = [i for i in self.open if i not in self.rest]

    def _split(self, node: _Node) -> list[int]:
        """The children of a node that are open in turn; none if it is a leaf."""
        chosen = list(range(len(self.cuts)))
        if self.settings["per_node"] < len(chosen):
            chosen = reservoir(len(chosen), self.settings["per_node"], self.draws.next_long())
        features = [f for f in chosen if len(self.cuts[f])]
        sums = node.histogram[features].cumsum(axis=1)
        if not features:
            node.sums = node.histogram[chosen[0]].sum(axis=0) if node.sums is None else node.sums
            node.impurity, node.gain, node.valid = float(_impurity(node.sums)), INVALID, False
            return []
        left, right = sums[:, :-1], sums[:, -1:] - sums[:, :-1]
        if node.sums is None:
            node.sums = left[0, 0] + right[0, 0]
            node.impurity = float(_impurity(node.sums))
        whole = left[..., 0] + right[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = node.impurity - left[..., 0] / whole * _impurity(left) - right[..., 0] / whole * _impurity(right)
        least = np.array([self.settings["min_weight"], self.settings["min_rows"]])
        few = (left[..., [0, 3]] < least).any(axis=-1) | (right[..., [0, 3]] < least).any(axis=-1)
        gain[few | ~(gain >= self.settings["min_gain"])] = INVALID
        gain[np.arange(gain.shape[1]) >= np.array([len(self.cuts[f]) for f in features])[:, None]] = -np.inf
        f, cut = divmod(int(gain.argmax()), gain.shape[1])
        node.gain, node.valid = float(gain[f, cut]), gain[f, cut] != INVALID
        if node.gain <= 0:
            return []
        node.split, node.children = (features[f], cut), len(self.nodes)
        self.nodes += [_Node(node.depth + 1, sums[f, cut]), _Node(node.depth + 1, sums[f, -1] - sums[f, cut])]
        return [] if node.depth + 1 == self.settings["depth"] else [
            i for i in (node.children, node.children + 1) if abs(self.nodes[i].impurity) >= EPSILON]

    def moves(self, level: Sequence[int]) -> tuple[np.ndarray, ...]:
        """For every node feature, cut and left child, -1 for nodes that weren't split at the last level."""
        feature, cut, child = (np.full(len(self.nodes), x) for x in (0, 0, -1))
        for i in level:
            if self.nodes[i].split:
                feature[i], cut[i], child[i] = *self.nodes[i].split, self.nodes[i].children
        return feature, cut, child

    def rows(self, number: int) -> list[tuple]:
        """The nodes as MLlib saves them: parents first, and leaves of one value joined."""
        def leaf(node: _Node) -> tuple:
            return (node,)

        def whole(i: int) -> tuple:
            node = self.nodes[i]
            if node.children is None:
                return leaf(node)
            left, right = whole(node.children), whole(node.children + 1)
            if len(left) == len(right) == 1 and left[0].prediction == right[0].prediction:
                return leaf(node)
            return node, left, right

        out: list[list] = []

        def add(part: tuple) -> int:
            node, at = part[0], len(out)
            out.append([number, at, node.prediction, node.impurity if node.valid else -1.0, *map(float, node.sums[:3]), int(node.sums[3]),
                        -1.0, -1, -1, -1, math.nan])
            if len(part) > 1:
                feature, cut = node.split
                children = [add(child) for child in part[1:]]
                out[at][8:] = [node.gain, *children, feature, float(self.cuts[feature][cut])]
            return at

        add(whole(0))
        return [tuple(row) for row in out]


class _Rows:
    """The rows of a task in columns, ordered by the part they came from."""

    def __init__(self, batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray]):
        parts, kind = [], np.uint8 if max(map(len, cuts), default=0) < 256 else np.int32
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y, w, held, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
                parts.append((np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(kind), 2.0 * y - 1.0, w, held, part))
        none = (np.empty((len(cuts), 0), kind), *[np.empty(0)] * 2, np.empty(0, bool), np.empty(0, int))
        self.bins, self.y, self.w, self.held, part = (np.concatenate(x, axis=-1) for x in zip(none, *parts))
        if np.any(np.diff(part) < 0):
            order = np.argsort(part, kind="stable")
            self.bins, self.y, self.w, self.held, part = self.bins[:, order], self.y[order], self.w[order], self.held[order], part[order]
        self.train = np.flatnonzero(~self.held)
        self.bins = np.ascontiguousarray(self.bins)
        self.flat = self.bins.ravel()
        numbers, starts = np.unique(part[self.train], return_index=True)
        #: The number of every part and where its training rows begin and end.
        self.parts = list(zip(numbers.tolist(), starts.tolist(), [*starts.tolist()[1:], len(self.train)]))

    def bag(self, seed: int, share: float) -> list[np.ndarray]:
        """The rows of every part that a round reads."""
        return [self.train[a:b][in_bag(b - a, seed + number + 1, share)] for number, a, b in self.parts]


def _histograms(rows: _Rows, chosen: Sequence[np.ndarray], at: np.ndarray, asked: Sequence[int], n_nodes: int, n_bins: int,
                weighted: Sequence[np.ndarray]) -> np.ndarray:
    """Weight, weighted label, weighted squared label and rows by node, feature and bin; parts are added up one after the other."""
    place = np.full(n_nodes, -1)
    place[list(asked)] = np.arange(len(asked))
    size = len(asked) * n_bins
    total = np.zeros((len(asked), len(rows.bins), n_bins, 4))
    for some in chosen:
        own = place.take(at.take(some))
        some, first = some[own >= 0], own[own >= 0] * n_bins
        columns = [x.take(some) for x in weighted]
        slots = np.empty_like(first)
        for f, bins in enumerate(rows.bins):
            np.add(first, bins.take(some), out=slots)
            for i, x in enumerate((*columns, None)):
                total[:, f, :, i] += np.bincount(slots, x, size).reshape(-1, n_bins)
    return total


def exchange(tasks: int, folder: str) -> Callable[[np.ndarray], np.ndarray]:
    """Adds up the arrays of all tasks, in the order of their numbers.

    ``allGather`` looks once a second for what the others sent, so it only names the
    attempt; sums go through files in the shared folder.  A task has two, in turn:
    when it writes the next but one, all have read the first.
    """
    if tasks == 1:
        return lambda own: own
    context, sent = BarrierTaskContext.get(), 0
    own_number = context.partitionId()
    attempt = context.allGather(uuid.uuid4().hex)[0]

    def name(number: int, turn: int) -> str:
        return os.path.join(folder, f"{attempt}-{number}-{turn % 2}")

    def read(number: int, turn: int, shape: tuple[int, ...]) -> np.ndarray:
        wait = 1e-4
        while True:
            try:
                with open(name(number, turn), "rb") as file:
                    found = np.fromfile(file)
                if found[0] == turn:
                    return found[1:].reshape(shape)
            except FileNotFoundError:
                pass
            time.sleep(wait)
            wait = min(2 * wait, 0.01)

    def added(own: np.ndarray) -> np.ndarray:
        nonlocal sent
        sent += 1
        with open(name(own_number, sent) + ".new", "wb") as file:
            np.concatenate([[float(sent)], own.ravel()]).tofile(file)
        os.replace(name(own_number, sent) + ".new", name(own_number, sent))
        total = 0.0
        for number in range(tasks):
            total = total + (own if number == own_number else read(number, sent, own.shape))
        return total

    return added


def exchange_folder(spark: SparkSession) -> str | None:
    """A new folder through which tasks can exchange sums; None if the shared one is a store that Python can't open."""
    path = new_path(spark, "sums")
    path = path.removeprefix("file://").removeprefix("file:")
    if not path.startswith("/"):
        return None
    os.makedirs(path, exist_ok=True)
    return path


def _gradients(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The next labels.  Java's and C's exponentials agree far oftener than numpy's with either."""
    bounded = np.minimum(2.0 * y * margins, 709.0)
    return 4.0 * y / (1.0 + np.array(list(map(math.exp, bounded.tolist()))))


def _grown(rows: _Rows, cuts: Sequence[np.ndarray], settings: dict, patience: int, least: int,
           add: Callable[[np.ndarray], np.ndarray], differences: bool) -> list[tuple]:
    """All trees up to the round after which ``patience`` rounds brought no smaller validation error, or the last."""
    n_bins = 1 + max(map(len, cuts), default=0)
    margins, labels = np.zeros(len(rows.y)), rows.y
    out: list[tuple] = []
    errors: list[float] = []
    judged = np.flatnonzero(rows.held)
    while len(errors) < settings["rounds"]:
        number = len(errors)
        seed = settings["seed"] + number
        tree = Growing(seed, cuts, settings, differences)
        bag, at = rows.bag(seed, settings["share"]), np.zeros(len(rows.y), np.int32)
        if differences:
            bag = [np.concatenate([np.empty(0, np.intp), *bag])]
        weighted = (rows.w, rows.w * labels, rows.w * labels * labels)
        everyone = np.arange(len(at))
        while tree.open:
            level = tree.open
            tree.take(add(_histograms(rows, bag, at, tree.asked, len(tree.nodes), n_bins, weighted)))
            feature, cut, child = tree.moves(level)
            own = at.take(everyone)
            everyone, own = everyone[child.take(own) >= 0], own[child.take(own) >= 0]
            right = rows.flat.take(feature.take(own) * len(at) + everyone) > cut.take(own)
            at[everyone] = child.take(own) + right
        values = np.array([node.prediction for node in tree.nodes])
        margins = margins + values.take(at) * (settings["step"] if number else 1.0)
        out += tree.rows(number)
        labels = _gradients(margins, rows.y)
        loss = 2.0 * np.logaddexp(0.0, -2.0 * rows.y[judged] * margins[judged])
        error, weight = add(np.array([(rows.w[judged] * loss).sum(), rows.w[judged].sum()]))
        errors.append(error / weight if weight else math.nan)
        if len(errors) >= least and best_round(errors, patience) + patience <= len(errors):
            break
    return out


def best_round(errors: Sequence[float], patience: int) -> int:
    """The round (from 1) after which ``patience`` rounds brought no smaller error; the best of all if there is none such."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


# --- the job -----------------------------------------------------------------------------------

def by_tasks(spark: SparkSession, n: int) -> bool:
    """Whether tasks can train ``n`` rows: many rows need several that run at once and a folder that all can open."""
    return n <= ONE_TASK or (spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true" and exchange_folder(spark) is not None)


def wanted_tasks(spark: SparkSession, n: int, together: int = 1) -> int:
    """Tasks for a training of ``n`` rows of which ``together`` run side by side."""
    if n <= ONE_TASK:
        return 1
    slots = spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1"))
    return max(1, min(slots, max(min(slots // together, math.ceil(math.sqrt(n / EXCHANGE_ROWS))), math.ceil(n / MOST_ROWS))))


def cut_points(gbt: GBTClassifier, kept: DataFrame) -> tuple[list[np.ndarray], dict]:
    """MLlib's cut points of every feature, how many features a node draws and how much weight it needs."""
    jvm = kept.sparkSession.sparkContext._jvm
    gbt._transfer_params_to_java()
    java, whole = gbt._java_obj, lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
    strategy = java.getOldBoostingStrategy(
        jvm.PythonUtils.toScalaMap({}), jvm.org.apache.spark.mllib.tree.configuration.Algo.Classification()).treeStrategy()
    # the checks of labels, weights and features are made here
    instances = whole(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(java, kept._jdf, jvm.scala.Option.apply(2))
    impl = jvm.org.apache.spark.ml.tree.impl
    metadata = whole(impl, "DecisionTreeMetadata").buildMetadata(instances, strategy, 1, gbt.getFeatureSubsetStrategy())
    found = whole(impl, "RandomForest").findSplits(instances, metadata, gbt.getSeed())
    return [np.array([split.threshold() for split in splits]) for splits in found], {
        "per_node": metadata.numFeaturesPerNode(), "min_weight": metadata.minWeightPerNode()}


def train(rows: DataFrame, n: int, gbt: GBTClassifier, patience: int, least: int = 0) -> GBTClassificationModel:
    """The model of ``gbt`` on the rows that aren't ``held``, with the rounds up to which the held rows are worth their while.

    ``rows`` has features, label, weight and held.  Parts of a table of more than ``ONE_TASK`` rows are the tasks.
    """
    spark, label = rows.sparkSession, gbt.getLabelCol()
    cuts, settings = cut_points(gbt, rows.filter("NOT held"))
    settings |= {"rounds": gbt.getMaxIter(), "seed": gbt.getSeed(), "depth": gbt.getMaxDepth(), "step": gbt.getStepSize(),
                 "min_rows": gbt.getMinInstancesPerNode(), "min_gain": gbt.getMinInfoGain(), "share": gbt.getSubsamplingRate()}
    table = rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), "weight", "held",
                        F.spark_partition_id().alias("part"))
    differences = n > ONE_TASK
    table = table if differences else table.coalesce(1)
    tasks = table.rdd.getNumPartitions()
    folder = exchange_folder(spark) if tasks > 1 else ""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _grown(_Rows(batches, cuts), cuts, settings, patience, least, exchange(tasks, folder), differences)
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            names = [field.split()[0] for field in NODES.split(", ")]
            types = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[field.split()[1]] for field in NODES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*made), types)], names)

    return _loaded(table.mapInArrow(task, NODES, barrier=tasks > 1), len(cuts), gbt)


def _loaded(nodes: DataFrame, n_features: int, gbt: GBTClassifier) -> GBTClassificationModel:
    """The model of the trees, through the form in which MLlib saves it."""
    spark = nodes.sparkSession
    path = new_path(spark, "grown")
    split = F.struct(F.col("feature").alias("featureIndex"),
                     F.when(F.col("feature") < 0, F.array().cast("array<double>")).otherwise(F.array("cut")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories"))
    data = nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.array("s0", "s1", "s2").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
        F.col("left_child").alias("leftChild"), F.col("right_child").alias("rightChild"), split.alias("split")).alias("nodeData"))
    data.write.parquet(f"{path}/data")
    trees = 1 + spark.read.parquet(f"{path}/data").agg(F.max("treeID")).first()[0]

    def metadata(name: str, uid: str, params: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {"impurity": "variance", **params}, "defaultParamMap": {}, **more})

    step, params = gbt.getStepSize(), {"labelCol": gbt.getLabelCol(), "weightCol": gbt.getWeightCol()}
    spark.createDataFrame([(i, metadata("regression.DecisionTreeRegressionModel", f"dtr_{i}", {}, numFeatures=n_features), step if i else 1.0)
                           for i in range(trees)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(metadata("classification.GBTClassificationModel", gbt.uid, params, numFeatures=n_features, numTrees=trees),)],
                          "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)
