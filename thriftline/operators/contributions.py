"""Additive per-feature contributions of a boosted-tree model.

For every leaf the exact path-dependent Shapley value follows from which of the
(few) features on its path a row satisfies.  The weighted sum over all coalitions
is the integral of a polynomial over 0..1, which a Gauss-Legendre rule with half
as many points as features gives exactly.  What a leaf gives each feature depends
only on which of them a row satisfies: for up to six features on a path it is
worked out once per task for all of these (at most 64) cases, and a row looks it
up.  Leaves of longer paths are evaluated row by row.  What is sent to a task are
two bounds and a share per path feature, in size linear in the leaves, and numpy
evaluates blocks of rows and leaves at once.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.workspace import new_path


#: Rows and leaves that are evaluated at once.
ROWS, LEAVES = 256, 1024
#: Path features up to which all cases are worked out before, and rows that a task explains: at least the first, at most the second.
CASES, FEW_ROWS, TASK_ROWS = 6, 512, 4096


@dataclass(frozen=True)
class LeafGroup:
    """All leaves whose path holds the same number of distinct features."""
    features: np.ndarray  # [leaf, d]
    low: np.ndarray       # [leaf, d]  satisfied if low < x <= high
    high: np.ndarray
    kept: np.ndarray      # [leaf, d]  share of the training weight that a split on the feature lets through
    values: np.ndarray    # [leaf]

    @cached_property
    def cases(self) -> np.ndarray:
        """[d, leaf * 2^d]: what a leaf gives its feature j if the row satisfies the features whose bits are set."""
        leaves, d = self.features.shape
        satisfied = (np.arange(2 ** d)[:, None] >> np.arange(d)) & 1
        out = np.empty((d, leaves, 2 ** d))
        for at in range(0, leaves, LEAVES):
            kept = self.kept[at:at + LEAVES, None, :]
            given = self.values[at:at + LEAVES, None, None] * (satisfied - kept) * _integrals(kept, satisfied[None])
            out[:, at:at + LEAVES] = np.moveaxis(given, 2, 0)
        return out.reshape(d, -1)


def model_nodes(spark: SparkSession, model) -> tuple[dict[int, dict[int, dict]], list[float], float]:
    """Nodes per tree, tree weights and the scale to log-odds, from the saved form of the model."""
    trees = model.stages[-1] if isinstance(model, PipelineModel) else model
    path = new_path(spark, "model")
    trees.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # model-sized
    nodes: dict[int, dict[int, dict]] = {}
    for r in rows:
        nodes.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    scale = 2.0 if "Classif" in type(trees).__name__ else 1.0  # p = 1 / (1 + exp(-2 * margin))
    return nodes, list(trees.treeWeights), scale


def _leaf_paths(tree: dict[int, dict]):
    """(value, {feature: (low, high, share of training weight kept)}) of every leaf."""
    stack = [(0, {})]
    while stack:
        node_id, path = stack.pop()
        node = tree[node_id]
        if node["leftChild"] < 0:
            yield node["prediction"], path
            continue
        rule = node["split"]
        if rule["numCategories"] != -1:
            raise ValueError("only continuous splits are supported")
        feature, cut = rule["featureIndex"], rule["leftCategoriesOrThreshold"][0]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            low, high, kept = path.get(feature, (-np.inf, np.inf, 1.0))
            kept *= tree[child]["impurityStats"][0] / node["impurityStats"][0]
            box = (low, min(high, cut), kept) if left else (max(low, cut), high, kept)
            stack.append((child, {**path, feature: box}))


def leaf_groups(nodes: dict[int, dict[int, dict]], weights: Sequence[float], scale: float) -> tuple[list[LeafGroup], float]:
    """The leaves by number of path features, and the model's expected output."""
    by_size: dict[int, list] = {}
    base = 0.0
    for tree_id, tree in nodes.items():
        for value, path in _leaf_paths(tree):
            value *= weights[tree_id] * scale
            base += value * float(np.prod([kept for _, _, kept in path.values()]))
            if path:
                by_size.setdefault(len(path), []).append((value, path))
    groups = []
    for leaves in by_size.values():
        features = np.array([list(p) for _, p in leaves])
        box = np.array([list(p.values()) for _, p in leaves])
        groups.append(LeafGroup(features, box[:, :, 0], box[:, :, 1], box[:, :, 2], np.array([v for v, _ in leaves])))
    return groups, base


def _integrals(kept: np.ndarray, satisfied: np.ndarray) -> np.ndarray:
    """For every feature (the last axis) the integral over t of the product of z * (1 - t) + o * t over the others."""
    points, weights = np.polynomial.legendre.leggauss((kept.shape[-1] + 1) // 2)
    total = 0.0
    for t, weight in zip((points + 1) / 2, weights / 2):
        factors = kept * (1 - t) + satisfied * t
        total = total + weight * np.prod(factors, axis=-1, keepdims=True) / factors
    return total


def _look_up_block(out: np.ndarray, x: np.ndarray, group: LeafGroup, part: slice) -> None:
    """Add the contributions of some leaves to some rows (columns of ``x`` and ``out``) from the group's cases."""
    features = group.features[part]
    leaves, d = features.shape
    case = np.repeat(np.arange(part.start, part.start + leaves)[:, None] << d, x.shape[1], axis=1)
    for k in range(d):
        value = x[features[:, k]]
        case += ((value > group.low[part, k, None]) & (value <= group.high[part, k, None])).astype(np.int64) << k
    for k in range(d):
        owner = np.zeros((out.shape[0], leaves))
        owner[features[:, k], np.arange(leaves)] = 1.0
        out += owner @ group.cases[k].take(case)


def _add_block(out: np.ndarray, x: np.ndarray, group: LeafGroup, part: slice) -> None:
    """Add the contributions of some leaves to some rows.

    With z the shares and o the satisfied flags, feature j of a leaf of value v
    gets v * (o_j - z_j) times the integral over t of the product of
    z_k * (1 - t) + o_k * t over the other features k.
    """
    features, kept, values = group.features[part], group.kept[part], group.values[part]
    leaves, d = features.shape
    seen = [(x[:, features[:, k]] > group.low[part][:, k]) & (x[:, features[:, k]] <= group.high[part][:, k]) for k in range(d)]
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    totals = [np.zeros((len(x), leaves)) for _ in range(d)]
    for t, weight in zip((points + 1) / 2, weights / 2):
        factors = [kept[:, k] * (1 - t) + seen[k] * t for k in range(d)]
        product = weight * np.prod(factors, axis=0)
        for k in range(d):
            totals[k] += product / factors[k]
    for k in range(d):
        owner = np.zeros((leaves, out.shape[1]))
        owner[np.arange(leaves), features[:, k]] = values
        out += ((seen[k] - kept[:, k]) * totals[k]) @ owner


def row_contributions(groups: list[LeafGroup], x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    columns = np.ascontiguousarray(x.T)
    for group in groups:
        if group.features.shape[1] <= CASES:
            for row in range(0, len(x), ROWS):
                block = np.zeros((x.shape[1], len(x[row:row + ROWS])))
                for at in range(0, len(group.values), LEAVES):
                    _look_up_block(block, columns[:, row:row + ROWS], group, slice(at, at + LEAVES))
                out[row:row + ROWS] += block.T
            continue
        for at in range(0, len(group.values), LEAVES):
            for row in range(0, len(x), ROWS):
                _add_block(out[row:row + ROWS], x[row:row + ROWS], group, slice(at, at + LEAVES))
    return out


def contributions(model, df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("user_id", "segment"),
                  good_sign: float = -1.0, batch: int = 4096) -> DataFrame:
    """One column per feature: how far it moves the row's raw output from the model's mean.

    Contributions plus ``base_value`` equal the raw output (log-odds for the
    classifier), times ``good_sign``: the default -1 makes positive good for a
    default model.
    """
    spark = df.sparkSession
    groups, base = leaf_groups(*model_nodes(spark, model))
    shared = spark.sparkContext.broadcast(groups)
    names = list(columns)
    inputs = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    rows = df.count()
    tasks = max(-(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)))
    if tasks > inputs.rdd.getNumPartitions():  # a row costs far more than its bytes tell
        inputs = inputs.repartition(tasks)
    schema = T.StructType([*[inputs.schema[k] for k in keep], *[T.StructField(c, T.DoubleType()) for c in names],
                           T.StructField("base_value", T.DoubleType())])

    def explain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                moved = row_contributions(shared.value, part[names].to_numpy(dtype="float64")) * good_sign
                out = pd.DataFrame(moved, columns=names)
                for k in reversed(list(keep)):
                    out.insert(0, k, part[k].to_numpy())
                out["base_value"] = base * good_sign
                yield out

    return inputs.mapInPandas(explain, schema)
