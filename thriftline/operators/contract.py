"""The feature contract: the one list of columns a model may see."""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..plans.workspace import write_through
from .clean import fill_numeric_nulls

IDENTITY = ("user_id", "segment", "state", "default_probability")


@dataclass(frozen=True)
class FeatureContract:
    version: str = "1.0"
    features: tuple[str, ...] = tuple(fv.CONTRACT_FEATURES)
    label: str = fv.CONTRACT_LABEL
    pillars: dict[str, str] = field(
        default_factory=lambda: {name: pillar for name, (pillar, _) in fv.CONTRACT_FEATURES.items()})

    def to_json(self) -> str:
        grouped: dict[str, list[str]] = {}
        for name in self.features:
            grouped.setdefault(self.pillars[name], []).append(name)
        return json.dumps({"version": self.version, "feature_cols": list(self.features),
                           "label_col": self.label, "n_features": len(self.features),
                           "pillars": grouped}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> "FeatureContract":
        raw = json.loads(text)
        pillars = {name: pillar for pillar, names in raw["pillars"].items() for name in names}
        return cls(raw["version"], tuple(raw["feature_cols"]), raw["label_col"], pillars)


def feature_contract(df: DataFrame, contract: FeatureContract = FeatureContract(),
                     identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Exactly identity + features + label; a missing column is an error, an extra one is dropped."""
    wanted = [*identity, *contract.features, contract.label]
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing from the feature contract: {missing}")
    return fill_numeric_nulls(df.select(*wanted))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail if a key occurs twice (runs one keyed count); otherwise return the frame."""
    twice = df.groupBy(key).count().filter(F.col("count") > 1).limit(1)
    if not twice.isEmpty():
        raise ValueError(f"duplicate values in key column {key}")
    return df


def training_set(labels: DataFrame, features: DataFrame, key: str = "user_id",
                 label: str = fv.CONTRACT_LABEL, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Labels with their features; the label is checked before it is read and keys must be unique."""
    if label not in labels.columns:
        raise ValueError(f"label column {label} is missing")
    assert_unique(features, key)
    chosen = [c for c in features.columns if c not in (key, label)]
    joined = labels.select(key, label).join(features.select(key, *chosen), key, "left")
    return joined.drop(*exclude)


def point_in_time_lookup(labels: DataFrame, features: DataFrame, key: str, label_ts: str, feature_ts: str,
                         ranges: int | None = None) -> DataFrame:
    """For every label row the newest feature row at or before the label time (NULLs if none).

    Both sides are merged into one history, dealt by ranges of key and time and
    written once.  Inside a range the last feature row of a key is carried
    forward; over the ends of ranges only each range's last feature row
    travels.  So no pair of label and feature rows is formed, and a key, a day
    or a moment of any size is spread over as many ranges as its rows need.

    A NULL key or a NULL time meets no feature row.  Of feature rows of one key
    and time any may be taken.
    """
    features = features.filter(F.col(key).isNotNull() & F.col(feature_ts).isNotNull())
    chosen = [c for c in features.columns if c not in (key, feature_ts)]
    packed = F.struct(F.col(feature_ts).alias("ts"), *chosen)
    whole = F.struct(*labels.columns)
    hashable = [f.name for f in labels.schema if "map<" not in f.dataType.simpleString()]
    left = labels.select(
        F.col(key).alias("_key"), F.col(label_ts).alias("_ts"), F.lit(1).alias("_side"), F.xxhash64(*hashable).alias("_tie"),
        whole.alias("_label"), F.lit(None).cast(features.select(packed.alias("f")).schema["f"].dataType).alias("_feature"))
    right = features.select(
        F.col(key).alias("_key"), F.col(feature_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"),
        F.lit(None).cast(labels.select(whole.alias("l")).schema["l"].dataType).alias("_label"), packed.alias("_feature"))
    order = ["_key", "_ts", "_side", "_tie"]
    both = left.unionByName(right)
    ranged = both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    history = write_through(numbered.withColumn("_range", F.shiftright("_row", 33)).drop("_tie"), "history")

    # a key goes on into a later range only as that range's first key and as the last one of the ranges before
    edges = history.groupBy("_range").agg(
        F.min("_row").alias("first"), F.max(F.when(F.col("_side") == 0, F.col("_row"))).alias("last"))
    picked = edges.select(F.inline(F.array(
        F.struct(F.col("first").alias("_row"), F.lit(False).alias("_is_end")),
        F.struct(F.col("last").alias("_row"), F.lit(True).alias("_is_end")))))
    marks = history.select("_row", "_range", "_key", "_feature").join(
        F.broadcast(picked), "_row")  # two numbers per range, as many ranges as tasks
    before = Window.partitionBy("_key").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("_is_end"), F.col("_feature"))
    carried = (marks.withColumn("_carried", F.last(end, ignorenulls=True).over(before))
               .filter("NOT _is_end AND _carried IS NOT NULL").select("_range", "_key", "_carried"))

    within = Window.partitionBy("_range", "_key").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answer = history.withColumn("_seen", F.last("_feature", ignorenulls=True).over(within)).filter("_side = 1")
    value = F.coalesce("_seen", "_carried")
    return answer.join(carried, ["_range", "_key"], "left").select(
        "_label.*", value["ts"].alias(feature_ts), *[value[c].alias(c) for c in chosen])
