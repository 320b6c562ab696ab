"""Features that follow a stream: mergeable measures per user and month, and features of the users that a batch has changed."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import statement_features as sf
from ..plans.workspace import wide_rows, write_through
from ..sources.buckets import bucketed_read, bucketed_upsert

KEY = "user_id"
# The persona signals that months_dlt doesn't count
SIGNALS = {"pmkisan_count": "Govt_PMKisan", "salary_count": "Salary_Income", "gig_count": "Gig_Income"}
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "bits": F.bit_or}


def month_rows(txns: DataFrame) -> DataFrame:
    """The state that these rows alone give: one row per user and month."""
    signals = [F.count_if(F.col("category") == category).alias(name) for name, category in SIGNALS.items()]
    return sf.months_dlt(txns.drop("persona"), *signals)


def merge_months(rows: DataFrame, fresh: str | None = None, keys: Sequence[str] = (KEY, "month")) -> DataFrame:
    """One row per user and month from several partial ones.

    Means and squared deviations are merged around the common mean, so nothing is
    lost by subtracting large sums however many batches a month comes in.
    ``fresh`` names a boolean column that tells apart the rows of a month, of which
    there are two at most: nothing is collected then, and hashing does.
    """
    merges = {**sf.month_merges_dlt(), **{name: "sum" for name in SIGNALS}, "last_batch": "max"}
    columns = [_MERGE[how](name).cast(rows.schema[name].dataType).alias(name) for name, how in merges.items() if name in rows.columns]
    moments = ("_k", "_mean", "_var")
    if fresh:
        sides = [[F.max(F.when((F.col(fresh) == side) & (F.col("_k") > 0), F.col(c))).alias(f"_{side}{c}") for c in moments] for side in (False, True)]
        found = F.array(*[F.struct(*[F.col(f"_{side}{c}").alias(c) for c in moments]) for side in (False, True)])
        merged = rows.groupBy(*keys).agg(*columns, *sides[0], *sides[1])
        merged = merged.withColumn("_moments", F.filter(found, lambda m: m["_k"].isNotNull()))
    else:
        merged = rows.groupBy(*keys).agg(*columns, F.collect_list(F.when(F.col("_k") > 0, F.struct(*moments))).alias("_moments"))
    mean = F.when(F.col("_k") > 0, _added(F.col("_moments"), lambda m: m["_k"] * m["_mean"]) / F.col("_k"))
    merged = merged.withColumn("_mean", mean)
    spread = _added(F.col("_moments"), lambda m: m["_k"] * (m["_var"] + (m["_mean"] - F.col("_mean")) * (m["_mean"] - F.col("_mean"))))
    return merged.withColumn("_var", F.when(F.col("_k") > 0, spread / F.col("_k"))).select(*[c for c in rows.columns if c != fresh])


def _added(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + of(v))


def features(state: DataFrame) -> DataFrame:
    """The feature table of the users in ``state``, and the last batch of each if the state tells it.

    The persona comes from the same sums over their months.  A NULL user has none.
    """
    signals = [F.sum(name).alias(name) for name in SIGNALS]
    carried = [c for c in ("last_batch",) if c in state.columns]
    users = sf.user_totals_dlt(state, KEY, more=[*signals, *[F.max(c).alias(c) for c in carried]])
    diversity = F.coalesce(F.col("unique_categories"), F.lit(0)).cast("long")
    users = sf.assign_persona(users.withColumn("category_diversity", diversity), "dlt")
    return sf.finish_dlt(users.withColumn("persona", F.when(F.col(KEY).isNotNull(), F.col("persona"))), *carried)


def update_features(txns: DataFrame, path: str, batch_id: int, buckets: int = 64) -> None:
    """Merge a batch of enriched rows into the state below ``path`` and renew the features of its users.

    Only buckets with users of the batch are read and written, by tasks whose
    number follows the rows.  The state holds a row per user and month with the last
    batch in it, written together: a batch that is given again, whole or after a
    failure half way, counts once.  Batches come one after another, as a stream's
    do, with growing numbers.  There must be one writer: of two that claim the
    same version the second raises ConcurrentWrite, but one that reads the state
    before and writes after the other is not noticed.  Rows of old months, of new
    users, without a date or without a user are merged like any other; an empty
    batch changes nothing.
    """
    with wide_rows(txns.sparkSession, short_methods=True):
        _update(txns, path, batch_id, buckets)


def _update(txns: DataFrame, path: str, batch_id: int, buckets: int) -> None:
    spark = txns.sparkSession
    fresh = write_through(month_rows(txns), "month_rows")
    if fresh.isEmpty():
        return
    new = fresh.withColumn("last_batch", F.lit(batch_id).cast("long"))
    schema = _nullable(new.schema)
    old = bucketed_read(spark, f"{path}/state", schema)
    done = write_through(old.filter(F.col("last_batch") >= batch_id).select(F.col(KEY).alias("_done")).distinct(), "done_users")
    if not done.isEmpty():
        new = new.join(done, F.col(KEY).eqNullSafe(F.col("_done")), "left_anti")
    bucketed_upsert(new, f"{path}/state", KEY, schema, buckets, None, attempts=1, merge=_merge_files)
    state = bucketed_read(spark, f"{path}/state", schema, fresh, KEY, whole=True)
    gold = write_through(features(state).filter(F.col("last_batch") >= batch_id).drop("last_batch"), "new_features")
    bucketed_upsert(gold, f"{path}/features", KEY, gold.schema, buckets, None, attempts=1)


def _merge_files(rows: DataFrame) -> DataFrame:
    """One row per user and month in the order of months, so that their sums come out the same every time."""
    return merge_months(rows, "_fresh", ("_bucket", "_part", KEY, "month")).sortWithinPartitions("_bucket", KEY, "month")


def _nullable(kind: T.DataType) -> T.DataType:
    """The type as it comes back from files: everything in it may be NULL."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    return T.ArrayType(_nullable(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def feature_stream(silver: DataFrame, path: str, checkpoint: str, every: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep state and features below ``path`` up to date with a stream of enriched rows."""
    writer = silver.writeStream.foreachBatch(lambda batch, number: update_features(batch, path, number, buckets))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_features(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest features of all users."""
    return bucketed_read(spark, f"{path}/features", schema)
