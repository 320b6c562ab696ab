"""Join strategies that hold up when one key carries a large share of the rows."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000
HOT_ROWS = 2_000_000
SALTS = 64
#: Rows that a task of a clustered join takes at most on average, however many there are.
TASK_ROWS = 250_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def row_salt(df: DataFrame, salts: int):
    """A salt that depends on the row's own values, so a rerun task yields the same rows."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")


def join_dimension(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
    max_rows: int = BROADCAST_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Join facts to a dimension whose keys repeat heavily on the facts side.

    The dimension is broadcast only after its size was checked.  A larger one is
    replicated over ``salts`` and joined on key plus salt, which spreads a hot
    key over that many tasks.
    """
    if how not in ("left", "inner"):
        raise ValueError("the facts side must be preserved: use left or inner")
    if fits(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    salted = facts.withColumn("_salt", row_salt(facts, salts))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def attach_by_key(
    rows: DataFrame, keyed: DataFrame, key: str, value: str, weight: str, hot_rows: int = HOT_ROWS,
    most_hot: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join one value per key onto many rows, with hot keys kept out of the shuffle join.

    ``keyed`` holds one row per key with the number of rows of that key in
    ``weight``.  The ``most_hot`` heaviest keys of at least ``hot_rows`` rows, a
    bounded number, are broadcast.  Rows of these keys, and rows without a key,
    are then given a harmless salted key, so the shuffle join that serves all
    other rows sees neither a hot nor a null partition.
    """
    keyed = keyed.select(key, value, weight)
    hot = keyed.filter(F.col(weight) >= hot_rows).orderBy(F.desc(weight), key).limit(most_hot)
    hot = hot.select(F.col(key).alias("_key"), F.col(value).alias("_hot_value"), F.lit(True).alias("_hot"))
    usual = keyed.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_usual_key"), value)
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    spread = F.concat(F.lit("\u0000"), row_salt(rows, 4096).cast("string"))
    apart = F.col("_hot") | F.col(key).isNull()
    joined = marked.withColumn("_shuffle_key", F.when(apart, spread).otherwise(F.col(key).cast("string"))).join(
        usual, F.col("_shuffle_key") == F.col("_usual_key"), "left")
    chosen = F.when(F.col("_hot"), F.col("_hot_value")).otherwise(F.col(value))
    return joined.withColumn(value, chosen).select(*[c for c in rows.columns if c != value], value)


def attach_clustered(
    rows: DataFrame, keyed: DataFrame, key: str, value: str, weight: str, then: Callable[[DataFrame], DataFrame] = lambda df: df,
    hot_rows: int = HOT_ROWS, most_hot: int = BROADCAST_ROWS, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``attach_by_key`` for written tables, followed by ``then``, which works inside the groups of ``key``.

    The rows are shuffled once, by ``key``, into a number of parts that follows
    theirs: neither the join nor a grouping by ``key`` and other columns in
    ``then`` shuffles or sorts them again.  Rows of hot keys and rows without a
    key stay out of this shuffle; ``then`` gets them apart and is planned there
    like any other query.
    """
    spark = rows.sparkSession
    keyed = keyed.select(key, value, weight)
    heavy = F.col(weight) >= hot_rows
    total, apart = keyed.agg(F.sum(weight), F.sum(F.when(heavy | F.col(key).isNull(), F.col(weight)))).first()
    hot = keyed.filter(heavy).orderBy(F.desc(weight), key).limit(most_hot).select(
        F.col(key).alias("_key"), F.col(value).alias("_hot_value"), F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key") if apart else None
    columns = [*[c for c in rows.columns if c != value], value]

    usual = marked.filter(F.col("_hot").isNull() & F.col(key).isNotNull()) if apart else rows
    parts = math.ceil((total or 0) / task_rows)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        usual = usual.repartition(parts, key)
    own = keyed.filter(F.col(key).isNotNull()).select(key, value).hint("shuffle_hash")
    result = then(usual.join(own, key, "left").select(*columns))
    if apart:
        other = marked.filter(F.col("_hot") | F.col(key).isNull()).withColumn(value, F.col("_hot_value"))
        result = result.unionByName(then(other.select(*columns)))
    return result
