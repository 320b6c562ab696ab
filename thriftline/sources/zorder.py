"""Z-order layout: one set of files that prunes lookups by any of several columns."""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.joins import TASK_ROWS

#: Each column is cut into 2 ** BITS ranges of about as many distinct values.
BITS = 6


def range_starts(df: DataFrame, column: str, bits: int = BITS) -> list[Any]:
    """The starts of all but the first of at most ``2 ** bits`` ranges of the column's distinct values, ascending.

    Values are made distinct before they are dealt, so a hot key weighs as much
    as any other, and the driver receives one value per range.
    """
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    ranged = values.repartitionByRange(2 ** bits, "value").withColumn("part", F.spark_partition_id())
    return sorted(r["low"] for r in ranged.groupBy("part").agg(F.min("value").alias("low")).collect())[1:]


def range_number(value: Column, starts: list[Any]) -> Column:
    """How many of the ascending starts are at or below the value, found by halving; NULL is in the first range."""
    def between(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(value < F.lit(starts[middle]), between(first, middle)).otherwise(between(middle + 1, last))

    return F.when(value.isNull(), 0).otherwise(between(0, len(starts)))


def interleave(numbers: list[Column], bits: int = BITS) -> Column:
    """One number whose bits are those of all numbers in turn, the highest first."""
    z, width = F.lit(0).cast("long"), len(numbers)
    for bit in range(bits):
        for i, number in enumerate(numbers):
            one = F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("long")
            z = z.bitwiseOR(F.shiftleft(one, bit * width + width - 1 - i))
    return z


def zorder(df: DataFrame, columns: list[str], n: int | None = None, bits: int = BITS) -> DataFrame:
    """Rows dealt and sorted along the Z-curve over the columns' ranges.

    Inside a cell of the curve rows go by the columns and a hash of the row, so
    a cell or key of any size is spread over as many files as its rows need.
    ``df`` is counted, and read once per column for the ranges and once for the rows.
    Without ``n`` there are as many parts as Spark shuffles into, or more if they
    would hold over ``TASK_ROWS`` rows each.
    Columns named ``_range<i>``, ``_z`` and ``_tie`` are used inside.
    """
    hashable = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    names = [f"_range{i}" for i in range(len(columns))]
    ranged = df.withColumns({
        name: range_number(F.col(c), range_starts(df, c, bits)) for name, c in zip(names, columns)})
    laid = ranged.withColumns({"_z": interleave([F.col(n) for n in names], bits), "_tie": F.xxhash64(*hashable)})
    order = ["_z", *columns, "_tie"]
    if n is None:
        parts = -(-df.count() // TASK_ROWS)
        n = parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    dealt = laid.repartitionByRange(n, *order) if n else laid.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).drop(*names, "_z", "_tie")


def zorder_write(df: DataFrame, path: str, columns: list[str], n: int | None = None, bits: int = BITS) -> DataFrame:
    """Write the rows along the Z-curve, and beside them a manifest with each file's bounds; returns the manifest.

    The manifest holds per file: file, rows, and for every column its smallest
    and largest value and whether it has NULL there.
    """
    spark = df.sparkSession
    zorder(df, columns, n, bits).write.mode("overwrite").parquet(f"{path}/data")
    bounds = [b for i, c in enumerate(columns) for b in (
        F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}"), (F.count(c) < F.count("*")).alias(f"has_null{i}"))]
    written = spark.read.schema(df.schema).parquet(f"{path}/data").select("*", F.col("_metadata.file_path").alias("_file"))
    # bounds of strings alone would be aggregated by sorting all rows; beside a set, which the filter reads, they are hashed by file
    stats = written.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("rows"), *bounds, F.collect_set(F.lit(0)).alias("_hashed"))
    stats.filter(F.size("_hashed") == 1).drop("_hashed").write.mode("overwrite").parquet(f"{path}/manifest")
    # which column has which number
    spark.createDataFrame(list(enumerate(columns)), "number int, column string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/columns")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _numbers(spark: SparkSession, path: str) -> dict[str, int]:
    return {r["column"]: r["number"] for r in spark.read.parquet(f"{path}/columns").collect()}


def files_for(spark: SparkSession, path: str, ranges: dict[str, tuple[Any, Any]]) -> DataFrame:
    """The manifest's files that may hold rows inside all ranges (both ends included; None: open, and NULL is outside)."""
    numbers, files = _numbers(spark, path), manifest(spark, path)
    for column, (low, high) in ranges.items():
        i = numbers.get(column)
        if i is None:
            continue  # no bounds are kept for it: no file can be left out
        if low is not None:
            files = files.filter(F.col(f"high{i}") >= F.lit(low))
        if high is not None:
            files = files.filter(F.col(f"low{i}") <= F.lit(high))
    return files


def zorder_read(spark: SparkSession, path: str, ranges: dict[str, tuple[Any, Any]], schema: T.StructType | None = None) -> DataFrame:
    """The rows inside all ranges; only files whose bounds meet them are opened."""
    schema = schema or spark.read.parquet(f"{path}/data").schema
    names = [r["file"] for r in files_for(spark, path, ranges).select("file").collect()]  # one per file
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    for column, (low, high) in ranges.items():
        value = F.col(f"`{column}`")
        rows = rows.filter(value.isNotNull()) if low is None and high is None else rows
        rows = rows.filter(value >= F.lit(low)) if low is not None else rows
        rows = rows.filter(value <= F.lit(high)) if high is not None else rows
    return rows
