"""Table operations: write, upsert, change feed, snapshots, constraints, logs, layout."""
from __future__ import annotations

import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

FEED_COLUMN = "_change_type"


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """overwrite replaces rows and schema; append conforms to the schema already there."""
    spark = df.sparkSession
    if mode == "append":
        existing = _existing_schema(spark, path)
        df = conform(df, existing) if existing is not None else df
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _existing_schema(spark: SparkSession, path: str) -> T.StructType | None:
    try:
        schema = spark.read.parquet(path).schema
        return schema if schema.fields else None
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorder, add missing nullable columns and cast safely; a column the schema lacks is an error."""
    extra = sorted(set(df.columns) - set(schema.names))
    if extra:
        raise ValueError(f"columns not in the table schema: {extra}")
    return df.to(schema)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Create an empty typed table unless one is there, and read it."""
    if _existing_schema(spark, path) is None:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def append_log(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append typed rows to a log that never rewrites earlier rows."""
    conform(df, schema).write.mode("append").parquet(path)


# --- upsert and change feed ---------------------------------------------------------

def assert_single_source(source: DataFrame, key: str) -> None:
    if not source.groupBy(key).count().filter(F.col("count") > 1).limit(1).isEmpty():
        raise ValueError(f"several source rows for one {key}")


def merge_upsert(target: DataFrame, source: DataFrame, key: str, check: bool = True,
                 source_keys: DataFrame | None = None) -> DataFrame:
    """Matched rows take the source's values in every column, other source rows are added.

    NULL is a key like any other: it matches NULL.

    The target is read once against the keys of the source (a small side is
    broadcast by size) and is never joined with the source's wide rows.  The
    source itself is evaluated for its keys and again for its rows: where that
    is costly (a model, an encoder), pass the keys from elsewhere as
    ``source_keys`` or write the source first.
    """
    if check:
        assert_single_source(source, key)
    keys = (source if source_keys is None else source_keys).select(F.col(key).alias("_source_key"))
    kept = target.join(keys, F.col(key).eqNullSafe(F.col("_source_key")), "left_anti").select(*target.columns)
    return kept.unionByName(source.select(*target.columns))


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Row-level difference of two snapshots with a unique key.

    ``_change_type`` is insert, delete, update_preimage or update_postimage.
    Comparison is NULL-safe; a column known to one snapshot only is NULL in the
    other.  Both snapshots meet once on the key and unchanged rows are dropped
    before the images are emitted.
    """
    columns = [key, *[c for c in new.columns if c != key]]
    columns += [c for c in old.columns if c not in columns]
    types = {**{f.name: f.dataType for f in old.schema}, **{f.name: f.dataType for f in new.schema}}

    def image(df: DataFrame, name: str) -> DataFrame:
        fields = [(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns]
        return df.select(F.col(key).alias(f"{name}_key"), F.struct(*fields).alias(name))

    pairs = image(old, "_old").join(image(new, "_new"), F.col("_old_key").eqNullSafe(F.col("_new_key")), "full_outer")
    inserted, deleted = F.col("_old").isNull(), F.col("_new").isNull()

    def entry(kind: str, side: str) -> Column:
        return F.struct(F.lit(kind).alias(FEED_COLUMN), F.col(side).alias("row"))

    entries = (
        F.when(inserted, F.array(entry("insert", "_new")))
        .when(deleted, F.array(entry("delete", "_old")))
        .otherwise(F.array(entry("update_preimage", "_old"), entry("update_postimage", "_new"))))
    changed = pairs.filter(~F.col("_old").eqNullSafe(F.col("_new")))
    flat = changed.select(F.explode(entries).alias("e"))
    return flat.select(F.col(f"e.{FEED_COLUMN}").alias(FEED_COLUMN), F.col("e.row.*"))


def changed_keys(feed: DataFrame, key: str) -> DataFrame:
    """Keys whose new version has to be processed."""
    return feed.filter(F.col(FEED_COLUMN).isin("insert", "update_postimage")).select(key).distinct()


#: JSON cuts timestamps to milliseconds unless told otherwise.
MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def changed_between(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``changed_keys(change_feed(...))`` when only the keys are wanted.

    Rows meet as key and SHA-256 of their values, so wide rows and long texts
    are not shuffled.
    """
    columns = sorted({c for c in (*old.columns, *new.columns) if c != key})

    def digest(df: DataFrame, name: str) -> DataFrame:
        known = F.to_json(F.struct(*[c for c in columns if c in df.columns]), MICROSECONDS)
        return df.select(key, F.unhex(F.sha2(known, 256)).alias(name))

    before = digest(old, "_old").withColumnRenamed(key, "_old_key")
    both = digest(new, "_new").join(before, F.col(key).eqNullSafe(F.col("_old_key")), "left")
    return both.filter(~F.col("_new").eqNullSafe(F.col("_old"))).select(key).distinct()


def apply_feed(old: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The new snapshot from the old one and its feed."""
    untouched = old.join(feed.select(key).distinct(), key, "left_anti")
    arrived = feed.filter(F.col(FEED_COLUMN).isin("insert", "update_postimage")).drop(FEED_COLUMN)
    return untouched.unionByName(arrived, allowMissingColumns=True)


# --- snapshots -------------------------------------------------------------------------

def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions (a version without its success marker is ignored)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def _create_once(fs, path) -> bool:
    """Create an empty file that must not exist; whether this call made it.

    Stores such as HDFS do this atomically.  The local file system's adapter
    doesn't, so there the operating system is asked.
    """
    if fs.getUri().getScheme() != "file":
        return fs.createNewFile(path)
    name = path.toUri().getPath()
    os.makedirs(os.path.dirname(name), exist_ok=True)
    try:
        os.close(os.open(name, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        return False
    return True


def _claim(spark: SparkSession, path: str) -> int:
    """Take the next version for this writer alone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    version = max(snapshot_versions(spark, path), default=0) + 1
    while not _create_once(fs, jvm.org.apache.hadoop.fs.Path(root, f"_claims/{version}-of-writer")):
        version += 1
    return version


def snapshot_write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write the next version beside the earlier ones and return its number.

    Two writers never share a version.  One that fails leaves its number unused.
    """
    version = _claim(df.sparkSession, path)
    writer = df.write.mode("overwrite")  # what an earlier layout may have left there without success marker
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/version={version}")
    return version


def compact(spark: SparkSession, path: str, key: str, schema: T.StructType) -> int:
    """Write a table of increments as one new full version; later reads start there.  Returns the version."""
    version = snapshot_write(increment_read(spark, path, key, schema), path)
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/_BASE")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(marker)
    return version


def _base_version(spark: SparkSession, path: str, versions: list[int]) -> int:
    """The newest full version: the last compacted one, else the first."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for version in reversed(versions[1:]):
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/_BASE")):
            return version
    return versions[0]


def snapshot_read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version, by default the newest committed one."""
    versions = snapshot_versions(spark, path)
    if not versions:
        raise ValueError(f"no committed version under {path}")
    wanted = versions[-1] if version is None else version
    if wanted not in versions:
        raise ValueError(f"version {wanted} is not committed; have {versions}")
    return spark.read.parquet(f"{path}/version={wanted}")


def increment_read(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """A table kept as a full version (the first, or the last compacted) plus versions that hold only rewritten rows.

    The newest row of a key wins.  The base is read against the keys of the
    (small) increments, so neither an upsert nor a read shuffles the wide base.
    """
    versions = snapshot_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    full = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def one(version: int) -> DataFrame:
        return spark.read.schema(full).parquet(f"{path}/version={version}")

    first = _base_version(spark, path, versions)
    base, versions = one(first), [v for v in versions if v > first]
    if not versions:
        return base
    later = reduce(lambda a, b: a.unionByName(b), [one(v).withColumn("_version", F.lit(v)) for v in versions])
    newest = later.groupBy(key).agg(F.max_by(F.struct(*schema.names), "_version").alias("_row")).select("_row.*")
    return base.join(newest.select(key), key, "left_anti").select(*schema.names).unionByName(newest)


def snapshot_history(spark: SparkSession, path: str) -> DataFrame:
    """version, rows per committed version."""
    parts = [spark.read.parquet(f"{path}/version={v}").agg(F.count("*").alias("rows"))
             .select(F.lit(v).alias("version"), "rows") for v in snapshot_versions(spark, path)]
    if not parts:
        return spark.createDataFrame([], "version int, rows long")
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- constraints, layout, inventory -------------------------------------------------------

def check_constraints(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """Reject the table if a predicate is FALSE for any row; NULL passes, as in SQL.

    The check is part of the row's own projection, so it costs no extra pass and
    stops the job before a bad row is written.
    """
    for name, predicate in constraints.items():
        message = F.lit(f"constraint violated: {name}")
        df = df.filter(F.when(F.coalesce(predicate, F.lit(True)), True).otherwise(
            F.raise_error(message).cast("boolean")))
    return df


def constraint_report(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """constraint_name, violations: one aggregate."""
    counted = df.agg(*[F.count_if(~F.coalesce(p, F.lit(True))).alias(n) for n, p in constraints.items()])
    return counted.unpivot([], list(constraints), "constraint_name", "violations")


def cluster_for_lookup(df: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """Range-partition and sort before a write, so row-group statistics prune point lookups."""
    ranged = df.repartitionByRange(n, *columns) if n else df.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


def table_inventory(tables: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """table_name, rows, present; a missing table is reported, not an error."""
    def one(name: str, df: DataFrame | None) -> DataFrame:
        if df is None:
            return spark.createDataFrame([(name, 0, False)], "table_name string, rows long, present boolean")
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(True).alias("present"))

    return reduce(lambda a, b: a.unionByName(b), [one(n, d) for n, d in tables.items()])


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    return None if _existing_schema(spark, path) is None else spark.read.parquet(path)


def calibration_stats(facts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """stat_key, stat_value: every fact is one aggregate of its table."""
    by_table: dict[int, tuple[DataFrame, list[Column]]] = {}
    for name, (df, value) in facts.items():
        by_table.setdefault(id(df), (df, []))[1].append(value.cast("double").alias(name))
    rows = []
    for df, values in by_table.values():
        wide = df.agg(*values)
        rows.append(wide.unpivot([], wide.columns, "stat_key", "stat_value"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def stats_lookup(stats: DataFrame, key: str, default: float) -> Column:
    """One fact as a scalar column, ``default`` where it is missing."""
    value = stats.filter(F.col("stat_key") == key).agg(F.max("stat_value")).scalar()
    return F.coalesce(value, F.lit(default))
