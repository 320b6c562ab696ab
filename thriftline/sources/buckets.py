"""Tables in hash buckets: an upsert rewrites only the buckets that hold one of its keys."""
from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .tables import _create_once, change_feed, conform, merge_upsert, snapshot_read, snapshot_versions

#: Rows that a task writes on average where their number decides on the tasks.
TASK_ROWS = 150_000
MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType()),
                         T.StructField("buckets", T.IntegerType())])


class ConcurrentWrite(Exception):
    """Another writer has taken the version that would follow the one this upsert was built on."""


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; NULL keys share one bucket."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """bucket, folder and number of buckets of a version, by default the newest."""
    return snapshot_read(spark, f"{path}/manifest", version)


def _folders(spark: SparkSession, path: str) -> tuple[int, dict[int, str], int | None]:
    """The newest version (0: none), the folder of each of its buckets, and the table's number of buckets."""
    versions = snapshot_versions(spark, f"{path}/manifest")
    if not versions:
        return 0, {}, None
    rows = bucket_manifest(spark, path, versions[-1]).collect()  # one per bucket
    return versions[-1], {r["bucket"]: r["folder"] for r in rows}, rows[0]["buckets"] if rows else None


def _read(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    full = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.read.schema(full).parquet(*folders) if folders else spark.createDataFrame([], full)


def _commit(spark: SparkSession, path: str, version: int, folders: dict[int, str], buckets: int) -> None:
    """Make a version visible, unless another writer has claimed its number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not _create_once(fs, spark._jvm.org.apache.hadoop.fs.Path(root, f"_claims/{version}-of-writer")):
        raise ConcurrentWrite(f"version {version} of {path} is taken")
    rows = [(bucket, folder, buckets) for bucket, folder in sorted(folders.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _upsert_once(spark: SparkSession, path: str, source: DataFrame, key: str, schema: T.StructType,
                 buckets: int, files: int | None, merge: Callable[[DataFrame], DataFrame] | None) -> int:
    version, folders, kept = _folders(spark, path)
    buckets = kept or buckets
    touched = [r["bucket"] for r in source.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()]  # at most all buckets
    if not touched and version:
        return version
    old = _read(spark, [folders[b] for b in touched if b in folders], schema)
    source = conform(source, old.schema)
    if files is None:
        files = max(1, math.ceil((old.count() + source.count()) / max(len(touched), 1) / TASK_ROWS))
    rows = old.withColumn("_fresh", F.lit(False)).unionByName(source.withColumn("_fresh", F.lit(True))) if merge else merge_upsert(old, source, key)
    place = F.array_position(F.lit(touched or [0]), bucket_of(key, buckets)) - 1  # each bucket is dealt to ``files`` tasks of its own
    part = (place * files + F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(files))).cast("int")
    rows = rows.withColumns({"_bucket": bucket_of(key, buckets), "_part": part}).repartitionById(max(len(touched), 1) * files, "_part")
    data = f"{path}/data/{uuid.uuid4().hex}"
    (merge(rows) if merge else rows).select("_bucket", *old.columns).write.partitionBy("_bucket").parquet(data)
    _commit(spark, path, version + 1, {**folders, **{b: f"{data}/_bucket={b}" for b in touched}}, buckets)
    return version + 1


def bucketed_upsert(df: DataFrame, path: str, key: str, schema: T.StructType, buckets: int = 64, files: int | None = 1,
                    attempts: int = 5, merge: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Upsert rows with a unique key and return the table's version; the first call makes the table.

    Buckets without a key of ``df`` are neither read nor written; a bucket with
    one is merged and written anew, by ``files`` tasks (None: as many as make
    about ``TASK_ROWS`` rows each).  ``buckets`` is fixed by
    the first call: choose it so that a bucket is some hundred megabytes.  NULL
    is a key like any other.  ``df`` is read several times: write a costly one
    first.

    With ``merge`` a key may have several rows, and ``merge`` makes the new rows
    from the old ones and those of ``df`` (``_fresh``), after the only shuffle:
    a grouping by ``_part``, ``_bucket``, the key and more needs no other.

    A version appears whole or not at all.  Of two writers one commits, and the
    other merges again with what the first has written; after ``attempts``
    tries it raises ConcurrentWrite.  A writer lost after its claim and before
    its manifest leaves a claim that ``release_claim`` removes.
    """
    for attempt in range(attempts):
        try:
            return _upsert_once(df.sparkSession, path, df, key, schema, buckets, files, merge)
        except ConcurrentWrite:
            if attempt + 1 == attempts:
                raise
            time.sleep(0.5 * 2 ** attempt)
    raise ValueError("attempts must be positive")


def release_claim(spark: SparkSession, path: str) -> bool:
    """Remove the claim of a lost writer on the next version; only when no writer is at work.  Whether there was one."""
    version, _, _ = _folders(spark, path)
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_claims/{version + 1}-of-writer")
    return claim.getFileSystem(spark._jsc.hadoopConfiguration()).delete(claim, False)


def bucketed_read(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame | None = None,
                  key: str | None = None, whole: bool = False) -> DataFrame:
    """The newest version's rows; with ``keys`` (a frame with the column ``key``) only theirs, from buckets that may hold one.

    ``whole``: all rows of these buckets, without a join.
    """
    _, folders, buckets = _folders(spark, path)
    if keys is not None and buckets:
        wanted = keys.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()  # at most all buckets
        rows = _read(spark, [folders[r["bucket"]] for r in wanted if r["bucket"] in folders], schema)
        if whole:
            return rows
        asked = keys.select(F.col(key).alias("_asked"))
        return rows.join(asked, F.col(key).eqNullSafe(F.col("_asked")), "left_semi")
    return _read(spark, list(folders.values()), schema)


def bucketed_feed(spark: SparkSession, path: str, key: str, schema: T.StructType, old: int, new: int | None = None) -> DataFrame:
    """``change_feed`` between two versions; buckets that no upsert between them has touched are not read."""
    before, after = ({r["bucket"]: r["folder"] for r in bucket_manifest(spark, path, v).collect()} for v in (old, new))  # one per bucket
    written = [b for b in sorted({*before, *after}) if before.get(b) != after.get(b)]
    old_rows, new_rows = (_read(spark, [side[b] for b in written if b in side], schema) for side in (before, after))
    return change_feed(old_rows, new_rows, key)
