"""Streams whose files gain columns: a log of schemas, and batches read by what each file's header names."""
from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.statements import evolve_schema, read_statements, with_ingest_metadata
from ..sources.tables import append_log, try_read

# The columns of Spark's binary file source; the content is never read
FILES = "path string, modificationTime timestamp, length long, content binary"
LOG = T.StructType([T.StructField("version", T.LongType()), T.StructField("batch_id", T.LongType()),
                    T.StructField("schema", T.StringType())])
BATCH = "_batch_id"


def schema_log(spark: SparkSession, path: str) -> DataFrame | None:
    """version, batch_id and schema (JSON) of every widening, or None before the first."""
    return try_read(spark, path)


def newest_schema(spark: SparkSession, path: str) -> tuple[int, T.StructType] | None:
    log = schema_log(spark, path)
    row = log.agg(F.max(F.struct("version", "schema")).alias("newest")).first() if log is not None else None
    if row is None or row["newest"] is None:
        return None
    return row["newest"]["version"], T.StructType.fromJson(json.loads(row["newest"]["schema"]))


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The columns of a file's header line; nothing further of the file is read."""
    return tuple(spark.read.option("header", True).csv(path).columns)


def _schema_of(header: tuple[str, ...], known: T.StructType) -> T.StructType:
    """A header's columns under their known names and types, whatever their case; new ones are text."""
    fields = {f.name.lower(): f for f in known}
    return T.StructType([fields.get(c.lower(), T.StructField(c, T.StringType())) for c in header])


def write_batch(spark: SparkSession, paths: list[str], batch_id: int, sink: str, log: str, declared: T.StructType) -> None:
    """Read some files, each by its own header, and write them as one batch under the schema known by then.

    Files of one header are read together.  New columns are logged before rows
    are written.  A repeated batch replaces what it wrote, and finds its
    columns in the log.
    """
    version, known = newest_schema(spark, log) or (0, None)
    schema = known or declared
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: _header(spark, p), paths))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(paths, headers):
        if header:  # else an empty file
            groups.setdefault(header, []).append(path)
    for header in sorted(groups):
        schema = evolve_schema(schema, _schema_of(header, schema))
    if schema != known:
        append_log(spark.createDataFrame([(version + 1, batch_id, schema.json())], LOG), log, LOG)
    parts = [with_ingest_metadata(read_statements(spark, files, _schema_of(header, schema), rescue=True))
             for header, files in groups.items()]
    if parts:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rows.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")


def run_evolving(spark: SparkSession, directory: str, sink: str, log: str, checkpoint: str, declared: T.StructType,
                 max_files: int = 1000) -> None:
    """Take all CSV files that have come since the last run, at most ``max_files`` per micro-batch.

    Files may name more columns than ``declared``, fewer, or in another order:
    the schema widens within the run and is kept for the next.  The checkpoint
    holds which files belong to which batch, so every file is written once.
    A file without a line is passed over.
    """
    files = (spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files)
             .load(directory).select("path"))

    def take(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())  # at most max_files
        write_batch(batch.sparkSession, paths, batch_id, sink, log, declared)

    query = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# What read and write of a batch add to a file's own columns
ADDED = T.StructType([
    T.StructField("_rescued_data", T.StringType()), T.StructField("ingestion_timestamp", T.TimestampType()),
    T.StructField("source_file", T.StringType()), T.StructField("file_modification_time", T.TimestampType())])


def read_evolved(spark: SparkSession, sink: str, log: str) -> DataFrame:
    """All batches under the newest schema; a column that a batch's files didn't have is NULL there."""
    newest = newest_schema(spark, log)
    if newest is None:
        raise ValueError(f"no schema logged under {log}")
    wanted = T.StructType([*newest[1].fields, *ADDED.fields])
    if try_read(spark, sink) is None:
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).parquet(sink).select(*[F.col(f"`{c}`") for c in wanted.names])
