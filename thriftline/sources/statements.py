"""Statement files, batch and streaming, with rescued rows and ingest metadata."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .schemas import STATEMENTS

CORRUPT = "_corrupt_record"
RESCUED = "_rescued_data"


def _reader(reader, schema: T.StructType, rescue: bool, header: bool = True):
    if rescue:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).option("header", header)


def read_statements(
    spark: SparkSession, path: str, schema: T.StructType = STATEMENTS, rescue: bool = False, header: bool = True,
) -> DataFrame:
    """CSV with text amounts, by default with a header; the schema is given, so no inference pass over the files."""
    df = _reader(spark.read, schema, rescue, header).csv(path)
    return rescue_malformed(df) if rescue else df


def stream_statements(spark: SparkSession, directory: str, schema: T.StructType = STATEMENTS,
                      max_files: int = 1000, rescue: bool = True) -> DataFrame:
    """Existing and new CSV files of a folder, at most ``max_files`` per micro-batch."""
    reader = _reader(spark.readStream, schema, rescue).option("maxFilesPerTrigger", max_files)
    df = reader.csv(directory)
    return rescue_malformed(df) if rescue else df


def rescue_malformed(df: DataFrame, casts: dict[str, F.Column] | None = None) -> DataFrame:
    """Keep what did not parse in ``_rescued_data`` instead of failing.

    A record that does not fit the schema is kept as its raw line.  With
    ``casts`` (column -> parsed value) a value that is present but does not
    parse is kept as JSON under its column name.
    """
    pieces = []
    if CORRUPT in df.columns:
        pieces.append(F.col(CORRUPT))
    if casts:
        broken = {c: F.when(F.col(c).isNotNull() & parsed.isNull(), F.col(c)).alias(c) for c, parsed in casts.items()}
        as_json = F.to_json(F.struct(*broken.values()))
        pieces.append(F.when(as_json != "{}", as_json))
    rescued = F.coalesce(*pieces) if pieces else F.lit(None).cast("string")
    out = df.withColumn(RESCUED, rescued)
    return out.drop(CORRUPT) if CORRUPT in out.columns else out


def with_ingest_metadata(df: DataFrame) -> DataFrame:
    """Ingest time, source file and its modification time (file sources only)."""
    return df.select(
        "*", F.current_timestamp().alias("ingestion_timestamp"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("file_modification_time"))


def evolve_schema(known: T.StructType, observed: T.StructType) -> T.StructType:
    """The known columns followed by columns seen for the first time; nothing is dropped or retyped."""
    names = set(known.names)
    return T.StructType([*known.fields, *[f for f in observed.fields if f.name not in names]])


def union_evolving(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column missing on one side is NULL there."""
    return a.unionByName(b, allowMissingColumns=True)
