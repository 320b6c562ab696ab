"""Where intermediate tables go, and how lineage is cut."""
from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
#: Rows per part of a shuffle of wide rows.
TASK_ROWS = 250_000


@lru_cache(maxsize=None)
def _local_root(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="thriftline-")


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master, where every task
    runs on the same machine; elsewhere a missing setting is an error.
    """
    named = spark.conf.get(SHARED_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR} to a folder all executors can reach")
    return _local_root(context.applicationId)


_MADE: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Owner of what is written to the shared folder inside the block: it is dropped when the block ends.

    Results must have been written elsewhere, or collected, by then.
    """
    before = len(_MADE)
    try:
        yield
    finally:
        made, _MADE[before:] = _MADE[before:], []
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def wide_rows(spark: SparkSession, n: int = 0, short_methods: bool = False) -> Iterator[None]:
    """Settings for groupings of ``n`` rows with some fifty measures or more, for plans that run inside the block.

    A task takes smaller pieces of a file and, after a shuffle, about
    ``TASK_ROWS`` rows: what it keeps in memory doesn't grow with the table.

    Spark fuses a stage into one method; beyond 8,000 bytes of bytecode HotSpot
    only interprets it, several times slower for every row.  With
    ``short_methods`` such stages run operator by operator; measure whether it helps.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_ROWS))
    wanted = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.shuffle.partitions": str(parts)}
    if short_methods:
        wanted["spark.sql.codegen.hugeMethodLimit"] = "8000"
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write_through(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    Use before a second reader of an expensive result: the readers scan only
    the columns they need and a lost executor costs a re-read, not a rerun.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
