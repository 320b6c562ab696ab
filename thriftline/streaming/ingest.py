"""Streaming ingest: files -> bronze -> silver, then batch features on the sink."""
from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.clean import enrich
from ..operators.quality import Expectation, holds, keep_rows
from ..operators.statement_features import statement_features_dlt, user_personas, attach_persona
from ..sources.statements import stream_statements, with_ingest_metadata


def append_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None, name: str | None = None) -> StreamingQuery:
    """Append to a Parquet sink, exactly once through checkpoint and file log.

    Without ``every`` the query takes what is there and stops; with a period
    such as ``"10 seconds"`` it keeps running.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def bronze_stream(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    return stream_statements(spark, directory, max_files=max_files).transform(with_file_columns)


def with_file_columns(df: DataFrame) -> DataFrame:
    return with_ingest_metadata(df)


def silver_stream(bronze: DataFrame, rules: list[Expectation], null_passes: bool = True,
                  observe_as: str | None = "expectations") -> DataFrame:
    """Stateless cleaning and expectations on a streaming (or batch) frame.

    Broken rules are counted per micro-batch through an observation, so warn
    metrics cost no second pass.
    """
    rows = enrich(bronze, "dlt")
    if observe_as:
        counts = [F.count_if(~holds(r, null_passes)).alias(r.name) for r in rules]
        rows = rows.observe(observe_as, F.count("*").alias("input_rows"), *counts)
    return keep_rows(rows, rules, null_passes)


PROGRESS = "batch_id long, input_rows long, trigger_ms long, observed map<string, long>"


class ProgressLog(StreamingQueryListener):
    """Writes one row per micro-batch of one query, observed counts included.

    Spark itself keeps only the newest records of a query.  Rows are written in
    portions and at the query's end, so a run of any length is logged whole.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, portion: int = 50):
        self.spark, self.name, self.path, self.portion = spark, name, path, portion
        self.rows: list[tuple] = []
        self.query_id = None
        self.lock, self.ended = threading.Lock(), threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query_id = event.id

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name:
            return
        counts = {k: int(v) for row in progress.observedMetrics.values() for k, v in row.asDict().items()}
        with self.lock:
            self.rows.append((progress.batchId, progress.numInputRows, int(progress.durationMs.get("triggerExecution", 0)), counts))
            full = len(self.rows) >= self.portion
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        if event.id == self.query_id:
            self.ended.set()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)


def stream_progress(spark: SparkSession, log: str) -> DataFrame:
    """batch_id, input_rows, trigger_ms and observed counts of every micro-batch that read rows."""
    return spark.read.schema(PROGRESS).parquet(log).filter("input_rows > 0")


def observed_counts(spark: SparkSession, log: str) -> DataFrame:
    """batch_id, name, value: what a stream observed, such as the rows that break each expectation."""
    return stream_progress(spark, log).select("batch_id", F.explode("observed").alias("name", "value"))


def run_available(df: DataFrame, path: str, checkpoint: str, progress: str | None = None) -> StreamingQuery:
    """Process everything that is there and wait for the end; ``progress`` names a table for the log of its batches."""
    spark, log = df.sparkSession, None
    if progress:
        log = ProgressLog(spark, f"run-{uuid.uuid4().hex[:12]}", progress)
        spark.streams.addListener(log)
    try:
        query = append_stream(df, path, checkpoint, name=log.name if log else None)
        query.awaitTermination()
        if log:
            log.ended.wait(60)  # events come in order: nothing is missing once the end is told
            log.flush()
    finally:
        if log:
            spark.streams.removeListener(log)
    failure = query.exception()
    if failure is not None:
        raise failure
    return query


def gold_from_silver(silver: DataFrame) -> DataFrame:
    """Personas and the dlt feature table from the streamed silver sink (batch read)."""
    return statement_features_dlt(attach_persona(silver, user_personas(silver, "dlt")))
