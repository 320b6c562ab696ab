import pytest
from pyspark.sql import functions as F

from thriftline.catalogue import inputs, layers
from thriftline.operators import quality, statement_features as sf
from thriftline.plans.workspace import new_path
from thriftline.sources import statements as st
from thriftline.streaming import ingest


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    path = new_path(spark, "csv")
    rows = inputs.statements(spark, sf_dir).withColumn("balance", F.translate("balance", "-", ""))
    rows.repartition(4).write.option("header", True).csv(path)
    return path


def rows_of(df):
    return sorted(map(str, df.collect()))


def rules():
    return quality.statement_expectations(layers.AS_OF)


def test_stream_equals_batch(spark, source):
    sink = new_path(spark, "silver")
    log = new_path(spark, "log")
    ingest.run_available(
        ingest.silver_stream(st.stream_statements(spark, source, max_files=1), rules()), sink, new_path(spark, "cp"), progress=log)
    assert ingest.stream_progress(spark, log).count() == 4
    batch = ingest.silver_stream(st.read_statements(spark, source, rescue=True), rules(), observe_as=None)
    streamed = spark.read.parquet(sink)
    assert rows_of(streamed.select(*batch.columns)) == rows_of(batch)
    gold = ingest.gold_from_silver(streamed)
    want = sf.statement_features_dlt(sf.attach_persona(batch, sf.user_personas(batch, "dlt")))
    assert len(gold.columns) == 74 and gold.count() == want.count()


def test_restart_takes_only_new_files(spark, sf_dir, source):
    folder, sink, checkpoint = new_path(spark, "in"), new_path(spark, "bronze"), new_path(spark, "cp")
    rows = st.read_statements(spark, source)
    rows.limit(50).write.option("header", True).csv(folder)
    for _ in range(2):  # the second run finds nothing new
        ingest.run_available(ingest.bronze_stream(spark, folder), sink, checkpoint)
    assert spark.read.parquet(sink).count() == 50
    rows.limit(20).write.mode("append").option("header", True).csv(folder)
    ingest.run_available(ingest.bronze_stream(spark, folder), sink, checkpoint)
    bronze = spark.read.parquet(sink)
    assert bronze.count() == 70 and bronze.filter("source_file IS NULL OR ingestion_timestamp IS NULL").isEmpty()


def test_warn_metrics_come_with_the_batch(spark, source):
    log = new_path(spark, "log")
    ingest.run_available(ingest.silver_stream(st.stream_statements(spark, source, max_files=1), rules()), new_path(spark, "silver"),
                         new_path(spark, "cp"), progress=log)
    observed = dict(ingest.observed_counts(spark, log).groupBy("name").agg(F.sum("value")).collect())
    total, stale = observed["input_rows"], observed["recent_transactions"]
    batch = ingest.enrich(st.read_statements(spark, source, rescue=True), "dlt")
    want = {r["rule"]: r["failed"] for r in quality.expectation_metrics(batch, rules()).collect()}
    assert total == batch.count() and stale == want["recent_transactions"]


def test_more_batches_than_spark_remembers(spark, tmp_path):
    for i in range(130):
        (tmp_path / f"{i}.csv").write_text(f"user_id,date,particulars,chq_num,withdrawal,deposit,balance\nUSR-{i},01-01-2024,A,,5,,10\n")
    log, sink = new_path(spark, "log"), new_path(spark, "bronze")
    ingest.run_available(ingest.bronze_stream(spark, str(tmp_path), max_files=1), sink, new_path(spark, "cp"), progress=log)
    batches = ingest.stream_progress(spark, log)
    assert batches.count() == 130 and batches.agg(F.sum("input_rows")).first()[0] == 130 == spark.read.parquet(sink).count()


def test_negative_balance_fails_the_stream(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "user_id,date,particulars,chq_num,withdrawal,deposit,balance\nUSR-1,01-01-2024,A,,5,,-10\n")
    sink = new_path(spark, "silver")
    with pytest.raises(Exception, match="critical_no_negative_balance"):
        ingest.run_available(ingest.silver_stream(st.stream_statements(spark, str(tmp_path)), rules()), sink, new_path(spark, "cp"))
