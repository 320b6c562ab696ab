import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thriftline.operators.clean import enrich
from thriftline.plans.workspace import new_path
from thriftline.sources import buckets as tables, schemas
from thriftline.sources.buckets import ConcurrentWrite, bucket_manifest, bucketed_read
from thriftline.streaming import feature_state, ingest

WORDS = ["SALARY CREDIT ACME", "UPI/SWIGGY/FOOD", "ATM WDL", "EMI HDFC", "PMKISAN", "BUSINESS RECEIPT", "ZOMATO PAYOUT", "SIP MF", ""]


@pytest.fixture(scope="module")
def silver(spark):
    source, rows = random.Random(3), []
    for i in range(400):
        day = dt.date(2024, source.randint(1, 6), source.randint(1, 28)) if i % 50 else None
        user = f"u{source.randint(0, 9)}" if i % 7 else "hot"
        credit = i % 3 == 0
        rows.append((i, user if i % 90 else None, day, source.choice(WORDS), *((0.0, round(source.uniform(1, 9e4), 2)) if credit else (
            round(source.uniform(1, 9e3), 2), 0.0)), 100.0 * i))
    raw = spark.createDataFrame(rows, "i int, user_id string, day date, particulars string, w double, d double, b double")
    shown = raw.select("i", *[{"user_id": F.col("user_id"), "date": F.date_format("day", "dd-MM-yyyy"), "particulars": F.col("particulars"),
                               "withdrawal": F.col("w").cast("string"), "deposit": F.col("d").cast("string"), "balance": F.col("b").cast("string")
                               }.get(n.lower(), F.lit(None).cast("string")).alias(n) for n in schemas.STATEMENTS.names])
    return enrich(shown, "dlt").cache()


def rounded(df):
    cells = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(cells, r)) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_state_of_batches_equals_the_whole(spark, silver):
    """Five batches that cut across users and months: the last one goes back to old months."""
    at, whole = new_path(spark, "state"), ingest.gold_from_silver(silver)
    for number in range(5):
        feature_state.update_features(silver.filter(F.col("i") * 7 % 5 == number), at, number, buckets=4)
    assert rounded(feature_state.read_features(spark, at, whole.schema)) == rounded(whole)


def test_a_batch_counts_once(spark, silver, monkeypatch):
    """A batch given twice, and one that fails between state and features."""
    at, whole = new_path(spark, "state"), ingest.gold_from_silver(silver)
    first, second = silver.filter("i < 200"), silver.filter("i >= 200")
    for batch, number in ((first, 0), (first, 0)):
        feature_state.update_features(batch, at, number, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(feature_state, "features", lambda state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            feature_state.update_features(second, at, 1, buckets=4)
    feature_state.update_features(second, at, 1, buckets=4)
    assert rounded(feature_state.read_features(spark, at, whole.schema)) == rounded(whole)


def test_only_buckets_of_the_batch_are_written(spark, silver):
    at = new_path(spark, "state")
    feature_state.update_features(silver, at, 0, buckets=16)
    before = {r["bucket"]: r["folder"] for r in bucket_manifest(spark, f"{at}/features").collect()}
    feature_state.update_features(silver.filter("user_id = 'u1'"), at, 1, buckets=16)
    after = {r["bucket"]: r["folder"] for r in bucket_manifest(spark, f"{at}/features").collect()}
    assert sum(before[b] != after[b] for b in before) == 1 < len(before)
    feature_state.update_features(silver.filter("false"), at, 2, buckets=16)
    assert {r["bucket"]: r["folder"] for r in bucket_manifest(spark, f"{at}/features").collect()} == after


def test_tasks_follow_the_rows_and_rows_meet_in_one_shuffle(spark, silver, monkeypatch):
    """Two batches into one bucket, more rows than a task should write; months of the two are hashed, not collected."""
    at, whole, plans = new_path(spark, "state"), ingest.gold_from_silver(silver), []
    merge = feature_state.merge_months
    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    monkeypatch.setattr(feature_state, "merge_months", lambda *a: plans.append(merge(*a)) or plans[-1])
    for number in range(2):
        feature_state.update_features(silver.filter(F.col("i") % 2 == number), at, number, buckets=1)
    plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ObjectHashAggregate" not in plan
    state = spark.read.parquet(bucket_manifest(spark, f"{at}/state").first()["folder"])
    assert 3 < len(state.inputFiles()) < state.count() == state.select("user_id", "month").distinct().count()
    digits = lambda df: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())
    assert digits(feature_state.read_features(spark, at, whole.schema)) == digits(whole)


def test_spread_survives_many_parts(spark):
    """Large incomes that hardly differ, one row per batch: squares of sums would lose the difference."""
    schema = feature_state.month_rows(enrich(spark.createDataFrame([], schemas.STATEMENTS), "dlt")).schema
    values = [1e9 + 0.01 * i for i in range(6)]
    row = lambda x: {**{f.name: 0 for f in schema}, "user_id": "u", "month": dt.date(2024, 1, 1), "first_date": None, "last_date": None,
                     "_k": 1, "_mean": x, "_var": 0.0, "_high": x, "_low": x}
    def as_rows(xs):
        return spark.createDataFrame([tuple(type_of(f, row(x)[f.name]) for f in schema) for x in xs], schema)
    def type_of(f, v):
        return float(v) if f.dataType.typeName() == "double" and v is not None else v
    state = as_rows(values[:1])
    for x in values[1:]:
        state = feature_state.merge_months(state.unionByName(as_rows([x])))
    r = state.first()
    assert r["_k"] == 6 and r["_mean"] == pytest.approx(1e9 + 0.025) and r["_var"] == pytest.approx(0.0001 * 35 / 12, rel=1e-3)
