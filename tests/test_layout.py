"""Exact quantiles, Z-order files and streams whose files gain columns."""
import math

import pytest
from pyspark.sql import functions as F, types as T

from thriftline.operators.analytics import feature_summary, income_score_frame
from thriftline.operators.quantiles import exact_quantiles
from thriftline.plans.workspace import new_path
from thriftline.sources import tables, zorder
from thriftline.streaming import evolving

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def nearest_rank(values, share):
    ordered = sorted(values, key=lambda x: (math.isnan(x), x))
    return ordered[max(math.ceil(share * len(ordered)), 1) - 1]


# --- quantiles ---------------------------------------------------------------------------
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact_beyond_the_sketch(spark, accuracy):
    """300,000 rows: even, skewed by 300 orders of magnitude, and one value on a third of all rows."""
    i = F.col("id")
    df = spark.range(300_000).select(
        ((i * 7919) % 300_007).cast("double").alias("even"),
        F.pow(F.lit(10.0), ((i * 31) % 601 - 300).cast("double")).alias("skewed"),
        F.when(i % 3 == 0, 5.0).otherwise((i % 1000).cast("double") / 7).alias("hot"),
        F.when(i % 4 > 0, (i % 977).cast("int")).alias("gaps"))
    rows = df.toPandas()
    got = exact_quantiles(df, df.columns, SHARES, accuracy)
    for name in df.columns:
        values = rows[name].dropna().tolist()
        assert got[name] == [nearest_rank(values, s) for s in SHARES], name


def test_quantiles_of_odd_columns(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame(
        [(1.0, None, nan, -inf, -0.0), (None, None, 2.0, inf, 0.0), (2.0, None, nan, 1.0, None), (1.0, None, 1.0, None, None)],
        "a double, none double, `with nan` double, ends double, zero double")
    got = exact_quantiles(df, df.columns, [0.25, 0.5, 1.0])
    assert got["a"] == [1.0, 1.0, 2.0] and got["none"] == [None] * 3 and got["zero"] == [0.0] * 3
    assert got["with nan"][:2] == [1.0, 2.0] and math.isnan(got["with nan"][2])
    assert got["ends"] == [-inf, 1.0, inf]
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_feature_summary_and_income_limit_use_them(spark):
    df = spark.range(200_000).select(
        F.col("id").alias("user_id"), F.lit("p").alias("persona"), F.lit("Good").alias("score_category"),
        F.lit(600.0).alias("predicted_score"), F.sqrt(F.col("id") + 0.5).alias("avg_monthly_income"), F.lit(None).cast("double").alias("empty"))
    values = [math.sqrt(i + 0.5) for i in range(200_000)]
    rows = {r["feature"]: r for r in feature_summary(df, ["avg_monthly_income", "empty"]).collect()}
    row = rows["avg_monthly_income"]
    assert (row["n"], row["p25"], row["p50"], row["p75"]) == (200_000, *(nearest_rank(values, s) for s in (0.25, 0.5, 0.75)))
    assert rows["empty"]["n"] == 0 and rows["empty"]["p50"] is None
    limit = nearest_rank(values, 0.95)
    framed = income_score_frame(df)
    assert framed.select("income_limit").distinct().collect()[0][0] == limit
    assert framed.filter("in_view").count() == 190_000


# --- Z-order -----------------------------------------------------------------------------
def statements_of(spark, users=401, days=200):
    return spark.range(users * days).select(
        F.format_string("USR-%05d", (F.col("id") * 7) % users).alias("user_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % days).cast("int")).alias("date"),
        F.col("id").alias("amount"))


def test_both_columns_prune(spark):
    df, path = statements_of(spark), new_path(spark, "z")
    files = zorder.zorder_write(df, path, ["user_id", "date"], n=64)
    total = files.count()
    assert total == 64 and files.agg(F.sum("rows")).first()[0] == df.count()
    day = df.agg(F.min("date")).first()[0]
    for ranges, wanted in (({"user_id": ("USR-00123", "USR-00123")}, "user_id = 'USR-00123'"),
                           ({"date": (day, day)}, "date = (DATE '2024-01-01')")):
        opened = zorder.files_for(spark, path, ranges).count()
        assert opened <= total / 4, ranges  # a sort by (user_id, date) opens them all for a date
        got = zorder.zorder_read(spark, path, ranges)
        assert len(got.inputFiles()) == opened
        assert sorted(got.collect()) == sorted(df.filter(wanted).collect())
    plain = new_path(spark, "sorted")
    tables.write_table(tables.cluster_for_lookup(df, ["user_id", "date"], 64), plain)
    by_file = spark.read.parquet(plain).groupBy(F.input_file_name()).agg(F.min("date").alias("low"))
    assert by_file.filter(F.col("low") <= F.lit(day)).count() > total / 4


def test_one_user_with_most_rows_is_spread(spark):
    df = statements_of(spark).withColumn("user_id", F.when(F.col("amount") % 4 > 0, "USR-00001").otherwise(F.col("user_id")))
    files = zorder.zorder_write(df, new_path(spark, "z"), ["user_id", "date"], n=16)
    assert files.agg(F.max("rows")).first()[0] < df.count() / 16 * 2.5


def test_zorder_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(zorder, "TASK_ROWS", 100)
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    files = zorder.zorder_write(df, new_path(spark, "z"), ["k", "v"]).collect()
    assert 15 <= len(files) <= 20 and sum(r["rows"] for r in files) == 2000 and max(r["rows"] for r in files) < 400


def test_zorder_keeps_nulls_and_repeated_rows(spark):
    rows = [("a", 1), ("a", 1), (None, 2), ("b", None), (None, None)]
    df, path = spark.createDataFrame(rows, "k string, v int"), new_path(spark, "z")
    zorder.zorder_write(df, path, ["k", "v"], n=3)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, zorder.zorder_read(spark, path, {}).collect())) == sorted(map(str, rows))
    assert [tuple(r) for r in zorder.zorder_read(spark, path, {"k": ("b", None)}).collect()] == [("b", None)]
    assert len(zorder.zorder_read(spark, path, {"v": (None, None)}).collect()) == 3
    assert zorder.zorder_read(spark, path, {"k": ("x", "z")}).isEmpty()
    empty = new_path(spark, "z")
    zorder.zorder_write(df.limit(0), empty, ["k", "v"])
    assert zorder.zorder_read(spark, empty, {"k": ("a", "b")}, df.schema).isEmpty()


def test_range_numbers_and_interleaving(spark):
    starts = [10, 20, 30]
    df = spark.createDataFrame([(5,), (10,), (19,), (20,), (99,), (None,)], "v int")
    assert [r[0] for r in df.select(zorder.range_number(F.col("v"), starts)).collect()] == [0, 1, 1, 2, 3, 0]
    pair = spark.range(1).select(zorder.interleave([F.lit(0b101), F.lit(0b011)], 3).alias("z")).first()[0]
    assert pair == 0b100111


# --- streams with new columns ----------------------------------------------------------
DECLARED = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("amount", T.IntegerType())])


def run(spark, where, max_files=1000):
    evolving.run_evolving(spark, str(where), *paths(where), DECLARED, max_files)
    return evolving.read_evolved(spark, *paths(where)[:2])


def paths(where):
    base = where.parent / (where.name + "-out")
    return str(base / "sink"), str(base / "log"), str(base / "checkpoint")


def test_stream_takes_up_new_columns(spark, tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    (where / "a.csv").write_text("user_id,amount\nU1,1\nU2,x\n")
    first = run(spark, where)
    assert first.columns[:2] == ["user_id", "amount"] and first.count() == 2
    assert first.filter("amount IS NULL").select("_rescued_data").first()[0] == "U2,x"
    (where / "b.csv").write_text("channel,AMOUNT,user_id\nupi,3,U3\n")  # new column, other order and case
    (where / "c.csv").write_text("user_id\nU4\n")  # a column less
    (where / "d.csv").write_text("")
    second = run(spark, where, max_files=1)
    got = sorted(tuple(r) for r in second.select("user_id", "amount", "channel").fillna({"amount": -1, "channel": "-"}).collect())
    assert got == [("U1", 1, "-"), ("U2", -1, "-"), ("U3", 3, "upi"), ("U4", -1, "-")]
    assert second.filter("source_file IS NULL OR ingestion_timestamp IS NULL").isEmpty()
    assert run(spark, where).count() == 4  # nothing new
    log = evolving.schema_log(spark, paths(where)[1])
    assert [r["version"] for r in log.orderBy("version").collect()] == [1, 2]


def test_repeated_batch_writes_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,amount,extra\nU1,1,e\n")
    sink, log = new_path(spark, "sink"), new_path(spark, "log")
    for _ in range(2):  # the second time as after a lost driver
        evolving.write_batch(spark, [str(tmp_path / "a.csv")], 0, sink, log, DECLARED)
    assert evolving.read_evolved(spark, sink, log).count() == 1
    assert evolving.schema_log(spark, log).count() == 1


def test_stream_of_empty_files(spark, tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    (where / "a.csv").write_text("")
    assert run(spark, where).isEmpty()
