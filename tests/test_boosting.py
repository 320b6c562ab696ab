import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from thriftline.operators import boosting, models

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def parts(spark):
    x = spark.range(0, 900, 1, 3).select(F.col("id"), *[F.pmod(F.hash("id", F.lit(i)), F.lit(30 * i + 9)).cast("double").alias(c) for i, c in enumerate(COLUMNS)])
    risk = F.col("a") * 3 + F.col("b") / 4 + F.pmod(F.hash("id", F.lit(7)), F.lit(9))
    return x.withColumns({"default_label": (risk > 20).cast("int"), "is_validation": F.pmod(F.hash("id", F.lit(8)), F.lit(4)) == 0}).cache()


def test_jobs_do_not_grow_with_the_rounds(spark, parts):
    """Every level of every tree was a job."""
    rows = models.boosting_rows(parts, COLUMNS)
    spark.sparkContext.setJobGroup("boosting", "one training")
    try:
        model = models.boost(rows, COLUMNS, patience=40, maxIter=40)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert models.tree_count(model) > 5
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) < 40


def test_training_ends_when_patience_does(spark, parts, monkeypatch):
    """Rounds beyond the best one and the patience were trained, some of them twice."""
    made, train = [], boosting.train
    monkeypatch.setattr(boosting, "train", lambda *args: made.append(train(*args)) or made[-1])
    model = models.boost(models.boosting_rows(parts, COLUMNS), COLUMNS, patience=4, maxIter=200, stepSize=0.5)
    assert [m.getNumTrees for m in made] == [models.tree_count(model) + 4]


def test_several_tasks_grow_the_trees_of_one(spark, parts, monkeypatch):
    """Sums of two tasks, and large children as differences, against MLlib's own training."""
    settings = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 1.0, "minInstancesPerNode": 5}
    monkeypatch.setattr(boosting, "ONE_TASK", 100)
    monkeypatch.setattr(boosting, "EXCHANGE_ROWS", 300)
    rows = models.boosting_rows(parts, COLUMNS)
    assert rows.rows.rdd.getNumPartitions() == boosting.wanted_tasks(spark, rows.n) == 2
    several = models.boost(rows, COLUMNS, patience=8, **settings)
    alone = models._boost_by_jobs(rows, COLUMNS, models._booster("default_label", **settings), 8)
    assert models.tree_count(several) == models.tree_count(alone)
    margins = [np.array([r[0] for r in m.transform(parts.orderBy("id")).select(vector_to_array("rawPrediction")[1]).collect()]) for m in (several, alone)]
    assert np.allclose(*margins, atol=1e-9)


def test_rows_of_no_known_set_and_a_set_of_none(parts):
    lost = parts.withColumn("is_validation", F.when(F.col("id") % 5 > 0, F.col("is_validation")))
    rows = models.boosting_rows(lost, COLUMNS)
    assert rows.n == lost.filter("NOT is_validation").count() and rows.rows.count() == lost.filter("is_validation IS NOT NULL").count()
    with pytest.raises(Exception):
        models.train_default_classifier(parts.withColumn("is_validation", F.lit(True)), COLUMNS, maxIter=2)


@pytest.mark.parametrize("n, seed, share", [(0, 1, 0.5), (1, 2, 0.5), (1000, -7, 0.8), (777, 45, 1.0)])
def test_bags_are_drawn_one_after_the_other(n, seed, share):
    state, wanted = boosting.xorshift_start(seed), []
    for _ in range(n):
        high = state = boosting._xorshift(state)
        state = boosting._xorshift(state)
        wanted.append(((high & (1 << 26) - 1) << 27 | state & (1 << 27) - 1) * 2.0 ** -53 < share)
    assert boosting.in_bag(n, seed, share).tolist() == wanted


def test_random_numbers_are_those_of_spark(spark):
    random = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.util.random, "XORShiftRandom$"), "MODULE$")
    for seed in (0, 42, -1, 1 << 40):
        start = boosting.xorshift_start(seed)
        assert (start - (1 << 64) if start >> 63 else start) == random.hashSeed(seed)
    java, own = spark.sparkContext._jvm.java.util.Random(45), boosting._JavaRandom(45)
    for _ in range(5):
        value = own.next_long()
        assert (value - (1 << 64) if value >> 63 else value) == java.nextLong()
