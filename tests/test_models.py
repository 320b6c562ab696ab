import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from thriftline.functions import fixed_values as fv
from thriftline.operators import contributions as contrib, models, refresh
from thriftline.operators.contract import FeatureContract
from thriftline.plans.workspace import new_path
from thriftline.sources import schemas, tables

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(600).select(
        F.concat(F.lit("u"), "id").alias("user_id"), F.lit("s").alias("segment"),
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b"), (F.col("id") * 5 % 11).cast("double").alias("c"))
    x = x.withColumn("y", F.col("a") * 2 + F.when(F.col("b") > 10, F.col("c")).otherwise(0.0))
    return x.withColumn("default_label", (F.col("y") > 25).cast("int")).cache()


def brute_shapley(tree, x, d):
    """Path-dependent Shapley values by enumerating every coalition."""
    def value(node_id, known):
        node = tree[node_id]
        if node["leftChild"] < 0:
            return node["prediction"]
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        left, right = node["leftChild"], node["rightChild"]
        if f in known:
            return value(left if x[f] <= cut else right, known)
        n = node["impurityStats"][0]
        return sum(tree[ch]["impurityStats"][0] / n * value(ch, known) for ch in (left, right))

    out = np.zeros(d)
    for j in range(d):
        others = [k for k in range(d) if k != j]
        for size in range(d):
            for known in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                out[j] += w * (value(0, {*known, j}) - value(0, set(known)))
    return out


def test_contributions_equal_enumerated_shapley_values(spark, rows):
    model = models.train_score_regressor(rows, COLUMNS, "y", maxIter=5, maxDepth=4)
    nodes, weights, scale = contrib.model_nodes(spark, model)
    groups, base = contrib.leaf_groups(nodes, weights, scale)
    sample = np.array([[3.0, 12.0, 5.0], [16.0, 0.0, 10.0], [0.0, 22.0, 0.0]])
    want = np.array([sum(weights[t] * scale * brute_shapley(tree, x, 3) for t, tree in nodes.items()) for x in sample])
    assert np.allclose(contrib.row_contributions(groups, sample), want, atol=1e-9)
    moved = contrib.contributions(model, rows, COLUMNS, good_sign=1.0)
    joined = moved.join(model.transform(rows).select("user_id", "prediction"), "user_id")
    gap = joined.select(F.max(F.abs(F.col("a") + F.col("b") + F.col("c") + F.col("base_value") - F.col("prediction")))).first()[0]
    assert gap < 1e-9


def test_classifier_contributions_are_log_odds(rows):
    data = rows.withColumn("is_validation", F.col("a") > 13)
    model = models.train_default_classifier(data, COLUMNS, maxIter=6, maxDepth=3)
    scored = models.default_probability(model.transform(rows), "p")
    moved = contrib.contributions(model, rows, COLUMNS)
    joined = moved.drop("segment").join(scored.select("user_id", "p"), "user_id")
    odds = F.log(F.col("p") / (1 - F.col("p")))
    gap = joined.select(F.max(F.abs(F.col("a") + F.col("b") + F.col("c") + F.col("base_value") + odds))).first()[0]
    assert gap < 1e-6


def test_cases_of_a_leaf_equal_its_evaluation_by_row(monkeypatch):
    """A wider table of leaves than one block, a value on every bound, and NaN."""
    rng = np.random.default_rng(5)
    groups = []
    for d in (1, 3, 6):
        features = np.array([rng.choice(8, d, replace=False) for _ in range(contrib.LEAVES + 7)])
        low = np.where(rng.random(features.shape) < 0.5, -np.inf, rng.integers(-2, 2, features.shape))
        high = np.where(np.isinf(low), rng.integers(-2, 2, features.shape), low + 2.0)
        groups.append(contrib.LeafGroup(features, low, high, rng.uniform(0.1, 0.9, features.shape), rng.normal(size=len(features))))
    x = rng.integers(-3, 4, (contrib.ROWS + 3, 8)).astype(float)
    x[5, 2] = np.nan
    found = contrib.row_contributions(groups, x)
    assert groups[2].cases.shape == (6, (contrib.LEAVES + 7) * 64)
    monkeypatch.setattr(contrib, "CASES", 0)
    assert np.allclose(found, contrib.row_contributions(groups, x), atol=1e-9)


def test_rows_to_explain_are_spread(spark, rows):
    """One part of a few kilobytes is hours of work for a large model."""
    model = models.train_score_regressor(rows, COLUMNS, "y", maxIter=1, maxDepth=2)
    one = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("user_id"), F.lit("s").alias("segment"), *[(F.col("id") % 17).alias(c) for c in COLUMNS])
    moved = contrib.contributions(model, one, COLUMNS)
    assert moved.rdd.getNumPartitions() >= 3 and moved.count() == 10_000


def test_split_is_reproducible_and_stratified(rows):
    parts = models.split(rows, models.TRAIN_VAL_TEST, strata="default_label")
    again = models.split(rows.repartition(7), models.TRAIN_VAL_TEST, strata="default_label")
    assert parts.select("user_id", "split").exceptAll(again.select("user_id", "split")).isEmpty()
    share = {(r["default_label"], r["split"]): r["count"] for r in parts.groupBy("default_label", "split").count().collect()}
    for label in (0, 1):
        total = sum(v for (l, _), v in share.items() if l == label)
        assert share[(label, "train")] == round(0.70 * total + 1e-9)
        assert share[(label, "train")] + share[(label, "val")] == round(0.85 * total + 1e-9)


def test_deep_trees_stay_additive(spark, rows):
    """Depth 9 on eight features: paths longer than any table over all patterns could hold cheaply."""
    names = [f"x{i}" for i in range(8)]
    wide = rows.withColumns({n: F.pmod(F.hash("user_id", F.lit(i)), F.lit(50)).cast("double") for i, n in enumerate(names)})
    wide = wide.withColumn("target", sum((F.col(n) * F.col(names[(i + 1) % 8]) for i, n in enumerate(names)), F.lit(0.0)))
    model = models.train_score_regressor(wide, names, "target", maxIter=3, maxDepth=9, minInstancesPerNode=1)
    groups, base = contrib.leaf_groups(*contrib.model_nodes(spark, model))
    assert max(g.features.shape[1] for g in groups) >= 7
    joined = contrib.contributions(model, wide, names, good_sign=1.0).join(model.transform(wide).select("user_id", "prediction"), "user_id")
    total = sum((F.col(n) for n in names), F.col("base_value"))
    assert joined.select(F.max(F.abs(total - F.col("prediction")))).first()[0] < 1e-6


def test_tuning_keeps_test_rows_apart(spark, rows):
    parts = models.split(rows, models.TRAIN_VAL_TEST, strata="default_label")
    table, best, test_auc = models.tune(parts, COLUMNS, models.random_trials(3, max_iter=5))
    found = table.collect()
    assert [r["auc"] for r in found] == sorted((r["auc"] for r in found), reverse=True) and len(found) == 3
    assert found[0]["test_auc"] == test_auc > 0.9 and all(r["test_auc"] is None for r in found[1:])
    assert found[0]["step_size"] == best.step_size


def test_metrics_on_known_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, "train"), (3.0, 3.0, "train"), (5.0, 1.0, "test")], "y double, prediction double, split string")
    got = {r["split"]: r for r in models.regression_metrics(df, "y").collect()}
    assert got["train"]["rmse"] == pytest.approx(math.sqrt(0.5)) and got["train"]["r2"] == pytest.approx(0.5) and got["test"]["mae"] == 4.0
    assert models.overfit_ratio(models.regression_metrics(df, "y")).first()[0] == pytest.approx(4 / math.sqrt(0.5))
    binary = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "default_label int, default_probability double")
    values = models.classification_metrics(binary)
    assert values["auc_roc"] == pytest.approx(0.75) and values["f1"] == pytest.approx(0.8)


def test_trials_are_seeded_and_in_range():
    trials = models.random_trials(20)
    assert trials == models.random_trials(20) and len(set(trials)) == 20
    assert all(0.01 <= t.step_size <= 0.15 and 4 <= t.max_depth <= 9 and 0.60 <= t.subsampling_rate <= 0.95 for t in trials)


def test_promotion_needs_a_greater_auc(spark):
    log, champion = new_path(spark, "log"), new_path(spark, "champion")
    trial = models.random_trials(1)[0]
    outcome = [models.promote(spark, log, champion, trial, auc, 20, f"m{i}", dt.datetime(2026, 1, 1 + i)) for i, auc in enumerate((0.6, 0.6, 0.7))]
    assert outcome == [True, False, True]
    newest = spark.read.parquet(champion).orderBy(F.desc("promoted_at")).first()
    assert newest["model_path"] == "m2" and spark.read.parquet(log).count() == 3


def test_refresh_rewrites_changed_users_only(spark):
    names = list(fv.CONTRACT_FEATURES)
    base = spark.range(200).select(
        F.format_string("u%03d", "id").alias("user_id"), F.lit("s").alias("segment"), F.lit("st").alias("state"),
        F.lit(0.1).alias("default_probability"),
        *[((F.col("id") * (i + 3)) % 13).cast("double").alias(n) for i, n in enumerate(names)], (F.col("id") % 4 == 0).cast("int").alias("default_label"))
    model = models.train_default_classifier(base.withColumn("is_validation", F.lit(False)), names, validation=None, maxIter=3, maxDepth=3)
    at = refresh.RefreshTables.under(new_path(spark, "refresh"))
    tables.snapshot_write(base, at.features)
    runs = [dt.datetime(2026, 1, day) for day in (1, 2, 3)]
    assert refresh.refresh(spark, at, model, now=runs[0]) == refresh.SUCCESS
    assert refresh.refresh(spark, at, model, now=runs[1]) == refresh.NO_CHANGES
    changed = base.withColumn("income_log", F.when(F.col("user_id") < "u005", 99.0).otherwise(F.col("income_log")))
    tables.snapshot_write(changed.filter("user_id <> 'u199'").unionByName(base.limit(1).withColumn("user_id", F.lit("new"))), at.features)
    assert refresh.refresh(spark, at, model, FeatureContract(), now=runs[2]) == refresh.SUCCESS
    scores = refresh.read_scores(spark, at)
    assert [r["rows"] for r in tables.snapshot_history(spark, at.scores).orderBy("version").collect()] == [200, 6]
    touched = {r["user_id"] for r in scores.filter(F.col("score_timestamp") == F.lit(runs[2])).collect()}
    assert touched == {"u000", "u001", "u002", "u003", "u004", "new"} and scores.count() == 201
    told = refresh.read_explanations(spark, at)
    assert told.count() == 201 and told.filter("explanation_text IS NULL").isEmpty()
    log = [(r["status"], r["last_processed_ver"], r["new_version"], r["changed_users"], r["total_users_scored"])
           for r in spark.read.schema(schemas.REFRESH_LOG).parquet(at.log).orderBy("run_timestamp").collect()]
    assert log == [("SUCCESS", 0, 1, 200, 200), ("NO_CHANGES", 1, 1, 0, 0), ("SUCCESS", 1, 2, 6, 201)]


def test_probability_column(rows):
    model = models.train_default_classifier(rows, COLUMNS, validation=None, maxIter=2, maxDepth=2)
    out = models.default_probability(model.transform(rows))
    assert out.filter(F.col("default_probability") != vector_to_array("probability")[1]).isEmpty()


def test_best_round_waits_for_patience():
    assert models.best_round([5, 4, 3, 4, 4, 4, 1], patience=3) == 3  # what comes after the patience is never seen
    assert models.best_round([5, 4, 3, 4, 4, 2.5, 4, 4, 4], patience=3) == 6
    assert models.best_round([5, 4, 3], patience=3) == 3 and models.best_round([1, 2, 3, 4, 5], patience=3) == 1


def test_boosting_is_cut_to_its_best_round(spark, rows):
    noisy = rows.withColumn("default_label", F.when(F.abs(F.hash("user_id")) % 4 == 0, 1 - F.col("default_label")).otherwise(F.col("default_label")))
    parts = noisy.withColumn("is_validation", F.abs(F.hash(F.col("user_id"), F.lit(1))) % 3 == 0).cache()
    settings = {"maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}  # nothing that depends on the order of rows
    model = models.train_default_classifier(parts, COLUMNS, patience=5, maxIter=40, **settings)
    n = models.tree_count(model)
    train = parts.filter("NOT is_validation")
    ratio = train.agg(F.count_if(F.col("default_label") == 0) / F.count_if(F.col("default_label") == 1)).first()[0]
    weighted = parts.withColumn("weight", F.when(F.col("default_label") == 1, ratio).otherwise(1.0))
    whole = models.train_default_classifier(weighted.filter("NOT is_validation"), COLUMNS, validation=None, maxIter=min(40, n + 5), **settings)
    judged = weighted.filter("is_validation")
    errors = models.staged_errors(whole, judged)
    assert 1 < n == models.best_round(errors, 5)
    # the errors once more, from the margins of the cut models
    for k in {1, n}:
        margin = vector_to_array("rawPrediction")[1]
        cut = models.first_trees(whole, k).transform(judged)
        sign = 2.0 * F.col("default_label") - 1
        loss = cut.agg(F.sum(F.col("weight") * 2 * F.log1p(F.exp(-2 * sign * margin))) / F.sum("weight")).first()[0]
        assert loss == pytest.approx(errors[k - 1], rel=1e-6)
    assert models.first_trees(whole, n).stages[-1].featureImportances.toArray().sum() == pytest.approx(1.0)


def test_proposals_approach_a_known_optimum():
    """A smooth surface: after as many trials, proposals come nearer to its top than random draws do."""
    top = models.Trial(0.05, 64, 6, 20, 0.8, 0.7, 1e-5, 10)

    def surface(t):
        return -sum((a - b) ** 2 for a, b in zip(models.to_unit(t), models.to_unit(top)))

    gained = []
    for seed in range(6):
        known = [(t, surface(t)) for t in models.random_trials(10, seed, 10)]
        ratios = []
        for i in range(40):
            trial, ratio = models.propose(known, seed * 100 + i, 10)
            ratios.append(ratio)
            known.append((trial, surface(trial)))
        alone = max(surface(t) for t in models.random_trials(50, seed, 10))
        gained.append(max(v for _, v in known) - alone)
        assert all(math.isfinite(r) for r in ratios) and sum(ratios) > 0
        assert all(0.01 <= t.step_size <= 0.15 and 20 <= t.max_bins <= 120 and 4 <= t.max_depth <= 9 for t, _ in known)
    assert sum(g > 0 for g in gained) >= 5
    assert models.propose(known, 3, 10) == models.propose(known, 3, 10)


def test_parzen_density_integrates_to_one():
    for points in ([], [0.5], [0.0, 1.0, 0.2, 0.21]):
        own = models.Parzen(points)
        assert sum(own.density((i + 0.5) / 4000) for i in range(4000)) / 4000 == pytest.approx(1.0, abs=1e-3)


def test_tuning_proposes_after_the_first_trials(spark, rows):
    parts = models.split(rows, models.TRAIN_VAL_TEST, strata="default_label")
    found = models.tune(parts, COLUMNS, models.random_trials(2, max_iter=3), proposed=3, parallelism=2, patience=2)[0].collect()
    assert sorted(r["trial"] for r in found) == [1, 2, 3, 4, 5]
    assert [r["log_ratio"] is None for r in sorted(found, key=lambda r: r["trial"])] == [True, True, False, False, False]
    assert all(1 <= r["trees"] <= 3 for r in found)


def test_rows_of_one_part_are_spread_for_boosting(spark):
    """Few columns of many rows are one small file, and its scan one part."""
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 10_000 * cores, 1, 1)
    spread = models.spread_rows(many, 10_000 * cores)
    assert spread.rdd.getNumPartitions() == cores and spread.count() == 10_000 * cores
    few = spark.range(0, 9_999, 1, 1)
    assert models.spread_rows(few, 9_999) is few


def test_lift_reads_the_rows_it_was_given_once(spark, rows):
    """Labels, splits and scores are worked out once, not once per set, part and metric."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    counted = models.split(rows, models.TRAIN_VAL_TEST).mapInPandas(passed, models.split(rows, models.TRAIN_VAL_TEST).schema)
    lift = models.progressive_lift(counted, {"one": COLUMNS[:1], "all": COLUMNS}, maxIter=3, maxDepth=2).collect()
    assert seen.value == rows.count()
    assert [(r["version"], r["n_features"]) for r in lift] == [("one", 1), ("all", 3)]
    assert lift[0]["lift"] == 0.0 and lift[1]["lift"] == pytest.approx(lift[1]["val_auc"] - lift[0]["val_auc"])


def test_first_training_lasts_longer_for_more_rows():
    """The rounds that were needed (best round and patience) on tables of 8,342 and 83,339 rows."""
    assert models.first_rounds(8_342, 30) >= 33 + 30 and models.first_rounds(83_339, 30) >= 88 + 30
    assert models.first_rounds(0, 30) == 40


def test_the_regressor_spreads_its_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
    models.train_score_regressor(spark.range(0, 200, 1, 1).selectExpr("id", "id * 2.0 AS y"), ["id"], "y")
    models.train_score_regressor(spark.range(0, 199, 1, 1).selectExpr("id", "id * 2.0 AS y"), ["id"], "y")
    assert seen == [2, 1]


def test_trials_share_the_rows_that_they_train_on(rows, monkeypatch):
    """Weights and vectors were made and written anew for every trial."""
    made, write = [], models.write_through
    monkeypatch.setattr(models, "write_through", lambda df, label: made.append(label) or write(df, label))
    found = models.tune(models.split(rows, models.TRAIN_VAL_TEST), COLUMNS, models.random_trials(2, max_iter=2), proposed=1)[0]
    assert found.count() == 3 and sorted(made) == ["boosting", "tuning"]


def test_shared_rows_give_the_model_of_rows_read_for_it_alone(rows, monkeypatch):
    written, write = [], models.write_through
    monkeypatch.setattr(models, "write_through", lambda df, label: written.append(write(df, label)) or written[-1])
    parts = rows.withColumn("is_validation", F.col("a") > 13)
    made = models.boosting_rows(parts, COLUMNS)
    assert "FileScanRDD" not in made.kept.rdd.toDebugString().decode() and made.n == made.kept.count() == parts.filter("a <= 13").count()
    for settings in ({"maxIter": 4, "maxDepth": 3}, {"maxIter": 2, "maxDepth": 4, "stepSize": 0.1}):
        model = models.boost(made, COLUMNS, **settings).stages[-1]
        gbt = models.GBTClassifier(labelCol="default_label", weightCol="weight", seed=models.SEED, **{**models.CLASSIFIER, **settings})
        alone = models.Pipeline(stages=[models.assembler(COLUMNS), gbt]).fit(written[0].filter("NOT is_validation"))
        alone = models.first_trees(alone, model.getNumTrees).stages[-1]
        assert alone.toDebugString.split("\n", 1)[1] == model.toDebugString.split("\n", 1)[1]
