import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from thriftline.operators import leafwise
from thriftline.operators.leafwise import Settings

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(900).select(
        F.concat(F.lit("u"), "id").alias("user_id"), (F.col("id") % 17).cast("double").alias("a"),
        F.when(F.col("id") % 29 > 0, F.col("id") * 7 % 23).cast("double").alias("b"), (F.col("id") * 5 % 11).cast("int").alias("c"))
    risk = F.col("a") * 2 + F.when(F.coalesce("b", F.lit(3)) > 10, F.col("c")).otherwise(0) + F.col("id") * 13 % 9
    x = spark.range(900).join(x.withColumn("id", F.substring("user_id", 2, 9).cast("long")), "id").withColumn(
        "default_label", (risk > 24).cast("int"))
    return x.withColumn("is_validation", F.col("id") % 5 == 0).withColumn(
        "split", F.when(F.col("id") % 5 == 0, "val").when(F.col("id") % 5 == 1, "test").otherwise("train")).drop("id").cache()


def one_by_one(x, y, w, settings):
    """The leaf-wise tree by single splits over sorted values: the rows of each leaf and the leaf's value."""
    g, h = np.rint((0.5 - y) * w * leafwise.UNIT), np.rint(0.25 * w * leafwise.UNIT)
    shrink = lambda v: np.sign(v) * max(abs(v) - settings.reg_alpha, 0.0)
    score = lambda m: shrink(g[m].sum() / leafwise.UNIT) ** 2 / (h[m].sum() / leafwise.UNIT + settings.reg_lambda)

    def split(mask, depth):
        best = (0.0, None)
        for f in range(x.shape[1] if depth < settings.max_depth else 0):
            for cut in [-np.inf, *np.unique(x[~np.isnan(x[:, f]), f])]:
                left = mask & (np.isnan(x[:, f]) | (x[:, f] <= cut))
                right = mask & ~left
                if min(left.sum(), right.sum()) >= settings.min_instances:
                    gain = score(left) + score(right) - score(mask)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (left, right))
        return best

    everything = np.ones(len(y), bool)
    gain, parts = split(everything, 0)
    heap, count, leaves = [(-gain, 0, 0, everything, parts)], 1, []
    while heap:
        gain, _, depth, mask, parts = heapq.heappop(heap)
        if gain < 0 and count < settings.num_leaves:
            for i, part in enumerate(parts):
                own, next_parts = split(part, depth + 1)
                heapq.heappush(heap, (-own, 2 * count + i, depth + 1, part, next_parts))
            count += 1
        else:
            leaves.append((mask, -settings.step_size * shrink(g[mask].sum() / leafwise.UNIT) / (h[mask].sum() / leafwise.UNIT + settings.reg_lambda)))
    return leaves


@pytest.mark.parametrize("settings", [
    Settings(0.1, 9, 6, 10, 1.0, 1.0, 0.0, 0.0, 1), Settings(0.1, 6, 9, 20, 1.0, 1.0, 2.0, 1.5, 1), Settings(0.1, 64, 3, 1, 1.0, 1.0, 0.5, 0.1, 1)])
def test_a_tree_is_the_one_of_single_best_splits(rows, settings):
    model = leafwise.train(rows, COLUMNS, [settings], validation=None, max_bins=254)[0]
    table = rows.select(*COLUMNS, "default_label").toPandas()
    x, y = table[COLUMNS].to_numpy(float, na_value=np.nan), table["default_label"].to_numpy(float)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    found = model.margins([x[:, i] for i in range(3)])
    wanted, leaves = np.zeros(len(y)), one_by_one(x, y, w, settings)
    for mask, value in leaves:
        wanted[mask] = value
    assert len(model.trees) == 1 and 1 < len(leaves) <= settings.num_leaves
    assert np.allclose(found, wanted, atol=1e-9)


def test_models_trained_together_equal_those_trained_alone(rows):
    chosen = [Settings(rounds=11, num_leaves=8), Settings(rounds=4, max_depth=2, reg_alpha=1.0)]
    both = leafwise.train(rows, COLUMNS, chosen, patience=20)
    spread = rows.repartition(7, "user_id")
    for settings, model in zip(chosen, both):
        alone = leafwise.train(spread, COLUMNS, [settings], patience=20)[0]
        assert np.allclose(alone.errors, model.errors, atol=1e-6) and len(alone.trees) == len(model.trees)
        x = [np.arange(20.0), np.arange(20.0), np.arange(20.0) / 2]
        assert np.allclose(alone.margins(x), model.margins(x))


def test_boosting_learns_and_ends_at_its_best_round(rows):
    model = leafwise.train(rows, COLUMNS, [Settings(step_size=0.6, num_leaves=16, rounds=60, min_instances=5)], patience=3)[0]
    assert len(model.trees) == int(np.argmin(model.errors)) > 1 and len(model.errors) <= len(model.trees) + 4
    assert model.errors[len(model.trees)] < 0.5 * model.errors[0]
    scored = leafwise.predict(model, rows, "p").groupBy("default_label").agg(F.avg("p").alias("p"), F.max("p").alias("top"))
    p = {r["default_label"]: r["p"] for r in scored.collect()}
    assert p[1] > 0.6 > 0.4 > p[0]


def test_all_eight_parameters_are_searched(rows):
    table, best = leafwise.tune(rows, COLUMNS, leafwise.random_settings(2, rounds=3), proposed=1, together=2)
    found = table.collect()
    assert len(found) == 3 and set(leafwise.RANGES) <= set(table.columns) and len(leafwise.RANGES) == 8
    assert [r["auc"] for r in found] == sorted((r["auc"] for r in found), reverse=True)
    assert sum(r["test_auc"] is not None for r in found) == 1 == sum(r["log_ratio"] is not None for r in found)
    for r in found:
        assert all(low <= r[name] <= high for name, (low, high, _) in leafwise.RANGES.items())


def test_edges(spark, rows):
    none = leafwise.train(rows.filter("false"), COLUMNS, [Settings(rounds=2)], validation=None)[0]
    assert leafwise.predict(none, rows.limit(3), "p").agg(F.max("p"), F.min("p")).first()[:] == (0.5, 0.5)
    alone = leafwise.train(rows.filter("default_label = 1"), COLUMNS, [Settings(rounds=2)])[0]
    assert leafwise.predict(alone, rows, "p").agg(F.countDistinct("p")).first()[0] == 1
    gaps = rows.withColumns({"b": F.lit(None).cast("double"), "default_label": F.when(F.col("a") > 3, F.col("default_label"))})
    assert leafwise.predict(leafwise.train(gaps, COLUMNS, [Settings(rounds=2)])[0], gaps, "p").filter("p IS NULL OR isnan(p)").isEmpty()
    with pytest.raises(ValueError):
        leafwise.train(rows, COLUMNS, [Settings()], max_bins=255)


def test_only_rows_in_nodes_asked_for_are_replayed(spark):
    """After the first pass the trees before are worked out for the smaller children's rows alone."""
    class Strict:
        def margins(self, bins):
            assert len(bins) <= 10
            return np.zeros(len(bins))

    df = spark.range(0, 100, 1, 1).select(F.col("id").alias("user_id"), F.when(F.col("id") < 10, 1.0).otherwise(F.col("id") % 3 + 2.0).alias("x"),
                                          (F.col("id") < 10).cast("int").alias("y"))
    settings = leafwise.Settings(min_instances=2, bagging_fraction=1.0, max_depth=3, num_leaves=4)
    table = leafwise.binned(df, ["x"], "y", [np.array([1.0, 2.0, 3.0])], 1, "user_id", None)
    run = leafwise._Run(settings, 1)
    run.growing = leafwise.Growing(settings, np.array([0]))
    root = leafwise._sums(table, [run], False, 0, 1, 5)[0]
    run.growing.take({node: h for (_, node), h in root.items()})
    assert len(run.growing.asked) == 1
    run.trees = [Strict()]
    found = leafwise._sums(table, [run], False, 0, 1, 5)[0]
    assert [int(h[0, :, 2].sum()) for h in found.values()] == [10]


@pytest.mark.parametrize("most", [100_000, 100])
def test_models_of_one_job_are_those_of_a_job_for_every_pass(rows, monkeypatch, most):
    """One task and several; eleven rounds, so margins are written anew once."""
    chosen = [Settings(rounds=11, num_leaves=8, step_size=0.3), Settings(rounds=3, max_depth=2)]
    monkeypatch.setattr(leafwise.boosting, "by_tasks", lambda *_: False)
    wanted = leafwise.train(rows, COLUMNS, chosen, patience=20)
    monkeypatch.undo()
    monkeypatch.setattr(leafwise.boosting, "ONE_TASK", most)
    monkeypatch.setattr(leafwise.boosting, "EXCHANGE_ROWS", 300)
    monkeypatch.setattr(leafwise, "_sums", None)
    for model, other in zip(leafwise.train(rows, COLUMNS, chosen, patience=20), wanted):
        assert model.errors == other.errors and len(model.trees) == len(other.trees) > 0
        assert all(np.array_equal(a.value, b.value) and np.array_equal(a.feature, b.feature) for a, b in zip(model.trees, other.trees))


def test_the_queries_search_with_all_rounds(monkeypatch):
    """Trials ended after 8 and 40 rounds, and a search of leaf-wise trees after 8 trials."""
    from thriftline.catalogue import model_queries, registry
    seen = []
    monkeypatch.setattr(model_queries, "_labelled", lambda *_: None)
    monkeypatch.setattr(leafwise, "tune", lambda _, columns, settings, proposed: seen.append([s.rounds for s in settings] + [500] * proposed) or [None])
    monkeypatch.setattr(model_queries.models, "tune", lambda _, columns, trials, proposed: seen.append([t.max_iter for t in trials] + [500] * proposed) or [None])
    for name in ("leafwise_trials", "tuning_trials"):
        registry.CASES[name].build(None, None)
    assert seen == [[500] * 20] * 2
