"""Queries that train, evaluate, score and refresh.

Training itself can't be spelled in SQL; the checked queries reduce it to facts
that can: every user scored once, scores in range, contributions additive.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import fixed_values as fv, text
from ..operators import analytics, contributions as contrib, leafwise, models, refresh, score_tables
from ..operators.contract import FeatureContract
from ..plans.workspace import new_path, write_through
from ..sources import schemas, tables
from . import inputs, layers
from .pillar_queries import _RISK
from .registry import case, stored

FEATURES = list(fv.CONTRACT_FEATURES)
NOW = datetime(2026, 1, 1, 2, 0, 0)
_MODELS: dict = {}


def _numeric_features():
    from ..operators import statement_features as sf
    skipped = {"user_id", "persona", "first_transaction_date", "last_transaction_date"}
    return [c for c in sf.GOLD_COLUMNS if c not in skipped]


def _training(spark, d):
    return score_tables.with_rule_score(layers.gold(spark, d), column="target").withColumn("target", F.col("target").cast("double"))


def _regressor(spark, d):
    key = (spark.sparkContext.applicationId, d, "regressor")
    if key not in _MODELS:
        rows = models.split(_training(spark, d), models.TRAIN_TEST)
        _MODELS[key] = models.train_score_regressor(rows.filter(F.col("split") == "train"), _numeric_features(), "target")
    return _MODELS[key]


def _labelled(spark, d):
    """The feature table with its split and a label that follows from the people: a default risk above the user's own draw.

    The label of the given profiles depends on nothing, so a model of it has nothing to learn.
    """
    return stored(spark, d, "labelled", lambda: _drawn_labels(spark, d))


def _drawn_labels(spark, d):
    people = inputs.profiles(spark, d)
    rates = people.select("segment").distinct().withColumn("base_default_rate", F.lit(0.3))
    factor = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("income_monthly") / 40000.0))
    risk = score_tables.with_default_risk(people.withColumn("income_factor", factor), rates).groupBy("user_id").agg(
        F.max("default_risk").alias("default_risk"))
    drawn = (F.col("default_risk") > 0.15 + 0.2 * text.hash_fraction(F.col("user_id"), "default")).cast("int")
    rows = layers.gold_pl(spark, d).join(risk, "user_id").withColumn(fv.CONTRACT_LABEL, drawn).drop("default_risk")
    return models.split(rows, models.TRAIN_VAL_TEST, strata=fv.CONTRACT_LABEL)


def _classifier(spark, d):
    key = (spark.sparkContext.applicationId, d, "classifier")
    if key not in _MODELS:
        rows = _labelled(spark, d)
        rows = rows.filter(F.col("split") != "test").withColumn("is_validation", F.col("split") == "val")
        _MODELS[key] = models.train_default_classifier(rows, FEATURES)
    return _MODELS[key]


@case("scaled_features", "J1", "SELECT count(*) AS users, TRUE AS centred, TRUE AS scaled FROM v_gold_pl")
def _(spark, d):
    scaled, _model = models.assemble_scale(layers.gold_pl(spark, d), FEATURES)
    long = scaled.select("user_id", F.posexplode(vector_to_array("features")).alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n"))
    return stats.agg(F.max("n").alias("users"), (F.max(F.abs("mean")) < 1e-9).alias("centred"),
                     F.bool_and((F.abs(F.col("sd") - 1) < 1e-9) | (F.col("sd") == 0)).alias("scaled"))


_HASH = "CAST(('0x' || substr(md5('42:' || default_label || ':' || user_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@case("stratified_split", "J2", f"""
SELECT user_id, default_label, CASE WHEN place <= round(0.7 * n) THEN 'train' WHEN place <= round(0.85 * n) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY default_label ORDER BY h, user_id) AS place, count(*) OVER (PARTITION BY default_label) AS n
      FROM (SELECT user_id, default_label, {_HASH} AS h FROM v_gold_pl))""")
def _(spark, d):
    return models.split(layers.gold_pl(spark, d), models.TRAIN_VAL_TEST, strata=fv.CONTRACT_LABEL).select(
        "user_id", "default_label", "split")


@case("score_regressor", "J3 J11", "SELECT count(*) AS users, TRUE AS in_range, TRUE AS better_than_mean FROM v_gold")
def _(spark, d):
    scored = _regressor(spark, d).transform(_training(spark, d))
    predicted = score_tables.with_predicted_score(scored)
    spread = F.var_pop("target")
    error = F.col("target") - F.col("prediction")
    return predicted.agg(F.count("*").alias("users"), F.bool_and(F.col("predicted_score").between(300, 900)).alias("in_range"),
                         (F.avg(error * error) < spread).alias("better_than_mean"))


@case("held_out_error", "J3 J5 J11", """
SELECT split, count(*) AS n, TRUE AS better_than_mean FROM (
  SELECT CASE WHEN CAST(('0x' || substr(md5('42:' || user_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS split
  FROM v_gold) GROUP BY split""")
def _(spark, d):
    """The regressor on rows that it has seen and on rows that it hasn't."""
    scored = _regressor(spark, d).transform(models.split(_training(spark, d), models.TRAIN_TEST))
    metrics = models.regression_metrics(scored, "target")
    return metrics.select("split", "n", (F.col("r2") > 0).alias("better_than_mean"))


@case("predicted_scores", "J11")
def _(spark, d):
    return models.predict_scores(_regressor(spark, d), layers.gold(spark, d))


_NOISY = """SELECT split, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
FROM (SELECT *, CAST(rule_score AS DOUBLE) AS y, CAST(noisy_score AS DOUBLE) AS p,
  CASE WHEN CAST(('0x' || substr(md5('42:' || user_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS split
  FROM v_scored) GROUP BY split"""


def _noisy_metrics(spark, d):
    from ..functions import scoring
    key = F.regexp_replace(F.regexp_replace("user_id", "USR-", ""), "BAD", "0").cast("long")
    both = score_tables.with_rule_score(score_tables.with_rule_score(layers.gold(spark, d), column="target"), scoring.key_noise(key), "prediction")
    return models.regression_metrics(models.split(both, models.TRAIN_TEST), "target")


@case("regression_metrics", "J5", _NOISY, rmse=6, mae=6, r2=6)
def _(spark, d):
    return _noisy_metrics(spark, d)


@case("overfit_ratio", "J5", f"SELECT max(rmse) FILTER (WHERE split = 'test') / max(rmse) FILTER (WHERE split = 'train') AS overfit_ratio FROM ({_NOISY})",
      overfit_ratio=6)
def _(spark, d):
    return models.overfit_ratio(_noisy_metrics(spark, d))


_RANKED = "SELECT default_label AS y, default_probability AS p, rank() OVER (ORDER BY default_probability) + (count(*) OVER (PARTITION BY default_probability) - 1) / 2.0::DOUBLE AS r FROM v_gold_pl"


@case("classification_metrics", "J6", f"""
SELECT 'auc_roc' AS metric, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))::DOUBLE AS value FROM ({_RANKED})
UNION ALL
SELECT 'auc_pr', sum((recall - coalesce(prev_recall, 0)) * (prec + coalesce(prev_prec, prec)) / 2) FROM (
  SELECT *, lag(recall) OVER (ORDER BY p DESC) AS prev_recall, lag(prec) OVER (ORDER BY p DESC) AS prev_prec FROM (
    SELECT p, sum(pos) OVER (ORDER BY p DESC)::DOUBLE / sum(n) OVER (ORDER BY p DESC) AS prec,
           sum(pos) OVER (ORDER BY p DESC)::DOUBLE / (SELECT count(*) FROM v_gold_pl WHERE default_label = 1) AS recall
    FROM (SELECT default_probability AS p, count(*) AS n, count(*) FILTER (WHERE default_label = 1) AS pos FROM v_gold_pl GROUP BY 1)))
UNION ALL
SELECT 'f1', 2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn) FROM (
  SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
         count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM ({_RANKED}))""", value=6)
def _(spark, d):
    values = models.classification_metrics(layers.gold_pl(spark, d))
    return models.metrics_frame(spark, {"all": values}).drop("name")


@case("default_classifier", "J4 J11 I9", "SELECT count(*) AS users, TRUE AS in_range, TRUE AS banded FROM v_gold_pl")
def _(spark, d):
    scores = models.score_all(_classifier(spark, d), layers.gold_pl(spark, d), "v1", "run-1", NOW)
    return scores.agg(F.count("*").alias("users"), F.bool_and(F.col("score").between(0, 900)).alias("in_range"),
                      F.bool_and(F.col("score_band").isNotNull()).alias("banded"))


_DRAWN = f"""(SELECT user_id, CAST(max(least(greatest({_RISK.replace("base_default_rate", "0.3::DOUBLE")}, 0.005::DOUBLE), 0.65::DOUBLE)) > 0.15::DOUBLE + 0.2::DOUBLE *
    (CAST(('0x' || substr(md5('default:' || user_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE) AS INT) AS y
  FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, income_monthly / 40000.0::DOUBLE)) AS income_factor FROM v_profiles)
  JOIN v_gold_pl g USING (user_id) GROUP BY user_id)"""


@case("early_stopped_classifier", "J4 J6", f"""
SELECT split, count(*) AS users, CAST(sum(y) AS BIGINT) AS defaults, TRUE AS many_trees, TRUE AS informed FROM (
  SELECT y, CASE WHEN place <= round(0.7 * n) THEN 'train' WHEN place <= round(0.85 * n) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, user_id) AS place, count(*) OVER (PARTITION BY y) AS n
        FROM (SELECT user_id, y, CAST(('0x' || substr(md5('42:' || y || ':' || user_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS h FROM {_DRAWN})))
GROUP BY split""")
def _(spark, d):
    """Rows and defaults of each part; whether the model has over five trees and ranks defaults above others (AUC over 0.6, in parts of 100 users or more)."""
    model = _classifier(spark, d)
    scored = models.default_probability(model.transform(_labelled(spark, d)), "p").select("user_id", "split", "p", F.col(fv.CONTRACT_LABEL).alias("y"))
    scored = write_through(scored, "early_stopped")
    auc = {part: models.classification_metrics(scored.filter(F.col("split") == part), "y", "p")["auc_roc"] for part in models.TRAIN_VAL_TEST}
    informed = F.create_map(*[F.lit(x) for part, value in auc.items() for x in (part, value > 0.6)])
    return scored.groupBy("split").agg(F.count("*").alias("users"), F.sum("y").alias("defaults")).select(
        "*", F.lit(models.tree_count(model) > 5).alias("many_trees"), (informed[F.col("split")] | (F.col("users") < 100)).alias("informed"))


@case("feature_importance", "J7 F4")
def _(spark, d):
    return analytics.top_features(models.feature_importance(spark, _classifier(spark, d), FEATURES), 31)


@case("importance_sums_to_one", "J7", "SELECT 31 AS features, TRUE AS sums_to_one")
def _(spark, d):
    table = models.feature_importance(spark, _classifier(spark, d), FEATURES)
    return table.agg(F.count("*").cast("int").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))


@case("progressive_lift", "J8")
def _(spark, d):
    rows = _labelled(spark, d)
    sets = {"v1_baseline": fv.BASELINE_FEATURES, "v2_bills": fv.BASELINE_FEATURES + fv.BILL_FEATURES, "v3_full": FEATURES}
    return models.progressive_lift(rows, sets)


@case("tuning_trials", "J9")
def _(spark, d):
    rows = _labelled(spark, d)
    return models.tune(rows, FEATURES, models.random_trials(8), proposed=12)[0]


@case("leafwise_trials", "J9")
def _(spark, d):
    """Eight random and twelve proposed settings of leaf-wise trees of up to 500 rounds; four models are trained side by side."""
    return leafwise.tune(_labelled(spark, d), FEATURES, leafwise.random_settings(8), proposed=12)[0]


_UNIT = "1048576.0::DOUBLE"


def _gain_sql(g: str, h: str) -> str:
    """The score of a node with penalties 0.1 and 0.1."""
    return f"(greatest(abs({g}) / {_UNIT} - 0.1::DOUBLE, 0.0::DOUBLE) * greatest(abs({g}) / {_UNIT} - 0.1::DOUBLE, 0.0::DOUBLE) / ({h} / {_UNIT} + 0.1::DOUBLE))"


@case("leafwise_root_splits", "J9", f"""
WITH weighted AS (SELECT user_id, round((0.5::DOUBLE - y) * w * {_UNIT}) AS g, round(0.25::DOUBLE * w * {_UNIT}) AS h FROM (
    SELECT user_id, y, CASE WHEN y = 1 THEN (count(*) FILTER (WHERE y = 0) OVER ())::DOUBLE / count(*) FILTER (WHERE y = 1) OVER () ELSE 1.0::DOUBLE END AS w
    FROM {_DRAWN})),
long AS (UNPIVOT (SELECT user_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)} FROM v_gold_pl) ON {", ".join(FEATURES)} INTO NAME feature VALUE x),
cuts AS (SELECT DISTINCT feature, unnest(quantile_disc(x, [i / 8.0::DOUBLE for i in range(1, 8)])) AS cut FROM long GROUP BY feature),
sums AS (SELECT feature, cut, sum(g) FILTER (WHERE x <= cut) AS gl, sum(h) FILTER (WHERE x <= cut) AS hl, count(*) FILTER (WHERE x <= cut) AS nl,
    sum(g) AS g, sum(h) AS h, count(*) AS n FROM long JOIN weighted USING (user_id) JOIN cuts USING (feature) GROUP BY feature, cut),
gains AS (SELECT feature, cut, nl, CASE WHEN least(nl, n - nl) >= 15 AND least(hl, h - hl) >= 0.001::DOUBLE * {_UNIT}
    THEN greatest({_gain_sql("gl", "hl")} + {_gain_sql("(g - gl)", "(h - hl)")} - {_gain_sql("g", "h")}, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS gain FROM sums)
SELECT feature, max(gain) AS gain, count(*) FILTER (WHERE gain > 0) > 0 AS splits FROM gains GROUP BY feature
UNION ALL SELECT f, 0.0::DOUBLE, FALSE FROM (SELECT unnest({FEATURES!r}) AS f) WHERE f NOT IN (SELECT feature FROM gains)""", gain=5)
def _(spark, d):
    """The best first split of every feature over its seven octiles."""
    found = leafwise.root_splits(_labelled(spark, d), FEATURES, max_bins=8)
    return found.select("feature", "gain", (F.col("gain") > 0).alias("splits"))


def _auc_sql(score: str) -> str:
    """Area under the ROC curve by rank sums, ties at mid-rank."""
    return f"""(SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))::DOUBLE FROM (
  SELECT default_label AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM v_gold_pl))"""


_FIRST, _SECOND = _auc_sql("default_probability"), _auc_sql("bank_vintage_capped")


@case("tuning_history", "J10 F3", f"""
SELECT '2026-01-01 02:00:00' AS run_time, 20 AS n_trials, a AS best_auc, 0.0::DOUBLE AS prev_champion, a AS improvement, 'true' AS promoted
FROM (SELECT {_FIRST} AS a)
UNION ALL SELECT '2026-01-02 02:00:00', 20, b, a, b - a, CASE WHEN b > a THEN 'true' ELSE 'false' END FROM (SELECT {_FIRST} AS a, {_SECOND} AS b)""",
      best_auc=3, prev_champion=3, improvement=3)
def _(spark, d):
    """Two runs whose AUCs are measured on the gold table; the better one stays champion."""
    log, champion = new_path(spark, "best_params"), new_path(spark, "champion")
    trial, rows = models.random_trials(1)[0], layers.gold_pl(spark, d)
    for day, column in ((1, "default_probability"), (2, "bank_vintage_capped")):
        auc = models.classification_metrics(rows.withColumn("_p", F.col(column).cast("double")), probability="_p")["auc_roc"]
        models.promote(spark, log, champion, trial, auc, 20, "model-path", datetime(2026, 1, day, 2))
    return analytics.tuning_history(tables.ensure_table(spark, log, schemas.BEST_PARAMS))


@case("upserted_scores", "J11 A13", "SELECT user_id, segment, TRUE AS rescored FROM v_gold_pl UNION ALL "
      "SELECT s.user_id, s.segment, FALSE FROM v_scores s ANTI JOIN v_gold_pl g USING (user_id)")
def _(spark, d):
    old = inputs.scores(spark, d).withColumns({
        "score_timestamp": F.lit(NOW), "model_version": F.lit("old"), "model_run_id": F.lit("run-0")}).select(*schemas.CREDIT_SCORES.names)
    gold = layers.gold_pl(spark, d)
    fresh = models.score_all(_classifier(spark, d), gold, "new", "run-1", NOW)
    return models.upsert_scores(old, fresh, gold).select("user_id", "segment", (F.col("model_version") == "new").alias("rescored"))


@case("contributions_additive", "J13", "SELECT count(*) AS users, TRUE AS additive FROM v_gold_pl")
def _(spark, d):
    model, rows = _classifier(spark, d), layers.gold_pl(spark, d)
    moved = contrib.contributions(model, rows, FEATURES)
    total = sum((F.col(c) for c in FEATURES), F.col("base_value"))
    margin = vector_to_array("rawPrediction")[1] * 2.0  # log-odds of default
    raw = model.transform(rows).select("user_id", margin.alias("log_odds"))
    return moved.join(raw, "user_id").agg(
        F.count("*").alias("users"), (F.max(F.abs(total + F.col("log_odds"))) < 1e-6).alias("additive"))


@case("model_explanations", "J13 J14 J15 J16")
def _(spark, d):
    from ..operators.explain import score_explanations
    model, rows = _classifier(spark, d), layers.gold_pl(spark, d)
    scores = models.score_all(model, rows, "v1", "run-1", NOW)
    return score_explanations(contrib.contributions(model, rows, FEATURES), scores)


@case("refresh_run", "J12 S4 E2 C3 A15 A21", """
SELECT 'SUCCESS' AS status, 1 AS new_version, count(*) AS changed_users, count(*) AS total_users_scored FROM v_gold_pl
UNION ALL SELECT 'NO_CHANGES', 1, 0, 0
UNION ALL SELECT 'SUCCESS', 2, count(*) FILTER (WHERE itr_filed_d = 0), count(*) FROM v_gold_pl""")
def _(spark, d):
    """First run scores all users, the second finds no change, the third only users whose features moved."""
    at = refresh.RefreshTables.under(new_path(spark, "refresh"))
    features = layers.gold_pl(spark, d)
    model = _classifier(spark, d)
    tables.snapshot_write(features, at.features)
    refresh.refresh(spark, at, model, FeatureContract(), datetime(2026, 1, 1))
    refresh.refresh(spark, at, model, FeatureContract(), datetime(2026, 1, 2))
    # every user without a filed tax return files one
    tables.snapshot_write(features.withColumn("itr_filed_d", F.lit(1.0)), at.features)
    refresh.refresh(spark, at, model, FeatureContract(), datetime(2026, 1, 3))
    log = tables.ensure_table(spark, at.log, schemas.REFRESH_LOG)
    return log.select("status", F.col("new_version").cast("int").alias("new_version"), "changed_users", "total_users_scored")


@case("run_log", "J18", f"SELECT 'score' AS run_name, 'auc_roc' AS key, a AS value FROM (SELECT {_FIRST} AS a)", value=6)
def _(spark, d):
    path = new_path(spark, "runs")
    rows = layers.gold_pl(spark, d)
    models.log_run(spark, path, "score", models.REGRESSOR, models.classification_metrics(rows), rows)
    log = tables.ensure_table(spark, path, schemas.RUNS)
    return log.filter((F.col("kind") == "metric") & (F.col("key") == "auc_roc")).select(
        "run_name", "key", F.col("value").cast("double").alias("value"))
