"""Dashboard and report queries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, text
from .quantiles import exact_quantiles

# Column lists of the two user listings
USER_TABLE_COLUMNS = [
    "user_id", "persona", "predicted_score", "score_category", "payment_behaviour_score", "digital_flow_score",
    "income_stability_component", "avg_monthly_income", "emi_regularity_score", "digital_adoption_rate",
    "savings_ratio", "total_transactions", "active_months", "has_emi", "has_insurance", "bounce_count",
]
PROFILE_COLUMNS = [
    "user_id", "segment", "state", "bill_ontime_rate_24m", "bill_streak_months", "nach_bounce_rate", "income_monthly",
    "upi_txn_per_month", "upi_avg_txn_amount", "upi_monthly_credit",
]
PILLAR_NAMES = dict(zip(fv.PILLARS, ("Bills", "UPI", "Assets", "Income", "Identity", "Stability")))


def _mean(name: str, digits: int) -> Column:
    return F.round(F.avg(name), digits)


def _mean_points(points: Column) -> Column:
    """Mean of one-decimal points, rounded to one place; whole tenths add up exactly in any order."""
    return F.round(F.sum(F.round(points * 10, 0).cast("long")) / 10.0 / F.count(points), 1)


# --- group summaries -------------------------------------------------------------

def segment_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("segment").agg(
        F.count("*").alias("users"), _mean("income_monthly", 0).alias("avg_income"),
        _mean("bill_ontime_rate_24m", 3).alias("avg_bill_ontime"),
        _mean("p1_bill_ontime_rate", 3).alias("avg_p1_ontime"),
        _mean("p2_upi_txn_per_month", 1).alias("avg_upi_txn"),
        _mean("derived_formal_economy_score", 1).alias("avg_formal_score"),
        _mean("default_label", 3).alias("default_rate"),
    ).orderBy("avg_income", "segment")


def feature_health(gold: DataFrame) -> DataFrame:
    return gold.agg(
        _mean("income_log", 3).alias("avg_income_log"), _mean("p1_bill_ontime_rate", 3).alias("avg_bill_ontime"),
        _mean("p2_upi_txn_per_month", 1).alias("avg_upi_txn"),
        _mean("derived_formal_economy_score", 1).alias("avg_formal_score"),
        _mean("derived_asset_score", 1).alias("avg_asset_score"),
        _mean("default_label", 4).alias("overall_default_rate"), F.count("*").alias("total_users"))


def portfolio_kpis(scores: DataFrame) -> DataFrame:
    """Totals of the score table; lendable means Good or Excellent."""
    def band(name: str) -> Column:
        return F.count_if(F.col("score_band") == name)

    kpis = scores.agg(
        F.count("*").alias("total"), _mean("score", 0).alias("avg_score"),
        F.round(F.avg("default_probability") * 100, 2).alias("avg_default_pct"),
        band("Excellent").alias("excellent"), band("Good").alias("good"))
    lendable = F.col("excellent") + F.col("good")
    return kpis.withColumns({
        "lendable": lendable, "lendable_pct": F.round(F.try_divide(lendable * 100.0, F.col("total")), 0)})


def share_of_total(df: DataFrame, group: str, digits: int = 1) -> DataFrame:
    """Rows and percentage of all rows per group.

    The total is a scalar subquery over the grouped counts, so no row ever
    travels to a single-partition window.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("users"))
    total = counts.agg(F.sum("users")).scalar()
    return counts.withColumn("pct", F.round(F.col("users") * 100.0 / total, digits))


def band_summary(scores: DataFrame) -> DataFrame:
    """Users, share, mean score and mean default percentage per band."""
    bands = scores.groupBy("score_band").agg(
        F.count("*").alias("users"), _mean("score", 0).alias("avg_score"),
        F.round(F.avg("default_probability") * 100, 2).alias("default_pct"))
    total = bands.agg(F.sum("users")).scalar()
    return bands.withColumn("pct", F.round(F.col("users") * 100.0 / total, 1)).orderBy(F.desc("avg_score"))


def score_histogram(scores: DataFrame, width: int = 50, column: str = "score") -> DataFrame:
    bucket = (F.floor(F.col(column) / width) * width).cast("long")
    return scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("users")).orderBy("bucket")


def equal_bins(scores: DataFrame, bins: int = 30, column: str = "score") -> DataFrame:
    """``bins`` equal bins between the observed minimum and maximum (1..bins)."""
    low = scores.agg(F.min(column)).scalar()
    high = scores.agg(F.max(column)).scalar()
    position = F.floor((F.col(column) - low) * float(bins) / F.nullif(high - low, F.lit(0)))
    bin_no = F.least(F.coalesce(position, F.lit(0)) + 1, F.lit(bins)).cast("long")
    return (scores.filter(F.col(column).isNotNull()).groupBy(bin_no.alias("bin"))
            .agg(F.count("*").alias("users")).orderBy("bin"))


def score_distribution(df: DataFrame, column: str = "score") -> DataFrame:
    """min, quartiles, mean, max.  Exact: scores are a bounded set of integers, so the
    quartiles' count table has at most as many entries as there are scores."""
    def quartile(q: float) -> Column:
        return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{column}`)").cast("int")

    return df.agg(F.min(column).alias("min_score"), quartile(0.25).alias("p25"), quartile(0.5).alias("median"),
                  F.avg(column).alias("avg_score"), quartile(0.75).alias("p75"), F.max(column).alias("max_score"))


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per feature: count, mean, stddev, min, exact quartiles (nearest rank), max.

    The quartiles need two or three passes: write a costly ``df`` first.
    """
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])

    def stats(c: str) -> Column:
        value = F.col(c).cast("double")
        p25, p50, p75 = (F.lit(q).cast("double") for q in quartiles[c])
        return F.struct(
            F.lit(c).alias("feature"), F.count(value).alias("n"), F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("stddev"), F.min(value).alias("min"),
            p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), F.max(value).alias("max")).alias(c)

    wide = df.agg(*[stats(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.col(c) for c in columns])))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def explorer_kpis(dashboard: DataFrame) -> DataFrame:
    category = F.col("score_category")
    return dashboard.agg(
        F.count("*").alias("users"), F.avg("predicted_score").alias("avg_score"),
        F.count_if(category == "Poor").alias("poor"), F.count_if(category == "Very Poor").alias("very_poor"),
        F.count_if(F.col("bounce_count") > 0).alias("high_risk"),
        (F.avg("digital_adoption_rate") * 100).alias("digital_adoption_pct"))


def persona_scores(dashboard: DataFrame) -> DataFrame:
    return dashboard.groupBy("persona").agg(
        F.avg("predicted_score").alias("avg_score"),
        F.avg("payment_behaviour_score").alias("avg_payment"),
        F.avg("digital_flow_score").alias("avg_digital"),
        F.avg("income_stability_component").alias("avg_income")).orderBy("avg_score", "persona")


def risk_characteristics(dashboard: DataFrame) -> DataFrame:
    names = ("has_bounce", "has_insurance", "has_emi", "high_digital_user")
    return dashboard.agg(*[F.count_if(F.col(n) == "Yes").alias(n) for n in names])


def segment_pillars(scores: DataFrame, explanations: DataFrame) -> DataFrame:
    """Users, mean score, default percentage and six pillar means per segment."""
    points = {f"shap_{p}_pts": f"p{i}" for i, p in enumerate(fv.PILLARS, 1)}
    return scores_with_explanations(scores, explanations).groupBy("segment").agg(
        F.count("*").alias("users"), _mean("score", 0).alias("avg_score"),
        F.round(F.avg("default_probability") * 100, 2).alias("default_pct"),
        *[_mean_points(F.col(c)).alias(alias) for c, alias in points.items()]).orderBy(F.desc("avg_score"), "segment")


def pillar_importance(explanations: DataFrame) -> DataFrame:
    means = explanations.agg(*[
        _mean_points(F.abs(f"shap_{p}_pts")).alias(name) for p, name in PILLAR_NAMES.items()])
    return means.unpivot([], list(PILLAR_NAMES.values()), "pillar", "avg_abs_points").orderBy(
        F.desc("avg_abs_points"), "pillar")


def scheme_reach(eligibility: DataFrame) -> DataFrame:
    return eligibility.groupBy("scheme_name").agg(
        F.countDistinct("user_id").alias("eligible_users")).orderBy(F.desc("eligible_users"), "scheme_name")


def income_score_frame(df: DataFrame, q: float = 0.95) -> DataFrame:
    """Income against score with the exact q-quantile of income (nearest rank) as axis limit; all points are kept."""
    limit = F.lit(exact_quantiles(df, ["avg_monthly_income"], [q])["avg_monthly_income"][0]).cast("double")
    points = df.select("user_id", "persona", "avg_monthly_income", "predicted_score", "score_category")
    return points.withColumn("income_limit", limit).withColumn(
        "in_view", F.col("avg_monthly_income") <= F.col("income_limit"))


def silver_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct users, first and last date."""
    per_user = df.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("date").alias("low"), F.max("date").alias("high"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("user_id").alias("unique_users"),
        F.min("low").alias("first_date"), F.max("high").alias("last_date"))


# --- listings ----------------------------------------------------------------------

def explore(dashboard: DataFrame, personas=None, categories=None, emi=None, insurance=None,
            digital=None, search: str | None = None) -> DataFrame:
    """The explorer filters; a filter left out admits everything."""
    for column, wanted in (("persona", personas), ("score_category", categories)):
        if wanted is not None:
            dashboard = dashboard.filter(F.col(column).isin(*wanted))
    for column, wanted in (("has_emi", emi), ("has_insurance", insurance), ("high_digital_user", digital)):
        if wanted is not None:
            dashboard = dashboard.filter(F.col(column) == wanted)
    if search:
        dashboard = dashboard.filter(F.lower("user_id").contains(search.lower()))
    return dashboard


def top_users(df: DataFrame, n: int = 10, by: str = "predicted_score") -> DataFrame:
    return df.orderBy(F.desc(by), "user_id").limit(n)


def top_performers_report(dashboard: DataFrame, n: int = 10) -> DataFrame:
    """The best users with formatted columns."""
    best = top_users(dashboard, n)
    return best.select(
        "user_id", "persona", "predicted_score",
        F.format_number("avg_monthly_income", 0).alias("monthly_income"),
        F.format_string("%.2f%%", F.col("emi_regularity_score") * 100).alias("emi_regularity"),
        F.format_string("%.2f%%", F.col("digital_adoption_rate") * 100).alias("digital_adoption"),
        F.format_string("%.3f", F.col("savings_ratio")).alias("savings"))


def _improvable(dashboard: DataFrame) -> DataFrame:
    return dashboard.filter(
        (F.col("score_category") == "Very Poor") & (F.col("digital_adoption_rate") > 0.5)
        & (F.col("bounce_count") == 0))


def improvement_candidates(dashboard: DataFrame, n: int = 20) -> DataFrame:
    """Very Poor users with high adoption and no bounce: a list of n plus the count of all."""
    total = _improvable(dashboard).agg(F.count("*")).scalar()
    return _improvable(dashboard).select(
        "user_id", "persona", "predicted_score", "digital_adoption_rate", "avg_monthly_income", "savings_ratio"
    ).orderBy("user_id").limit(n).withColumn("all_candidates", total)


def tuning_history(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("run_timestamp")).limit(n).select(
        F.col("run_timestamp").cast("string").alias("run_time"), "n_trials",
        F.round("best_auc", 4).alias("best_auc"), F.round("champion_auc", 4).alias("prev_champion"),
        F.round("improvement", 4).alias("improvement"), F.col("promoted").cast("string").alias("promoted"))


def top_features(importance: DataFrame, n: int, by: str = "importance") -> DataFrame:
    return importance.orderBy(F.desc(by), "feature").limit(n)


def user_table(dashboard: DataFrame) -> DataFrame:
    return dashboard.select(*USER_TABLE_COLUMNS)


def profile_listing(profiles: DataFrame) -> DataFrame:
    """The ten columns of the profile page."""
    return profiles.select(*PROFILE_COLUMNS)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "user_id") -> DataFrame:
    """n rows in a reproducible random order (hash of seed and key)."""
    return df.withColumn("_order", text.hash_fraction(F.col(key), seed)).orderBy("_order", key).limit(n).drop("_order")


# --- joins ---------------------------------------------------------------------------

def scores_with_explanations(scores: DataFrame, explanations: DataFrame, how: str = "inner") -> DataFrame:
    return scores.join(explanations.drop("segment"), "user_id", how)


def user_cards(scores: DataFrame, explanations: DataFrame) -> DataFrame:
    """Score card of every user; users without an explanation are kept.  ``scores`` has its provenance columns."""
    points = {f"shap_{p}_pts": f"p{i}" for i, p in enumerate(fv.PILLARS, 1)}
    joined = scores_with_explanations(scores, explanations, "left")
    return joined.select(
        "user_id", text.title_case(F.col("segment")).alias("segment"), "score", "score_band",
        F.round(F.col("default_probability") * 100, 2).alias("default_pct"), "score_timestamp", "model_version",
        "explanation_text", "top_positive_factors", "top_negative_factors",
        *[F.round(c, 1).alias(alias) for c, alias in points.items()])


def user_card(scores: DataFrame, explanations: DataFrame, user_id: str) -> DataFrame:
    """One user's card; the key filter reaches both scans."""
    return user_cards(scores.filter(F.col("user_id") == user_id), explanations.filter(F.col("user_id") == user_id))


def rank_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows per key; Spark prunes each partition to k rows before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def latest_success(log: DataFrame, status: str = "SUCCESS") -> DataFrame:
    """The newest log row with this status."""
    return log.filter(F.col("status") == status).orderBy(F.desc("run_timestamp")).limit(1)
