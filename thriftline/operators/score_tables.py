"""Score columns, dashboard tables and scheme eligibility."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, scoring
from ..plans.joins import join_dimension

# Output column lists
PREDICTION_COLUMNS = [
    "user_id", "persona", "predicted_score", "score_category", "avg_monthly_income", "emi_regularity_score",
    "digital_adoption_rate", "savings_ratio", "merchant_diversity_score", "income_stability_score", "bounce_count",
]
DASHBOARD_COLUMNS = [
    "user_id", "persona", "predicted_score", "score_category",
    "payment_behaviour_score", "digital_flow_score", "income_stability_component",
    "avg_monthly_income", "total_transactions", "active_months", "emi_regularity_score",
    "digital_adoption_rate", "savings_ratio", "merchant_diversity_score", "income_stability_score",
    "has_bounce", "has_insurance", "has_emi", "high_digital_user", "bounce_count",
    "total_credits", "total_debits", "total_utility_spend", "total_emi_paid", "total_sip_invested",
]


def with_rule_score(features: DataFrame, noise: Column | None = None, column: str = "rule_score") -> DataFrame:
    return features.withColumn(column, scoring.rule_score(noise))


def score_components(df: DataFrame) -> DataFrame:
    """Payment, digital and income parts of the score as whole points."""
    parts = {"payment_behaviour_score": scoring.payment_points(),
             "digital_flow_score": scoring.digital_points(),
             "income_stability_component": scoring.income_points()}
    return df.withColumns({name: F.round(points, 0).cast("int") for name, points in parts.items()})


def risk_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "has_bounce": scoring.yes_no(F.col("bounce_count") > 0),
        "has_insurance": scoring.yes_no(F.col("insurance_paid_flag") > 0),
        "has_emi": scoring.yes_no(F.col("emi_payment_count") > 0),
        "high_digital_user": scoring.yes_no(F.col("digital_adoption_rate") > 0.5),
    })


def with_predicted_score(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    scored = df.withColumn("predicted_score", scoring.clip_prediction(F.col(prediction)))
    return scored.withColumn("score_category", scoring.score_category(F.col("predicted_score")))


def prediction_table(predictions: DataFrame) -> DataFrame:
    return with_predicted_score(predictions).select(*PREDICTION_COLUMNS)


def dashboard_table(predictions: DataFrame) -> DataFrame:
    """The 25-column dashboard table from features plus a ``prediction`` column."""
    return risk_flags(score_components(with_predicted_score(predictions))).select(*DASHBOARD_COLUMNS)


def credit_scores(df: DataFrame, probability: str = "default_probability") -> DataFrame:
    scored = df.withColumn("score", scoring.pd_to_score(F.col(probability)))
    return scored.withColumn("score_band", scoring.score_band(F.col("score")))


def user_credit_context(profiles: DataFrame, features: DataFrame, scores: DataFrame, explanations: DataFrame) -> DataFrame:
    """Profile, features, score and factors of every profile user, with tier and text.

    The text is NULL as soon as one of its parts is NULL.
    """
    joined = profiles
    for part in (features, scores, explanations):
        joined = joined.join(part, "user_id", "left")

    def whole(column: Column) -> Column:
        return F.round(column, 0).cast("long").cast("string")

    text = F.concat(
        F.lit("User Profile: "), F.col("occupation"), F.lit(" from "), F.col("city"), F.lit(", "), F.col("state"),
        F.lit(". Annual income Rs "), whole(F.col("annual_income")),
        F.lit(". Credit score "), F.col("credit_score").cast("string"), F.lit("/900 ("), F.col("score_band"),
        F.lit("). UPI transactions: "), F.col("total_upi_txns").cast("string"),
        F.lit(" totalling Rs "), whole(F.col("total_upi_volume")),
        F.lit(". Bill payment rate: "), whole(F.col("bill_ontime_rate") * 100),
        F.lit("%. Savings ratio: "), whole(F.col("savings_ratio") * 100), F.lit("%."))
    return joined.withColumns({"score_tier": scoring.score_tier(F.col("credit_score")), "rag_text": text})


def _level_of(score: Column, thresholds: list[int]) -> Column:
    """How many thresholds the score reaches: 0 .. len(thresholds)."""
    return F.array_size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= score))


def scheme_minimums(schemes: DataFrame, rules=fv.SCHEME_SCORE_RULES) -> DataFrame:
    """The lowest score that any matching rule of a scheme asks for.

    A later rule can still admit a user whom an earlier matching rule refused,
    because a rule holds only if name and score both match.
    """
    asked = [F.when(F.col("scheme_name").like(pattern), F.lit(minimum)) for pattern, minimum in rules]
    return schemes.withColumn("min_score", F.array_min(F.array(*asked)))


def scheme_eligibility(users: DataFrame, schemes: DataFrame, rules=fv.SCHEME_SCORE_RULES) -> DataFrame:
    """Every (user, scheme) pair that a rule admits.

    Not a cross join: each scheme is expanded over the score levels it admits
    and joined to users on the level, so only eligible pairs are produced.
    """
    thresholds = sorted({minimum for _, minimum in rules})
    known = scheme_minimums(schemes, rules).filter(F.col("min_score").isNotNull())
    levels = F.sequence(_level_of(F.col("min_score"), thresholds), F.lit(len(thresholds)))
    admitted = known.withColumn("_level", F.explode(levels)).drop("min_score")
    leveled = users.filter(F.col("credit_score").isNotNull()).withColumn(
        "_level", _level_of(F.col("credit_score"), thresholds))
    return join_dimension(leveled, admitted, ["_level"], "inner").drop("_level")


def eligible_schemes(users: DataFrame, rules=fv.APP_SCHEMES) -> DataFrame:
    """Schemes per user from score and occupation keywords, as an array of structs in rule order."""
    occupation = F.lower("occupation")

    def offer(name, minimum, keywords, amount, interest, collateral) -> Column:
        admitted = F.col("credit_score") >= minimum if minimum is not None else occupation.rlike("|".join(keywords))
        return F.when(admitted, F.struct(
            F.lit(name).alias("name"), F.lit(amount).alias("amount"),
            F.lit(interest).alias("interest"), F.lit(collateral).alias("collateral")))

    return users.withColumn("schemes", F.array_compact(F.array(*[offer(*rule) for rule in rules])))


def schemes_by_threshold(users: DataFrame, thresholds=None) -> DataFrame:
    """The threshold-table variant: names of admitted schemes and the largest loan among them."""
    table = thresholds or fv.SCHEME_THRESHOLDS
    score = F.col("credit_score")
    names = F.array_compact(F.array(*[F.when(score >= low, F.lit(n)) for n, (low, _) in table.items()]))
    loans = F.array(*[F.when(score >= low, F.lit(loan)) for low, loan in table.values()])
    return users.withColumns({"scheme_names": names, "max_loan": F.array_max(loans)})


def with_default_risk(profiles: DataFrame, base_rates: DataFrame) -> DataFrame:
    """Attach the segment's base rate and apply the risk factors."""
    joined = join_dimension(profiles, base_rates, ["segment"])
    return joined.withColumn("default_risk", scoring.default_risk(F.col("base_default_rate")))
