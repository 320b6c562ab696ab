"""Row-level scoring expressions; everything stays inside generated JVM code."""
from __future__ import annotations

from functools import reduce
from operator import add, mul

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .rules import at_least, first_match


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def payment_points() -> Column:
    """Up to 225 points for regular EMIs, insurance, utility bills and no bounces."""
    return (
        _zero("emi_regularity_score") * 75
        + _zero("insurance_paid_flag") * 50
        + F.when(F.col("utility_payment_count") >= 3, 50.0).otherwise(0.0)
        + F.when(F.col("bounce_count") == 0, 50.0).otherwise(-50.0)
    )


def digital_points() -> Column:
    """Adoption, diversity, savings and frequency, each with its own ceiling."""
    capped = ((_zero("digital_adoption_rate") * 100, 100.0), (_zero("merchant_diversity_score") * 2, 80.0),
              (_zero("savings_ratio") * 100, 100.0), (_zero("txn_frequency_per_month"), 80.0))
    return reduce(add, [F.least(points, F.lit(ceiling)) for points, ceiling in capped])


def income_points() -> Column:
    return _zero("income_stability_score") * 90


def persona_points() -> Column:
    return reduce(add, [F.col(flag) * float(points) for flag, points in fv.PERSONA_POINTS.items()])


def rule_score(noise: Column | None = None) -> Column:
    """Weighted feature sum, clipped to 300..900 and truncated to an integer.

    ``noise`` defaults to none so that a score is reproducible; pass for example
    ``key_noise(...)`` for the published spread of 25 points either way.
    """
    total = payment_points() + digital_points() + income_points() + persona_points()
    if noise is not None:
        total = total + noise
    return clip(total).cast("int")


def key_noise(key: Column) -> Column:
    """A reproducible whole number in -25..25 from an integer key."""
    return (F.pmod(key * F.lit(7919), F.lit(51)) - 25).cast("double")


def clip(value: Column, low: float = fv.SCORE_FLOOR, high: float = fv.SCORE_CEILING) -> Column:
    """NULL stays NULL (a bare least/greatest would skip it)."""
    bounded = F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
    return F.when(value.isNotNull(), bounded)


def clip_prediction(prediction: Column) -> Column:
    """Model output -> whole score in 300..900."""
    return clip(F.round(prediction, 0)).cast("int")


def score_category(score: Column) -> Column:
    return at_least(score, fv.SCORE_CATEGORIES, fv.LOWEST_CATEGORY)


def score_tier(score: Column) -> Column:
    return at_least(score, fv.SCORE_TIERS, fv.LOWEST_TIER)


def app_label(score: Column) -> Column:
    return at_least(score, fv.APP_LABELS, fv.LOWEST_APP_LABEL)


def approval(score: Column) -> Column:
    return at_least(score, fv.APPROVALS, fv.LOWEST_APPROVAL)


def pd_to_score(probability: Column) -> Column:
    """Default probability -> 0..900, truncated."""
    return (F.lit(900.0) - probability * 900.0).cast("int")


def score_band(score: Column) -> Column:
    """Upper bounds are inclusive; NULL below -1 and above 901."""
    return first_match(
        ((label, (score > -1) & (score <= bound)) for bound, label in fv.SCORE_BANDS), None
    )


def yes_no(predicate: Column) -> Column:
    return F.when(predicate, "Yes").otherwise("No")


def improvement_tips() -> Column:
    """Personal tips first, then the standing ones; a missing value counts as 0."""
    personal = [F.when(_zero(name) < limit, F.lit(tip)) for name, limit, tip in fv.IMPROVEMENT_TIPS]
    return F.array_compact(F.array(*personal, *[F.lit(t) for t in fv.STANDING_TIPS]))


FACTORS = "array<struct<feature string, direction string, points double>>"


def parse_factors(listed: Column) -> Column:
    """A JSON list of factors as an array of structs; what is no list, or null, is an empty one."""
    return F.coalesce(F.from_json(listed, FACTORS), F.array().cast(FACTORS))


def default_risk(base_rate: Column) -> Column:
    """Base rate times one factor per signal, clipped to 0.005..0.65.

    Reads income_factor, bill_ontime_rate_24m, savings_ratio, bank_vintage_months and the
    0/1 flags itr_filed, owns_land, svanidhi_repaid, fraud_flag and shg_member.
    """
    def floor(lowest: float, value: Column) -> Column:
        return F.greatest(F.lit(lowest), value)

    def flag(name: str, factor: float) -> Column:
        return F.when(F.col(name) == 1, factor).otherwise(1.0)

    factors = (
        floor(0.30, 1.80 - 0.80 * F.col("income_factor")),
        floor(0.50, 1.60 - 0.60 * F.col("bill_ontime_rate_24m")),
        flag("itr_filed", 0.55),
        flag("owns_land", 0.65),
        F.when(F.col("savings_ratio") > 0.05, 0.70).otherwise(1.25),
        flag("svanidhi_repaid", 0.80),
        flag("fraud_flag", 1.80),
        floor(0.60, 1.30 - 0.01 * F.col("bank_vintage_months")),
        flag("shg_member", 0.75),
    )
    return clip(reduce(mul, factors, base_rate), 0.005, 0.65)
