"""Reader-facing explanations from per-feature contributions (positive = helps the score)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, rules

# Clip range, points per pillar and number of factors
CLIP, PILLAR_POINTS, TOP_FACTORS = 2.0, 150.0, 3
OPENERS = {"Excellent": "Strong profile", "Good": "Good profile", "Fair": "Developing profile"}


def pillar_map() -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {p: [] for p in fv.PILLARS}
    for name, (pillar, _) in fv.CONTRACT_FEATURES.items():
        if pillar in grouped:
            grouped[pillar].append(name)
    return grouped


def pillar_points(contributions: DataFrame, pillars: dict[str, list[str]] | None = None) -> DataFrame:
    """Sum per pillar, clip, scale to +-150, one decimal -> ``shap_<pillar>_pts``."""
    def points(names: list[str]) -> Column:
        total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
        return F.round(F.greatest(F.least(total, F.lit(CLIP)), F.lit(-CLIP)) / CLIP * PILLAR_POINTS, 1)

    grouped = pillars or pillar_map()
    return contributions.withColumns({f"shap_{p}_pts": points(names) for p, names in grouped.items()})


def _ranked(labels: dict[str, str], descending: bool) -> Column:
    """Features as structs, best first; ties keep contract order."""
    sign = -1.0 if descending else 1.0
    entries = [
        F.struct((F.col(name) * sign).alias("order"), F.lit(i).alias("i"),
                 F.col(name).alias("value"), F.lit(label).alias("label"))
        for i, (name, label) in enumerate(labels.items())
    ]
    return F.array_sort(F.array(*entries))


def _factor_lines(top: Column, positive: bool) -> Column:
    kept = F.filter(top, lambda s: s["value"] > 0 if positive else s["value"] < 0)
    sign = "+" if positive else ""
    return F.array_join(F.transform(
        kept, lambda s: F.format_string(f"%s ({sign}%.2f)", s["label"], s["value"])), " | ")


def contract_labels(variant: str = "full") -> dict[str, str]:
    if variant == "refresh":
        return {name: fv.REFRESH_LABELS.get(name, name) for name in fv.CONTRACT_FEATURES}
    return {name: label for name, (_, label) in fv.CONTRACT_FEATURES.items()}


def top_factors(contributions: DataFrame, k: int = TOP_FACTORS, variant: str = "full") -> DataFrame:
    """``top_positive_factors`` and ``top_negative_factors`` as ``label (+0.12) | ...`` text."""
    labels = contract_labels(variant)
    # one projection per step, so that a ranking is sorted and formatted once per row
    ranked = contributions.withColumns({
        "_best": F.slice(_ranked(labels, True), 1, k), "_worst": F.slice(_ranked(labels, False), 1, k)})
    lines = ranked.withColumns({
        "_gains": _factor_lines(F.col("_best"), True), "_losses": _factor_lines(F.col("_worst"), False),
        "_best_label": F.col("_best")[0]["label"], "_worst_label": F.col("_worst")[0]["label"]})

    def or_else(column: str, nothing: str) -> Column:
        return F.when(F.col(column) == "", F.lit(nothing)).otherwise(F.col(column))

    return lines.withColumns({
        "top_positive_factors": or_else("_gains", fv.NO_POSITIVE),
        "top_negative_factors": or_else("_losses", fv.NO_NEGATIVE)}).drop("_best", "_worst", "_gains", "_losses")


def _headline(factors: Column) -> Column:
    first = F.substring_index(factors, " | ", 1)
    return F.trim(F.substring_index(first, "(", 1))


def explanation_text(df: DataFrame, variant: str = "full") -> DataFrame:
    """One sentence per user from score, band and top factors.

    full: opener by band, strength, opportunity.  refresh: the shorter wording.
    A user without a score is described as 500.
    """
    if variant == "refresh":
        head = F.format_string("Score %d (%s).", F.col("score"), F.col("score_band"))
        named = F.format_string("%s Strength: %s. Opportunity: %s.", head, F.col("_best_label"), F.col("_worst_label"))
        some = F.col("top_positive_factors") != fv.NO_POSITIVE
        text = F.when(some, named).otherwise(F.concat(head, F.lit(" Build payment history to improve.")))
        return df.withColumn("explanation_text", text)
    opener = rules.first_match(
        ((words, F.col("score_band") == band) for band, words in OPENERS.items()), "Needs improvement")
    head = F.format_string("%s — score %d.", opener, F.coalesce("score", F.lit(500)))
    strength, chance = _headline(F.col("top_positive_factors")), _headline(F.col("top_negative_factors"))
    text = F.when(
        strength == fv.NO_POSITIVE, F.concat(head, F.lit(" Build payment history to improve."))
    ).otherwise(F.format_string("%s Key strength: %s. Main opportunity: %s.", head, strength, chance))
    return df.withColumn("explanation_text", text)


def score_explanations(contributions: DataFrame, scores: DataFrame, variant: str = "full") -> DataFrame:
    """Contributions + scores -> the explanation table (11 columns)."""
    factors = top_factors(pillar_points(contributions), variant=variant)
    joined = factors.join(scores.select("user_id", "score", "score_band"), "user_id", "left")
    points = [f"shap_{p}_pts" for p in fv.PILLARS]
    return explanation_text(joined, variant).select(
        "user_id", "segment", "explanation_text", "top_positive_factors", "top_negative_factors", *points)


def mean_abs_contribution(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature with its pillar, largest first.

    One wide aggregate row is unpivoted afterwards, so the table is read once
    and never multiplied by the number of features.
    """
    names = list(fv.CONTRACT_FEATURES)
    means = contributions.agg(*[F.avg(F.abs(n)).alias(n) for n in names])
    long = means.unpivot([], names, "feature", "mean_abs")
    pairs = [F.lit(x) for name, (pillar, _) in fv.CONTRACT_FEATURES.items() for x in (name, pillar)]
    tagged = long.withColumn("pillar", F.element_at(F.create_map(*pairs), F.col("feature")))
    return tagged.orderBy(F.desc("mean_abs"), "feature")
