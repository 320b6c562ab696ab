import pytest
from pyspark.sql import functions as F

from thriftline.functions import fixed_values as fv, scoring
from thriftline.operators import explain, pillar_features, score_tables


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def value(spark, column, **values):
    return one(spark, **values).select(column).first()[0]


@pytest.mark.parametrize("score,band", [(-1, None), (0, "Poor"), (400, "Poor"), (401, "Fair"), (600, "Fair"), (601, "Good"),
                                        (750, "Good"), (751, "Excellent"), (901, "Excellent"), (902, None)])
def test_band_edges(spark, score, band):
    assert value(spark, scoring.score_band(F.col("s")), s=score) == band


@pytest.mark.parametrize("score,label", [(449, "Very Poor"), (450, "Poor"), (549, "Poor"), (550, "Fair"), (650, "Good"), (749, "Good"), (750, "Excellent")])
def test_category_edges(spark, score, label):
    assert value(spark, scoring.score_category(F.col("s")), s=score) == label


@pytest.mark.parametrize("score,tier,app,decision", [
    (399, "building", "Needs Work", "HIGH RISK"), (400, "fair", "Needs Work", "HIGH RISK"), (500, "fair", "Fair", "HIGH RISK"),
    (550, "good", "Fair", "CONDITIONAL APPROVAL"), (699, "good", "Fair", "CONDITIONAL APPROVAL"), (700, "excellent", "Good", "RECOMMEND APPROVAL")])
def test_tiers_labels_and_approval(spark, score, tier, app, decision):
    got = one(spark, s=score).select(*[f(F.col("s")) for f in (scoring.score_tier, scoring.app_label, scoring.approval)]).first()
    assert tuple(got) == (tier, app, decision)


def test_scores_truncate_and_clip(spark):
    assert value(spark, scoring.pd_to_score(F.col("p")), p=0.0999) == 810
    assert [value(spark, scoring.clip_prediction(F.col("p")), p=p) for p in (12.0, 449.5, 950.0)] == [300, 450, 900]
    assert one(spark, p=1.0).select(scoring.clip_prediction(F.lit(None).cast("double"))).first()[0] is None


BASE = dict(emi_regularity_score=1.0, insurance_paid_flag=1, utility_payment_count=3, bounce_count=0, digital_adoption_rate=2.0,
            merchant_diversity_score=100, savings_ratio=5.0, txn_frequency_per_month=500.0, income_stability_score=1.0,
            **{f: 0 for f in fv.PERSONA_FLAGS})


def test_rule_score_components_reach_their_ceilings(spark):
    assert value(spark, scoring.rule_score(), **BASE) == 75 + 50 + 50 + 50 + 100 + 80 + 100 + 80 + 90
    assert value(spark, scoring.rule_score(), **{**BASE, "is_salaried": 1}) == 755
    assert value(spark, scoring.rule_score(F.lit(25.0)), **{**BASE, "is_salaried": 1}) == 780
    assert value(spark, scoring.rule_score(), **{k: 0 for k in BASE}) == 300
    parts = score_tables.score_components(one(spark, **BASE)).first()
    assert (parts["payment_behaviour_score"], parts["digital_flow_score"], parts["income_stability_component"]) == (225, 360, 90)


def test_noise_is_reproducible_and_bounded(spark):
    noise = spark.range(-500, 5000).select(scoring.key_noise(F.col("id")).alias("n"))
    low, high = noise.agg(F.min("n"), F.max("n")).first()
    assert (low, high) == (-25.0, 25.0)


def test_default_risk_is_clipped(spark):
    worst = dict(income_factor=0.0, bill_ontime_rate_24m=0.0, itr_filed=0, owns_land=0, savings_ratio=0.0, svanidhi_repaid=0,
                 fraud_flag=1, bank_vintage_months=0, shg_member=0)
    assert value(spark, scoring.default_risk(F.lit(0.5)), **worst) == 0.65
    best = {**worst, "income_factor": 9.0, "bill_ontime_rate_24m": 9.0, "itr_filed": 1, "owns_land": 1, "fraud_flag": 0, "shg_member": 1}
    assert value(spark, scoring.default_risk(F.lit(0.01)), **best) == 0.005


def test_tips_keep_their_order(spark):
    tips = value(spark, scoring.improvement_tips(), bills_on_time_pct=0.95, upi_txn_count=10)
    assert tips == [fv.IMPROVEMENT_TIPS[1][2], *fv.STANDING_TIPS]


def test_missing_values_count_as_zero_for_tips(spark):
    both = one(spark, k=1).select(F.lit(None).cast("double").alias("bills_on_time_pct"), F.lit(None).cast("int").alias("upi_txn_count"))
    tips = both.select(scoring.improvement_tips().alias("t")).first()["t"]
    assert tips == [t for _, _, t in fv.IMPROVEMENT_TIPS] + list(fv.STANDING_TIPS)


def test_factor_lists(spark):
    listed = [('[{"feature": "a", "direction": "up", "points": 1.5}]', 1), ("[]", 0), ("no list", 0), (None, 0)]
    rows = spark.createDataFrame(listed, "j string, n int").select(scoring.parse_factors(F.col("j")).alias("f"), "n").collect()
    assert all(len(r["f"]) == r["n"] for r in rows) and rows[0]["f"][0]["points"] == 1.5


def test_composites_and_caps(spark):
    row = dict(income_monthly=2400.0, p1_total_bills_24m=240.0, p2_upi_txn_per_month=10.0, p2_merchant_diversity=3.0, p2_failure_rate=0.1,
               itr_filed=1, gst_registered=0, jan_dhan_active=1, shg_member=0, owns_land=1, owns_vehicle=0, has_fd_or_rd=1,
               bank_vintage_months=200, upi_txn_per_month=400, land_acres=12, employment_months=10, svanidhi_repaid=0, fraud_flag=0)
    got = pillar_features.model_ready(pillar_features.composites(one(spark, **row))).first()
    assert got["derived_income_to_bills_ratio"] == round(2400 / 11, 2) and got["derived_digital_engagement"] == 79.0
    assert (got["derived_formal_economy_score"], got["derived_asset_score"]) == (55.0, 80.0)
    assert (got["upi_txn_capped"], got["land_acres_capped"], got["bank_vintage_capped"], got["employment_capped"]) == (300, 10.0, 120, 10)
    assert got["itr_filed_d"] == 1.0


def test_no_bills_and_no_payments_become_zero(spark):
    profiles = spark.createDataFrame([("u", 1000.0)], "user_id string, income_monthly double")
    bills = spark.createDataFrame([], "user_id string, month int, bill_type string, amount double, paid_on_time int, days_late int")
    got = pillar_features.assemble_features(profiles, pillar_features.bill_features(bills)).first()
    assert got["p1_bill_ontime_rate"] == 0.0 and got["p1_payment_trend"] == 0.0


# --- explanations ------------------------------------------------------------------------
def contributions(spark, **values):
    row = {"user_id": "u", "segment": "s", **{n: 0.0 for n in fv.CONTRACT_FEATURES}, **values}
    return one(spark, **row)


def test_pillar_points_clip_and_scale(spark):
    got = explain.pillar_points(contributions(spark, p1_bill_ontime_rate=1.5, p1_payment_trend=1.5, income_log=-0.5)).first()
    assert got["shap_pillar_1_bill_payment_pts"] == 150.0 and got["shap_pillar_4_income_pts"] == -37.5
    assert got["shap_pillar_2_upi_flow_pts"] == 0.0


def test_factors_are_ordered_and_ties_keep_contract_order(spark):
    got = explain.top_factors(contributions(
        spark, fraud_flag_d=0.5, p1_avg_days_late=0.5, income_log=0.2, shg_months=0.1, gst_registered_d=-0.25)).first()
    assert got["top_positive_factors"] == "Average payment delay (+0.50) | Fraud flag (+0.50) | Income level (+0.20)"
    assert got["top_negative_factors"] == "GST registration (-0.25)"
    none = explain.top_factors(contributions(spark)).first()
    assert (none["top_positive_factors"], none["top_negative_factors"]) == (fv.NO_POSITIVE, fv.NO_NEGATIVE)


def test_explanation_wording(spark):
    scores = spark.createDataFrame([("u", 760, "Excellent")], "user_id string, score int, score_band string")
    rows = contributions(spark, income_log=0.3, itr_filed_d=-0.2)
    full = explain.score_explanations(rows, scores).first()["explanation_text"]
    assert full == "Strong profile — score 760. Key strength: Income level. Main opportunity: ITR filing status."
    short = explain.score_explanations(rows, scores, "refresh").first()["explanation_text"]
    assert short == "Score 760 (Excellent). Strength: Income level. Opportunity: ITR filing."
    unknown = explain.score_explanations(contributions(spark), scores.limit(0)).first()["explanation_text"]
    assert unknown == "Needs improvement — score 500. Build payment history to improve."


# --- eligibility ------------------------------------------------------------------------------
def test_eligibility_equals_the_pairwise_rule(spark):
    from thriftline.operators.corpus import priced_schemes
    users = spark.range(0, 1000, 7).select(F.col("id").cast("string").alias("user_id"), F.col("id").cast("int").alias("credit_score"))
    got = score_tables.scheme_eligibility(users, priced_schemes(spark))
    pairs = {(r["user_id"], r["scheme_name"]) for r in got.collect()}

    def admitted(name, score):
        return any(p.strip("%") in name and score >= low for p, low in fv.SCHEME_SCORE_RULES)

    assert pairs == {(str(s), row[1]) for s in range(0, 1000, 7) for row in fv.SCHEME_PRICES if admitted(row[1], s)}
    assert not any(n == "Self Help Group Bank Linkage" for _, n in pairs)  # the SHG rule does not match the long name


def test_large_dimensions_take_the_salted_join(spark):
    from thriftline.plans.joins import join_dimension
    facts = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    small = join_dimension(facts, dim, ["k"])
    salted = join_dimension(facts, dim, ["k"], max_rows=1, salts=5)
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.select(*small.columns).collect()))
    assert salted.count() == 300


def test_rates_divide_by_all_rows(spark):
    """Also by those whose delay or status is unknown."""
    bills = spark.createDataFrame([("u", m, "power", 10.0, p, late) for m, p, late in ((20, 1, 0), (21, 0, 60), (22, 0, None), (23, None, None))],
                                  "user_id string, month int, bill_type string, amount double, paid_on_time int, days_late int")
    found = pillar_features.bill_features(bills).first()
    assert found["p1_severe_late_rate"] == 0.25 and found["p1_avg_days_late"] == 30.0
    upi = spark.createDataFrame([("u", "food", 10.0, s) for s in ("FAILED", "SUCCESS", None, None, None)],
                                "user_id string, category string, amount double, status string")
    assert pillar_features.upi_features(upi).first()["p2_failure_rate"] == 0.2
