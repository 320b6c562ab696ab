"""Queries on profiles, bills, payments, scores and explanations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, scoring, text
from ..operators import analytics, clean, contract, explain, pillar_features as pf, quality, score_tables
from . import inputs, layers, oracle
from .registry import case

_PROFILE = {"income_monthly": 2, "bill_ontime_rate_24m": 4, "savings_ratio": 4, "location_stability": 4, "default_probability": 4}
_P1 = {"p1_bill_ontime_rate": 4, "p1_avg_days_late": 2, "p1_severe_late_rate": 4, "p1_total_bills_24m": 2,
       "p1_ontime_recent_6m": 4, "p1_ontime_first_6m": 4, "p1_payment_trend": 4}
_P2 = {"p2_upi_txn_per_month": 2, "p2_avg_txn_amount": 2, "p2_std_txn_amount": 2, "p2_failure_rate": 4,
       "p2_total_spend_12m": 2, "p2_txn_cv": 4}
_DERIVED = {"derived_income_to_bills_ratio": 2, "derived_digital_engagement": 2,
            "derived_formal_economy_score": 2, "derived_asset_score": 2}


@case("valid_profiles", "B7 B8", "SELECT * FROM v_valid_profiles", **_PROFILE)
def _(spark, d):
    return clean.clean_profiles(inputs.profiles(spark, d))


@case("valid_bills", "B7", "SELECT * FROM v_valid_bills", amount=2)
def _(spark, d):
    return clean.valid_bills(inputs.bills(spark, d))


@case("clean_bills", "B7 B8", "SELECT * FROM v_clean_bills", amount=2)
def _(spark, d):
    return clean.clean_bills(inputs.bills(spark, d))


@case("clean_upi", "B7 B8", "SELECT * FROM v_clean_upi", amount=4)
def _(spark, d):
    return clean.clean_upi(inputs.upi(spark, d))


@case("cleaning_summary_profiles", "B17", """
SELECT b AS rows_before, a AS rows_after, b - a AS rows_dropped, round((b - a) * 100.0::DOUBLE / b, 2) AS dropped_pct
FROM (SELECT count(*) AS b FROM v_profiles), (SELECT count(*) AS a FROM v_valid_profiles)""")
def _(spark, d):
    raw = inputs.profiles(spark, d)
    return quality.cleaning_summary(raw, clean.clean_profiles(raw))


@case("bill_features", "D9", "SELECT * FROM v_p1", **_P1)
def _(spark, d):
    return pf.bill_features(clean.clean_bills(inputs.bills(spark, d)))


@case("upi_features", "D10", "SELECT * FROM v_p2", **_P2)
def _(spark, d):
    return pf.upi_features(clean.clean_upi(inputs.upi(spark, d)))


@case("user_features", "C2 I4 B9", "SELECT * FROM v_user_features", **_PROFILE, **_P1, **_P2, **_DERIVED)
def _(spark, d):
    return pf.user_features(
        clean.clean_profiles(inputs.profiles(spark, d)), clean.clean_bills(inputs.bills(spark, d)),
        clean.clean_upi(inputs.upi(spark, d)))


@case("model_ready", "B10", "SELECT * FROM v_model_ready", **_PROFILE, **_P1, **_P2, **_DERIVED, income_log=4)
def _(spark, d):
    return pf.model_ready(layers.user_features(spark, d))


_CONTRACT = {c: digits for c, digits in {**_PROFILE, **_P1, **_P2, **_DERIVED, "income_log": 4}.items()
             if c in fv.CONTRACT_FEATURES or c == "default_probability"}


@case("feature_contract", "A18 B9", "SELECT * FROM v_gold_pl", **_CONTRACT)
def _(spark, d):
    return layers.gold_pl(spark, d)


@case("segment_summary", "D11", """
SELECT segment, count(*) AS users, round(avg(income_monthly), 0) AS avg_income, round(avg(bill_ontime_rate_24m), 3) AS avg_bill_ontime,
  round(avg(p1_bill_ontime_rate), 3) AS avg_p1_ontime, round(avg(p2_upi_txn_per_month), 1) AS avg_upi_txn,
  round(avg(derived_formal_economy_score), 1) AS avg_formal_score, round(avg(default_label), 3) AS default_rate
FROM v_user_features GROUP BY segment""")
def _(spark, d):
    return analytics.segment_summary(layers.user_features(spark, d))


@case("feature_health", "D12", """
SELECT round(avg(income_log), 3) AS avg_income_log, round(avg(p1_bill_ontime_rate), 3) AS avg_bill_ontime,
  round(avg(p2_upi_txn_per_month), 1) AS avg_upi_txn, round(avg(derived_formal_economy_score), 1) AS avg_formal_score,
  round(avg(derived_asset_score), 1) AS avg_asset_score, round(avg(default_label), 4) AS overall_default_rate,
  count(*) AS total_users FROM v_gold_pl""")
def _(spark, d):
    return analytics.feature_health(layers.gold_pl(spark, d))


# --- scores ----------------------------------------------------------------------------
_TIER = oracle.case_of(((l, f"score >= {b}") for b, l in fv.SCORE_TIERS), oracle.quote(fv.LOWEST_TIER))
_APP = oracle.case_of(((l, f"score >= {b}") for b, l in fv.APP_LABELS), oracle.quote(fv.LOWEST_APP_LABEL))
_APPROVE = oracle.case_of(((l, f"score >= {b}") for b, l in fv.APPROVALS), oracle.quote(fv.LOWEST_APPROVAL))


@case("credit_scores", "I9 I12 I13", f"""
SELECT user_id, segment, default_probability, score, score_band, {_TIER} AS tier, {_APP} AS app_label, {_APPROVE} AS approval
FROM v_scores""")
def _(spark, d):
    base = inputs.scores(spark, d).drop("score", "score_band")
    return score_tables.credit_scores(base).withColumns({
        "tier": scoring.score_tier(F.col("score")), "app_label": scoring.app_label(F.col("score")),
        "approval": scoring.approval(F.col("score"))})


@case("portfolio_kpis", "D13", """
SELECT *, excellent + good AS lendable, round((excellent + good) * 100.0::DOUBLE / total, 0) AS lendable_pct FROM (
SELECT count(*) AS total, round(avg(score), 0) AS avg_score, round(avg(default_probability) * 100, 2) AS avg_default_pct,
  count(*) FILTER (WHERE score_band = 'Excellent') AS excellent, count(*) FILTER (WHERE score_band = 'Good') AS good FROM v_scores)""")
def _(spark, d):
    return analytics.portfolio_kpis(inputs.scores(spark, d))


@case("band_summary", "D14 E1", """
SELECT score_band, count(*) AS users, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct,
  round(avg(score), 0) AS avg_score, round(avg(default_probability) * 100, 2) AS default_pct FROM v_scores GROUP BY score_band""")
def _(spark, d):
    return analytics.band_summary(inputs.scores(spark, d))


@case("segment_share", "E1", """
SELECT segment, count(*) AS users, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM v_scores GROUP BY segment""")
def _(spark, d):
    return analytics.share_of_total(inputs.scores(spark, d), "segment")


@case("score_histogram", "D15", """
SELECT CAST(floor(score / 50.0::DOUBLE) * 50 AS BIGINT) AS bucket, count(*) AS users FROM v_scores GROUP BY 1""")
def _(spark, d):
    return analytics.score_histogram(inputs.scores(spark, d))


_FRACTION = "CAST(('0x' || substr(md5('42:' || user_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@case("sampled_scores", "B19", f"""
SELECT user_id, score, round(default_probability * 100, 2) AS default_pct, score_band, segment
FROM v_scores ORDER BY {_FRACTION}, user_id LIMIT 1500""", default_pct=2)
def _(spark, d):
    return analytics.sample_rows(inputs.scores(spark, d), 1500).select(
        "user_id", "score", F.round(F.col("default_probability") * 100, 2).alias("default_pct"), "score_band", "segment")


# --- explanations -------------------------------------------------------------------------
_PTS = [f"shap_{p}_pts" for p in fv.PILLARS]
_POINTS = {c: 1 for c in _PTS}


@case("pillar_points", "J14", f"SELECT user_id, {', '.join(_PTS)} FROM v_points", **_POINTS)
def _(spark, d):
    return explain.pillar_points(inputs.contributions(spark, d)).select("user_id", *_PTS)


@case("top_factors", "J15 E3", "SELECT user_id, top_positive_factors, top_negative_factors FROM v_factors")
def _(spark, d):
    return explain.top_factors(inputs.contributions(spark, d)).select("user_id", "top_positive_factors", "top_negative_factors")


@case("score_explanations", "J14 J15 J16", "SELECT * FROM v_explanations", **_POINTS)
def _(spark, d):
    return explain.score_explanations(inputs.contributions(spark, d), inputs.scores(spark, d))


@case("score_explanations_refresh", "J16 (refresh wording)", "SELECT * FROM v_explanations_refresh", **_POINTS)
def _(spark, d):
    return explain.score_explanations(inputs.contributions(spark, d), inputs.scores(spark, d), "refresh")


@case("mean_abs_contribution", "J17", "SELECT feature, avg(abs(value)) AS mean_abs, CASE feature " + " ".join(
    f"WHEN '{n}' THEN '{p}'" for n, (p, _) in fv.CONTRACT_FEATURES.items()) + " END AS pillar FROM v_long GROUP BY feature",
    mean_abs=6)
def _(spark, d):
    return explain.mean_abs_contribution(inputs.contributions(spark, d))


def _mean_sql(points: str) -> str:
    return f"round(CAST(sum(CAST(round({points} * 10, 0) AS BIGINT)) AS DOUBLE) / 10.0::DOUBLE / count({points}), 1)"


@case("segment_pillars", "D22 C4", "SELECT s.segment, count(*) AS users, round(avg(score), 0) AS avg_score, "
      "round(avg(default_probability) * 100, 2) AS default_pct, "
      + ", ".join(f"{_mean_sql(c)} AS p{i}" for i, c in enumerate(_PTS, 1))
      + " FROM v_scores s JOIN v_explanations e USING (user_id) GROUP BY s.segment", **{f"p{i}": 1 for i in range(1, 7)})
def _(spark, d):
    return analytics.segment_pillars(inputs.scores(spark, d), layers.explanations(spark, d))


@case("pillar_importance", "D23", " UNION ALL ".join(
    f"SELECT '{n}' AS pillar, {_mean_sql(f'abs(shap_{p}_pts)')} AS avg_abs_points FROM v_explanations"
    for p, n in analytics.PILLAR_NAMES.items()), avg_abs_points=1)
def _(spark, d):
    return analytics.pillar_importance(layers.explanations(spark, d))


_CARD = f"""SELECT user_id, {{title}} AS segment, score, score_band, round(default_probability * 100, 2) AS default_pct,
  max_order AS score_timestamp, 'v' || length(score_band) AS model_version, explanation_text, top_positive_factors, top_negative_factors, {', '.join(f'round({c}, 1) AS p{i}' for i, c in enumerate(_PTS, 1))}
FROM v_scores s LEFT JOIN (SELECT * EXCLUDE (segment) FROM v_explanations) e USING (user_id)
LEFT JOIN (SELECT 'USR-' || o_custkey AS user_id, max(o_orderdate) AS max_order FROM orders GROUP BY 1) USING (user_id)"""
_TITLE = "CASE s.segment " + " ".join(
    f"WHEN '{s}' THEN '{s.replace('_', ' ').title()}'" for s in fv.SEGMENTS) + " END"


def _dated_scores(spark, d):
    """Scores with provenance: the time of the user's last order, and a version."""
    seen = inputs.table(spark, d, "orders").groupBy(F.concat(F.lit("USR-"), F.col("o_custkey").cast("string")).alias("user_id")).agg(
        F.max("o_orderdate").alias("score_timestamp"))
    version = F.concat(F.lit("v"), F.length("score_band").cast("string"))
    return inputs.scores(spark, d).join(seen, "user_id", "left").withColumn("model_version", version)


@case("profile_listing", "F5", """
SELECT user_id, segment, state, bill_ontime_rate_24m, k % 25 AS bill_streak_months, (k % 20) / 100.0::DOUBLE AS nach_bounce_rate, income_monthly,
  upi_txn_per_month, round(income_monthly / 50, 2) AS upi_avg_txn_amount, round(income_monthly / 50 * upi_txn_per_month, 2) AS upi_monthly_credit
FROM (SELECT *, CAST(substr(user_id, 5) AS BIGINT) AS k FROM v_profiles)""",
      bill_ontime_rate_24m=2, nach_bounce_rate=2, income_monthly=2, upi_avg_txn_amount=1, upi_monthly_credit=1)
def _(spark, d):
    k, income = F.substring("user_id", 5, 20).cast("long"), F.col("income_monthly")
    return analytics.profile_listing(inputs.profiles(spark, d).withColumns({
        "bill_streak_months": k % 25, "nach_bounce_rate": (k % 20) / 100.0, "upi_avg_txn_amount": F.round(income / 50, 2),
        "upi_monthly_credit": F.round(income / 50 * F.col("upi_txn_per_month"), 2)}))


@case("parsed_factors", "2.8 JSON", " UNION ALL ".join(
    f"SELECT user_id, '{p}' AS feature, CASE WHEN shap_{p}_pts < 0 THEN 'down' ELSE 'up' END AS direction, shap_{p}_pts AS points FROM v_points"
    for p in fv.PILLARS), points=1)
def _(spark, d):
    """Pillar points as JSON lists of factors, parsed again."""
    points = explain.pillar_points(inputs.contributions(spark, d))
    factors = F.array(*[F.struct(
        F.lit(p).alias("feature"), F.when(F.col(f"shap_{p}_pts") < 0, "down").otherwise("up").alias("direction"),
        F.col(f"shap_{p}_pts").alias("points")) for p in fv.PILLARS])
    listed = points.select("user_id", F.to_json(factors).alias("shap_factors"))
    return listed.select("user_id", F.inline(scoring.parse_factors(F.col("shap_factors"))))


@case("user_cards", "C5", _CARD.format(title=_TITLE), default_pct=2, **{f"p{i}": 1 for i in range(1, 7)})
def _(spark, d):
    return analytics.user_cards(_dated_scores(spark, d), layers.explanations(spark, d))


@case("user_card", "B20", _CARD.format(title=_TITLE) + " WHERE user_id = 'USR-7'", default_pct=2, **{f"p{i}": 1 for i in range(1, 7)})
def _(spark, d):
    return analytics.user_card(_dated_scores(spark, d), layers.explanations(spark, d), "USR-7")


# --- joins, eligibility, risk ------------------------------------------------------------------
def _context(spark, d):
    people = inputs.borrowers(spark, d).select("user_id", "occupation", "city", "state")
    flows = inputs.table(spark, d, "events").groupBy(
        F.concat(F.lit("USR-"), F.col("user_id").cast("string")).alias("user_id")).agg(
        F.count("*").alias("total_upi_txns"), F.round(F.sum("value"), 2).alias("total_upi_volume"),
        F.round(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)), 4).alias("bill_ontime_rate"))
    money = inputs.profiles(spark, d).select(
        "user_id", (F.col("income_monthly") * 12).alias("annual_income"), "savings_ratio")
    scores = inputs.scores(spark, d).select("user_id", F.col("score").alias("credit_score"), "score_band")
    factors = layers.explanations(spark, d).select("user_id", "top_positive_factors", "top_negative_factors")
    return score_tables.user_credit_context(people, money.join(flows, "user_id", "left"), scores, factors)


@case("user_credit_context", "C6 I13", "SELECT * FROM v_context",
      annual_income=2, savings_ratio=4, total_upi_volume=2, bill_ontime_rate=4)
def user_credit_context(spark, d):
    return _context(spark, d)


def _schemes(spark):
    from ..operators.corpus import priced_schemes
    return priced_schemes(spark)


@case("scheme_eligibility", "C7 K13", """
SELECT user_id, credit_score, occupation, scheme_name, max_loan_inr, interest_pct, collateral, eligibility FROM v_eligibility""")
def _(spark, d):
    return score_tables.scheme_eligibility(inputs.borrowers(spark, d), _schemes(spark)).select(
        "user_id", "credit_score", "occupation", "scheme_name", "max_loan_inr", "interest_pct", "collateral", "eligibility")


@case("scheme_reach", "D24", "SELECT scheme_name, count(DISTINCT user_id) AS eligible_users FROM v_eligibility GROUP BY scheme_name")
def _(spark, d):
    return analytics.scheme_reach(score_tables.scheme_eligibility(inputs.borrowers(spark, d), _schemes(spark)))


_OFFER = " || ".join(
    f"CASE WHEN {f'credit_score >= {m}' if m is not None else 'regexp_matches(lower(occupation), ' + oracle.quote('|'.join(k)) + ')'} "
    f"THEN {oracle.quote('/'.join((n, a, i, c)) + ';')} ELSE '' END" for n, m, k, a, i, c in fv.APP_SCHEMES)


@case("eligible_schemes", "I14", f"SELECT user_id, credit_score, occupation, {_OFFER} AS offers FROM v_borrowers")
def _(spark, d):
    offered = score_tables.eligible_schemes(inputs.borrowers(spark, d))
    listed = F.transform("schemes", lambda s: F.concat(
        F.concat_ws("/", s["name"], s["amount"], s["interest"], s["collateral"]), F.lit(";")))
    return offered.select("user_id", "credit_score", "occupation", F.array_join(listed, "").alias("offers"))


_ALLOWED = " || ".join(f"CASE WHEN credit_score >= {m} THEN {oracle.quote(n + ';')} ELSE '' END"
                       for n, (m, _) in fv.SCHEME_THRESHOLDS.items())
_LARGEST = "greatest(" + ", ".join(f"CASE WHEN credit_score >= {m} THEN {l} END" for m, l in fv.SCHEME_THRESHOLDS.values()) + ")"


@case("schemes_by_threshold", "I14 (threshold table)", f"""
SELECT user_id, {_ALLOWED} AS names, CAST({_LARGEST} AS INTEGER) AS max_loan FROM v_borrowers""")
def _(spark, d):
    allowed = score_tables.schemes_by_threshold(inputs.borrowers(spark, d))
    listed = F.transform("scheme_names", lambda s: F.concat(s, F.lit(";")))
    return allowed.select("user_id", F.array_join(listed, "").alias("names"), "max_loan")


_RATE = "round(avg(CAST(default_label AS DOUBLE)), 4)"
_RISK = " * ".join((
    "base_default_rate", "greatest(0.3::DOUBLE, 1.8::DOUBLE - 0.8::DOUBLE * income_factor)",
    "greatest(0.5::DOUBLE, 1.6::DOUBLE - 0.6::DOUBLE * bill_ontime_rate_24m)",
    "CASE WHEN itr_filed = 1 THEN 0.55::DOUBLE ELSE 1 END", "CASE WHEN owns_land = 1 THEN 0.65::DOUBLE ELSE 1 END",
    "CASE WHEN savings_ratio > 0.05 THEN 0.7::DOUBLE ELSE 1.25::DOUBLE END",
    "CASE WHEN svanidhi_repaid = 1 THEN 0.8::DOUBLE ELSE 1 END", "CASE WHEN fraud_flag = 1 THEN 1.8::DOUBLE ELSE 1 END",
    "greatest(0.6::DOUBLE, 1.3::DOUBLE - 0.01::DOUBLE * bank_vintage_months)",
    "CASE WHEN shg_member = 1 THEN 0.75::DOUBLE ELSE 1 END"))


@case("default_risk", "I16 C2", f"""
SELECT user_id, segment, base_default_rate, least(greatest({_RISK}, 0.005::DOUBLE), 0.65::DOUBLE) AS default_risk
FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, income_monthly / 40000.0::DOUBLE)) AS income_factor FROM v_profiles)
JOIN (SELECT segment, {_RATE} AS base_default_rate FROM v_profiles GROUP BY segment) USING (segment)""",
      base_default_rate=4, default_risk=6)
def _(spark, d):
    people = inputs.profiles(spark, d)
    rates = people.groupBy("segment").agg(F.round(F.avg("default_label"), 4).alias("base_default_rate"))
    factor = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("income_monthly") / 40000.0))
    return score_tables.with_default_risk(people.withColumn("income_factor", factor), rates).select(
        "user_id", "segment", "base_default_rate", "default_risk")


@case("training_set", "C8", f"SELECT user_id, default_label, {', '.join(fv.CONTRACT_FEATURES)} FROM "
      "(SELECT user_id, default_label FROM v_profiles) LEFT JOIN (SELECT * EXCLUDE (default_label) FROM v_gold_pl) USING (user_id)",
      **{c: n for c, n in _CONTRACT.items() if c in fv.CONTRACT_FEATURES})
def _(spark, d):
    labels = inputs.profiles(spark, d).select("user_id", "default_label")
    features = layers.gold_pl(spark, d).select("user_id", *fv.CONTRACT_FEATURES)
    return contract.training_set(labels, features)


@case("point_in_time_lookup", "C9", """
SELECT event_id, user_id, label_ts, o_orderkey, feature_ts FROM (
  SELECT event_id, user_id, label_ts, o_orderkey, feature_ts,
         row_number() OVER (PARTITION BY event_id ORDER BY feature_ts DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS rn
  FROM (SELECT event_id, user_id, ts - INTERVAL 9131 HOUR * (event_id % 7) AS label_ts FROM events) e
  LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate AS feature_ts FROM orders
             QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) f
    ON f.o_custkey = e.user_id AND f.feature_ts <= e.label_ts) WHERE rn = 1""")
def _(spark, d):
    hours = (F.col("event_id") % 7 * 9131).cast("int")
    labels = inputs.table(spark, d, "events").select(
        "event_id", "user_id", (F.col("ts") - F.make_dt_interval(hours=hours)).alias("label_ts"))
    newest = inputs.table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    features = newest.select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_orderdate").alias("feature_ts"))
    return contract.point_in_time_lookup(labels, features, "user_id", "label_ts", "feature_ts")
