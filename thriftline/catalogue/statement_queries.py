"""Queries on bank statements: cleaning, personas, features, scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, scoring
from ..operators import analytics, clean, quality, score_tables, statement_features as sf
from ..plans.workspace import write_through
from . import inputs, layers, oracle
from .registry import case

_MONEY = {"clean_withdrawal": 2, "clean_deposit": 2, "clean_balance": 2}
_ROW = "user_id, date, particulars, withdrawal, deposit, balance, clean_withdrawal, clean_deposit, clean_balance, particulars_lower, category, transaction_type, merchant"


@case("enriched_statements", "B1 B2 B3 B4 B5 B6 (batch)", f"SELECT {_ROW} FROM v_batch", **_MONEY)
def _(spark, d):
    return layers.enriched(spark, d).drop("chq_num")


@case("enriched_statements_dlt", "B1 B2 B3 B4 B5 B6 (dlt)", f"SELECT {_ROW} FROM v_dlt_raw", **_MONEY)
def _(spark, d):
    return layers.enriched(spark, d, "dlt").drop("chq_num")


@case("alternate_date_format", "B2", """
SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM lineitem""")
def _(spark, d):
    dates = inputs.table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("iso"), F.date_format("l_shipdate", "MM/yyyy").alias("bad"))
    good = clean.parse_date(dates.select(F.col("iso").alias("date")), "yyyy-MM-dd")
    bad = clean.parse_date(dates.select(F.col("bad").alias("date")), "yyyy-MM-dd")
    return good.unionByName(bad).groupBy("date").agg(F.count("*").alias("n"))


@case("category_distribution", "B4 D18", "SELECT category, count(*) AS n FROM v_batch GROUP BY category")
def _(spark, d):
    return analytics.value_distribution(layers.enriched(spark, d), "category")


@case("category_distribution_dlt", "B4 D18 (dlt)", "SELECT category, count(*) AS n FROM v_dlt_raw GROUP BY category")
def _(spark, d):
    return analytics.value_distribution(layers.enriched(spark, d, "dlt"), "category")


@case("merchant_distribution", "B6 D18", "SELECT merchant, count(*) AS n FROM v_batch GROUP BY merchant")
def _(spark, d):
    return analytics.value_distribution(layers.enriched(spark, d), "merchant")


@case("deduplicated_statements", "B8", "SELECT * EXCLUDE (persona, chq_num) FROM v_silver", **_MONEY)
def _(spark, d):
    return layers.silver(spark, d).drop("persona", "chq_num")


@case("quality_report", "B15", """
SELECT count(*) FILTER (WHERE user_id IS NULL) AS null_user_id, count(*) FILTER (WHERE date IS NULL) AS null_date,
  count(*) FILTER (WHERE clean_withdrawal IS NULL AND clean_deposit IS NULL) AS null_both_amounts FROM v_batch""")
def _(spark, d):
    return quality.quality_report(layers.enriched(spark, d))


_SILVER_COLUMNS = ("user_id", "date", "particulars", "chq_num", "withdrawal", "deposit", "balance", "clean_withdrawal", "clean_deposit",
                   "clean_balance", "particulars_lower", "category", "transaction_type", "merchant", "persona")


@case("null_profile", "B16", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM v_silver" for c in _SILVER_COLUMNS))
def _(spark, d):
    return quality.null_profile(layers.silver(spark, d))


@case("cleaning_summary_statements", "B17", """
SELECT b AS rows_before, a AS rows_after, b - a AS rows_dropped, round((b - a) * 100.0::DOUBLE / b, 2) AS dropped_pct
FROM (SELECT count(*) AS b FROM v_batch), (SELECT count(*) AS a FROM v_silver)""")
def _(spark, d):
    return quality.cleaning_summary(layers.enriched(spark, d), layers.silver(spark, d))


# --- expectations -----------------------------------------------------------------
def _unsigned_statements(spark, d):
    rows = inputs.statements(spark, d).withColumn("_rescued_data", F.lit(None).cast("string"))
    return clean.parse_date(rows.withColumn("balance", F.translate("balance", "-", "")))


_EXPECT = {
    "critical_no_negative_balance": ("fail", "TRY_CAST(replace(balance, ',', '') AS DOUBLE) >= 0"),
    "valid_user_id": ("drop", f"user_id IS NOT NULL AND regexp_matches(user_id, '{fv.USER_ID_PATTERN}')"),
    "valid_date": ("drop", "date IS NOT NULL"),
    "valid_transaction": ("drop", "(withdrawal IS NOT NULL OR deposit IS NOT NULL)"),
    "realistic_amounts": ("drop", f"TRY_CAST(regexp_replace(withdrawal, '[^0-9.]', '', 'g') AS DOUBLE) < {fv.LARGEST_WITHDRAWAL}"),
    "high_quality_data": ("warn", "TRUE"),
    "recent_transactions": ("warn", f"datediff('day', date, DATE '{layers.AS_OF}') < {fv.FRESH_DAYS}"),
}


def _metrics_sql(source: str, rules: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS rule, '{s}' AS severity, count(*) FILTER (WHERE coalesce({p}, TRUE)) AS passed, "
        f"count(*) FILTER (WHERE NOT coalesce({p}, TRUE)) AS failed FROM {source}" for n, (s, p) in rules.items())


@case("expectation_metrics", "B13", _metrics_sql("v_batch", _EXPECT))
def _(spark, d):
    rows = clean.parse_date(inputs.statements(spark, d)).withColumn("_rescued_data", F.lit(None).cast("string"))
    return quality.expectation_metrics(rows, quality.statement_expectations(layers.AS_OF))


_KEPT = " AND ".join(f"coalesce({p}, TRUE)" for s, p in _EXPECT.values() if s == "drop")


@case("expectation_kept_rows", "B13", f"""
SELECT user_id, date, particulars, withdrawal, deposit, replace(balance, '-', '') AS balance FROM v_batch WHERE {_KEPT}""")
def _(spark, d):
    kept, _metrics = quality.expect(_unsigned_statements(spark, d), quality.statement_expectations(layers.AS_OF))
    return kept.select("user_id", "date", "particulars", "withdrawal", "deposit", "balance")


_BROKEN = " || ".join(
    f"CASE WHEN coalesce({p}, TRUE) THEN '' ELSE '{n};' END" for n, (s, p) in _EXPECT.items() if s != "warn")


@case("quarantined_rows", "B14", f"""
SELECT * FROM (SELECT user_id, date, particulars, balance, {_BROKEN} AS broken FROM v_batch) WHERE broken <> ''""")
def _(spark, d):
    rows = clean.parse_date(inputs.statements(spark, d)).withColumn("_rescued_data", F.lit(None).cast("string"))
    bad = quality.quarantine(rows, quality.statement_expectations(layers.AS_OF))
    return bad.select("user_id", "date", "particulars", "balance",
                      F.concat(F.array_join("broken_rules", ";"), F.lit(";")).alias("broken"))


@case("feature_expectations", "B13 (gold)", _metrics_sql("v_gold", {
    "sufficient_transaction_history": ("warn", "total_transactions >= 10"), "valid_persona": ("warn", "persona IS NOT NULL")}))
def _(spark, d):
    return quality.expectation_metrics(layers.gold(spark, d), quality.feature_expectations())


# --- personas and features -----------------------------------------------------------
@case("persona_distribution", "B1-B6 D1 I1 C1 D18 (flagship)",
      "SELECT persona, count(*) AS n FROM v_with_persona GROUP BY persona")
def persona_distribution(spark, d):
    rows = write_through(layers.enriched(spark, d), "enriched")  # read for the signals and for the rows
    return analytics.value_distribution(sf.attach_persona(rows, sf.user_personas(rows)), "persona")


@case("persona_signals", "D1 I1", "SELECT * FROM v_personas",
      total_gig_income=2, total_salary=2, total_business_income=2, total_credits=2, total_debits=2)
def _(spark, d):
    return sf.user_personas(layers.enriched(spark, d))


@case("personas_dlt", "I1 (dlt)", "SELECT *, 0 AS _x FROM v_dlt_personas")
def _(spark, d):
    return sf.user_personas(layers.enriched(spark, d, "dlt"), "dlt").drop("total_transactions").withColumn("_x", F.lit(0))


@case("transactions_with_persona", "C1", "SELECT * EXCLUDE (chq_num) FROM v_dlt", **_MONEY)
def _(spark, d):
    return layers.silver_dlt(spark, d).drop("chq_num")


_D = oracle.GOLD_DOUBLES


def _only(columns):
    return {c: _D[c] for c in columns if c in _D}


@case("payment_features", "D2 I2", "SELECT * FROM v_payment", **_only(sf.PAYMENT_COLUMNS))
def _(spark, d):
    return sf.payment_features(layers.silver(spark, d))


@case("digital_features", "D3 I2", "SELECT * FROM v_digital", **_only(sf.DIGITAL_COLUMNS))
def _(spark, d):
    return sf.digital_features(layers.silver(spark, d))


@case("monthly_income", "D4 B12", "SELECT * FROM v_monthly", monthly_income=2)
def _(spark, d):
    return sf.monthly_income(layers.silver(spark, d))


@case("income_features", "D5 I3", "SELECT * FROM v_income", **_only(sf.MONTHLY_INCOME_COLUMNS))
def _(spark, d):
    return sf.income_features(sf.monthly_income(layers.silver(spark, d)))


@case("income_type_features", "D6", "SELECT * FROM v_income_types", **_only(oracle.INCOME))
def _(spark, d):
    return sf.income_type_features(layers.silver(spark, d))


@case("persona_risk_features", "D7 B11", "SELECT * FROM v_risk", account_age_months=4)
def _(spark, d):
    return sf.persona_risk_features(layers.silver(spark, d))


@case("statement_gold", "C2 D2-D7 I2 I3 B9 B11 B12 (73 columns)", "SELECT * FROM v_gold", **_D)
def _(spark, d):
    return sf.statement_features(layers.silver(spark, d))


@case("statement_gold_dlt", "D8 I2 I3 I8 (74 columns)", "SELECT * FROM v_gold_dlt", **oracle.DLT_DOUBLES)
def _(spark, d):
    return sf.statement_features_dlt(layers.silver_dlt(spark, d))


# --- scores ---------------------------------------------------------------------------
@case("rule_score", "I5", "SELECT user_id, rule_score, noisy_score FROM v_scored")
def _(spark, d):
    key = F.regexp_replace(F.regexp_replace("user_id", "USR-", ""), "BAD", "0").cast("long")
    scored = score_tables.with_rule_score(layers.gold(spark, d))
    return score_tables.with_rule_score(scored, scoring.key_noise(key), "noisy_score").select(
        "user_id", "rule_score", "noisy_score")


@case("dashboard_table", "I6 I7 I8 I10 I11", f"SELECT {', '.join(score_tables.DASHBOARD_COLUMNS)} FROM v_dashboard",
      **_only(score_tables.DASHBOARD_COLUMNS))
def _(spark, d):
    return layers.dashboard(spark, d)


@case("prediction_table", "I7 I10 I11", f"SELECT {', '.join(score_tables.PREDICTION_COLUMNS)} FROM v_dashboard",
      **_only(score_tables.PREDICTION_COLUMNS))
def _(spark, d):
    scored = score_tables.with_rule_score(layers.gold(spark, d), column="prediction")
    return score_tables.prediction_table(scored)


@case("risk_flags_dlt", "I8 (dlt)", """
SELECT user_id, CASE WHEN bounce_count > 0 THEN 1 ELSE 0 END AS bounce_count_risk,
  CASE WHEN sip_payment_count = 0 THEN 1 ELSE 0 END AS sip_count_risk,
  CASE WHEN insurance_payment_count = 0 THEN 1 ELSE 0 END AS insurance_count_risk FROM v_gold_dlt""")
def _(spark, d):
    return sf.statement_features_dlt(layers.silver_dlt(spark, d)).select(
        "user_id", "bounce_count_risk", "sip_count_risk", "insurance_count_risk")


# --- dashboard reports ------------------------------------------------------------------
@case("explorer", "B18", """
SELECT user_id, persona, predicted_score, score_category, has_emi, has_insurance, high_digital_user FROM v_dashboard
WHERE persona IN ('Farmer', 'Salaried_Employee', 'Casual_User') AND score_category IN ('Poor', 'Very Poor', 'Fair')
  AND has_emi = 'Yes' AND lower(user_id) LIKE '%usr-1%'""")
def _(spark, d):
    return analytics.explore(
        layers.dashboard(spark, d), ["Farmer", "Salaried_Employee", "Casual_User"], ["Poor", "Very Poor", "Fair"],
        emi="Yes", search="USR-1",
    ).select("user_id", "persona", "predicted_score", "score_category", "has_emi", "has_insurance", "high_digital_user")


@case("explorer_kpis", "D19", """
SELECT count(*) AS users, avg(predicted_score) AS avg_score, count(*) FILTER (WHERE score_category = 'Poor') AS poor,
  count(*) FILTER (WHERE score_category = 'Very Poor') AS very_poor, count(*) FILTER (WHERE bounce_count > 0) AS high_risk,
  avg(digital_adoption_rate) * 100 AS digital_adoption_pct FROM v_dashboard""", avg_score=4, digital_adoption_pct=4)
def _(spark, d):
    return analytics.explorer_kpis(layers.dashboard(spark, d))


@case("persona_scores", "D20", """
SELECT persona, avg(predicted_score) AS avg_score, avg(payment_behaviour_score) AS avg_payment,
  avg(digital_flow_score) AS avg_digital, avg(income_stability_component) AS avg_income FROM v_dashboard GROUP BY persona""",
      avg_score=4, avg_payment=4, avg_digital=4, avg_income=4)
def _(spark, d):
    return analytics.persona_scores(layers.dashboard(spark, d))


@case("risk_characteristics", "D21", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} = 'Yes') AS {c}" for c in ("has_bounce", "has_insurance", "has_emi", "high_digital_user"))
    + " FROM v_dashboard")
def _(spark, d):
    return analytics.risk_characteristics(layers.dashboard(spark, d))


@case("score_category_distribution", "D18", "SELECT score_category, count(*) AS n FROM v_dashboard GROUP BY score_category")
def _(spark, d):
    return analytics.value_distribution(layers.dashboard(spark, d), "score_category")


@case("score_distribution", "D16", """
SELECT min(predicted_score) AS min_score, quantile_disc(predicted_score, 0.25) AS p25, quantile_disc(predicted_score, 0.5) AS median,
  avg(predicted_score) AS avg_score, quantile_disc(predicted_score, 0.75) AS p75, max(predicted_score) AS max_score
FROM v_dashboard""", avg_score=4)
def _(spark, d):
    return analytics.score_distribution(layers.dashboard(spark, d), "predicted_score")


_SUMMARY = ["avg_monthly_income", "emi_regularity_score", "savings_ratio", "digital_adoption_rate",
            "merchant_diversity_score", "income_stability_score", "bounce_count"]


@case("feature_summary", "D17", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS stddev, min(x) AS min, "
    f"quantile_disc(x, 0.25) AS p25, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.75) AS p75, max(x) AS max "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM v_gold)" for c in _SUMMARY),
    mean=3, stddev=3, min=3, p25=3, p50=3, p75=3, max=3)
def _(spark, d):
    return analytics.feature_summary(layers.gold(spark, d), _SUMMARY)


@case("equal_score_bins", "D15", """
SELECT CAST(least(coalesce(floor((predicted_score - lo) * 30.0::DOUBLE / nullif(hi - lo, 0)), 0) + 1, 30) AS BIGINT) AS bin,
  count(*) AS users FROM v_dashboard, (SELECT min(predicted_score) AS lo, max(predicted_score) AS hi FROM v_dashboard) GROUP BY 1""")
def _(spark, d):
    return analytics.equal_bins(layers.dashboard(spark, d), 30, "predicted_score")


@case("income_score_frame", "D28", """
SELECT user_id, persona, avg_monthly_income, predicted_score, score_category, q AS income_limit, avg_monthly_income <= q AS in_view
FROM v_dashboard, (SELECT quantile_disc(avg_monthly_income, 0.95) AS q FROM v_dashboard)""",
      avg_monthly_income=4, income_limit=4)
def _(spark, d):
    return analytics.income_score_frame(layers.dashboard(spark, d))


@case("silver_summary", "D29", """
SELECT count(*) AS total_rows, count(DISTINCT user_id) AS unique_users, min(date) AS first_date, max(date) AS last_date FROM v_silver""")
def _(spark, d):
    return analytics.silver_summary(layers.silver(spark, d))


@case("top_users", "F1", """
SELECT user_id, persona, predicted_score, score_category FROM v_dashboard ORDER BY predicted_score DESC, user_id LIMIT 15""")
def _(spark, d):
    return analytics.top_users(layers.dashboard(spark, d), 15).select(
        "user_id", "persona", "predicted_score", "score_category")


@case("top_performers_report", "F1 (formatted)", """
SELECT user_id, persona, predicted_score, format('{:,.0f}', avg_monthly_income) AS monthly_income,
  printf('%.2f%%', emi_regularity_score * 100) AS emi_regularity, printf('%.2f%%', digital_adoption_rate * 100) AS digital_adoption,
  printf('%.3f', savings_ratio) AS savings FROM v_dashboard ORDER BY predicted_score DESC, user_id LIMIT 10""")
def _(spark, d):
    return analytics.top_performers_report(layers.dashboard(spark, d))


@case("improvement_candidates", "F2", """
SELECT user_id, persona, predicted_score, digital_adoption_rate, avg_monthly_income, savings_ratio,
  count(*) OVER () AS all_candidates FROM v_dashboard
WHERE score_category = 'Very Poor' AND digital_adoption_rate > 0.5 AND bounce_count = 0 ORDER BY user_id LIMIT 20""",
      digital_adoption_rate=4, avg_monthly_income=4, savings_ratio=4)
def _(spark, d):
    return analytics.improvement_candidates(layers.dashboard(spark, d))


@case("user_table", "F5", f"SELECT {', '.join(analytics.USER_TABLE_COLUMNS)} FROM v_dashboard",
      **_only(analytics.USER_TABLE_COLUMNS))
def _(spark, d):
    return analytics.user_table(layers.dashboard(spark, d))


_TIPS = " || ".join([
    *[f"CASE WHEN coalesce({c}, 0) < {limit} THEN {oracle.quote(tip + ' | ')} ELSE '' END" for c, limit, tip in fv.IMPROVEMENT_TIPS],
    *[oracle.quote(tip + " | ") for tip in fv.STANDING_TIPS]])


@case("improvement_tips", "I15", f"""
SELECT user_id, bills_on_time_pct, upi_txn_count, {_TIPS} AS tips
FROM (SELECT user_id, CASE WHEN segment <> 'rural_farmer' THEN bill_ontime_rate_24m END AS bills_on_time_pct,
             CASE WHEN segment <> 'kirana_owner' THEN upi_txn_per_month * 2 END AS upi_txn_count FROM v_profiles)""",
      bills_on_time_pct=4)
def _(spark, d):
    """Farmers have no bills on record, shops no payments: both count as 0."""
    segment = F.col("segment")
    people = inputs.profiles(spark, d).select(
        "user_id", F.when(segment != "rural_farmer", F.col("bill_ontime_rate_24m")).alias("bills_on_time_pct"),
        F.when(segment != "kirana_owner", F.col("upi_txn_per_month") * 2).alias("upi_txn_count"))
    tips = F.transform(scoring.improvement_tips(), lambda tip: F.concat(tip, F.lit(" | ")))
    return people.withColumn("tips", F.array_join(tips, ""))
