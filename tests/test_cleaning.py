import datetime as dt

import pytest
from pyspark.sql import functions as F

from thriftline.functions import fixed_values as fv, rules, text
from thriftline.operators import clean, statement_features as sf
from thriftline.plans import joins
from thriftline.plans.workspace import write_through

STATEMENT = "user_id string, date string, particulars string, chq_num string, withdrawal string, deposit string, balance string"


def statements(spark, rows):
    return spark.createDataFrame(rows, STATEMENT)


def categories(spark, texts, variant="batch"):
    df = spark.createDataFrame([(t,) for t in texts], "particulars string")
    rows = clean.categorise(clean.normalise_text(df), variant=variant).collect()
    return {r["particulars"]: r["category"] for r in rows}


def test_rule_order_decides_between_overlapping_keywords(spark):
    got = categories(spark, [
        "GROUP DIVIDEND", "SHG SAVINGS", "LIFE PREMIUM", "SWIGGY PAYOUT", "AJIO ORDER", "CURRENT ACCOUNT",
        "INT.PD SB", "INTXPD SB", "NOTHING KNOWN HERE", "PM-KISAN DBT", "SHG CREDIT"])
    assert got == {
        "GROUP DIVIDEND": "Telecom_Expense",       # 'vi' comes before any dividend rule
        "SHG SAVINGS": "Telecom_Expense",
        "LIFE PREMIUM": "EMI_Loan_Payment",        # 'emi' inside 'premium'
        "SWIGGY PAYOUT": "Food_Delivery",
        "AJIO ORDER": "Telecom_Expense",           # 'jio' inside 'ajio'
        "CURRENT ACCOUNT": "Rent_Expense",
        "INT.PD SB": "Interest_Dividend_Income",
        "INTXPD SB": "Other",                      # the point is literal
        "NOTHING KNOWN HERE": "Other",
        "PM-KISAN DBT": "Govt_DBT_PMKisan",
        "SHG CREDIT": "SHG_Contribution",
    }


def test_every_keyword_reaches_its_rule_or_an_earlier_one(spark):
    words = [(w, i) for i, (_, ws) in enumerate(fv.CATEGORY_RULES) for w in ws if w.replace(" ", "").replace("-", "").isalnum()]
    order = rules.category_names()
    got = categories(spark, [w for w, _ in words])
    assert all(order.index(got[w]) <= i for w, i in words)


def test_dlt_rules_use_their_own_names(spark):
    got = categories(spark, ["JIO RECHARGE", "UPI-PAY", "SALARY", "CHEQUE RETURN", "x"], "dlt")
    assert got == {"JIO RECHARGE": "Telecom_Recharge", "UPI-PAY": "UPI_Payment", "SALARY": "Salary_Income",
                   "CHEQUE RETURN": "Payment_Bounce", "x": "Other"}


def test_amounts_of_both_variants(spark):
    df = statements(spark, [("u", "01-01-2024", "x", None, "1,234.50", None, "-1,000 .00"), ("u", "01-01-2024", "x", None, "", "-5", "n/a")])
    batch = clean.clean_amounts(df).collect()
    assert (batch[0]["clean_withdrawal"], batch[0]["clean_deposit"]) == (1234.5, None)
    assert (batch[1]["clean_withdrawal"], batch[1]["clean_deposit"], batch[1]["clean_balance"]) == (None, -5.0, None)
    dlt = clean.clean_amounts(df, "dlt").collect()
    assert (dlt[0]["clean_withdrawal"], dlt[0]["clean_deposit"], dlt[0]["clean_balance"]) == (1234.5, 0.0, -1000.0)
    assert (dlt[1]["clean_withdrawal"], dlt[1]["clean_deposit"]) == (None, 5.0)  # the sign is lost


def test_unknown_variant_is_refused(spark):
    with pytest.raises(ValueError):
        clean.clean_amounts(statements(spark, []), "other")


def test_bad_dates_become_null(spark):
    df = statements(spark, [("u", d, "x", None, None, None, None) for d in ("31-12-2023", "2023-12-31", "32-01-2024", None)])
    assert [r["date"] for r in clean.parse_date(df).collect()] == [dt.date(2023, 12, 31), None, None, None]


def test_transaction_type_and_merchant(spark):
    df = statements(spark, [("u", "01-01-2024", "UPI-PAY1 X", None, "0.00", None, "1"), ("u", "01-01-2024", "pay AMAZON", None, None, "7", "1"),
                            ("u", "01-01-2024", "lower", None, None, None, "1")])
    batch = clean.enrich(df).collect()
    assert [r["transaction_type"] for r in batch] == ["Debit", "Credit", "Unknown"]
    assert [r["merchant"] for r in batch] == ["UPI-PAY1", "AMAZON", ""]
    dlt = clean.enrich(df, "dlt").collect()
    assert [r["transaction_type"] for r in dlt] == ["Unknown", "Credit", "Unknown"]
    assert [r["merchant"] for r in dlt] == ["", "amazon", ""]


def test_dedupe_keeps_the_smallest_row_whatever_the_input_order(spark):
    rows = [("u", "a", None, 3), ("u", "a", "z", 1), ("u", "b", "x", 2), ("v", None, "y", 9), ("v", None, "y", 8)]
    for sample in (rows, rows[::-1]):
        df = spark.createDataFrame(sample, "user string, k string, t string, n int").repartition(3)
        got = sorted(map(tuple, clean.dedupe(df, ["user", "k"]).collect()), key=str)
        assert got == sorted([("u", "a", None, 3), ("u", "b", "x", 2), ("v", None, "y", 8)], key=str)


def test_fill_numeric_nulls_reaches_counts(spark):
    df = spark.createDataFrame([(None, None, None, "x")], "a long, b double, c int, s string")
    assert tuple(clean.fill_numeric_nulls(df, exclude=["c"]).first()) == (0, 0.0, None, "x")


def test_month_bucket_and_one_hot(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29), "Farmer"), (None, None)], "date date, persona string")
    got = clean.one_hot(clean.month_bucket(df)).collect()
    assert got[0]["month"] == dt.date(2024, 2, 1) and got[0]["is_farmer"] == 1 and got[0]["is_salaried"] == 0
    assert got[1]["month"] is None and got[1]["is_farmer"] == 0


def test_bit_mask_counts_distinct_members_and_refuses_strangers(spark):
    df = spark.createDataFrame([(c,) for c in ("Other", "Education", "Other", None)], "c string")
    mask = F.bit_count(F.bit_or(rules.membership_bit(F.col("c"), rules.category_names())))
    assert df.agg(mask).first()[0] == 2
    with pytest.raises(Exception, match="outside the member list"):
        spark.createDataFrame([("Mystery",)], "c string").agg(F.bit_or(rules.membership_bit(F.col("c"), ["a"]))).collect()
    with pytest.raises(ValueError):
        rules.membership_bit(F.col("c"), [str(i) for i in range(64)])


SIGNALS = {**{n: 0 for n in fv.PERSONA_SIGNALS}, "category_diversity": 1, "total_credits": 0.0, "total_debits": 0.0}


@pytest.mark.parametrize("signals,persona", [
    ({"pmkisan_count": 1, "bounce_count": 9}, "Farmer"), ({"mgnrega_count": 2}, "Casual_User"),
    ({"mgnrega_count": 2, "tractor_emi_count": 1}, "Farmer"),
    ({"gig_income_count": 3, "total_gig_income": 5000.0}, "Casual_User"), ({"gig_income_count": 3, "total_gig_income": 5000.01}, "Gig_Worker"),
    ({"salary_credit_count": 3, "total_salary": 10001.0}, "Salaried_Employee"),
    ({"business_deposit_count": 10, "total_business_income": 15001.0}, "Kirana_Owner"), ({"shg_income_count": 1}, "SHG_Woman"),
    ({"atm_txn_count": 8, "market_txn_count": 3, "total_credits": 19999.0}, "Street_Vendor"),
    ({"atm_txn_count": 8, "market_txn_count": 3, "total_credits": 20000.0}, "Casual_User"),
    ({"sip_count": 2, "insurance_payment_count": 2, "emi_payment_count": 3}, "Financially_Disciplined"),
    ({"sip_count": 2, "insurance_payment_count": 2, "emi_payment_count": 3, "bounce_count": 1}, "High_Risk_Bounces"),
    ({"category_diversity": 10}, "Diverse_Spender"), ({"category_diversity": 9}, "Casual_User"),
])
def test_persona_cascade(spark, signals, persona):
    row = {**SIGNALS, **signals}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    assert sf.assign_persona(df).first()["persona"] == persona


@pytest.mark.parametrize("row,persona", [
    ((1, 9, 9, 17), "Farmer"), ((0, 5, 1, 17), "Salaried_Employee"), ((0, 4, 1, 17), "Gig_Worker"),
    ((0, 0, 0, 16), "Diverse_Spender"), ((0, 0, 0, 15), "Casual_User")])
def test_dlt_persona_cascade(spark, row, persona):
    df = spark.createDataFrame([row], "pmkisan_count int, salary_count int, gig_count int, category_diversity int")
    assert sf.assign_persona(df, "dlt").first()["persona"] == persona


def silver(spark, rows):
    """(user, date, category, withdrawal, deposit) -> minimal silver rows."""
    df = spark.createDataFrame(rows, "user_id string, date date, category string, clean_withdrawal double, clean_deposit double")
    return clean.transaction_type(df.withColumns({
        "particulars": F.lower("category"), "merchant": F.col("category"), "clean_balance": F.lit(100.0), "persona": F.lit("Farmer")}))


def test_one_income_month_has_no_deviation_and_gaps_are_filled(spark):
    rows = [("a", dt.date(2024, 1, 5), "Salary_Income", None, 100.0), ("a", dt.date(2024, 1, 9), "Salary_Income", None, 50.0),
            ("b", dt.date(2024, 3, 31), "Education", 10.0, None), ("b", dt.date(2024, 2, 29), "EMI_Loan_Payment", 30.0, None),
            ("b", dt.date(2024, 2, 29), "EMI_Loan_Payment", 30.0, None), ("c", None, "Other", 1.0, None)]
    txns = silver(spark, rows)
    raw = {r["user_id"]: r for r in sf.income_features(sf.monthly_income(txns)).collect()}
    assert raw["a"]["avg_monthly_income"] == 150.0 and raw["a"]["income_variance"] is None and set(raw) == {"a"}
    gold = {r["user_id"]: r for r in sf.statement_features(txns).collect()}
    assert gold["a"]["income_variance"] == 0.0 and gold["b"]["months_with_income"] == 0  # counts are filled too
    assert gold["b"]["account_age_months"] == 1.0  # both month ends
    assert (gold["b"]["active_days"], gold["b"]["active_months"], gold["b"]["emi_months_active"]) == (2, 2, 1)
    assert gold["b"]["emi_regularity_score"] == 0.5
    assert (gold["c"]["active_days"], gold["c"]["active_months"], gold["c"]["total_transactions"]) == (0, 0, 1)
    assert len(gold["a"]) == 73


def test_a_user_with_most_rows_is_treated_like_any_other(spark):
    """The hot-key path of the persona join gives what the plain join gives."""
    rows = [("hot", dt.date(2024, 1, 1 + i % 28), "Education", float(i), None) for i in range(400)]
    rows += [(f"u{i}", dt.date(2024, 1, 1), "Other", 1.0, None) for i in range(50)] + [(None, dt.date(2024, 1, 1), "Other", 1.0, None)]
    txns = silver(spark, rows).drop("persona")
    keyed = txns.groupBy("user_id").count().select(
        "user_id", F.concat(F.lit("P-"), "user_id").alias("persona"), F.col("count").alias("total_transactions"))
    plain = txns.join(keyed.select("user_id", "persona"), "user_id", "left").select(*txns.columns, "persona")
    split = sf.attach_persona(txns, keyed, hot_rows=100)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_reply_cleaning_reads_the_whole_text(spark):
    long = "<think>" + "y" * 5000 + "</think>" + "z" * 600
    df = spark.createDataFrame([("<think>a\nb</think> hi ",), ("ok <think>never closed",), ("<think>x</think>",), (None,), (long,)], "t string")
    got = [r[0] for r in df.select(text.clean_reply(F.col("t"))).collect()]
    assert got == ["hi", "ok", fv.FALLBACK_REPLY, fv.FALLBACK_REPLY, "z" * 490]


def test_language_codes(spark):
    df = spark.createDataFrame([("hi-IN",), ("ta",), ("xx-YY",), (None,)], "l string")
    code = text.language_code(F.col("l"))
    assert [tuple(r) for r in df.select(code, text.language_name(code)).collect()] == [
        ("hi", "Hindi"), ("ta", "Tamil"), ("hi", "Hindi"), ("hi", "Hindi")]


def test_silver_shuffles_the_rows_once_and_keeps_hot_users_apart(spark):
    """Hot users, rows without a user and duplicates: what the two-shuffle plan gives, in parts that follow the rows."""
    rows = [("hot", dt.date(2024, 1, 1 + i % 28), "Education", float(i), None) for i in range(400)]
    rows += [(f"u{i}", dt.date(2024, 1, 1), "Other", 1.0, None) for i in range(50) for _ in range(2)] + 2 * [(None, dt.date(2024, 1, 1), "Other", 1.0, None)]
    txns = silver(spark, rows).drop("persona")
    personas = txns.groupBy("user_id").count().select(
        "user_id", F.concat(F.lit("P-"), "user_id").alias("persona"), F.col("count").alias("total_transactions"))
    plain = clean.dedupe_statements(sf.attach_persona(txns, personas))
    for hot in (100, 1000):
        got = sf.clustered_silver(txns, personas, hot_rows=hot)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    known, named = (write_through(df.filter("user_id IS NOT NULL"), "known") for df in (txns, personas))
    one = joins.attach_clustered(known, named, "user_id", "persona", "total_transactions",
                                 clean.dedupe_statements, task_rows=50)
    assert one.rdd.getNumPartitions() == 10  # 500 rows, 50 a task
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "date#" in line for line in plan.splitlines())  # not shuffled to remove duplicates


def test_only_narrow_rows_are_kept_per_month(spark):
    """Measures that need no month are summed per user at once."""
    txns = silver(spark, [("u", dt.date(2024, m, 1), "Education", 1.0, None) for m in (1, 2)])
    for table in (sf.statement_features(txns), sf.digital_features(txns)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        monthly = [line for line in plan.splitlines() if "HashAggregate(keys=" in line and "month#" in line.split("functions=")[0]]
        assert monthly and all("merge_" in line or line.count("partial_") <= 6 for line in monthly)
