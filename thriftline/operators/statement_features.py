"""User-level features from categorised statements.

The batch variant aggregates few measures in two steps, first per user and month
and then per user, and all others per user (dlt: all in two steps): users have few rows a month, so
wide rows per month would be more data than the statements.  The two steps give
the monthly income series and replace every ``COUNT(DISTINCT)`` over dates,
months, categories and (dlt) merchants by sums and bit masks: days of a month
and category names are bounded sets, so a ``bit_or`` mask per group counts them
exactly without multiplying rows.  Only batch merchants are unbounded; they are
counted in a two-column side branch.  All first-step measures combine on the
map side, so a user who holds a large share of the rows is reduced to a few
rows per task before any shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, rules
from ..plans.joins import HOT_ROWS, attach_by_key, attach_clustered
from .clean import dedupe_statements, enrich, fill_numeric_nulls, month_bucket

# --- fixed values: feature name -> (measure, categories) ----------------------
# Column names and the categories behind them are the table's contract.
_PAYMENT = {
    "total_utility_spend": ("withdrawal", ("Utility_Electricity",)),
    "avg_utility_bill": ("mean_withdrawal", ("Utility_Electricity",)),
    "utility_payment_count": ("count", ("Utility_Electricity",)),
    "emi_payment_count": ("count", ("EMI_Loan_Payment",)),
    "total_emi_paid": ("withdrawal", ("EMI_Loan_Payment",)),
    "emi_months_active": ("months", ("EMI_Loan_Payment",)),
    "insurance_payment_count": ("count", ("Insurance_Premium",)),
    "total_insurance_premium": ("withdrawal", ("Insurance_Premium",)),
    "rent_payment_count": ("count", ("Rent_Expense",)),
    "avg_rent_amount": ("mean_withdrawal", ("Rent_Expense",)),
    "sip_payment_count": ("count", ("SIP_Investment",)),
    "total_sip_invested": ("withdrawal", ("SIP_Investment",)),
    "bounce_count": ("count", ("Payment_Bounce",)),
    "total_bounce_charges": ("withdrawal", ("Payment_Bounce",)),
}
_DIGITAL = {
    # the count includes shopping, the spend does not
    "digital_txn_count": ("count", ("UPI_Payment", "Food_Delivery", "Quick_Commerce", "Ecommerce_Shopping")),
    "total_digital_spend": ("withdrawal", ("UPI_Payment", "Food_Delivery", "Quick_Commerce")),
    "atm_withdrawal_count": ("count", ("ATM_Cash_Withdrawal",)),
    "total_cash_withdrawn": ("withdrawal", ("ATM_Cash_Withdrawal",)),
    "food_delivery_spend": ("withdrawal", ("Food_Delivery",)),
    "grocery_spend": ("withdrawal", ("Grocery_Store",)),
    "ecommerce_spend": ("withdrawal", ("Ecommerce_Shopping",)),
    "transportation_spend": ("withdrawal", ("Transportation",)),
    "healthcare_spend": ("withdrawal", ("Healthcare_Medical",)),
    "education_spend": ("withdrawal", ("Education",)),
}
_INCOME = {
    "salary_credit_count": ("count", ("Salary_Income",)),
    "total_salary_income": ("deposit", ("Salary_Income",)),
    "gig_credit_count": ("count", ("Gig_Income",)),
    "total_gig_income": ("deposit", ("Gig_Income",)),
    "govt_benefit_count": ("count", ("Govt_DBT_PMKisan", "MGNREGA_Income")),
    "total_govt_benefits": ("deposit", ("Govt_DBT_PMKisan", "MGNREGA_Income")),
    "business_credit_count": ("count", ("Business_P2P_Income",)),
    "total_business_income": ("deposit", ("Business_P2P_Income",)),
    "total_investment_income": ("deposit", ("Interest_Dividend_Income",)),
}
_RISK = {
    "bounce_count_risk": ("count", ("Payment_Bounce",)),
    "sip_count_risk": ("count", ("SIP_Investment",)),
    "insurance_count_risk": ("count", ("Insurance_Premium",)),
}
_PAYMENT_DLT = {
    **{name: spec for name, spec in _PAYMENT.items() if "rent" not in name},
    "rent_payment_count": ("count", ("Rent_Payment",)),
    "avg_rent_amount": ("mean_withdrawal", ("Rent_Payment",)),
}
_DIGITAL_DLT = {
    "digital_txn_count": ("count", ("UPI_Payment",)),
    "total_digital_spend": ("withdrawal", ("UPI_Payment",)),
    "food_delivery_spend": ("withdrawal", ("Food_Delivery",)),
    "grocery_spend": ("withdrawal", ()),  # no rule yields a grocery category
    "ecommerce_spend": ("withdrawal", ("Ecommerce",)),
    "transportation_spend": ("withdrawal", ("Transportation",)),
    "healthcare_spend": ("withdrawal", ("Healthcare",)),
    "education_spend": ("withdrawal", ("Education",)),
    "telecom_spend": ("withdrawal", ("Telecom_Recharge",)),
}
_INCOME_DLT = {
    "salary_credit_count": ("count", ("Salary_Income",)),
    "total_salary_income": ("deposit", ("Salary_Income",)),
    "gig_credit_count": ("count", ("Gig_Income",)),
    "total_gig_income": ("deposit", ("Gig_Income",)),
    "govt_benefit_count": ("count", ("Govt_PMKisan", "Govt_MGNREGA")),
    "total_govt_benefits": ("deposit", ("Govt_PMKisan", "Govt_MGNREGA")),
    "total_investment_income": ("deposit", ("SIP_Investment",)),
}
PAYMENT_COLUMNS = [*_PAYMENT, "emi_regularity_score", "insurance_paid_flag"]
DIGITAL_COLUMNS = [
    "total_transactions", "active_days", "active_months", "avg_debit_txn_size", "avg_credit_txn_size",
    "unique_merchants", "unique_categories", "digital_txn_count", "total_digital_spend",
    "atm_withdrawal_count", "total_cash_withdrawn", "total_credits", "total_debits",
    "food_delivery_spend", "grocery_spend", "ecommerce_spend", "transportation_spend",
    "healthcare_spend", "education_spend", "txn_frequency_per_month", "merchant_diversity_score",
    "savings_ratio", "digital_adoption_rate", "cash_dependency_ratio",
]
MONTHLY_INCOME_COLUMNS = [
    "avg_monthly_income", "max_monthly_income", "min_monthly_income", "income_variance",
    "income_variance_squared", "months_with_income", "distinct_income_months", "income_cv",
    "income_stability_score",
]
INCOME_COLUMNS = [*MONTHLY_INCOME_COLUMNS, *_INCOME]
RISK_COLUMNS = [
    "persona", "bounce_count_risk", "low_balance_days", "sip_count_risk", "insurance_count_risk",
    "first_transaction_date", "last_transaction_date", "account_age_months", *fv.PERSONA_FLAGS,
]
GOLD_COLUMNS = ["user_id", *PAYMENT_COLUMNS, *DIGITAL_COLUMNS, *INCOME_COLUMNS, *RISK_COLUMNS]
# ------------------------------------------------------------------------------


def _in(categories: tuple[str, ...]) -> Column:
    return F.col("category").isin(*categories) if categories else F.lit(False)


def _monthly(name: str, measure: str, hit: Column) -> list[Column]:
    """First-step aggregates of one feature; the alias is the feature name."""
    if measure == "count":
        return [F.count_if(hit).alias(name)]
    if measure == "months":
        return [F.max(hit & F.col("month").isNotNull()).cast("int").alias(name)]
    if measure == "mean_withdrawal":
        paid = F.when(hit, F.col("clean_withdrawal"))
        return [F.sum(paid).alias(name), F.count(paid).alias(f"_n_{name}")]
    return [F.sum(F.when(hit, F.col(f"clean_{measure}")).otherwise(0.0)).alias(name)]


def _total(name: str, measure: str) -> Column:
    """Second-step aggregate: sums of sums, and sum over count for a mean."""
    if measure == "mean_withdrawal":
        return (F.sum(name) / F.nullif(F.sum(f"_n_{name}"), F.lit(0))).alias(name)
    return F.sum(name).cast("long" if measure in ("count", "months") else "double").alias(name)


def _monthwise(specs: dict, monthly: bool = True) -> dict:
    """The features that count months, or all others."""
    return {name: spec for name, spec in specs.items() if (spec[0] == "months") == monthly}


def _by_category(specs: dict) -> list[Column]:
    return [c for name, (measure, cats) in specs.items() for c in _monthly(name, measure, _in(cats))]


def _totals(specs: dict) -> list[Column]:
    return [_total(name, measure) for name, (measure, _) in specs.items()]


def _days() -> Column:
    """First-step mask of the days of a month."""
    day_bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth("date"))
    return F.coalesce(F.bit_or(day_bit), F.lit(0).cast("long")).alias("_days")


def _credits() -> list[Column]:
    credit = F.when(F.col("transaction_type") == "Credit", F.col("clean_deposit"))
    return [F.sum(credit).alias("credits"), F.count(credit).alias("n_credits"),
            F.count_if(F.col("transaction_type") == "Credit").alias("credit_rows")]


def _activity(categories: list[str]) -> list[Column]:
    """First-step activity measures shared by both variants."""
    debit = F.when(F.col("transaction_type") == "Debit", F.col("clean_withdrawal"))
    return [
        F.count("*").alias("n"),
        F.bit_or(rules.membership_bit(F.col("category"), categories)).alias("_categories"),
        F.sum(debit).alias("debits"), F.count(debit).alias("n_debits"),
        *_credits(),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    ]


def _by_month(txns: DataFrame, *measures: Column) -> DataFrame:
    """First step: one row per user and month.

    The persona is the same on all rows of a user, so it rides along as a
    grouping column: a string aggregate would rule out hash aggregation.
    """
    carried = ["persona"] if "persona" in txns.columns else []
    return month_bucket(txns).groupBy("user_id", *carried, "month").agg(*measures)


def _month_totals() -> list[Column]:
    """Second-step activity that only rows per month tell."""
    return [F.sum(F.bit_count("_days")).cast("long").alias("active_days"), F.count("month").alias("active_months")]


def _activity_totals() -> list[Column]:
    def ratio(total: str, count: str) -> Column:
        return F.sum(total) / F.nullif(F.sum(count), F.lit(0))

    return [
        F.sum("n").alias("total_transactions"),
        F.bit_count(F.bit_or("_categories")).cast("long").alias("unique_categories"),
        ratio("debits", "n_debits").alias("avg_debit_txn_size"),
        ratio("credits", "n_credits").alias("avg_credit_txn_size"),
        F.coalesce(F.sum("credits"), F.lit(0.0)).alias("total_credits"),
        F.coalesce(F.sum("debits"), F.lit(0.0)).alias("total_debits"),
        F.min("first_date").alias("first_transaction_date"),
        F.max("last_date").alias("last_transaction_date"),
    ]


def _match(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on keys that may be NULL."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, same, "left").drop(*[f"_right_{k}" for k in keys])


def _share(part: str, whole: str) -> Column:
    """part / whole, 0 where the whole is not positive."""
    return F.when(F.col(whole) > 0, F.try_divide(F.col(part), F.col(whole))).otherwise(0.0)


# --- persona ---------------------------------------------------------------------

def persona_signals(txns: DataFrame) -> DataFrame:
    """31 aggregates per user (batch): category counts and sums, diversity, credits, debits."""
    columns = []
    for name, (measure, category) in fv.PERSONA_SIGNALS.items():
        columns += _monthly(name, measure, _in((category,)))
    credit = F.when(F.col("transaction_type") == "Credit", F.col("clean_deposit")).otherwise(0.0)
    debit = F.when(F.col("transaction_type") == "Debit", F.col("clean_withdrawal")).otherwise(0.0)
    mask = F.bit_or(rules.membership_bit(F.col("category"), rules.category_names()))
    return txns.groupBy("user_id").agg(
        *columns,
        F.count("*").alias("total_transactions"),
        F.bit_count(mask).cast("long").alias("category_diversity"),
        F.sum(credit).alias("total_credits"),
        F.sum(debit).alias("total_debits"),
    )


def persona_signals_dlt(txns: DataFrame) -> DataFrame:
    names = rules.category_names(fv.CATEGORY_RULES_DLT)
    mask = F.bit_or(rules.membership_bit(F.col("category"), names))
    return txns.groupBy("user_id").agg(
        F.count_if(_in(("Govt_PMKisan",))).alias("pmkisan_count"),
        F.count_if(_in(("Salary_Income",))).alias("salary_count"),
        F.count_if(_in(("Gig_Income",))).alias("gig_count"),
        F.bit_count(mask).cast("long").alias("category_diversity"),
        F.count("*").alias("total_transactions"),
    )


def assign_persona(signals: DataFrame, variant: str = "batch", rule_set=None) -> DataFrame:
    chosen = rule_set or (fv.PERSONA_RULES if variant == "batch" else fv.PERSONA_RULES_DLT)
    return signals.withColumn("persona", rules.persona_of(chosen))


def user_personas(txns: DataFrame, variant: str = "batch") -> DataFrame:
    signals = persona_signals(txns) if variant == "batch" else persona_signals_dlt(txns)
    return assign_persona(signals, variant)


def attach_persona(txns: DataFrame, personas: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join the persona onto every row; ``personas`` carries each user's row count."""
    return attach_by_key(txns, personas, "user_id", "persona", "total_transactions", hot_rows)


def clustered_silver(rows: DataFrame, personas: DataFrame, variant: str = "batch", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Silver from written enriched rows and personas: duplicates are removed where the persona was attached."""
    then = dedupe_statements if variant == "batch" else (lambda df: df)
    return attach_clustered(rows, personas, "user_id", "persona", "total_transactions", then, hot_rows)


def silver_transactions(statements: DataFrame, variant: str = "batch") -> DataFrame:
    """Raw statements -> enriched rows with persona.

    batch: the persona is decided on all rows and duplicates are removed
    afterwards.  dlt: rows are not de-duplicated.
    """
    rows = enrich(statements, variant)
    with_persona = attach_persona(rows, user_personas(rows, variant))
    return dedupe_statements(with_persona) if variant == "batch" else with_persona


# --- batch features ------------------------------------------------------------------

def monthly_income(txns: DataFrame) -> DataFrame:
    """Credits per user and month."""
    credits = month_bucket(txns).filter(F.col("transaction_type") == "Credit")
    return credits.groupBy("user_id", "month").agg(
        F.sum("clean_deposit").alias("monthly_income"), F.count("*").alias("monthly_credit_count"))


def _income_stability(df: DataFrame, deviation: Column, when_flat: float) -> DataFrame:
    cv = F.when(F.col("avg_monthly_income") > 0, F.try_divide(deviation, F.col("avg_monthly_income")))
    df = df.withColumn("income_cv", cv.otherwise(0.0))
    score = F.when(F.col("income_cv") > 0, 1.0 / (1.0 + F.col("income_cv"))).otherwise(when_flat)
    return df.withColumn("income_stability_score", score)


def _income_moments(month: Column, income: Column) -> list[Column]:
    return [
        F.avg(income).alias("avg_monthly_income"), F.max(income).alias("max_monthly_income"),
        F.min(income).alias("min_monthly_income"),
        F.stddev_samp(income).alias("income_variance"),
        F.var_samp(income).alias("income_variance_squared"),
    ]


def income_features(monthly: DataFrame) -> DataFrame:
    """Second-level income statistics; sample deviation, so NULL for a single month.

    ``income_variance`` holds the standard deviation and ``income_variance_squared``
    the variance: the names are kept, the contents are as published.
    """
    stats = monthly.groupBy("user_id").agg(
        *_income_moments(F.col("month"), F.col("monthly_income")),
        F.count("*").alias("months_with_income"),
        F.count("month").alias("distinct_income_months"),
    )
    return _income_stability(stats, F.col("income_variance"), 0.0).select("user_id", *MONTHLY_INCOME_COLUMNS)


def merchant_counts(txns: DataFrame, *keys: str) -> DataFrame:
    """Distinct merchants per user (or per ``keys``); reads their columns only.  ``''`` is a merchant."""
    keys = keys or ("user_id",)
    pairs = txns.groupBy(*keys, "merchant").agg(F.lit(1).alias("_one"))
    return pairs.groupBy(*keys).agg(F.count("merchant").alias("unique_merchants"))


def _ratios(df: DataFrame) -> DataFrame:
    """txn frequency, diversity, savings, adoption, cash dependency."""
    return df.withColumns({
        "txn_frequency_per_month": F.col("total_transactions") / F.greatest(F.lit(1), F.col("active_months")),
        "merchant_diversity_score": F.col("unique_merchants") + F.col("unique_categories"),
        "savings_ratio": _share("total_credits", "total_debits"),
        "digital_adoption_rate": _share("digital_txn_count", "total_transactions"),
        "cash_dependency_ratio": _share("total_cash_withdrawn", "total_debits"),
    })


def statement_features(txns: DataFrame) -> DataFrame:
    """The 73-column user table from silver rows (batch variant)."""
    specs, keys = {**_PAYMENT, **_DIGITAL, **_INCOME}, ("user_id", "persona")
    # The persona, the same on all rows of a user, is a key in all steps: a string aggregate would mean sorting.
    users = txns.groupBy(*keys).agg(
        *_activity(rules.category_names()), *_by_category(_monthwise(specs, False)),
        F.count_if(F.col("clean_balance") < fv.LOW_BALANCE_LIMIT).alias("low_balance_days"),
    ).groupBy(*keys).agg(
        *_activity_totals(), *_totals(_monthwise(specs, False)), F.sum("low_balance_days").alias("low_balance_days"))
    credit_month = F.col("credit_rows") > 0
    income = F.when(credit_month, F.col("credits"))
    months = _by_month(txns, _days(), *_credits(), *_by_category(_monthwise(specs))).groupBy(*keys).agg(
        *_month_totals(), *_totals(_monthwise(specs)),
        *_income_moments(F.when(credit_month, F.col("month")), income),
        F.count_if(credit_month).alias("months_with_income"),
        F.count(F.when(credit_month, F.col("month"))).alias("distinct_income_months"),
    )
    users = _ratios(_match(_match(users, months, *keys), merchant_counts(txns, *keys), *keys))
    users = users.withColumns({
        "emi_regularity_score": _share("emi_months_active", "emi_payment_count"),
        "insurance_paid_flag": F.when(F.col("insurance_payment_count") > 0, 1).otherwise(0),
        "bounce_count_risk": F.col("bounce_count"),
        "sip_count_risk": F.col("sip_payment_count"),
        "insurance_count_risk": F.col("insurance_payment_count"),
        "account_age_months": F.months_between("last_transaction_date", "first_transaction_date"),
        **rules.one_hot(F.col("persona"), fv.PERSONA_FLAGS),
    })
    users = _income_stability(users, F.col("income_variance"), 0.0)
    return fill_numeric_nulls(users.select(*GOLD_COLUMNS))


def payment_features(txns: DataFrame) -> DataFrame:
    """The payment block alone (17 columns with the key)."""
    monthly = _by_month(txns.drop("persona"), *_by_category(_PAYMENT))
    users = monthly.groupBy("user_id").agg(*_totals(_PAYMENT))
    return users.withColumns({
        "emi_regularity_score": _share("emi_months_active", "emi_payment_count"),
        "insurance_paid_flag": F.when(F.col("insurance_payment_count") > 0, 1).otherwise(0),
    }).select("user_id", *PAYMENT_COLUMNS)


def digital_features(txns: DataFrame) -> DataFrame:
    """The digital-flow block alone (25 columns with the key)."""
    users = txns.groupBy("user_id").agg(*_activity(rules.category_names()), *_by_category(_DIGITAL))
    users = users.groupBy("user_id").agg(*_activity_totals(), *_totals(_DIGITAL))
    months = _by_month(txns.drop("persona"), _days()).groupBy("user_id").agg(*_month_totals())
    users = _match(users, months, "user_id").join(merchant_counts(txns), "user_id", "left")
    return _ratios(users).select("user_id", *DIGITAL_COLUMNS)


def income_type_features(txns: DataFrame) -> DataFrame:
    """Salary, gig, government, business and investment credits per user."""
    return txns.groupBy("user_id").agg(*_by_category(_INCOME))


def persona_risk_features(txns: DataFrame) -> DataFrame:
    """Persona, bounce/SIP/insurance counts, rows under the low-balance limit, account age.

    ``low_balance_days`` counts rows, not days.
    """
    users = txns.groupBy("user_id", "persona").agg(
        *_by_category(_RISK),
        F.count_if(F.col("clean_balance") < fv.LOW_BALANCE_LIMIT).alias("low_balance_days"),
        F.min("date").alias("first_transaction_date"), F.max("date").alias("last_transaction_date"),
    )
    return users.withColumns({
        "account_age_months": F.months_between("last_transaction_date", "first_transaction_date"),
        **rules.one_hot(F.col("persona"), fv.PERSONA_FLAGS),
    }).select("user_id", *RISK_COLUMNS)


# --- dlt features ------------------------------------------------------------------------

def statement_features_dlt(txns: DataFrame) -> DataFrame:
    """The 74-column user table of the streaming line, every feature from one pass.

    Income statistics are over single salary credits.  Their variance is merged
    from the monthly count, mean and squared deviations.
    """
    return users_dlt(months_dlt(txns))


_SPECS_DLT = {**_PAYMENT_DLT, **_DIGITAL_DLT, **_INCOME_DLT}
_WORDS_DLT = {"atm_withdrawal_count": ("count", "atm"), "total_cash_withdrawn": ("withdrawal", "atm"),
              "business_credit_count": ("count", "business"), "total_business_income": ("deposit", "business")}


def months_dlt(txns: DataFrame, *more: Column) -> DataFrame:
    """First step: the measures of every user and month, and ``more`` aggregates."""
    return _by_month(txns, _days(), *_measures_dlt(_SPECS_DLT), *more)


def _measures_dlt(specs: dict) -> list[Column]:
    lower = F.lower("particulars")
    salary = F.when(_in(("Salary_Income",)), F.col("clean_deposit"))
    brands = ["", *fv.MERCHANT_BRANDS_DLT]
    return [
        *_activity(rules.category_names(fv.CATEGORY_RULES_DLT)),
        F.bit_or(rules.membership_bit(F.col("merchant"), brands)).alias("_merchants"),
        *_by_category(specs),
        *[c for name, (measure, word) in _WORDS_DLT.items() for c in _monthly(name, measure, lower.contains(word))],
        F.count(salary).alias("_k"), F.avg(salary).alias("_mean"), F.var_pop(salary).alias("_var"),
        F.max(salary).alias("_high"), F.min(salary).alias("_low"),
    ]


def month_merges_dlt() -> dict[str, str]:
    """How two rows of ``months_dlt`` for one month become one: sum, max, min or bits per measure, without ``_mean`` and ``_var``."""
    sums = ["n", "debits", "n_debits", "credits", "n_credits", "credit_rows", *_WORDS_DLT, "_k"]
    merges = {name: "sum" for name in sums}
    for name, (measure, _) in _SPECS_DLT.items():
        merges[name] = "max" if measure == "months" else "sum"
        if measure == "mean_withdrawal":
            merges[f"_n_{name}"] = "sum"
    return {**merges, "_days": "bits", "_categories": "bits", "_merchants": "bits", "first_date": "min", "last_date": "max",
            "_high": "max", "_low": "min"}


def users_dlt(monthly: DataFrame) -> DataFrame:
    """Second step: the feature table from rows of ``months_dlt`` with ``persona``."""
    return finish_dlt(user_totals_dlt(monthly, "user_id", "persona"))


def user_totals_dlt(monthly: DataFrame, *keys: str, more: Sequence[Column] = ()) -> DataFrame:
    """The measures of ``months_dlt`` summed up, and ``more`` aggregates."""
    return monthly.groupBy(*keys).agg(*_month_totals(), *_totals_dlt(_SPECS_DLT), *more)


def _totals_dlt(specs: dict) -> list[Column]:
    return [
        *_activity_totals(), *_totals(specs),
        *[_total(name, measure) for name, (measure, _) in _WORDS_DLT.items()],
        F.bit_count(F.bit_or("_merchants")).cast("long").alias("unique_merchants"),
        F.sum("_k").alias("_k"),
        F.sum(F.col("_k") * F.col("_mean")).alias("_sum"),
        F.sum(F.col("_k") * (F.col("_var") + F.col("_mean") * F.col("_mean"))).alias("_squares"),
        F.max("_high").alias("max_monthly_income"), F.min("_low").alias("min_monthly_income"),
    ]


def finish_dlt(users: DataFrame, *carried: str) -> DataFrame:
    """The feature table from rows of ``user_totals_dlt`` with ``persona``, and the columns ``carried`` as they are."""
    mean = F.col("_sum") / F.nullif(F.col("_k"), F.lit(0))
    spread = F.greatest(F.col("_squares") - F.col("_sum") * mean, F.lit(0.0))
    flat = F.col("max_monthly_income") == F.col("min_monthly_income")
    users = users.withColumns({
        "avg_monthly_income": mean,
        "income_variance": F.when(F.col("_k") > 1, F.when(flat, 0.0).otherwise(
            spread / (F.nullif(F.col("_k"), F.lit(1)) - 1))),
        "account_age_months": F.months_between("last_transaction_date", "first_transaction_date"),
        "emi_regularity_score": _share("emi_months_active", "active_months"),
        "months_with_income": F.when(F.col("salary_credit_count") > 0, F.col("salary_credit_count"))
            .otherwise(F.col("gig_credit_count")),
        "low_balance_days": F.lit(0),
        "bounce_count_risk": F.when(F.col("bounce_count") > 0, 1).otherwise(0),
        "sip_count_risk": F.when(F.col("sip_payment_count") == 0, 1).otherwise(0),
        "insurance_count_risk": F.when(F.col("insurance_payment_count") == 0, 1).otherwise(0),
        "insurance_paid_flag": F.when(F.col("insurance_payment_count") > 0, 1).otherwise(0),
        **rules.one_hot(F.col("persona"), fv.PERSONA_FLAGS),
    })
    users = _ratios(users).withColumns({
        "txn_frequency_per_month": _share("total_transactions", "active_months"),
        "income_variance_squared": F.col("income_variance") * F.col("income_variance"),
        "distinct_income_months": F.col("months_with_income"),
    })
    users = _income_stability(users, F.sqrt("income_variance"), 1.0)
    columns = ["user_id", *PAYMENT_COLUMNS, *DIGITAL_COLUMNS, "telecom_spend", *INCOME_COLUMNS, *RISK_COLUMNS]
    return fill_numeric_nulls(users.select(*columns, *carried))
