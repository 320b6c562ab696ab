"""Independent SQL for every checked query, as plain views over the given tables.

The views deliberately use another shape than the Spark code (single-level
``COUNT(DISTINCT)``, ``ROW_NUMBER`` and so on), so that agreement means something.
"""
from __future__ import annotations

import re

from ..functions import fixed_values as fv
from . import inputs

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def query(select: str) -> str:
    """A statement with exactly the views that ``select`` needs, in dependency order."""
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in sorted(set(re.findall(r"\bv_\w+", sql))):
            if name not in ordered and name in VIEWS:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(select)
    if not ordered:
        return half_up(select.strip())
    return half_up("WITH " + ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in ordered) + "\n" + select.strip())


def half_up(sql: str) -> str:
    """Spell every ``round(x, n)`` as decimal rounding of the printed double.

    Spark rounds the decimal text of a double half up; DuckDB scales the binary
    value.  The two differ on halves such as 93.665, so the check spells out the first.
    """
    out, i = [], 0
    for start in re.finditer(r"\bround\(", sql):
        if start.start() < i:
            continue
        depth, j, comma = 1, start.end(), None
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        inner = half_up(sql[start.end():comma if comma else j - 1])
        digits = sql[comma + 1:j - 1].strip() if comma else "0"
        out.append(sql[i:start.start()])
        out.append(f"CAST(ROUND(CAST(CAST({inner} AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)")
        i = j
    return "".join(out) + sql[i:]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_of(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} THEN {quote(l)}" for l, p in pairs) + f" ELSE {otherwise} END"


def names(values) -> str:
    return ", ".join(quote(v) for v in values)


# --- inputs ---------------------------------------------------------------------
_narrations = "[" + names(inputs.NARRATION_LIST) + "]"
view("v_lines", f"""
SELECT l.*, o.o_custkey, c.c_acctbal,
       {_narrations}[((o.o_custkey % 10) * 12 + (l.l_partkey + 3 * l.l_linenumber) % 12 + 1)::INTEGER] AS narration
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
view("v_statements", """
SELECT CASE WHEN l_partkey % 211 = 0 THEN 'BAD' ELSE 'USR-' || o_custkey END AS user_id,
       strftime(l_shipdate, '%d-%m-%Y') AS date,
       regexp_replace(narration, '\\+$', '') AS particulars,
       CAST(NULL AS VARCHAR) AS chq_num,
       CASE WHEN narration NOT LIKE '%+' AND l_quantity < 50 THEN format('{:,.2f}', l_extendedprice) END AS withdrawal,
       CASE WHEN narration LIKE '%+' AND l_quantity < 50 THEN format('{:,.2f}', l_extendedprice) END AS deposit,
       format('{:,.2f}', c_acctbal) AS balance
FROM v_lines""")
_segments = "CASE c_mktsegment " + " ".join(
    f"WHEN {quote(k)} THEN {quote(v)}" for k, v in inputs.SEGMENT_OF.items()) + " END"
_kinds = "[" + names(inputs.BILL_KINDS) + "]"
view("v_bills", f"""
SELECT 'USR-' || o_custkey AS user_id,
       CAST((year(l_shipdate) * 12 + month(l_shipdate)) % 26 AS INTEGER) AS month,
       {_kinds}[(l_linenumber % 5 + 1)::INTEGER] AS bill_type,
       round(l_extendedprice - 1000.0, 2) AS amount,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS paid_on_time,
       CASE WHEN l_returnflag = 'R' THEN CAST(trunc(l_quantity * 2) AS INTEGER) ELSE 0 END AS days_late
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("v_upi", """
SELECT 'USR-' || user_id AS user_id, CAST((day(ts) - 1) % 13 + 1 AS INTEGER) AS month, value AS amount,
       event_type AS category,
       CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 97 = 0 THEN 'PENDING' ELSE 'SUCCESS' END AS status
FROM events""")
_whole = {"land_acres": 13, "bank_vintage_months": 150, "upi_txn_per_month": 400, "employment_months": 200,
          "shg_months": 60, "dbt_months": 24, "sim_tenure_months": 96}
view("v_profiles", f"""
SELECT 'USR-' || c_custkey AS user_id, {_segments} AS segment, n_name AS state,
       round(c_acctbal * 4.0, 2) AS income_monthly,
       CAST(c_custkey % 101 AS DOUBLE) / 100.0::DOUBLE AS bill_ontime_rate_24m,
       CAST(c_custkey % 31 AS DOUBLE) / 20.0::DOUBLE - 0.3::DOUBLE AS savings_ratio,
       {', '.join(f"CAST(c_custkey % {m} AS INTEGER) AS {c}" for c, m in _whole.items())},
       CAST(c_custkey % 91 + 10 AS DOUBLE) / 100.0::DOUBLE AS location_stability,
       {', '.join(f"CASE WHEN c_custkey % {m} = 0 THEN 1 ELSE 0 END AS {c}" for c, m in inputs.FLAG_MODULI.items())},
       CAST(c_custkey % 2 AS INTEGER) AS owns_land,
       CAST(c_custkey % 1000 AS DOUBLE) / 1000.0::DOUBLE AS default_probability
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
_band = "CASE " + " ".join(f"WHEN score > -1 AND score <= {b} THEN {quote(l)}" for b, l in fv.SCORE_BANDS) + " END"
view("v_scores", f"""
SELECT *, {_band} AS score_band FROM (
  SELECT 'USR-' || c_custkey AS user_id, {_segments} AS segment,
         CAST(c_custkey % 1000 AS DOUBLE) / 1000.0::DOUBLE AS default_probability,
         CAST(trunc(900.0::DOUBLE - (CAST(c_custkey % 1000 AS DOUBLE) / 1000.0::DOUBLE) * 900.0::DOUBLE) AS INTEGER) AS score
  FROM customer)""")
view("v_contributions", f"""
SELECT 'USR-' || c_custkey AS user_id, {_segments} AS segment,
       {', '.join(f"CAST((c_custkey * {7 + i}) % 401 - 200 AS DOUBLE) / 100.0::DOUBLE AS {n}" for i, n in enumerate(fv.CONTRACT_FEATURES))}
FROM customer""")
_jobs = "[" + names(inputs.OCCUPATIONS) + "]"
view("v_borrowers", f"""
SELECT 'USR-' || c_custkey AS user_id, {_jobs}[(c_custkey % 5 + 1)::INTEGER] AS occupation,
       'City ' || (c_custkey % 7) AS city, n_name AS state,
       CAST(trunc(900.0::DOUBLE - (CAST(c_custkey % 1000 AS DOUBLE) / 1000.0::DOUBLE) * 900.0::DOUBLE) AS INTEGER) AS credit_score,
       round(c_acctbal * 48.0, 2) AS annual_income
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
view("v_rural", """
SELECT c_mktsegment AS primary_business, n_name AS city, o_totalprice AS annual_income,
       CAST(o_orderkey % 5000 AS DOUBLE) AS monthly_expenses,
       CAST(o_orderkey % 90000 + 10000 AS DOUBLE) AS loan_amount,
       CAST(o_orderkey % 48 + 12 AS INTEGER) AS loan_tenure,
       CAST(o_orderkey % 4 AS INTEGER) AS young_dependents, CAST(o_orderkey % 3 AS INTEGER) AS old_dependents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
_topics = "[" + names(inputs.QA_TOPICS) + "]"
view("v_qa", f"""
SELECT item_id AS id, text AS question,
       {', '.join(f"'opt {x} ' || item_id AS option_{x}" for x in "abcd")},
       ['A','B','C','D','raw'][(item_id % 5 + 1)::INTEGER] AS correct_answer,
       {_topics}[(item_id % {len(inputs.QA_TOPICS)} + 1)::INTEGER] AS topic,
       CASE WHEN item_id % 2 = 0 THEN 'hi' ELSE 'en' END AS lang
FROM benchmark""")
view("v_states", """
SELECT n_name AS state, count(*) AS accounts, round(sum(o_totalprice), 2) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
view("v_vectors", """
SELECT vec_id AS chunk_id, label AS target_group, source AS state, embedding::DOUBLE[] AS embedding
FROM embeddings LEFT JOIN documents ON vec_id = doc_id""")
view("v_queries", """
SELECT label AS query_id, label AS expected_group, list(x ORDER BY pos) AS embedding FROM (
  SELECT label, pos, round(avg(x), 6) AS x FROM (
    SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label""")
view("v_replies", """
SELECT conv_id, turn, role,
       CASE turn % 3 WHEN 0 THEN '<think>x</think>' WHEN 1 THEN '<think>x' ELSE '' END || text AS reply
FROM conversations""")
view("v_schemes", "SELECT * FROM (VALUES " + ", ".join(
    f"({quote(i)}, {quote(n)}, {loan}::BIGINT, {pct}::DOUBLE, {quote(col)}, {quote(el)})"
    for i, n, loan, pct, col, el in fv.SCHEME_PRICES
) + ") t(scheme_id, scheme_name, max_loan_inr, interest_pct, collateral, eligibility)")
view("v_scheme_corpus", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quote(n)}, 'scheme', {quote(g)}, {quote(s)}, {quote(c)})" for i, n, g, s, c in fv.SCHEME_CORPUS
) + ") t(scheme_id, scheme_name, content_type, target_group, state, content)")


# --- statements, batch and dlt ----------------------------------------------------
def _categories(rules) -> str:
    return case_of(((name, f"regexp_matches(lower(particulars), {quote('|'.join(words))})")
                    for name, words in rules), quote(fv.OTHER_CATEGORY))


view("v_batch", f"""
SELECT *, {_categories(fv.CATEGORY_RULES)} AS category,
       CASE WHEN clean_withdrawal IS NOT NULL THEN 'Debit' WHEN clean_deposit IS NOT NULL THEN 'Credit'
            ELSE 'Unknown' END AS transaction_type,
       regexp_extract(particulars, {quote(fv.MERCHANT_PATTERN)}, 0) AS merchant
FROM (SELECT user_id, CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, particulars, chq_num,
             withdrawal, deposit, balance,
             TRY_CAST(replace(withdrawal, ',', '') AS DOUBLE) AS clean_withdrawal,
             TRY_CAST(replace(deposit, ',', '') AS DOUBLE) AS clean_deposit,
             TRY_CAST(replace(balance, ',', '') AS DOUBLE) AS clean_balance,
             lower(particulars) AS particulars_lower
      FROM v_statements)""")
_brands = "(" + "|".join(fv.MERCHANT_BRANDS_DLT) + ")"
view("v_dlt_raw", f"""
SELECT *, {_categories(fv.CATEGORY_RULES_DLT)} AS category,
       CASE WHEN clean_withdrawal > 0 THEN 'Debit' WHEN clean_deposit > 0 THEN 'Credit' ELSE 'Unknown' END AS transaction_type,
       regexp_extract(lower(particulars), {quote(_brands)}, 1) AS merchant
FROM (SELECT user_id, CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, particulars, chq_num,
             withdrawal, deposit, balance,
             CASE WHEN withdrawal IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(regexp_replace(withdrawal, '[^0-9.]', '', 'g') AS DOUBLE) END AS clean_withdrawal,
             CASE WHEN deposit IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(regexp_replace(deposit, '[^0-9.]', '', 'g') AS DOUBLE) END AS clean_deposit,
             TRY_CAST(replace(replace(balance, ',', ''), ' ', '') AS DOUBLE) AS clean_balance,
             lower(particulars) AS particulars_lower
      FROM v_statements)""")


def _count(category: str) -> str:
    return f"count(*) FILTER (WHERE category = {quote(category)})"


def _sum(amount: str, cats) -> str:
    return f"coalesce(sum({amount}) FILTER (WHERE category IN ({names(cats)})), 0.0::DOUBLE)"


view("v_signals", "SELECT user_id, " + ", ".join(
    f"{_count(cat)} AS {n}" if m == "count" else f"{_sum('clean_deposit', [cat])} AS {n}"
    for n, (m, cat) in fv.PERSONA_SIGNALS.items()) + """,
  count(*) AS total_transactions, count(DISTINCT category) AS category_diversity,
  coalesce(sum(clean_deposit) FILTER (WHERE transaction_type = 'Credit'), 0.0::DOUBLE) AS total_credits,
  coalesce(sum(clean_withdrawal) FILTER (WHERE transaction_type = 'Debit'), 0.0::DOUBLE) AS total_debits
FROM v_batch GROUP BY user_id""")
view("v_personas", f"SELECT *, {case_of(fv.PERSONA_RULES, quote(fv.DEFAULT_PERSONA))} AS persona FROM v_signals")
view("v_with_persona", "SELECT b.*, p.persona FROM v_batch b LEFT JOIN v_personas p ON b.user_id = p.user_id")
_others = ("chq_num, withdrawal, deposit, balance, clean_withdrawal, clean_deposit, clean_balance, "
           "particulars_lower, category, transaction_type, merchant, persona").split(", ")
view("v_silver", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, date, particulars
         ORDER BY {', '.join(f'{c} NULLS FIRST' for c in _others)}) AS rn FROM v_with_persona) WHERE rn = 1""")
view("v_dlt_personas", f"""
SELECT *, {case_of(fv.PERSONA_RULES_DLT, quote(fv.DEFAULT_PERSONA))} AS persona FROM (
  SELECT user_id, {_count('Govt_PMKisan')} AS pmkisan_count, {_count('Salary_Income')} AS salary_count,
         {_count('Gig_Income')} AS gig_count, count(DISTINCT category) AS category_diversity
  FROM v_dlt_raw GROUP BY user_id)""")
view("v_dlt", "SELECT b.*, p.persona FROM v_dlt_raw b LEFT JOIN v_dlt_personas p ON b.user_id = p.user_id")

# months between two dates without time, as Spark counts them
MONTHS = """CASE WHEN day({b}) = day({a}) OR ({b} = last_day({b}) AND {a} = last_day({a}))
  THEN CAST(12 * (year({b}) - year({a})) + month({b}) - month({a}) AS DOUBLE)
  ELSE 12 * (year({b}) - year({a})) + month({b}) - month({a}) + (day({b}) - day({a})) / 31.0::DOUBLE END"""


def _aggregate(spec) -> str:
    measure, cats = spec
    listed = names(cats) or "''"
    hit = f"FILTER (WHERE category IN ({listed}))"
    return {
        "count": f"count(*) {hit}",
        "months": f"count(DISTINCT date_trunc('month', date)) {hit}",
        "mean_withdrawal": f"avg(clean_withdrawal) {hit}",
        "withdrawal": f"coalesce(sum(clean_withdrawal) {hit}, 0.0::DOUBLE)",
        "deposit": f"coalesce(sum(clean_deposit) {hit}, 0.0::DOUBLE)",
    }[measure]


# Spelled out again for the oracle: feature -> (measure, categories)
E_ = "EMI_Loan_Payment"
PAYMENT = {
    "total_utility_spend": ("withdrawal", ["Utility_Electricity"]), "avg_utility_bill": ("mean_withdrawal", ["Utility_Electricity"]),
    "utility_payment_count": ("count", ["Utility_Electricity"]), "emi_payment_count": ("count", [E_]),
    "total_emi_paid": ("withdrawal", [E_]), "emi_months_active": ("months", [E_]),
    "insurance_payment_count": ("count", ["Insurance_Premium"]), "total_insurance_premium": ("withdrawal", ["Insurance_Premium"]),
    "rent_payment_count": ("count", ["Rent_Expense"]), "avg_rent_amount": ("mean_withdrawal", ["Rent_Expense"]),
    "sip_payment_count": ("count", ["SIP_Investment"]), "total_sip_invested": ("withdrawal", ["SIP_Investment"]),
    "bounce_count": ("count", ["Payment_Bounce"]), "total_bounce_charges": ("withdrawal", ["Payment_Bounce"]),
}
DIGITAL = {
    "digital_txn_count": ("count", ["UPI_Payment", "Food_Delivery", "Quick_Commerce", "Ecommerce_Shopping"]),
    "total_digital_spend": ("withdrawal", ["UPI_Payment", "Food_Delivery", "Quick_Commerce"]),
    "atm_withdrawal_count": ("count", ["ATM_Cash_Withdrawal"]), "total_cash_withdrawn": ("withdrawal", ["ATM_Cash_Withdrawal"]),
    "food_delivery_spend": ("withdrawal", ["Food_Delivery"]), "grocery_spend": ("withdrawal", ["Grocery_Store"]),
    "ecommerce_spend": ("withdrawal", ["Ecommerce_Shopping"]), "transportation_spend": ("withdrawal", ["Transportation"]),
    "healthcare_spend": ("withdrawal", ["Healthcare_Medical"]), "education_spend": ("withdrawal", ["Education"]),
}
INCOME = {
    "salary_credit_count": ("count", ["Salary_Income"]), "total_salary_income": ("deposit", ["Salary_Income"]),
    "gig_credit_count": ("count", ["Gig_Income"]), "total_gig_income": ("deposit", ["Gig_Income"]),
    "govt_benefit_count": ("count", ["Govt_DBT_PMKisan", "MGNREGA_Income"]),
    "total_govt_benefits": ("deposit", ["Govt_DBT_PMKisan", "MGNREGA_Income"]),
    "business_credit_count": ("count", ["Business_P2P_Income"]), "total_business_income": ("deposit", ["Business_P2P_Income"]),
    "total_investment_income": ("deposit", ["Interest_Dividend_Income"]),
}
ACTIVITY = """count(*) AS total_transactions, count(DISTINCT date) AS active_days,
  count(DISTINCT date_trunc('month', date)) AS active_months,
  avg(clean_withdrawal) FILTER (WHERE transaction_type = 'Debit') AS avg_debit_txn_size,
  avg(clean_deposit) FILTER (WHERE transaction_type = 'Credit') AS avg_credit_txn_size,
  count(DISTINCT merchant) AS unique_merchants, count(DISTINCT category) AS unique_categories,
  coalesce(sum(clean_deposit) FILTER (WHERE transaction_type = 'Credit'), 0.0::DOUBLE) AS total_credits,
  coalesce(sum(clean_withdrawal) FILTER (WHERE transaction_type = 'Debit'), 0.0::DOUBLE) AS total_debits"""
FLAGS = ", ".join(f"CASE WHEN persona = {quote(p)} THEN 1 ELSE 0 END AS {f}" for f, p in fv.PERSONA_FLAGS.items())


def aggregates(spec: dict) -> str:
    return ", ".join(f"{_aggregate(s)} AS {n}" for n, s in spec.items())


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0.0::DOUBLE END"


view("v_monthly", """
SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(clean_deposit) AS monthly_income,
       count(*) AS monthly_credit_count
FROM v_silver WHERE transaction_type = 'Credit' GROUP BY ALL""")
view("v_income", """
SELECT *, CASE WHEN income_cv > 0 THEN 1 / (1 + income_cv) ELSE 0.0::DOUBLE END AS income_stability_score FROM (
  SELECT *, CASE WHEN avg_monthly_income > 0 THEN income_variance / avg_monthly_income ELSE 0.0::DOUBLE END AS income_cv FROM (
    SELECT user_id, avg(monthly_income) AS avg_monthly_income, max(monthly_income) AS max_monthly_income,
           min(monthly_income) AS min_monthly_income, stddev_samp(monthly_income) AS income_variance,
           var_samp(monthly_income) AS income_variance_squared, count(*) AS months_with_income,
           count(DISTINCT month) AS distinct_income_months
    FROM v_monthly GROUP BY user_id))""")
view("v_payment", f"""
SELECT *, {share('emi_months_active', 'emi_payment_count')} AS emi_regularity_score,
       CASE WHEN insurance_payment_count > 0 THEN 1 ELSE 0 END AS insurance_paid_flag
FROM (SELECT user_id, {aggregates(PAYMENT)} FROM v_silver GROUP BY user_id)""")
view("v_digital", f"""
SELECT *, total_transactions / greatest(1, active_months)::DOUBLE AS txn_frequency_per_month,
       unique_merchants + unique_categories AS merchant_diversity_score,
       {share('total_credits', 'total_debits')} AS savings_ratio,
       {share('digital_txn_count', 'total_transactions')} AS digital_adoption_rate,
       {share('total_cash_withdrawn', 'total_debits')} AS cash_dependency_ratio
FROM (SELECT user_id, {ACTIVITY}, {aggregates(DIGITAL)} FROM v_silver GROUP BY user_id)""")
view("v_income_types", f"SELECT user_id, {aggregates(INCOME)} FROM v_silver GROUP BY user_id")
view("v_risk", f"""
SELECT *, {MONTHS.format(a='first_transaction_date', b='last_transaction_date')} AS account_age_months, {FLAGS}
FROM (SELECT user_id, max(persona) AS persona, {_count('Payment_Bounce')} AS bounce_count_risk,
             count(*) FILTER (WHERE clean_balance < {fv.LOW_BALANCE_LIMIT}) AS low_balance_days,
             {_count('SIP_Investment')} AS sip_count_risk, {_count('Insurance_Premium')} AS insurance_count_risk,
             min(date) AS first_transaction_date, max(date) AS last_transaction_date
      FROM v_silver GROUP BY user_id)""")

GOLD_DOUBLES = {
    **{c: 2 for c in (
        "total_utility_spend", "total_emi_paid", "total_insurance_premium", "total_sip_invested", "total_bounce_charges",
        "total_digital_spend", "total_cash_withdrawn", "total_credits", "total_debits", "food_delivery_spend",
        "grocery_spend", "ecommerce_spend", "transportation_spend", "healthcare_spend", "education_spend",
        "total_salary_income", "total_gig_income", "total_govt_benefits", "total_business_income",
        "total_investment_income", "max_monthly_income", "min_monthly_income", "income_variance")},
    **{c: 4 for c in (
        "avg_utility_bill", "avg_rent_amount", "avg_debit_txn_size", "avg_credit_txn_size", "avg_monthly_income",
        "emi_regularity_score", "txn_frequency_per_month", "savings_ratio", "digital_adoption_rate",
        "cash_dependency_ratio", "income_cv", "income_stability_score", "account_age_months")},
    "income_variance_squared": -2,
}
_counts = [n for spec in (PAYMENT, DIGITAL, INCOME) for n, (m, _) in spec.items() if m in ("count", "months")]
_zero_int = ["months_with_income", "distinct_income_months"]
view("v_gold", f"""
SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in _zero_int)},
                  {', '.join(f'coalesce({c}, 0.0::DOUBLE) AS {c}' for c in GOLD_DOUBLES)})
FROM v_payment LEFT JOIN v_digital USING (user_id) LEFT JOIN v_income USING (user_id)
     LEFT JOIN v_income_types USING (user_id) LEFT JOIN v_risk USING (user_id)""")

DLT = {
    **{n: s for n, s in PAYMENT.items() if "rent" not in n},
    "rent_payment_count": ("count", ["Rent_Payment"]), "avg_rent_amount": ("mean_withdrawal", ["Rent_Payment"]),
    "digital_txn_count": ("count", ["UPI_Payment"]), "total_digital_spend": ("withdrawal", ["UPI_Payment"]),
    "food_delivery_spend": ("withdrawal", ["Food_Delivery"]), "grocery_spend": ("withdrawal", ["Grocery"]),
    "ecommerce_spend": ("withdrawal", ["Ecommerce"]), "transportation_spend": ("withdrawal", ["Transportation"]),
    "healthcare_spend": ("withdrawal", ["Healthcare"]), "education_spend": ("withdrawal", ["Education"]),
    "telecom_spend": ("withdrawal", ["Telecom_Recharge"]),
    "salary_credit_count": ("count", ["Salary_Income"]), "total_salary_income": ("deposit", ["Salary_Income"]),
    "gig_credit_count": ("count", ["Gig_Income"]), "total_gig_income": ("deposit", ["Gig_Income"]),
    "govt_benefit_count": ("count", ["Govt_PMKisan", "Govt_MGNREGA"]),
    "total_govt_benefits": ("deposit", ["Govt_PMKisan", "Govt_MGNREGA"]),
    "total_investment_income": ("deposit", ["SIP_Investment"]),
}


def gold_dlt(source: str) -> str:
    """The dlt feature table over a view of dlt rows."""
    salary = "FILTER (WHERE category = 'Salary_Income')"
    filled = [c for c in GOLD_DOUBLES if c not in ("income_cv", "income_stability_score")]
    return f"""
SELECT * REPLACE ({', '.join(f'coalesce({c}, 0.0::DOUBLE) AS {c}' for c in filled)}) FROM (
SELECT *, CASE WHEN income_cv > 0 THEN 1 / (1 + income_cv) ELSE 1.0::DOUBLE END AS income_stability_score FROM (
SELECT *, {MONTHS.format(a='first_transaction_date', b='last_transaction_date')} AS account_age_months,
  {share('total_transactions', 'active_months')} AS txn_frequency_per_month,
  {share('total_credits', 'total_debits')} AS savings_ratio,
  unique_merchants + unique_categories AS merchant_diversity_score,
  {share('digital_txn_count', 'total_transactions')} AS digital_adoption_rate,
  {share('total_cash_withdrawn', 'total_debits')} AS cash_dependency_ratio,
  {share('emi_months_active', 'active_months')} AS emi_regularity_score,
  income_variance * income_variance AS income_variance_squared,
  CASE WHEN avg_monthly_income > 0 THEN sqrt(income_variance) / avg_monthly_income ELSE 0.0::DOUBLE END AS cv0,
  coalesce(cv0, 0.0::DOUBLE) AS income_cv_filled, cv0 AS income_cv,
  CASE WHEN salary_credit_count > 0 THEN salary_credit_count ELSE gig_credit_count END AS months_with_income,
  CASE WHEN salary_credit_count > 0 THEN salary_credit_count ELSE gig_credit_count END AS distinct_income_months,
  0 AS low_balance_days,
  CASE WHEN bounce_count > 0 THEN 1 ELSE 0 END AS bounce_count_risk,
  CASE WHEN sip_payment_count = 0 THEN 1 ELSE 0 END AS sip_count_risk,
  CASE WHEN insurance_payment_count = 0 THEN 1 ELSE 0 END AS insurance_count_risk,
  CASE WHEN insurance_payment_count > 0 THEN 1 ELSE 0 END AS insurance_paid_flag, {FLAGS}
FROM (SELECT user_id, max(persona) AS persona, min(date) AS first_transaction_date, max(date) AS last_transaction_date,
  {ACTIVITY}, {aggregates(DLT)},
  count(*) FILTER (WHERE lower(particulars) LIKE '%atm%') AS atm_withdrawal_count,
  coalesce(sum(clean_withdrawal) FILTER (WHERE lower(particulars) LIKE '%atm%'), 0.0::DOUBLE) AS total_cash_withdrawn,
  count(*) FILTER (WHERE lower(particulars) LIKE '%business%') AS business_credit_count,
  coalesce(sum(clean_deposit) FILTER (WHERE lower(particulars) LIKE '%business%'), 0.0::DOUBLE) AS total_business_income,
  avg(clean_deposit) {salary} AS avg_monthly_income, max(clean_deposit) {salary} AS max_monthly_income,
  min(clean_deposit) {salary} AS min_monthly_income, var_samp(clean_deposit) {salary} AS income_variance
FROM {source} GROUP BY user_id)))"""


view("v_gold_dlt", f"""
SELECT * EXCLUDE (cv0, income_cv, income_cv_filled), income_cv_filled AS income_cv FROM ({gold_dlt('v_dlt')})""")
DLT_DOUBLES = {**GOLD_DOUBLES, "telecom_spend": 2, "income_variance": -2, "income_variance_squared": -10}

# --- pillar line ------------------------------------------------------------------------
view("v_valid_profiles", """
SELECT * FROM v_profiles WHERE user_id IS NOT NULL AND segment IS NOT NULL AND income_monthly > 0
  AND bill_ontime_rate_24m BETWEEN 0.0 AND 1.0 AND savings_ratio BETWEEN -1.0 AND 1.0 AND default_label IN (0, 1)""")
view("v_valid_bills", f"""
SELECT * FROM v_bills WHERE user_id IS NOT NULL AND amount > 0 AND amount < {fv.MAX_BILL} AND paid_on_time IN (0, 1)
  AND days_late BETWEEN 0 AND 90 AND month BETWEEN 1 AND 24 AND bill_type IN ({names(fv.BILL_TYPES)})""")
view("v_valid_upi", f"""
SELECT * FROM v_upi WHERE user_id IS NOT NULL AND amount > 0 AND amount < {fv.MAX_UPI}
  AND status IN ({names(fv.UPI_STATUSES)}) AND month BETWEEN 1 AND 12""")


def deduped(source: str, keys: str, rest: str) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in rest.split(", "))
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn
FROM {source}) WHERE rn = 1"""


view("v_clean_bills", deduped("v_valid_bills", "user_id, month, bill_type", "amount, paid_on_time, days_late"))
view("v_clean_upi", deduped("v_valid_upi", "user_id, month, amount, category", "status"))
view("v_p1", """
SELECT *, round(p1_ontime_recent_6m - p1_ontime_first_6m, 4) AS p1_payment_trend FROM (
SELECT user_id, round(avg(paid_on_time), 4) AS p1_bill_ontime_rate, round(avg(days_late), 2) AS p1_avg_days_late,
  CAST(max(days_late) AS DOUBLE) AS p1_max_days_late,
  round(sum(CASE WHEN days_late > 30 THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS p1_severe_late_rate,
  CAST(count(DISTINCT bill_type) AS DOUBLE) AS p1_bill_type_diversity, round(sum(amount), 2) AS p1_total_bills_24m,
  round(avg(paid_on_time) FILTER (WHERE month >= 19), 4) AS p1_ontime_recent_6m,
  round(avg(paid_on_time) FILTER (WHERE month <= 6), 4) AS p1_ontime_first_6m
FROM v_clean_bills GROUP BY user_id)""")
view("v_p2", """
SELECT *, round(p2_std_txn_amount / (p2_avg_txn_amount + 0.01::DOUBLE), 4) AS p2_txn_cv FROM (
SELECT user_id, round(count(*) / 12.0::DOUBLE, 2) AS p2_upi_txn_per_month, round(CAST(sum(CAST(amount AS DECIMAL(28,12))) AS DOUBLE) / count(amount), 2) AS p2_avg_txn_amount,
  round(stddev_samp(amount), 2) AS p2_std_txn_amount,
  round(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS p2_failure_rate,
  CAST(count(DISTINCT category) AS DOUBLE) AS p2_merchant_diversity,
  round(sum(CASE WHEN status = 'SUCCESS' THEN amount ELSE 0.0::DOUBLE END), 2) AS p2_total_spend_12m
FROM v_clean_upi GROUP BY user_id)""")
_p = ["p1_bill_ontime_rate", "p1_avg_days_late", "p1_max_days_late", "p1_severe_late_rate", "p1_bill_type_diversity",
      "p1_total_bills_24m", "p1_ontime_recent_6m", "p1_ontime_first_6m", "p1_payment_trend", "p2_upi_txn_per_month",
      "p2_avg_txn_amount", "p2_std_txn_amount", "p2_failure_rate", "p2_merchant_diversity", "p2_total_spend_12m", "p2_txn_cv"]
view("v_user_features", f"""
SELECT *, round(income_monthly / (p1_total_bills_24m / 24.0::DOUBLE + 1.0::DOUBLE), 2) AS derived_income_to_bills_ratio,
  round(p2_upi_txn_per_month * 0.4::DOUBLE + p2_merchant_diversity * 10.0::DOUBLE + (1.0::DOUBLE - p2_failure_rate) * 50.0::DOUBLE, 2) AS derived_digital_engagement,
  round(itr_filed * 40.0::DOUBLE + gst_registered * 30.0::DOUBLE + jan_dhan_active * 15.0::DOUBLE + shg_member * 15.0::DOUBLE, 2) AS derived_formal_economy_score,
  round(owns_land * 40.0::DOUBLE + owns_vehicle * 20.0::DOUBLE + has_fd_or_rd * 25.0::DOUBLE
        + least(bank_vintage_months / 2.0::DOUBLE, 15.0::DOUBLE), 2) AS derived_asset_score
FROM (SELECT * REPLACE ({', '.join(f'coalesce({c}, 0.0::DOUBLE) AS {c}' for c in _p)})
      FROM v_valid_profiles LEFT JOIN v_p1 USING (user_id) LEFT JOIN v_p2 USING (user_id))""")
view("v_model_ready", """
SELECT *, round(ln(1 + income_monthly), 4) AS income_log, least(upi_txn_per_month, 300) AS upi_txn_capped,
  least(CAST(land_acres AS DOUBLE), 10.0::DOUBLE) AS land_acres_capped, least(bank_vintage_months, 120) AS bank_vintage_capped,
  least(employment_months, 120) AS employment_capped,
  """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}_d" for c in (
      "itr_filed", "gst_registered", "jan_dhan_active", "shg_member", "owns_land", "owns_vehicle",
      "has_fd_or_rd", "svanidhi_repaid", "fraud_flag")) + "\nFROM v_user_features")
view("v_gold_pl", f"""
SELECT user_id, segment, state, default_probability, {', '.join(fv.CONTRACT_FEATURES)}, default_label FROM v_model_ready""")

# --- scores and explanations -----------------------------------------------------------------
_payment = """coalesce(emi_regularity_score, 0) * 75 + coalesce(insurance_paid_flag, 0) * 50
  + CASE WHEN utility_payment_count >= 3 THEN 50 ELSE 0 END + CASE WHEN bounce_count = 0 THEN 50 ELSE -50 END"""
_digital = """least(coalesce(digital_adoption_rate, 0) * 100, 100.0::DOUBLE) + least(coalesce(merchant_diversity_score, 0) * 2.0::DOUBLE, 80.0::DOUBLE)
  + least(coalesce(savings_ratio, 0) * 100, 100.0::DOUBLE) + least(coalesce(txn_frequency_per_month, 0.0::DOUBLE), 80.0::DOUBLE)"""
_income = "coalesce(income_stability_score, 0) * 90"
_persona = " + ".join(f"{f} * {p}" for f, p in fv.PERSONA_POINTS.items())
RAW_SCORE = f"({_payment}) + ({_digital}) + ({_income}) + ({_persona})"
CATEGORY = case_of(((l, f"predicted_score >= {b}") for b, l in fv.SCORE_CATEGORIES), quote(fv.LOWEST_CATEGORY))
view("v_scored", f"""
SELECT *, CAST(trunc(greatest(least({RAW_SCORE}, 900.0::DOUBLE), 300.0::DOUBLE)) AS INTEGER) AS rule_score,
  CAST(trunc(greatest(least({RAW_SCORE} + (CAST(replace(replace(user_id, 'USR-', ''), 'BAD', '0') AS BIGINT) * 7919 % 51 - 25), 900.0::DOUBLE), 300.0::DOUBLE)) AS INTEGER) AS noisy_score,
  CAST(round({_payment}) AS INTEGER) AS payment_behaviour_score, CAST(round({_digital}) AS INTEGER) AS digital_flow_score,
  CAST(round({_income}) AS INTEGER) AS income_stability_component,
  CASE WHEN bounce_count > 0 THEN 'Yes' ELSE 'No' END AS has_bounce,
  CASE WHEN insurance_paid_flag > 0 THEN 'Yes' ELSE 'No' END AS has_insurance,
  CASE WHEN emi_payment_count > 0 THEN 'Yes' ELSE 'No' END AS has_emi,
  CASE WHEN digital_adoption_rate > 0.5 THEN 'Yes' ELSE 'No' END AS high_digital_user
FROM v_gold""")
view("v_dashboard", f"""
SELECT *, {CATEGORY} AS score_category FROM (SELECT *, rule_score AS predicted_score FROM v_scored)""")
view("v_points", "SELECT *, " + ", ".join(
    "round(greatest(least(" + " + ".join(n for n, (pl, _) in fv.CONTRACT_FEATURES.items() if pl == p)
    + f", 2.0::DOUBLE), -2.0::DOUBLE) / 2.0::DOUBLE * 150.0::DOUBLE, 1) AS shap_{p}_pts" for p in fv.PILLARS) + " FROM v_contributions")
_ix = {n: i for i, n in enumerate(fv.CONTRACT_FEATURES)}


def _labels(variant: dict[str, str]) -> str:
    return "CASE feature " + " ".join(f"WHEN {quote(n)} THEN {quote(l)}" for n, l in variant.items()) + " END"


view("v_long", f"""
SELECT user_id, segment, feature, value, {_labels({n: l for n, (_, l) in fv.CONTRACT_FEATURES.items()})} AS label,
  {_labels({n: fv.REFRESH_LABELS.get(n, n) for n in fv.CONTRACT_FEATURES})} AS short_label,
  CASE feature {' '.join(f"WHEN {quote(n)} THEN {i}" for n, i in _ix.items())} END AS i
FROM (UNPIVOT v_contributions ON {', '.join(fv.CONTRACT_FEATURES)} INTO NAME feature VALUE value)""")
view("v_ranked", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) AS best,
       row_number() OVER (PARTITION BY user_id ORDER BY value, i) AS worst FROM v_long""")


def _factors(label: str) -> str:
    return f"""
SELECT user_id,
  coalesce(string_agg({label} || ' (+' || printf('%.2f', value) || ')', ' | ' ORDER BY best) FILTER (WHERE best <= 3 AND value > 0), {quote(fv.NO_POSITIVE)}) AS top_positive_factors,
  coalesce(string_agg({label} || ' (' || printf('%.2f', value) || ')', ' | ' ORDER BY worst) FILTER (WHERE worst <= 3 AND value < 0), {quote(fv.NO_NEGATIVE)}) AS top_negative_factors,
  max({label}) FILTER (WHERE best = 1) AS best_label, max({label}) FILTER (WHERE worst = 1) AS worst_label
FROM v_ranked GROUP BY user_id"""


view("v_factors", _factors("label"))
view("v_factors_short", _factors("short_label"))
_points = ", ".join(f"shap_{p}_pts" for p in fv.PILLARS)
_strength = "trim(split_part(split_part(top_positive_factors, ' | ', 1), '(', 1))"
_chance = "trim(split_part(split_part(top_negative_factors, ' | ', 1), '(', 1))"
view("v_explanations", f"""
SELECT user_id, p.segment, top_positive_factors, top_negative_factors, {_points},
  CASE score_band WHEN 'Excellent' THEN 'Strong profile' WHEN 'Good' THEN 'Good profile'
       WHEN 'Fair' THEN 'Developing profile' ELSE 'Needs improvement' END || ' — score ' || coalesce(score, 500) || '.'
  || CASE WHEN {_strength} = {quote(fv.NO_POSITIVE)} THEN ' Build payment history to improve.'
          ELSE ' Key strength: ' || {_strength} || '. Main opportunity: ' || {_chance} || '.' END AS explanation_text
FROM v_points p JOIN v_factors USING (user_id) LEFT JOIN v_scores s USING (user_id)""")
view("v_explanations_refresh", f"""
SELECT user_id, p.segment, top_positive_factors, top_negative_factors, {_points},
  'Score ' || score || ' (' || score_band || ').'
  || CASE WHEN top_positive_factors = {quote(fv.NO_POSITIVE)} THEN ' Build payment history to improve.'
          ELSE ' Strength: ' || best_label || '. Opportunity: ' || worst_label || '.' END AS explanation_text
FROM v_points p JOIN v_factors_short USING (user_id) LEFT JOIN v_scores s USING (user_id)""")

# --- eligibility, corpus -----------------------------------------------------------------------
_eligible = " OR ".join(f"(scheme_name LIKE {quote(p)} AND credit_score >= {s})" for p, s in fv.SCHEME_SCORE_RULES)
view("v_eligibility", f"SELECT * FROM v_borrowers CROSS JOIN v_schemes WHERE {_eligible}")
view("v_rural_profiles", """
SELECT *, 'Occupation: ' || occupation || ' | City: ' || city || ' | Typical borrowers: ' || borrower_count
  || ' | Average annual income: Rs ' || CAST(avg_annual_income AS BIGINT)
  || ' | Average monthly expenses: Rs ' || CAST(avg_monthly_expenses AS BIGINT)
  || ' | Average loan amount needed: Rs ' || CAST(avg_loan_amount AS BIGINT)
  || ' | Average loan tenure: ' || CAST(avg_loan_tenure AS BIGINT)
  || ' months | Average dependents: ' || printf('%.1f', avg_dependents) AS rag_text FROM (
SELECT primary_business AS occupation, city, count(*) AS borrower_count, round(avg(annual_income), 0) AS avg_annual_income,
  round(avg(monthly_expenses), 0) AS avg_monthly_expenses, round(avg(loan_amount), 0) AS avg_loan_amount,
  round(avg(loan_tenure), 0) AS avg_loan_tenure, round(avg(young_dependents + old_dependents), 1) AS avg_dependents
FROM v_rural GROUP BY primary_business, city HAVING count(*) >= 5)""")
view("v_qa_text", f"""
SELECT *, 'Q: ' || question || ' | Answer: ' || CASE correct_answer WHEN 'A' THEN option_a WHEN 'B' THEN option_b
  WHEN 'C' THEN option_c WHEN 'D' THEN option_d ELSE correct_answer END AS rag_text
FROM v_qa WHERE question IS NOT NULL AND topic IN ({names(fv.FINANCE_TOPICS)})""")
view("v_corpus_parts", """
SELECT 'loan_scheme' AS content_type, 'gov_schemes' AS source, scheme_name AS title, 'All India' AS state, content FROM v_scheme_corpus
UNION ALL SELECT 'finance_qa', 'qa_bank', question, 'All India', rag_text FROM v_qa_text
UNION ALL SELECT 'borrower_profile', 'rural_loan', occupation, city, rag_text FROM v_rural_profiles
UNION ALL SELECT 'state_context', 'state_loans', state, state,
  'State: ' || state || ' | Loan accounts: ' || accounts || ' | Loan amount: Rs ' || CAST(round(amount, 0) AS BIGINT) FROM v_states""")
view("v_corpus", """
SELECT *, sha256(content_type || '␟' || source || '␟' || title || '␟' || state || '␟' || content) AS chunk_id FROM v_corpus_parts""")
view("v_upi_users", """
SELECT 'USR-' || user_id AS user_id, count(*) AS total_upi_txns, round(sum(value), 2) AS total_upi_volume,
       round(avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 4) AS bill_ontime_rate
FROM events GROUP BY user_id""")
view("v_context", f"""
SELECT *, {case_of(((l, f'credit_score >= {b}') for b, l in fv.SCORE_TIERS), quote(fv.LOWEST_TIER))} AS score_tier,
  'User Profile: ' || occupation || ' from ' || city || ', ' || state || '. Annual income Rs ' || CAST(round(annual_income, 0) AS BIGINT)
  || '. Credit score ' || credit_score || '/900 (' || score_band || '). UPI transactions: ' || total_upi_txns
  || ' totalling Rs ' || CAST(round(total_upi_volume, 0) AS BIGINT) || '. Bill payment rate: ' || CAST(round(bill_ontime_rate * 100, 0) AS BIGINT)
  || '%. Savings ratio: ' || CAST(round(savings_ratio * 100, 0) AS BIGINT) || '%.' AS rag_text
FROM (SELECT user_id, b.occupation, b.city, b.state, f.annual_income, f.savings_ratio, u.total_upi_txns, u.total_upi_volume,
             u.bill_ontime_rate, s.score AS credit_score, s.score_band, e.top_positive_factors, e.top_negative_factors
      FROM v_borrowers b
      LEFT JOIN (SELECT user_id, income_monthly * 12 AS annual_income, savings_ratio FROM v_profiles) f USING (user_id)
      LEFT JOIN v_upi_users u USING (user_id) LEFT JOIN v_scores s USING (user_id) LEFT JOIN v_explanations e USING (user_id))""")
