"""The given tables seen as statements, bills, payments, profiles and so on.

Each view is a deterministic projection over the whole given tables.  The same
view is spelled in SQL in ``oracle.py`` for the independent check.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import pd_to_score, score_band

# --- Fixed values: 10 behaviour groups x 12 narrations; '+' marks a credit ---
NARRATIONS = (
    "PM-KISAN DBT CREDIT+, MANDI CROP SALE+, FERTILIZER AGRI STORE, TRACTOR HIRE, MGNREGA PAYMENT+, KIRANA SHOP, PETROL PUMP HPCL, JIO RECHARGE, ATM CASH, UPI-PAY1, BESCOM BILL, LPG CYLINDER",
    "BUNDL TECH PAY+, PORTER TRIP PAY+, URBAN COMPANY GIG JOB+, DIESEL FUEL, ZOMATO ORDER, BLINKIT ORDER, JIO RECHARGE, UPI-PAY2, HOUSE RENT, EMI BIKE, SMS CHARGES, UBER TRIP",
    "SALARY ACME+, PAYROLL ACME+, INT.PD SB+, GROWW SIP, AMAZON ORDER, HOUSE RENT, EMI HDFC LOAN, LIC POLICY, SWIGGY ORDER, BESCOM BILL, UPI-PAY3, APOLLO PHARMACY",
    "CUST PAYMENT+, CUSTOMER UDHAAR+, P2P TRANSFER+, DMART STOCK, VENDOR SUPPLY, UPI-PAY4, BESCOM BILL, AIRTEL BILL, ATM CASH, EMI SHOP LOAN, SCHOOL FEES, CUST PAYMENT QR+",
    "SHG SAVINGS, SELF HELP GROUP, MARKET SABZI, LPG CYLINDER, KIRANA SHOP, JIO RECHARGE, ATM CASH, UPI-PAY5, CLINIC FEE, SCHOOL FEES, SHG CREDIT+, GROUP DIVIDEND+",
    "ATM CASH, ATM WD 2, ATM WD 3, LOCAL MARKET, SABZI MANDI, VEGETABLE STALL, ATM WD 4, ATM WD 5, KIRANA SHOP, ATM WD 6, JIO RECHARGE, MARKET SPACE",
    "GROWW SIP, ZERODHA SIP, LIC POLICY, HDFC LIFE, EMI HOME LOAN, LOAN NACH, EMI CAR, UPI-PAY6, BESCOM BILL, DMART STORE, COIN SIP, AMAZON ORDER",
    "BOUNCE FEE, CHEQUE RETURN, INSUFF BAL, UPI-PAY7, ATM CASH, JIO RECHARGE, KIRANA SHOP, EMI PHONE, OLA CAB, ZOMATO ORDER, BESCOM BILL, MISC TXN+",
    "ZOMATO ORDER, BLINKIT ORDER, DMART STORE, JIO RECHARGE, BESCOM BILL, HOUSE RENT, PETROL PUMP, UBER TRIP, AMAZON ORDER, APOLLO PHARMACY, SCHOOL FEES, LPG CYLINDER",
    "MISC TXN, MISC NOTE+, UPI-PAY8, UPI-PAY9, ZOMATO ORDER, JIO RECHARGE, MISC BOX, MISC TXN+, KFC MEAL, PAYTM WALLET, ATM CASH, note lower",
)
NARRATION_LIST = [n.strip() for row in NARRATIONS for n in row.split(",")]
SEGMENT_OF = {"HOUSEHOLD": "shg_woman", "AUTOMOBILE": "gig_worker", "BUILDING": "kirana_owner",
              "FURNITURE": "salaried_informal", "MACHINERY": "rural_farmer"}
BILL_KINDS = ("electricity", "mobile", "water", "dth", "gas")
OCCUPATIONS = ("farmer", "dairy", "tailor", "trader", "weaver")
# flag name -> modulus: 1 where the customer key divides by it
FLAG_MODULI = {"default_label": 11, "owns_vehicle": 3, "prop_tax_compliant": 4, "has_fd_or_rd": 5,
               "itr_filed": 6, "gst_registered": 9, "jan_dhan_active": 2, "shg_member": 8,
               "svanidhi_repaid": 17, "fraud_flag": 50}
QA_TOPICS = (*fv.FINANCE_TOPICS, "Sports", "Cooking")
RAW_LANGUAGES = ("hi-IN", "ta-IN", "en-IN", "xx")
# --------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table whose scan has fewer parts than there are cores, before costly row work.

    Any larger table is already spread by its scan and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _pick(values, index) -> F.Column:
    """values[index], zero-based, from a literal array."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _user(key: str):
    return F.concat(F.lit("USR-"), F.col(key).cast("string"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank statement lines with text amounts, some without amount, some with a bad user."""
    lines = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))  # the lines are shuffled once
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    slot = (F.col("o_custkey") % 10) * 12 + (F.col("l_partkey") + 3 * F.col("l_linenumber")) % 12
    rows = rows.withColumn("_narration", _pick(NARRATION_LIST, slot))
    credit = F.endswith("_narration", F.lit("+"))
    paid = F.when(F.col("l_quantity") < 50, F.format_number("l_extendedprice", 2))
    return rows.select(
        F.when(F.col("l_partkey") % 211 == 0, "BAD").otherwise(_user("o_custkey")).alias("user_id"),
        F.date_format("l_shipdate", "dd-MM-yyyy").alias("date"),
        F.regexp_replace("_narration", r"\+$", "").alias("particulars"),
        F.lit(None).cast("string").alias("chq_num"),
        F.when(~credit, paid).alias("withdrawal"),
        F.when(credit, paid).alias("deposit"),
        F.format_number("c_acctbal", 2).alias("balance"),
    )


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.col("l_returnflag") == "R"
    return rows.select(
        _user("o_custkey").alias("user_id"),
        ((F.year("l_shipdate") * 12 + F.month("l_shipdate")) % 26).cast("int").alias("month"),
        _pick(BILL_KINDS, F.col("l_linenumber") % 5).alias("bill_type"),
        F.round(F.col("l_extendedprice") - 1000.0, 2).alias("amount"),
        F.when(late, 0).otherwise(1).alias("paid_on_time"),
        F.when(late, (F.col("l_quantity") * 2).cast("int")).otherwise(0).alias("days_late"),
    )


def upi(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.when(F.col("event_type") == "error", "FAILED")
              .when(F.col("event_id") % 97 == 0, "PENDING").otherwise("SUCCESS"))
    return table(spark, sf_dir, "events").select(
        _user("user_id").alias("user_id"),
        ((F.dayofmonth("ts") - 1) % 13 + 1).cast("int").alias("month"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("category"),
        status.alias("status"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey"))
    pairs = [F.lit(x) for pair in SEGMENT_OF.items() for x in pair]
    whole = {"land_acres": 13, "bank_vintage_months": 150, "upi_txn_per_month": 400, "employment_months": 200,
             "shg_months": 60, "dbt_months": 24, "sim_tenure_months": 96}
    return people.select(
        _user("c_custkey").alias("user_id"),
        F.element_at(F.create_map(*pairs), F.col("c_mktsegment")).alias("segment"),
        F.col("n_name").alias("state"),
        F.round(F.col("c_acctbal") * 4.0, 2).alias("income_monthly"),
        ((k % 101) / 100.0).alias("bill_ontime_rate_24m"),
        ((k % 31) / 20.0 - 0.3).alias("savings_ratio"),
        *[(k % m).cast("int").alias(c) for c, m in whole.items()],
        ((k % 91 + 10) / 100.0).alias("location_stability"),
        *[F.when(k % m == 0, 1).otherwise(0).alias(c) for c, m in FLAG_MODULI.items()],
        (k % 2).cast("int").alias("owns_land"),
        ((k % 1000) / 1000.0).alias("default_probability"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored users of the pillar line."""
    pairs = [F.lit(x) for pair in SEGMENT_OF.items() for x in pair]
    base = table(spark, sf_dir, "customer").select(
        _user("c_custkey").alias("user_id"),
        F.element_at(F.create_map(*pairs), F.col("c_mktsegment")).alias("segment"),
        ((F.col("c_custkey") % 1000) / 1000.0).alias("default_probability"),
    )
    scored = base.withColumn("score", pd_to_score(F.col("default_probability")))
    return scored.withColumn("score_band", score_band(F.col("score")))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contribution per contract feature and user, in steps of 0.01."""
    k = F.col("c_custkey")
    pairs = [F.lit(x) for pair in SEGMENT_OF.items() for x in pair]
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(
        _user("c_custkey").alias("user_id"),
        F.element_at(F.create_map(*pairs), F.col("c_mktsegment")).alias("segment"),
        *[(((k * (7 + i)) % 401 - 200) / 100.0).alias(name) for i, name in enumerate(fv.CONTRACT_FEATURES)],
    )


def borrowers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with occupation, place, income and score for scheme matching."""
    k = F.col("c_custkey")
    score = pd_to_score((k % 1000) / 1000.0)
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey"))
    return people.select(
        _user("c_custkey").alias("user_id"),
        _pick(OCCUPATIONS, k % 5).alias("occupation"),
        F.concat(F.lit("City "), (k % 7).cast("string")).alias("city"),
        F.col("n_name").alias("state"),
        score.alias("credit_score"),
        F.round(F.col("c_acctbal") * 48.0, 2).alias("annual_income"),
    )


def rural_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
            .join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
                  F.col("c_nationkey") == F.col("n_nationkey")))
    return rows.select(
        F.col("c_mktsegment").alias("primary_business"), F.col("n_name").alias("city"),
        F.col("o_totalprice").alias("annual_income"),
        (k % 5000).cast("double").alias("monthly_expenses"),
        (k % 90000 + 10000).cast("double").alias("loan_amount"),
        (k % 48 + 12).cast("int").alias("loan_tenure"),
        (k % 4).cast("int").alias("young_dependents"), (k % 3).cast("int").alias("old_dependents"),
    )


def finance_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        k.alias("id"), F.col("text").alias("question"),
        *[F.concat(F.lit(f"opt {x} "), k.cast("string")).alias(f"option_{x}") for x in "abcd"],
        _pick(("A", "B", "C", "D", "raw"), k % 5).alias("correct_answer"),
        _pick(QA_TOPICS, k % len(QA_TOPICS)).alias("topic"),
        F.when(k % 2 == 0, "hi").otherwise("en").alias("lang"),
    )


def state_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan accounts and amounts per state, from the orders of its customers."""
    per_nation = (
        table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
              F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("accounts"), F.round(F.sum("o_totalprice"), 2).alias("amount")))
    return per_nation.join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("n_name").alias("state"), "accounts", "amount")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table as chunks; the document source stands in for the state."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("state"))
    return table(spark, sf_dir, "embeddings").join(
        documents, F.col("vec_id") == F.col("doc_id"), "left"
    ).select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("target_group"), "state",
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean vector of the label, from the whole embedding table."""
    parts = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("x"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    return packed.select(
        F.col("label").alias("query_id"), F.col("label").alias("expected_group"),
        F.transform("xs", lambda s: s["x"]).alias("embedding"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = (F.when(F.col("turn") % 3 == 0, "<think>x</think>")
              .when(F.col("turn") % 3 == 1, "<think>x").otherwise(""))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.concat(prefix, "text").alias("reply"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", _pick(RAW_LANGUAGES, F.col("conv_id") % 4).alias("raw_language"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
