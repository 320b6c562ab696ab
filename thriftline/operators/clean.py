"""Row-level cleaning of statements and validity rules of the pillar tables."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import fixed_values as fv, rules, text

VARIANTS = ("batch", "dlt")


def _check(variant: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")


def clean_amounts(df: DataFrame, variant: str = "batch") -> DataFrame:
    """Text amounts -> DOUBLE ``clean_withdrawal``, ``clean_deposit``, ``clean_balance``.

    batch keeps NULL for a missing amount; dlt drops everything but digits and
    points (so also the sign) and turns a missing amount into 0.0.
    """
    _check(variant)
    if variant == "batch":
        money = {c: text.amount(F.col(c)) for c in ("withdrawal", "deposit", "balance")}
    else:
        money = {c: text.unsigned_amount(F.col(c)) for c in ("withdrawal", "deposit")}
        money["balance"] = text.spaced_amount(F.col("balance"))
    return df.withColumns({f"clean_{c}": e for c, e in money.items()})


def parse_date(df: DataFrame, fmt: str = "dd-MM-yyyy", column: str = "date") -> DataFrame:
    return df.withColumn(column, text.statement_date(F.col(column), fmt))


def normalise_text(df: DataFrame, column: str = "particulars") -> DataFrame:
    return df.withColumn(f"{column}_lower", F.lower(column))


def categorise(df: DataFrame, rule_set=None, variant: str = "batch") -> DataFrame:
    """Add ``category``.  Rule order is part of the meaning: see fixed_values."""
    _check(variant)
    chosen = rule_set or (fv.CATEGORY_RULES if variant == "batch" else fv.CATEGORY_RULES_DLT)
    return df.withColumn("category", rules.category_of(F.col("particulars_lower"), chosen))


def transaction_type(df: DataFrame, variant: str = "batch") -> DataFrame:
    """Debit if there is a withdrawal, else Credit if there is a deposit, else Unknown."""
    _check(variant)
    out, into = F.col("clean_withdrawal"), F.col("clean_deposit")
    present = (out.isNotNull(), into.isNotNull()) if variant == "batch" else (out > 0, into > 0)
    return df.withColumn(
        "transaction_type", rules.first_match(zip(("Debit", "Credit"), present), "Unknown"))


def extract_merchant(df: DataFrame, variant: str = "batch") -> DataFrame:
    _check(variant)
    return df.withColumn("merchant", text.merchant(F.col("particulars"), variant))


def enrich(df: DataFrame, variant: str = "batch", rule_set=None) -> DataFrame:
    """All row-level steps in one narrow projection; works on batch and streaming frames."""
    out = parse_date(clean_amounts(df, variant))
    out = categorise(normalise_text(out), rule_set, variant)
    return extract_merchant(transaction_type(out, variant), variant)


def dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest of the key's rows, comparing the other columns in order.

    The survivor is the same on every run.  ``min`` of a struct combines on the
    map side, so a key with very many copies reaches its reducer as one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_kept"))
    columns = [F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in df.columns]
    return kept.select(*columns)


def dedupe_statements(df: DataFrame) -> DataFrame:
    return dedupe(df, ["user_id", "date", "particulars"])


def valid_profiles(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("user_id").isNotNull() & F.col("segment").isNotNull()
        & (F.col("income_monthly") > 0)
        & F.col("bill_ontime_rate_24m").between(0.0, 1.0)
        & F.col("savings_ratio").between(-1.0, 1.0)
        & F.col("default_label").isin(0, 1)
    )


def valid_bills(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("user_id").isNotNull()
        & (F.col("amount") > 0) & (F.col("amount") < fv.MAX_BILL)
        & F.col("paid_on_time").isin(0, 1)
        & F.col("days_late").between(0, 90)
        & F.col("month").between(1, 24)
        & F.col("bill_type").isin(*fv.BILL_TYPES)
    )


def valid_upi(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("user_id").isNotNull()
        & (F.col("amount") > 0) & (F.col("amount") < fv.MAX_UPI)
        & F.col("status").isin(*fv.UPI_STATUSES)
        & F.col("month").between(1, 12)
    )


def clean_profiles(df: DataFrame) -> DataFrame:
    return dedupe(valid_profiles(df), ["user_id"])


def clean_bills(df: DataFrame) -> DataFrame:
    return dedupe(valid_bills(df), ["user_id", "month", "bill_type"])


def clean_upi(df: DataFrame) -> DataFrame:
    return dedupe(valid_upi(df), ["user_id", "month", "amount", "category"])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skipped = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skipped]


def fill_numeric_nulls(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Every numeric NULL, counts included, becomes 0 of its own type."""
    return df.na.fill(0, subset=numeric_columns(df, exclude))


def month_bucket(df: DataFrame, column: str = "date") -> DataFrame:
    """Month start as a DATE."""
    return df.withColumn("month", F.trunc(column, "month"))


def one_hot(df: DataFrame, column: str = "persona", flags=None) -> DataFrame:
    return df.withColumns(rules.one_hot(F.col(column), flags or fv.PERSONA_FLAGS))
