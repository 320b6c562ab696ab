"""Expectations, quarantine and data-quality reports."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, text

FAIL, DROP, WARN = "fail", "drop", "warn"


@dataclass(frozen=True)
class Expectation:
    name: str
    predicate: Column
    severity: str = WARN


def statement_expectations(as_of: str) -> list[Expectation]:
    """The seven rules on streamed statements; ``as_of`` replaces today's date."""
    rescued = F.col("_rescued_data").isNull()
    return [
        Expectation("critical_no_negative_balance", text.spaced_amount(F.col("balance")) >= 0, FAIL),
        Expectation("valid_user_id", F.col("user_id").isNotNull() & F.col("user_id").rlike(fv.USER_ID_PATTERN), DROP),
        Expectation("valid_date", F.col("date").isNotNull(), DROP),
        Expectation("valid_transaction", F.col("withdrawal").isNotNull() | F.col("deposit").isNotNull(), DROP),
        Expectation("realistic_amounts",
                    F.regexp_replace("withdrawal", "[^0-9.]", "").try_cast("double") < fv.LARGEST_WITHDRAWAL, DROP),
        Expectation("high_quality_data", rescued, WARN),
        Expectation("recent_transactions", F.datediff(F.lit(as_of).cast("date"), F.col("date")) < fv.FRESH_DAYS, WARN),
    ]


def feature_expectations() -> list[Expectation]:
    return [
        Expectation("sufficient_transaction_history", F.col("total_transactions") >= fv.MIN_HISTORY, WARN),
        Expectation("valid_persona", F.col("persona").isNotNull(), WARN),
    ]


def holds(rule: Expectation, null_passes: bool = True) -> Column:
    """The predicate with NULL decided: a rule that can't be judged passes by default."""
    return F.coalesce(rule.predicate, F.lit(null_passes))


def keep_rows(df: DataFrame, rules: list[Expectation], null_passes: bool = True) -> DataFrame:
    """Apply fail and drop rules.  A broken fail rule stops the job while the row is read,
    before it can be written.  Works on streaming frames."""
    for rule in rules:
        ok = holds(rule, null_passes)
        if rule.severity == FAIL:
            df = df.filter(F.when(ok, True).otherwise(
                F.raise_error(F.lit(f"expectation failed: {rule.name}")).cast("boolean")))
    drops = [holds(r, null_passes) for r in rules if r.severity == DROP]
    return df.filter(reduce(lambda a, b: a & b, drops)) if drops else df


def expectation_metrics(df: DataFrame, rules: list[Expectation], null_passes: bool = True) -> DataFrame:
    """rule, severity, passed, failed: one aggregate over the table, then one row per rule."""
    counted = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(~holds(r, null_passes)).alias(r.name) for r in rules])
    entries = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                 (F.col("_n") - F.col(r.name)).alias("passed"), F.col(r.name).alias("failed"))
        for r in rules])
    return counted.select(F.inline(entries))


def expect(df: DataFrame, rules: list[Expectation], null_passes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Kept rows and the metrics of all rules."""
    return keep_rows(df, rules, null_passes), expectation_metrics(df, rules, null_passes)


def quarantine(df: DataFrame, rules: list[Expectation], null_passes: bool = True) -> DataFrame:
    """Rows that break a fail or drop rule, with the names of the rules they break."""
    binding = [r for r in rules if r.severity != WARN]
    names = F.array_compact(F.array(*[F.when(~holds(r, null_passes), F.lit(r.name)) for r in binding]))
    return df.withColumn("broken_rules", names).filter(F.size("broken_rules") > 0)


def quality_report(df: DataFrame) -> DataFrame:
    """NULL users, NULL dates and rows with neither amount."""
    return df.agg(
        F.count_if(F.col("user_id").isNull()).alias("null_user_id"),
        F.count_if(F.col("date").isNull()).alias("null_date"),
        F.count_if(F.col("clean_withdrawal").isNull() & F.col("clean_deposit").isNull()).alias("null_both_amounts"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, null_count for every column, from one aggregate."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "null_count")


def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_before, rows_after, rows_dropped, dropped_pct from one pass over each input."""
    sizes = before.agg(F.count("*").alias("n")).withColumn("side", F.lit("before")).unionByName(
        after.agg(F.count("*").alias("n")).withColumn("side", F.lit("after")))
    totals = sizes.agg(
        F.sum(F.when(F.col("side") == "before", F.col("n"))).alias("rows_before"),
        F.sum(F.when(F.col("side") == "after", F.col("n"))).alias("rows_after"))
    dropped = F.col("rows_before") - F.col("rows_after")
    return totals.withColumns({
        "rows_dropped": dropped,
        "dropped_pct": F.round(F.try_divide(dropped * 100.0, F.col("rows_before")), 2)})
