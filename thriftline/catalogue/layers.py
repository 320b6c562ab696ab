"""The layer tables behind the queries, each written once and then read."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean, contract, explain, pillar_features, score_tables, statement_features as sf
from ..plans import flows
from ..plans.workspace import wide_rows
from . import inputs
from .registry import stored

AS_OF = "2001-12-31"


def enriched(spark: SparkSession, sf_dir: str, variant: str = "batch") -> DataFrame:
    return clean.enrich(inputs.statements(spark, sf_dir), variant)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "silver", lambda: flows.silver_from_statements(inputs.statements(spark, sf_dir)))


def silver_dlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "silver_dlt", lambda: flows.silver_from_statements(inputs.statements(spark, sf_dir), "dlt"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir)
    with wide_rows(spark, rows.count()):
        return stored(spark, sf_dir, "gold_st", lambda: sf.statement_features(rows))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard table with the rule score standing in for a model's prediction."""
    def build() -> DataFrame:
        scored = score_tables.with_rule_score(gold(spark, sf_dir), column="prediction")
        return score_tables.dashboard_table(scored.withColumn("prediction", F.col("prediction").cast("double")))

    return stored(spark, sf_dir, "dashboard", build)


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "user_features", lambda: pillar_features.user_features(
        clean.clean_profiles(inputs.profiles(spark, sf_dir)), clean.clean_bills(inputs.bills(spark, sf_dir)),
        clean.clean_upi(inputs.upi(spark, sf_dir))))


def gold_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "gold_pl", lambda: contract.feature_contract(
        pillar_features.model_ready(user_features(spark, sf_dir))))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "explanations", lambda: explain.score_explanations(
        inputs.contributions(spark, sf_dir), inputs.scores(spark, sf_dir)))
