"""The three end-to-end flows, each written table by table as a scheduled job would run them."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, contract, explain, pillar_features, score_tables, statement_features as sf
from .workspace import wide_rows, write_through


def silver_from_statements(statements: DataFrame, variant: str = "batch") -> DataFrame:
    """Statements -> silver rows with persona, reading the statements once.

    The enriched rows feed both the per-user signals and the rows themselves.
    Writing them first means text parsing and the rule cascade run once; the
    signals then scan four of the columns.  The rows are shuffled once, by user.
    """
    rows = write_through(clean.enrich(statements, variant), f"enriched_{variant}")
    personas = write_through(sf.user_personas(rows, variant).select("user_id", "persona", "total_transactions"), f"personas_{variant}")
    return sf.clustered_silver(rows, personas, variant)


def statement_tables(statements: DataFrame, model=None) -> dict[str, DataFrame]:
    """silver, gold and dashboard of the statement line.

    Without a model the rule score stands in for the prediction.
    """
    silver = write_through(silver_from_statements(statements), "silver")
    with wide_rows(statements.sparkSession, silver.count()):
        gold = write_through(sf.statement_features(silver), "gold_st")
    if model is None:
        predicted = score_tables.with_rule_score(gold, column="prediction").withColumn(
            "prediction", F.col("prediction").cast("double"))
    else:
        predicted = model.transform(gold)
    return {"silver": silver, "gold": gold, "dashboard": score_tables.dashboard_table(predicted)}


def pillar_tables(profiles: DataFrame, bills: DataFrame, upi: DataFrame) -> dict[str, DataFrame]:
    """user_features and the contract table of the pillar line."""
    features = write_through(pillar_features.user_features(
        clean.clean_profiles(profiles), clean.clean_bills(bills), clean.clean_upi(upi)), "user_features")
    return {"user_features": features, "gold": contract.feature_contract(pillar_features.model_ready(features))}


def scored_tables(model, gold: DataFrame, version: str, run_id: str, now) -> dict[str, DataFrame]:
    """credit_scores and score_explanations from the contract table."""
    from ..operators.contributions import contributions
    from ..operators.models import score_all
    from ..functions import fixed_values as fv

    scores = write_through(score_all(model, gold, version, run_id, now), "credit_scores")
    moved = contributions(model, gold, list(fv.CONTRACT_FEATURES))
    return {"credit_scores": scores, "score_explanations": explain.score_explanations(moved, scores)}
