"""Explicit schemas of every table that is read or written."""
from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
          "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType()}


def schema_of(spec: str) -> T.StructType:
    """'name TYPE [NOT NULL], ...' without needing a running session."""
    parts = [column.split() for column in spec.split(",")]
    return T.StructType([T.StructField(p[0], _TYPES[p[1]], p[2:] != ["NOT", "NULL"]) for p in parts])


STATEMENTS = schema_of(
    "user_id STRING, date STRING, particulars STRING, chq_num STRING, withdrawal STRING, deposit STRING, balance STRING")
BILLS = schema_of("user_id STRING, month INT, bill_type STRING, amount DOUBLE, paid_on_time INT, days_late INT")
UPI = schema_of("user_id STRING, month INT, amount DOUBLE, category STRING, status STRING")
CREDIT_SCORES = schema_of(
    "user_id STRING NOT NULL, segment STRING, score INT, score_band STRING, default_probability DOUBLE, "
    "score_timestamp TIMESTAMP, model_version STRING, model_run_id STRING")
EXPLANATIONS = schema_of(
    "user_id STRING NOT NULL, segment STRING, explanation_text STRING, top_positive_factors STRING, "
    "top_negative_factors STRING, shap_pillar_1_bill_payment_pts DOUBLE, shap_pillar_2_upi_flow_pts DOUBLE, "
    "shap_pillar_3_assets_pts DOUBLE, shap_pillar_4_income_pts DOUBLE, shap_pillar_5_identity_pts DOUBLE, "
    "shap_pillar_6_stability_pts DOUBLE, computed_at TIMESTAMP")
BEST_PARAMS = schema_of(
    "run_timestamp TIMESTAMP, n_trials INT, best_auc DOUBLE, champion_auc DOUBLE, improvement DOUBLE, "
    "promoted BOOLEAN, step_size DOUBLE, max_bins INT, max_depth INT, min_instances INT, "
    "feature_fraction DOUBLE, subsampling_rate DOUBLE, min_info_gain DOUBLE, max_iter INT")
REFRESH_LOG = schema_of(
    "run_timestamp TIMESTAMP, last_processed_ver BIGINT, new_version BIGINT, changed_users BIGINT, "
    "total_users_scored BIGINT, champion_version STRING, run_duration_secs DOUBLE, status STRING")
SCHEMES = schema_of("scheme_id INT, scheme_name STRING, target_group STRING, state STRING, content STRING")
RUNS = schema_of("run_name STRING, key STRING, kind STRING, value STRING")
