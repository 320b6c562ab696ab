"""Incremental refresh: only users whose features changed are scored and explained again."""
from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.workspace import write_through
from ..sources import schemas
from ..sources.tables import (append_log, changed_between, ensure_table, increment_read, snapshot_read,
                              snapshot_versions, snapshot_write)
from .analytics import latest_success
from .contract import FeatureContract
from .contributions import contributions
from .explain import score_explanations
from .models import score_all

NO_CHANGES, SUCCESS = "NO_CHANGES", "SUCCESS"


@dataclass(frozen=True)
class RefreshTables:
    """Locations: features are full snapshots, scores and explanations increments, the log is append-only."""
    features: str
    scores: str
    explanations: str
    log: str

    @classmethod
    def under(cls, root: str) -> "RefreshTables":
        return cls(*(f"{root}/{name}" for name in ("features", "scores", "explanations", "refresh_log")))


def restrict_to_changed(features: DataFrame, keys: DataFrame, key: str = "user_id") -> DataFrame:
    return features.join(keys, key, "left_semi")


def _last_version(spark: SparkSession, tables: RefreshTables) -> int:
    row = latest_success(ensure_table(spark, tables.log, schemas.REFRESH_LOG)).select("new_version").first()
    return int(row["new_version"]) if row else 0


def read_scores(spark: SparkSession, tables: RefreshTables) -> DataFrame:
    return increment_read(spark, tables.scores, "user_id", schemas.CREDIT_SCORES)


def read_explanations(spark: SparkSession, tables: RefreshTables) -> DataFrame:
    return increment_read(spark, tables.explanations, "user_id", schemas.EXPLANATIONS)


def changed_users(spark: SparkSession, tables: RefreshTables, last: int, newest: int) -> DataFrame:
    """Users inserted or updated after version ``last``; all users where that version is not there."""
    new = snapshot_read(spark, tables.features, newest)
    if last not in snapshot_versions(spark, tables.features):
        return new.select("user_id").distinct()
    return changed_between(snapshot_read(spark, tables.features, last), new, "user_id")


def refresh(spark: SparkSession, tables: RefreshTables, model, contract: FeatureContract = FeatureContract(),
            now: datetime | None = None, version: str = "nightly_refresh", run_id: str = "nightly_job") -> str:
    """Change feed -> score changed users -> upsert scores and explanations -> log.

    Only the rows of changed users are scored, explained and written; readers
    take the newest row per user.  The last processed version is exclusive: it
    is not read again.  Without changes the run is logged as NO_CHANGES and
    nothing else is written.
    """
    now, started = now or datetime.now(), time.monotonic()
    last = _last_version(spark, tables)
    newest = snapshot_versions(spark, tables.features)[-1]
    keys = write_through(changed_users(spark, tables, last, newest), "changed_users") if newest != last else None
    n_changed = keys.count() if keys is not None else 0
    if n_changed == 0:
        _log(spark, tables, now, last, newest, 0, 0, "N/A", 0.0, NO_CHANGES)
        return NO_CHANGES

    features = restrict_to_changed(snapshot_read(spark, tables.features, newest), keys)
    features = features.na.fill(0.0, subset=list(contract.features))
    fresh = shaped(score_all(model, features, version, run_id, now), schemas.CREDIT_SCORES)
    written = snapshot_write(fresh, tables.scores)

    scored = snapshot_read(spark, tables.scores, written)
    moved = contributions(model, features, contract.features)
    told = score_explanations(moved, scored, "refresh").withColumn("computed_at", F.lit(now).cast("timestamp"))
    snapshot_write(shaped(told, schemas.EXPLANATIONS), tables.explanations)

    total = read_scores(spark, tables).count()
    _log(spark, tables, now, last, newest, n_changed, total, "Champion", time.monotonic() - started, SUCCESS)
    return SUCCESS


def shaped(df: DataFrame, schema) -> DataFrame:
    """The table's columns, types and order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _log(spark, tables, now, last, newest, changed, total, champion, seconds, status) -> None:
    row = (now, last, newest, changed, total, champion, float(seconds), status)
    append_log(spark.createDataFrame([row], schemas.REFRESH_LOG), tables.log, schemas.REFRESH_LOG)
