"""Registration of queries, their check SQL and the tables they share."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.workspace import write_through
from . import oracle

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    name: str
    ids: str
    build: Build
    sql: str | None = None
    doubles: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.withColumns({c: settle(F.col(c), d) for c, d in self.doubles.items()}) if self.doubles else df

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return oracle.query(self.sql)
        shown = ", ".join(f"{settle_sql(c, d)} AS {c}" for c, d in self.doubles.items())
        return oracle.query(f"SELECT * REPLACE ({shown}) FROM ({self.sql.strip()})")


def settle(value, digits: int):
    """Round a double for comparison: both engines do the same four steps, and the
    cut lies off the halves on which averages of money amounts often fall."""
    scale = F.lit(10.0 ** digits)
    return F.floor(value * scale + F.lit(0.637)).cast("double") / scale


def settle_sql(column: str, digits: int) -> str:
    scale = repr(10.0 ** digits) + "::DOUBLE"
    return f"floor({column} * {scale} + 0.637::DOUBLE) / {scale}"


CASES: dict[str, Case] = {}


def case(name: str, ids: str, sql: str | None = None, **doubles: int):
    """Decorator: register a query under ``name`` for the operators ``ids``."""
    def register(build: Build) -> Build:
        if name in CASES:
            raise ValueError(f"query {name} is registered twice")
        CASES[name] = Case(name, ids, build, sql, doubles)
        return build

    return register


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A layer table that several queries read: written once per application, then scanned."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = write_through(build(), name)
    return _STORED[key]
