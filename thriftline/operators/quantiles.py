"""Exact quantiles of unbounded columns without a sort of the table."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.workspace import write_through

#: Pivots lie within this share of the wanted rank; only the work depends on it, never the result.
ACCURACY = 10_000


@dataclass
class _Search:
    """One wanted rank among the ``rows`` values strictly between ``low`` and ``high``."""
    name: str
    rank: int
    rows: int
    low: float | None = None
    high: float | None = None
    value: float | None = None
    open: bool = True

    def narrow(self, counted: list[tuple[float, int, int]]) -> None:
        """Take the pivot that has the rank, else go on between the two pivots around it.

        ``counted`` holds ascending pivots with the rows below and up to them.
        """
        left, right = 0, self.rows
        for pivot, below, upto in counted:
            if self.rank <= below:
                self.high, right = pivot, below
                break
            if self.rank <= upto:
                self.value, self.open = pivot, False
                return
            self.low, left = pivot, upto
        self.rank, self.rows = self.rank - left, right - left

    def holds(self, value: Column) -> Column:
        """Whether a value lies between the bounds."""
        inside = value.isNotNull()
        if self.low is not None:
            inside &= value > F.lit(self.low)
        return inside & (value < F.lit(self.high)) if self.high is not None else inside


def _around(share: float, accuracy: int) -> list[float]:
    step = 2.0 / accuracy
    return sorted({max(share - step, 0.0), share, min(share + step, 1.0)})


def _count(rows: DataFrame, asked: list[tuple[_Search, Column, list[float]]]) -> None:
    """Count the rows around all pivots of all searches in one pass, and narrow each search."""
    pairs = [F.array(*[F.array(F.count_if(value < F.lit(p)), F.count_if(value <= F.lit(p))) for p in pivots])
             for _, value, pivots in asked]
    counts = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(pairs)]).first()
    for (search, _, pivots), found in zip(asked, counts):
        search.narrow([(p, below, upto) for p, (below, upto) in zip(pivots, found)])


def exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """The nearest-rank quantiles of every column: the value of rank ``ceil(share * n)``, at least 1.

    A sketch proposes pivots around each rank and the rows below and at them
    are counted, so a pivot is taken only if it has the rank.  Otherwise the
    values between the two pivots around it, some ``4 / accuracy`` of all rows,
    are written once and searched in the same way; each round leaves out at
    least its pivots.  Nothing is sorted or shuffled but aggregates of one row.
    ``df`` is read two or three times: write a costly one first.

    NULL takes no part, NaN is larger than every number, and a column without
    values gives None.
    """
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    numbers = [F.when(~F.isnan(v), v) for v in values]
    proposals = sorted({p for share in shares for p in _around(share, accuracy)})
    first = df.agg(*[
        F.struct(F.count(v), F.count(x), F.percentile_approx(x, proposals, accuracy)).alias(f"c{i}")
        for i, (v, x) in enumerate(zip(values, numbers))]).first()

    searches: dict[tuple[str, float], _Search] = {}
    asked = []
    for name, x, (n, n_numbers, pivots) in zip(columns, numbers, first):
        for share in shares:
            search = _Search(name, max(math.ceil(share * n), 1), n_numbers)
            searches[name, share] = search
            if search.rank > n_numbers:  # no value at all, or only NaN from that rank on
                search.value, search.open = (math.nan if n else None), False
            else:
                asked.append((search, x, sorted(set(pivots))))
    if asked:
        _count(df, asked)

    going = [(s, x) for s, x, _ in asked if s.open]
    if going:
        entries = F.array(*[
            F.struct(F.lit(i).alias("search"), F.when(s.holds(x), x).alias("value")) for i, (s, x) in enumerate(going)])
        inside = write_through(
            df.select(F.inline(F.filter(entries, lambda e: e["value"].isNotNull()))), "quantile_search")
        going = [(s, F.when(F.col("search") == i, F.col("value"))) for i, (s, _) in enumerate(going)]
        while going:
            within = [F.when(s.holds(x), x) for s, x in going]
            found = inside.agg(*[
                F.percentile_approx(x, _around(s.rank / s.rows, accuracy), accuracy).alias(f"c{i}")
                for i, ((s, _), x) in enumerate(zip(going, within))]).first()
            _count(inside, [(s, x, sorted(set(p))) for (s, _), x, p in zip(going, within, found)])
            going = [(s, x) for s, x in going if s.open]
    return {c: [searches[c, share].value for share in shares] for c in columns}
