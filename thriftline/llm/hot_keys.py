"""Joins onto rows of which one key may have a third."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .frames import named

#: A key is hot if it has more than one in SHARE of all rows; so there are at most SHARE hot keys.
SHARE = 10_000


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """Join ``facts`` (one row per key, with the number ``n`` of its rows) onto ``rows``, which are read twice.

    A key with more than ``total`` / SHARE rows is hot.  As all keys together
    have ``total`` rows, the hot ones are fewer than SHARE, and are broadcast;
    their rows stay where they are.  Rows without a key stay as well.  All others
    meet in a shuffle join that has no hot key.  ``how`` is left or inner.
    """
    hot = facts.filter(F.col(n) > max(1, total // SHARE)).drop(n)
    cold = facts.filter(F.col(n) <= max(1, total // SHARE)).drop(n)
    there: Column = reduce(lambda a, b: a & b, [named(k).isNotNull() for k in keys])
    keyed = rows.filter(there)
    out = keyed.join(F.broadcast(hot), keys).unionByName(
        keyed.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))
    if how == "left":
        out = out.unionByName(rows.filter(~there), allowMissingColumns=True)
    return out


def attach_listed(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """As ``attach``, with the hot keys as a list in the plan: fewer than SHARE values of the first key come to the driver.

    Rows are told apart by a filter on it, so none passes a join only to be told
    that it isn't hot.
    """
    first = named(keys[0])
    hot = [r[0] for r in facts.filter(F.col(n) > max(1, total // SHARE)).select(first).distinct().collect()]
    facts = facts.drop(n)
    if not hot:
        return rows.join(facts, keys, how)
    out = rows.filter(first.isin(hot)).join(F.broadcast(facts.filter(first.isin(hot))), keys, how).unionByName(
        rows.filter(~first.isin(hot)).join(facts.filter(~first.isin(hot)), keys, how))
    return out.unionByName(rows.filter(first.isNull()), allowMissingColumns=True) if how == "left" else out
