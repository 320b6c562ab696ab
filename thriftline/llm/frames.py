"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The white space of the contracts: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def named(column: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, beside the columns in ``more``.

    Whatever names the input brings, they can't clash with an operator's own.
    """
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``row`` again, then ``new``; a new column takes the place of one of the same name."""
    kept = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in {n.lower() for n in new}]
    replaced = [v.alias(k) for k, v in new.items()]
    return df.select(*kept, *replaced)


def replaced(df: DataFrame, columns: list[str], column: str, value: Column) -> DataFrame:
    """The columns of ``row`` in their order, with the values of one exchanged."""
    return df.select(*[(value if c == column else F.col("row").getField(c)).alias(c) for c in columns])


def ascii_lower(value: Column) -> Column:
    """A-Z lower-cased, all else left alone."""
    return F.translate(value, UPPER, UPPER.lower())


def digest(value: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they identify a text."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same batches, none with more than ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
