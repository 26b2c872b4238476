"""Data mode keeps messages in a nullable ``error`` column; strict mode raises the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame


class MissingKey(KeyError):
    """A looked-up key isn't there."""


def strict(df: DataFrame, column: str = "error", kind: type[Exception] = ValueError) -> DataFrame:
    """``df`` without its error column, after one action that raises ``kind`` for a message in it."""
    first = df.filter(df[column].isNotNull()).select(column).first()
    if first is not None:
        raise kind(first[0])
    return df.drop(column)
