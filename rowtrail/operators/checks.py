"""Built-in tests that pick suspicious outputs: minimum, maximum, null, or any predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.operators.keyed import col


def is_min(outputs: DataFrame, value: str) -> Column:
    """The output holds the smallest value of all outputs (a one-row subquery)."""
    return col(value) == outputs.agg(F.min(col(value))).scalar()


def is_max(outputs: DataFrame, value: str) -> Column:
    return col(value) == outputs.agg(F.max(col(value))).scalar()


def is_missing(value: str) -> Column:
    return col(value).isNull()
