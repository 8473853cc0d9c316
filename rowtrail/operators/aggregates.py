"""Aggregates with declared inputs, so that each result column knows what explains it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from rowtrail.operators.influence import All, Influence, Max, Min, Union
from rowtrail.operators.keyed import col


@dataclass(frozen=True)
class Agg:
    """``expr``: any aggregate Column (a pandas grouped-aggregate UDF call is one too).

    ``uses``: input columns, the first being the value that influence operators look at.
    ``influence``: rows that explain the result under column-level lineage.
    """

    expr: Column
    uses: tuple[str, ...] = ()
    influence: Influence = All()


def total(value: str, influence: Influence = All()) -> Agg:
    return Agg(F.sum(col(value)), (value,), influence)


def average(value: str, influence: Influence = All()) -> Agg:
    return Agg(F.avg(col(value)), (value,), influence)


def smallest(value: str) -> Agg:
    return Agg(F.min(col(value)), (value,), Min())


def largest(value: str) -> Agg:
    return Agg(F.max(col(value)), (value,), Max())


def spread(value: str) -> Agg:
    """Largest minus smallest value, explained by one row of each."""
    return Agg(F.max(col(value)) - F.min(col(value)), (value,), Union(Min(), Max()))


def population_variance(value: str, influence: Influence = All()) -> Agg:
    return Agg(F.var_pop(col(value)), (value,), influence)


def sample_variance(value: str, influence: Influence = All()) -> Agg:
    return Agg(F.var_samp(col(value)), (value,), influence)


def rows() -> Agg:
    return Agg(F.count(F.lit(1)))


def distinct_values(value: str) -> Agg:
    return Agg(F.count_distinct(col(value)), (value,))


def total_where(value: str, condition: Column) -> Agg:
    """Order-free conditional sum: only the values that satisfy the condition count."""
    return Agg(F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0)), (value,))
