"""Keyed folds that no built-in aggregate expresses.

A fold is a set of state columns computed from each row and a ``combine`` function that reduces
several states of a key to one.  States are combined per Arrow batch before anything is shuffled,
then per (key, slice of input partitions), then per key, so a hot key reaches one task only as a
bounded number of states.  After a shuffle the states come sorted by key and are combined batch by
batch, all keys of a batch in one call; only the states of the last, still open key are carried on.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.operators.keyed import col
from rowtrail.scratch import shuffle_width

# Executors receive these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# (states, key columns) -> fewer rows with the same columns, at best one per key; should be
# vectorized over the keys
Combine = Callable[[pd.DataFrame, list[str]], pd.DataFrame]


def _same_key(states: pd.DataFrame, keys: list[str], row: pd.Series) -> pd.Series:
    same = pd.Series(True, states.index)
    for k in keys:
        value = row[k]
        missing = value is None or value is pd.NaT or value != value
        same &= states[k].isna() if missing else states[k] == value
    return same


def combine_sorted(batches: Iterator[pd.DataFrame], combine: Combine, keys: list[str], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Combine the states of a partition sorted by key; holds one batch and the open key's states."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        last = batch.iloc[-1]
        batch = batch[columns]
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        out = combine(batch, keys)[columns]
        is_open = _same_key(out, keys, last)
        held = out[is_open]
        yield out[~is_open]
    if held is not None:
        yield held


def fold(rows: DataFrame, keys: list[str], state: dict[str, Column], combine: Combine) -> DataFrame:
    """The combined state of every key: columns ``keys`` and those of ``state``."""
    states = rows.select(*[col(k) for k in keys], *[e.alias(n) for n, e in state.items()])
    schema, columns = states.schema, states.columns

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield combine(batch, keys)[columns]

    def per_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return combine_sorted(batches, combine, keys, columns)

    by_key = [col(k) for k in keys]
    width = shuffle_width(rows.sparkSession)
    partial = states.mapInPandas(per_batch, schema)
    sliced = partial.withColumn("__slice", F.spark_partition_id() % F.lit(max(2, width)))
    merged = sliced.repartition(width, *by_key, "__slice").sortWithinPartitions(*by_key).mapInPandas(per_key, schema)
    return merged.repartition(width, *by_key).sortWithinPartitions(*by_key).mapInPandas(per_key, schema)


def moments_of(value: Column) -> dict[str, Column]:
    """The state of one row for :func:`combine_moments`."""
    return {"n": F.when(value.isNull(), 0).otherwise(1).cast("bigint"), "mean": F.coalesce(value, F.lit(0.0)), "m2": F.lit(0.0)}


def combine_moments(states: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Combine (n, mean, m2) states: count, mean and sum of squared deviations.

    A null value is the state (0, 0, 0), see :func:`moments_of`; without any value all three are 0.
    """
    weighted = states.assign(total=states["n"] * states["mean"])
    sums = weighted.groupby(keys, dropna=False)[["n", "total"]].transform("sum")
    shift = (states["mean"] - sums["total"] / sums["n"].where(sums["n"] > 0)).fillna(0.0)
    spread = states.assign(total=weighted["total"], m2=states["m2"] + states["n"] * shift * shift)
    out = spread.groupby(keys, dropna=False, as_index=False)[["n", "total", "m2"]].sum()
    return out.assign(mean=out["total"] / out["n"].clip(lower=1))
