"""Registry of the named queries: each runs over whole tables and has, where possible, the same
query in plain SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtrail.operators.frame import TracedFrame
from rowtrail.sources.registry import TraceContext

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} exists")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def add(name: str, fn: Query, sql: str | None = None) -> None:
    query(sql, name)(fn)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, column_lineage: bool = False) -> TracedFrame:
    return TraceContext(spark).source("events", table(spark, sf_dir, "events"), "event_id", column_lineage)


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
