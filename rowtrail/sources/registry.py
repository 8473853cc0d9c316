"""Registered inputs: a name, a DataFrame and the columns that identify a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtrail.operators.frame import Tag, TracedFrame
from rowtrail.operators.keyed import col
from rowtrail.scratch import materialize
from rowtrail.sources.ids import with_position

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True, eq=False)
class Source:
    name: str
    df: DataFrame
    keys: tuple[str, ...]

    @property
    def scalar_id(self) -> bool:
        return len(self.keys) == 1

    def row_id(self) -> Column:
        """The key itself, or a struct of the key columns (exact, no hashing)."""
        return col(self.keys[0]) if self.scalar_id else F.struct(*[col(k) for k in self.keys])

    def integral_id(self) -> bool:
        return self.scalar_id and isinstance(self.df.schema[self.keys[0]].dataType, _INTEGRAL)


class TraceContext:
    """Creates traced frames and remembers their sources by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Source] = {}
        self._origins = 0
        self._dictionaries: dict[str, DataFrame] = {}

    def id_dictionary(self, name: str) -> DataFrame:
        """The ids of a source numbered from 0 in their order: its key columns and ``id_no``, written once.

        Contiguous numbers make composite and text ids fit for bitmaps.
        """
        if name not in self._dictionaries:
            source = self.sources[name]
            ids = source.df.select(*[col(k) for k in source.keys]).distinct()
            self._dictionaries[name] = materialize(with_position(ids, list(source.keys), "id_no"), "id-dictionary")
        return self._dictionaries[name]

    def origin_column(self) -> str:
        self._origins += 1
        return f"__id{self._origins}"

    def source(self, name: str, df: DataFrame, keys: str | list[str] | None = None,
               column_lineage: bool = False) -> TracedFrame:
        """Register ``df``.  ``keys`` must identify its rows.

        Without keys each row gets a unique number, and the numbered table is written once (no
        shuffle), because a recomputed number could change.  Tables read with
        ``readers.read_parquet_rows`` have stable keys without that copy.
        """
        if name in self.sources:
            raise ValueError(f"source {name!r} is registered already")
        if keys is None:
            df, keys = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "numbered"), ["__row"]
        keys = [keys] if isinstance(keys, str) else list(keys)
        registered = Source(name, df, tuple(keys))
        self.sources[name] = registered
        id_column = self.origin_column()
        visible = [c for c in df.columns if c != "__row"]
        return TracedFrame(self, df.withColumn(id_column, registered.row_id()), visible,
                           {id_column: registered}, {c: frozenset({Tag(id_column)}) for c in visible},
                           unique=True, column_lineage=column_lineage, name=name)
