"""Influence operators: which rows of a group explain its aggregate.

Each operator turns the keyed input rows into the kept ones, as a relational filter or rank.
``keep`` gets the rows, the key columns, the value expression and the id columns (the
tie-break, so results do not depend on partitioning); its result has at least the key and id
columns.  Null and NaN values never rank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowtrail.operators.keyed import attach_stats, col, first_rows, group_stats, null_safe_join
from rowtrail.scratch import materialize
from rowtrail.sources.ids import ordered_chunks

_V = "__v"


def _with_value(rows: DataFrame, value: Column) -> DataFrame:
    """Rows with the ranked value in ``__v``; rows without a usable value are left out."""
    valued = rows.withColumn(_V, value).where(col(_V).isNotNull())
    if isinstance(valued.schema[_V].dataType, (T.DoubleType, T.FloatType)):
        valued = valued.where(~F.isnan(_V))
    return valued


class Influence:
    def keep(self, rows: DataFrame, keys: list[str], value: Column, ids: list[str]) -> DataFrame:
        raise NotImplementedError

    def inverted(self) -> "Influence":
        raise ValueError(f"{type(self).__name__} has no opposite")


@dataclass(frozen=True)
class All(Influence):
    """Every row of the group."""

    def keep(self, rows, keys, value, ids):
        return rows


@dataclass(frozen=True)
class Top(Influence):
    """The ``n`` largest values; ``tie`` picks the earlier or later id among equals."""

    n: int
    tie: str = "first"
    largest = True

    def keep(self, rows, keys, value, ids):
        tie = [col(i).asc() if self.tie == "first" else col(i).desc() for i in ids]
        order = [col(_V).desc() if self.largest else col(_V).asc(), *tie]
        return first_rows(_with_value(rows, value), keys, order, self.n).drop(_V)

    def inverted(self):
        return Bottom(self.n, self.tie)


@dataclass(frozen=True)
class Bottom(Top):
    """The ``n`` smallest values."""

    largest = False

    def inverted(self):
        return Top(self.n, self.tie)


def Max(tie: str = "first") -> Top:
    """One row that holds the maximum."""
    return Top(1, tie)


def Min(tie: str = "first") -> Bottom:
    """One row that holds the minimum."""
    return Bottom(1, tie)


@dataclass(frozen=True)
class Ties(Influence):
    """All rows that hold the maximum (or minimum) of their group.

    The extreme is a partial aggregate joined back, so a group with many ties stays spread.
    """

    largest: bool = True

    def keep(self, rows, keys, value, ids):
        valued = _with_value(rows, value)
        extreme = F.max(_V) if self.largest else F.min(_V)
        stats = group_stats(valued, keys, {"__extreme": extreme})
        joined = attach_stats(valued, stats, keys, ids)
        return joined.where(col(_V) == col("__extreme")).select(*[col(c) for c in rows.columns])

    def inverted(self):
        return Ties(not self.largest)


def MaxTies() -> Ties:
    return Ties(True)


def MinTies() -> Ties:
    return Ties(False)


@dataclass(frozen=True)
class Where(Influence):
    """Rows whose value passes the predicate."""

    predicate: Callable[[Column], Column]

    def keep(self, rows, keys, value, ids):
        return rows.where(self.predicate(value))


@dataclass(frozen=True)
class Converted(Influence):
    """The inner operator applied to ``convert(value)``."""

    convert: Callable[[Column], Column]
    inner: Influence

    def keep(self, rows, keys, value, ids):
        return self.inner.keep(rows, keys, self.convert(value), ids)

    def inverted(self):
        return replace(self, inner=self.inner.inverted())


def AbsTop(n: int) -> Converted:
    """The ``n`` values of largest magnitude."""
    return Converted(F.abs, Top(n))


@dataclass(frozen=True)
class Union(Influence):
    """Rows kept by any of the operators."""

    parts: tuple[Influence, ...]

    def __init__(self, *parts: Influence):
        object.__setattr__(self, "parts", tuple(parts))

    def _extremes(self) -> bool:
        return all(type(part) in (Top, Bottom) and part.n == 1 for part in self.parts)

    def _one_pass(self, rows, keys, value, ids):
        """One partial aggregate that keeps a row per part: the extreme value, of equal ones the wanted id."""
        valued = _with_value(rows, value)
        row = F.struct(*[col(i) for i in ids])
        buffers = []
        for part in self.parts:
            # the order of (value, ids), with the value turned round where value and ids go opposite ways
            upwards = part.largest == (part.tie == "last")
            ranked = F.struct((col(_V) if upwards else -col(_V)).alias("v"), row.alias("ids"))
            buffers.append((F.max if part.tie == "last" else F.min)(ranked).getField("ids"))
        kept = valued.groupBy(*[col(k) for k in keys]).agg(F.array_distinct(F.array(*buffers)).alias("__rows"))
        return kept.select(*[col(k) for k in keys], F.explode("__rows").alias("__row")).select(
            *[col(k) for k in keys], *[col("__row").getField(i).alias(i) for i in ids])

    def keep(self, rows, keys, value, ids):
        needed = [col(c) for c in [*keys, *ids]]
        kind = rows.select(value.alias(_V)).schema[_V].dataType
        if self._extremes() and isinstance(kind, (T.DoubleType, T.FloatType)) and not set(keys) & set(ids):
            return self._one_pass(rows, keys, value, ids).select(*needed)
        kept = self.parts[0].keep(rows, keys, value, ids).select(*needed)
        for part in self.parts[1:]:
            kept = kept.unionByName(part.keep(rows, keys, value, ids).select(*needed))
        return kept.distinct()

    def inverted(self):
        return Union(*[part.inverted() for part in self.parts])


# A score this close (relatively) to the threshold counts as reaching it: a mean and a deviation
# carry rounding errors that depend on the order of summation, the kept rows must not.
Z_SLACK = 1e-9


def _is_far(value: Column, mean: Column, deviation: Column, z: float) -> Column:
    return F.abs(value - mean) / deviation >= F.lit(z * (1 - Z_SLACK))


@dataclass(frozen=True)
class Outlier(Influence):
    """Rows at least ``z`` population standard deviations from their group's mean (exact).

    One partial aggregate per group, joined back and filtered; a group with zero spread has none.
    """

    z: float = 3.0

    def keep(self, rows, keys, value, ids):
        valued = _with_value(rows, value.cast("double"))
        stats = group_stats(valued, keys, {"__mean": F.avg(_V), "__sd": F.stddev_pop(_V),
                                           "__lo": F.min(_V), "__hi": F.max(_V)})
        joined = attach_stats(valued, stats.where((col("__lo") < col("__hi")) & (col("__sd") > 0)),
                              keys, ids)
        return (joined.where(_is_far(col(_V), col("__mean"), col("__sd"), self.z))
                .select(*[col(c) for c in rows.columns]))


@dataclass(frozen=True)
class SequentialOutlier(Influence):
    """One-pass outliers: rows that stood out from the rows before them (or are among the first
    ``warmup``) and that still stand out from the whole group.  "Before" is the order of the columns
    ``order`` (nulls first), then of the ids.

    A group is not run through in one task.  Rows are range-partitioned on (key, order, id) into chunks
    of about ``chunk_rows`` rows;
    a group that spans chunks contains the first row of a chunk, so there are at most as many such
    groups as chunks.  Only these need statistics from other chunks: a summary of at most two rows
    per chunk, which is broadcast.  Everything else is a window within (key, chunk).  Deviations
    are taken from the group mean, which keeps the running sums stable.
    """

    z: float = 3.0
    warmup: int = 100
    order: tuple[str, ...] = ()
    chunk_rows: int = 250_000

    def keep(self, rows, keys, value, ids):
        ks, v = [col(k) for k in keys], col(_V)
        needed = [col(c) for c in [*keys, *ids]]
        turns = {f"__turn{i}": col(c) for i, c in enumerate(self.order)}
        narrow = _with_value(rows, value.cast("double")).select(*needed, *[c.alias(n) for n, c in turns.items()], _V)
        chunks = max(1, -(-narrow.count() // self.chunk_rows))
        chunked = ordered_chunks(narrow, [*keys, *turns, *ids], chunks)
        joined = null_safe_join(chunked, F.broadcast(self._spanning(chunked, keys)), [*keys, "__chunk"], "left")

        inside = Window.partitionBy(*ks, "__chunk").orderBy("__slot")
        all_rows = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        prior = inside.rowsBetween(Window.unboundedPreceding, -1)
        d = v - col("__mean")
        zero = F.lit(0.0)
        ran = (joined
               .withColumns({"__mean": F.coalesce(col("__mean"), F.avg(_V).over(all_rows)),
                             "__sd": F.coalesce(col("__sd"), F.stddev_pop(_V).over(all_rows)),
                             "__lo": F.coalesce(col("__lo"), F.min(_V).over(all_rows)),
                             "__hi": F.coalesce(col("__hi"), F.max(_V).over(all_rows)),
                             "__pn": F.coalesce(col("__n0"), F.lit(0)) + F.count(_V).over(prior),
                             "__plo": F.least(col("__lo0"), F.min(_V).over(prior)),
                             "__phi": F.greatest(col("__hi0"), F.max(_V).over(prior))})
               .withColumns({"__pd": F.coalesce(col("__d0"), zero) + F.coalesce(F.sum(d).over(prior), zero),
                             "__pq": F.coalesce(col("__q0"), zero) + F.coalesce(F.sum(d * d).over(prior), zero)})
               .withColumns({"__pd": F.try_divide(col("__pd"), col("__pn")),
                             "__pq": F.try_divide(col("__pq"), col("__pn"))})
               .where((col("__lo") < col("__hi")) & (col("__sd") > 0)))
        prior_sd = F.sqrt(F.greatest(col("__pq") - col("__pd") * col("__pd"), F.lit(0.0)))
        prior_mean = col("__mean") + col("__pd")
        # with equal prior values any other value is infinitely far away
        stood_out = F.when(col("__plo") == col("__phi"), v != col("__plo")).otherwise(
            (prior_sd > 0) & (F.try_divide(F.abs(v - prior_mean), prior_sd) >= F.lit(self.z * (1 - Z_SLACK))))
        on_arrival = (col("__pn") < self.warmup) | stood_out
        return ran.where(_is_far(v, col("__mean"), col("__sd"), self.z) & on_arrival).select(*needed)

    @staticmethod
    def _spanning(chunked: DataFrame, keys: list[str]) -> DataFrame:
        """Per (key, chunk) of the groups that may span chunks: statistics of the whole group and
        of its earlier chunks."""
        ks = [col(k) for k in keys]
        heads = chunked.where(col("__slot") == 0).select(*ks).distinct()
        partial = null_safe_join(chunked, F.broadcast(heads), keys, "left_semi").groupBy(*ks, "__chunk").agg(
            F.count(F.lit(1)).alias("__n"), F.avg(_V).alias("__a"), F.var_pop(_V).alias("__s"),
            F.min(_V).alias("__l"), F.max(_V).alias("__h"))
        whole = Window.partitionBy(*ks)
        before = whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        n, shift = col("__n"), col("__a") - col("__mean")
        summary = (
            partial.withColumn("__total", F.sum("__n").over(whole))
            .withColumn("__mean", F.sum(n * col("__a")).over(whole) / col("__total"))
            .withColumn("__sq", n * (col("__s") + shift * shift))
            .withColumn("__sd", F.sqrt(F.sum("__sq").over(whole) / col("__total")))
            .withColumn("__lo", F.min("__l").over(whole)).withColumn("__hi", F.max("__h").over(whole))
            .withColumn("__n0", F.sum("__n").over(before)).withColumn("__d0", F.sum(n * shift).over(before))
            .withColumn("__q0", F.sum("__sq").over(before))
            .withColumn("__lo0", F.min("__l").over(before)).withColumn("__hi0", F.max("__h").over(before)))
        return materialize(summary.select(*ks, "__chunk", "__mean", "__sd", "__lo", "__hi", "__n0", "__d0", "__q0",
                                          "__lo0", "__hi0"), "summaries")


@dataclass(frozen=True)
class Custom(Influence):
    """A user-defined choice: ``fn(rows, keys, value, ids)`` returns the kept rows, same columns."""

    fn: Callable[[DataFrame, list[str], Column, list[str]], DataFrame]

    def keep(self, rows, keys, value, ids):
        return self.fn(rows, keys, value, ids).select(*[col(c) for c in rows.columns])


@dataclass(frozen=True)
class Procedural(Influence):
    """A choice written in pandas: ``prune(rows, keys)`` drops rows that cannot count.

    ``rows`` has the key and id columns and ``value``.  It is applied to parts of a group before
    the group (per batch, per slice of partitions), so it must not matter whether a row is dropped
    early: prune(prune(A) + prune(B)) = prune(A + B).
    """

    prune: Callable

    def keep(self, rows, keys, value, ids):
        from rowtrail.operators.folds import fold

        if "value" in (*keys, *ids):
            raise ValueError("prune sees the judged value as the column 'value': rename the key column of that name")
        state = {i: col(i) for i in ids} | {"value": value}
        return fold(rows, keys, state, self.prune).drop("value")
