"""Stable row positions without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rowtrail.operators.keyed import col
from rowtrail.scratch import materialize, shuffle_width

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def ordered_chunks(df: DataFrame, order_by: list[str], chunks: int | None = None) -> DataFrame:
    """Range-partition and sort ``df``; add ``__chunk`` (increasing along the order) and ``__slot``.

    The result is stored: range bounds come from sampling, so the chunk numbers must be fixed
    before two branches of a plan use them.
    """
    parts = chunks or shuffle_width(df.sparkSession)
    order = [col(c) for c in order_by]
    arranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = arranged.withColumn("__mid", F.monotonically_increasing_id())
    return materialize(
        marked.withColumn("__chunk", F.shiftrightunsigned("__mid", _SLOT_BITS).cast("int"))
        .withColumn("__slot", col("__mid").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))).drop("__mid"),
        "chunks")


def with_position(df: DataFrame, order_by: list[str], name: str = "pos",
                  chunks: int | None = None) -> DataFrame:
    """Add the contiguous 0-based position of each row in the order of ``order_by``.

    One range shuffle; the offset table has one row per chunk and is therefore safe to order in
    one task and to broadcast.
    """
    chunked = ordered_chunks(df, order_by, chunks)
    sizes = chunked.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__chunk", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    return (chunked.join(F.broadcast(offsets), "__chunk")
            .withColumn(name, col("__base") + col("__slot")).drop("__base", "__slot", "__chunk"))


def split_equal(positioned: DataFrame, parts: int, total: int, pos: str = "pos",
                name: str = "part") -> DataFrame:
    """Sequential split into ``parts`` runs of (nearly) equal length."""
    return positioned.withColumn(name, F.expr(f"`{pos}` * {parts} div {total}").cast("int"))


def split_weighted(positioned: DataFrame, weights: list[float], total: int, pos: str = "pos",
                   name: str = "part") -> DataFrame:
    """Sequential split where run j covers its share ``weights[j] / sum(weights)`` of the rows."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    whole, bounds, reached = float(sum(weights)), [], 0.0
    for weight in weights[:-1]:
        reached += weight / whole
        bounds.append(reached)
    share = col(pos) / F.lit(float(total))
    part = F.lit(0)
    for bound in bounds:
        part = part + F.when(share >= F.lit(bound), 1).otherwise(0)
    return positioned.withColumn(name, part.cast("int"))
