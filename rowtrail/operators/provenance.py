"""Sizes, bitmaps and containment of id sets held as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtrail.operators.keyed import col, null_safe_join
from rowtrail.operators.lineage import RID


#: Bytes of one bitmap, and the ids it covers.
BITMAP_BYTES, BITMAP_IDS = 4096, 8 * 4096


def _pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (key, input row) pairs.  Edges are distinct as they come, so only dropping one of
    their columns calls for another pass."""
    wanted = [*keys, "src", RID]
    pairs = edges.select(*[col(c) for c in wanted])
    return pairs if set(wanted) == set(edges.columns) else pairs.distinct()


def provenance_size(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Number of distinct input ids per output."""
    return _pairs(edges, keys).groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("ids"))


def provenance_bitmap(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Id sets in compact form: one bitmap per (key, source, bucket of ids).  Needs integral ids; for
    others see :func:`number_ids`.

    A bucket covers a fixed range of ids, so a large set is many small rows, never one big value.
    """
    bucketed = edges.select(*[col(k) for k in keys], "src", F.bitmap_bucket_number(RID).alias("bucket"),
                            F.bitmap_bit_position(RID).alias("__bit"))
    return (bucketed.groupBy(*[col(k) for k in keys], "src", "bucket")
            .agg(F.bitmap_construct_agg("__bit").alias("bits")))


def bitmap_union(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the sets of several outputs: bitwise OR per bucket."""
    return bitmaps.groupBy(*[col(k) for k in keys], "src", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_size(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    return bitmaps.groupBy(*[col(k) for k in keys]).agg(F.sum(F.bitmap_count("bits")).alias("ids"))


def bitmap_contains(larger: DataFrame, smaller: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of ``smaller``: does ``larger`` hold all of its ids?  Compares bucket by bucket."""
    sides = [d.select(*[col(k) for k in keys], "src", "bucket", "bits", F.lit(flag).alias("__large"))
             for d, flag in ((larger, True), (smaller, False))]
    buckets = sides[0].unionByName(sides[1]).groupBy(*[col(k) for k in keys], "src", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("__all"),
        F.coalesce(F.sum(F.when(col("__large"), F.bitmap_count("bits"))), F.lit(0)).alias("__own"),
        F.some(~col("__large")).alias("__asked"))
    return buckets.where("__asked").groupBy(*[col(k) for k in keys]).agg(F.every(col("__all") == col("__own")).alias("contained"))


def number_ids(edges: DataFrame, dictionary: DataFrame, id_columns: list[str]) -> DataFrame:
    """Edges of one source with the numbers of its ids in place of composite or text ids.

    ``dictionary`` comes from ``TraceContext.id_dictionary``: a table of the id columns and their
    number ``id_no``.  Both sides are shuffled by id, unless the dictionary is small.
    """
    if len(id_columns) == 1:
        parts = edges.withColumn("__i0", col(RID))
    else:
        parts = edges.withColumns({f"__i{i}": col(RID).getField(c) for i, c in enumerate(id_columns)})
    names = [f"__i{i}" for i in range(len(id_columns))]
    joined = null_safe_join(parts, dictionary, names, "inner", id_columns)
    return joined.withColumn(RID, col("id_no")).drop("id_no", *names)


def id_bitmaps(ids: DataFrame, key: str) -> DataFrame:
    """A table of integral ids as rows ``(bucket, bits)``."""
    return (ids.select(F.bitmap_bucket_number(key).alias("__bucket"), F.bitmap_bit_position(key).alias("__bit"))
            .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")))


def bitmap_semi_join(rows: DataFrame, key: str, bitmaps: DataFrame) -> DataFrame:
    """The rows whose id is in the bitmaps, which are sent to every task: ``rows`` stay where they are.

    The caller checks that there are few enough of them (``BITMAP_BYTES`` each).
    """
    position = F.bitmap_bit_position(key)
    octet = F.conv(F.hex(F.substring(col("__bits"), (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", octet.cast("long"), (position % 8).cast("int"))
    columns = [col(c) for c in rows.columns]
    return (rows.withColumn("__bucket", F.bitmap_bucket_number(key)).join(F.broadcast(bitmaps), "__bucket")
            .where(bit == 1).select(*columns))


def contains_all(larger: DataFrame, smaller: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of ``smaller``: does ``larger`` hold all of its ids?  Compares (key, id) pairs, so
    the work spreads over ids even when one key dominates."""
    pair = [*keys, "src", RID]
    known = _pairs(larger, keys).withColumn("__known", F.lit(True))
    checked = null_safe_join(_pairs(smaller, keys), known, pair, "left")
    return checked.groupBy(*[col(k) for k in keys]).agg(
        F.every(F.coalesce(col("__known"), F.lit(False))).alias("contained"))
