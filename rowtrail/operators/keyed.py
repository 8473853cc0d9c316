"""Keyed joins used by lineage: null-safe, and safe for keys that hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtrail.scratch import materialize, shuffle_width

# A key is hot when it holds at least 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 256
# Up to this many rows per key and map task, one reducer per key is enough (see first_rows).
ONE_ROUND_ROWS = 32


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                   right_keys: list[str] | None = None) -> DataFrame:
    """Equi-join where a null key matches a null key; the right key columns are dropped."""
    right_keys = right_keys or keys
    alias = {k: f"__rk{i}" for i, k in enumerate(right_keys)}
    renamed = right.select(*[col(c).alias(alias.get(c, c)) for c in right.columns])
    condition = reduce(lambda a, b: a & b,
                       [col(l).eqNullSafe(col(alias[r])) for l, r in zip(keys, right_keys)])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*alias.values())


def group_stats(rows: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """One row per key: the given aggregates and the group size ``__n`` (map-side combined)."""
    aggregated = rows.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__n"), *[e.alias(n) for n, e in stats.items()])
    return materialize(aggregated, "group-stats")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst broadcasts ``df`` by its estimated bytes; for a stored table, its file sizes."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def attach_stats(rows: DataFrame, stats: DataFrame, keys: list[str],
                 spread_by: list[str]) -> DataFrame:
    """Give every row the statistics of its group, without moving a group into one task.

    ``stats`` is a stored table from :func:`group_stats`.  One that Catalyst broadcasts by its bytes
    is left to it, so the rows are not shuffled.  Beyond that bound both sides are shuffled on (key, salt); only hot keys get
    more than one salt, so the statistics grow by at most HOT_SHARE * salts rows.
    """
    if fits_broadcast(stats):
        return null_safe_join(rows, stats, keys)
    salts = max(2, shuffle_width(rows.sparkSession))
    total = stats.agg(F.sum("__n")).scalar()
    is_hot = col("__n") >= F.greatest(F.lit(2), F.floor(total / HOT_SHARE))
    hot = stats.where(is_hot).select(*[col(k) for k in keys], F.lit(True).alias("__hot"))
    salted_rows = null_safe_join(rows, F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.when(col("__hot"), F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.lit(salts)))
        .otherwise(F.lit(0)).cast("int")).drop("__hot")
    salted_stats = stats.withColumn(
        "__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1)))
                            .otherwise(F.array(F.lit(0)))))
    return null_safe_join(salted_rows, salted_stats, [*keys, "__salt"]).drop("__salt")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    The rank is pruned before the shuffle (WindowGroupLimit), so a reducer receives at most ``n``
    rows of a key per map task, however large the group is.  For small ``n`` that is one shuffle
    of few rows.  For larger ``n`` the survivors of a hot key could still be many, so they are
    ranked per (key, slice of input partitions) first: the last task sees n rows per slice.
    """
    by_key = [col(k) for k in keys]
    survivors = rows
    pruned_up_to = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > min(ONE_ROUND_ROWS, pruned_up_to):
        slices = max(2, shuffle_width(rows.sparkSession))
        sliced = rows.withColumn("__slice", F.spark_partition_id() % F.lit(slices))
        local = Window.partitionBy(*by_key, "__slice").orderBy(*order)
        survivors = (sliced.withColumn("__rn", F.row_number().over(local)).where(col("__rn") <= n)
                     .drop("__slice", "__rn"))
    final = Window.partitionBy(*by_key).orderBy(*order)
    return survivors.withColumn("__rn", F.row_number().over(final)).where(col("__rn") <= n).drop("__rn")
