"""Hot keys, and the shape of physical plans."""

import pytest
from pyspark.sql import functions as F

from rowtrail import TraceContext, aggregates as agg
from rowtrail.operators.influence import Max, Outlier, Top
from rowtrail.operators.keyed import attach_stats, first_rows, group_stats
from rowtrail.plans.base import events
from rowtrail.sources.ids import ordered_chunks


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed(spark):
    """Two thirds of the rows have one key, the rest are almost all different; one key is null."""
    return spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") != 9, F.concat(F.lit("k"), F.col("id")))
        .alias("k"), (F.col("id") % 1000).cast("double").alias("v"))


@pytest.mark.parametrize("bound", ["-1", "64m"])
def test_stats_reach_every_row_with_and_without_broadcast(spark, skewed, bound):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tiny tables end in one task
    try:
        _stats_reach_every_row(skewed, bound)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _stats_reach_every_row(skewed, bound):
    stats = group_stats(skewed, ["k"], {"top": F.max("v")})
    joined = attach_stats(skewed, stats, ["k"], ["id"])
    assert joined.count() == 30_000 and joined.select("id").distinct().count() == 30_000
    assert joined.where("k = 'hot'").agg(F.min("top"), F.max("top"), F.max("__n")).first()[:] == (999.0, 999.0, 20_000)
    assert joined.where("k is null").first()["__n"] == 1
    assert ("BroadcastHashJoin" in physical(joined)) and (bound == "-1" or "SortMergeJoin" not in physical(joined))
    if bound == "-1":
        # the hot key is spread over several tasks
        tasks = joined.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1


@pytest.mark.parametrize("n, rounds", [(5, 1), (100, 2)])
def test_first_rows_of_a_hot_key(spark, skewed, n, rounds):
    got = first_rows(skewed.repartition(13), ["k"], [F.col("v").desc(), F.col("id")], n)
    hot = [r["id"] for r in got.where("k = 'hot'").orderBy("id").collect()]
    want = skewed.where("k = 'hot'").orderBy(F.col("v").desc(), "id").limit(n)
    assert hot == sorted(r["id"] for r in want.collect())
    assert physical(got).count("WindowGroupLimit") == 2 * rounds  # partial and final in each round


def test_ranks_are_sliced_when_spark_does_not_prune(spark, skewed):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "-1")
    try:
        got = first_rows(skewed, ["k"], [F.col("v").desc(), F.col("id")], 2)
        assert "__slice" in plan(got) and "WindowGroupLimit" not in physical(got)
        assert got.where("k = 'hot'").count() == 2
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_chunks_split_a_hot_key(spark, skewed):
    chunked = ordered_chunks(skewed.where("k = 'hot'"), ["k", "id"])
    sizes = [r["count"] for r in chunked.groupBy("__chunk").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * 20_000 / len(sizes)


def test_untraced_aggregate_carries_no_ids(spark, sf_dir):
    """The traced frame's result has the plan of the plain job: no id column is read."""
    text = physical(events(spark, sf_dir).group_agg("event_type", {"s": agg.total("value")}, Top(5)).df)
    assert "event_id" not in text and "ReadSchema: struct<event_type:string,value:double>" in text
    assert text.count("Exchange") == 1 and "HashAggregate" in text


def test_filters_reach_the_scan(spark, sf_dir):
    out = events(spark, sf_dir).where(F.col("value") > 100).group_agg("event_type", {"s": agg.total("value")}, Max())
    text = physical(out.edges())
    assert "GreaterThan(value,100.0)" in text and "props" not in text and "WindowGroupLimit" in text


def test_trace_broadcasts_its_targets(spark, sf_dir):
    out = events(spark, sf_dir).group_agg("event_type", {"s": agg.total("value")}, Outlier())
    text = physical(out.trace(F.col("event_type") == "click").rows())
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_file_position_identifies_rows(spark, tmp_path):
    from rowtrail.sources.readers import FILE_KEYS, read_parquet_rows

    path = str(tmp_path / "t")
    spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).repartition(4).write.parquet(path)
    frame = TraceContext(spark).source("t", read_parquet_rows(spark, path), FILE_KEYS).select("k", "v")
    out = frame.group_agg("k", {"s": agg.total("v")}, Top(2))
    assert sorted(r["v"] for r in out.trace(F.col("k") == 3).rows().collect()) == [990, 997]


def test_no_python_in_any_plan(spark, sf_dir):
    from rowtrail.plans.catalog import QUERIES

    for name in ("infl_outlier_seq", "trace_metrics", "col_topbottom_mean", "prov_bitmap"):
        text = physical(QUERIES[name](spark, sf_dir))
        assert "Python" not in text and "InPandas" not in text and "CartesianProduct" not in text


def test_work_tables_are_deleted_on_request():
    """In a session of its own work folder: clear() removes what the application wrote."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import tempfile, pathlib
from pyspark.sql import SparkSession
from rowtrail import scratch
root = tempfile.mkdtemp()
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", root).getOrCreate())
stored = scratch.materialize(spark.range(3), "t")
assert scratch.work_root(spark) == root and stored.count() == 3
assert list(pathlib.Path(root).rglob("*.parquet"))
scratch.clear(spark)
assert not list(pathlib.Path(root).rglob("*.parquet"))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1],
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
