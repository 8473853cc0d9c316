"""Scoring that leaves the source where it is, numbered ids, sorted folds and one-pass extremes."""

import re
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowtrail import aggregates as agg
from rowtrail.operators.folds import combine_moments, combine_sorted, moments_of
from rowtrail.operators.influence import All, Bottom, Max, Min, Procedural, SequentialOutlier, Top, Union, Where
from rowtrail.operators.provenance import (bitmap_contains, bitmap_semi_join, bitmap_size, id_bitmaps, number_ids,
                                           provenance_bitmap)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_scans(df, column):
    """Scans of tables with ``column`` below a shuffle by key, with the text of the plan between the two."""
    lines = str(df._jdf.queryExecution().executedPlan().toString()).splitlines()
    depth = [len(re.match(r"[\s:|]*(?:[+:]- )?", line)[0]) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                if "FileScan" in lines[j] and f"{column}#" in lines[j]:
                    found.append("\n".join(lines[i:j + 1]))
    return found


@pytest.fixture
def readings(spark, tmp_path):
    df = spark.range(50_000).select("id", (F.col("id") % 20).alias("k"), (F.col("id") % 997 + 0.5).alias("reading"))
    df.write.parquet(str(tmp_path / "readings"))
    return spark.read.parquet(str(tmp_path / "readings"))


def test_scoring_shuffles_faults_only(ctx, readings, no_broadcast):
    out = ctx.source("readings", readings, "id").group_agg("k", {"s": agg.total("reading")}, All())
    trace = out.trace(F.col("k") < 10)
    fault = F.col("reading") > 990
    scores = trace.metrics(fault, count_outputs=False)
    assert all(re.search(r"Filter .*reading", text) for text in shuffled_scans(scores, "reading"))
    row = scores.first()
    expected = [(i, i % 20 < 10, i % 997 + 0.5 > 990) for i in range(50_000)]
    assert row["input_count"] == 50_000 and row["trace_count"] == 25_000
    assert row["fault_count"] == sum(f for _, _, f in expected) and row["correct_count"] == sum(t and f for _, t, f in expected)
    diff = trace.diff(fault)
    assert all(re.search(r"Filter .*reading", text) for text in shuffled_scans(diff, "reading"))
    assert {(r["kind"], r["id"]) for r in diff.select("kind", "id").collect()} == {
        ("untraced_fault" if f else "false_trace", i) for i, t, f in expected if t != f}


def test_rows_by_bitmap_and_by_join_agree(ctx, readings, no_broadcast):
    out = ctx.source("readings", readings, "id").group_agg("k", {"s": agg.total("reading")}, Top(300))
    trace = out.trace(F.col("k") == 3)
    found = trace.rows()
    assert not shuffled_scans(found, "reading")
    joined = out.trace(F.col("k") == 3)
    joined.bitmap_limit = 0
    other = joined.rows()
    assert shuffled_scans(other, "reading")
    assert found.columns == readings.columns and sorted(found.collect()) == sorted(other.collect()) and found.count() == 300


def test_bitmap_semi_join_of_any_integer(spark):
    ids = [-40_000, -1, 0, 7, 8, 32_767, 32_768, 2 ** 40]
    rows = spark.createDataFrame([(i + d,) for i in ids for d in (-1, 0, 1)] + [(None,)], "id long").distinct()
    found = bitmap_semi_join(rows, "id", id_bitmaps(spark.createDataFrame([(i,) for i in ids], "id long"), "id"))
    assert sorted(r["id"] for r in found.collect()) == sorted(ids)


def test_bitmaps_of_text_and_composite_ids(ctx, spark):
    df = spark.createDataFrame([("x", None, "a", 1.0), ("x", 1, "a", 2.0), ("y", 1, "b", 3.0), ("é", 2, "b", 4.0)], "p string, q int, k string, v double")
    two = ctx.source("two", df, ["p", "q"])
    numbers = ctx.id_dictionary("two")
    assert sorted(r["id_no"] for r in numbers.collect()) == [0, 1, 2, 3] and ctx.id_dictionary("two") is numbers

    def sets(least):
        edges = two.group_agg("k", {"s": agg.total("v")}, Where(lambda v: v >= least)).edges()
        return provenance_bitmap(number_ids(edges, numbers, ["p", "q"]), ["k"])

    assert {r["k"]: r["ids"] for r in bitmap_size(sets(0), ["k"]).collect()} == {"a": 2, "b": 2}
    inside = {r["k"]: r["contained"] for r in bitmap_contains(sets(2), sets(0), ["k"]).collect()}
    assert inside == {"a": False, "b": True}
    assert {r["k"]: r["contained"] for r in bitmap_contains(sets(0), sets(4), ["k"]).collect()} == {"b": True}
    text = ctx.source("text", df.dropDuplicates(["p"]).select("p", "k"), "p")
    edges = number_ids(text.group_agg("k", {"n": agg.rows()}).edges(), ctx.id_dictionary("text"), ["p"])
    assert sorted(r["rid"] for r in edges.collect()) == [0, 1, 2]


def test_many_keys_and_a_hot_one(spark, ctx):
    """100,000 keys and one with half of the rows; a key is combined batch by batch, never gathered."""
    df = spark.range(400_000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 100_000).alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    out = ctx.source("t", df, "id").fold_agg("k", moments_of(F.col("v")), combine_moments, {"n": F.col("n"), "mean": F.col("mean")}, uses=["v"]).df
    assert out.count() == 50_001
    hot = out.where("k = -1").first()
    assert hot["n"] == 200_000 and abs(hot["mean"] - 4.0) < 1e-9
    assert out.where("k <> -1 and n <> 4").isEmpty()


def test_sorted_states_are_combined_across_batches():
    calls = []

    def largest(states, keys):
        calls.append(len(states))
        return states.groupby(keys, dropna=False, as_index=False)["v"].max()

    rows = [(None, 1), (None, 5)] + [("a", i) for i in range(7)] + [("b", 3), ("c", 2), ("c", 9)]
    for size in (1, 2, 3, 5, 20):
        batches = [pd.DataFrame(rows[i:i + size], columns=["k", "v"]) for i in range(0, len(rows), size)]
        calls.clear()
        out = pd.concat(list(combine_sorted(iter([pd.DataFrame(columns=["k", "v"]), *batches]), largest, ["k"], ["k", "v"])))
        assert sorted(("" if k is None or k != k else k, v) for k, v in out.itertuples(index=False)) == [("", 5), ("a", 6), ("b", 3), ("c", 9)]
        assert len(calls) == len(batches) and max(calls) <= size + 1


def test_procedural_influence_keeps_several_rows(ctx, spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    two = Procedural(lambda rows, keys: rows.sort_values("value").groupby(keys).tail(2))
    out = ctx.source("t", df, "id").group_agg("k", {"s": agg.total("v")}, two)
    assert sorted(r["rid"] for r in out.edges().collect()) == [2994, 2995, 2996, 2997, 2998, 2999]


def test_extremes_in_one_pass(ctx, spark):
    """Smallest and largest value with their rows from one partial aggregate, ties by id on either side."""
    nan = float("nan")
    rows = [(1, "a", 5.0), (2, "a", 5.0), (3, "a", -1.0), (4, "a", -1.0), (5, "b", 2.0), (6, "c", None), (7, "c", nan), (8, None, 0.0), (9, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    frame = ctx.source("t", df, "id")

    def kept(*parts):
        edges = frame.group_agg("k", {"d": agg.spread("v")}, Union(*parts)).edges()
        assert str(edges._jdf.queryExecution().executedPlan().toString()).count("Exchange") == 1
        return sorted(r["rid"] for r in edges.collect())

    assert kept(Min(), Max()) == [1, 3, 5, 8, 9] and kept(Min("last"), Max("last")) == [2, 4, 5, 8, 9] and kept(Max("last"), Max()) == [1, 2, 5, 9]
    several = frame.group_agg("k", {"d": agg.spread("v")}, Union(Top(2), Bottom(1))).edges()
    assert sorted(r["rid"] for r in several.collect()) == [1, 2, 3, 5, 8, 9]


def test_sizes_come_with_the_aggregate(ctx, spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "b c b")], "id int, text string")
    words = ctx.source("t", df, "id").explode("w", F.split("text", " ")).group_agg("w", {"n": agg.rows()})
    sized = words.with_provenance_size()
    assert sorted(sized.collect()) == [("a", 2, 1), ("b", 4, 3), ("c", 1, 1)]
    assert "Join" not in str(sized._jdf.queryExecution().executedPlan().toString())
    top = ctx.source("u", df, "id").explode("w", F.split("text", " ")).with_columns({"v": F.lit(1.0)}).group_agg("w", {"n": agg.total("v")}, Max())
    assert sorted(top.with_provenance_size("sources").select("w", "sources").collect()) == [("a", 1), ("b", 1), ("c", 1)]
    with pytest.raises(ValueError):
        ctx.source("v", df, "id").with_provenance_size()


@pytest.mark.parametrize("chunk_rows", [7, 60, 10_000])
def test_outliers_by_arrival(ctx, spark, chunk_rows):
    """The order of arrival decides, whatever the ids; any number of chunks gives the same rows."""
    rows = [(i, "k" if i % 5 else "m", (i * 37) % 400, float((i * 7919) % 10) + (500.0 if i in (15, 203, 391) else 0.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, at int, v double")
    out = ctx.source(f"t{chunk_rows}", df, "id").group_agg("k", {"s": agg.total("v")}, SequentialOutlier(warmup=10, order=("at",), chunk_rows=chunk_rows))
    expected = set()
    for key in "km":
        own = sorted((at, i, v) for i, k, at, v in rows if k == key)
        values = [v for *_, v in own]
        mean, sd = statistics.fmean(values), statistics.pstdev(values)
        for n, (_, i, v) in enumerate(own):
            before = values[:n]
            stood = n < 10 or (abs(v - statistics.fmean(before)) / statistics.pstdev(before) >= 3 if len(set(before)) > 1 else v != before[0])
            if stood and abs(v - mean) / sd >= 3:
                expected.add(i)
    assert {r["rid"] for r in out.edges().collect()} == expected and expected


def test_names_that_lineage_needs(ctx, spark):
    """A clash with a column of the lineage itself is refused, not answered wrongly."""
    df = spark.createDataFrame([(1, "a", 1.0)], "id int, src string, v double")
    frame = ctx.source("t", df, "id")
    with pytest.raises(ValueError, match="src"):
        frame.group_agg("src", {"s": agg.total("v")}).edges()
    assert frame.group_agg("src", {"s": agg.total("v")}).trace(F.col("src") == "a").ids().count() == 1
    renamed = frame.select("v", value=F.col("src"))
    with pytest.raises(ValueError, match="value"):
        renamed.group_agg("value", {"s": agg.total("v")}, Procedural(lambda rows, keys: rows)).edges()
