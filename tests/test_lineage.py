"""Lineage through every kind of step, checked against ids worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rowtrail import aggregates as agg
from rowtrail.operators.influence import All, Bottom, Max, MaxTies, Outlier, SequentialOutlier, Top, Union
from rowtrail.operators.provenance import (bitmap_size, bitmap_union, contains_all, provenance_bitmap,
                                           provenance_size)


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [(1, "x", 10.0), (2, "x", 30.0), (3, "y", 5.0), (4, None, 7.0), (5, None, 9.0)],
        "id bigint, shop string, amount double")


def pairs(df, *columns):
    return sorted(((tuple(r[c] for c in columns)) for r in df.collect()), key=lambda t: [(v is None, v) for v in t])


def test_map_filter_explode_keep_ids(ctx, sales):
    frame = (ctx.source("sales", sales, "id").where(F.col("amount") > 6)
             .select("shop", double=F.col("amount") * 2)
             .explode("part", F.array(F.lit("p"), F.lit("q"))))
    assert pairs(frame.with_provenance().where("part = 'p'"), "double", "rid") == [
        (14.0, 4), (18.0, 5), (20.0, 1), (60.0, 2)]
    assert frame.count() == 8 and len(frame.take(3)) == 3 and frame.df.columns == ["shop", "double", "part"]


def test_repeated_parent_counts_once(ctx, sales):
    frame = ctx.source("sales", sales, "id").explode("k", F.array(F.lit("all"), F.lit("all")))
    out = frame.group_agg("k", {"n": agg.rows()})
    assert out.df.first()["n"] == 10
    assert pairs(out.edges(), "rid") == [(i,) for i in range(1, 6)]
    assert provenance_size(out.edges(), ["k"]).first()["ids"] == 5


def test_null_keys_are_a_group(ctx, sales):
    out = ctx.source("sales", sales, "id").group_agg("shop", {"s": agg.total("amount")})
    assert pairs(out.trace(F.col("shop").isNull()).ids(), "id") == [(4,), (5,)]
    assert pairs(out.edges(), "shop", "rid") == [("x", 1), ("x", 2), ("y", 3), (None, 4), (None, 5)]


def test_plain_result_is_the_plain_job(ctx, sales):
    traced = ctx.source("sales", sales, "id").group_agg("shop", {"s": agg.total("amount")}, Max()).df
    plain = sales.groupBy("shop").agg(F.sum("amount").alias("s"))
    assert traced.exceptAll(plain).isEmpty() and plain.exceptAll(traced).isEmpty()


def test_join_keeps_both_parents(ctx, spark, sales):
    shops = spark.createDataFrame([("s1", "x", "north"), ("s2", "y", "south")], "code string, shop string, area string")
    joined = ctx.source("sales", sales, "id").join(ctx.source("shops", shops, "code"), "shop")
    out = joined.group_agg("area", {"s": agg.total("amount")})
    assert out.sources() == ["sales", "shops"]
    trace = out.trace(F.col("area") == "north")
    assert pairs(trace.ids("sales"), "id") == [(1,), (2,)]
    assert pairs(trace.ids("shops"), "code") == [("s1",)]
    # ids of different types meet as text
    assert pairs(out.edges().where("area = 'north'"), "src", "rid") == [
        ("sales", "1"), ("sales", "2"), ("shops", "s1")]


def test_self_join(ctx, sales):
    left = ctx.source("sales", sales, "id")
    totals = left.group_agg("shop", {"s": agg.total("amount")})
    out = left.select("shop", "amount").join(totals, "shop").group_agg("shop", {"m": agg.largest("s")})
    assert pairs(out.trace(F.col("shop") == "x").ids(), "id") == [(1,), (2,)]
    twice = left.select("shop", "amount").join(left.select("shop", other=F.col("amount")), "shop")
    assert pairs(twice.where((F.col("amount") == 10) & (F.col("other") == 30)).edges(keep=["amount"]), "rid") == [(1,), (2,)]


def test_union_and_distinct(ctx, spark, sales):
    more = spark.createDataFrame([(1, "x", 10.0), (2, "z", 1.0)], "id bigint, shop string, amount double")
    both = ctx.source("old", sales, "id").union(ctx.source("new", more, "id"))
    shops = both.distinct(["shop"])
    assert pairs(shops.edges().where("shop in ('x', 'z')"), "shop", "src", "rid") == [
        ("x", "new", 1), ("x", "old", 1), ("x", "old", 2), ("z", "new", 2)]
    tr = shops.trace(F.col("shop") == "x")
    assert pairs(tr.rows("new"), "id", "amount") == [(1, 10.0)]
    # both halves of one source: a row kept by both counts once
    one = ctx.source("one", sales, "id")
    again = one.where(F.col("id") < 3).union(one.where(F.col("id") > 1)).group_agg("shop", {"n": agg.rows()})
    assert pairs(again.edges().where("shop = 'x'"), "rid") == [(1,), (2,)]


def test_having_and_overwritten_key(ctx, sales):
    out = ctx.source("sales", sales, "id").group_agg("shop", {"s": agg.total("amount")})
    assert pairs(out.where(F.col("s") > 10).edges(keep=["shop"]), "shop", "rid") == [
        ("x", 1), ("x", 2), (None, 4), (None, 5)]
    upper = out.with_columns({"shop": F.upper("shop")})
    assert pairs(upper.where("shop is not null").edges(keep=["shop"]), "shop", "rid") == [("X", 1), ("X", 2), ("Y", 3)]
    assert pairs(upper.edges(keep=["shop"]).where("shop = 'X'"), "rid") == [(1,), (2,)]


def test_two_levels_compose(ctx, spark):
    df = spark.createDataFrame([(i, i // 4, float(i % 4)) for i in range(24)], "id bigint, u bigint, v double")
    means = ctx.source("t", df, "id").group_agg("u", {"m": agg.average("v")}, Top(1), name="means")
    out = means.select("m", "u", half=F.col("u") % 2).group_agg("half", {"mm": agg.average("m")}, Bottom(2), value="u")
    # half 0 holds u = 0, 2, 4; the two smallest are 0 and 2; of each the largest v
    assert pairs(out.trace(F.col("half") == 0).ids(), "id") == [(3,), (11,)]
    assert pairs(out.edges().where("half = 0"), "rid") == [(3,), (11,)]
    counts = out.trace(F.col("half") == 0).stage_counts()
    assert [r["rows"] for r in counts.orderBy("stage").collect()] == [1, 2, 2]
    stored = means.stored().group_agg("u", {"x": agg.largest("m")})
    assert pairs(stored.trace(F.col("u") == 1).ids(), "id") == [(7,)]


def test_columns_have_their_own_lineage(ctx, sales):
    out = ctx.source("sales", sales, "id", column_lineage=True).group_agg(
        "shop", {"lo": agg.smallest("amount"), "hi": agg.largest("amount"), "s": agg.total("amount")})
    out = (out.derive("width", F.col("hi") - F.col("lo"), uses=["hi", "lo"])
           .derive_when("big", [(F.col("hi") > 20, F.lit("yes"))], F.lit("no"), uses=["hi"]))
    edges = out.edges(by_column=True).where("shop = 'x'")
    assert pairs(edges, "out_col", "rid") == [
        ("big", 2), ("hi", 2), ("lo", 1), ("s", 1), ("s", 2), ("width", 1), ("width", 2)]
    assert pairs(out.trace(F.col("shop") == "x", columns=["big"]).ids(), "id") == [(2,)]
    rules = [(F.col("s") > 30, ["lo"]), (F.col("s") < 10, ["hi"])]
    assert pairs(out.trace(F.lit(True), rules=rules).ids(), "id") == [(1,), (3,)]


def test_promotion_turns_row_lineage_into_column_lineage(ctx, sales):
    best = ctx.source("sales", sales, "id").group_agg("shop", {"m": agg.average("amount")}, Max())
    out = best.select("m", all=F.lit(1)).promote().group_agg("all", {"lo": agg.smallest("m"), "hi": agg.largest("m")})
    assert pairs(out.edges(by_column=True), "out_col", "rid") == [("hi", 2), ("lo", 3)]


def test_source_without_keys_gets_stored_numbers(ctx, sales):
    frame = ctx.source("sales", sales.select("shop", "amount"))
    out = frame.group_agg("shop", {"s": agg.total("amount")})
    assert "__row" not in frame.columns
    assert pairs(out.trace(F.col("shop") == "x").rows(), "amount") == [(10.0,), (30.0,)]


def test_composite_keys(ctx, spark):
    df = spark.createDataFrame([(1, 1, "a", 2.0), (1, 2, "a", 3.0), (2, 1, "b", 4.0)],
                               "o bigint, l int, k string, v double")
    out = ctx.source("t", df, ["o", "l"]).group_agg("k", {"s": agg.total("v")}, Max())
    assert pairs(out.trace(F.col("k") == "a").ids(), "o", "l") == [(1, 2)]


def test_set_forms(ctx, spark):
    ids = spark.range(100_000).withColumn("k", F.col("id") % 3)
    edges = ctx.source("t", ids, "id").group_agg("k", {"n": agg.rows()}, All()).edges()
    bitmaps = provenance_bitmap(edges, ["k"])
    assert pairs(bitmap_size(bitmaps, ["k"]), "k", "ids") == [(0, 33334), (1, 33333), (2, 33333)]
    merged = bitmap_union(bitmaps.withColumn("k", F.lit("any")), ["k"])
    assert bitmap_size(merged, ["k"]).first()["ids"] == 100_000
    even = edges.where("rid % 2 = 0")
    assert pairs(contains_all(edges, even, ["k"]), "contained") == [(True,)] * 3
    assert pairs(contains_all(even, edges, ["k"]), "contained") == [(False,)] * 3


@pytest.mark.parametrize("influence", [None, Max(), Top(50), Bottom(2), MaxTies(), Outlier(), SequentialOutlier(),
                                       Union(Top(1), Bottom(1))], ids=lambda i: type(i).__name__)
def test_empty_inputs_and_targets(ctx, sales, influence):
    source = ctx.source("sales", sales, "id")
    out = source.where(F.col("amount") > 1000).group_agg("shop", {"s": agg.total("amount")}, influence)
    assert out.count() == 0 and out.edges().isEmpty() and out.trace().rows().isEmpty()
    some = source.group_agg("shop", {"s": agg.total("amount")}, influence)
    trace = some.trace(F.col("s") > 1000)
    assert trace.targets.isEmpty() and trace.ids().isEmpty() and trace.rows().isEmpty()


def test_trace_of_a_source_level_frame(ctx, sales):
    frame = ctx.source("sales", sales, "id").select("shop", double=F.col("amount") * 2)
    assert pairs(frame.trace(F.col("double") > 15).rows(), "id", "amount") == [(1, 10.0), (2, 30.0), (5, 9.0)]


def test_bad_requests(ctx, sales):
    frame = ctx.source("sales", sales, "id")
    with pytest.raises(ValueError):
        ctx.source("sales", sales, "id")
    with pytest.raises(ValueError):
        frame.join(frame, "id")
    with pytest.raises(ValueError):
        frame.group_agg([], {"n": agg.rows()})
    with pytest.raises(ValueError):
        frame.group_agg("shop", {"n": agg.rows()}, Max())


def test_custom_fold(ctx, spark):
    from rowtrail.operators.folds import combine_moments

    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 != 0, "hot").alias("k"),
                                    (F.col("id") % 101).cast("double").alias("v")).repartition(9)
    out = ctx.source("t", df, "id").fold_agg(
        "k", {"n": F.lit(1).cast("bigint"), "mean": F.col("v"), "m2": F.lit(0.0)}, combine_moments,
        {"mean": F.col("mean"), "variance": F.col("m2") / F.col("n")}, uses=["v"], influence=Top(2))
    want = {r["k"]: (r["m"], r["s"]) for r in
            df.groupBy("k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()}
    got = {r["k"]: (r["mean"], r["variance"]) for r in out.df.collect()}
    assert got.keys() == want.keys() == {"hot", None}
    for key, values in got.items():
        assert values == pytest.approx(want[key], rel=1e-12)
    assert len(pairs(out.trace(F.col("k") == "hot").ids(), "id")) == 2


def test_user_functions_as_columns(ctx, sales):
    import pandas as pd

    @F.pandas_udf("double")
    def doubled(v: pd.Series) -> pd.Series:
        return v * 2

    out = (ctx.source("sales", sales, "id", column_lineage=True).derive("d", doubled("amount"), uses=["amount"])
           .group_agg("shop", {"hi": agg.largest("d")}))
    assert pairs(out.edges(by_column=True).where("shop = 'x'"), "out_col", "rid") == [("hi", 2)]


def test_frames_of_two_contexts_do_not_mix(spark):
    from rowtrail import TraceContext

    a, b = (TraceContext(spark).source(n, spark.range(3), "id") for n in "ab")
    for combine in (lambda: a.union(b), lambda: a.join(b, "id")):
        with pytest.raises(ValueError, match="TraceContext"):
            combine()


def test_nulls_do_not_count_in_moments(spark):
    from rowtrail.operators.folds import combine_moments, fold, moments_of

    rows = spark.createDataFrame([("k", None), *[("k", float(x)) for x in range(1, 6)], ("none", None)], "k string, v double")
    out = {r["k"]: r for r in fold(rows, ["k"], moments_of(F.col("v")), combine_moments).collect()}
    assert (out["k"]["n"], out["k"]["mean"], out["k"]["m2"]) == (5, 3.0, 10.0) and out["none"]["n"] == 0
