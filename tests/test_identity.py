"""Output identity, lineage of the chosen argument and of the branch taken, table functions."""

import pytest
from pyspark.sql import functions as F

from rowtrail import aggregates as agg
from rowtrail.operators.influence import Max, Outlier, Top, Union


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_equal_rows_of_a_join_are_outputs_of_their_own(ctx, spark):
    left = ctx.source("l", spark.createDataFrame([(1, "k"), (2, "k")], "id int, k string"), "id").select("k")
    right = ctx.source("r", spark.createDataFrame([(7, "k"), (8, "k")], "id int, k string"), "id").select("k")
    out = left.join(right, "k")
    assert rows_of(out.with_provenance(), "k", "src", "rid") == [("k", "l", 1), ("k", "l", 2), ("k", "r", 7), ("k", "r", 8)]
    found = out.with_provenance("out").select("out.l", "out.r", "src", "rid")
    assert rows_of(found, "l", "r", "src", "rid") == sorted((a, b, s, i) for a in (1, 2) for b in (7, 8) for s, i in (("l", a), ("r", b)))


def test_self_join_elements_and_unions(ctx, spark):
    base = ctx.source("t", spark.createDataFrame([(1, "a"), (2, "a")], "id int, k string"), "id").select("k")
    pairs = base.explode("e", F.array(F.lit("x"), F.lit("x"))).join(base.explode("f", F.array(F.lit("y"), F.lit("y"))), "k").select("e", "f")
    found = pairs.identified("out")
    assert found.df.select("out").distinct().count() == found.count() == 16
    assert set(found.df.schema["out"].dataType.names) == {"t", "t_2", "element", "element_2"}
    # each output has its own one or two inputs
    assert found.edges(keep=["out"]).groupBy("out").count().groupBy("count").count().sort("count").collect()[:] == [(1, 8), (2, 8)]
    both = base.union(base)
    assert both.identified("out").df.select("out").distinct().count() == 4 and len(both.with_provenance("out").collect()) == 4


def test_identity_of_groups_and_of_taken_rows(ctx, spark):
    df = spark.createDataFrame([(i, i % 2, None if i == 3 else float(i % 3)) for i in range(8)], "id int, k int, v double")
    out = ctx.source("t", df, "id").group_agg("k", {"n": agg.rows()}).select("n")
    assert rows_of(out.with_provenance(), "n", "rid") == [(4, i) for i in range(8)]
    assert rows_of(out.with_provenance("o").select("o.group.k", "rid"), "k", "rid") == sorted((i % 2, i) for i in range(8))
    assert out.take_with_provenance(1, "o").select("o").distinct().count() == 1


def test_nothing_more_is_read_without_identity(ctx, spark):
    frame = ctx.source("t", spark.range(5).withColumn("v", F.lit(1)), "id").explode("e", F.array("v", "v"))
    assert frame.df.columns == ["id", "v", "e"] and frame.count() == 10


def frame_of_ends(ctx, spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 9.0), (3, "b", 4.0), (4, "b", 5.0), (5, "c", None), (6, "c", None)],
                               "id int, k string, v double")
    return ctx.source("t", df, "id", column_lineage=True).group_agg("k", {"lo": agg.smallest("v"), "hi": agg.largest("v")})


def lineage(frame, *columns):
    found = {}
    for r in frame.edges(by_column=list(columns)).collect():
        found.setdefault((r["k"], r["out_col"]), set()).add(r["rid"])
    return found


def test_least_keeps_the_chosen_argument(ctx, spark):
    frame = frame_of_ends(ctx, spark).derive("far", F.col("hi") - 3, uses=["hi"])
    frame = frame.derive_least("low", ["far", "lo"]).derive_greatest("high", ["far", "lo"])
    assert frame.df.where("k = 'a'").first()[:] == ("a", 1.0, 9.0, 6.0, 1.0, 6.0)
    # a: far = 6, lo = 1; b: far = 2, lo = 4
    assert lineage(frame, "low", "high") == {("a", "low"): {1}, ("a", "high"): {2}, ("b", "low"): {4}, ("b", "high"): {3}}


def test_ties_take_the_first(ctx, spark):
    frame = frame_of_ends(ctx, spark).derive("same", F.col("lo"), uses=["hi"])
    frame = frame.derive_least("x", ["lo", "same"]).derive_least("y", ["same", "lo"])
    assert lineage(frame, "x", "y") == {("a", "x"): {1}, ("a", "y"): {2}, ("b", "x"): {3}, ("b", "y"): {4}}


def test_choices_nest_and_survive_steps(ctx, spark):
    """A chosen value goes through projection, another choice, a join with itself and a second aggregation."""
    frame = frame_of_ends(ctx, spark).derive("far", F.col("hi") - 3, uses=["hi"]).derive_least("low", ["far", "lo"])
    frame = frame.derive_branch("pick", [(F.col("k") == "a", F.col("low"), ["k"], ["low"])], F.col("hi"), ["hi"])
    assert lineage(frame, "pick")[("a", "pick")] >= {1} and lineage(frame, "pick")[("b", "pick")] >= {4}
    narrow = frame.select("k", "low")
    assert lineage(narrow, "low") == {("a", "low"): {1}, ("b", "low"): {4}}
    again = narrow.join(narrow.select("k", other=F.col("low")), "k")
    assert {k: v for k, v in lineage(again, "low").items()} == {("a", "low"): {1}, ("b", "low"): {4}}
    top = narrow.select("low", all=F.lit(0)).promote(["all"]).group_agg("all", {"best": agg.smallest("low")})
    assert {r["rid"] for r in narrow.with_columns({"all": F.lit(0)}, uses=[]).group_agg("all", {"sum": agg.total("low")}).edges(
        keep=["all"], by_column=["sum"]).collect()} == {1, 4}
    assert top.df.first()["best"] == 1.0
    for influence, expected in ((Max(), {4}), (Union(Top(1), Top(2)), {1, 4}), (Outlier(0.5), {1, 4})):
        two = narrow.with_columns({"all": F.lit(0)}, uses=[]).group_agg("all", {"s": agg.total("low", influence)})
        assert {r["rid"] for r in two.edges(keep=["all"], by_column=["s"]).collect()} == expected


def test_branch_taken(ctx, spark):
    frame = frame_of_ends(ctx, spark).derive_branch(
        "label", [(F.col("hi") > 6, F.lit("far"), ["hi"], []), (F.col("lo") > 3, F.col("lo").cast("string"), ["lo"], ["lo"])], F.lit("none"), [])
    assert [r["label"] for r in frame.df.sort("k").collect()] == ["far", "4.0", "none"]
    assert lineage(frame, "label") == {("a", "label"): {2}, ("b", "label"): {3, 4}}
    traced = frame.trace(F.col("k") == "a", columns=["label"])
    assert rows_of(traced.ids(), "id") == [(2,)]


def test_table_function(ctx, spark):
    class Words:  # defined here, it is sent to the executors by value
        def eval(self, text: str):
            for number, word in enumerate((text or "").split()):
                yield number, word

    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "a")], "id int, text string")
    out = ctx.source("t", df, "id").explode_function(F.udtf(Words, returnType="n int, word string"), ["text"], ["n", "word"])
    assert rows_of(out.df, "id", "n", "word") == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (3, 0, "a")]
    counted = out.group_agg("word", {"n": agg.rows()})
    assert rows_of(counted.edges(), "word", "rid") == [("a", 1), ("a", 3), ("b", 1)]
    with pytest.raises(ValueError):
        out.explode_function(F.udtf(Words, returnType="n int, word string"), ["text"], ["n", "other"])
