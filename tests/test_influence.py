"""Influence operators on small groups, their laws, and independence of partitioning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rowtrail import TraceContext, aggregates as agg
from rowtrail.operators.influence import (AbsTop, All, Bottom, Converted, Custom, Max, MaxTies, Min, MinTies,
                                          Outlier, SequentialOutlier, Top, Union, Where)


def kept(spark, rows, influence, partitions=None):
    """{key: sorted ids} of the kept rows; ``rows`` are (key, id, value)."""
    df = spark.createDataFrame(rows, "k string, id bigint, v double")
    if partitions:
        df = df.repartition(partitions)
    out = TraceContext(spark).source("t", df, "id").group_agg("k", {"s": agg.total("v")}, influence)
    found = {}
    for r in out.edges().collect():
        found.setdefault(r["k"], []).append(r["rid"])
    return {k: sorted(v) for k, v in found.items()}


ROWS = [("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 9.0), ("a", 4, -20.0), ("a", 5, None), ("a", 6, math.nan),
        ("b", 7, 1.0), (None, 8, 2.0), (None, 9, 3.0)]


@pytest.mark.parametrize("influence, expected", [
    (All(), {"a": [1, 2, 3, 4, 5, 6], "b": [7], None: [8, 9]}),
    (Max(), {"a": [2], "b": [7], None: [9]}),
    (Max("last"), {"a": [3], "b": [7], None: [9]}),
    (Min(), {"a": [4], "b": [7], None: [8]}),
    (Top(2), {"a": [2, 3], "b": [7], None: [8, 9]}),
    (Bottom(2), {"a": [1, 4], "b": [7], None: [8, 9]}),
    (AbsTop(1), {"a": [4], "b": [7], None: [9]}),
    (MaxTies(), {"a": [2, 3], "b": [7], None: [9]}),
    (MinTies(), {"a": [4], "b": [7], None: [8]}),
    (MaxTies().inverted(), {"a": [4], "b": [7], None: [8]}),
    (Max().inverted(), {"a": [4], "b": [7], None: [8]}),
    (Union(Top(1), Bottom(1)), {"a": [2, 4], "b": [7], None: [8, 9]}),
    (Where(lambda v: v > 2), {"a": [1, 2, 3, 6], None: [9]}),
    (Converted(lambda v: -v, Max()), {"a": [4], "b": [7], None: [8]}),
    (Custom(lambda rows, keys, value, ids: rows.where(F.col(ids[0]) < 3)), {"a": [1, 2]}),
    (Outlier(), {}),
])
def test_small_groups(spark, influence, expected):
    assert kept(spark, ROWS, influence) == expected


def test_published_tracker_values(spark):
    rows = [("k", 3, 20.0), ("k", 100, 100.0), ("k", 1, 1.0)]
    assert kept(spark, rows, Max()) == {"k": [100]}
    four = [("k", 100 * i, float(i)) for i in (1, 2, 3, 4)]
    assert kept(spark, four, Top(3)) == {"k": [200, 300, 400]}
    assert kept(spark, [*four, ("k", 500, 5.0)], Top(3)) == {"k": [300, 400, 500]}
    assert kept(spark, [("k", 1, 1.0), ("k", 600, 6.0), ("k", 700, 7.0), ("k", 3, 3.0)],
                Where(lambda v: v > 5)) == {"k": [600, 700]}


def one_pass_outliers(rows, z, warmup):
    """Plain simulation of the one-pass rule for a single group, rows in arrival order."""
    count = mean = m2 = 0.0
    stored = []
    far = lambda x: (abs(x - mean) / math.sqrt(m2 / count) >= z) if m2 > 0 else (count > 0 and m2 == 0 and x != mean)
    for ident, x in rows:
        if count < warmup or far(x):
            stored.append((ident, x))
        count += 1
        delta = x - mean
        mean += delta / count
        m2 += delta * (x - mean)
    return sorted(i for i, x in stored if m2 > 0 and abs(x - mean) / math.sqrt(m2 / count) >= z)


@pytest.mark.parametrize("warmup", [0, 5, 100])
def test_sequential_outlier_equals_one_pass(spark, warmup):
    rng = random.Random(7)
    rows, expected = [], {}
    for key, n in (("hot", 900), ("b", 250), ("flat", 40), ("one", 1)):
        group = []
        for i in range(n):
            x = 5.0 if key == "flat" else rng.gauss(10, 2) * (6 if rng.random() < 0.02 else 1)
            group.append((len(rows) + i, x))
        if key == "flat":
            group[30] = (group[30][0], 500.0)
        rows += [(key, i, x) for i, x in group]
        found = one_pass_outliers(group, 3.0, warmup)
        if found:
            expected[key] = found
    assert len(expected) >= 3
    assert kept(spark, rows, SequentialOutlier(3.0, warmup)) == expected


INFLUENCES = [Max(), MaxTies(), Top(4), Union(Top(2), Bottom(2)), Outlier(2.0), SequentialOutlier(2.0, 10)]


@pytest.mark.parametrize("influence", INFLUENCES, ids=lambda i: type(i).__name__)
def test_same_result_for_any_partitioning(spark, influence):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaab"), i, float(rng.choice([1, 2, 3, 4] * 5 + [50, 60]))) for i in range(600)]
    results = [kept(spark, rows, influence, p) for p in (1, 4, 16)]
    assert results[0] == results[1] == results[2] and results[0]


def test_laws(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), i, rng.expovariate(1)) for i in range(500)]
    everything = kept(spark, rows, All())
    sets = {type(i).__name__: kept(spark, rows, i) for i in INFLUENCES}
    for found in sets.values():
        assert all(set(ids) <= set(everything[k]) for k, ids in found.items())
    assert all(set(ids) <= set(sets["Top"][k]) for k, ids in kept(spark, rows, Max()).items())
    exact, one_pass = kept(spark, rows, Outlier(2.0)), kept(spark, rows, SequentialOutlier(2.0, 10))
    assert all(set(ids) <= set(exact[k]) for k, ids in one_pass.items())


def test_threshold_does_not_depend_on_rounding(spark):
    # ten equal stays and one far one: the score is exactly sqrt(9)
    rows = [("a", i, 30.0) for i in range(9)] + [("a", 9, -4000.0)]
    for partitions in (1, 3, 8):
        assert kept(spark, rows, Outlier(3.0), partitions) == {"a": [9]}
