"""Delta debugging against a plain simulation, and splits."""

import random

import pytest
from pyspark.sql import functions as F

import rowtrail.operators.minimize as minimizer
from rowtrail import aggregates as agg
from rowtrail.operators.minimize import (Fold, FoldedProgram, chunk_bounds, minimize, minimize_trace,
                                         ranks_between)
from rowtrail.sources.ids import split_equal, split_weighted, with_position


def simulate(items, fails):
    """The same search over a list."""
    if not items or not fails(items):
        return []
    parts = 2
    while len(items) > 1:
        n = len(items)
        parts = min(parts, n)
        cuts = [-(-j * n // parts) for j in range(parts + 1)]
        pieces = [items[a:b] for a, b in zip(cuts, cuts[1:])]
        part = next((p for p in pieces if fails(p)), None)
        if part is not None:
            items, parts = part, 2
            continue
        rest = next((r for r in ([x for q in pieces[:j] + pieces[j + 1:] for x in q] for j in range(parts))
                     if parts > 2 and fails(r)), None)
        if rest is not None:
            items, parts = rest, max(parts - 1, 2)
            continue
        if parts >= n:
            break
        parts = min(n, parts * 2)
    return items


CASES = [
    (40, {13: 1}, 1), (40, {3: 1, 30: 1}, 2), (33, {0: 1, 16: 1, 32: 1}, 3), (25, {}, 1), (1, {0: 1}, 1),
    (30, {i: 1 for i in range(30)}, 4),
]


@pytest.mark.parametrize("n, hits, need", CASES)
def test_both_modes_equal_the_simulation(spark, n, hits, need):
    rows = [(i, "k" if i % 3 else "other", hits.get(i, 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, k string, hit int").repartition(3)
    expected = simulate([r[0] for r in rows], lambda ids: sum(hits.get(i, 0) for i in ids) >= need)
    program = FoldedProgram(["one"], {"hits": Fold(F.sum("hit"))}, F.col("hits") >= need,
                            prepare=lambda d: d.withColumn("one", F.lit(1)))
    folded = minimize(df, ["id"], program)
    assert sorted(r["id"] for r in folded.rows.collect()) == expected and folded.size == len(expected)
    assert folded.failed == bool(expected) and folded.log().count() == len(folded.rounds)
    if n <= 33 and need < 4:
        free = minimize(df, ["id"], lambda d: d.groupBy().agg(F.sum("hit").alias("hits")), F.col("hits") >= need)
        assert sorted(r["id"] for r in free.rows.collect()) == expected


def test_several_keys_and_merges(spark):
    """The failing key need not appear in every part; min and max folds have no inverse."""
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.randrange(100)) for i in range(36)]
    rows[7], rows[29] = (7, "b", 500), (29, "b", -500)

    def fails(items):
        for key in "abc":
            values = [v for _, k, v in items if k == key]
            if values and max(values) - min(values) >= 1000:
                return True
        return False

    program = FoldedProgram(["k"], {"lo": Fold(F.min("v"), "min"), "hi": Fold(F.max("v"), "max")},
                            F.col("hi") - F.col("lo") >= 1000)
    found = minimize(spark.createDataFrame(rows, "id bigint, k string, v int"), ["id"], program)
    assert sorted(r["id"] for r in found.rows.collect()) == [i for i, _, _ in simulate(rows, fails)] == [7, 29]


def test_equal_rows_stay_different_candidates(spark):
    df = spark.createDataFrame([(i, "same", 1) for i in range(8)], "id bigint, k string, v int")
    program = FoldedProgram(["k"], {"n": Fold(F.sum("v"))}, F.col("n") >= 3)
    assert minimize(df, ["id"], program).size == 3


def test_trace_then_minimize(ctx, spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], 900.0 if i == 50 else 1.0) for i in range(120)],
                               "id bigint, k string, v double")
    out = ctx.source("t", df, "id").group_agg("k", {"s": agg.total("v")})
    program = FoldedProgram(["k"], {"s": Fold(F.sum("v"))}, F.col("s") > 500)
    minimal, report = minimize_trace(out.trace(F.col("s") > 500), program)
    assert [r["id"] for r in minimal.rows.collect()] == [50]
    assert report.select("input_rows", "trace_rows", "minimal_rows").first()[:] == (120, 40, 1)


def test_split_arithmetic():
    assert chunk_bounds(10, 4) == [0, 3, 5, 8, 10]
    assert ranks_between([(0, 3), (10, 14)], 2, 5) == [(2, 3), (10, 12)]


def test_splits(spark):
    positioned = with_position(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), ["id"])
    assert positioned.where("pos <> id").isEmpty()
    equal = split_equal(positioned, 3, 1000).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in equal] == [334, 333, 333]
    weighted = split_weighted(positioned, [1, 2, 1], 1000).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in weighted] == [250, 500, 250]
    with pytest.raises(ValueError):
        split_weighted(positioned, [], 10)


@pytest.mark.parametrize("n, hits", [(90, range(0, 90, 2)), (2000, [i for i in range(2000) if i * 7919 % 4 == 0])])
def test_scattered_culprits(spark, n, hits):
    """Many removals are decided at once: 500 culprits among 2,000 candidates take a few dozen rounds."""
    hits = set(hits)
    df = spark.range(n).select("id", F.col("id").isin(hits).cast("int").alias("hit")).repartition(3)
    program = FoldedProgram(["one"], {"hits": Fold(F.sum("hit"))}, F.col("hits") >= len(hits),
                            prepare=lambda d: d.withColumn("one", F.lit(1)))
    found = minimize(df, ["id"], program)
    assert {r["id"] for r in found.rows.collect()} == hits and found.size == len(hits)
    assert len(found.rounds) <= 40


def one_minimal(df, rows, need):
    """Whether the kept values reach the sum, and no longer without any one of them."""
    kept = [r["v"] for r in rows.collect()]
    return sum(kept) >= need > sum(kept) - min(kept)


def test_removals_that_exclude_each_other(spark):
    """Each row can go alone but not all of them together: what stays still fails and is minimal."""
    df = spark.range(200).select("id", (F.col("id") * 31 % 17 + 1).alias("v"), F.lit("k").alias("k"))
    program = FoldedProgram(["k"], {"s": Fold(F.sum("v"))}, F.col("s") >= 900)
    assert one_minimal(df, minimize(df, ["id"], program).rows, 900)


def test_program_mode_takes_many_tests_a_job(spark, monkeypatch):
    hits = {3, 11, 12, 19, 28}
    df = spark.range(32).select("id", F.col("id").isin(hits).cast("int").alias("hit"))
    tests, one_job = [], minimizer._TestedSearch.failing_of
    monkeypatch.setattr(minimizer._TestedSearch, "failing_of", lambda self, subsets: tests.append(len(subsets)) or one_job(self, subsets))
    found = minimize(df, ["id"], lambda rows: rows.groupBy().agg(F.sum("hit").alias("hits")), F.col("hits") >= len(hits))
    assert {r["id"] for r in found.rows.collect()} == hits
    assert len(tests) <= 20 and max(tests) == minimizer.TESTS and sum(tests) > 3 * len(tests)


@pytest.mark.parametrize("bits", [1, 12])
def test_running_folds_in_blocks(spark, monkeypatch, bits):
    """A key's folds on both sides, by blocks or in one task, also of a null key and of null folds."""
    monkeypatch.setattr(minimizer, "BLOCK_BITS", bits)
    rng = random.Random(2)
    rows = [(k, c, rng.choice([None, *range(9)])) for k in ("a", None) for c in rng.sample(range(-1, 60), 40)]
    df = spark.createDataFrame(rows, "k string, c bigint, v int").withColumn("lo", F.col("v")).repartition(3)
    merges = {"v": "sum", "lo": "min"}
    got = minimizer.running_folds(df, ["k"], "c", merges, 60, "after_", "before_", "all_")

    def folds(key, within):
        values = [v for k, c, v in rows if k == key and within(c) and v is not None]
        return (sum(values), min(values)) if values else (None, None)

    want = {(k, c): (*folds(k, lambda x: x > c), *folds(k, lambda x: x < c), *folds(k, lambda x: True)) for k, c, _ in rows}
    assert {(r["k"], r["c"]): r[2:] for r in got.select(
        "k", "c", "after_v", "after_lo", "before_v", "before_lo", "all_v", "all_lo").collect()} == want


def test_no_fold_is_made_anew_for_every_row(spark):
    """Frames that end at a key's last row take quadratic time in Spark."""
    program = FoldedProgram(["k"], {"s": Fold(F.sum("v"))}, F.col("s") > 1)
    partial = spark.range(10).select(F.lit(0).alias("k"), F.col("id").alias("c"), F.lit(1).alias("__n"), F.col("id").alias("s"))
    plan = minimizer.chunk_partials(partial, "c", program)._jdf.queryExecution().optimizedPlan().toString()
    assert "1, unboundedfollowing$()" not in plan and "unboundedpreceding$(), -1" in plan
