"""Fixtures do not depend on partitioning; programs find planted faults."""

import pytest
from pyspark.sql import functions as F, types as T

from rowtrail import TraceContext
from rowtrail.functions import scalar
from rowtrail.plans import program_queries, programs
from rowtrail.operators.influence import SequentialOutlier
from rowtrail.sources import fixtures as fx
from rowtrail.sources.readers import parse_lines, read_table, write_lines


def score(program):
    return program.score().first().asDict()


@pytest.mark.parametrize("make", [fx.weather, fx.airport, fx.trips, fx.student_info, fx.student_info_lines, fx.grades,
                                  fx.grades_with_zeros, fx.student_grades, fx.keyed_numbers],
                         ids=lambda f: f.__name__)
def test_fixture_is_a_function_of_the_id(spark, make):
    few, many = make(spark.range(0, 400, 1, 1)), make(spark.range(0, 400, 1, 7))
    assert few.exceptAll(many).isEmpty() and few.count() == 400


def test_exams_of_one_file_are_made_by_all_tasks(spark, tmp_path):
    ids = [None, 0, 0, *range(397)]
    spark.createDataFrame([(i,) for i in ids], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    exams = program_queries._exams(spark, str(tmp_path))
    per_task = [r["count"] for r in exams.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 400 and len(per_task) >= 8 and max(per_task) < 100
    items = exams.select("id", F.posexplode("grades").alias("i", "item"))
    assert items.where(F.substring_index("item", ":", -1).cast("long") != fx.mix(F.col("id") * 256 + F.col("i"), 4) % 90 + 10).isEmpty()
    assert items.where("id = 0 and i = 0").count() == 3


def test_snow_delta_column_lineage_is_more_precise(spark):
    table = fx.weather(spark.range(20_000), fault_one_in=1000).cache()
    by_column = score(programs.snow_delta(TraceContext(spark), table, "id"))
    by_row = score(programs.snow_delta(TraceContext(spark), table, "id", column_lineage=False))
    faults = table.where("is_fault").count()
    assert by_column["fault_count"] == faults > 5
    assert by_column["precision"] > by_row["precision"] and by_row["recall"] == 1.0


def test_outliers_are_exactly_the_faults(spark):
    table = fx.student_info(spark.range(20_000), fault_one_in=2000).cache()
    got = score(programs.student_age(TraceContext(spark), table, "id"))
    assert got["precision"] == 1.0 and got["fault_count"] == table.where("is_fault").count() > 0
    assert got["recall"] > 0.5  # a fault with a small student number hides behind the larger ones
    again = score(programs.student_age(TraceContext(spark), table, "id", SequentialOutlier()))
    assert again["trace_count"] <= got["trace_count"]


def test_commute_top_speeds(spark):
    table = fx.trips(spark.range(20_000), fault_one_in=400).cache()
    got = score(programs.commute_type(TraceContext(spark), table, "id"))
    assert got["recall"] == 1.0 and got["trace_count"] == 1000


def test_metrics_without_targets(spark):
    table = fx.trips(spark.range(500)).cache()
    program = programs.commute_type(TraceContext(spark), table, "id")
    program.failing = F.col("class") == "rocket"
    got = score(program)
    assert got["target_count"] == 0 and got["trace_count"] == 0
    assert got["precision"] is None and got["recall"] is None


def test_union_of_targets(spark):
    table = fx.grades(spark.range(5000))
    program = programs.gpa_two_level(TraceContext(spark), table, "id")
    ids = lambda cond: {r["id"] for r in program.output.trace(cond).ids().collect()}
    cs, ee = F.col("dept") == "CS", F.col("dept") == "EE"
    assert ids(cs) | ids(ee) == ids(cs | ee)


def test_lines(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a,5,x"), (2, "b,oops,y"), (3, "c"), (4, "d, 7 ,z,extra"), (5, "")],
                                  "id bigint, value string")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType()),
                           T.StructField("t", T.StringType())])
    good, bad = parse_lines(lines, schema)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "a", 5, "x"), (4, "d", 7, "z")]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3, 5]
    path = str(tmp_path / "out")
    write_lines(good.select("k", "n"), path)
    assert sorted(r["value"] for r in read_table(spark, f"{path}/part-*", "text").collect()) == ["a,5", "d,7"]


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.last_index_of(F.lit("1/2/1990"), "/").alias("a"), scalar.last_index_of(F.lit("x"), "/").alias("b"),
        scalar.from_last(F.lit("1/2/1990"), "/").alias("c"), scalar.before_last(F.lit("1/2/1990"), "/").alias("d"),
        scalar.snow_millimetres(F.lit("12mm")).alias("e"), scalar.snow_millimetres(F.lit("90in")).alias("f"),
        scalar.minutes_between(F.lit("23:50"), F.lit("0:20")).alias("g"),
        scalar.minutes_between(F.lit("101112:0"), F.lit("1:0")).alias("h"),
        scalar.grade_points(F.lit(88)).alias("i"), scalar.department(F.lit("Physics 401")).alias("j"),
        scalar.floor_div(F.lit(-7), F.lit(2)).alias("k"), scalar.floor_mod(F.lit(-7), F.lit(2)).alias("l"),
        scalar.int_div(F.lit(-7), F.lit(2)).alias("m"), scalar.natural_log(F.lit(0.0)).alias("n"),
        scalar.zip_to_state(F.lit("90034")).alias("o")).first()
    assert row[:5] == (3, -1, "/1990", "1/2", 12.0)
    assert abs(row["f"] - 27432) < 0.01 and row["g"] == 30 and row["h"] == 1440 + 60 - 101112 * 60
    assert (row["i"], row["j"], row["k"], row["l"], row["m"]) == (3.3, "Physics", -4, 1, -3)
    assert row["n"] == float("-inf") and row["o"] == "34"
