"""The fault-tracing programs, end to end: output, output test and fault predicate.

Each takes a context and an input table (``sources.fixtures`` describes the layouts) whose rows
are identified by ``ident``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.functions.scalar import (before_last, department, from_last, grade_points, int_div,
                                       minutes_between, snow_millimetres, travel_class, zip_to_state)
from rowtrail.operators import aggregates as agg
from rowtrail.operators.frame import TracedFrame
from rowtrail.operators.influence import Bottom, Influence, Outlier, Top, Union
from rowtrail.operators.keyed import col
from rowtrail.operators.trace import Trace
from rowtrail.sources.fixtures import INFLATED_COURSES, ZEROED_COURSES
from rowtrail.sources.registry import TraceContext


@dataclass
class Program:
    output: TracedFrame
    failing: Column | None = None
    fault: Column | None = None
    source: str | None = None
    rules: list | None = None

    def trace(self) -> Trace:
        return self.output.trace(self.failing, rules=self.rules)

    def score(self) -> DataFrame:
        return self.trace().metrics(self.fault, self.source)


def _snow_by_key(readings: TracedFrame) -> TracedFrame:
    """Each reading under its day of the year ('d/m') and its year ('/yyyy')."""
    return (readings.with_columns({"mm": snow_millimetres(col("snow")), "state": zip_to_state(col("zip"))})
            .explode("key", F.array(before_last(col("date"), "/"), from_last(col("date"), "/")))
            .select("key", "state", "mm").named("snow by key"))


def _inches() -> Column:
    return F.trim(col("snow")) == "90in"


def snow_delta(ctx: TraceContext, table: DataFrame, ident: str, column_lineage: bool = True) -> Program:
    readings = ctx.source("weather", table, ident, column_lineage)
    out = _snow_by_key(readings).group_agg("key", {"delta": agg.spread("mm")})
    return Program(out, col("delta") > 6000, _inches())


def snow_variance(ctx: TraceContext, table: DataFrame, ident: str,
                  influence: Influence = Outlier()) -> Program:
    out = _snow_by_key(ctx.source("weather", table, ident)).with_columns(
        {"depth": col("mm").cast("double")}).group_agg(
        "key", {"variance": agg.sample_variance("depth")}, influence)
    return Program(out, col("variance") > 6000, _inches())


def snow_state_range(ctx: TraceContext, table: DataFrame, ident: str) -> Program:
    """Mean per (date, state) explained by its extremes, then the range of the means per state."""
    means = _snow_by_key(ctx.source("weather", table, ident)).with_columns(
        {"depth": col("mm").cast("double")}).group_agg(
        ["key", "state"], {"mean": agg.average("depth")}, Union(Top(5), Bottom(5)), name="date means")
    # the means become values with their own lineage; the lineage of a mean is its extremes
    out = means.select("state", "mean").promote().group_agg("state", {"delta": agg.spread("mean")})
    return Program(out)


def snow_state_peak(ctx: TraceContext, table: DataFrame, ident: str) -> Program:
    """Sum per (state, date), then the largest sum of a state."""
    sums = _snow_by_key(ctx.source("weather", table, ident)).with_columns(
        {"depth": col("mm").cast("double")}).group_agg(
        ["state", "key"], {"total": agg.total("depth")}, name="date sums")
    out = sums.group_agg("state", {"peak": agg.largest("total")}, Top(1))
    return Program(out, col("peak") > 10000, _inches())


def airport_transit(ctx: TraceContext, table: DataFrame, ident: str,
                    influence: Influence = Outlier()) -> Program:
    stay = minutes_between(col("arrival"), col("departure"))
    out = (ctx.source("airport", table, ident)
           .select("airport", hour=F.substring_index(col("departure"), ":", 1), stay=stay)
           .where(col("stay") < 45)
           .group_agg(["airport", "hour"], {"total": agg.total("stay")}, influence))
    return Program(out, col("total") < 0, stay < 0)


def _speed() -> Column:
    return int_div(col("distance"), col("time"))


def commute_type(ctx: TraceContext, table: DataFrame, ident: str,
                 influence: Influence = Top(1000)) -> Program:
    out = (ctx.source("trips", table, ident).select(speed=_speed())
           .with_columns({"class": travel_class(col("speed"))})
           .group_agg("class", {"mean": agg.average("speed")}, influence))
    return Program(out, col("class") == "car", _speed() > 500)


def commute_join(ctx: TraceContext, table: DataFrame, ident: str, areas: DataFrame) -> Program:
    places = ctx.source("zipcode", areas, "zip")
    out = (ctx.source("trips", table, ident).select(zip=col("zip_from"), speed=_speed())
           .join(places, "zip").with_columns({"class": travel_class(col("speed"))})
           .group_agg("class", {"mean": agg.average("speed")}))
    return Program(out, col("class") == "car", _speed() > 500, source="trips")


def student_age(ctx: TraceContext, table: DataFrame, ident: str,
                influence: Influence = Outlier()) -> Program:
    out = ctx.source("student_info", table, ident).group_agg(
        "year", {"mean": agg.average("age")}, influence)
    return Program(out, col("mean") > 30, col("age") > 30)


def pass_fail(ctx: TraceContext, table: DataFrame, ident: str) -> Program:
    """Passed and failed exams per course, where there is more than one."""
    out = (ctx.source("student_grades", table, ident).explode("item", col("grades"))
           .select(result=F.concat(F.substring_index(col("item"), ":", 1), F.when(
               F.substring_index(col("item"), ":", -1).cast("int") > 40, " Pass").otherwise(" Fail")))
           .group_agg("result", {"exams": agg.rows()}).where(col("exams") > 1))
    return Program(out)


def gpa_two_level(ctx: TraceContext, table: DataFrame, ident: str,
                  influence: Influence = Outlier()) -> Program:
    """Mean grade points per course, then mean and variance of the courses of a department."""
    courses = ctx.source("grades", table, ident).select(
        "course", points=grade_points(col("grade"))).group_agg(
        "course", {"gpa": agg.average("points")}, name="course means")
    out = courses.select("gpa", dept=department(col("course"))).named("course means").group_agg(
        "dept", {"mean": agg.average("gpa"), "variance": agg.population_variance("gpa")}, influence)
    return Program(out, col("dept") == "CS", col("course").isin(INFLATED_COURSES))


def gpa_variance(ctx: TraceContext, table: DataFrame, ident: str, influence: Influence = Outlier(),
                 fault: Column | None = None) -> Program:
    out = ctx.source("grades", table, ident).select(
        dept=department(col("course")), points=grade_points(col("grade"))).group_agg(
        "dept", {"variance": agg.population_variance("points")}, influence)
    return Program(out, col("variance") > 0.96, col("course").isin(INFLATED_COURSES) if fault is None else fault)


def course_extremes(ctx: TraceContext, table: DataFrame, ident: str, limit: int = 5) -> Program:
    """Mean per course (explained by its two best and two worst grades), then the means of the
    lowest and highest courses of a department, each with its own lineage."""
    means = ctx.source("grades", table, ident).select(
        "course", "grade", dept=department(col("course"))).group_agg(
        ["dept", "course"], {"mean": agg.average("grade")}, Union(Bottom(2), Top(2)), name="course means")
    out = means.select("dept", "mean").promote().top_bottom_mean("dept", "mean", limit, limit)
    low, high = col("low_mean") < 80, col("high_mean") > 85
    return Program(out, low | high, col("course").isin(ZEROED_COURSES) & (col("grade") == 0),
                   rules=[(low, ["low_mean"]), (high, ["high_mean"])])


def word_count(ctx: TraceContext, table: DataFrame, ident: str, text: str = "text") -> Program:
    out = (ctx.source("documents", table, ident).explode("word", F.split(col(text), " "))
           .group_agg("word", {"n": agg.rows()}))
    return Program(out)


def keyed_conditional_sum(ctx: TraceContext, table: DataFrame, ident: str, above: int = 300) -> Program:
    """Sum per key of the values above a limit (independent of the order of the rows)."""
    out = ctx.source("numbers", table, ident).group_agg(
        "key", {"total": agg.total_where("value", col("value") > above)})
    return Program(out)
