"""Benchmark: plain jobs, the same jobs traced, traces per influence operator, minimization.

Prints one JSON line.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtrail import TraceContext, aggregates as agg
from rowtrail.operators.influence import (All, MaxTies, Outlier, SequentialOutlier, Top, Union, Bottom, Where)
from rowtrail.operators.minimize import Fold, FoldedProgram, minimize
from rowtrail.plans import programs
from rowtrail.plans.base import events, table
from rowtrail.plans.catalog import QUERIES
from rowtrail.scratch import materialize
from rowtrail.sources import fixtures as fx

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PROGRAM_ROWS = int(os.environ.get("BENCH_PROGRAM_ROWS", "500000"))
RUNS = 2

# catalog queries timed end to end
CATALOG = ["prov_join", "trace_join", "prov_wordcount", "prov_bitmap", "agg_two_level", "trace_two_level",
           "agg_topbottom_mean", "col_topbottom_mean", "trace_metrics", "trace_by_column", "dd_minimal",
           "prog_snow_delta_score", "prog_snow_variance_score", "prog_airport_transit_score",
           "prog_commute_type_score", "prog_commute_join_score", "prog_student_age_score",
           "prog_gpa_two_level_score", "prog_course_extremes_score"]

INFLUENCES = {"all": All(), "top5": Top(5), "max_ties": MaxTies(), "extremes": Union(Top(2), Bottom(2)),
              "filter": Where(lambda v: v > 300), "outlier": Outlier(), "outlier_seq": SequentialOutlier()}


def _grouped(spark, influence=None):
    return events(spark, SF_DIR).group_agg("event_type", {"total": agg.total("value")}, influence)


def plain_job(spark) -> DataFrame:
    return table(spark, SF_DIR, "events").groupBy("event_type").agg(F.sum("value").alias("total"))


def traced_job(spark) -> DataFrame:
    """The same result through a traced frame, before anybody traces."""
    return _grouped(spark).df


def trace_job(influence):
    return lambda spark: _grouped(spark, influence).trace(F.col("event_type") == "click").rows()


def run(job, spark) -> float:
    started = time.perf_counter()
    job(spark).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


PROGRAMS = {
    "snow_delta": (lambda ids: fx.weather(ids, fault_one_in=100_000), programs.snow_delta),
    "snow_variance": (lambda ids: fx.weather(ids, fault_one_in=100_000), programs.snow_variance),
    "airport": (lambda ids: fx.airport(ids, fault_one_in=100_000), programs.airport_transit),
    "commute": (lambda ids: fx.trips(ids, fault_one_in=10_000), programs.commute_type),
    "student_age": (lambda ids: fx.student_info(ids, fault_one_in=100_000), programs.student_age),
    "gpa_two_level": (fx.grades, programs.gpa_two_level),
    "course_extremes": (lambda ids: fx.grades_with_zeros(ids, small_one_in=10_000), programs.course_extremes),
}


def program_overheads(spark) -> dict[str, dict[str, float]]:
    """Each program on a larger table: the plain result, and the result plus the lineage of all of
    its outputs (what an instrumented run collects), and tracing the failing ones."""
    out = {}
    for name, (make, program) in PROGRAMS.items():
        data = materialize(make(spark.range(PROGRAM_ROWS)), name)
        fresh = lambda: program(TraceContext(spark), data, "id")
        plain = min(run(lambda s: fresh().output.df, spark) for _ in range(RUNS))
        lineage = min(run(lambda s: fresh().output.edges(), spark) for _ in range(RUNS))
        trace = min(run(lambda s: fresh().trace().rows(), spark) for _ in range(RUNS))
        out[name] = {"plain": round(plain, 3), "lineage": round(lineage, 3), "trace": round(trace, 3),
                     "overhead": round((plain + lineage) / plain, 2)}
    return out


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("rowtrail-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {"plain_sum": plain_job, "traced_sum": traced_job}
    jobs |= {f"trace_{name}": trace_job(influence) for name, influence in INFLUENCES.items()}
    jobs |= {name: (lambda s, q=QUERIES[name]: q(s, SF_DIR)) for name in CATALOG}
    run(plain_job, spark)  # session warm-up
    seconds = {name: round(min(run(job, spark) for _ in range(RUNS)), 4) for name, job in jobs.items()}

    program = FoldedProgram(["event_type"], {"peak": Fold(F.max("value"), "max")}, F.col("peak") > 300)
    rounds = minimize(table(spark, SF_DIR, "events").select("event_id", "event_type", "value"),
                      ["event_id"], program).rounds
    print(json.dumps({
        "metric": "total seconds of headline queries (best of 2)", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "untraced_overhead": round(seconds["traced_sum"] / seconds["plain_sum"], 3),
        "programs": program_overheads(spark), "program_rows": PROGRAM_ROWS,
        "minimize_rounds": len(rounds), "minimize_seconds": round(sum(r[-1] for r in rounds), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
