"""Backward tracing, scoring, output tests and minimization."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail.operators import aggregates as agg
from rowtrail.operators.checks import is_max, is_min, is_missing
from rowtrail.operators.influence import All, Bottom, Top
from rowtrail.operators.keyed import col
from rowtrail.operators.minimize import (Fold, FoldedProgram, chunk_partials, minimize, minimize_trace,
                                         own_partials)
from rowtrail.plans.base import events, query, rounded, table
from rowtrail.plans.lineage_queries import user_means
from rowtrail.sources.ids import split_equal, with_position
from rowtrail.sources.registry import TraceContext

_FAULT = "value > 300"


def _totals(spark, sf_dir, influence=Top(5)):
    return events(spark, sf_dir).group_agg("event_type", {"total": agg.total("value")}, influence)


_TARGETS = """t as (select event_type, sum(value) as total from events group by 1
  having sum(value) > (select sum(value) / count(distinct event_type) from events))"""
_TRACED = f"""{_TARGETS}, x as (select event_id from (select *, row_number() over
  (partition by event_type order by value desc, event_id) rn from events
  where event_type in (select event_type from t)) where rn <= 5)"""


def _suspicious(spark, sf_dir, influence=Top(5)):
    """Totals above the mean total of all types."""
    out = _totals(spark, sf_dir, influence)
    mean = out.df.agg(F.avg("total")).scalar()
    return out.trace(F.col("total") > mean)


@query(f"with {_TARGETS} select event_type, round(total, 2) as total from t")
def trace_targets(spark, sf_dir):
    return rounded(_suspicious(spark, sf_dir).targets, 2, "total")


@query(f"with {_TRACED} select event_id, user_id, event_type, value from events where event_id in (select event_id from x)")
def trace_rows(spark, sf_dir):
    return _suspicious(spark, sf_dir).rows().select("event_id", "user_id", "event_type", "value")


@query(f"""with {_TRACED}, c as (select count(*) as input_count, count(*) filter (where {_FAULT}) as fault_count,
  (select count(*) from x) as trace_count,
  count(*) filter (where {_FAULT} and event_id in (select event_id from x)) as correct_count from events)
select input_count, (select count(distinct event_type) from events) as output_count,
  (select count(*) from t) as target_count, fault_count, trace_count, correct_count,
  fault_count - correct_count as missing_count, trace_count - correct_count as extra_count,
  round(correct_count / trace_count, 8) as "precision", round(correct_count / fault_count, 8) as recall,
  correct_count as "yield" from c""")
def trace_metrics(spark, sf_dir):
    return rounded(_suspicious(spark, sf_dir).metrics(F.expr(_FAULT)), 8, "precision", "recall")


@query(f"""with {_TRACED} select case when {_FAULT} then 'untraced_fault' else 'false_trace' end as kind, event_id, value
from events where ({_FAULT}) <> (event_id in (select event_id from x))""")
def trace_diff(spark, sf_dir):
    return _suspicious(spark, sf_dir).diff(F.expr(_FAULT)).select("kind", "event_id", "value")


@query(f"""with {_TRACED}, a as (select event_type, value from events where {_FAULT}),
b as (select event_type, value from events where event_id in (select event_id from x))
select 'untraced_fault' as kind, event_type, value from (select * from a except all select * from b)
union all select 'false_trace', event_type, value from (select * from b except all select * from a)""")
def trace_diff_values(spark, sf_dir):
    """The comparison as multisets of values."""
    return _suspicious(spark, sf_dir).diff_values(F.expr(_FAULT), ["event_type", "value"])


@query("""with m as (select user_id, user_id % 10 as bucket, avg(value) as mean from events group by user_id),
r as (select *, row_number() over (partition by bucket order by mean, user_id) lo,
  row_number() over (partition by bucket order by mean desc, user_id) hi from m),
o as (select bucket, avg(mean) filter (where lo <= 5) as low_mean, avg(mean) filter (where hi <= 5) as high_mean
  from r group by 1)
select distinct event_id from events join r using (user_id) join o using (bucket)
where (low_mean < 44 and lo <= 5) or (high_mean > 56 and hi <= 5)""")
def trace_by_column(spark, sf_dir):
    """Each output chooses by its values which column's lineage to follow."""
    out = user_means(spark, sf_dir, column_lineage=True).top_bottom_mean("bucket", "mean")
    low, high = F.col("low_mean") < 44, F.col("high_mean") > 56
    return out.trace(low | high, rules=[(low, ["low_mean"]), (high, ["high_mean"])]).ids()


@query("""with m as (select user_id, user_id % 10 as bucket, avg(value) as mean from events group by user_id),
r as (select user_id, row_number() over (partition by bucket order by mean, user_id) rn from m where bucket in (3, 4))
select 0 as stage, 'bucket means' as name, 2 as rows
union all select 1, 'user means', (select count(*) from r where rn <= 5)
union all select 2, 'events', (select count(*) from events where user_id in (select user_id from r where rn <= 5))""")
def trace_stage_counts(spark, sf_dir):
    out = user_means(spark, sf_dir).group_agg("bucket", {"mean": agg.average("mean")}, Bottom(5),
                                              name="bucket means")
    return out.trace(F.col("bucket").isin(3, 4)).stage_counts()


# -- output tests --------------------------------------------------------------------------

_OUT = "o as (select user_id, round(avg(value), 8) as mean from events group by 1)"


def _outputs(spark, sf_dir):
    return rounded(events(spark, sf_dir).group_agg("user_id", {"mean": agg.average("value")}).df, 8, "mean")


@query(f"with {_OUT} select * from o where mean = (select min(mean) from o)")
def test_is_min(spark, sf_dir):
    out = _outputs(spark, sf_dir)
    return out.where(is_min(out, "mean"))


@query(f"with {_OUT} select * from o where mean = (select max(mean) from o)")
def test_is_max(spark, sf_dir):
    out = _outputs(spark, sf_dir)
    return out.where(is_max(out, "mean"))


@query("""select user_id, round(avg(value) filter (where event_type = 'error' and value > 100), 8) as mean
from events group by 1 having avg(value) filter (where event_type = 'error' and value > 100) is null""")
def test_is_null(spark, sf_dir):
    large_error = (F.col("event_type") == "error") & (F.col("value") > 100)
    out = events(spark, sf_dir).group_agg(
        "user_id", {"mean": agg.Agg(F.avg(F.when(large_error, F.col("value"))), ("value",))})
    return rounded(out.where(is_missing("mean")).df, 8, "mean")


# -- minimization --------------------------------------------------------------------------

@query("""with p as (select event_type, value, (row_number() over (order by event_id) - 1) * 8
  // (select count(*) from events) as part from events),
c as (select event_type, part, count(*) as n, sum(value) as own, max(value) as own_max from p group by 1, 2)
select event_type, cast(part as integer) as part, n, round(own, 2) as own, own_max,
  round(sum(own) over (partition by event_type) - own, 2) as rest,
  (select max(d.own_max) from c d where d.event_type = c.event_type and d.part <> c.part) as rest_max from c""")
def dd_batched_partials(spark, sf_dir):
    """One job: the folds of every part and of every complement."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    parts = split_equal(with_position(rows, ["event_id"]), 8, rows.count())
    program = FoldedProgram(["event_type"], {"own": Fold(F.sum("value")), "own_max": Fold(F.max("value"), "max")},
                            F.lit(True))
    out = chunk_partials(own_partials(parts, "part", program), "part", program).select(
        "event_type", "part", F.col("__n").alias("n"), "own", "own_max", F.col("rest_own").alias("rest"),
        F.col("rest_own_max").alias("rest_max"))
    return rounded(out, 2, "own", "rest")


@query("select event_id, event_type, value from events where value > 300 order by event_id limit 1")
def dd_minimal(spark, sf_dir):
    """One job per round.  The test fails on any reading above 300, so the search, which prefers
    earlier parts, must end at the first such row."""
    program = FoldedProgram(["event_type"], {"peak": Fold(F.max("value"), "max")}, F.col("peak") > 300)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return minimize(rows, ["event_id"], program).rows


@query("select event_id, event_type, value from events where value > 250")
def dd_minimal_scattered(spark, sf_dir):
    """Culprits all over the table, which only fail together: those of a round go at once."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    needed = rows.where(F.col("value") > 250).count()
    program = FoldedProgram(["all"], {"hits": Fold(F.sum("hit"))}, F.col("hits") >= needed, prepare=lambda d: d.withColumns(
        {"all": F.lit(0), "hit": (F.col("value") > 250).cast("int")}))
    return minimize(rows, ["event_id"], program).rows


@query("""select event_id, event_type, value from events where event_id in (
  (select min(event_id) from events where event_type = 'click' and value > 250),
  (select min(event_id) from events where event_type = 'purchase' and value > 250))""")
def dd_minimal_pair(spark, sf_dir):
    """Two rows that only fail together, found after tracing the failing output."""
    large = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    first = large.where(F.col("value") > 250).groupBy("event_type").agg(F.min("event_id").alias("event_id"))
    # the culprits are the first large click and the first large purchase
    marked = large.join(first.withColumn("hit", F.lit(1)), ["event_type", "event_id"], "left").select(
        "event_id", "event_type", "value", F.coalesce("hit", F.lit(0)).alias("hit"), F.lit(0).alias("all"))
    traced = TraceContext(spark).source("large", marked, "event_id").group_agg(
        "all", {"hits": agg.total("hit")}, All()).trace(F.col("hits") >= 2)
    program = FoldedProgram(["all"], {"hits": Fold(F.sum("hit"))}, col("hits") >= 2)
    minimal, _ = minimize_trace(traced, program)
    return minimal.rows.select("event_id", "event_type", "value")


@query("select event_id, event_type, value from events where value > 300 order by event_id limit 1")
def dd_minimal_program(spark, sf_dir):
    """The same search with an arbitrary DataFrame program, one job per test, on traced rows."""
    out = events(spark, sf_dir).group_agg("event_type", {"total": agg.total("value")}, All())
    candidates = out.trace(F.col("total") > 0).rows().select("event_id", "event_type", "value")
    return minimize(candidates, ["event_id"],
                    lambda rows: rows.groupBy("event_type").agg(F.max("value").alias("peak")),
                    F.col("peak") > 300).rows
