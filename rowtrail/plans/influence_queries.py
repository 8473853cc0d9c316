"""One query per influence operator: the kept rows of each group."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail.operators import aggregates as agg
from rowtrail.operators.influence import (AbsTop, All, Bottom, Converted, Custom, Max, MaxTies, Min, MinTies,
                                          Outlier, Procedural, SequentialOutlier, Top, Union, Where)
from rowtrail.plans.base import add, events, query, rounded, table
from rowtrail.plans.lineage_queries import LINEITEM_ID
from rowtrail.sources.registry import TraceContext


def _kept(influence, spark, sf_dir):
    """Edges of sum(value) by type under an influence, with the value of the kept row."""
    out = events(spark, sf_dir).group_agg("event_type", {"total": agg.total("value")}, influence)
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), "value")
    return out.edges().join(values, "rid").select("event_type", "rid", "value")


def _ranked(order: str, n: int) -> str:
    return (f"select event_type, event_id as rid, value from (select *, row_number() over "
            f"(partition by event_type order by {order}) rn from events) where rn <= {n}")


_OUTLIERS = """select event_type, event_id, value from (select *, avg(value) over k as m,
  stddev_pop(value) over k as sd from events window k as (partition by event_type))
where sd > 0 and abs(value - m) / sd >= 3 * (1 - 1e-9)"""

_SEQUENTIAL = """with w as (select event_type, event_id, value,
  count(*) over p pc, avg(value) over p pm, stddev_pop(value) over p ps,
  avg(value) over f fm, stddev_pop(value) over f fs from events
  window p as (partition by event_type order by event_id rows between unbounded preceding and 1 preceding),
         f as (partition by event_type))
select event_type, event_id as rid, value from w
where (pc < 100 or (ps > 0 and abs(value - pm) / ps >= 3 * (1 - 1e-9)) or (ps = 0 and value <> pm))
  and fs > 0 and abs(value - fm) / fs >= 3 * (1 - 1e-9)"""

_CASES = [
    ("infl_all", All(), "select event_type, event_id as rid, value from events"),
    ("infl_max", Max(), _ranked("value desc, event_id", 1)),
    ("infl_max_last", Max("last"), _ranked("value desc, event_id desc", 1)),
    ("infl_min", Min(), _ranked("value, event_id", 1)),
    ("infl_inverted", Max().inverted(), _ranked("value, event_id", 1)),
    ("infl_topn", Top(5), _ranked("value desc, event_id", 5)),
    ("infl_bottomn", Bottom(5), _ranked("value, event_id", 5)),
    ("infl_abstopn", Converted(lambda v: v - 50, AbsTop(5)), _ranked("abs(value - 50) desc, event_id", 5)),
    ("infl_union", Union(Top(2), Bottom(2)),
     f"{_ranked('value desc, event_id', 2)} union {_ranked('value, event_id', 2)}"),
    ("infl_filter", Where(lambda v: v > 200),
     "select event_type, event_id as rid, value from events where value > 200"),
    ("infl_converted", Converted(lambda v: v % 10, Top(3)), _ranked("value % 10 desc, event_id", 3)),
    ("infl_outlier", Outlier(), f"select event_type, event_id as rid, value from ({_OUTLIERS})"),
    ("infl_outlier_seq", SequentialOutlier(), _SEQUENTIAL),
    ("infl_outlier_arrival", SequentialOutlier(order=("ts",)), _SEQUENTIAL.replace("order by event_id", "order by ts, event_id")),
    ("infl_custom", Custom(lambda rows, keys, value, ids: rows.where(F.col(ids[0]) % 7 == 0)),
     "select event_type, event_id as rid, value from events where event_id % 7 = 0"),
]

for _name, _influence, _sql in _CASES:
    add(_name, lambda spark, sf_dir, i=_influence: _kept(i, spark, sf_dir), _sql)


@query("""select event_type, event_id as rid, value from (select *, dense_rank() over
  (partition by event_type order by value desc) r from events) where r <= 3""")
def infl_procedural(spark, sf_dir):
    """Rows that hold one of the three largest different values, chosen in pandas."""
    def prune(rows, keys):
        rank = rows.groupby(keys, dropna=False)["value"].rank(method="dense", ascending=False)
        return rows[rank <= 3]

    return _kept(Procedural(prune), spark, sf_dir)


def _ties(influence):
    def run(spark, sf_dir):
        items = TraceContext(spark).source("lineitem", table(spark, sf_dir, "lineitem"), LINEITEM_ID)
        out = items.group_agg("l_returnflag", {"qty": agg.total("l_quantity")}, influence)
        return out.edges().select("l_returnflag", *[F.col("rid").getField(k).alias(k) for k in LINEITEM_ID])
    return run


for _name, _influence, _end in (("infl_max_ties", MaxTies(), "desc"), ("infl_min_ties", MinTies(), "asc")):
    add(_name, _ties(_influence),
        f"select l_returnflag, {', '.join(LINEITEM_ID)} from (select *, rank() over (partition by l_returnflag "
        f"order by l_quantity {_end}) r from lineitem) where r = 1")


def _aggregate_with_outliers(spark, sf_dir, aggs, digits):
    """The aggregate beside the number and the extremes of the rows that explain it."""
    out = events(spark, sf_dir).group_agg("event_type", aggs, Outlier())
    edges = out.edges().groupBy("event_type").agg(
        F.count(F.lit(1)).alias("ids"), F.min("rid").alias("first_id"), F.max("rid").alias("last_id"))
    return rounded(out.df, digits, *aggs).join(edges, "event_type")


def _outlier_sql(columns: str) -> str:
    return (f"select event_type, {columns}, ids, first_id, last_id from events join (select event_type, "
            f"count(*) as ids, min(event_id) as first_id, max(event_id) as last_id from ({_OUTLIERS}) "
            f"group by event_type) using (event_type) group by event_type, ids, first_id, last_id")


@query(_outlier_sql("round(sum(value), 2) as total"))
def infl_outlier_sum(spark, sf_dir):
    return _aggregate_with_outliers(spark, sf_dir, {"total": agg.total("value")}, 2)


@query(_outlier_sql("round(avg(value), 8) as mean"))
def infl_outlier_avg(spark, sf_dir):
    return _aggregate_with_outliers(spark, sf_dir, {"mean": agg.average("value")}, 8)


@query(_outlier_sql("round(avg(value), 6) as mean, round(var_pop(value), 6) as variance"))
def infl_outlier_meanvar(spark, sf_dir):
    return _aggregate_with_outliers(
        spark, sf_dir, {"mean": agg.average("value"), "variance": agg.population_variance("value")}, 6)
