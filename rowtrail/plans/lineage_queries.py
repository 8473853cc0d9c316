"""Row lineage through projections, filters, joins, set operations and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from rowtrail.operators import aggregates as agg
from rowtrail.operators.folds import combine_moments, moments_of
from rowtrail.operators.influence import Bottom, Top, Where
from rowtrail.operators.keyed import attach_stats, group_stats
from rowtrail.operators.provenance import (bitmap_contains, bitmap_size, bitmap_union, contains_all, number_ids,
                                           provenance_bitmap, provenance_size)
from rowtrail.plans.base import events, query, rounded, table
from rowtrail.plans.programs import word_count
from rowtrail.scratch import new_path
from rowtrail.sources.ids import split_equal, split_weighted, with_position
from rowtrail.sources.readers import parse_lines, read_table, write_lines
from rowtrail.sources.registry import TraceContext

LINEITEM_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


# -- sources, ids, sinks -------------------------------------------------------------------

@query("select event_type, value, 'events' as src, event_id as rid from events")
def prov_scan(spark, sf_dir):
    return events(spark, sf_dir).select("event_type", "value").with_provenance()


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as pos "
       "from orders")
def src_position(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return with_position(orders, ["o_totalprice", "o_orderkey"])


_LINES = ("select event_id, case when event_id % 97 = 0 then event_type || ',n/a' "
          "else event_type || ',' || cast(user_id as varchar) end as line from events")


@query(f"""with l as ({_LINES})
select event_id, split_part(line, ',', 1) as kind, try_cast(split_part(line, ',', 2) as bigint) as user_id,
  case when split_part(line, ',', 2) = 'n/a' then 1 else 0 end as rejected from l""")
def src_parse_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(
        ",", "event_type", F.when(F.col("event_id") % 97 == 0, "n/a")
        .otherwise(F.col("user_id").cast("string"))).alias("value"))
    parsed, rejected = parse_lines(lines, T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("user_id", T.LongType())]))
    return parsed.withColumn("rejected", F.lit(0)).unionByName(rejected.select(
        "event_id", F.split_part("value", F.lit(","), F.lit(1)).alias("kind"),
        F.lit(None).cast("bigint").alias("user_id"), F.lit(1).alias("rejected")))


@query("select event_id, event_type, user_id from events")
def src_text_roundtrip(spark, sf_dir):
    """Text sink, then a glob read of its parts with a schema."""
    path = new_path(spark, "lines")
    write_lines(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), path)
    lines = read_table(spark, f"{path}/part-*", "text")
    parsed, _ = parse_lines(lines, T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.LongType())]))
    return parsed


# -- projections, filters ------------------------------------------------------------------

@query("select event_type, value * 2 as doubled, 'events' as src, event_id as rid from events where value > 100")
def prov_map_filter(spark, sf_dir):
    return (events(spark, sf_dir).where(F.col("value") > 100)
            .select("event_type", doubled=F.col("value") * 2).with_provenance())


@query("""select 'h' || cast(hour(ts) as varchar) as key, value, 'events' as src, event_id as rid from events
union all select 'd' || cast(day(ts) as varchar), value, 'events', event_id from events""")
def prov_flatmap(spark, sf_dir):
    keys = F.array(F.concat(F.lit("h"), F.hour("ts").cast("string")),
                   F.concat(F.lit("d"), F.dayofmonth("ts").cast("string")))
    frame = events(spark, sf_dir).explode("key", keys).select("key", "value")
    # two keys of one row never coincide, so the long form has no repeated pairs
    return frame.with_provenance()


@query("""with w as (select doc_id, unnest(string_split(text, ' ')) as word from documents)
select word, count(*) as n, count(distinct doc_id) as docs from w group by word""")
def prov_wordcount(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return word_count(TraceContext(spark), docs, "doc_id").output.with_provenance_size("docs")


# -- joins, set operations -----------------------------------------------------------------

def _order_lines(spark, sf_dir):
    ctx = TraceContext(spark)
    orders = ctx.source("orders", table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderpriority", l_orderkey=F.col("o_orderkey"))
    items = ctx.source("lineitem", table(spark, sf_dir, "lineitem"), LINEITEM_ID).select(
        "l_orderkey", "l_quantity")
    return orders.join(items, "l_orderkey").group_agg("o_orderpriority", {"qty": agg.total("l_quantity")})


@query("""select o_orderpriority, 'orders' as src, count(distinct o_orderkey) as ids
from orders join lineitem on o_orderkey = l_orderkey group by 1
union all
select o_orderpriority, 'lineitem', count(*) from (
  select distinct o_orderpriority, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  from orders join lineitem on o_orderkey = l_orderkey) group by 1""")
def prov_join(spark, sf_dir):
    edges = _order_lines(spark, sf_dir).edges()
    return edges.groupBy("o_orderpriority", "src").agg(F.count(F.lit(1)).alias("ids"))


@query("""select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
from orders join lineitem on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT'""")
def trace_join(spark, sf_dir):
    return _order_lines(spark, sf_dir).trace(F.col("o_orderpriority") == "1-URGENT").ids("lineitem")


@query("""select event_type, value, 'clicks' as src, event_id as rid from events where event_type = 'click'
union all select event_type, value, 'purchases', event_id from events where event_type = 'purchase'""")
def prov_union(spark, sf_dir):
    ctx = TraceContext(spark)
    data = table(spark, sf_dir, "events")
    sides = [ctx.source(name, data.where(F.col("event_type") == kind), "event_id").select("event_type", "value")
             for name, kind in (("clicks", "click"), ("purchases", "purchase"))]
    return sides[0].union(sides[1]).with_provenance()


@query("""select o_orderkey as out_order, c_custkey as out_customer, o_orderpriority, c_mktsegment, unnest(['orders', 'customer']) as src,
  unnest([o_orderkey, c_custkey]) as rid from orders join customer on o_custkey = c_custkey""")
def prov_join_rows(spark, sf_dir):
    """Every row of a join with a set of its own: most rows have equal visible columns."""
    ctx = TraceContext(spark)
    orders = ctx.source("orders", table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderpriority", c_custkey=F.col("o_custkey"))
    customers = ctx.source("customer", table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_mktsegment")
    out = orders.join(customers, "c_custkey").select("o_orderpriority", "c_mktsegment")
    return out.with_provenance("out").select(
        F.col("out.orders").alias("out_order"), F.col("out.customer").alias("out_customer"), "o_orderpriority", "c_mktsegment", "src", "rid")


@query("""select event_id as out_event, cast(unnest([0, 1, 2]) as integer) as out_element, event_type as key, 'events' as src, event_id as rid
from events""")
def prov_flatmap_repeats(spark, sf_dir):
    """Three equal elements of a row are three outputs."""
    out = events(spark, sf_dir).explode("key", F.array_repeat("event_type", 3)).select("key")
    return out.with_provenance("out").select(
        F.col("out.events").alias("out_event"), F.col("out.element").alias("out_element"), "key", "src", "rid")


@query("""select event_id as id, cast(unnest([0, 1]) as integer) as number, unnest([split_part(props, ':', 1),
  substring(props, instr(props, ':') + 1)]) as piece, 'events' as src, event_id as rid from events""")
def prov_udtf(spark, sf_dir):
    """A flat map by user code: each returned row keeps the id of the row it was made from."""
    class Halves:  # sent to the executors by value
        """The two parts of a text around its first colon, with their order."""

        def eval(self, text: str):
            for number, part in enumerate((text or "").split(":", 1)):
                yield number, part

    halves = F.udtf(Halves, returnType="number int, piece string")
    out = events(spark, sf_dir).select("props", id=F.col("event_id")).explode_function(halves, ["props"], ["number", "piece"])
    return out.select("id", "number", "piece").with_provenance()


@query("select p_brand, 'part' as src, p_partkey as rid from part")
def prov_distinct(spark, sf_dir):
    return (TraceContext(spark).source("part", table(spark, sf_dir, "part"), "p_partkey")
            .distinct(["p_brand"]).edges())


# -- forms of provenance -------------------------------------------------------------------

@query("""select e.event_type, t.total, 'events' as src, e.event_id as rid from events e
join (select event_type, round(sum(value), 2) as total from events group by 1) t using (event_type)""")
def prov_collect_long(spark, sf_dir):
    out = events(spark, sf_dir).group_agg("event_type", {"total": agg.total("value")})
    return rounded(out.with_provenance(), 2, "total")


@query("""select user_id, string_agg(event_id, ',' order by event_id) as ids from (
  select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) rn
  from events) where rn <= 3 group by user_id""")
def prov_collect_array(spark, sf_dir):
    """Sets as arrays, for an influence that bounds their size."""
    edges = events(spark, sf_dir).group_agg("user_id", {"total": agg.total("value")}, Top(3)).edges()
    return edges.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("rid")), ",").alias("ids"))


@query("select event_type, count(*) as ids from events where value > 20 group by 1")
def prov_size(spark, sf_dir):
    edges = (events(spark, sf_dir).group_agg("event_type", {"total": agg.total("value")},
                                             Where(lambda v: v > 20)).edges())
    return provenance_size(edges, ["event_type"])


@query("""select event_type, count(*) as ids from events group by 1
union all select 'any', count(*) from events""")
def prov_bitmap(spark, sf_dir):
    edges = events(spark, sf_dir).group_agg("event_type", {"total": agg.total("value")}).edges()
    bitmaps = provenance_bitmap(edges, ["event_type"])
    any_type = bitmap_union(bitmaps.withColumn("event_type", F.lit("any")), ["event_type"])
    return bitmap_size(bitmaps.unionByName(any_type), ["event_type"])


@query("""select l_returnflag, count(*) as ids, bool_and(l_quantity > 10) as contained from (select distinct l_returnflag, l_orderkey, l_linenumber,
  l_partkey, l_suppkey, l_extendedprice, l_quantity from lineitem) group by 1""")
def prov_bitmap_lineitem(spark, sf_dir):
    """Bitmaps over a five-column id, by its number in the source's dictionary."""
    ctx = TraceContext(spark)
    frame = ctx.source("lineitem", table(spark, sf_dir, "lineitem"), LINEITEM_ID)

    def sets(least):
        edges = frame.group_agg("l_returnflag", {"qty": agg.total("l_quantity")}, Where(lambda v: v > least)).edges()
        return provenance_bitmap(number_ids(edges, ctx.id_dictionary("lineitem"), LINEITEM_ID), ["l_returnflag"])

    everything = sets(0)
    return bitmap_size(everything, ["l_returnflag"]).join(bitmap_contains(sets(10), everything, ["l_returnflag"]), "l_returnflag")


@query("""select event_type, bool_and(value > 50) as large_in_medium, bool_and(value > 200) as medium_in_large
from events where value > 100 group by 1""")
def prov_contains(spark, sf_dir):
    def above(limit):
        return events(spark, sf_dir).group_agg(
            "event_type", {"total": agg.total("value")}, Where(lambda v: v > limit)).edges()

    key = ["event_type"]
    inside = contains_all(above(50), above(100), key).withColumnRenamed("contained", "large_in_medium")
    outside = contains_all(above(200), above(100), key).withColumnRenamed("contained", "medium_in_large")
    return inside.join(outside, "event_type")


# -- aggregates ----------------------------------------------------------------------------

@query("select event_type, round(sum(value), 2) as total from events group by 1")
def agg_sum_all(spark, sf_dir):
    return rounded(events(spark, sf_dir).group_agg("event_type", {"total": agg.total("value")}).df, 2, "total")


@query("select event_type, round(avg(value), 8) as mean from events group by 1")
def agg_avg_all(spark, sf_dir):
    return rounded(events(spark, sf_dir).group_agg("event_type", {"mean": agg.average("value")}).df, 8, "mean")


@query("""select event_type, count(value) as n, round(avg(value), 6) as mean, round(var_pop(value), 6) as variance
from events group by 1""")
def agg_custom_fold(spark, sf_dir):
    """A fold with its own state (count, mean, squared deviations), merged in parallel."""
    out = events(spark, sf_dir).fold_agg(
        "event_type", moments_of(F.col("value")), combine_moments,
        {"n": F.col("n"), "mean": F.when(F.col("n") > 0, F.col("mean")),
         "variance": F.when(F.col("n") > 0, F.col("m2") / F.col("n"))}, uses=["value"])
    return rounded(out.df, 6, "mean", "variance")


@query("select event_type, round(max(value) - min(value), 6) as delta from events group by 1")
def agg_minmax_delta(spark, sf_dir):
    return rounded(events(spark, sf_dir).group_agg("event_type", {"delta": agg.spread("value")}).df, 6, "delta")


@query("""select user_id, round(var_samp(value), 6) as sample_variance, round(var_pop(value), 6) as variance
from events group by 1""")
def agg_var_samp(spark, sf_dir):
    out = events(spark, sf_dir).group_agg("user_id", {
        "sample_variance": agg.sample_variance("value"), "variance": agg.population_variance("value")})
    return rounded(out.df, 6, "sample_variance", "variance")


@query("""select event_type, count(*) as n, count(distinct user_id) as users from events group by 1""")
def agg_counts(spark, sf_dir):
    return events(spark, sf_dir).group_agg(
        "event_type", {"n": agg.rows(), "users": agg.distinct_values("user_id")}).df


@query("select user_id, count(*) as n from events group by 1 having count(*) > 66")
def agg_having(spark, sf_dir):
    return events(spark, sf_dir).group_agg("user_id", {"n": agg.rows()}).where(F.col("n") > 66).df


@query("""select e.user_id, 'events' as src, e.event_id as rid from events e
join (select user_id from events group by 1 having count(*) > 66) k on k.user_id = e.user_id""")
def prov_having(spark, sf_dir):
    """Lineage of the groups that survive a filter after the aggregation."""
    out = events(spark, sf_dir).group_agg("user_id", {"n": agg.rows()}).where(F.col("n") > 66)
    return out.edges(keep=["user_id"])


@query("""select event_type, coalesce(round(sum(value) filter (where value > 100), 2), 0) as total
from events group by 1""")
def agg_conditional_sum(spark, sf_dir):
    out = events(spark, sf_dir).group_agg(
        "event_type", {"total": agg.total_where("value", F.col("value") > 100)})
    return rounded(out.df, 2, "total")


@query("""select event_type, event_id, value, count(*) over (partition by event_type) as size from events""")
def agg_group_elements(spark, sf_dir):
    """Every element with its own id and the size of its group, as keyed rows (no group is gathered)."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    stats = group_stats(rows, ["event_type"], {"size": F.count(F.lit(1))})
    return attach_stats(rows, stats, ["event_type"], ["event_id"]).drop("__n")


def user_means(spark, sf_dir, column_lineage=False):
    """First level of the two-level queries: mean value per user, keyed by the user's bucket."""
    return (events(spark, sf_dir, column_lineage)
            .group_agg("user_id", {"mean": agg.average("value")}, name="user means")
            .select("mean", bucket=F.col("user_id") % 10).named("user means"))


@query("""select bucket, round(avg(mean), 8) as mean, round(var_pop(mean), 8) as variance from (
  select user_id % 10 as bucket, avg(value) as mean from events group by user_id) group by 1""")
def agg_two_level(spark, sf_dir):
    out = user_means(spark, sf_dir).group_agg(
        "bucket", {"mean": agg.average("mean"), "variance": agg.population_variance("mean")})
    return rounded(out.df, 8, "mean", "variance")


@query("""with m as (select user_id, user_id % 10 as bucket, avg(value) as mean from events group by user_id),
r as (select user_id, row_number() over (partition by bucket order by mean, user_id) rn from m where bucket = 3)
select event_id from events where user_id in (select user_id from r where rn <= 5)""")
def trace_two_level(spark, sf_dir):
    """From one bucket to its five lowest user means, and on to the events behind those."""
    out = user_means(spark, sf_dir).group_agg("bucket", {"mean": agg.average("mean")}, Bottom(5))
    return out.trace(F.col("bucket") == 3).ids()


@query("""with m as (select user_id, user_id % 10 as bucket, avg(value) as mean from events group by user_id),
r as (select *, row_number() over (partition by bucket order by mean) lo,
  row_number() over (partition by bucket order by mean desc) hi from m)
select bucket, round(avg(mean) filter (where lo <= 5), 8) as low_mean,
  round(avg(mean) filter (where hi <= 5), 8) as high_mean from r group by 1""")
def agg_topbottom_mean(spark, sf_dir):
    return rounded(user_means(spark, sf_dir).top_bottom_mean("bucket", "mean").df, 8, "low_mean", "high_mean")


@query("""select event_type, round(max(total), 2) as peak from (
  select event_type, day(ts) as day, sum(value) as total from events group by 1, 2) group by 1""")
def agg_sum_then_max(spark, sf_dir):
    sums = events(spark, sf_dir).select("event_type", "value", day=F.dayofmonth("ts")).group_agg(
        ["event_type", "day"], {"total": agg.total("value")})
    return rounded(sums.group_agg("event_type", {"peak": agg.largest("total")}).df, 2, "peak")


# -- splits used by the minimizer ----------------------------------------------------------

@query("""select event_id, cast(floor((row_number() over (order by event_id) - 1) * 8
  // (select count(*) from events)) as integer) as part from events""")
def dd_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return split_equal(with_position(rows, ["event_id"]), 8, rows.count()).drop("pos")


@query("""with p as (select event_id, (row_number() over (order by event_id) - 1)
  / cast((select count(*) from events) as double) as share from events)
select event_id, case when share < 0.125 then 0 when share < 0.25 then 1 when share < 0.75 then 2 else 3 end
  as part from p""")
def dd_weighted_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return split_weighted(with_position(rows, ["event_id"]), [1, 1, 4, 2], rows.count()).drop("pos")


@query("""with p as (select event_id, (row_number() over (order by event_id) - 1) * 8
  // (select count(*) from events) as part from events) select event_id from p where part <> 2""")
def dd_complement(spark, sf_dir):
    """All rows but one part, by id: equal rows are not confused."""
    rows = table(spark, sf_dir, "events").select("event_id")
    parts = split_equal(with_position(rows, ["event_id"]), 8, rows.count())
    return rows.join(parts.where(F.col("part") == 2), "event_id", "left_anti")
