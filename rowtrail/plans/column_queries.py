"""Column-level lineage: every result column has its own set of inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail.functions import scalar
from rowtrail.operators import aggregates as agg
from rowtrail.operators.influence import Bottom, Top, Union
from rowtrail.plans.base import events, query, rounded, table
from rowtrail.plans.lineage_queries import user_means

_ENDS = """with r as (select event_type, event_id, row_number() over (partition by event_type order by value, event_id) lo,
  row_number() over (partition by event_type order by value desc, event_id) hi from events)"""


def _low_high(spark, sf_dir):
    return events(spark, sf_dir, column_lineage=True).group_agg(
        "event_type", {"lo": agg.smallest("value"), "hi": agg.largest("value")})


@query(f"""{_ENDS}
select event_type, 'lo' as out_col, 'events' as src, event_id as rid from r where lo = 1
union all select event_type, unnest(['hi', 'doubled']), 'events', event_id from r where hi = 1
union all select event_type, 'width', 'events', event_id from r where lo = 1 or hi = 1""")
def col_derive(spark, sf_dir):
    frame = (_low_high(spark, sf_dir).derive("width", F.col("hi") - F.col("lo"), uses=["hi", "lo"])
             .derive("doubled", F.col("hi") * 2, uses=["hi"]))
    return frame.edges(by_column=True)


@query("""with r as (select event_type, event_id, row_number() over (partition by event_type order by props, event_id) lo,
  row_number() over (partition by event_type order by value desc, event_id) hi from events)
select event_type, unnest(['first', 'digits', 'size']) as out_col, 'events' as src, event_id as rid from r where lo = 1
union all select event_type, 'whole', 'events', event_id from r where hi = 1
union all select event_type, 'text', 'events', event_id from r where lo = 1 or hi = 1""")
def col_string(spark, sf_dir):
    """String functions and casts keep the lineage of their arguments."""
    frame = events(spark, sf_dir, column_lineage=True).group_agg(
        "event_type", {"first": agg.smallest("props"), "hi": agg.largest("value")})
    frame = (frame.derive("digits", F.regexp_extract("first", "([0-9]+)", 1).try_cast("int"), uses=["first"])
             .derive("size", F.length("first"), uses=["first"])
             .derive("whole", F.col("hi").cast("int"), uses=["hi"])
             .derive("text", F.substring(F.col("first"), F.lit(1), F.col("whole")), uses=["first", "whole"]))
    return frame.edges(by_column=["first", "digits", "size", "whole", "text"])


@query(f"""{_ENDS}
select event_type, 'label' as out_col, 'events' as src, event_id as rid from r where hi = 1
union all select event_type, 'price', 'events', event_id from r where lo = 1 or hi = 1""")
def col_branch(spark, sf_dir):
    """A constant picked by a branch depends on what the branch looked at."""
    frame = (_low_high(spark, sf_dir)
             .derive_when("label", [(F.col("hi") > 400, F.lit("wide"))], F.lit("narrow"), uses=["hi"])
             .derive_when("price", [(F.col("label") == "wide", F.col("lo") * 3)], F.lit(1.0),
                          uses=["label", "lo"]))
    return frame.edges(by_column=["label", "price"])


_USER_ENDS = """with r as (select user_id, event_id, value, row_number() over (partition by user_id order by value, event_id) lo,
  row_number() over (partition by user_id order by value desc, event_id) hi from events),
m as (select user_id, min(value) as low, max(value) as high from events group by 1)"""


def _user_ends(spark, sf_dir):
    return events(spark, sf_dir, column_lineage=True).group_agg(
        "user_id", {"low": agg.smallest("value"), "high": agg.largest("value")})


@query(f"""{_USER_ENDS} select user_id, 'least' as out_col, 'events' as src, event_id as rid from r join m using (user_id)
where (hi = 1 and high <= 200 + 9 * low) or (lo = 1 and 200 + 9 * low < high)
union all select user_id, 'greatest', 'events', event_id from r join m using (user_id)
where (hi = 1 and high >= 200 + 9 * low) or (lo = 1 and 200 + 9 * low > high)
union all select user_id, 'equal', 'events', event_id from r where lo = 1""")
def col_least(spark, sf_dir):
    """The smaller of two values is explained by the one that was chosen; of equal ones by the first."""
    frame = _user_ends(spark, sf_dir).derive("bound", F.col("low") * 9 + 200, uses=["low"])
    frame = (frame.derive("same", F.col("bound"), uses=["high"])
             .derive_least("least", ["high", "bound"]).derive_greatest("greatest", ["high", "bound"])
             .derive_least("equal", ["bound", "same"]))
    return frame.edges(by_column=["least", "greatest", "equal"])


@query(f"""{_USER_ENDS} select user_id, 'label' as out_col, 'events' as src, event_id as rid from r join m using (user_id)
where hi = 1 or (lo = 1 and high <= 250)
union all select user_id, 'price', 'events', event_id from r join m using (user_id)
where hi = 1 or (lo = 1 and high <= 250 and low < 0.5)""")
def col_branch_taken(spark, sf_dir):
    """A value chosen by conditions is explained by the branch taken and the conditions looked at."""
    frame = _user_ends(spark, sf_dir).derive_branch(
        "label", [(F.col("high") > 250, F.lit("high"), ["high"], []), (F.col("low") < 0.5, F.lit("low"), ["low"], [])], F.lit("even"), [])
    frame = frame.derive_branch("price", [(F.col("high") > 250, F.col("high") * 2, ["high"], ["high"]),
                                          ((F.col("high") <= 250) & (F.col("low") < 0.5), F.col("low") * 3, ["high"], ["low"])], F.lit(1.0), [])
    return frame.edges(by_column=["label", "price"])


@query(f"""{_ENDS} select event_type, 'delta' as out_col, 'events' as src, event_id as rid
from r where lo = 1 or hi = 1""")
def col_minmax_delta(spark, sf_dir):
    frame = events(spark, sf_dir, column_lineage=True).group_agg("event_type", {"delta": agg.spread("value")})
    return frame.edges(by_column=True)


_MEANS = """with m as (select user_id, user_id % 10 as bucket, avg(value) as mean from events group by user_id),
r as (select *, row_number() over (partition by bucket order by mean, user_id) lo,
  row_number() over (partition by bucket order by mean desc, user_id) hi from m)"""


@query(f"""{_MEANS} select bucket, 'low_mean' as out_col, 'events' as src, event_id as rid
from r join events using (user_id) where lo <= 5
union all select bucket, 'high_mean', 'events', event_id from r join events using (user_id) where hi <= 5""")
def col_topbottom_mean(spark, sf_dir):
    frame = user_means(spark, sf_dir, column_lineage=True).top_bottom_mean("bucket", "mean")
    return frame.edges(by_column=True)


@query("""with m as (select user_id, user_id % 10 as bucket, avg(value) as mean from events group by user_id),
k as (select *, row_number() over (partition by bucket order by mean, user_id) lo,
  row_number() over (partition by bucket order by mean desc, user_id) hi from m),
e as (select user_id, event_id, row_number() over (partition by user_id order by value, event_id) lo,
  row_number() over (partition by user_id order by value desc, event_id) hi from events)
select bucket, 'delta' as out_col, 'events' as src, event_id as rid from k join e using (user_id)
where (k.lo = 1 or k.hi = 1) and (e.lo <= 2 or e.hi <= 2)""")
def col_promote(spark, sf_dir):
    """Row lineage of the user means (their extremes) becomes the lineage of the mean's value."""
    means = (events(spark, sf_dir).group_agg("user_id", {"mean": agg.average("value")},
                                             Union(Top(2), Bottom(2)), name="user means")
             .select("mean", bucket=F.col("user_id") % 10))
    return means.promote().group_agg("bucket", {"delta": agg.spread("mean")}).edges(by_column=True)


@query(f"{_ENDS} select event_type, 'events' as src, event_id as rid from r where lo = 1 or hi = 1")
def col_to_row(spark, sf_dir):
    """The lineage of a row is the union over its columns."""
    return _low_high(spark, sf_dir).edges()


# -- scalar functions under lineage --------------------------------------------------------

@query("""select event_id, length(props) as len, split_part(props, ':', 2) as tail,
  case when instr(reverse(props), '"') = 0 then -1 else length(props) - instr(reverse(props), '"') end as last_quote,
  substring(event_type, 2, 3) as middle, trim('  ' || event_type || ' ') as trimmed,
  try_cast(event_type as integer) as number, try_cast('1' || cast(user_id as varchar) as double) as parsed,
  event_type = 'click' as is_click, regexp_extract(event_type, '^([^0-9]*)', 1) as dept,
  'events' as src, event_id as rid from events""")
def fn_string(spark, sf_dir):
    text, kind = F.col("props"), F.col("event_type")
    frame = events(spark, sf_dir).select(
        "event_id", len=F.length(text), tail=F.split_part(text, F.lit(":"), F.lit(2)),
        last_quote=scalar.last_index_of(text, '"'), middle=F.substring(kind, 2, 3),
        trimmed=F.trim(F.concat(F.lit("  "), kind, F.lit(" "))), number=kind.try_cast("int"),
        parsed=F.concat(F.lit("1"), F.col("user_id").cast("string")).try_cast("double"),
        is_click=kind == "click", dept=scalar.department(kind))
    return frame.with_provenance()


_MATH = [
    ("f_sin", F.sin, "sin(x)"), ("f_cos", F.cos, "cos(x)"), ("f_tan", F.tan, "tan(x)"),
    ("f_asin", lambda x: F.asin(x / 1000), "asin(x / 1000)"), ("f_acos", lambda x: F.acos(x / 1000), "acos(x / 1000)"),
    ("f_atan", F.atan, "atan(x)"), ("f_atan2", lambda x: F.atan2(x, F.lit(3.0)), "atan2(x, 3)"),
    ("f_hypot", lambda x: F.hypot(x, F.lit(4.0)), "sqrt(x * x + 16)"),
    ("f_radians", F.radians, "radians(x)"), ("f_degrees", F.degrees, "degrees(x)"),
    ("f_sinh", lambda x: F.sinh(x / 100), "(exp(x / 100) - exp(-x / 100)) / 2"),
    ("f_cosh", lambda x: F.cosh(x / 100), "(exp(x / 100) + exp(-x / 100)) / 2"),
    ("f_tanh", lambda x: F.tanh(x / 100), "(exp(x / 50) - 1) / (exp(x / 50) + 1)"),
    ("f_ceil", lambda x: F.ceil(x).cast("double"), "ceil(x)"), ("f_floor", lambda x: F.floor(x).cast("double"), "floor(x)"),
    ("f_rint", F.rint, "round_even(x, 0)"), ("f_abs", lambda x: F.abs(x - 50), "abs(x - 50)"),
    ("f_signum", lambda x: F.signum(x - 50), "cast(sign(x - 50) as double)"),
    ("f_sqrt", F.sqrt, "sqrt(x)"), ("f_cbrt", F.cbrt, "cbrt(x)"), ("f_pow", lambda x: F.pow(x, F.lit(1.5)), "pow(x, 1.5)"),
    ("f_exp", lambda x: F.exp(x / 100), "exp(x / 100)"), ("f_expm1", lambda x: F.expm1(x / 100), "exp(x / 100) - 1"),
    ("f_log", scalar.natural_log, "ln(x)"), ("f_log1p", F.log1p, "ln(1 + x)"), ("f_log10", scalar.log_base_10, "log10(x)"),
    ("f_least", lambda x: F.least(x, F.lit(50.0)), "least(x, 50.0)"),
    ("f_greatest", lambda x: F.greatest(x, F.lit(50.0)), "greatest(x, 50.0)"),
    ("f_e_pi", lambda x: F.e() * F.pi() * x, "exp(1) * pi() * x"),
]


@query("select event_id, " + ", ".join(f"round(cast({sql} as double), 5) as {name}" for name, _, sql in _MATH)
       + ", 'events' as src, event_id as rid from (select event_id, value as x from events)")
def fn_math(spark, sf_dir):
    frame = events(spark, sf_dir).select("event_id", x=F.col("value")).with_columns(
        {name: F.round(fn(F.col("x")).cast("double"), 5) for name, fn, _ in _MATH}, uses=["x"])
    return frame.select("event_id", *[name for name, _, _ in _MATH]).with_provenance()


@query("""select event_id, d // 7 as div7, d % 7 as rem7, cast(floor(d / 7.0) as bigint) as floor_div7,
  ((d % 7) + 7) % 7 as floor_mod7, d + 1 as added, cast(d as integer) as narrowed
from (select event_id, user_id - 70 as d from events)""")
def fn_integer(spark, sf_dir):
    seven = F.lit(7).cast("bigint")
    d = F.col("d")
    return events(spark, sf_dir).select("event_id", d=F.col("user_id") - 70).select(
        "event_id", div7=scalar.int_div(d, seven), rem7=d % 7, floor_div7=scalar.floor_div(d, seven),
        floor_mod7=scalar.floor_mod(d, seven), added=d + 1, narrowed=d.cast("int")).df


_GPA_SQL = "case " + " ".join(f"when g >= {low} then {points}" for low, points in scalar.GPA_STEPS) + " else 0.0 end"


@query(f"""select event_id, cast({_GPA_SQL} as double) as points, case when g > 40 then 'car' when g > 15 then 'public'
  else 'onfoot' end as class, cast((90000 + g) % 50 as varchar) as state,
  case when (g * 7) % 1440 - (g * 13) % 1440 < 0 then 1440 + (g * 7) % 1440 - (g * 13) % 1440
  else (g * 7) % 1440 - (g * 13) % 1440 end as stay
from (select event_id, user_id % 100 as g from events)""")
def fn_domain(spark, sf_dir):
    def clock(minutes):
        return F.concat_ws(":", scalar.int_div(minutes, F.lit(60)), minutes % 60)

    g = F.col("g")
    return events(spark, sf_dir).select("event_id", g=F.col("user_id") % 100).select(
        "event_id", points=scalar.grade_points(g), **{"class": scalar.travel_class(g)},
        state=scalar.zip_to_state((g + 90000).cast("string")),
        stay=scalar.minutes_between(clock(g * 13 % 1440), clock(g * 7 % 1440)).cast("bigint")).df
