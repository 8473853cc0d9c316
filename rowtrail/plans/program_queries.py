"""The fixtures and the fault-tracing programs, over tables derived row by row from a given one."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail.functions.scalar import GPA_STEPS
from rowtrail.operators.influence import Outlier
from rowtrail.plans import programs
from rowtrail.plans.base import add, query, rounded, table
from rowtrail.scratch import materialize, shuffle_width
from rowtrail.sources import fixtures as fx
from rowtrail.sources.registry import TraceContext

_P = 2147483647


def _mix(ident: str, salt: int) -> str:
    first = f"((({ident}) % {_P} + {salt * 7919}) * 48271 % {_P})"
    second = f"(xor({first}, {first} >> 13) * 69621 % {_P})"
    return f"xor({second}, {second} >> 11)"


def _draws(count: int) -> str:
    return ", ".join(f"{_mix('id', s)} as m{s}" for s in range(1, count + 1))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _ids(spark, sf_dir, name="orders", key="o_orderkey"):
    return table(spark, sf_dir, name).select(F.col(key).alias("id"))


_ORDERS = "select o_orderkey as id from orders"

WEATHER = f"""d as (select id, {_draws(8)} from ({_ORDERS})),
z as (select *, cast(10000 + m1 % 90000 as varchar) as zip from d),
l as (select *, left(zip, 1) in ('3', '7', '9') as low from z),
h as (select *, case when low then m7 % 50 else m7 % 1300 end as q from l),
weather as (select id, zip, (1 + m2 % 30) || '/' || (1 + m3 % 12) || '/' || (1900 + m4 % 117) as date,
  case when m5 % 500 = 0 then '90in' when m8 % 2 = 0 then (case when low then m6 % 160 else m6 % 4000 end) || 'mm'
    else (q // 100) || '.' || lpad(cast(q % 100 as varchar), 2, '0') || 'ft' end as snow,
  m5 % 500 = 0 as is_fault from h)"""

AIRPORT = f"""d as (select id, {_draws(11)} from ({_ORDERS})),
c as (select *, (10 + m4 % 8) || '' || (10 + m5 % 8) || '' || (10 + m6 % 8) as passenger,
  (m7 % 24) * 60 + m8 % 60 + 30 * (1 + m9 % 4) as leave, m11 % 50 = 0 as is_fault from d),
airport as (select id, (1 + m1 % 12) || '/' || (m2 % 31) || '/' || (10 + m3 % 8) as date, passenger,
  case when is_fault then passenger || ':0' else (m7 % 24) || ':' || (m8 % 60) end as arrival,
  (leave // 60 % 24) || ':' || (leave % 60) as departure, {_list(fx.AIRPORTS)}[m10 % 16 + 1] as airport,
  is_fault from c)"""

TRIPS = f"""d as (select id, {_draws(5)} from ({_ORDERS})),
b as (select *, abs((m1 % 100) - (m2 % 100)) * 100 + m3 % 10 as dist from d),
t as (select *, greatest(dist // (10 + m4 % 50), 1) as time from b),
f as (select *, dist // time > 40 and m5 % 100 = 0 as is_fault from t),
trips as (select id, 'sr' as mode, cast(90000 + m1 % 100 as varchar) as zip_from,
  cast(90000 + m2 % 100 as varchar) as zip_to,
  cast(dist + case when is_fault then 600 * time else 0 end as integer) as distance,
  cast(time as integer) as time, is_fault from f)"""

STUDENTS = f"""d as (select id, {_draws(6)} from ({_ORDERS})),
f as (select *, m4 % 4 = 2 and m5 % 200 = 0 as is_fault from d),
students as (select id, cast(m1 % 99999999 as integer) as student_id, {_list(fx.MAJORS)}[m2 % 10 + 1] as major,
  {_list(fx.GENDERS)}[m3 % 2 + 1] as gender, {_list(fx.YEARS)}[m4 % 4 + 1] as year,
  cast(case when is_fault then m1 % 99999999 else 15 + m6 % 6 + 2 * (m4 % 4) end as integer) as age,
  is_fault from f)"""

_COURSE = f"""({_list(fx.DEPARTMENTS)}[(m2 % 990) // 198 + 1]
  || cast(case when m2 % 198 < 99 then m2 % 198 + 1 else m2 % 198 + 2 end as varchar))"""

GRADES = f"""d as (select id, {_draws(3)} from ({_ORDERS})),
e as (select *, {_COURSE} as course from d),
grades as (select id, cast(10 + m1 % 190 as integer) as student_id, course,
  cast(case when course in ('CS9', 'CS11') then 85 + m3 % 25 else 65 + m3 % 35 end as integer) as grade,
  course in ('CS9', 'CS11') as is_fault from e)"""

ZEROS = f"""d as (select id, {_draws(6)} from ({_ORDERS})),
e as (select *, case when m4 % 75 = 0 then {_list(fx.ZEROED_COURSES)}[m5 % 2 + 1] else {_COURSE} end as course,
  m4 % 75 = 0 and m6 % 100 < 15 as is_fault from d),
grades as (select id, cast(10 + m1 % 190 as integer) as student_id, course,
  cast(case when is_fault then 0 else 65 + m3 % 35 end as integer) as grade, is_fault from e)"""

EXAMS = f"""d as (select id, {_draws(3)} from (select c_custkey as id from customer)),
i as (select id, case when m1 % 2 = 0 then 'EE' else 'CS' end || cast(30 + m2 % 570 as varchar) as course,
  unnest(range(0, 11 + m3 % 190)) as i from d),
exams as (select id, course, course || ':' || cast(10 + {_mix('id * 256 + i', 4)} % 90 as varchar) as item from i)"""

NUMBERS = f"""d as (select id, {_draws(2)} from ({_ORDERS})),
numbers as (select id, ['a', 'b', 'c', 'q'][m1 % 4 + 1] as key, cast(1 + m2 % 1111199 as integer) as value from d)"""


_FIXTURES = {
    "weather": lambda ids: fx.weather(ids, fault_one_in=500),
    "airport": lambda ids: fx.airport(ids, fault_one_in=50),
    "trips": lambda ids: fx.trips(ids, fault_one_in=100),
    "students": lambda ids: fx.student_info(ids, fault_one_in=200),
    "grades": fx.grades,
    "grades_with_zeros": fx.grades_with_zeros,
}


def _fixture(spark, sf_dir, name):
    return _FIXTURES[name](_ids(spark, sf_dir))


def _stored(spark, sf_dir, name):
    """The fixture as a program reads it: generated once and written."""
    return materialize(_fixture(spark, sf_dir, name), name)


def _exams(spark, sf_dir):
    """Up to 200 items a row: the ids are dealt to all tasks, as a file of many may be one split."""
    tasks = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    return fx.student_grades(_ids(spark, sf_dir, "customer", "c_custkey").repartition(tasks))


# -- fixtures ------------------------------------------------------------------------------

for _name, _make, _sql in [
    ("fix_weather", lambda s, d: _fixture(s, d, "weather"), f"with {WEATHER} select * from weather"),
    ("fix_airport", lambda s, d: _fixture(s, d, "airport"), f"with {AIRPORT} select * from airport"),
    ("fix_trips", lambda s, d: _fixture(s, d, "trips"), f"with {TRIPS} select * from trips"),
    ("fix_zipcode", lambda s, d: fx.zip_areas(_fixture(s, d, "trips")),
     f"with {TRIPS} select zip, cast(cast(zip as integer) % 100 as varchar) as area from "
     "(select zip_from as zip from trips union select zip_to from trips)"),
    ("fix_student_info", lambda s, d: _fixture(s, d, "students"), f"with {STUDENTS} select * from students"),
    ("fix_grades", lambda s, d: _fixture(s, d, "grades"), f"with {GRADES} select * from grades"),
    ("fix_grades_with_zeros", lambda s, d: _fixture(s, d, "grades_with_zeros"), f"with {ZEROS} select * from grades"),
    ("fix_student_grades", lambda s, d: _exams(s, d).select("id", F.explode("grades").alias("item")),
     f"with {EXAMS} select id, item from exams"),
    ("fix_keyed_numbers", lambda s, d: fx.keyed_numbers(_ids(s, d)), f"with {NUMBERS} select * from numbers"),
]:
    add(_name, _make, _sql)


@query(f"""with d as (select id, {_draws(9)} from ({_ORDERS})),
g as (select *, 1 + m5 % 4 as grade from d),
a as (select *, 17 + grade + m6 % 2 as age, grade = 3 and m7 % 100 = 0 as is_fault from g)
select id, substring(translate(lpad(cast(m1 % {_P} as varchar), 10, '0'), '0123456789', 'abcdefghij'), 3, 3 + m2 % 5) || ' ' ||
  substring(translate(lpad(cast(m3 % {_P} as varchar), 10, '0'), '0123456789', 'abcdefghij'), 3, 3 + m4 % 5) || ' ' ||
  {_list(fx.GENDERS)}[m8 % 2 + 1] || ' ' || (case when is_fault then age * 101 else age end) || ' ' || grade || ' ' ||
  {_list(fx.MAJORS)}[m9 % 10 + 1] as value, is_fault from a""")
def fix_student_info_lines(spark, sf_dir):
    return fx.student_info_lines(_ids(spark, sf_dir), fault_one_in=100)


# -- programs ------------------------------------------------------------------------------

def _score_sql(tables: str, source: str, outputs: str, failing: str, traced: str, fault: str) -> str:
    """Metrics of a trace in SQL: ``outputs`` and ``traced`` (ids) are queries over ``tables``."""
    return f"""with {tables}, o as ({outputs}), x as (select distinct id from ({traced})),
counts as (select count(*) as input_count, count(*) filter (where {fault}) as fault_count,
  (select count(*) from x) as trace_count,
  count(*) filter (where ({fault}) and id in (select id from x)) as correct_count from {source})
select input_count, (select count(*) from o) as output_count, (select count(*) from o where {failing}) as target_count,
  fault_count, trace_count, correct_count, fault_count - correct_count as missing_count,
  trace_count - correct_count as extra_count,
  round(case when trace_count > 0 then correct_count / trace_count end, 8) as "precision",
  round(case when fault_count > 0 then correct_count / fault_count end, 8) as recall, correct_count as "yield" from counts"""


def _score(program: programs.Program):
    return rounded(program.score(), 8, "precision", "recall")


_SNOW = f"""{WEATHER},
s as (select id, date, zip, snow, case when suffix(snow, 'mm') then cast(left(snow, length(snow) - 2) as float)
  else cast(left(snow, length(snow) - 2) as float) * cast(304.8 as float) end as mm,
  length(date) - instr(reverse(date), '/') as cut from weather),
k as (select id, snow, mm, cast(cast(zip as integer) % 50 as varchar) as state,
  unnest([left(date, cut), substring(date, cut + 1)]) as key from s)"""


@query(f"with {_SNOW} select key, round(cast(max(mm) - min(mm) as double), 3) as delta from k group by key")
def prog_snow_delta(spark, sf_dir):
    program = programs.snow_delta(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id")
    return program.output.df.select("key", F.round(F.col("delta").cast("double"), 3).alias("delta"))


_SNOW_OUT = "select key, max(mm) - min(mm) as delta from k group by key"
_SNOW_RANKS = """select *, row_number() over (partition by key order by mm, id) lo,
  row_number() over (partition by key order by mm desc, id) hi from k where key in (select key from o where delta > 6000)"""


@query(_score_sql(_SNOW, "weather", _SNOW_OUT, "delta > 6000",
                  f"select id from ({_SNOW_RANKS}) where lo = 1 or hi = 1", "snow = '90in'"))
def prog_snow_delta_score(spark, sf_dir):
    return _score(programs.snow_delta(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id"))


@query(_score_sql(_SNOW, "weather", _SNOW_OUT, "delta > 6000",
                  "select id from k where key in (select key from o where delta > 6000)", "snow = '90in'"))
def prog_snow_delta_rows_score(spark, sf_dir):
    """The same program with row lineage only: every reading under a failing key is suspicious."""
    return _score(programs.snow_delta(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id", column_lineage=False))


_VAR_OUT = "select key, var_samp(cast(mm as double)) as variance from k group by key"


def _far(key: str, value: str, rows: str, z: float = 3) -> str:
    """Ids at least ``z`` deviations from the mean of their group."""
    return (f"select id from (select id, {value} as v, avg({value}) over g as m, stddev_pop({value}) over g as sd, "
            f"min({value}) over g as v0, max({value}) over g as v1 from {rows} window g as (partition by {key})) "
            f"where v0 < v1 and sd > 0 and abs(v - m) / sd >= {z} * (1 - 1e-9)")


@query(f"with {_SNOW} select key, round(variance, 2) as variance from ({_VAR_OUT})")
def prog_snow_variance(spark, sf_dir):
    return rounded(programs.snow_variance(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id").output.df, 2, "variance")


@query(_score_sql(_SNOW, "weather", _VAR_OUT, "variance > 6000",
                  _far("key", "cast(mm as double)", "(select * from k where key in (select key from o where variance > 6000))"),
                  "snow = '90in'"))
def prog_snow_variance_score(spark, sf_dir):
    return _score(programs.snow_variance(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id"))


_STATE_MEANS = f"""{_SNOW},
a as (select key, state, avg(cast(mm as double)) as mean from k group by 1, 2)"""


@query(f"with {_STATE_MEANS} select state, round(max(mean) - min(mean), 3) as delta from a group by 1")
def prog_snow_state_range(spark, sf_dir):
    return rounded(programs.snow_state_range(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id").output.df, 3, "delta")


@query(f"""with {_STATE_MEANS},
b as (select *, row_number() over (partition by state order by mean, key, state) lo,
  row_number() over (partition by state order by mean desc, key, state) hi from a),
c as (select id, key, state, row_number() over (partition by key, state order by mm, id) lo,
  row_number() over (partition by key, state order by mm desc, id) hi from k)
select distinct b.state, 'delta' as out_col, 'weather' as src, c.id as rid
from b join c on b.key = c.key and b.state = c.state where (b.lo = 1 or b.hi = 1) and (c.lo <= 5 or c.hi <= 5)""")
def prog_snow_state_range_edges(spark, sf_dir):
    program = programs.snow_state_range(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id")
    return program.output.edges(by_column=True)


_SUMS = f"""{_SNOW},
a as (select state, key, sum(cast(mm as double)) as total from k group by 1, 2)"""
_PEAKS = "select state, max(total) as peak from a group by 1"


@query(f"with {_SUMS} select state, round(peak, 2) as peak from ({_PEAKS})")
def prog_snow_state_peak(spark, sf_dir):
    return rounded(programs.snow_state_peak(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id").output.df, 2, "peak")


@query(_score_sql(_SUMS, "weather", _PEAKS, "peak > 10000", """select k.id from k join (
  select state, key from (select *, row_number() over (partition by state order by total desc, state, key) r from a)
  where r = 1 and state in (select state from o where peak > 10000)) w on w.state = k.state and w.key = k.key""",
                  "snow = '90in'"))
def prog_snow_state_peak_score(spark, sf_dir):
    return _score(programs.snow_state_peak(TraceContext(spark), _stored(spark, sf_dir, "weather"), "id"))


_STAYS = f"""{AIRPORT},
t as (select id, airport, split_part(departure, ':', 1) as hour,
  cast(split_part(departure, ':', 1) as integer) * 60 + cast(split_part(departure, ':', 2) as integer)
  - cast(split_part(arrival, ':', 1) as integer) * 60 - cast(split_part(arrival, ':', 2) as integer) as m from airport),
a as (select id, airport, hour, case when m < 0 then m + 1440 else m end as stay from t),
s as (select * from a where stay < 45)"""
_STAY_OUT = "select airport, hour, cast(sum(stay) as bigint) as total from s group by 1, 2"


@query(f"with {_STAYS} {_STAY_OUT}")
def prog_airport_transit(spark, sf_dir):
    return programs.airport_transit(TraceContext(spark), _stored(spark, sf_dir, "airport"), "id").output.df


@query(_score_sql(_STAYS, "a", _STAY_OUT, "total < 0", _far(
    "airport, hour", "stay", "(select s.* from s join o on o.airport = s.airport and o.hour = s.hour where o.total < 0)"),
    "stay < 0"))
def prog_airport_transit_score(spark, sf_dir):
    return _score(programs.airport_transit(TraceContext(spark), _stored(spark, sf_dir, "airport"), "id"))


_CLASS = "case when speed > 40 then 'car' when speed > 15 then 'public' else 'onfoot' end"
_SPEEDS = f"{TRIPS}, s as (select *, distance // time as speed from trips), k as (select *, {_CLASS} as class from s)"
_CLASS_OUT = "select class, avg(speed) as mean from k group by 1"


@query(f"with {_SPEEDS} select class, round(mean, 8) as mean from ({_CLASS_OUT})")
def prog_commute_type(spark, sf_dir):
    return rounded(programs.commute_type(TraceContext(spark), _stored(spark, sf_dir, "trips"), "id").output.df, 8, "mean")


@query(_score_sql(_SPEEDS, "s", _CLASS_OUT, "class = 'car'", """select id from (select id, row_number() over
  (order by speed desc, id) r from k where class = 'car') where r <= 1000""", "speed > 500"))
def prog_commute_type_score(spark, sf_dir):
    return _score(programs.commute_type(TraceContext(spark), _stored(spark, sf_dir, "trips"), "id"))


def _commute_join(spark, sf_dir):
    trips = _stored(spark, sf_dir, "trips")
    return programs.commute_join(TraceContext(spark), trips, "id", fx.zip_areas(trips))


@query(f"with {_SPEEDS} select class, round(mean, 8) as mean from ({_CLASS_OUT})")
def prog_commute_join(spark, sf_dir):
    return rounded(_commute_join(spark, sf_dir).output.df, 8, "mean")


@query(_score_sql(_SPEEDS, "s", _CLASS_OUT, "class = 'car'", "select id from k where class = 'car'", "speed > 500"))
def prog_commute_join_score(spark, sf_dir):
    return _score(_commute_join(spark, sf_dir))


@query(f"with {_SPEEDS} select distinct zip_from as zip from k where class = 'car'")
def prog_commute_join_zips(spark, sf_dir):
    """The other side of the join: zip codes behind the same output."""
    return _commute_join(spark, sf_dir).trace().ids("zipcode")


_AGE_OUT = "select year, avg(age) as mean from students group by 1"


@query(f"with {STUDENTS} select year, round(mean, 6) as mean from ({_AGE_OUT})")
def prog_student_age(spark, sf_dir):
    return rounded(programs.student_age(TraceContext(spark), _stored(spark, sf_dir, "students"), "id").output.df, 6, "mean")


@query(_score_sql(STUDENTS, "students", _AGE_OUT, "mean > 30", _far(
    "year", "age", "(select * from students where year in (select year from o where mean > 30))"), "age > 30"))
def prog_student_age_score(spark, sf_dir):
    return _score(programs.student_age(TraceContext(spark), _stored(spark, sf_dir, "students"), "id"))


_RESULTS = f"""{EXAMS}, r as (select id, split_part(item, ':', 1) || case when cast(split_part(item, ':', 2) as integer) > 40
  then ' Pass' else ' Fail' end as result from exams)"""


@query(f"with {_RESULTS} select result, count(*) as exams from r group by 1 having count(*) > 1")
def prog_pass_fail(spark, sf_dir):
    return programs.pass_fail(TraceContext(spark), materialize(_exams(spark, sf_dir), "exams"), "id").output.df


@query(f"""with {_RESULTS} select distinct result, 'student_grades' as src, id as rid from r
where result in (select result from r group by 1 having count(*) > 1)""")
def prog_pass_fail_edges(spark, sf_dir):
    return programs.pass_fail(TraceContext(spark), materialize(_exams(spark, sf_dir), "exams"), "id").output.edges(keep=["result"])


_POINTS = "case " + " ".join(f"when grade >= {g} then {p}" for g, p in GPA_STEPS) + " else 0.0 end"
_GPA = f"""{GRADES}, p as (select id, course, trim(regexp_extract(course, '^([^0-9]*)', 1)) as dept,
  cast({_POINTS} as double) as points from grades),
c as (select course, dept, avg(points) as gpa from p group by 1, 2)"""
_GPA_OUT = "select dept, avg(gpa) as mean, var_pop(gpa) as variance from c group by 1"


@query(f"with {_GPA} select dept, round(mean, 6) as mean, round(variance, 6) as variance from ({_GPA_OUT})")
def prog_gpa_two_level(spark, sf_dir):
    out = programs.gpa_two_level(TraceContext(spark), _stored(spark, sf_dir, "grades"), "id").output
    return rounded(out.df, 6, "mean", "variance")


@query(_score_sql(_GPA, "grades", _GPA_OUT, "dept = 'CS'", """select id from p where course in (
  select course from (select course, gpa, avg(gpa) over () as m, stddev_pop(gpa) over () as sd from c where dept = 'CS')
  where sd > 0 and abs(gpa - m) / sd >= 3 * (1 - 1e-9))""", "course in ('CS9', 'CS11')"))
def prog_gpa_two_level_score(spark, sf_dir):
    return _score(programs.gpa_two_level(TraceContext(spark), _stored(spark, sf_dir, "grades"), "id"))


_GPA_VAR = "select dept, var_pop(points) as variance from p group by 1"


@query(f"with {_GPA} select dept, round(variance, 6) as variance from ({_GPA_VAR})")
def prog_gpa_variance(spark, sf_dir):
    out = programs.gpa_variance(TraceContext(spark), _stored(spark, sf_dir, "grades"), "id").output
    return rounded(out.df, 6, "variance")


@query(_score_sql(_GPA, "grades", _GPA_VAR, "variance > 0.96", _far(
    "dept", "points", "(select * from p where dept in (select dept from o where variance > 0.96))"),
    "course in ('CS9', 'CS11')"))
def prog_gpa_variance_score(spark, sf_dir):
    return _score(programs.gpa_variance(TraceContext(spark), _stored(spark, sf_dir, "grades"), "id"))


@query(_score_sql(_GPA.replace(GRADES, ZEROS), "grades", _GPA_VAR, "variance > 0.96", _far(
    "dept", "points", "(select * from p where dept in (select dept from o where variance > 0.96))", 2.5),
    "course in ('Physics 401', 'Physics 402') and grade = 0"))
def prog_gpa_variance_zeros_score(spark, sf_dir):
    """The same program where grades of zero widen the spread: faults that its outlier rule reaches."""
    return _score(programs.gpa_variance(TraceContext(spark), _stored(spark, sf_dir, "grades_with_zeros"), "id", Outlier(2.5),
                                        F.col("course").isin(fx.ZEROED_COURSES) & (F.col("grade") == 0)))


_COURSES = f"""{ZEROS}, p as (select id, course, grade, trim(regexp_extract(course, '^([^0-9]*)', 1)) as dept from grades),
c as (select dept, course, avg(grade) as mean from p group by 1, 2),
r as (select *, row_number() over (partition by dept order by mean, dept, course) lo,
  row_number() over (partition by dept order by mean desc, dept, course) hi from c)"""
_COURSE_OUT = """select dept, avg(mean) filter (where lo <= 5) as low_mean, avg(mean) filter (where hi <= 5) as high_mean
from r group by 1"""


@query(f"with {_COURSES} select dept, round(low_mean, 6) as low_mean, round(high_mean, 6) as high_mean from ({_COURSE_OUT})")
def prog_course_extremes(spark, sf_dir):
    out = programs.course_extremes(TraceContext(spark), _stored(spark, sf_dir, "grades_with_zeros"), "id").output
    return rounded(out.df, 6, "low_mean", "high_mean")


@query(_score_sql(_COURSES, "grades", _COURSE_OUT, "low_mean < 80 or high_mean > 85", """select e.id from (
  select id, course, row_number() over (partition by course order by grade, id) a,
    row_number() over (partition by course order by grade desc, id) b from p) e
  join r on r.course = e.course join o on o.dept = r.dept
  where (a <= 2 or b <= 2) and ((low_mean < 80 and lo <= 5) or (high_mean > 85 and hi <= 5))""",
                  "course in ('Physics 401', 'Physics 402') and grade = 0"))
def prog_course_extremes_score(spark, sf_dir):
    return _score(programs.course_extremes(
        TraceContext(spark), _stored(spark, sf_dir, "grades_with_zeros"), "id"))


@query("""with w as (select unnest(string_split(text, ' ')) as word from documents)
select word, count(*) as n from w group by 1""")
def prog_word_count(spark, sf_dir):
    return programs.word_count(TraceContext(spark), table(spark, sf_dir, "documents"), "doc_id").output.df


@query(f"with {NUMBERS} select key, cast(sum(value) filter (where value > 300) as bigint) as total from numbers group by 1")
def prog_keyed_conditional_sum(spark, sf_dir):
    return programs.keyed_conditional_sum(TraceContext(spark), materialize(fx.keyed_numbers(_ids(spark, sf_dir)), "numbers"), "id").output.df
