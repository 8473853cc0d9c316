"""Synthetic tables with planted faults, computed from an id column.

Every value is an arithmetic expression of the id, so the tables are the same for any
partitioning and any engine, and they grow with the table the ids come from (``spark.range(n)``
or a real one).  ``is_fault`` marks the planted faults; pipelines do not read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.functions.scalar import int_div
from rowtrail.operators.keyed import col

_PRIME = 2147483647

# Fixed values
AIRPORTS = ["LAX", "SFO", "JFK", "ORD", "MDW", "SEA", "SJC", "BNA", "LGA", "DAL", "FTW", "PHX",
            "BUR", "JAX", "ATL", "MNN"]
MAJORS = ["English", "Mathematics", "ComputerScience", "ElectricalEngineering", "Business",
          "Economics", "Biology", "Law", "PoliticalScience", "IndustrialEngineering"]
GENDERS = ["male", "female"]
YEARS = ["Freshman", "Sophomore", "Junior", "Senior"]
DEPARTMENTS = ["EE", "CS", "MATH", "Physics ", "STATS"]
INFLATED_COURSES = ["CS9", "CS11"]
ZEROED_COURSES = ["Physics 401", "Physics 402"]
LOW_SNOW_DIGITS = ["3", "7", "9"]


def _first(ident: Column, salt: int) -> Column:
    return ((ident.cast("bigint") % _PRIME) + salt * 7919) * 48271 % _PRIME


def _fold(number: Column, bits: int) -> Column:
    return number.bitwiseXOR(F.shiftright(number, bits))


def mix(ident: Column, salt: int) -> Column:
    """A well-spread number in [0, 2^31) from an id; different salts give unrelated numbers."""
    return _fold(_fold(_first(ident, salt), 13) * 69621 % _PRIME, 11)


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _base(ids: DataFrame, ident: str, draws: int) -> tuple[DataFrame, Callable[[int, int], Column]]:
    """The ids with ``draws`` numbers each; ``draw(i, below)`` is the i-th one, cut to a range.

    The steps of :func:`mix` are separate projections, so a number that is used several times is
    computed once and the generated code stays small.
    """
    salts = range(1, draws + 1)
    base = (ids.select(col(ident))
            .withColumns({f"__m{s}": _first(col(ident), s) for s in salts})
            .withColumns({f"__m{s}": _fold(col(f"__m{s}"), 13) * 69621 % _PRIME for s in salts})
            .withColumns({f"__m{s}": _fold(col(f"__m{s}"), 11) for s in salts}))
    return base, lambda salt, below: col(f"__m{salt}") % below


def weather(ids: DataFrame, ident: str = "id", fault_one_in: int = 1_000_000) -> DataFrame:
    """Snow readings (zip, date d/m/yyyy, snow); a faulty reading is in inches."""
    base, draw = _base(ids, ident, 8)
    zip_code = (draw(1, 90000) + 10000).cast("string")
    date = F.concat_ws("/", draw(2, 30) + 1, draw(3, 12) + 1, draw(4, 117) + 1900)
    low = col("zip").substr(1, 1).isin(LOW_SNOW_DIGITS)
    millimetres = F.when(low, draw(6, 160)).otherwise(draw(6, 4000))
    hundredths = F.when(low, draw(7, 50)).otherwise(draw(7, 1300))
    feet = F.concat(int_div(hundredths, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("ft"))
    snow = (F.when(col("is_fault"), "90in")
            .when(draw(8, 2) == 0, F.concat(millimetres.cast("string"), F.lit("mm"))).otherwise(feet))
    return (base.withColumns({"zip": zip_code, "date": date, "is_fault": draw(5, fault_one_in) == 0})
            .withColumn("snow", snow).select(ident, "zip", "date", "snow", "is_fault"))


def airport(ids: DataFrame, ident: str = "id", fault_one_in: int = 1_000_000) -> DataFrame:
    """Transit stays; a faulty arrival time holds the passenger number instead of the hour."""
    base, draw = _base(ids, ident, 11)
    passenger = F.concat(*[(draw(s, 8) + 10).cast("string") for s in (4, 5, 6)])
    leave = draw(7, 24) * 60 + draw(8, 60) + (draw(9, 4) + 1) * 30
    arrival = F.concat_ws(":", draw(7, 24), draw(8, 60))
    return (base.withColumns({
        "date": F.concat_ws("/", draw(1, 12) + 1, draw(2, 31), draw(3, 8) + 10), "passenger": passenger,
        "departure": F.concat_ws(":", int_div(leave, F.lit(60)) % 24, leave % 60),
        "airport": _pick(AIRPORTS, draw(10, 16)), "is_fault": draw(11, fault_one_in) == 0})
        .withColumn("arrival", F.when(col("is_fault"), F.concat(col("passenger"), F.lit(":0")))
                    .otherwise(arrival))
        .select(ident, "date", "passenger", "arrival", "departure", "airport", "is_fault"))


def trips(ids: DataFrame, ident: str = "id", fault_one_in: int = 100_000) -> DataFrame:
    """Trips between zip codes; on a faulty fast trip the distance is far too long."""
    base, draw = _base(ids, ident, 5)
    start, end = draw(1, 100) + 90000, draw(2, 100) + 90000
    true_distance = F.abs(start - end) * 100 + draw(3, 10)
    true_time = F.greatest(int_div(col("__d"), draw(4, 50) + 10), F.lit(1))
    speeding = int_div(col("__d"), col("time")) > 40
    return (base.withColumns({"zip_from": start.cast("string"), "zip_to": end.cast("string"),
                              "__d": true_distance})
            .withColumn("time", true_time.cast("int"))
            .withColumn("is_fault", speeding & (draw(5, fault_one_in) == 0))
            .withColumn("distance", (col("__d") + F.when(col("is_fault"), col("time") * 600).otherwise(0))
                        .cast("int"))
            .select(ident, F.lit("sr").alias("mode"), "zip_from", "zip_to", "distance", "time", "is_fault"))


def zip_areas(trip_table: DataFrame) -> DataFrame:
    """Each zip code of the trips with its area."""
    zips = trip_table.select(F.explode(F.array("zip_from", "zip_to")).alias("zip")).distinct()
    return zips.withColumn("area", (col("zip").cast("int") % 100).cast("string"))


def student_info(ids: DataFrame, ident: str = "id", fault_one_in: int = 250_000) -> DataFrame:
    """Students by year; a faulty junior's age is the student number."""
    base, draw = _base(ids, ident, 6)
    year = draw(4, 4)
    return (base.withColumns({
        "student_id": draw(1, 99999999).cast("int"), "major": _pick(MAJORS, draw(2, 10)),
        "gender": _pick(GENDERS, draw(3, 2)), "year": _pick(YEARS, year),
        "is_fault": (year == 2) & (draw(5, fault_one_in) == 0)})
        .withColumn("age", F.when(col("is_fault"), col("student_id"))
                    .otherwise((draw(6, 6) + 15 + year * 2).cast("int")))
        .select(ident, "student_id", "major", "gender", "year", "age", "is_fault"))


def student_info_lines(ids: DataFrame, ident: str = "id", fault_one_in: int = 2_000) -> DataFrame:
    """Older layout: one blank-separated line 'first last gender age grade major'; a faulty
    third-year's age is written twice."""
    base, draw = _base(ids, ident, 9)

    def name(salt: int) -> Column:
        letters = F.translate(F.lpad(draw(salt, _PRIME).cast("string"), 10, "0"), "0123456789", "abcdefghij")
        return F.substring(letters, F.lit(3), (draw(salt + 1, 5) + 3).cast("int"))

    grade = draw(5, 4) + 1
    age = draw(6, 2) + 17 + grade
    return (base.withColumn("is_fault", (grade == 3) & (draw(7, fault_one_in) == 0))
            .withColumn("value", F.concat_ws(
                " ", name(1), name(3), _pick(GENDERS, draw(8, 2)),
                F.when(col("is_fault"), age * 101).otherwise(age), grade, _pick(MAJORS, draw(9, 10))))
            .select(ident, "value", "is_fault"))


def student_grades(ids: DataFrame, ident: str = "id") -> DataFrame:
    """One course per row with 11 to 200 'course:grade' items."""
    base, draw = _base(ids, ident, 3)
    course = F.concat(F.when(draw(1, 2) == 0, "EE").otherwise("CS"), (draw(2, 570) + 30).cast("string"))
    # the steps of mix(), one by one: a lambda has no common subexpressions, so a fold would compute its number twice
    firsts = F.transform(F.sequence(F.lit(0).cast("bigint"), draw(3, 190) + 10), lambda i: _first(col(ident) * 256 + i, 4))
    seconds = F.transform(firsts, lambda x: _fold(x, 13) * 69621 % _PRIME)
    items = F.transform(seconds, lambda x: F.concat(col("course"), F.lit(":"), (_fold(x, 11) % 90 + 10).cast("string")))
    return base.withColumn("course", course).withColumn("grades", items).select(ident, "grades")


def _course(index: Column) -> Column:
    number = index % 198
    return F.concat(_pick(DEPARTMENTS, int_div(index, F.lit(198))),
                    F.when(number < 99, number + 1).otherwise(number + 2).cast("string"))


def grades(ids: DataFrame, ident: str = "id") -> DataFrame:
    """Grades of five departments; two courses are graded on an inflated scale."""
    base, draw = _base(ids, ident, 3)
    return (base.withColumns({"student_id": (draw(1, 190) + 10).cast("int"), "course": _course(draw(2, 990))})
            .withColumn("is_fault", col("course").isin(INFLATED_COURSES))
            .withColumn("grade", F.when(col("is_fault"), draw(3, 25) + 85).otherwise(draw(3, 35) + 65)
                        .cast("int"))
            .select(ident, "student_id", "course", "grade", "is_fault"))


def grades_with_zeros(ids: DataFrame, ident: str = "id", small_one_in: int = 75) -> DataFrame:
    """Grades without inflation, plus two small courses where about 15 % of the grades are zero."""
    base, draw = _base(ids, ident, 6)
    small = draw(4, small_one_in) == 0
    return (base.withColumns({
        "student_id": (draw(1, 190) + 10).cast("int"),
        "course": F.when(small, _pick(ZEROED_COURSES, draw(5, 2))).otherwise(_course(draw(2, 990))),
        "is_fault": small & (draw(6, 100) < 15)})
        .withColumn("grade", F.when(col("is_fault"), 0).otherwise(draw(3, 35) + 65).cast("int"))
        .select(ident, "student_id", "course", "grade", "is_fault"))


def keyed_numbers(ids: DataFrame, ident: str = "id") -> DataFrame:
    base, draw = _base(ids, ident, 2)
    return base.select(ident, _pick(["a", "b", "c", "q"], draw(1, 4)).alias("key"),
                       (draw(2, 1111199) + 1).cast("int").alias("value"))
