"""Order of typed values, by tables of cases and against arithmetic of the standard library."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.functions import values as V

DURATIONS = [
    ("P1Y", "P12M", "equal"), ("P1Y", "P364D", "greater"), ("P1Y", "P365D", "incomparable"), ("P1Y", "P366D", "incomparable"), ("P1Y", "P367D", "less"),
    ("P1M", "P27D", "greater"), ("P1M", "P28D", "incomparable"), ("P1M", "P31D", "incomparable"), ("P1M", "P32D", "less"),
    ("P5M", "P149D", "greater"), ("P5M", "P150D", "incomparable"), ("P5M", "P153D", "incomparable"), ("P5M", "P154D", "less"),
    ("PT24H", "P1D", "equal"), ("-P1D", "PT0S", "less"), ("-P1M", "-P32D", "greater"), (" PT1.5S\n", "PT1.50S", "equal"), ("PT0.000000001S", "PT0S", "greater"),
    ("P9999999999999Y", "P9999999999998Y", "greater"), ("P00000000000000000001D", "P1D", "equal"), ("P99999999999999Y", "P1D", None),
    ("P", "P1D", None), ("P1DT", "P1D", None), ("P1S", "P1D", None), ("", "P1D", None), (None, "P1D", None), ("P1D", None, None),
]
TIMES = [
    ("2000-01-15T12:00:00", "2000-01-16T12:00:00Z", "less"), ("2000-01-16T12:00:00Z", "2000-01-15T12:00:00", "greater"), ("2000-01-01T12:00:00", "1999-12-31T23:00:00Z", "incomparable"), ("2000-01-16T12:00:00", "2000-01-16T12:00:00Z", "incomparable"),
    ("2000-01-16T00:00:00", "2000-01-16T14:00:00Z", "incomparable"), ("2000-01-16T00:00:00", "2000-01-16T14:00:01Z", "less"), ("2000-03-04T20:00:00Z", "2000-03-04T23:00:00+03:00", "equal"),
    ("1999-12-31T24:00:00", "2000-01-01T00:00:00", "equal"), ("-0001-12-31T23:59:59Z", "0000-01-01T00:00:00Z", "less"), ("12000-01-01T00:00:00Z", "9999-12-31T24:00:00Z", "greater"),
    ("2000-02-29T00:00:00", "2000-03-01T00:00:00", "less"), ("1900-02-29T00:00:00", "1900-03-01T00:00:00", None), ("2000-13-01T00:00:00", "2000-01-01T00:00:00", None), ("2000-01-01T25:00:00", "2000-01-01T00:00:00", None),
    ("2000-01-01T00:00:60", "2000-01-01T00:00:00", None), ("2000-01-01T00:00:00+14:01", "2000-01-01T00:00:00Z", None), ("2000-01-01", "2000-01-01T00:00:00", None), (None, "2000-01-01T00:00:00Z", None), ("2000-01-01T00:00:00.5", "2000-01-01T00:00:00.50", "equal"),
]
DECIMALS = [("+001.500", "1.5", "equal"), ("-0.0", "0", "equal"), (".5", "0.50", "equal"), ("-2", "-10", "greater"), ("-1", "1", "less"), ("10", "9.99", "greater"), ("1.05", "1.5", "less"), ("9" * 60, "1" + "0" * 60, "less"), ("5.", "5", "equal"), (".", "0", None), ("1e3", "0", None), ("", "0", None), (None, "0", None)]
CANONICAL = [("+001.500", "1.5"), ("-0", "0.0"), (".5", "0.5"), ("-100", "-100.0"), ("1.", "1.0"), (" 007 ", "7.0"), ("0" * 50 + "1." + "2" * 50, "1." + "2" * 50), ("x", None), (None, None)]


def seen(spark, f, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want string")
    return [(r.a, r.b, r.got) for r in df.withColumn("got", f(df.a, df.b)).orderBy("i").collect()]


def test_tables(spark):
    for f, cases in ((V.compare_durations, DURATIONS), (V.compare_times, TIMES), (V.compare_decimals, DECIMALS)):
        assert seen(spark, f, cases) == cases
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CANONICAL)], "i int, a string, want string")
    assert [(r.a, r.got) for r in df.withColumn("got", V.canonical_decimal(df.a)).orderBy("i").collect()] == CANONICAL


def order(a, b):
    return "less" if a < b else "greater" if a > b else "equal"


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.datetimes(), st.datetimes(), st.decimals(allow_nan=False, allow_infinity=False), st.decimals(allow_nan=False, allow_infinity=False)), min_size=30, max_size=60))
def test_against_the_standard_library(spark, rows):
    zone = dt.timezone(dt.timedelta(hours=-5, minutes=-30))
    times = [(a.isoformat(), b.isoformat(), order(a, b)) for a, b, _, _ in rows]
    zoned = [(a.isoformat() + "-05:30", b.isoformat() + "Z", order(a.replace(tzinfo=zone), b.replace(tzinfo=dt.timezone.utc))) for a, b, _, _ in rows if 1 < a.year < 9999 and 1 < b.year < 9999]
    assert seen(spark, V.compare_times, times) == times
    assert seen(spark, V.compare_times, [*zoned, ("2000-01-01T00:00:00-05:30", "2000-01-01T05:30:00Z", "equal")])[: len(zoned)] == zoned
    numbers = [(f"{x:f}", f"{y:f}", order(Decimal(x), Decimal(y))) for _, _, x, y in rows]
    assert seen(spark, V.compare_decimals, numbers) == numbers


def test_missing_parts_are_not_cast(spark):
    # A failing cast throws, which made most of a comparison's time.
    plan = spark.range(1).select(V.compare_durations(F.lit("P1D"), F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    casts = plan.split("try_cast(")[1:]
    assert casts and all(c.startswith(("CASE WHEN", "concat(")) for c in casts), plan[:1500]
