"""Values that typed texts stand for, and their order, which is partial for durations and for times with and without a zone.

Comparisons return 'less', 'equal', 'greater', 'incomparable', or null where a text is no value of the type (null and the empty text are
none). White space around a value is dropped first. All are Columns without casts that could fail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexical forms of the types, and the instants that durations are compared at (year, month; the first at midnight).
_DURATION = r"^(-?)P(?=\d|T\d)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d+))?S)?)?$"
_TIME = r"^(-?(?:[1-9]\d{3,}|0\d{3}))-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)?$"
_DECIMAL = r"^([+-]?)(?:(\d+)(?:\.(\d*))?|\.(\d+))$"
_INSTANTS = ((1696, 9), (1697, 2), (1903, 3), (1903, 7))
_ZONE_HOURS = 14

_DATE_DIGITS = 13
#: Whole seconds, and seconds with a fraction: narrow enough that a sum of two keeps all its digits.
_WHOLE, _WIDE = "decimal(27,0)", "decimal(37,9)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once (written out, one value would be repeated at each of its uses)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(text: Column, pattern: str, n: int, body: Callable[[Sequence[Column]], Column]) -> Column:
    """``body`` of the pattern's groups in the text, without white space around it; null if it doesn't match."""
    t = F.regexp_replace(text.cast("string"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    groups = lambda u: F.when(u.rlike(pattern), F.array(*(F.regexp_extract(u, pattern, k) for k in range(1, n + 1))))
    return _let(t, lambda u: _let(groups(u), lambda g: F.when(g.isNotNull(), body([g[k] for k in range(n)]))))


def _number(digits: Column) -> Column:
    # A cast that fails costs some 40 microseconds, as it throws, and most parts of a value are missing.
    return F.coalesce(F.when(digits != "", digits).try_cast("long"), F.lit(0).cast("long"))


def _fraction(digits: Column) -> Column:
    return F.concat(F.lit("0."), F.rpad(F.substring(digits, 1, 9), 9, "0")).try_cast("decimal(10,9)")


def _in_seconds(days: Column) -> Column:
    return (days.cast("decimal(19,0)") * F.lit(86400).cast("decimal(5,0)")).cast(_WHOLE)


def _days(month: Column) -> Column:
    """Days from the first of March of year 0 to the first of a month, which is counted from there too."""
    m = F.pmod(month, F.lit(12))
    year = F.floor((month - m) / 12)
    return year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + F.floor((m * 153 + 2) / 5)


def _verdict(a: Column, b: Column) -> Column:
    return F.when(a < b, "less").when(a > b, "greater").when(a == b, "equal")


def duration_value(text: Column) -> Column:
    """(months, seconds) of a duration; null if the text is none, or counts years, months or days with more than 13 digits, or hours, minutes or seconds with more than 18. Fractions keep 9 digits."""

    def value(p: Sequence[Column]) -> Column:
        fits = F.lit(True)
        for k in range(1, 7):
            fits = fits & (F.length(F.ltrim(p[k], F.lit("0"))) <= (_DATE_DIGITS if k < 4 else 18))
        sign = F.when(p[0] == "-", -1).otherwise(1)
        months = _number(p[1]) * 12 + _number(p[2])
        wide = lambda k, scale: _number(p[k]).cast("decimal(19,0)") * F.lit(scale).cast("decimal(4,0)")
        seconds = ((_in_seconds(_number(p[3])) + (wide(4, 3600) + wide(5, 60) + wide(6, 1))).cast(_WHOLE) + _fraction(p[7])).cast(_WIDE)
        return F.when(fits, F.struct((sign * months).alias("months"), F.when(p[0] == "-", -seconds).otherwise(seconds).alias("seconds")))

    return _parts(text, _DURATION, 8, value)


def compare_durations(a: Column, b: Column) -> Column:
    """Order of two durations: that of the times they lead to from four instants, where it is the same for all of them."""

    def after(value: Column) -> Column:
        ends = (_in_seconds(_days(value["months"] + (year * 12 + month - 3))) + value["seconds"] for year, month in _INSTANTS)
        return F.when(value.isNotNull(), F.array(*ends))

    def order(x: Column, y: Column) -> Column:
        seen = F.array_distinct(F.zip_with(x, y, _verdict))
        return F.when(x.isNotNull() & y.isNotNull(), F.when(F.size(seen) == 1, seen[0]).otherwise("incomparable"))

    return _let(_let(duration_value(a), after), lambda x: _let(_let(duration_value(b), after), lambda y: order(x, y)))


def time_value(text: Column) -> Column:
    """(seconds, zoned) of a dateTime, on one line of UTC seconds; those without a zone as if they were in UTC. Year 0 is the one before year 1, 24:00:00 the next midnight.

    Null if the text is none, its day isn't in the calendar, or its year has more than 13 characters. Fractions keep 9 digits.
    """

    def value(p: Sequence[Column]) -> Column:
        year, month, day, hour, minute, second = (_number(p[k]) for k in range(6))
        zone = p[7]
        zone_hours, zone_minutes = _number(F.substring(zone, 2, 2)), _number(F.substring(zone, 5, 2))
        offset = F.when(zone.startswith("-"), -1).otherwise(1) * (zone_hours * 60 + zone_minutes)
        at = F.struct((year * 12 + month - 3).alias("month"), (hour * 3600 + minute * 60 + second).alias("clock"))
        midnight = (hour == 24) & (minute == 0) & (second == 0) & ~p[6].rlike("[1-9]")
        good = month.between(1, 12) & ((hour < 24) | midnight) & (minute < 60) & (second < 60)
        good = good & (zone_minutes < 60) & (F.abs(offset) <= _ZONE_HOURS * 60) & (F.length(p[0]) <= _DATE_DIGITS)
        seconds = lambda t, first: ((_in_seconds(first + day - 1) + (t["clock"] - offset * 60).cast("decimal(19,0)")).cast(_WHOLE) + _fraction(p[6])).cast(_WIDE)
        in_month = lambda t, first: day.between(1, 31) & (day <= _days(t["month"] + 1) - first)
        placed = lambda t, first: F.when(in_month(t, first), F.struct(seconds(t, first).alias("seconds"), (F.length(zone) > 0).alias("zoned")))
        return F.when(good, _let(at, lambda t: _let(_days(t["month"]), lambda first: placed(t, first))))

    return _parts(text, _TIME, 8, value)


def compare_times(a: Column, b: Column) -> Column:
    """Order of two dateTimes. One with a zone and one without compare only where they would for every zone of the other, 14 hours either way."""
    gap = F.lit(_ZONE_HOURS * 3600)

    def order(x: Column, y: Column) -> Column:
        apart = x["seconds"] - y["seconds"]
        mixed = F.when(apart < -gap, "less").when(apart > gap, "greater").otherwise("incomparable")
        return F.when(x["zoned"] == y["zoned"], _verdict(x["seconds"], y["seconds"])).when(x.isNotNull() & y.isNotNull(), mixed)

    return _let(time_value(a), lambda x: _let(time_value(b), lambda y: order(x, y)))


def decimal_value(text: Column) -> Column:
    """(negative, n, whole, rest): the digits before and after the point without zeros at the ends, n before it; null if the text is no decimal."""

    def value(p: Sequence[Column]) -> Column:
        whole, rest = F.ltrim(p[1], F.lit("0")), F.rtrim(F.concat(p[2], p[3]), F.lit("0"))
        negative = (p[0] == "-") & ((F.length(whole) > 0) | (F.length(rest) > 0))
        return F.struct(negative.alias("negative"), F.length(whole).alias("n"), whole.alias("whole"), rest.alias("rest"))

    return _parts(text, _DECIMAL, 4, value)


def canonical_decimal(text: Column) -> Column:
    """The canonical form of a decimal of any length: no plus sign, no zeros at its ends but one on either side of the point; null if it is none."""
    some = lambda c: F.when(F.length(c) > 0, c).otherwise("0")
    return _let(decimal_value(text), lambda v: F.when(v.isNotNull(), F.concat(F.when(v["negative"], "-").otherwise(""), some(v["whole"]), F.lit("."), some(v["rest"]))))


def compare_decimals(a: Column, b: Column) -> Column:
    """Order of two decimals with any number of digits."""
    size = lambda v: F.struct(v["n"], v["whole"], v["rest"])

    def order(x: Column, y: Column) -> Column:
        one_sign = F.when(x["negative"], _verdict(size(y), size(x))).otherwise(_verdict(size(x), size(y)))
        signs = F.when(x["negative"] & ~y["negative"], "less").when(y["negative"] & ~x["negative"], "greater").otherwise(one_sign)
        return F.when(x.isNotNull() & y.isNotNull(), signs)

    return _let(decimal_value(a), lambda x: _let(decimal_value(b), lambda y: order(x, y)))
