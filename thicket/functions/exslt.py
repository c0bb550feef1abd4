"""EXSLT functions on dates, strings and numbers, URIs, and number pictures, as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.xpath import _nan, duration_text, string


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body has it (an expression that holds another several times over
    would grow with each level)."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- durations: whole months, and seconds -----------------------------------------------------------------------------

_DURATION = r"^(-?)P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


FARTHEST = 12 * 9000  # months that date_add moves at most


def duration(text: Column) -> Column:
    """``months`` and ``seconds`` of an ISO 8601 duration; null for other texts. Months beyond a long stay at its end."""

    def read(t: Column) -> Column:
        part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, _DURATION, i), F.lit("")).cast("double"), F.lit(0.0))
        sign = F.when(F.startswith(t, F.lit("-")), -1).otherwise(1)
        months, seconds = (sign * F.least(part(2) * 12 + part(3), F.lit(9e18))).cast("long"), sign * (part(4) * 86400 + part(5) * 3600 + part(6) * 60 + part(7))
        return F.when(t.rlike(_DURATION), F.struct(months.alias("months"), seconds.alias("seconds")))

    return let(string(text), read)


def duration_of(months: Column, seconds: Column) -> Column:
    """The text of a duration whose months and seconds have one sign; null if they haven't."""

    def written(d: Column) -> Column:
        m, negative = F.abs(d["m"]), (d["m"] < 0) | (d["s"] < 0)
        piece = lambda v, unit: F.when(v > 0, F.concat(v.cast("string"), F.lit(unit))).otherwise("")
        rest = F.regexp_replace(let(F.abs(d["s"]), duration_text), "^P", "")
        body = F.concat(piece(F.floor(m / 12), "Y"), piece(m % 12, "M"), F.when((d["s"] == 0) & (m > 0), "").otherwise(rest))
        mixed = ((d["m"] < 0) & (d["s"] > 0)) | ((d["m"] > 0) & (d["s"] < 0))
        return F.when(~mixed, F.concat(F.when(negative, "-").otherwise(""), F.lit("P"), body))

    return let(F.struct(months.alias("m"), seconds.alias("s")), written)


def date_add(t: Column, text: Column) -> Column:
    """``date:add``: months first (the last day of a month stays in it), then seconds. Null for no duration, and for one beyond
    ``FARTHEST`` months (or as many seconds), as timestamps end there."""

    def added(d: Column) -> Column:
        near = (F.abs(d["months"]) <= FARTHEST) & (F.abs(d["seconds"]) <= FARTHEST * 2_600_000.0)
        moved = F.add_months(t.cast("date"), F.when(near, d["months"]).cast("int")).cast("timestamp_ntz")
        clock = F.make_dt_interval(F.lit(0), F.hour(t), F.minute(t), F.second(t).cast("decimal(18,6)"))
        return moved + clock + F.make_dt_interval(secs=F.when(near, d["seconds"]).cast("decimal(18,6)"))

    return let(duration(text), added)


def date_difference(start: Column, end: Column) -> Column:
    """``date:difference``: from start to end, as a duration of days and time."""
    return let(F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp")), duration_text)


def date_seconds(text: Column) -> Column:
    """``date:seconds`` of a duration; NaN where months have no fixed length, and for no duration."""
    return let(duration(text), lambda d: F.coalesce(F.when(d["months"] == 0, d["seconds"]), _nan()))


def add_durations(a: Column, b: Column) -> Column:
    """``date:add-duration``: empty if the signs of months and seconds differ in the sum, or for no duration."""
    both = F.struct(duration(a).alias("x"), duration(b).alias("y"))
    return let(both, lambda d: F.coalesce(duration_of(d["x"]["months"] + d["y"]["months"], d["x"]["seconds"] + d["y"]["seconds"]), F.lit("")))


def sum_durations(text: Column) -> Column:
    """``date:sum``, an aggregate; empty if one is no duration or there is none."""
    d = duration(text)
    total = duration_of(F.sum(d["months"]), F.sum(d["seconds"]))
    return F.when(F.bool_and(d.isNotNull()), F.coalesce(total, F.lit(""))).otherwise("")


def month_name(t: Column, short: bool = False) -> Column:
    return F.date_format(t, "MMM" if short else "MMMM")


def day_name(t: Column, short: bool = False) -> Column:
    return F.date_format(t, "EEE" if short else "EEEE")


# --- strings -----------------------------------------------------------------------------------------------------------


def split(text: Column, pattern: str = " ") -> Column:
    """``str:split``: the parts between a string (not an expression), without empty ones; of an empty string, the characters."""
    t = string(text)
    return F.filter(F.split(t, re.escape(pattern) if pattern else ""), lambda p: p != "")


def replace(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """``str:replace``: at each place the longest search string that fits is replaced, and what was put in isn't searched again."""
    found = sorted((a for a, _ in pairs if a), key=len, reverse=True)
    if not found:
        return string(text)
    tokens = F.regexp_extract_all(string(text), F.lit(f"(?s)({'|'.join(re.escape(a) for a in found)}|.)"), F.lit(1))
    table = F.create_map(*(F.lit(x) for a, b in dict(reversed([(a, b) for a, b in pairs if a])).items() for x in (a, b)))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def concat(value: Column, order: Column) -> Column:
    """``str:concat``, an aggregate: the strings of a node set in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), string(value).alias("v")))), lambda p: p["v"]), "")


# --- numbers -----------------------------------------------------------------------------------------------------------


def power(x: Column, y: Column) -> Column:
    return F.coalesce(F.pow(x, y), _nan())


def math(name: str, x: Column) -> Column:
    """``math:abs``, sqrt, exp, log, sin, cos, tan, asin, acos, atan of a number; NaN outside of their domain and for none."""
    value = F.log(F.when(x > 0, x)) if name == "log" else getattr(F, name)(x)
    return F.coalesce(F.when(x == 0, float("-inf")).otherwise(value), _nan()) if name == "log" else F.coalesce(value, _nan())


# --- number pictures ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DecimalFormat:
    """``xsl:decimal-format``."""

    decimal: str = "."
    grouping: str = ","
    percent: str = "%"
    per_mille: str = "\u2030"
    zero: str = "0"
    digit: str = "#"
    pattern: str = ";"
    minus: str = "-"
    infinity: str = "Infinity"
    nan: str = "NaN"


def picture(x: Column, pattern: str, fmt: DecimalFormat = DecimalFormat()) -> Column:
    """``format-number``: prefix and suffix, digits, grouping, per cent and per mille, and a pattern of its own for negative numbers.

    The digits are those of the shortest decimal text of the number, halves are rounded up in size, and numbers of any size are written
    out. A negative number that rounds to zero has no sign. A picture of fraction digits alone writes one digit on each side. A quote in what stands before or behind
    the digits makes the character after it stand for itself. Of more than two sub-patterns the first alone counts.
    """
    first, *others = pattern.split(fmt.pattern)
    second = others[0] if len(others) == 1 else ""
    marks = re.escape(fmt.zero + fmt.digit + fmt.grouping + fmt.decimal)
    plain = lambda text: re.sub(r"'(.)", r"\1", text, flags=re.S)
    prefix, body, suffix = re.fullmatch(rf"((?:'.|[^{marks}'])*)([{marks}]*)(.*)", first, re.S).groups()
    prefix, suffix = plain(prefix), plain(suffix)
    whole, _, part = body.partition(fmt.decimal)
    factor = 100 if fmt.percent in prefix + suffix else 1000 if fmt.per_mille in prefix + suffix else 1
    most, least, digits = len(part.replace(fmt.grouping, "")), part.count(fmt.zero), whole.count(fmt.zero)
    if whole == "" and least == 0 and most:
        least = digits = 1
    group = len(whole) - whole.rindex(fmt.grouping) - 1 if fmt.grouping in whole else 0
    negative = tuple(map(plain, re.fullmatch(rf"((?:'.|[^{marks}'])*)[{marks}]*(.*)", second, re.S).groups())) if second else (fmt.minus + prefix, suffix)

    def digits_of(value: Column) -> Column:
        left = F.regexp_replace(F.split_part(value, F.lit("."), F.lit(1)), "^0+", "")
        right = F.rpad(F.substring(F.split_part(value, F.lit("."), F.lit(2)), 1, most), most, "0") if most else F.lit("")
        right = F.regexp_replace(right, rf"^(\d{{{least}}}\d*?)0*$", "$1") if most > least else right
        return F.struct(left.alias("l"), right.alias("r"))

    def number_of(d: Column) -> Column:
        left, right = d["l"], d["r"]
        left = F.when(F.length(left) < digits, F.lpad(left, digits, "0")).otherwise(left) if digits else F.when((left == "") & (right == ""), "0").otherwise(left)
        if group:
            left = F.regexp_replace(left, rf"(?<=\d)(?=(\d{{{group}}})+$)", re.escape(fmt.grouping) if fmt.grouping in "$\\" else fmt.grouping)
        number = F.concat(left, F.when(F.length(right) > 0, F.concat(F.lit(fmt.decimal), right)).otherwise(""))
        if fmt.zero != "0":
            number = F.translate(number, "0123456789", "".join(chr(ord(fmt.zero) + i) for i in range(10)))
        return F.struct(number.alias("n"), F.concat(d["l"], right).rlike("[1-9]").alias("some"))

    def written(v: Column) -> Column:
        size = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.abs(v))
        shifted = F.coalesce(F.format_string("%.20f", size).try_cast("decimal(38,20)") * factor, F.lit(None))
        exact = F.when(size < 1e15, F.round(shifted, most).cast("string")) if factor > 1 and most <= 12 else F.lit(None).cast("string")
        value = F.coalesce(exact, F.format_string(f"%.{most}f", size * factor))
        value = F.concat(value, F.lit("." if not most else ""))
        shown = lambda a, n, b: F.concat(F.lit(a), n, F.lit(b))
        finite = let(let(let(value, digits_of), number_of), lambda n: F.when((v < 0) & n["some"], shown(negative[0], n["n"], negative[1])).otherwise(shown(prefix, n["n"], suffix)))
        endless = F.when(v > 0, shown(prefix, F.lit(fmt.infinity), suffix)).otherwise(shown(negative[0], F.lit(fmt.infinity), negative[1]))
        return F.when(v.isNull() | F.isnan(v), fmt.nan).when(F.abs(v) == float("inf"), endless).otherwise(finite)

    return let(x.cast("double"), written)


# --- URIs --------------------------------------------------------------------------------------------------------------

_URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _component(uri: Column, i: int, there: str) -> Column:
    """A component, null if it isn't there (an empty query is)."""
    return F.when(uri.rlike(there), F.regexp_extract(uri, _URI, i))


def _parts(uri: Column) -> tuple[Column, ...]:
    scheme = F.nullif(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(""))
    return scheme, _component(uri, 2, r"^(?:[^:/?#]+:)?//"), F.regexp_extract(uri, _URI, 3), _component(uri, 4, r"^[^?#]*\?"), _component(uri, 5, "#")


def _without_dots(path: Column) -> Column:
    """RFC 3986, 5.2.4: "." goes, ".." takes the segment before it along."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.when(F.startswith(path, F.lit("/")), F.slice(segments, 2, F.lit(1 << 30))).otherwise(segments),
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, s)),
    )
    lead = F.when(F.startswith(path, F.lit("/")), "/").otherwise("")
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(lead, F.array_join(kept, "/"), end)


def _joined(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    piece = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return F.concat(piece("", scheme, ":"), piece("//", authority), path, piece("?", query), piece("#", fragment))


def _split(uri: Column) -> Column:
    return let(string(uri), lambda u: F.struct(*(c.alias(n) for n, c in zip("sapqf", _parts(u), strict=True))))


def resolve_uri(reference: Column, base: Column) -> Column:
    """RFC 3986, 5.2: a reference against a base."""

    def resolved(d: Column) -> Column:
        r, b = d["r"], d["b"]
        own, there = r["s"].isNotNull(), r["a"].isNotNull()
        merged = F.when(b["a"].isNotNull() & (b["p"] == ""), F.concat(F.lit("/"), r["p"])).otherwise(F.concat(F.regexp_extract(b["p"], "^(.*/)?", 0), r["p"]))
        path = F.when(own | there | F.startswith(r["p"], F.lit("/")), let(r["p"], _without_dots)).when(r["p"] == "", b["p"]).otherwise(let(merged, _without_dots))
        query = F.when(own | there | (r["p"] != "") | r["q"].isNotNull(), r["q"]).otherwise(b["q"])
        return _joined(F.coalesce(r["s"], b["s"]), F.when(own | there, r["a"]).otherwise(b["a"]), path, query, r["f"])

    return let(F.struct(_split(reference).alias("r"), _split(base).alias("b")), resolved)


def normalize_uri(uri: Column) -> Column:
    """Scheme and host in lower case, no dot segments, no default port, an empty path of an authority as /."""

    def normal(u: Column) -> Column:
        scheme = F.lower(u["s"])
        ports = F.when(scheme == "http", ":80").when(scheme == "https", ":443").when(scheme == "ftp", ":21").otherwise(":")
        host = let(F.lower(u["a"]), lambda h: F.regexp_replace(F.when(F.endswith(h, ports), F.substring(h, F.lit(1), F.length(h) - F.length(ports))).otherwise(h), ":$", ""))
        path = F.when(u["a"].isNotNull() & (u["p"] == ""), "/").when(u["s"].isNotNull(), let(u["p"], _without_dots)).otherwise(u["p"])
        return _joined(scheme, host, path, u["q"], u["f"])

    return let(_split(uri), normal)
