"""XPath 1.0 and EXSLT functions as Columns. There is no null: missing strings are '' and missing numbers NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nan() -> Column:
    return F.lit(float("nan"))


def string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number(text: Column) -> Column:
    """A decimal number with an optional minus and white space around it; NaN for other texts (also for '+5').

    An exponent below -323 makes 0, as the power of ten is 0 then.
    """
    good = text.rlike(r"^[ \t\r\n]*-?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\r\n]*$")
    plain = F.trim(F.translate(text, "\t\r\n", "   "))
    small = F.regexp_extract(text, r"[eE](-\d+)", 1)
    tiny = (small != "") & (F.coalesce(small.try_cast("double"), F.lit(0.0)) < -323)
    value = F.when(good & tiny, F.when(F.startswith(plain, F.lit("-")), -0.0).otherwise(0.0)).when(good, plain.try_cast("double"))
    return F.coalesce(value, _nan())


def number_text(x: Column) -> Column:
    """A number as text: integers plain, others with 15 significant digits, very large or small ones with an exponent."""
    size = F.abs(x)
    whole = (x > -2147483648.0) & (x < 2147483647.0) & (x == F.floor(x))
    # With DBL_DIG = 15: digits after the point, or mantissa and exponent.
    exponent = F.floor(F.log10(size))
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.14e", x), r"\.?0+e", "e"), r"e([+-])(\d)$", "e$10$2")
    power = F.when(size >= 1, F.greatest(F.floor(F.log10(size)), F.lit(0))).otherwise(-F.floor(-F.log10(size)))
    digits = F.when(power > 0, 14 - power).otherwise(15 - power).cast("int")
    plain = F.lit(None).cast("string")
    for d in range(21):
        plain = F.when(digits == d, F.format_string(f"%.{d}f", x)).otherwise(plain)
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(x.isNull() | F.isnan(x), "NaN")
        .when(x == float("inf"), "Infinity")
        .when(x == float("-inf"), "-Infinity")
        .when(x == 0, "0")
        .when(whole, x.cast("long").cast("string"))
        .when((size > 1e9) | (size < 1e-5) | exponent.isNull(), mantissa)
        .otherwise(plain)
    )


def boolean_of_text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def boolean_of_number(c: Column) -> Column:
    return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))


def starts_with(a: Column, b: Column) -> Column:
    return F.startswith(string(a), string(b))


def contains(a: Column, b: Column) -> Column:
    return F.contains(string(a), string(b))


def substring_before(a: Column, b: Column) -> Column:
    at = F.instr(string(a), string(b))
    return F.when(at > 0, F.substring(string(a), F.lit(1), at - 1)).otherwise("")


def substring_after(a: Column, b: Column) -> Column:
    at = F.instr(string(a), string(b))
    return F.when(at > 0, F.substring(string(a), at + F.length(b), F.length(a))).otherwise("")


def round_half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity; NaN and infinities stay."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x + 0.5).cast("double"))


def substring(text: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at positions p with round(start) <= p < round(start) + round(length), counted from 1."""
    s = string(text)
    n = F.length(s).cast("double")
    first = round_half_up(start.cast("double"))
    stop = n + 1 if length is None else first + round_half_up(length.cast("double"))
    low, high = F.greatest(first, F.lit(1.0)), F.least(stop, n + 1)
    good = ~F.isnan(first) & ~F.isnan(stop) & (high > low)
    return F.when(good, F.substring(s, low.cast("int"), (high - low).cast("int"))).otherwise("")


def string_length(c: Column) -> Column:
    return F.length(string(c))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(string(c), "[ \t\r\n]+", " "))


def translate(c: Column, source: str, target: str) -> Column:
    return F.translate(string(c), source, target)


def divide(a: Column, b: Column) -> Column:
    """IEEE division."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.coalesce(F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)), _nan())


def mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), float("nan")).otherwise(a - b * F.when(a / F.nullif(b, F.lit(0.0)) < 0, F.ceil(a / F.nullif(b, F.lit(0.0)))).otherwise(F.floor(a / F.nullif(b, F.lit(0.0)))))


def sum_of(c: Column) -> Column:
    """``sum()`` of a node set's numbers: 0 for none, NaN if one is no number."""
    return F.coalesce(F.sum(F.coalesce(c, _nan())), F.lit(0.0))


def max_of(c: Column) -> Column:
    """``math:max``: NaN for no numbers or if one is none."""
    return F.when(F.coalesce(F.bool_or(c.isNull() | F.isnan(c)), F.lit(True)), float("nan")).otherwise(F.max(c))


def min_of(c: Column) -> Column:
    return F.when(F.coalesce(F.bool_or(c.isNull() | F.isnan(c)), F.lit(True)), float("nan")).otherwise(F.min(c))


def roman(n: Column) -> Column:
    """1 to 3999 as upper-case Roman numerals; 0 is empty, other numbers are written in decimal digits."""
    #: The numerals by decimal place.
    places = [
        (1000, ["", "M", "MM", "MMM"]),
        (100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]),
        (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]),
        (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]),
    ]
    whole = n.cast("string").try_cast("long")
    there = F.coalesce(whole.between(0, 3999), F.lit(False))
    good = F.when(there, whole).otherwise(0)
    numeral = F.concat(*(F.element_at(F.array(*map(F.lit, names)), (F.floor(good / unit) % 10 + 1).cast("int")) for unit, names in places))
    return F.when(there, numeral).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """1, 2, .. as A, B, .. Z, AA, .. (any long); other numbers in decimal digits."""
    whole = n.cast("string").try_cast("long")

    def further(state: Column) -> Column:
        rest = state["rest"]
        more = F.struct(F.floor((rest - 1) / F.lit(26).cast("decimal(20,0)")).cast("long").alias("rest"), F.concat(F.char((rest - 1) % 26 + 65), state["out"]).alias("out"))
        return F.when(rest > 0, more).otherwise(state)

    start = F.struct(whole.alias("rest"), F.lit("").alias("out"))
    found = F.aggregate(F.array(*(F.lit(i) for i in range(14))), start, lambda state, _: further(state))["out"]
    return F.when(whole > 0, found).otherwise(n.cast("string"))


def tokenize(text: Column, delimiters: str = "\t\r\n ") -> Column:
    """``str:tokenize``: the parts between any of the delimiters, without empty ones."""
    pattern = "[" + "".join(f"\\x{ord(d):02x}" if ord(d) < 256 else d for d in delimiters) + "]+"
    return F.filter(F.split(string(text), pattern), lambda t: t != "")


def padding(n: Column, text: str = " ") -> Column:
    return F.substring(F.repeat(F.lit(text), (F.ceil(n / len(text))).cast("int")), F.lit(1), n.cast("int"))


def align(text: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    space = F.greatest(F.lit(0), F.lit(width) - F.length(text))
    half = F.floor(space / 2)
    left = {"left": F.lit(0), "right": space, "center": half}[side]
    return F.substring(F.concat(padding(left, fill), text, padding(space - left, fill)), 1, width)


def encode_uri(text: Column) -> Column:
    """Percent-encoding, a space as %20."""
    return F.replace(F.url_encode(string(text)), F.lit("+"), F.lit("%20"))


def decode_uri(text: Column) -> Column:
    return F.url_decode(F.replace(string(text), F.lit("+"), F.lit("%2B")))


def escape(text: Column, attribute: bool = False, canonical: bool = False) -> Column:
    """Markup characters as entities; canonical attributes keep their ``>``."""
    out = text
    for a, b in [("&", "&amp;"), ("<", "&lt;"), *([] if attribute and canonical else [(">", "&gt;")]), *([('"', "&quot;"), ("\t", "&#x9;" if canonical else "&#9;"), ("\n", "&#xA;" if canonical else "&#10;")] if attribute else []), ("\r", "&#xD;" if canonical else "&#13;")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def uri_parts(url: Column) -> Column:
    """Scheme, host, port, path, query and fragment of a URI."""
    part = lambda p: F.nullif(F.regexp_extract(url, r"^(?:([^:/?#]+):)?(?://([^/?#:]*)(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", p), F.lit(""))
    return F.struct(*(part(i).alias(n) for i, n in enumerate(("scheme", "host", "port", "path", "query", "fragment"), 1)))


def format_number(x: Column, fraction_min: int, fraction_max: int, integer_min: int = 1, group: int = 0, percent: int = 1, suffix: str = "") -> Column:
    """``format-number`` with a pattern given by its parts: digits, grouping size, factor (100, 1000) and suffix."""
    value = F.abs(x) * percent
    text = F.format_string(f"%.{fraction_max}f", value)
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    for _ in range(fraction_max - fraction_min):
        part = F.when((F.length(part) > fraction_min) & F.endswith(part, F.lit("0")), F.substring(part, F.lit(1), F.length(part) - 1)).otherwise(part)
    whole = F.lpad(F.regexp_replace(whole, "^0+", ""), integer_min, "0") if integer_min == 0 else F.when(F.length(whole) < integer_min, F.lpad(whole, integer_min, "0")).otherwise(whole)
    if group:
        whole = F.regexp_replace(whole, rf"(?<=\d)(?=(\d{{{group}}})+$)", ",")
    body = F.concat(whole, F.when(F.length(part) > 0, F.concat(F.lit("."), part)).otherwise(""), F.lit(suffix))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(F.concat(F.when((x < 0) & body.rlike("[1-9]"), "-").otherwise(""), body))


def date_parts(t: Column) -> Column:
    """The EXSLT date components of a timestamp; a week starts on Sunday (1)."""
    return F.struct(
        F.year(t).alias("year"),
        F.month(t).alias("month"),
        F.dayofmonth(t).alias("day_in_month"),
        F.dayofyear(t).alias("day_in_year"),
        F.weekofyear(t).alias("week_in_year"),
        F.dayofweek(t).alias("day_in_week"),
        (F.floor((F.dayofmonth(t) - 1) / 7) + 1).alias("day_of_week_in_month"),
        F.hour(t).alias("hour"),
        F.minute(t).alias("minute"),
        F.second(t).alias("second"),
        (((F.year(t) % 4 == 0) & (F.year(t) % 100 != 0)) | (F.year(t) % 400 == 0)).alias("leap_year"),
    )


def duration_text(seconds: Column) -> Column:
    """Whole seconds as an ISO 8601 duration of days and time."""
    s = F.abs(seconds.cast("long"))
    day, hour, minute, second = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    piece = lambda v, u: F.when(v > 0, F.concat(v.cast("string"), F.lit(u))).otherwise("")
    time = F.concat(piece(hour, "H"), piece(minute, "M"), piece(second, "S"))
    return F.when(s == 0, "PT0S").otherwise(F.concat(F.when(seconds < 0, "-").otherwise(""), F.lit("P"), piece(day, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise("")))
