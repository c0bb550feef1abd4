"""EXSLT functions, URIs, number pictures and comparisons by hand-made and library values."""

import math
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from thicket.functions import exslt as E
from thicket.functions.sql import register
from thicket.operators import axes as A
from thicket.operators import keys as K
from thicket.plans.summary import attribute_matches, combined, nth
from thicket.sources.shred import shred_html, shred_xml, stored_nodes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("base", ["http://h/a/b/c?x=1#f", "https://h", "http://h/a/"])
def test_resolve(spark, base):
    references = ["d", "./d", "../d", "../../d", "../../../d", "/d/./e/../f", "?y", "#z", "", "//other/p", "mailto:x@y", "d/../e/.", "d/..", "..", ".", "g;x=1/../y"]
    rows = spark.createDataFrame([(r,) for r in references], "r string").select("r", E.resolve_uri(F.col("r"), F.lit(base)).alias("u")).collect()
    for row in rows:
        want = urljoin(base, row.r) if row.r else base.partition("#")[0]
        assert row.u == want, row.r


def test_normalize(spark):
    for a, b in (("HTTP://Ex.ORG:80/a/./b/../c", "http://ex.org/a/c"), ("https://h:443", "https://h/"), ("http://h:8080/?q", "http://h:8080/?q"), ("a/../b", "a/../b")):
        assert value(spark, E.normalize_uri(F.lit(a))) == b


def test_pictures(spark):
    euro = E.DecimalFormat(decimal=",", grouping=".", nan="-", infinity="endless", minus="~")
    cases = [
        (1234567.891, "#,##0.00", E.DecimalFormat(), "1,234,567.89"),
        (0.5, "#", E.DecimalFormat(), "1"),
        (0.0, "#.##", E.DecimalFormat(), "0"),
        (0.25, "#.##", E.DecimalFormat(), ".25"),
        (-3.0, "0.0;(0.0)", E.DecimalFormat(), "(3.0)"),
        (-0.001, "0.0;(0.0)", E.DecimalFormat(), "0.0"),
        (0.1234, "0.0%", E.DecimalFormat(), "12.3%"),
        (0.1234, "0\u2030", E.DecimalFormat(), "123\u2030"),
        (5.0, "$000 each", E.DecimalFormat(), "$005 each"),
        (-1234.5, "#.##0,00", euro, "~1.234,50"),
        (float("nan"), "0", euro, "-"),
        (float("-inf"), "0", euro, "~endless"),
        (12.0, "\u0660\u0660\u0660", E.DecimalFormat(zero="\u0660"), "\u0660\u0661\u0662"),
    ]
    for x, pattern, fmt, want in cases:
        assert value(spark, E.picture(F.lit(x), pattern, fmt)) == want, (x, pattern)
    assert value(spark, E.picture(F.lit(None).cast("double"), "0")) == "NaN"


def test_durations(spark):
    t = F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")
    assert str(value(spark, E.date_add(t, F.lit("P1M")))) == "2024-02-29 10:00:00"
    assert str(value(spark, E.date_add(t, F.lit("-P1Y2DT1H0.5S")))) == "2023-01-29 08:59:59.500000"
    assert value(spark, E.date_add(t, F.lit("1 month"))) is None
    assert value(spark, E.date_seconds(F.lit("-P1DT1M"))) == -86460
    assert math.isnan(value(spark, E.date_seconds(F.lit("P1M")))) and math.isnan(value(spark, E.date_seconds(F.lit("P"))))
    for a, b, want in (("P1Y", "P1M", "P1Y1M"), ("P1D", "-P1D", "PT0S"), ("P1M", "-P1D", ""), ("-P1M", "-PT5S", "-P1MT5S"), ("PT30M", "PT45M", "PT1H15M"), ("x", "P1D", "")):
        assert value(spark, E.add_durations(F.lit(a), F.lit(b))) == want, (a, b)
    assert value(spark, E.date_difference(F.lit("2024-03-01").cast("date"), F.lit("2024-02-28").cast("date"))) == "-P2D"


def test_strings(spark):
    assert value(spark, E.replace(F.lit("aab.a\nb"), [("a", "b"), ("aa", "x"), ("b", "a"), (".", "-"), ("", "?")])) == "xa-b\na"
    assert value(spark, E.split(F.lit("a, b, , c"), ", ")) == ["a", "b", "c"] and value(spark, E.split(F.lit("abc"), "")) == ["a", "b", "c"]
    assert value(spark, E.split(F.lit(None).cast("string"))) == []
    assert math.isnan(value(spark, E.math("sqrt", F.lit(-1.0)))) and value(spark, E.math("log", F.lit(0.0))) == -math.inf and value(spark, E.power(F.lit(2.0), F.lit(-1.0))) == 0.5
    names = register(spark)
    assert len(names) == 9
    row = spark.sql("SELECT xp_number(' -.5 ') AS a, xp_number('+5') AS b, xp_round(-2.5D) AS c, xp_normalize_space(' a  b\t') AS d, xp_substring_after('a=b=c', '=') AS e, xp_contains('abc', NULL) AS f").first()
    assert row.a == -0.5 and math.isnan(row.b) and row.c == -2.0 and row.d == "a b" and row.e == "b=c" and row.f is True
    assert [tuple(r) for r in spark.sql("SELECT * FROM xp_tokens('x  y') ORDER BY position").collect()] == [(1, "x"), (2, "y")]


def test_some_pair(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 3.0), (3, float("nan")), (4, None), (5, 2.0)], "g int, value double")
    b = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 1.0), (4, 1.0), (5, 1.0), (5, 9.0)], "g int, value double")
    for o, want in (("=", {1, 2}), ("!=", {1, 5}), ("<", {1, 5}), ("<=", {1, 2, 5}), (">", {5}), (">=", {1, 2, 5})):
        assert {r.g for r in K.some_pair(a, b, ["g"], o).collect()} == want, o


def test_languages_namespaces_and_blanks(spark):
    xml = '<r xmlns="urn:a" xml:lang="en-GB"><a xmlns:p="urn:b" xmlns=""><b xml:lang="de"/> </a>\n<c xml:space="preserve"> <d xml:space="default"> </d></c></r>'
    n = shred_xml(spark.createDataFrame([(1, xml), (None, "<x/>")], "id long, xml string"), "id", "xml").cache()
    found = {r.local: r.lang for r in A.languages(A.everywhere(n, A.test()), n).join(n, ["doc_id", "pre"]).collect()}
    assert found == {"r": "en-gb", "a": "en-gb", "b": "de", "c": "en-gb", "d": "en-gb"}
    assert value(spark, A.lang(F.lit("en-gb"), "EN")) and not value(spark, A.lang(F.lit("eng"), "en"))
    names = {r.pre: r.local for r in n.where("kind = 1 and doc_id = 1").collect()}
    scope = {(names[r.ctx], r.prefix, r.uri) for r in A.namespaces(A.everywhere(n, A.test()), n).collect() if r.prefix != "xml" and r.doc_id}
    assert scope == {("r", "", "urn:a"), ("a", "p", "urn:b"), ("b", "p", "urn:b"), ("c", "", "urn:a"), ("d", "", "urn:a")}
    assert A.without_blank_text(n).where("kind = 3").count() == 1 and A.without_blank_text(n, keep=("a",)).where("kind = 3").count() == 2
    assert n.where("doc_id is null").count() == 2


def test_paths_and_css(spark):
    html = '<ul><li class="x">a<li id="k">b<ul><li>c</ul><li>d</ul><p lang="en-US">e'
    n = shred_html(spark.createDataFrame([(1, html)], "id long, h string"), "id", "h").cache()
    rows = n.orderBy("pre").collect()
    for r in rows:
        around, at = [], r.parent
        while at is not None:
            around.insert(0, at)
            at = rows[at].parent
        assert r.level == len(around) and r.last == len(rows) - 1
        assert r.size == sum(q.pre > r.pre and q.pre <= r.pre + r.size for q in rows) and all(r.pre <= rows[p].pre + rows[p].size for p in around)
        assert r.up == (rows[r.parent].local if r.parent is not None else None)
        assert (r.path_id, r.path_up) == ((rows[r.parent].path_id, rows[r.parent].path_up) if r.kind not in (1, 9) else (r.path_id, rows[r.parent].path_id if r.kind == 1 else 0))
    items = n.where("local = 'li' and kind = 1")
    assert [r.pre for r in nth(items, 2, 1).orderBy("pre").collect()] == [r.pre for r in rows if r.local == "li" and r.kind == 1 and r.elem % 2 == 1]
    assert nth(items, 0, 2).count() == 1 and nth(items, -1, 2).count() == 3
    assert [combined(items, c, items).count() for c in (" ", ">", "+", "~")] == [1, 0, 2, 2]
    texts = n.where("kind = 2 and local = 'lang'")
    assert [texts.where(attribute_matches(o, v)).count() for o, v in (("=", "en"), ("|=", "en"), ("^=", "en"), ("$=", "US"), ("*=", "-"), ("*=", ""), ("~=", "en-US"))] == [0, 1, 1, 1, 1, 0, 1]
    kept = stored_nodes(n, 2)
    assert kept.count() == n.count() and kept.schema == n.schema
