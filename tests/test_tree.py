"""Node tables: steps against a naive evaluation, output, functions, validation, streams."""

import math
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from thicket.functions import xpath as X
from thicket.operators import axes as A
from thicket.operators import output as O
from thicket.plans import validation as V
from thicket.plans.summary import structural_summary
from thicket.sources.files import line_ends, read_rows
from thicket.sources.shred import ATTRIBUTE, ELEMENT, shred_html, shred_xml, xml_errors
from thicket.streaming.push import push_events, take, whole_texts

DEPOT = '<depot><crate id="k1"><mark>Fir</mark><sender>Ona</sender></crate><crate id="k2"><mark>Ash</mark></crate><!--c--><crate id="k3"><mark>A &amp; B</mark><sender>Pell</sender></crate></depot>'


@pytest.fixture(scope="module")
def nodes(spark):
    rng, docs = random.Random(3), [(0, DEPOT)]

    def tree(depth):
        name = rng.choice("abc")
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else "t"
        return f'<{name} k="{rng.randint(0, 3)}">{inner}</{name}>'

    docs += [(i, tree(4)) for i in range(1, 7)]
    found = shred_xml(spark.createDataFrame(docs, "id long, xml string"), "id", "xml").cache()
    found.count()
    return found


def naive(all_rows, axis):
    out = set()
    for c in all_rows:
        for n in all_rows:
            if n.doc_id != c.doc_id:
                continue
            attr = n.kind == ATTRIBUTE
            below = c.pre < n.pre <= c.pre + c.size
            ok = {
                "child": n.parent == c.pre and not attr,
                "attribute": n.parent == c.pre and attr,
                "parent": c.parent == n.pre,
                "self": n.pre == c.pre,
                "descendant": below and not attr,
                "ancestor": n.pre < c.pre <= n.pre + n.size,
                "following": n.pre > c.pre + c.size and not attr,
                "preceding": n.pre + n.size < c.pre and not attr,
                "following-sibling": c.kind != ATTRIBUTE and n.parent == c.parent and n.parent is not None and n.pre > c.pre and not attr,
                "preceding-sibling": c.kind != ATTRIBUTE and n.parent == c.parent and n.parent is not None and n.pre < c.pre and not attr,
            }[axis]
            if ok:
                out.add((c.doc_id, c.pre, n.pre))
    return out


@pytest.mark.parametrize("axis", ["child", "attribute", "parent", "self", "descendant", "ancestor", "following", "preceding", "following-sibling", "preceding-sibling"])
def test_axes(nodes, axis):
    got = {(r.doc_id, r.ctx, r.pre) for r in A.step(nodes, nodes, axis).collect()}
    assert got == naive(nodes.collect(), axis)


def test_positions_and_predicates(nodes):
    lib = nodes.where("doc_id = 0")
    crates = A.everywhere(lib, A.test("crate"))
    senders = A.step(crates, lib, "child", A.test("sender"))
    assert A.having(crates, senders).count() == 2
    assert A.lacking(crates, senders).count() == 1
    children = A.step(crates, lib, "child", A.test()).withColumn("p", A.position()).withColumn("l", A.last())
    assert sorted((r.local, r.p, r.l) for r in children.collect()) == [("mark", 1, 1), ("mark", 1, 2), ("mark", 1, 2), ("sender", 2, 2), ("sender", 2, 2)]
    marks = {r.string for r in A.string_values(A.everywhere(lib, A.test("mark")), lib).collect()}
    assert marks == {"Fir", "Ash", "A & B"}
    first = crates.where("sib = 1")
    assert A.leading(crates, first, after=True).count() == 2
    assert A.union(crates, first).count() == 3 and A.difference(crates, first).count() == 2 and A.intersection(crates, first).count() == 1
    assert A.has_same_node(crates, first).count() == 1


def test_serialize_is_the_inverse_of_parsing(nodes):
    for row in O.serialized(nodes, canonical=True).where("doc_id > 0").collect():
        n = sum(1 for _ in ET.fromstring(row.markup).iter())
        assert n == nodes.where((F.col("doc_id") == row.doc_id) & (F.col("kind") == ELEMENT)).count()
    assert O.serialized(nodes.where("doc_id = 0")).first().markup == DEPOT


def test_canonical_form(spark):
    xml = '<p:root xmlns:p="urn:1" z="1" a="2"><p:a p:y="1" x="&lt;>"/>t&gt;<!-- gone --></p:root>'
    got = O.serialized(shred_xml(spark.createDataFrame([(1, xml)], "id long, xml string"), "id", "xml"), canonical=True).first().markup
    assert got == ET.canonicalize(xml)


def test_broken_documents(spark):
    docs = spark.createDataFrame([(1, "<a><b></a>"), (2, "<a/>"), (3, None), (4, "")], "id long, xml string")
    assert {r.doc_id for r in shred_xml(docs, "id", "xml").collect()} == {2}
    errors = {r.doc_id: r for r in xml_errors(docs, "id", "xml").collect()}
    assert set(errors) == {1, 3, 4} and errors[1].line == 1
    kept = shred_xml(docs, "id", "xml", recover=True).where("doc_id = 1 and kind = 1")
    assert [r.local for r in kept.orderBy("pre").collect()] == ["a", "b"]
    html = shred_html(spark.createDataFrame([(1, "<ul><li>a<li>b<p>c<p>d"), (2, None)], "id long, h string"), "id", "h")
    assert structural_summary(html, ["li", "p"]).orderBy("doc_id").first()[1:4] == (5, 2, 2)


def test_namespaces(spark):
    xml = '<r xmlns="urn:a" xmlns:p="urn:b"><p:x/><x xmlns=""/></r>'
    n = shred_xml(spark.createDataFrame([(1, xml)], "id long, xml string"), "id", "xml")
    assert A.everywhere(n, A.test("x", ns_uri="urn:b")).count() == 1
    assert A.everywhere(n, A.test("r", ns_uri="urn:a")).count() == 1
    assert A.everywhere(n, A.test("x") & F.col("ns_uri").isNull()).count() == 1


#: Number, its text.
NUMBERS = [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-3.0, "-3"), (0.1, "0.1"), (1.5, "1.5"), (2147483647.0, "2.147483647e+09"), (1e10, "1e+10"), (1e-6, "1e-06"), (9.99e-6, "9.99e-06"), (123456.789, "123456.789"), (1e300, "1e+300"), (float("nan"), "NaN"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity")]


def test_number_text(spark):
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(NUMBERS)], "i int, x double").select("i", X.number_text(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [t for _, t in NUMBERS]


#: Text, its number.
PARSED = [("+5", math.nan), (" 12.5 ", 12.5), ("12x", math.nan), ("", math.nan), (".5", 0.5), ("5.", 5.0), ("-2", -2.0), (None, math.nan)]


def test_number(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSED)], "i int, t string").select("i", X.number(F.col("t")).alias("x")).orderBy("i").collect()
    assert [repr(r.x) for r in got] == [repr(x) for _, x in PARSED]


def test_string_functions(spark):
    one = spark.range(1)
    s = F.lit("12345")
    got = one.select(
        X.substring(s, F.lit(0), F.lit(3)),
        X.substring(s, F.lit(1.5), F.lit(2.6)),
        X.substring(s, F.lit(float("nan")), F.lit(3)),
        X.substring(s, F.lit(2)),
        X.substring_before(F.lit("1999/04"), F.lit("/")),
        X.substring_after(F.lit("1999/04"), F.lit("/")),
        X.normalize_space(F.lit(" a \n b ")),
        X.round_half_up(F.lit(-0.5)),
        X.divide(F.lit(1), F.lit(0)),
        X.mod(F.lit(-5), F.lit(2)),
        X.roman(F.lit(1994)),
        X.letters(F.lit(28)),
        X.encode_uri(F.lit("a b&c")),
        X.format_number(F.lit(-1234567.891), 2, 2, 1, 3),
        X.format_number(F.lit(0.256), 0, 1, 1, 0, 100, "%"),
        X.align(F.lit("ab"), 4, "right", "-"),
        X.duration_text(F.lit(90061)),
    ).first()
    assert tuple(got) == ("12", "234", "", "2345", "1999", "04", "a b", 0.0, math.inf, -1.0, "MCMXCIV", "AB", "a%20b%26c", "-1,234,567.89", "25.6%", "--ab", "P1DT1H1M1S")


def test_aggregates_of_numbers(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("b", 2.0), ("b", 5.0)], "k string, v double")
    got = {r.k: (r.s, r.m) for r in rows.groupBy("k").agg(X.sum_of(F.col("v")).alias("s"), X.max_of(F.col("v")).alias("m")).collect()}
    assert got["b"] == (7.0, 5.0) and all(map(math.isnan, got["a"]))


def test_templates_copies_and_includes(spark):
    docs = spark.createDataFrame([(1, '<a xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="two.xml"/><xi:include href="no.xml"><xi:fallback/></xi:include></a>'), (2, "<b>x<c/></b>")], "id long, xml string")
    n = shred_xml(docs, "id", "xml")
    found = {r.target: r.fallback for r in O.included(n, spark.createDataFrame([(2, "two.xml")], "doc_id long, uri string")).collect()}
    assert found == {2: False, None: True}
    copied = O.copies(A.everywhere(n, A.test("b")), n).drop("source", "ctx")
    assert O.serialized(copied).first().markup == "<b>x<c/></b>"
    every = A.everywhere(n, A.test())
    rule = O.matched(every, [("any", every, -0.5), ("b", A.everywhere(n, A.test("b")), 0.0)]).where("local = 'b'").first().rule
    assert rule == "b"


def test_facets_and_defaults(spark):
    rows = spark.createDataFrame([("872-AA", 5), ("87-AA", 200), (None, None)], "sku string, q int")
    bad = rows.select(F.concat(V.facets(F.col("sku"), pattern=r"\d{3}-[A-Z]{2}"), V.facets(F.col("q"), bounds=(1, 99))).alias("b")).collect()
    assert [r.b for r in bad] == [[], ["pattern", "bounds"], []]
    n = shred_xml(spark.createDataFrame([(1, '<a><b x="1"/><b/></a>')], "id long, xml string"), "id", "xml")
    got = V.with_defaults(n, spark.createDataFrame([("b", "x", "0")], "local string, name string, value string"))
    assert sorted(r.value for r in got.collect()) == ["0", "1"]


def merged(events):
    """(event, name, value) with the pieces of a text joined."""
    out = []
    for e, n, v in events:
        if e == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", None, out[-1][2] + v)
        else:
            out.append((e, n, v))
    return out


def test_take_at_every_cut():
    text = '<a k="1">x<!-- c --><b/>y<![CDATA[<z>]]></a>'
    whole = merged((e, n, v) for _, e, n, v, _ in take(text, [], 0, True)[0])
    for cut in range(len(text)):
        names, rows = [], []
        got, tail, seq = take(text[:cut], names, 0, False)
        rows += got
        rows += take(tail + text[cut:], names, seq, True)[0]
        assert merged((e, n, v) for _, e, n, v, _ in rows) == whole


def test_long_texts_are_not_kept():
    names, tail, seq = [], "", 0
    for chunk in ["<a>", *["x" * 1000] * 50, "y<!-- c", " d -->z</a>"]:
        rows, tail, seq = take(tail + chunk, names, seq, False)
        assert len(tail) < 10
    assert names == []


def test_push_stream(spark, tmp_path):
    text = "<a><b>hello</b><c/></a>"
    chunks = [(d, i, text[i * 4 : i * 4 + 4], i * 4 + 4 >= len(text)) for d in (1, 2) for i in range(-(-len(text) // 4))]
    random.Random(1).shuffle(chunks)
    source = str(tmp_path / "in")
    schema = "doc_id long, chunk long, content string, final boolean"
    for k in range(3):
        spark.createDataFrame(chunks[k::3], schema).coalesce(1).write.mode("append").parquet(source)
    stream = push_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.format("memory").queryName("pushed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    for d in (1, 2):
        events = whole_texts(spark.table("pushed")).where(f"doc_id = {d}").orderBy("seq").collect()
        assert [(e.event, e.name, e.value) for e in events] == [("start", "a", None), ("start", "b", None), ("text", None, "hello"), ("end", "b", None), ("start", "c", None), ("end", "c", None), ("end", "a", None)]


def test_flat_rows(spark, tmp_path):
    path = str(tmp_path / "rows.xml")
    with open(path, "w") as f:
        f.write("<depot><crate><mark>Fir</mark></crate><crate><mark>Ash</mark></crate></depot>")
    assert [r.mark for r in read_rows(spark, path, "crate", "mark string").orderBy("mark").collect()] == ["Ash", "Fir"]
    assert spark.range(1).select(line_ends(F.lit("a\r\nb\rc"))).first()[0] == "a\nb\nc"


def test_ampersands_without_a_reference(spark):
    html = "<p k='a&amp;b&copy=1'>x&amp <b>&am</b>&</p><i>&amp;am&lt;&\ufdd0&ampx; \ufdd01</i>"
    nodes = shred_html(spark.createDataFrame([(1, html)], "id long, html string"), "id", "html")
    assert [r.value for r in nodes.where("value is not null").orderBy("pre").collect()] == ["a&b&copy=1", "x&amp ", "&am", "&", "&am<&\ufdd0&ampx; \ufdd01"]
    assert O.serialized(nodes, html=True).first().markup == '<p k="a&amp;b&amp;copy=1">x&amp <b>&am</b>&</p><i>&amp;am&lt;&\ufdd0&ampx; \ufdd01</i>'
