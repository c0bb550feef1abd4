"""Includes replaced to the end: nesting, fallbacks, loops, texts, namespaces, and documents against a recursive walk."""

import random

from thicket.operators.xinclude import spliced

XI = 'xmlns:xi="http://www.w3.org/2001/XInclude"'


def run(spark, *docs):
    rows = [(i, uri, text) for i, (uri, text) in enumerate(docs)]
    markup, faults = spliced(spark.createDataFrame(rows, "doc_id long, uri string, xml string"))
    return {r.doc_id: r.markup for r in markup.collect()}, sorted((r.doc_id, r.href, r.message) for r in faults.collect())


def test_nested_fallbacks_loops_and_texts(spark):
    inc = lambda href, inner="", more="": f'<xi:include href="{href}"{more}>{inner}</xi:include>'
    got, faults = run(
        spark,
        ("http://h/d/a.xml", f'<r {XI} xmlns="u">1{inc("b.xml")}2{inc("../t.txt", more=" parse=" + chr(34) + "text" + chr(34))}<e>{inc("/d/b.xml")}</e></r>'),
        ("http://h/d/b.xml", f'<!--c--><b {XI}>{inc("c.xml")}</b><?p q?>'),
        ("http://h/d/c.xml", '<c k="1&amp;">x</c>'),
        ("http://h/t.txt", "a < b"),
        ("http://h/m", f'<m {XI}>{inc("none", "<y/><xi:fallback z=" + chr(34) * 2 + ">f" + inc("d/c.xml") + inc("gone") + "</xi:fallback>")}</m>'),
        ("http://h/l1", f'<l {XI}>1{inc("l2")}</l>'),
        ("http://h/l2", f'<l {XI}>2{inc("l1")}</l>'),
        ("http://h/s", f'<xi:include {XI} href="d/c.xml"/>'),
        (None, None),
        ("http://h/w", f'<w {XI}>{inc("t.txt")}</w>'),
        (None, f'<n {XI}>{inc("http://h/d/c.xml")}</n>'),
    )
    b = f'<!--c--><b xmlns="" {XI}><c xmlns="" k="1&amp;">x</c></b><?p q?>'
    assert got == {
        0: f'<r {XI} xmlns="u">1{b}2a &lt; b<e>{b}</e></r>',
        1: b.replace('<b xmlns=""', "<b"),
        2: '<c k="1&amp;">x</c>',
        4: f'<m {XI}>f<c xmlns="" k="1&amp;">x</c></m>',
        5: f'<l {XI}>1<l xmlns="" {XI}>2</l></l>',
        6: f'<l {XI}>2<l xmlns="" {XI}>1</l></l>',
        7: '<c xmlns="" k="1&amp;">x</c>',
        9: f"<w {XI}></w>",
        10: f'<n {XI}><c xmlns="" k="1&amp;">x</c></n>',
    }
    assert faults == [(4, "gone", "nothing has this URI"), (5, "l1", "it includes itself"), (6, "l2", "it includes itself"), (9, "t.txt", "not well-formed")]


def test_against_a_walk(spark):
    rng, n = random.Random(6), 25
    links = {i: [rng.choice([rng.randrange(n), rng.randrange(n), -1]) for _ in range(rng.randint(0, 2))] for i in range(n)}

    def markup(i, chain):
        inner = "".join("-" if j < 0 else "" if j in chain else markup(j, [*chain, j]) for j in links[i])
        return f"<d{i}{' xmlns=' + chr(34) * 2 if len(chain) > 1 else ''} {XI}>{inner}</d{i}>"

    docs = [(f"u:{i}", f"<d{i} {XI}>" + "".join(f'<xi:include href="u:{j}"><xi:fallback>-</xi:fallback></xi:include>' for j in links[i]) + f"</d{i}>") for i in range(n)]
    got, faults = run(spark, *docs)
    assert got == {i: markup(i, [i]) for i in range(n)}
    assert faults and {m for _, _, m in faults} == {"it includes itself"}


def test_nothing_to_include(spark):
    assert run(spark, (None, "<a/>")) == ({0: "<a></a>"}, [])
    markup, faults = spliced(spark.createDataFrame([], "doc_id long, uri string, xml string"))
    assert markup.count() == faults.count() == 0
