"""Tree operators on inputs that the registered queries leave out."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from thicket.functions import xpath as X
from thicket.operators import axes as A
from thicket.operators import output as O
from thicket.plans import queries
from thicket.sources.files import resolved
from thicket.sources.shred import shred_html
from thicket.streaming.push import push_events, take, whole_texts

from test_tree import merged

#: Rules whose prefixes end inside a segment, at a slash, nowhere, and at a whole URI; and an exact entry.
RULES = [("rewrite", "https://", "mirror/"), ("rewrite", "http", "never/"), ("rewrite", "http://host/docbook/xml/4.", "db4/"), ("rewrite", "http://host/docbook/", "db/"), ("rewrite", "https://exam", "e/"), ("uri", "urn:x", "x.xml"), ("uri", "http://host/exact", "exact.xml")]


def by_hand(uri):
    exact = [t for k, n, t in RULES if k != "rewrite" and n == uri]
    fits = [(len(n), t) for k, n, t in RULES if k == "rewrite" and uri is not None and uri.startswith(n)]
    return exact[0] if exact else max(fits)[1] + uri[max(fits)[0] :] if fits else uri


def test_longest_prefix_inside_a_segment(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "kind string, name string, target string")
    uris = ["http://host/docbook/xml/4.5/a", "http://host/docbook/xml/5/a", "http", "htt", "", None, "https://example/é", "https://other/a", "urn:x", "urn:xy", "http://host/exact", "http://host/exact"]
    got = resolved(spark.createDataFrame([(u,) for u in uris], "uri string"), rules).collect()
    assert sorted((str(r.uri), str(r.resolved)) for r in got) == sorted((str(u), str(by_hand(u))) for u in uris)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    got = resolved(pages, rules, "url").collect()
    assert all(r.resolved == by_hand(r.url) for r in got) and len(got) == pages.count()
    assert sum(r.resolved.startswith("never/") for r in got) == pages.where(F.col("url").startswith("http://")).count() > 0
    assert all(r.resolved == r.url for r in resolved(pages, rules.limit(0), "url").collect())


SUBSET = """<!DOCTYPE a PUBLIC "-//x>y" 'a.dtd' [<!-- ]> " --><!ENTITY e "]>'<b>"><?p ]> ' ?>%pe; <!ATTLIST a k CDATA 'x">'>] >"""
#: Text, its events.
PUSHED = [
    ('<!DOCTYPE html><a t="x > y" u=\'/>\'>z</a>', [("doctype", "html", None), ("start", "a", "t=\"x > y\" u='/>'"), ("text", None, "z"), ("end", "a", None)]),
    ('<!doctype a><a t="/"/>', [("doctype", "a", None), ("start", "a", 't="/"'), ("end", "a", None)]),
    (SUBSET + "<a/>", [("doctype", "a", SUBSET[12:-1].strip()), ("start", "a", None), ("end", "a", None)]),
    ("<a>1 < 2 <b/></a>", [("start", "a", None), ("text", None, "1 "), ("error", None, "<"), ("text", None, " 2 "), ("start", "b", None), ("end", "b", None), ("end", "a", None)]),
    ('<a><b t="x<c/></a>', [("start", "a", None), ("error", None, '<b t="x'), ("start", "c", None), ("end", "c", None), ("end", "a", None)]),
    ("<!ELEMENT x><a b<c/>", [("error", None, "<!"), ("text", None, "ELEMENT x>"), ("error", None, "<a b"), ("start", "c", None), ("end", "c", None)]),
    ("<!DOCTYPE a [ <p/>", [("error", None, "<!DOCTYPE a [ "), ("start", "p", None), ("end", "p", None)]),
    ("</ a><![CDAT[x]]>", [("error", None, "</"), ("text", None, " a>"), ("error", None, "<!"), ("text", None, "[CDAT[x]]>")]),
    ("x<a", [("text", None, "x"), ("error", None, "<a")]),
]


@pytest.mark.parametrize("text, want", PUSHED)
def test_take_goes_on_at_every_cut(text, want):
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            names, rows, tail, seq = [], [], "", 0
            for piece, final in ((text[:i], False), (text[i:j], False), (text[j:], True)):
                got, tail, seq = take(tail + piece, names, seq, final)
                rows += got
            assert merged((e, n, v) for _, e, n, v, _ in rows) == merged(want), (i, j)


def test_take_leaves_no_tail_behind_a_doctype():
    assert take("<!DOCTYPE html><p>x<p", [], 0, False)[1] == "<p"


def test_push_whole_pages(spark, sf_dir, tmp_path):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(12).collect()}
    rng, chunks = random.Random(5), []
    for k, html in pages.items():
        cuts = [0, *sorted(rng.sample(range(1, len(html)), 6)), len(html)]
        chunks += [(k, i, html[a:b], b == len(html)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rng.shuffle(chunks)
    schema = "doc_id long, chunk long, content string, final boolean"
    for k in range(2):
        spark.createDataFrame(chunks[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = push_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("pages_pushed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = whole_texts(spark.table("pages_pushed")).orderBy("seq").collect()
    for k, html in pages.items():
        events = [(r.event, r.name, r.value) for r in got if r.doc_id == k]
        assert events == merged((e, n, v) for _, e, n, v, _ in take(html, [], 0, True)[0])
        assert events[0] == ("doctype", "html", None)
        assert [n for e, n, _ in events if e == "start"] == re.findall(r"<([a-z][a-z0-9]*)", html)
        assert "".join(v for e, _, v in events if e == "text") == re.sub(r"<!--.*?-->|<[^>]*>", "", html, flags=re.S)
        assert not [v for e, n, v in events if e == "error" and n is None]


def test_numerals(spark, sf_dir):
    #: 0 to 50, the numbers that region keys and p_size have.
    tens, ones = ["", "X", "XX", "XXX", "XL", "L"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    want = [t + o for t in tens for o in ones][:51]
    assert [want[i] for i in (0, 3, 4, 9, 14, 40, 49, 50)] == ["", "III", "IV", "IX", "XIV", "XL", "XLIX", "L"]
    for name, column in (("nation", "n_regionkey"), ("nation", "n_nationkey"), ("part", "p_size")):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(column).alias("n"), X.roman(F.col(column)).alias("numeral")).collect()
        assert rows and all(r.numeral == want[r.n] for r in rows)


def test_number_formats_calls_the_operator(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries.X, "roman", lambda n: F.concat(F.lit("r"), n.cast("string")))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    got = {r.n_nationkey: r.numeral for r in queries.QUERIES["number_formats"](spark, sf_dir).collect()}
    assert got == {r.n_nationkey: f"r{r.n_regionkey}" for r in nations.collect()}


class Seen(HTMLParser):
    """What a page says, by the standard parser alone."""

    def __init__(self, html):
        super().__init__()
        self.said = []
        self.feed(html)
        self.close()

    def add(self, *event):
        if event[0] == "text" and self.said and self.said[-1][0] == "text":
            event = ("text", self.said.pop()[1] + event[1])
        self.said.append(event)

    def handle_starttag(self, tag, attrs):
        self.add("start", tag, tuple((a, v or "") for a, v in attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        self.add("text", data)

    def handle_comment(self, data):
        self.add("comment", data)

    def handle_decl(self, decl):
        self.add("doctype", decl)


def test_pages_come_back_whole(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += [
        (-1, """<!-- a --><!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "x.dtd"><!-- b --><p z="1" a="&lt;&quot;" c>1 &lt; 2<br>x</p>"""),
        (-2, "<script>if (a < b && c > d) t('</p>&amp;')</script><style>p > a {}</style><textarea>&lt;b&gt;</textarea><title>&amp;</title>"),
        (-3, "<p>no type</p>"),
    ]
    docs = spark.createDataFrame(pages, "id long, h string")
    markup = O.serialized(shred_html(docs, "id", "h"), html=True).cache()
    again = {r.doc_id: r.markup for r in O.serialized(shred_html(markup, "doc_id", "markup"), html=True).collect()}
    got = {r.doc_id: r.markup for r in markup.collect()}
    assert got == again and len(got) == len(pages)
    for k, html in pages:
        assert Seen(got[k]).said == Seen(html).said
    assert got[-2].startswith("<script>if (a < b && c > d) t('</p>&amp;')</script><style>p > a {}</style>")
    assert queries.QUERIES["serialize_pages"](spark, sf_dir).where("markup like '<!DOCTYPE html><html%'").count() == len(pages) - 3
    empty = shred_html(spark.createDataFrame([(1, "<!DOCTYPE html>"), (2, "<p>x</p><!DOCTYPE html>")], "id long, h string"), "id", "h")
    assert {r.doc_id: r.markup for r in O.serialized(empty, html=True).collect()} == {1: "<!DOCTYPE html>", 2: "<p>x</p>"}
    assert O.serialized(empty.where("doc_id = 1"), canonical=True).first().markup == ""
    assert A.string_values(empty.where("doc_id = 1"), empty).first().string == ""
