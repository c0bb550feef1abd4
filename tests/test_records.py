"""Records of large files: every cut, every construct a cut can fall in, and streams that start again."""

import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from thicket.sources import records as R

PROLOG = """<?xml version="1.0"?><?x <row> ?><!-- <row> it's --><!DOCTYPE t SYSTEM "a<row>b>" [<!ENTITY e "<row a=']>'>"><!-- ]> <row> --><?p ]> "<row>?><!ELEMENT t ANY> ] >"""
BODY = """<t><row n="0"/><row n="1>'">a<!-- </row> --><row>inner</row><![CDATA[</row>]]]]>b</row><rows><rowx/></rows>
<row n='2"/>'>é<?p </row>?></row ><!-- <row n="x"> --><![CDATA[<row n="y">]]><a:row/><row
 n="3"></row><b c="&lt;row&gt;"/><row n="4" /></t>"""


def expected(text):
    """Outermost rows by a parser: their serial numbers in n."""
    found = []

    def walk(e):
        for child in e:
            if child.tag == "row":
                found.append(child.get("n"))
            else:
                walk(child)

    walk(ElementTree.fromstring(text.replace("<a:row/>", "<arow/>")))
    return found


def test_lexer_at_every_cut():
    text = PROLOG + BODY
    pieces = text.split("<")
    want = None
    for cut in range(1, len(pieces)):
        rows = [("f", 0, p) for p in pieces[:cut]] + [("f", 10, p) for p in pieces[cut:]]
        frame = R.pd.DataFrame(rows, columns=["file", "block", "value"])
        [summary] = R._summaries("row")(iter([frame]))
        placed = frame.merge(R._starts(summary), on=["file", "block"])
        [out] = R._cut("row")(iter([placed]))
        joined = "".join(t + ("\n--\n" if last else "") for t, last in zip(out["text"], out["last"]))
        want = want or joined
        assert joined == want, cut
    found = want.split("\n--\n")[:-1]
    assert [re.search(r"n=.(\d)", t).group(1) for t in found] == ["0", "1", "2", "3", "4"]
    assert [ElementTree.fromstring(t).get("n") for t in found] == expected(BODY)


@pytest.mark.parametrize("split", [150, 10**6])
@pytest.mark.parametrize("broadcast", [True, False])
def test_splits(spark, tmp_path, split, broadcast):
    long = "<row n='9'>" + "<x>y</x><!-- </row> -->" * 20 + "</row>"
    (tmp_path / "a.xml").write_text(PROLOG + BODY.replace("</t>", long + "</t>"))
    (tmp_path / "b.xml").write_text("text <row>1</row><row/><row>cut off")
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text("no elements")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, str(split))
        found = R.read_records(spark, str(tmp_path), "row", broadcast_blocks=10**6 if broadcast else 0)
        rows = [(r.file[-5:], r.complete, r.text) for r in found.orderBy("file", "block", "nr").collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    a = [t for f, _, t in rows if f == "a.xml"]
    assert [ElementTree.fromstring(t).get("n") for t in a] == ["0", "1>'", '2"/>', "3", "4", "9"] and a[-1] == long
    assert [(c, t) for f, c, t in rows if f == "b.xml"] == [(True, "<row>1</row>"), (True, "<row/>"), (False, "<row>cut off")]
    assert len(rows) == 9


def test_stream_starts_again(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    sink = lambda found, batch: found.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
    for k in range(3):
        (folder / f"{k}.xml").write_text(f"<t><row>{k}</row><row>{k}b</row></t>")
        q = R.stream_records(spark, str(folder), "row", sink, str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(r.text for r in got.collect()) == sorted(f"<row>{k}{s}</row>" for k in range(3) for s in ("", "b"))
    assert got.select("batch").distinct().count() == 3
