"""Chunks that arrive over time: pieces, references, patterns, and the work that a long construct takes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from thicket.operators.paths import CHILD, DESCENDANT, matching, on_paths, path_table
from thicket.sources.shred import ELEMENT, shred_xml
from thicket.streaming.push import BUCKETS, Parser, plain_texts, push_events, push_matches, take, unescaped, whole_texts

SCHEMA = "doc_id long, chunk long, content string, final boolean"
LONG = {
    "cdata": ("<a><![CDATA[", "]]></a>"),
    "comment": ("<a><!--", "--></a>"),
    "instruction": ("<a><?p ", "?></a>"),
    "value": ('<a k="', '"></a>'),
    "attributes": ("<a " + "k='1' " * 1000, "></a>"),
    "doctype": ("<!DOCTYPE a [<!--", "-->]><a/>"),
    "declaration": ("<!DOCTYPE a [<!ENTITY e '", "'>]><a/>"),
    "text": ("<a>", "</a>"),
}


def streamed(spark, tmp_path, chunks, make, name, files=3):
    for k in range(files):
        spark.createDataFrame(chunks[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def cut(texts, size, seed):
    chunks = [(d, i // size, t[i : i + size], i + size >= len(t)) for d, t in texts.items() for i in range(0, len(t), size)]
    random.Random(seed).shuffle(chunks)
    return chunks


@pytest.mark.parametrize("kind", LONG)
def test_long_constructs_take_work_in_proportion(kind):
    begin, end = LONG[kind]

    def seconds(megabytes):
        parser, piece, started = Parser([]), "x" * 65_536, time.process_time()
        parser.feed(begin)
        for _ in range(megabytes * 16):
            parser.feed(piece)
            assert kind in ("value", "attributes", "declaration", "doctype") or sum(map(len, parser.held)) + len(parser.carry) < 10
        assert parser.feed(end, True)[-1][1] == "end"
        return time.process_time() - started

    seconds(1)
    assert seconds(32) < 12 * max(seconds(8), 0.02)  # four times the input; reading again would take sixteen times


@pytest.mark.parametrize("seed", range(30))
def test_pieces_join_to_what_one_read_gives(seed):
    rng = random.Random(seed)
    bits = ["<a>", "</a>", "<b k='1>'/>", "x", "]]>", "<![CDATA[", "<!--", "-->", "<?p ", "?>", "&lt;", "<", '"', " ", "<!DOCTYPE a [", "<!E '", "]>", "<!-", "--"]
    text = "".join(rng.choice(bits) for _ in range(40))
    want = [(e, n, v) for _, e, n, v, _ in take(text, [], 0, True)[0]]
    parser, rows, at = Parser([]), [], 0
    while at < len(text):
        size = rng.randint(1, 6)
        rows += parser.feed(text[at : at + size], at + size >= len(text))
        at += size
    assert [r[0] for r in rows] == list(range(len(rows)))
    got, more = [], False
    for _, event, name, value, _, goes_on in rows:
        if event == "error" and name in ("<!--", "<?", "<![CDATA["):  # its pieces are out already
            got.append(("error", None, name + (got.pop()[2] if more else "")))
        elif event != "error" and (more or (event == "text" and got and got[-1][0] == "text")):
            got[-1] = (event, name, got[-1][2] + value)
        else:
            got.append((event, name, value))
        more = goes_on
    joined = []
    for e in want:
        if e[0] == "text" and joined and joined[-1][0] == "text":
            joined[-1] = ("text", None, joined[-1][2] + e[2])
        else:
            joined.append(e)
    assert got == joined


def test_cdata_and_references(spark, tmp_path):
    texts = {1: "<a>x &lt;&amp;amp; &#65;&#x1F600;<![CDATA[&lt;<b>]]>&#0;&e; &</a>", 2: "<a><![CDATA[]]><!--&lt;--><![CDATA[u]]><![CDATA[v]]></a>"}
    events = streamed(spark, tmp_path, cut(texts, 3, 1), push_events, "cdata_pushed")
    whole = whole_texts(events)
    rows = {d: [(r.event, r.value) for r in whole.where(f"doc_id = {d}").orderBy("seq").collect()] for d in texts}
    assert rows[1] == [("start", None), ("text", "x &lt;&amp;amp; &#65;&#x1F600;"), ("cdata", "&lt;<b>"), ("text", "&#0;&e; &"), ("end", None)]
    assert rows[2] == [("start", None), ("cdata", ""), ("comment", "&lt;"), ("cdata", "u"), ("cdata", "v"), ("end", None)]
    plain = {d: [(r.event, r.value) for r in plain_texts(whole).where(f"doc_id = {d}").orderBy("seq").collect()] for d in texts}
    assert plain[1] == [("start", None), ("text", "x <&amp; A\U0001f600&lt;<b>&#0;&e; &"), ("end", None)]
    assert plain[2] == [("start", None), ("text", ""), ("comment", "&lt;"), ("text", "uv"), ("end", None)]


def test_unescaped(spark):
    cases = {"": "", "a": "a", "&": "&", "&&lt;": "&<", "&lt": "&lt", "&#x41;&#x041;": "AA", "&#xD800;": "&#xD800;", "&#99999999999999;": "&#99999999999999;", "&#1114112;": "&#1114112;", "&#10;b": "\nb", "&apos;&quot;&gt;": "'\">", "&LT;": "&LT;", "&#;": "&#;", "&#x;": "&#x;"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string").select("t", "want", unescaped(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_streamed_patterns_equal_those_of_stored_nodes(spark, tmp_path):
    rng = random.Random(8)

    def tree(depth):
        name = rng.choice(["a", "b", "c", "p:b"])
        return f"<{name}>{''.join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else '<c/>'}</{name}>"

    texts = {d: f"<r xmlns:p='u'>{tree(5)}</r>" for d in range(6)}
    nodes = shred_xml(spark.createDataFrame(list(texts.items()), "id long, xml string"), "id", "xml").cache()
    for i, pattern in enumerate([[(DESCENDANT, "a"), (DESCENDANT, "b")], [(CHILD, "r"), (CHILD, "*"), (DESCENDANT, "c")], [(DESCENDANT, "b"), (CHILD, "*"), (CHILD, "c")], [(CHILD, "b")]]):
        folder = tmp_path / str(i)
        found = streamed(spark, folder, cut(texts, 7, i), lambda c, p=pattern: push_matches(c, p), f"matched_{i}")
        got = sorted((r.doc_id, r.name, r.depth) for r in found.collect())
        hits = on_paths(nodes, matching(path_table(nodes), pattern)).where(F.col("kind") == ELEMENT)
        assert got == sorted((r.doc_id, r.name, r.level - 1) for r in hits.collect())
        assert got or i == 3
    with pytest.raises(ValueError):
        push_matches(spark.createDataFrame([], SCHEMA), [])
    nodes.unpersist()


def test_state_of_many_documents_is_kept_by_bucket(spark, tmp_path):
    ids = [None, (1 << 62) + 1, *range(3000)]
    halves = [[(d, k, text, k == 1) for d in ids] for k, text in enumerate(("<a><b", "/></a>"))]
    for half in halves:
        spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = push_matches(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), [(CHILD, "a"), (CHILD, "b")])
    query = stream.writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {r.doc_id for r in spark.table("buckets").collect()} == set(ids)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(kept) <= BUCKETS < len(ids)
