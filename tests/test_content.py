"""Content models: against regular expressions, over any partitioning, and streamed against batch."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.plans import content as C
from thicket.plans.queries import _pushed
from thicket.sources.shred import shred_xml

LEAVES = st.sampled_from("abc").map(C.name)
COUNTS = st.tuples(st.integers(0, 3), st.integers(0, 3) | st.none()).map(lambda c: (c[0], None if c[1] is None else c[0] + c[1]))
MODELS = st.recursive(LEAVES, lambda m: st.one_of(st.lists(m, max_size=3).map(lambda p: C.sequence(*p)), st.lists(m, min_size=1, max_size=3).map(lambda p: C.choice(*p)), st.tuples(m, COUNTS).map(lambda t: C.repeated(t[0], *t[1]))), max_leaves=5)


def pattern(model):
    kind, *parts = model
    if kind == "name":
        return parts[0]
    if kind == "repeated":
        part, low, high = parts
        return f"(?:{pattern(part)}){{{low},{'' if high is None else high}}}"
    return "(?:" + ("" if kind == "sequence" else "|").join(map(pattern, parts)) + ")"


@settings(max_examples=300, deadline=None)
@given(MODELS, st.lists(st.text("abc", max_size=9), max_size=20))
def test_states_against_regular_expressions(model, texts):
    automata = C.Automata({"x": model})
    for text in ["", *texts]:
        state = automata.start["x"]
        for letter in text:
            state = automata.after(state, letter)
        good = state != C.DEAD and state not in automata.unfinished
        assert good == bool(re.fullmatch(pattern(model), text)), (model, text)


def test_ambiguity_and_limits():
    a, b = C.name("a"), C.name("b")
    assert C.ambiguous(C.choice(C.sequence(a, b), a)) == ["a"]
    assert C.ambiguous(C.sequence(C.repeated(a), a)) == ["a"]
    assert C.ambiguous(C.repeated(C.sequence(a, C.repeated(b, 0, 1)), 2, 5)) == []
    assert C.ambiguous(C.sequence(C.repeated(a, 0, 1), b, a)) == []
    assert C.Automata({"x": C.repeated(a, 900, 1000)}).n == 1003
    with pytest.raises(ValueError):
        C.Automata({"x": C.repeated(a, 0, 10_001)})
    with pytest.raises(ValueError):
        C.repeated(a, 2, 1)


MODEL = C.Automata({"t": C.sequence(C.repeated(C.name("a"), 2, 3), C.repeated(C.choice(C.name("b"), C.name("t")))), "big": C.repeated(C.sequence(C.name("a"), C.name("b")), 1), "a": C.sequence(), "free": None})
TEXTS = {
    1: "<t><a/><a/><b/></t>",
    2: "<t><a/><b/><b/></t>",
    3: "<t><a/></t>",
    4: "<t><a/><a/><t><a/><a/><a/><a/></t><t/></t>",
    5: "<free><a><a/></a><free/></free>",
    6: "<big>" + "<a/><b/>" * 400 + "</big>",
    7: "<big>" + "<a/><b/>" * 200 + "<b/>" + "<a/><b/>" * 200 + "</big>",
    8: "<big>" + "<a/><b/>" * 400 + "<a/></big>",
    9: None,
}


@pytest.mark.parametrize("partitions", [1, 13])
def test_batch_and_stream(spark, partitions):
    docs = spark.createDataFrame(list(TEXTS.items()), "id long, xml string")
    nodes = shred_xml(docs, "id", "xml")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = C.content_violations(nodes, MODEL).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    names = {(r.doc_id, r.pre): r.local for r in nodes.select("doc_id", "pre", "local").collect()}
    seen = sorted((r.doc_id, r.local, r.violation, names.get((r.doc_id, r.at), "")) for r in found if r.violation != C.UNDECLARED)
    assert seen == [(2, "t", "unexpected", "b"), (3, "t", "incomplete", ""), (4, "t", "incomplete", ""), (4, "t", "unexpected", "a"), (5, "a", "unexpected", "a"), (7, "big", "unexpected", "b"), (8, "big", "incomplete", "")]
    [at] = [r.at for r in found if r.doc_id == 7 and r.violation == C.UNEXPECTED]
    before = [r.pre for r in nodes.where("doc_id = 7 and local = 'b'").orderBy("pre").collect()]
    assert at == before[200]
    undeclared = [r for r in found if r.violation == C.UNDECLARED]
    assert len(undeclared) == 1 + 2 + 400 + 401 + 400 and {r.local for r in undeclared} == {"b"}
    if partitions == 1:
        streamed = _pushed(docs.where("xml is not null"), 60, lambda chunks: C.push_violations(chunks, MODEL)).collect()
        assert sorted((r.doc_id, r.local, r.violation) for r in streamed) == sorted((r.doc_id, r.local, r.violation) for r in found)
    assert not C.content_violations(nodes.where("false"), MODEL).collect()
