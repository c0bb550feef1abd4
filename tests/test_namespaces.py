"""Pretty printing, exclusive canonical form, subsets of documents, and namespace errors."""

import random


from thicket.operators import output as O
from thicket.operators.axes import without_blank_text
from thicket.sources.shred import shred_xml


def shredded(spark, *texts):
    return shred_xml(spark.createDataFrame(list(enumerate(texts)), "id long, xml string"), "id", "xml")


#: A document, its exclusive canonical form with comments.
EXCLUSIVE = [
    ('<root xmlns:p="http://u/p" xml:lang="en"><p:a xml:space="preserve" p:x="1"/><p:b xmlns:p="http://u/2"><p:c xmlns:p="http://u/1"/></p:b></root>', '<root xml:lang="en"><p:a xmlns:p="http://u/p" p:x="1" xml:space="preserve"></p:a><p:b xmlns:p="http://u/2"><p:c xmlns:p="http://u/1"></p:c></p:b></root>'),
    ('<!--x--><r xmlns="u" xmlns:q="v" xmlns:n="w"><a q:k="1"><q:b/></a><c xmlns=""><d xmlns="u"/></c></r><!--y-->', '<!--x-->\n<r xmlns="u"><a xmlns:q="v" q:k="1"><q:b></q:b></a><c xmlns=""><d xmlns="u"></d></c></r>\n<!--y-->'),
    ('<p:r xmlns:p="u"><a><p:b><c xmlns:p="w"><p:d/></c></p:b></a></p:r>', '<p:r xmlns:p="u"><a><p:b><c><p:d xmlns:p="w"></p:d></c></p:b></a></p:r>'),
]


def test_exclusive(spark):
    got = {r.doc_id: r.markup for r in O.serialized(shredded(spark, *(a for a, _ in EXCLUSIVE)), exclusive=(), comments=True).collect()}
    assert got == {i: want for i, (_, want) in enumerate(EXCLUSIVE)}


def test_listed_prefixes_and_subsets(spark):
    nodes = shredded(spark, '<r xmlns="u" xmlns:q="v" xmlns:n="w"><a q:k="1"><q:b xmlns:q="v" n:z=""/></a></r>')
    assert [r.markup for r in O.serialized(nodes, exclusive=("q",)).collect()] == ['<r xmlns="u" xmlns:q="v"><a q:k="1"><q:b xmlns:n="w" n:z=""></q:b></a></r>']
    # Without the outer element, and without the one between.
    part = nodes.where("coalesce(local, '') not in ('r', 'k') and not (kind = 2 and level = 2)")
    assert [r.markup for r in O.serialized(part, exclusive=()).collect()] == ['<a xmlns="u"><q:b xmlns:n="w" xmlns:q="v" n:z=""></q:b></a>']


def test_exclusive_against_a_walk(spark):
    rng, texts, wants = random.Random(4), [], []

    def tree(depth, scope, rendered):
        own = {p: rng.choice(["u", "v"]) for p in ("", "p", "q") if rng.random() < 0.3}
        scope = scope | own
        prefix, key = rng.choice(["", "p", "q"]), rng.choice(["", "p", "q"])
        name, used = (f"{prefix}:" if prefix else "") + "e", {prefix, *([key] if key else [])}
        new = {p: scope.get(p, "") for p in used if rendered.get(p, "") != scope.get(p, "")}
        mark = lambda d: "".join(f' xmlns{":" * bool(p)}{p}="{u}"' for p, u in sorted(d.items()))
        attribute = (f" {key}:" if key else " ") + 'k="1"'
        inner = [tree(depth - 1, scope, rendered | new) for _ in range(rng.randint(0, 3))] if depth else []
        return f"<{name}{mark(own)}{attribute}>{''.join(a for a, _ in inner)}</{name}>", f"<{name}{mark(new)}{attribute}>{''.join(b for _, b in inner)}</{name}>"

    for _ in range(40):
        text, want = tree(5, {"p": "s", "q": "s"}, {})
        texts.append(f'<top xmlns:p="s" xmlns:q="s">{text}</top>')
        wants.append(f"<top>{want}</top>")
    got = {r.doc_id: r.markup for r in O.serialized(shredded(spark, *texts), exclusive=()).collect()}
    assert got == dict(enumerate(wants))


def test_namespace_errors(spark):
    docs = ["<a><p:b/></a>", '<a xmlns:p=""><p:b/></a>', '<a xmlns:xml="urn:x"/>', '<a xmlns:p="u" p:k="1" xml:id="2"><b q:k="1"/></a>', "", '<a xmlns="u"><b xmlns=""/></a>']
    rows = O.namespace_errors(shredded(spark, *docs)).orderBy("doc_id", "pre").collect()
    assert [(r.doc_id, r.message) for r in rows] == [
        (0, "Namespace prefix p on b is not defined"),
        (1, "xmlns:p: Empty XML namespace is not allowed"),
        (1, "Namespace prefix p on b is not defined"),
        (2, "xml namespace prefix mapped to wrong URI"),
        (3, "Namespace prefix q for k on b is not defined"),
    ]


def test_deep_uses_of_one_prefix(spark):
    """Uses that the parent makes too don't look further out: work linear in depth."""
    depth = 3000
    text = '<p:a xmlns:p="u">' + "<p:a>" * depth + "</p:a>" * depth + "</p:a>"
    nodes = shredded(spark, text)
    assert O._needed(nodes, ()).count() == 1
    assert O.serialized(nodes, exclusive=()).first().markup == text


#: A document without blank texts, its lines.
PRETTY = [
    ('<?p q?><a k="1"><b><c/><!--x--></b><d>t<e><f/></e></d><g>u</g></a>', '<?p q?>\n<a k="1">\n  <b>\n    <c/>\n    <!--x-->\n  </b>\n  <d>t<e><f/></e></d>\n  <g>u</g>\n</a>\n'),
    ("<a/>", "<a/>\n"),
    ("<!DOCTYPE a><a><b><![CDATA[ ]]></b><b></b></a>", "<!DOCTYPE a>\n<a>\n  <b> </b>\n  <b/>\n</a>\n"),
]


def test_pretty(spark):
    nodes = shredded(spark, *(a for a, _ in PRETTY))
    got = {r.doc_id: r.markup for r in O.pretty(nodes).collect()}
    assert got[0] == PRETTY[0][1] and got[1] == PRETTY[1][1]
    assert got[2].removeprefix("<!DOCTYPE a>\n") == PRETTY[2][1].removeprefix("<!DOCTYPE a>\n")
    again = shredded(spark, *(got[i] for i in range(3)))
    assert {r.doc_id: r.markup for r in O.pretty(without_blank_text(again)).collect()}[0] == PRETTY[0][1]
