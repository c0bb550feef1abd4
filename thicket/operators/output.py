"""Node rows to text, and stylesheet-like output, without Python code on the rows.

Markup is a row for each start tag, end tag and leaf; a document's markup is put in order and joined. A document is
gathered in one task, as it was when it was read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.xpath import escape
from thicket.operators.axes import declarations, inside, step, string_values
from thicket.sources.shred import ATTRIBUTE, BARE, COMMENT, DOCUMENT, ELEMENT, INSTRUCTION, ITSELF, MARK, RAW_TEXT, TEXT, VOID
from thicket.sources.store import unbroadcast

XML, XMLNS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"


def serialized(nodes: DataFrame, html: bool = False, canonical: bool = False, comments: bool = False, exclusive: Sequence[str] | None = None) -> DataFrame:
    """``doc_id`` and ``markup``. ``html``: void elements have no end tag, and text in script and style stands as it is. ``canonical``: attributes in order of their
    namespace and name (declarations first, of these the default first), no declarations that an element inherits anyway, no empty-element tags,
    no comments (but with ``comments``), no DOCTYPE, and line feeds between the root and what stands outside of it.

    ``exclusive``: canonical, with a prefix declared only where an element or attribute of the output uses it and no element of the output
    around does so with the same namespace; the prefixes given ('' for the default) are treated as in the inclusive form. ``nodes`` may then be
    any set of nodes (a subset of a document): what is left out around a node declares nothing.
    """
    pieces = markup_pieces(nodes, html, canonical or exclusive is not None, comments, exclusive)
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("markup"))


def pretty(nodes: DataFrame, indent: str = "  ") -> DataFrame:
    """``doc_id`` and ``markup`` with each node on a line of its own, indented by level, but as it stands inside of elements that hold text directly,
    however deep. Texts of white space alone count as text; take them away before (``axes.without_blank_text``) to have them replaced."""
    holders = nodes.where((F.col("kind") == TEXT) & (F.col("level") > 1)).select("doc_id", F.col("parent").alias("pre")).distinct()
    mixed = unbroadcast(nodes.select("doc_id", "pre", "size").join(holders, ["doc_id", "pre"], "left_semi"))
    fixed = inside(nodes.select("doc_id", "pre", "last"), mixed, itself=False).select("doc_id", "pre").distinct().withColumn("_f", F.lit(True))
    within = mixed.select("doc_id", "pre", F.lit(True).alias("_m"))
    own = nodes.where(F.col("kind") != ATTRIBUTE).select("doc_id", "pre", "level", "kind").join(fixed, ["doc_id", "pre"], "left").join(within, ["doc_id", "pre"], "left")
    full = nodes.where((F.col("kind") != ATTRIBUTE) & (F.col("level") > 1)).select("doc_id", F.col("parent").alias("pre"), F.lit(True).alias("_b")).distinct()
    placed = markup_pieces(nodes).join(own, ["doc_id", "pre"]).join(full, ["doc_id", "pre"], "left")
    margin = F.repeat(F.lit(indent), F.col("level") - 1)
    ends = F.col("p.side") == 1
    # A node ends its line, or its start does if it goes on below.
    opens = F.concat(margin, F.col("p.t"), F.when(F.col("_b") & F.col("_m").isNull(), "\n").otherwise(""))
    closes = F.concat(F.when(F.col("_b") & F.col("_m").isNull(), margin).otherwise(""), F.col("p.t"), F.lit("\n"))
    typed = F.when(~ends & (F.col("p.t") != ""), F.concat(F.col("p.t"), F.lit("\n"))).otherwise("")
    t = F.when(F.col("kind") == DOCUMENT, typed).when(F.col("_f").isNotNull(), F.col("p.t")).when(ends, closes).otherwise(opens)
    lines = placed.select("doc_id", F.struct("p.at", "p.side", "p.depth", t.alias("t")).alias("p"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("markup"))


def markup_pieces(nodes: DataFrame, html: bool = False, canonical: bool = False, comments: bool = False, exclusive: Sequence[str] | None = None, pairs: bool = False) -> DataFrame:
    """``doc_id``, ``pre`` and ``p``: start, leaf and end of each node as structs that sort in order of the document, with the text ``t``. ``pairs``: no empty-element tags."""
    a = nodes.where(F.col("kind") == ATTRIBUTE)
    if exclusive is not None:
        a = a.where(F.coalesce(F.col("ns_uri"), F.lit("")) != XMLNS).unionByName(_needed(nodes, exclusive), allowMissingColumns=True)
    elif canonical:
        a = a.join(_superfluous(nodes), ["doc_id", "pre"], "left_anti")
    declares = (F.col("name") == "xmlns") | F.startswith("name", F.lit("xmlns:"))
    rank = F.struct(F.when(declares, 0).otherwise(1), F.when(declares, "").otherwise(F.coalesce("ns_uri", F.lit(""))), F.when(F.col("name") == "xmlns", "").otherwise(F.col("local"))) if canonical else F.struct(F.lit(0), F.lit(""), F.lpad(F.col("pre").cast("string"), 10, "0"))
    text = F.concat(F.lit(" "), F.col("name"), F.lit('="'), escape(F.coalesce("value", F.lit("")), True, canonical), F.lit('"'))
    attributes = a.groupBy("doc_id", F.col("parent").alias("pre")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t")))), lambda x: x["t"]), "").alias("_a"))
    inner = nodes.where(F.col("kind") != ATTRIBUTE).join(attributes, ["doc_id", "pre"], "left").withColumn("_a", F.coalesce("_a", F.lit("")))
    # An element with only attributes below it is empty.
    children = nodes.where((F.col("kind") != ATTRIBUTE) & F.col("parent").isNotNull()).select("doc_id", F.col("parent").alias("pre")).distinct().withColumn("_c", F.lit(True))
    inner = inner.join(children, ["doc_id", "pre"], "left")
    plain = F.lit(False)
    if html:
        raw = nodes.where((F.col("kind") == ELEMENT) & F.col("local").isin(*sorted(RAW_TEXT))).select("doc_id", F.col("pre").alias("parent"), F.lit(True).alias("_raw"))
        inner, plain = inner.join(raw, ["doc_id", "parent"], "left"), F.col("_raw").isNotNull()
    before, after = F.lit(""), F.lit("")
    if canonical:
        root = nodes.where((F.col("kind") == ELEMENT) & (F.col("level") == 1)).groupBy("doc_id").agg(F.min("pre").alias("_root"))
        inner = inner.join(root, "doc_id", "left")
        outside = F.col("kind").isin(INSTRUCTION, COMMENT) & (F.col("level") == 1)
        before = F.when(outside & (F.col("pre") > F.col("_root")), "\n").otherwise("")
        after = F.when(outside & (F.col("pre") < F.col("_root")), "\n").otherwise("")
    void = F.col("local").isin(*sorted(VOID)) if html else F.lit(False)
    bare = F.col("_c").isNull() & F.lit(not canonical and not html and not pairs)
    start = F.concat(F.lit("<"), F.col("name"), F.col("_a"), F.when(bare, "/>").otherwise(">"))
    end = F.when(bare | void, "").otherwise(F.concat(F.lit("</"), F.col("name"), F.lit(">")))
    leaf = (
        F.when((F.col("kind") == TEXT) & plain, F.col("value"))
        .when((F.col("kind") == TEXT) & F.col("prefix").isNotNull() & F.lit(html), F.replace(F.replace(escape(F.col("prefix")), F.lit(BARE), F.lit("&")), F.lit(ITSELF), F.lit(MARK)))
        .when(F.col("kind") == TEXT, escape(F.col("value"), canonical=canonical))
        .when(F.col("kind") == COMMENT, F.lit("") if canonical and not comments else F.concat(before, F.lit("<!--"), F.col("value"), F.lit("-->"), after))
        .when(F.col("kind") == INSTRUCTION, F.concat(before, F.lit("<?"), F.col("name"), F.when(F.length("value") > 0, F.concat(F.lit(" "), F.col("value"))).otherwise(""), F.lit("?>"), after))
        .otherwise("")
    )
    # Ends come after everything below; of ends at one place, the innermost first.
    typed = (F.col("kind") == DOCUMENT) & F.col("name").isNotNull() & F.lit(not canonical)
    leaf = F.when(typed, F.concat(F.lit("<!"), F.col("name"), F.lit(">"))).otherwise(leaf)
    opened = F.struct(F.when(typed, F.col("sib")).otherwise(F.col("pre")).alias("at"), F.when(typed, -1).otherwise(0).alias("side"), F.lit(0).alias("depth"), F.when(F.col("kind") == ELEMENT, start).otherwise(leaf).alias("t"))
    closed = F.struct((F.col("pre") + F.col("size")).alias("at"), F.lit(1).alias("side"), (-F.col("level")).alias("depth"), F.when(F.col("kind") == ELEMENT, end).otherwise("").alias("t"))
    return unbroadcast(inner).select("doc_id", "pre", F.explode(F.array(opened, closed)).alias("p"))


def _superfluous(nodes: DataFrame) -> DataFrame:
    """``doc_id`` and ``pre`` of the declarations that say what the nearest one around of the same prefix says (none: no default)."""
    own = declarations(nodes)
    outer = inside(own.select("doc_id", "pre", "last", "attribute", "prefix", "uri"), own.select("doc_id", "pre", "size", "prefix", "uri"), itself=False).where("prefix = in_prefix")
    nearest = outer.groupBy("doc_id", "attribute").agg(F.max_by("in_uri", "in_pre").alias("outer"))
    told = own.join(nearest, ["doc_id", "attribute"], "left")
    return told.where((F.coalesce("outer", F.lit("")) == F.col("uri")) & ((F.col("prefix") == "") | F.col("outer").isNotNull())).select("doc_id", F.col("attribute").alias("pre"))


def _needed(nodes: DataFrame, inclusive: Sequence[str]) -> DataFrame:
    """Declarations of the exclusive form as attribute rows: of each use of a prefix whose nearest use around has another namespace.

    A use that the parent makes too says nothing new, whatever stands around, so only the others look further out.
    """
    uri = F.coalesce("ns_uri", F.lit(""))
    elements = nodes.where(F.col("kind") == ELEMENT)
    used = elements.select("doc_id", "pre", F.coalesce("prefix", F.lit("")).alias("prefix"), uri.alias("uri"))
    used = used.union(nodes.where((F.col("kind") == ATTRIBUTE) & F.col("prefix").isNotNull() & (uri != XMLNS)).select("doc_id", F.col("parent").alias("pre"), "prefix", uri.alias("uri")))
    used = unbroadcast(used.where(~F.col("prefix").isin("xml", "xmlns", *inclusive)).distinct())
    told = used.join(elements.select("doc_id", "pre", "size", "last", "parent"), ["doc_id", "pre"])
    news = told.join(used.withColumnRenamed("pre", "parent"), ["doc_id", "parent", "prefix", "uri"], "left_anti")
    outer = inside(news.select("doc_id", "pre", "last", "prefix"), news.select("doc_id", "pre", "size", "prefix", "uri"), itself=False).where("prefix = in_prefix")
    nearest = outer.groupBy("doc_id", "pre", "prefix").agg(F.max_by("in_uri", "in_pre").alias("outer"))
    own = news.join(nearest, ["doc_id", "pre", "prefix"], "left").where(F.coalesce("outer", F.lit("")) != F.col("uri")).where("prefix = '' or uri <> ''")
    own = own.select("doc_id", F.col("pre").alias("parent"), F.when(F.col("prefix") == "", "xmlns").otherwise(F.concat(F.lit("xmlns:"), F.col("prefix"))).alias("name"), F.when(F.col("prefix") == "", "xmlns").otherwise(F.col("prefix")).alias("local"), F.col("uri").alias("value"))
    if inclusive:
        declared = nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("ns_uri") == XMLNS) & F.when(F.col("prefix").isNull(), "").otherwise(F.col("local")).isin(*inclusive))
        own = own.unionByName(declared.join(_superfluous(nodes), ["doc_id", "pre"], "left_anti").select("doc_id", "parent", "name", "local", "value"))
    return own


def namespace_errors(nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``pre`` (of the element or attribute at fault) and ``message``: prefixes without a declaration, prefixes declared empty, and
    ``xml`` bound to another namespace than its own (or another prefix to that)."""
    at, uri = F.col("kind") == ATTRIBUTE, F.coalesce("ns_uri", F.lit(""))
    declares = at & (uri == XMLNS)
    prefix = F.when(declares & F.col("prefix").isNotNull(), F.col("local"))
    message = (
        F.when(declares & (prefix == "xml") & (F.col("value") != XML), "xml namespace prefix mapped to wrong URI")
        .when(declares & (prefix == "xmlns"), "redefinition of the xmlns prefix is forbidden")
        .when(declares & (F.coalesce(prefix, F.lit("")) != "xml") & (F.col("value") == XML), "xml namespace URI mapped to wrong prefix")
        .when(declares & (F.col("value") == ""), F.when(prefix.isNotNull(), F.concat(F.lit("xmlns:"), prefix, F.lit(": Empty XML namespace is not allowed"))))
        .when(declares, None)
        .when(F.col("prefix").isNotNull() & (uri == "") & (F.col("kind") == ELEMENT), F.concat(F.lit("Namespace prefix "), F.col("prefix"), F.lit(" on "), F.col("local"), F.lit(" is not defined")))
        .when(F.col("prefix").isNotNull() & (uri == "") & at, F.concat(F.lit("Namespace prefix "), F.col("prefix"), F.lit(" for "), F.col("local"), F.lit(" on "), F.col("up"), F.lit(" is not defined")))
    )
    return nodes.select("doc_id", "pre", message.alias("message")).where("message is not null")


def dump(nodes: DataFrame) -> DataFrame:
    """A line for each node: indented kind, name and value."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in {1: "ELEMENT", 2: "ATTRIBUTE", 3: "TEXT", 7: "PI", 8: "COMMENT", 9: "DOCUMENT"}.items() for x in kv)), F.col("kind"))
    return nodes.select("doc_id", "pre", F.concat(F.repeat(F.lit("  "), F.col("level")), kind, F.lit(" "), F.coalesce("name", F.lit("")), F.when(F.col("value").isNotNull(), F.concat(F.lit(" content="), F.col("value"))).otherwise("")).alias("line"))


def copies(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """``xsl:copy-of``: the subtree of each context node as a document of its own, numbered anew.

    ``doc_id`` is a hash of the source document and node, which come as ``source`` and ``ctx``. Paths are those of the source.
    """
    c = context.select("doc_id", "pre", "size", "level").dropDuplicates(["doc_id", "pre"])
    below = inside(nodes, c)
    root, moved_by = F.col("pre") == F.col("in_pre"), F.col("in_pre") - 1
    own = F.xxhash64("doc_id", "in_pre")
    moved = below.select(
        own.alias("doc_id"),
        (F.col("pre") - moved_by).alias("pre"),
        "size",
        (F.col("level") - F.col("in_level") + 1).alias("level"),
        F.when(root, 0).otherwise(F.col("parent") - moved_by).alias("parent"),
        *["kind", "ns_uri", "prefix", "local", "name", "value"],
        F.when(root, 1).otherwise(F.col("sib")).alias("sib"),
        F.when(root & (F.col("kind") == ELEMENT), 1).otherwise(F.col("elem")).alias("elem"),
        (F.col("in_size") + 1).alias("last"),
        F.when(~root, F.col("up")).alias("up"),
        *["path_id", "path_up"],
        F.col("doc_id").alias("source"),
        F.col("in_pre").alias("ctx"),
    )
    text, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    fresh = c.select(F.xxhash64("doc_id", "pre").alias("doc_id"), F.lit(0).alias("pre"), (F.col("size") + 1).alias("size"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent"), F.lit(DOCUMENT).alias("kind"), *(text.alias(n) for n in ("ns_uri", "prefix", "local", "name", "value")), F.lit(1).alias("sib"), F.lit(None).cast("int").alias("elem"), (F.col("size") + 1).alias("last"), text.alias("up"), zero.alias("path_id"), zero.alias("path_up"), F.col("doc_id").alias("source"), F.col("pre").alias("ctx"))
    return moved.unionByName(fresh)


def matched(nodes: DataFrame, rules: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """Template choice: each node with the name of the rule that applies, of the highest priority, and of equals the last.

    ``rules``: (name, the nodes its pattern selects, priority). Nodes without a rule keep the built-in one (null).
    """
    found = None
    for i, (name, selected, priority) in enumerate(rules):
        one = selected.select("doc_id", "pre", F.lit(name).alias("rule"), F.lit(priority).alias("_p"), F.lit(i).alias("_i"))
        found = one if found is None else found.union(one)
    best = found.groupBy("doc_id", "pre").agg(F.max_by("rule", F.struct("_p", "_i")).alias("rule"))
    return nodes.join(best, ["doc_id", "pre"], "left")


def records(context: DataFrame, nodes: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``xsl:for-each`` with ``value-of``: for each context node, the string of the first child or attribute of a name.

    ``fields``: column: (axis, local name). Missing ones are ''.
    """
    field = F.lit(None).cast("string")
    for column, (axis, local) in fields.items():
        field = F.when((F.col("local") == local) & (F.col("kind") == (ATTRIBUTE if axis == "attribute" else ELEMENT)), column).otherwise(field)
    tagged = nodes.withColumn("_f", field).where("_f is not null").select("doc_id", "parent", "pre", "value", "size", "kind", "sib", "last", "_f")
    own = context.select("doc_id", "pre").distinct()
    hits = tagged.join(own.withColumnRenamed("pre", "parent"), ["doc_id", "parent"])
    first = hits.groupBy("doc_id", "parent", "_f").agg(F.min_by(F.struct("pre", "value", "size", "kind", "sib", "last"), "pre").alias("_n")).select("doc_id", "parent", "_f", "_n.*")
    # Attributes say their value themselves; only elements gather texts.
    if any(axis != "attribute" for axis, _ in fields.values()):
        first = unbroadcast(first).join(string_values(first, nodes), ["doc_id", "pre"])
    else:
        first = first.withColumn("string", F.coalesce("value", F.lit("")))
    wide = first.groupBy("doc_id", F.col("parent").alias("pre")).agg(*(F.max(F.when(F.col("_f") == c, F.col("string"))).alias(c) for c in fields))
    return unbroadcast(own.join(wide, ["doc_id", "pre"], "left")).select("doc_id", "pre", *(F.coalesce(c, F.lit("")).alias(c) for c in fields))


def element(name: str, content: Column, **attributes: Column) -> Column:
    """Builds markup in a column: a start tag with attributes, escaped content, an end tag. Null attributes are left out."""
    own = [F.coalesce(F.concat(F.lit(f' {k}="'), escape(v.cast("string"), True), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *own, F.lit(">"), escape(F.coalesce(content.cast("string"), F.lit(""))), F.lit(f"</{name}>"))


def write_documents(rows: DataFrame, path: str, markup: str = "markup", by: str | None = None) -> None:
    """One line of text for each document, in folders by ``by`` if given (several result documents)."""
    (rows.select(markup, by).write.partitionBy(by) if by else rows.select(markup).write).text(path)


def included(nodes: DataFrame, uris: DataFrame) -> DataFrame:
    """XInclude, one level: ``xi:include`` elements with the documents they name.

    ``uris``: ``doc_id`` and ``uri``. Returns ``doc_id``, ``pre`` (of the include), ``target`` (doc_id, null if there is none)
    and ``fallback`` (whether the element has one); ``copies`` of the targets are what takes their place.
    """
    own = nodes.where((F.col("local") == "include") & (F.col("ns_uri") == "http://www.w3.org/2001/XInclude"))
    href = step(own, nodes, "attribute", F.col("local") == "href").select("doc_id", F.col("ctx").alias("pre"), F.col("value").alias("uri"))
    back = step(own, nodes, "child", F.col("local") == "fallback").select("doc_id", F.col("ctx").alias("pre"), F.lit(True).alias("fallback")).distinct()
    hit = href.join(uris.select(F.col("doc_id").alias("target"), "uri"), "uri", "left")
    return hit.join(back, ["doc_id", "pre"], "left").select("doc_id", "pre", "target", F.coalesce("fallback", F.lit(False)).alias("fallback"))


def child_sequence(nodes: DataFrame, numbers: list[int]) -> DataFrame:
    """XPointer's ``element(/1/2/..)``: in each document, the n-th child element of the n-th child element .."""
    at = nodes.where(F.col("kind") == DOCUMENT)
    for level, n in enumerate(numbers, 1):
        at = step(at, nodes, "child", (F.col("kind") == ELEMENT) & (F.col("elem") == n) & (F.col("level") == level)).drop("ctx")
    return at
