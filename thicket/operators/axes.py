"""Location steps over node rows (see ``sources.shred``).

A step joins a context with the nodes of its documents. Its rows carry ``ctx``, the context node's ``pre``, which
positions refer to; ``nodeset`` forgets it and makes nodes unique. A name test from the root of all documents is a plain
filter (``everywhere``), and so is a test of the name around a node (``under``). Child, parent and sibling steps are joins on the document and the
parent's ``pre``. Steps into depth, and to what follows or precedes, look for numbers in intervals: an interval is covered by at most 17
segments of a width (a power of 16) that fits its length, a number lies in one segment of each width, so they meet on equal keys and an
exact comparison decides. No step compares all nodes of a document with each other, and storage is linear in the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.sources.shred import ATTRIBUTE, COMMENT, DOCUMENT, ELEMENT, INSTRUCTION, TEXT
from thicket.sources.store import unbroadcast

REVERSE = ("parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling")


def _n(name: str) -> Column:
    return F.col(f"n.{name}")


def _c(name: str) -> Column:
    return F.col(f"c.{name}")


def _width(n: Column) -> Column:
    """The largest k with 16^k <= n (0 for n < 16)."""
    out = F.lit(0)
    for k in range(1, 8):
        out = F.when(n >= 1 << 4 * k, k).otherwise(out)
    return out


def _point(at: Column, last: Column) -> Column:
    """Keys of the segments that a number lies in, of all widths that intervals in a document of ``last`` + 1 nodes can have."""
    keys = [F.lit(k << 32) + F.shiftright(at, 4 * k).cast("long") for k in range(8)]
    return F.slice(F.array(*keys), 1, _width(last + 1) + 1)


def _cover(low: Column, high: Column) -> Column:
    """Keys of the segments that cover an interval (both ends count)."""
    k = _width(high - low + 1)
    cut = lambda x: F.floor(x / F.element_at(F.array(*(F.lit(float(1 << 4 * i)) for i in range(8))), k + 1))
    keys = F.transform(F.sequence(cut(low), cut(high)), lambda s: F.shiftleft(k.cast("long"), 32) + s)
    return F.when(high >= low, keys).otherwise(F.array().cast("array<bigint>"))


def inside(points: DataFrame, intervals: DataFrame, itself: bool = True) -> DataFrame:
    """Rows of ``points`` for each row of ``intervals`` (nodes of the same documents, with further columns) that they stand below, or (``itself``) are.

    The intervals' columns but for ``doc_id`` come with the prefix ``in_``.
    """
    low = F.col("pre") if itself else F.col("pre") + 1
    names = [c for c in intervals.columns if c != "doc_id"]
    i = intervals.select(F.col("doc_id").alias("_d"), *(F.col(c).alias(f"in_{c}") for c in names), F.explode(_cover(low, F.col("pre") + F.col("size"))).alias("_s"))
    p = points.withColumn("_k", F.explode(_point(F.col("pre"), F.col("last"))))
    within = (F.col("pre") >= F.col("in_pre") + (0 if itself else 1)) & (F.col("pre") <= F.col("in_pre") + F.col("in_size"))
    return p.join(i, (F.col("doc_id") == F.col("_d")) & (F.col("_k") == F.col("_s")) & within).drop("_d", "_k", "_s")


def _keys(axis: str) -> tuple[Column, Column, Column]:
    """Of an axis: the keys of the context, the keys of the nodes (arrays are exploded), and what else must hold."""
    sibling = (_n("parent") == _c("parent")) & (_c("kind") != ATTRIBUTE)
    own = _n("kind") != ATTRIBUTE
    pre, end, last = F.col("pre"), F.col("pre") + F.col("size"), F.col("last")
    below = (_n("pre") > _c("pre")) & (_n("pre") <= _c("pre") + _c("size"))
    around = (_c("pre") > _n("pre")) & (_c("pre") <= _n("pre") + _n("size"))
    same = _n("pre") == _c("pre")
    return {
        "self": (pre, pre, F.lit(True)),
        "child": (pre, F.col("parent"), own),
        "attribute": (pre, F.col("parent"), ~own),
        "parent": (F.col("parent"), pre, F.lit(True)),
        "descendant": (_cover(pre + 1, end), _point(pre, last), below & own),
        "descendant-or-self": (_cover(pre, end), _point(pre, last), (below & own) | same),
        "ancestor": (_point(pre, last), _cover(pre + 1, end), around),
        "ancestor-or-self": (_point(pre, last), _cover(pre, end), around | same),
        "following-sibling": (F.col("parent"), F.col("parent"), sibling & (_n("sib") > _c("sib")) & own),
        "preceding-sibling": (F.col("parent"), F.col("parent"), sibling & (_n("sib") < _c("sib")) & own),
        "following": (_cover(end + 1, last), _point(pre, last), (_n("pre") > _c("pre") + _c("size")) & own),
        "preceding": (_cover(F.lit(0), pre - 1), _point(end, last), (_n("pre") + _n("size") < _c("pre")) & own),
    }[axis]


DEEP = ("descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following", "preceding")


def test(local: str | None = None, kind: int | None = ELEMENT, ns_uri: str | None = None) -> Column:
    """A node test: ``local`` None is any name, ``kind`` None any node; names match by namespace URI, not by prefix."""
    out = F.lit(True) if kind is None else F.col("kind") == kind
    if local is not None:
        out &= F.col("local") == local
    return out if ns_uri is None else out & (F.col("ns_uri") == ns_uri)


def everywhere(nodes: DataFrame, where: Column) -> DataFrame:
    """``//test`` from the documents' roots."""
    return nodes.where((F.col("kind") != DOCUMENT) & where)


def step(context: DataFrame, nodes: DataFrame, axis: str, where: Column | None = None) -> DataFrame:
    """The nodes on an axis of each context node, with ``ctx``."""
    found = nodes if where is None else nodes.where(where)
    of_context, of_nodes, condition = _keys(axis)
    c = context.select("doc_id", "pre", "size", "parent", "kind", "sib", "last").dropDuplicates(["doc_id", "pre"])
    c = c.withColumn("_k", F.explode(of_context) if axis in DEEP else of_context)
    found = found.withColumn("_k", F.explode(of_nodes) if axis in DEEP else of_nodes)
    return found.alias("n").join(c.alias("c"), (_n("doc_id") == _c("doc_id")) & (_n("_k") == _c("_k")) & condition).select("n.*", _c("pre").alias("ctx")).drop("_k")


def under(name: str) -> Column:
    """Nodes whose element around them has a name: ``name/..``."""
    return F.col("up") == name


def nodeset(stepped: DataFrame) -> DataFrame:
    return stepped.drop("ctx").dropDuplicates(["doc_id", "pre"])


def position(axis: str = "child") -> Column:
    """``position()`` in a step: from 1, backwards on reverse axes."""
    return F.row_number().over(Window.partitionBy("doc_id", "ctx").orderBy(F.desc("pre") if axis in REVERSE else F.asc("pre")))


def last() -> Column:
    return F.count("*").over(Window.partitionBy("doc_id", "ctx"))


def having(context: DataFrame, stepped: DataFrame) -> DataFrame:
    """Context nodes for which a step finds something (a predicate that is a path)."""
    return context.join(stepped.select("doc_id", F.col("ctx").alias("pre")).distinct(), ["doc_id", "pre"], "left_semi")


def lacking(context: DataFrame, stepped: DataFrame) -> DataFrame:
    """Context nodes for which a step finds nothing: ``not(path)``."""
    return context.join(stepped.select("doc_id", F.col("ctx").alias("pre")).distinct(), ["doc_id", "pre"], "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(["doc_id", "pre"])


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id", "pre"), ["doc_id", "pre"], "left_anti")


def has_same_node(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents in which two node sets meet."""
    return intersection(a, b).select("doc_id").distinct()


def leading(a: DataFrame, b: DataFrame, after: bool = False) -> DataFrame:
    """Nodes of ``a`` before the first node of ``b`` (or ``after`` it); all of ``a`` in documents without ``b``."""
    first = b.groupBy("doc_id").agg(F.min("pre").alias("_first"))
    side = F.col("pre") > F.col("_first") if after else F.col("pre") < F.col("_first")
    return a.join(first, "doc_id", "left").where(F.col("_first").isNull() | side).drop("_first")


def string_values(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``pre`` and ``string``: the texts below an element in document order, the value of other nodes."""
    texts = step(context.where(F.col("kind").isin(ELEMENT, DOCUMENT)), nodes, "descendant", F.col("kind") == TEXT)
    gathered = texts.groupBy("doc_id", "ctx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda t: t["value"]), "").alias("_s"))
    own = context.select("doc_id", "pre", "value").dropDuplicates(["doc_id", "pre"])
    return own.join(gathered.withColumnRenamed("ctx", "pre"), ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("_s", "value", F.lit("")).alias("string"))


def distinct_values(strings: DataFrame) -> DataFrame:
    """The first node of each string value in a document (``set:distinct``)."""
    order = Window.partitionBy("doc_id", "string").orderBy("pre")
    return strings.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _with_size(given: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows about elements (``doc_id``, ``pre``) with their ``size``."""
    return given.join(nodes.where(F.col("kind") == ELEMENT).select("doc_id", "pre", "size"), ["doc_id", "pre"])


def languages(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``pre`` and ``lang``: the nearest ``lang`` or ``xml:lang`` around each context node, itself included (null: none)."""
    given = nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("local") == "lang")).select("doc_id", F.col("parent").alias("pre"), F.lower("value").alias("lang"))
    around = inside(context.select("doc_id", "pre", "last"), _with_size(given, nodes))
    found = around.groupBy("doc_id", "pre").agg(F.max_by("in_lang", "in_pre").alias("lang"))
    return context.select("doc_id", "pre").distinct().join(found, ["doc_id", "pre"], "left")


def lang(of: Column, wanted: str) -> Column:
    """``lang('en')`` on a language: the same, or with a suffix behind a hyphen."""
    return F.coalesce((of == wanted.lower()) | F.startswith(of, F.lit(wanted.lower() + "-")), F.lit(False))


def declarations(nodes: DataFrame) -> DataFrame:
    """Namespace declarations: ``doc_id``, ``pre`` and ``size`` of the element, ``attribute`` (its ``pre``), ``last``, ``prefix`` ('' for the default) and ``uri``."""
    own = nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("ns_uri") == "http://www.w3.org/2000/xmlns/"))
    own = own.select("doc_id", F.col("parent").alias("pre"), F.col("pre").alias("attribute"), "last", F.when(F.col("prefix").isNull(), "").otherwise(F.col("local")).alias("prefix"), F.col("value").alias("uri"))
    return _with_size(own, nodes)


def namespaces(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """The namespace axis: ``doc_id``, ``ctx``, ``prefix`` ('' for the default) and ``uri`` of the namespaces in scope of elements, with ``xml``."""
    elements = context.where(F.col("kind") == ELEMENT)
    around = inside(elements.select("doc_id", "pre", "last"), declarations(nodes))
    nearest = around.groupBy("doc_id", F.col("pre").alias("ctx"), F.col("in_prefix").alias("prefix")).agg(F.max_by("in_uri", "in_pre").alias("uri"))
    always = elements.select("doc_id", F.col("pre").alias("ctx"), F.lit("xml").alias("prefix"), F.lit("http://www.w3.org/XML/1998/namespace").alias("uri")).distinct()
    return nearest.where("uri <> ''").union(always)  # xmlns="" takes the default away


def by_id(nodes: DataFrame, wanted: DataFrame, attribute: str = "id") -> DataFrame:
    """``id()``: elements whose ID is one of the tokens in ``wanted`` (``doc_id``, ``ids``: separated by white space); the first of equal IDs."""
    ids = wanted.select("doc_id", F.explode(F.split(F.trim(F.regexp_replace("ids", r"\s+", " ")), " ")).alias("value")).distinct()
    own = nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("local") == attribute)).join(ids, ["doc_id", "value"], "left_semi")
    first = own.groupBy("doc_id", "value").agg(F.min("parent").alias("pre")).select("doc_id", "pre").distinct()
    return nodes.join(first, ["doc_id", "pre"], "left_semi")


def without_blank_text(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``strip-space`` (and parsing without blanks): texts of white space alone go, but for those in elements of ``keep`` and where
    ``xml:space`` preserves them. Other nodes keep their numbers."""
    space = nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("name") == "xml:space")).select("doc_id", F.col("parent").alias("pre"), (F.col("value") == "preserve").alias("preserve"))
    blank = nodes.where((F.col("kind") == TEXT) & ~F.col("value").rlike(r"[^ \t\r\n]"))
    if keep:
        blank = blank.where(~F.col("up").isin(*keep))
    held = inside(blank.select("doc_id", "pre", "last"), _with_size(space, nodes)).groupBy("doc_id", "pre").agg(F.max_by("in_preserve", "in_pre").alias("preserve"))
    gone = blank.select("doc_id", "pre").join(held.where("preserve"), ["doc_id", "pre"], "left_anti")
    return unbroadcast(nodes.join(gone, ["doc_id", "pre"], "left_anti"))


def reader_events(nodes: DataFrame) -> DataFrame:
    """A pull reader's rows: ``doc_id``, ``at``, ``event`` (start, empty, end, text, comment, instruction), ``name``, ``value``, ``depth``.

    ``at`` is an array that sorts the events of a document. An element without children is one "empty" event.
    """
    kinds = F.create_map(*(F.lit(x) for kv in {ELEMENT: "start", TEXT: "text", INSTRUCTION: "instruction", COMMENT: "comment"}.items() for x in kv))
    inner = nodes.where(~F.col("kind").isin(ATTRIBUTE, DOCUMENT))
    holders = inner.select("doc_id", F.col("parent").alias("pre")).distinct().withColumn("_h", F.lit(True))
    inner = inner.join(holders, ["doc_id", "pre"], "left")
    element, empty = F.col("kind") == ELEMENT, F.col("_h").isNull()
    started = F.struct(F.array("pre", F.lit(0)).alias("at"), F.when(element & empty, "empty").otherwise(kinds[F.col("kind")]).alias("event"))
    ended = F.struct(F.array(F.col("pre") + F.col("size"), F.lit(1 << 30) - F.col("level")).alias("at"), F.lit("end").alias("event"))
    rows = inner.withColumn("_e", F.explode(F.when(element & ~empty, F.array(started, ended)).otherwise(F.array(started))))
    return rows.select("doc_id", "_e.at", "_e.event", "name", F.when(element, None).otherwise(F.col("value")).alias("value"), (F.col("level") - 1).alias("depth"))
