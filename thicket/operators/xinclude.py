"""Documents with what they include in its place, by substitution until nothing is left to include.

Each document is cut once into pieces of markup and references between them. A round replaces every reference by the pieces of the document it
names, all documents at a time; the place of a piece is the list of its numbers in the documents around it, so the order needs no
renumbering. A reference to a document that is being included already is a loop: it ends there and is reported. After as many
rounds as inclusions are nested, the pieces are joined, and ``shred_xml`` numbers the nodes of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.exslt import resolve_uri
from thicket.functions.xpath import escape
from thicket.operators.axes import inside, step
from thicket.operators.output import markup_pieces
from thicket.sources.shred import ATTRIBUTE, DOCUMENT, ELEMENT, stored_xml
from thicket.sources.store import stored, unbroadcast

XINCLUDE = "http://www.w3.org/2001/XInclude"
FAULTS = "doc_id long, href string, message string"


def _includes(nodes: DataFrame, uris: DataFrame) -> DataFrame:
    """The include elements with ``href``, ``parse`` and ``target`` (null: there is none; the smallest of several documents of one URI)."""
    own = nodes.where((F.col("kind") == ELEMENT) & (F.col("local") == "include") & (F.col("ns_uri") == XINCLUDE))
    said = step(own, nodes, "attribute", F.col("local").isin("href", "parse") & F.col("prefix").isNull()).groupBy("doc_id", F.col("ctx").alias("pre")).agg(*(F.max(F.when(F.col("local") == n, F.col("value"))).alias(n) for n in ("href", "parse")))
    told = own.select("doc_id", "pre", "size", "last").join(said, ["doc_id", "pre"], "left").join(uris, "doc_id", "left")
    at = told.withColumn("_uri", F.coalesce(resolve_uri(F.col("href"), F.col("uri")), F.col("href"))).drop("uri")
    return at.join(uris.groupBy(F.col("uri").alias("_uri")).agg(F.min("doc_id").alias("target")), "_uri", "left").select("doc_id", "pre", "size", "last", "href", F.coalesce("parse", F.lit("xml")).alias("parse"), "target")


def _pieces(nodes: DataFrame, includes: DataFrame) -> DataFrame:
    """``doc_id``, ``no``, ``t``, ``root`` (whether it is the root's start tag), and of references ``href``, ``target`` and ``parse``."""
    missing = includes.where("target is null").select("doc_id", "pre")
    below = nodes.join(missing.withColumnRenamed("pre", "parent"), ["doc_id", "parent"])
    is_fallback = (F.col("kind") == ELEMENT) & (F.col("local") == "fallback") & (F.col("ns_uri") == XINCLUDE)
    fallbacks = below.where(is_fallback).select("doc_id", "pre")
    said = nodes.where(F.col("kind") == ATTRIBUTE).join(fallbacks.withColumnRenamed("pre", "parent"), ["doc_id", "parent"], "left_semi")
    # Whole subtrees that go: what is included stands in their place, or only the content of a fallback does.
    gone = unbroadcast(includes.where("target is not null").select("doc_id", "pre", "size").union(below.where(~is_fallback).select("doc_id", "pre", "size")).union(said.select("doc_id", "pre", "size")))
    out = inside(nodes.select("doc_id", "pre", "last"), gone).select("doc_id", "pre").union(missing).union(fallbacks)
    kept = unbroadcast(nodes.where(F.col("kind") != DOCUMENT).join(out.distinct(), ["doc_id", "pre"], "left_anti"))
    defaults = nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("name") == "xmlns") & (F.col("level") == 2)).select("doc_id", F.lit(True).alias("_d")).distinct()
    root = nodes.where((F.col("kind") == ELEMENT) & (F.col("level") == 1)).join(defaults, "doc_id", "left_anti").select("doc_id", "pre", F.lit(True).alias("_r"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    own = markup_pieces(kept, pairs=True).join(root, ["doc_id", "pre"], "left").select("doc_id", "p", (F.col("_r").isNotNull() & (F.col("p.side") == 0)).alias("root"), text.alias("href"), number.alias("target"), text.alias("parse"))
    inner = inside(includes.select("doc_id", "pre", "last"), gone, itself=False).select("doc_id", "pre").distinct()
    place = F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("depth"), F.lit("").alias("t"))
    references = includes.where("target is not null").join(inner, ["doc_id", "pre"], "left_anti").select("doc_id", place.alias("p"), F.lit(False).alias("root"), "href", "target", "parse")
    order = Window.partitionBy("doc_id").orderBy("p")
    alone = F.col("root") | F.col("target").isNotNull()
    runs = own.union(references).withColumn("no", F.sum((alone | F.coalesce(F.lag(alone).over(order), F.lit(True))).cast("int")).over(order))
    return runs.groupBy("doc_id", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("t"), F.max("root").alias("root"), F.max("href").alias("href"), F.max("target").alias("target"), F.max("parse").alias("parse"))


def spliced(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id`` and ``markup`` of all documents with their includes replaced, and the faults (``doc_id``, ``href``, ``message``).

    ``docs``: ``doc_id`` (unique), ``uri``, ``xml``. An ``href`` is resolved against the document's URI; ``parse="text"`` includes the text
    itself. Where nothing has the URI, the content of the ``fallback`` stands there, which may include too, or nothing with a fault. Loops
    and targets that are not well-formed are faults of the documents they stand in the result of, and leave nothing. A root that declares no default namespace
    is included with ``xmlns=""``. Documents that are not well-formed have no row, null texts and URIs are none, and the
    DOCTYPE is left out. The result can be exponentially longer than the input if documents include others twice, at each level.
    """
    texts = unbroadcast(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "uri", F.col("xml").alias("text")))
    nodes = stored_xml(texts, "doc_id", "text")
    includes = unbroadcast(stored(_includes(nodes, texts.where("uri is not null").select("doc_id", "uri")), "xinclude"))
    pieces = unbroadcast(stored(_pieces(nodes, includes), "xinclude"))
    number = F.lit(None).cast("long")
    now = pieces.select("doc_id", F.array("no").alias("at"), "t", "href", "target", "parse", F.array("doc_id").alias("chain"))
    lacking = includes.where("target is null").join(step(includes.select("doc_id", "pre", "size", "last", F.lit(None).cast("int").alias("parent"), F.lit(ELEMENT).alias("kind"), F.lit(1).alias("sib")), nodes, "child", (F.col("local") == "fallback") & (F.col("ns_uri") == XINCLUDE)).select("doc_id", F.col("ctx").alias("pre")), ["doc_id", "pre"], "left_anti")
    done, faults = [], [lacking.select("doc_id", "href", F.lit("nothing has this URI").alias("message"))]
    # What a reference becomes; the root's start tag takes the default namespace of its surroundings away.
    taken = F.when(F.col("root"), F.regexp_replace("t", r"^(<[^\s>]+)", '$1 xmlns=""')).otherwise(F.col("t"))
    parts = pieces.select(F.col("doc_id").alias("target"), "no", taken.alias("t"), "href", F.col("target").alias("next"), "parse")
    while True:
        done.append(now.where("target is null").select("doc_id", "at", "t"))
        opened = now.where("target is not null")
        plain = opened.where("parse = 'text'").select("doc_id", "at", "target").join(texts.select(F.col("doc_id").alias("target"), "text"), "target")
        done.append(plain.select("doc_id", "at", escape(F.coalesce("text", F.lit(""))).alias("t")))
        looped = F.array_contains("chain", F.col("target"))
        marked = opened.where("parse <> 'text'")
        faults.append(marked.where(looped).select("doc_id", "href", F.lit("it includes itself").alias("message")))
        following = marked.where(~looped).select("doc_id", "at", F.col("href").alias("by"), "target", "chain").join(parts, "target", "left")
        following = stored(following.select("doc_id", F.when(F.col("no").isNotNull(), F.concat("at", F.array("no"))).alias("at"), "t", F.coalesce("href", F.when(F.col("no").isNull(), F.col("by"))).alias("href"), F.col("next").alias("target"), "parse", F.concat("chain", F.array("target")).alias("chain")), "xinclude")
        faults.append(following.where("at is null").select("doc_id", "href", F.lit("not well-formed").alias("message")))
        now = following.where("at is not null")
        if not now.limit(1).count():
            break
    pieces_of_all, all_faults = done[0], faults[0]
    for frame in done[1:]:
        pieces_of_all = pieces_of_all.union(frame)
    for frame in faults[1:]:
        all_faults = all_faults.union(frame)
    markup = pieces_of_all.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda p: p["t"]), "").alias("markup"))
    return markup, all_faults
