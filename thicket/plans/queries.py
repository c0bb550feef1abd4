"""Queries of the tree operators on the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import exslt as E
from thicket.functions import values as T
from thicket.functions import xpath as X
from thicket.functions.sql import register
from thicket.operators import axes as A
from thicket.operators import keys as K
from thicket.operators import output as O
from thicket.operators import paths as P
from thicket.operators.xinclude import spliced
from thicket.plans import content as C
from thicket.plans import validation as V
from thicket.plans.summary import attribute_matches, by_attribute, by_class, combined, nth, structural_summary
from thicket.sources.files import resolved
from thicket.sources.records import read_records
from thicket.sources.shred import ATTRIBUTE, ELEMENT, buckets_for, shred_html, shred_xml, stored_nodes, stored_xml, xml_errors
from thicket.sources.store import shared_folder, spread, stored, unbroadcast
from thicket.streaming.push import plain_texts, push_events, push_matches, whole_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shredded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred_html(spread(table(spark, sf_dir, "pages")), "page_id", "html")


_STORED: dict[tuple[str, ...], DataFrame] = {}


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the pages, stored once for a session and state of the files (so a query parses nothing a second time)."""
    pages = table(spark, sf_dir, "pages")
    files = pages.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.max("file_modification_time").cast("string"), F.count("*").cast("string"), F.sum("file_size")).first()
    key = (spark.sparkContext.applicationId, sf_dir, *map(str, state))
    if key not in _STORED:
        # Markup takes some five times the bytes of its compressed file as nodes.
        _STORED[key] = stored_nodes(shredded_pages(spark, sf_dir), buckets_for(spark, 5 * (state[2] or 0)))
    return _STORED[key]


def named(nodes: DataFrame, name: str) -> DataFrame:
    return A.everywhere(nodes, A.test(name))


def _hrefs(nodes: DataFrame) -> DataFrame:
    """//a/@href: a filter, as nodes carry the name of the element around them"""
    return A.everywhere(nodes, A.test("href", ATTRIBUTE) & A.under("a"))


# --- location paths over pages -------------------------------------------------------------------------------------

_DECODED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_TITLE = _DECODED.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")
_PLAIN = "regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs')"


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<a href=\"')) AS n_links FROM pages WHERE html LIKE '%<a href=\"%'")
def xp_links_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count(//a/@href)"""
    return _hrefs(page_nodes(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_links"))


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>')) AS n_items FROM pages WHERE html LIKE '%<li>%'")
def xp_li_in_ul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count(//ul/li)"""
    return A.everywhere(page_nodes(spark, sf_dir), A.test("li") & A.under("ul")).groupBy("doc_id").agg(F.count("*").alias("n_items"))


@query(f"SELECT page_id AS doc_id, {_TITLE} AS title FROM pages WHERE html LIKE '%<title>%'")
def xp_title_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """string(//title)"""
    n = page_nodes(spark, sf_dir)
    return A.string_values(named(n, "title"), n).select("doc_id", F.col("string").alias("title"))


@query("SELECT page_id AS doc_id, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS href FROM pages WHERE html LIKE '%<a href=\"%'")
def xp_positional_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(//a)[1]/@href"""
    n = page_nodes(spark, sf_dir)
    first = K.first_per_group(named(n, "a"), ["doc_id"], ["pre"], 1)
    return A.step(first, n, "attribute", A.test("href", ATTRIBUTE)).select("doc_id", F.col("value").alias("href"))


@query("SELECT page_id AS doc_id, list_last(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages WHERE html LIKE '%<a href=\"%'")
def xp_last_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(//a)[last()]/@href"""
    n = page_nodes(spark, sf_dir)
    last = K.first_per_group(named(n, "a"), ["doc_id"], [F.desc("pre")], 1)
    return A.step(last, n, "attribute", A.test("href", ATTRIBUTE)).select("doc_id", F.col("value").alias("href"))


@query("SELECT page_id AS doc_id, k AS position, l[k] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages), range(1, 4) r(k) WHERE k <= len(l)")
def xp_position_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(//a/@href)[position() <= 3]"""
    n = page_nodes(spark, sf_dir)
    hrefs = _hrefs(n)
    placed = hrefs.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).cast("long"))
    return placed.where("position <= 3").select("doc_id", "position", F.col("value").alias("href"))


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<div class=\"ad\">')) AS n FROM pages WHERE html LIKE '%<div class=\"ad\">%'")
def xp_attr_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count(//div[@class='ad'])"""
    n = page_nodes(spark, sf_dir)
    divs = named(n, "div")
    return A.having(divs, A.step(divs, n, "attribute", A.test("class", ATTRIBUTE) & (F.col("value") == "ad"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<div class=\"ad\">')) AS n FROM pages WHERE html LIKE '%<div class=\"ad\">%'")
def css_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """div.ad"""
    n = page_nodes(spark, sf_dir)
    return by_class(named(n, "div"), n, "ad").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, count(*) AS n FROM (SELECT page_id, unnest(range(1, len(regexp_extract_all(html, '<li>')) + 1)) AS k FROM pages) WHERE k % 2 = 1 GROUP BY page_id")
def css_nth_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """li:nth-child(odd)"""
    n = page_nodes(spark, sf_dir)
    return nth(named(n, "li"), 2, 1).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, len(l) * (len(l) - 1) // 2 AS n FROM (SELECT page_id, regexp_extract_all(html, '<li>') AS l FROM pages) WHERE len(l) > 1")
def xp_following_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (li, following-sibling::li) pairs of each page"""
    n = page_nodes(spark, sf_dir)
    return A.step(named(n, "li"), n, "following-sibling", A.test("li")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, name, len(regexp_extract_all(html, '<a href=\"')) AS n FROM pages, (VALUES ('html'), ('body'), ('nav'), ('ul'), ('li')) v(name) WHERE html LIKE '%<a href=\"%'")
def xp_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the ancestors of links, with the number of links below them"""
    n = page_nodes(spark, sf_dir)
    return A.step(named(n, "a"), n, "ancestor", A.test()).groupBy("doc_id", F.col("local").alias("name")).agg(F.countDistinct("ctx").alias("n"))


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<p>')) - len(regexp_extract_all(html, '<p><b>')) AS n FROM pages WHERE len(regexp_extract_all(html, '<p>')) > len(regexp_extract_all(html, '<p><b>'))")
def xp_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count(//p[not(b)])"""
    n = page_nodes(spark, sf_dir)
    p = named(n, "p")
    return A.lacking(p, A.step(p, n, "child", A.test("b"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, len(l) AS n_items, len(l) - 1 AS n_before_last FROM (SELECT page_id, regexp_extract_all(html, '<li>') AS l FROM pages) WHERE len(l) > 1")
def set_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set:leading(//li, //li[last()])"""
    n = page_nodes(spark, sf_dir)
    items = named(n, "li")
    last = K.first_per_group(items, ["doc_id"], [F.desc("pre")], 1)
    before = A.leading(items, last).groupBy("doc_id").agg(F.count("*").alias("n_before_last"))
    return items.groupBy("doc_id").agg(F.count("*").alias("n_items")).join(before, "doc_id")


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>')) AS n_following, CASE WHEN html LIKE '%<h1>%' THEN 1 ELSE 0 END AS n_parents FROM pages WHERE html LIKE '%<li>%' AND html LIKE '%<nav>%'")
def xp_following_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count(//head/following::li) and count(//h1/parent::article)"""
    n = page_nodes(spark, sf_dir)
    following = A.step(named(n, "head"), n, "following", A.test("li")).groupBy("doc_id").agg(F.count("*").alias("n_following"))
    parents = A.nodeset(A.step(named(n, "h1"), n, "parent", A.test("article"))).groupBy("doc_id").agg(F.count("*").alias("n_parents"))
    return following.join(parents, "doc_id")


@query(f"SELECT page_id AS doc_id, len(regexp_extract_all(p, '<[a-z][^>]*>')) AS n_elements, len(regexp_extract_all(p, '<p>')) AS n_p, len(regexp_extract_all(p, '<a ')) AS n_a, len(regexp_extract_all(p, '<li>')) AS n_li FROM (SELECT page_id, {_PLAIN} AS p FROM pages)")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count(//*) and counts by name: the structural summary"""
    return structural_summary(page_nodes(spark, sf_dir), ["p", "a", "li"]).select("doc_id", "n_elements", "n_p", "n_a", "n_li")


@query(f"SELECT page_id AS doc_id, {_TITLE} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def xslt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """for-each html: value-of head/title and @lang"""
    n = page_nodes(spark, sf_dir)
    heads = A.everywhere(n, A.test("head") & A.under("html"))
    title = O.records(heads, n, {"title": ("child", "title")}).select("doc_id", "title")
    return title.join(O.records(named(n, "html"), n, {"lang": ("attribute", "lang")}).select("doc_id", "lang"), "doc_id")


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>')) AS n, '<li><a href=\"' || regexp_extract(html, '<li><a href=\"([^\"]*)\"', 1) || '\">' || regexp_extract(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1) || '</a></li>' AS first FROM pages WHERE html LIKE '%<li>%'")
def xslt_copy_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """copy-of each li, serialized"""
    n = page_nodes(spark, sf_dir)
    items = named(n, "li")
    markup = O.serialized(O.copies(items, n).drop("source", "ctx"), html=True)
    markup = markup.join(items.select(F.xxhash64("doc_id", "pre").alias("doc_id"), F.col("doc_id").alias("source"), F.col("pre").alias("ctx")), "doc_id")
    return markup.groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n"), F.min_by("markup", "ctx").alias("first"))


@query("SELECT page_id AS doc_id, 'link' AS rule, len(regexp_extract_all(html, '<a href=\"')) AS n FROM pages WHERE html LIKE '%<a href=\"%' UNION ALL SELECT page_id, 'item', len(regexp_extract_all(html, '<li>')) FROM pages WHERE html LIKE '%<li>%'")
def xslt_template_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which template applies: a and li by name (0) before * (-0.5)"""
    n = page_nodes(spark, sf_dir)
    every = A.everywhere(n, A.test())
    chosen = O.matched(every, [("any", every, -0.5), ("link", named(n, "a"), 0.0), ("item", named(n, "li"), 0.0)])
    return chosen.where("rule <> 'any'").groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages WHERE html LIKE '%<li>%'")
def stream_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose path ends in nav/ul/li: matched against the distinct paths, and found by their ids"""
    n = page_nodes(spark, sf_dir)
    items = P.on_paths(named(n, "li"), P.matching(P.path_table(n), P.suffix("nav", "ul", "li")))
    return items.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, 'inner' AS pattern, len(regexp_extract_all(html, '<a href=\"')) AS n FROM pages WHERE html LIKE '%<a href=\"%' UNION ALL SELECT page_id, 'any', len(regexp_extract_all(html, '<li>')) FROM pages WHERE html LIKE '%<li>%' UNION ALL SELECT page_id, 'rooted', 1 FROM pages WHERE html LIKE '%<title>%'")
def path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/html//nav//a, //body/*/ul/* and /html/head/title"""
    n = page_nodes(spark, sf_dir)
    paths, elements = stored(P.path_table(n), "path-table"), A.everywhere(n, A.test())
    patterns = {
        "inner": [(P.CHILD, "html"), (P.DESCENDANT, "nav"), (P.DESCENDANT, "a")],
        "any": [(P.DESCENDANT, "body"), (P.CHILD, "*"), (P.CHILD, "ul"), (P.CHILD, "*")],
        "rooted": [(P.CHILD, "html"), (P.CHILD, "head"), (P.CHILD, "title")],
    }
    found = [P.on_paths(elements, P.matching(paths, p)).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("pattern"), "n") for name, p in patterns.items()]
    return functools.reduce(DataFrame.union, found)


@query("SELECT page_id AS doc_id, 'html' AS name FROM pages UNION ALL SELECT page_id, 'title' FROM pages")
def xpointer_child_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """element(/1) and element(/1/1/2)"""
    n = page_nodes(spark, sf_dir)
    return O.child_sequence(n, [1]).union(O.child_sequence(n, [1, 1, 2])).select("doc_id", F.col("local").alias("name"))


@query("SELECT page_id AS doc_id, len(l) AS n, len(list_distinct(l)) AS n_distinct FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages) WHERE len(l) > 0")
def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set:distinct(//a/@href)"""
    n = page_nodes(spark, sf_dir)
    hrefs = _hrefs(n).select("doc_id", "pre", F.col("value").alias("string"))
    return hrefs.groupBy("doc_id").agg(F.count("*").alias("n")).join(A.distinct_values(hrefs).groupBy("doc_id").agg(F.count("*").alias("n_distinct")), "doc_id")


@query("SELECT page_id AS doc_id, len(l) // 2 + len(l) % 2 + CAST(len(l) > 1 AS INT) AS n_union, CASE WHEN len(l) > 2 THEN 2 ELSE 1 END AS n_both, len(l) - (len(l) // 2 + len(l) % 2) AS n_even FROM (SELECT page_id, regexp_extract_all(html, '<li>') AS l FROM pages) WHERE len(l) > 0")
def set_union_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd list items and the first three: their union and their intersection; and the items that aren't odd"""
    n = page_nodes(spark, sf_dir)
    items = named(n, "li")
    odd, first = nth(items, 2, 1), nth(items, -1, 3)
    both = A.intersection(odd, first).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_both"))
    even = A.difference(items, odd).groupBy("doc_id").agg(F.count("*").alias("n_even"))
    counted = A.union(odd, first).groupBy("doc_id").agg(F.count("*").alias("n_union")).join(both, "doc_id").join(even, "doc_id", "left")
    return counted.select("doc_id", "n_union", "n_both", F.coalesce("n_even", F.lit(0)).alias("n_even"))


_ENDED = "CASE WHEN html LIKE '%</html>' THEN html WHEN html LIKE '%</body>' THEN html || '</html>' ELSE html || '</body></html>' END"
_IMPLIED = f"replace(replace({_ENDED}, '<br><p>', '<br></b></p><p>'), '<br></article>', '<br></b></p></article>')"


@query(f"SELECT page_id AS doc_id, replace(replace(replace({_IMPLIED}, '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&quot;', '\"') AS markup FROM pages")
def serialize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages back from their nodes: end tags that were left out stand there, character references are characters"""
    return O.serialized(page_nodes(spark, sf_dir), html=True)


@query("SELECT p_partkey AS doc_id, '<part xmlns=\"urn:p\" b=\"2\" id=\"' || p_partkey || '\"><name brand=\"' || p_brand || '\">' || p_name || '</name><size>' || p_size || '</size><note></note></part>' AS markup FROM part")
def c14n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form of a small document for each part"""
    return O.serialized(stored_xml(_part_documents(spark, sf_dir), "id", "xml"), canonical=True)


@query("SELECT doc_id, event, coalesce(name, '') AS name, count(*) AS n, min(coalesce(value, '')) AS least FROM (SELECT p_partkey AS doc_id, unnest(['start', 'start', 'text', 'end', 'start', 'text', 'end', 'start', 'end', 'end']) AS event, unnest(['part', 'name', NULL, 'name', 'size', NULL, 'size', 'note', 'note', 'part']) AS name, unnest(['xmlns=\"urn:p\" b=\"2\" id=\"' || p_partkey || '\"', 'brand=\"' || p_brand || '\"', p_name, NULL, NULL, CAST(p_size AS VARCHAR), NULL, NULL, NULL, NULL]) AS value FROM part) GROUP BY ALL")
def push_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse events of documents that arrive in chunks of 40 characters, out of order, as a stream"""
    events = whole_texts(_pushed(_part_documents(spark, sf_dir), 40, push_events))
    return events.groupBy("doc_id", "event", F.coalesce("name", F.lit("")).alias("name")).agg(F.count("*").alias("n"), F.min(F.coalesce("value", F.lit(""))).alias("least"))


#: Documents of which chunks arrive at a time.
_ARRIVING = 1_000_000


def _pushed(docs: DataFrame, size: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for a stream of the documents (``id``, ``xml``) in chunks of ``size`` characters, out of order.

    The documents come in turns of some ``_ARRIVING``, each document's chunks over its own turn and the next one: so what is open at a time
    doesn't grow with the table.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/push-{uuid.uuid4().hex}"
    whole = stored(docs.select(F.col("id").alias("doc_id"), "xml"), "push-documents")
    turns = -(-whole.count() // _ARRIVING) or 1
    if turns > 1:
        whole.withColumn("turn", F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), F.lit(turns))).repartition("turn", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy("turn").parquet(f"{folder}/documents")
        whole = spark.read.parquet(f"{folder}/documents")
    else:
        whole = whole.withColumn("turn", F.lit(0))
    last = F.ceil(F.length("xml") / size).cast("long") - 1
    files, now = spark.sparkContext.defaultParallelism, F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(2))
    for turn in range(turns + 1):
        present = whole.where(F.col("turn").isin(turn - 1, turn))
        chunks = present.select("doc_id", "xml", "turn", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).where(F.col("turn") + now == turn)
        chunks = chunks.select("doc_id", "chunk", F.substring("xml", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("content"), (F.col("chunk") == F.col("last")).alias("final"))
        chunks.repartition(files).write.mode("append").parquet(f"{folder}/chunks")
    stream = make(spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/chunks"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT p_partkey AS doc_id, '<w:list xmlns:w=\"urn:w\"><part xmlns=\"urn:p\" id=\"' || p_partkey || '\"><!--' || p_name || '--><u:size xmlns:u=\"urn:u\" xmlns:v=\"urn:v\" v:unit=\"' || p_brand || '\">' || p_size || '</u:size><w:note><u:b xmlns:u=\"urn:' || CASE WHEN p_size % 2 = 0 THEN 'u' ELSE 'w' END || '\"></u:b></w:note></part></w:list>' AS markup FROM part")
def c14n_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive canonical form with comments: prefixes declared where they are used"""
    other = F.when(F.col("p_size") % 2 == 0, "u").otherwise("w")
    size = F.concat(F.lit('<u:size v:unit="'), F.col("p_brand"), F.lit('">'), F.col("p_size").cast("string"), F.lit("</u:size>"))
    body = F.concat(F.lit('<w:list xmlns:u="urn:u" xmlns:v="urn:v" xmlns:w="urn:w" xmlns:x="urn:x"><part id="'), F.col("p_partkey").cast("string"), F.lit('" xmlns="urn:p"><!--'), F.col("p_name"), F.lit("-->"), size, F.lit('<w:note xmlns:u="urn:'), other, F.lit('"><u:b/></w:note></part></w:list>'))
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), body.alias("xml"))
    return O.serialized(stored_xml(docs, "id", "xml"), exclusive=(), comments=True)


@query("SELECT c_custkey AS doc_id, unnest(['Namespace prefix n' || c_nationkey || ' on ' || lower(c_mktsegment) || ' is not defined', 'Namespace prefix n' || c_nationkey || ' for k on ' || lower(c_mktsegment) || ' is not defined']) AS message FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT c_custkey, 'xmlns:e: Empty XML namespace is not allowed' FROM customer WHERE c_acctbal < 0")
def namespace_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes that nothing declares, and empty declarations"""
    prefix, name = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lower("c_mktsegment")
    body = F.concat(F.lit('<c xmlns:n7="urn:7"'), F.when(F.col("c_acctbal") < 0, ' xmlns:e=""').otherwise(""), F.lit("><"), prefix, F.lit(":"), name, F.lit(" "), prefix, F.lit(':k="1"/></c>'))
    docs = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("id"), body.alias("xml"))
    return O.namespace_errors(shred_xml(docs, "id", "xml")).select("doc_id", "message")


@query("SELECT p_partkey AS doc_id, '<part id=\"' || p_partkey || '\">' || chr(10) || '  <name>' || p_name || '</name>' || chr(10) || '  <make>' || chr(10) || '    <brand>' || p_brand || '<b><i/></b></brand>' || chr(10) || '    <!--' || p_type || '-->' || chr(10) || '  </make>' || chr(10) || '  <note/>' || chr(10) || '</part>' || chr(10) AS markup FROM part")
def pretty_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in lines, indented, but for what stands beside text"""
    body = F.concat(F.lit('<part id="'), F.col("p_partkey").cast("string"), F.lit('">\n'), O.element("name", F.col("p_name")), F.lit(" <make><brand>"), F.col("p_brand"), F.lit("<b><i/></b></brand><!--"), F.col("p_type"), F.lit("-->\t</make><note></note></part>"))
    nodes = stored_xml(spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), body.alias("xml")), "id", "xml")
    return O.pretty(unbroadcast(stored(A.without_blank_text(nodes), "stripped")))


_XI = 'xmlns:xi="http://www.w3.org/2001/XInclude"'


@query(f"SELECT c_custkey + 1000 AS doc_id, '<c {_XI}><n xmlns=\"\" {_XI} name=\"' || n_name || '\"><r xmlns=\"\">' || r_name || '</r></n>' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '<none></none>' ELSE '&lt;r&gt;' || r_name || '&lt;/r&gt;' END || '</c>' AS markup FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def xinclude_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers include their nations, and these their regions; also as texts, and with a fallback"""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = lambda column, at: (F.col(column) + at).cast("long").alias("doc_id")
    regions = r.select(key("r_regionkey", 0), F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")).alias("uri"), O.element("r", F.col("r_name")).alias("xml"))
    nation = F.concat(F.lit(f'<n {_XI} name="'), F.col("n_name"), F.lit('"><xi:include href="../r/'), F.col("n_regionkey").cast("string"), F.lit('"/></n>'))
    nations = n.select(key("n_nationkey", 100), F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("uri"), nation.alias("xml"))
    other = F.when(F.col("c_custkey") % 2 == 0, F.lit('<xi:include href="../none"><xi:fallback><none/></xi:fallback></xi:include>')).otherwise(F.concat(F.lit('<xi:include parse="text" href="../r/'), F.col("n_regionkey").cast("string"), F.lit('"/>')))
    body = F.concat(F.lit(f'<c {_XI}><xi:include href="../n/'), F.col("c_nationkey").cast("string"), F.lit('"/>'), F.col("c_mktsegment"), other, F.lit("</c>"))
    customers = spread(c).join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").select(key("c_custkey", 1000), F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("uri"), body.alias("xml"))
    markup, _ = spliced(regions.union(nations).union(customers))
    return markup.where("doc_id >= 1000")


@query("SELECT p_partkey AS doc_id, p_name || ' & <' || p_brand || '> A' || '&amp;' || p_type || ' <&#65;>' AS value FROM part")
def push_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of chunked documents: references resolved, but for those in CDATA sections"""
    body = F.concat(F.lit("<part>"), X.escape(F.col("p_name")), F.lit(" &amp; &#60;"), X.escape(F.col("p_brand")), F.lit("&#x3E; &#65;<![CDATA[&amp;"), F.col("p_type"), F.lit(" <&#65;>]]></part>"))
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), body.alias("xml"))
    return plain_texts(whole_texts(_pushed(docs, 11, push_events))).where("event = 'text'").select("doc_id", "value")


@query("SELECT o_orderkey AS doc_id, unnest(['price', 'price', 'urgent'][: CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 2 END]) AS name, unnest([2, 3, 4][: CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 2 END]) AS depth FROM orders")
def push_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements selected by ``/sale//order//*`` while the orders arrive in chunks"""
    price = O.element("price", F.col("o_totalprice"))
    urgent = F.when(F.col("o_orderpriority").startswith("1"), "<!--<price>--><note><urgent/></note>").otherwise("<note></note>")
    body = F.concat(F.lit("<sale><price/><order>"), price, F.lit("<list>"), price, urgent, F.lit("</list></order></sale>"))
    docs = spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("id"), body.alias("xml"))
    found = _pushed(docs, 40, lambda chunks: push_matches(chunks, [(P.CHILD, "sale"), (P.DESCENDANT, "order"), (P.DESCENDANT, "*")]))
    return found.where(~F.col("name").isin("list", "note")).select("doc_id", "name", "depth")


def _part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    size = O.element("size", F.col("p_size"))
    body = F.concat(F.lit('<part xmlns="urn:p" b="2" id="'), F.col("p_partkey").cast("string"), F.lit('">'), O.element("name", F.col("p_name"), brand=F.col("p_brand")), size, F.lit("<note/></part>"))
    return p.select(F.col("p_partkey").alias("id"), body.alias("xml"))


@query("SELECT p_partkey AS doc_id, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to XML, XML to nodes, nodes to rows"""
    n = stored_xml(_part_documents(spark, sf_dir), "id", "xml")
    parts = A.everywhere(n, A.test("part", ns_uri="urn:p"))
    rows = O.records(parts, n, {"name": ("child", "name"), "size": ("child", "size")}).select("doc_id", "name", "size")
    return rows.join(O.records(named(n, "name"), n, {"brand": ("attribute", "brand")}).select("doc_id", "brand"), "doc_id")


@query("SELECT 'children' AS violation, count(*) AS n FROM part WHERE p_size % 2 = 0 HAVING count(*) > 0")
def dtd_content_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content models: a second size element is one too many"""
    docs = _part_documents(spark, sf_dir).withColumn("xml", F.when(F.regexp_extract("xml", r"<size>(\d+)", 1).cast("int") % 2 == 0, F.replace("xml", F.lit("<note/>"), F.lit("<size>0</size><note/>"))).otherwise(F.col("xml")))
    models = spark.createDataFrame([("part", "name size (note )?", False), ("name", "", True), ("size", "", True), ("note", "", False)], "local string, model string, mixed boolean")
    return V.content_model(stored_xml(docs, "id", "xml"), models).groupBy("violation").agg(F.count("*").alias("n"))


_LINES_SQL = "SELECT l_orderkey AS doc_id, 'lines' AS local, CASE WHEN count(*) > 5 OR count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0 THEN 'unexpected' ELSE 'incomplete' END AS violation FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5 OR count(*) < 2 OR count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0"
_LINES = C.Automata({"order": C.sequence(C.name("lines")), "lines": C.choice(C.repeated(C.choice(C.name("N"), C.name("A")), 2, 5), C.repeated(C.choice(C.name("R"), C.name("A")), 2, 5)), "N": C.sequence(), "A": C.sequence(), "R": C.sequence()})


def _line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order, with an element named by its flag for each of its lines"""
    flags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda t: F.concat(F.lit("<"), t["l_returnflag"], F.lit("/>"))), "")
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flags.alias("flags"))
    return found.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("<order><lines>"), "flags", F.lit("</lines></order>")).alias("xml"))


@query(_LINES_SQL)
def content_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two to five lines, not N and R together: orders that don't hold to it"""
    nodes = shred_xml(_line_documents(spark, sf_dir), "id", "xml").where(F.col("kind") == ELEMENT)
    return C.content_violations(stored(nodes.select("doc_id", "pre", "parent", "kind", "local"), "content-nodes"), _LINES).select("doc_id", "local", "violation")


@query(_LINES_SQL)
def push_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while the orders arrive in chunks"""
    return _pushed(_line_documents(spark, sf_dir), 25, lambda chunks: C.push_violations(chunks, _LINES)).select("doc_id", "local", "violation")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS good FROM part")
def well_formedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd sizes lose their last tag"""
    docs = _part_documents(spark, sf_dir).withColumn("xml", F.when(F.regexp_extract("xml", r"<size>(\d+)", 1).cast("int") % 2 == 1, F.replace("xml", F.lit("</part>"), F.lit(""))).otherwise(F.col("xml")))
    good = shred_xml(docs, "id", "xml").where("pre = 0").select("doc_id", F.lit(1).alias("good"))
    return docs.select(F.col("id").alias("doc_id")).join(good, "doc_id", "left").select("doc_id", F.coalesce("good", F.lit(0)).alias("good"))


@query("SELECT page_id AS doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS n, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) = 'en' AS english FROM pages WHERE html LIKE '%<p>%'")
def xp_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each paragraph, and lang('en')"""
    n = page_nodes(spark, sf_dir)
    found = A.languages(named(n, "p"), n)
    return found.groupBy("doc_id", "lang").agg(F.count("*").alias("n")).withColumn("english", A.lang(F.col("lang"), "en"))


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<a href=\"/[a-m]')) AS n_prefix, len(regexp_extract_all(html, '<li>')) - 1 AS n_next, len(regexp_extract_all(html, '<li>')) AS n_below FROM pages WHERE len(regexp_extract_all(html, '<li>')) > 1")
def css_combinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a[href^=..], li + li, and nav li"""
    n = page_nodes(spark, sf_dir)
    items, links = named(n, "li"), named(n, "a")
    first = functools.reduce(lambda x, y: x | y, (attribute_matches("^=", f"/{c}") for c in "abcdefghijklm"))
    prefix = by_attribute(links, n, "href", first).groupBy("doc_id").agg(F.count("*").alias("n_prefix"))
    after = combined(items, "+", items).groupBy("doc_id").agg(F.count("*").alias("n_next"))
    below = combined(named(n, "nav"), " ", items).groupBy("doc_id").agg(F.count("*").alias("n_below"))
    return after.join(below, "doc_id").join(prefix, "doc_id", "left").select("doc_id", F.coalesce("n_prefix", F.lit(0)).alias("n_prefix"), "n_next", "n_below")


@query("SELECT p_partkey AS doc_id, p.prefix, p.uri, 4 AS n FROM part, (VALUES ('', 'urn:p'), ('xml', 'http://www.w3.org/XML/1998/namespace')) p(prefix, uri)")
def xp_namespace_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces in scope of the elements of each part's document"""
    n = stored_xml(_part_documents(spark, sf_dir), "id", "xml")
    return A.namespaces(A.everywhere(n, A.test()), n).groupBy("doc_id", "prefix", "uri").agg(F.count("*").cast("int").alias("n"))


@query("SELECT p_partkey AS doc_id, 'part' AS local, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size > 25")
def xp_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id() of tokens, of which one is the document's"""
    docs = _part_documents(spark, sf_dir)
    n = stored_xml(docs, "id", "xml")
    size = F.regexp_extract("xml", r"<size>(\d+)", 1).cast("int")
    wanted = docs.select(F.col("id").alias("doc_id"), F.concat(F.lit("none "), F.when(size > 25, F.col("id")).otherwise(-1).cast("string"), F.lit(" 0x ")).alias("ids"))
    found = A.by_id(n, wanted)
    return A.step(found, n, "attribute", A.test("id", ATTRIBUTE)).select("doc_id", F.lit("part").alias("local"), F.col("value").alias("id"))


@query("SELECT p_partkey AS doc_id, unnest([0, 1, 2]) AS place, unnest([p_name, CAST(p_size AS VARCHAR), '  ']) AS text FROM part")
def strip_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank texts between elements go; where xml:space preserves them they stay"""
    docs = _part_documents(spark, sf_dir).withColumn("xml", F.replace(F.replace("xml", F.lit("><size"), F.lit(">\n  <size")), F.lit("<note/>"), F.lit('\t<note xml:space="preserve">  </note>\n')))
    kept = A.without_blank_text(stored_xml(docs, "id", "xml")).where("kind = 3")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1
    return kept.select("doc_id", place.alias("place"), F.col("value").alias("text"))


@query("SELECT p_partkey AS doc_id, unnest(['start part', 'start name', 'text', 'end name', 'start size', 'text', 'end size', 'empty note', 'end part']) AS event, unnest(range(1, 10)) AS place FROM part")
def reader_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull reader's events in order"""
    events = A.reader_events(stored_xml(_part_documents(spark, sf_dir), "id", "xml"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long")
    return events.select("doc_id", F.concat_ws(" ", "event", "name").alias("event"), place.alias("place"))


@query("SELECT p_partkey AS doc_id, 1 AS line, length('<part xmlns=\"urn:p\" b=\"2\" id=\"' || p_partkey || '\"><name brand=\"' || p_brand || '\">' || p_name || '</name><size>' || p_size || '</size><note/>') AS col, 'no element found' AS message FROM part WHERE p_size % 2 = 1")
def xml_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents of odd sizes, which lose their last tag, break off"""
    docs = _part_documents(spark, sf_dir)
    odd = F.regexp_extract("xml", r"<size>(\d+)", 1).cast("int") % 2 == 1
    return xml_errors(docs.withColumn("xml", F.when(odd, F.replace("xml", F.lit("</part>"), F.lit(""))).otherwise(F.col("xml"))), "id", "xml")


@query("SELECT w AS role, count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM (SELECT conv_id, regexp_extract(text, '^([^ ]*) ', 1) AS w FROM conversations) WHERE w <> '' GROUP BY w")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions in SQL: the first word of each text that has a space"""
    register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("xp_conversations")
    return spark.sql("SELECT xp_substring_before(text, ' ') AS role, count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM xp_conversations WHERE xp_substring_before(text, ' ') <> '' GROUP BY 1")


# --- keys, sorting, numbering, grouping on tables ------------------------------------------------------------------


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def key_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key('orders', @custkey)"""
    found = K.lookup(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "c_custkey", "o_custkey")
    return found.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, max(l_extendedprice) AS highest FROM lineitem GROUP BY ALL")
def key_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Muenchian grouping"""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("highest"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def group_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer: the nodes that stand for their groups"""
    return K.distinct_keys(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer[order[@total > 300000]]"""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def not_exists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer[not(order[@total > 400000])]"""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) INTERSECT SELECT c_nationkey FROM customer")
def value_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation keys that suppliers and customers share (node-set = node-set)"""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return n.join(s, "n_nationkey", "left_semi").join(c, "n_nationkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal, c_custkey) AS place FROM customer QUALIFY place <= 50")
def sort_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xsl:sort by two keys, the first 50: a top-k before the places are given"""
    order = [K.sort_key(F.col("c_mktsegment"), order="descending"), K.sort_key(F.col("c_acctbal"), "number"), F.col("c_custkey")]
    top = table(spark, sf_dir, "customer").orderBy(*order).limit(50)
    return top.select("c_custkey", "c_mktsegment", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS number FROM lineitem")
def number_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.number_single(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"]).withColumn("number", F.col("number").cast("long"))


@query("SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS number FROM conversations")
def number_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level="any": the user's turns so far"""
    return K.number_any(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "number")


@query("SELECT r_name || '/' || n_name AS label, dense_rank() OVER (ORDER BY r_name) || '.' || row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS number FROM nation JOIN region ON n_regionkey = r_regionkey")
def number_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").withColumn("i", F.row_number().over(Window.orderBy("r_name")))
    n = K.number_single(table(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")), ["r_name"], ["n_name"], "j")
    return n.select(F.concat_ws("/", "r_name", "n_name").alias("label"), K.number_multiple([F.col("i"), F.col("j")]).alias("number"))


@query("SELECT p_brand, max(p_retailprice) AS highest, min(p_retailprice) AS lowest, sum(p_size) AS total FROM part GROUP BY p_brand")
def math_max_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(X.max_of(p).alias("highest"), X.min_of(p).alias("lowest"), F.sum("p_size").alias("total"))


@query("SELECT p_brand, p_partkey FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) = 1")
def math_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.highest(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice").select("p_brand", "p_partkey")


@query("SELECT role, sum(length(text)) AS n_chars FROM conversations GROUP BY role")
def text_length_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(X.string_length(F.col("text"))).alias("n_chars"))


@query("SELECT a.conv_id, a.turn, b.turn AS previous FROM conversations a JOIN (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.next")
def preceding_sibling_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """preceding-sibling::turn[1]"""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return t.withColumn("previous", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where("previous is not null")


@query("SELECT l_orderkey, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'N' AND b.l_quantity > a.low) AS less, EXISTS (SELECT 1 FROM lineitem b, lineitem c WHERE b.l_orderkey = a.l_orderkey AND c.l_orderkey = a.l_orderkey AND b.l_returnflag <> 'N' AND c.l_returnflag = 'N' AND b.l_quantity <> c.l_quantity) AS differ FROM (SELECT l_orderkey, min(l_quantity) AS low FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'N' AND (b.l_quantity > a.low)) OR EXISTS (SELECT 1 FROM lineitem b, lineitem c WHERE b.l_orderkey = a.l_orderkey AND c.l_orderkey = a.l_orderkey AND b.l_returnflag <> 'N' AND c.l_returnflag = 'N' AND b.l_quantity <> c.l_quantity)")
def nodeset_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in which a returned quantity is less than, or differs from, some quantity that is not (node-set < and != node-set)"""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("value"))
    returned, others = lines.where("l_returnflag <> 'N'"), lines.where("l_returnflag = 'N'")
    less, differ = (K.some_pair(returned, others, ["l_orderkey"], o).withColumn(n, F.lit(True)) for o, n in (("<", "less"), ("!=", "differ")))
    return less.join(differ, "l_orderkey", "full").select("l_orderkey", F.coalesce("less", F.lit(False)).alias("less"), F.coalesce("differ", F.lit(False)).alias("differ"))


@query("SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name < 'F'")
def optional_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child that may be missing"""
    n = table(spark, sf_dir, "nation").where("n_name < 'F'")
    return table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", "n_name")


# --- functions -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, count(*) AS n, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id")
def str_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.tokenize(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")).where("n > 0")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS normal, translate(text, 'aeiou', 'AEIO') AS translated, substr(text, 2, 5) AS part, length(text) AS n FROM documents")
def str_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_space(t).alias("normal"), X.translate(t, "aeiou", "AEIO").alias("translated"), X.substring(t, F.lit(1.5), F.lit(5.2)).alias("part"), X.string_length(t).cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, ' ') THEN split_part(p_type, ' ', 1) ELSE '' END AS before, CASE WHEN contains(p_type, ' ') THEN substr(p_type, instr(p_type, ' ') + 1) ELSE '' END AS after, starts_with(p_type, 'S') AS starts FROM part")
def str_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, space = F.col("p_type"), F.lit(" ")
    return table(spark, sf_dir, "part").select("p_partkey", X.substring_before(t, space).alias("before"), X.substring_after(t, space).alias("after"), X.starts_with(t, F.lit("S")).alias("starts"))


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, dayofyear(ts) AS doy, dayofweek(ts) + 1 AS dow, hour(ts) AS h, minute(ts) AS mi FROM events")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("event_id", X.date_parts(F.col("ts")).alias("p"))
    names = {"year": "y", "month": "m", "day_in_month": "d", "day_in_year": "doy", "day_in_week": "dow", "hour": "h", "minute": "mi"}
    return p.select("event_id", *(F.col(f"p.{k}").cast("long").alias(v) for k, v in names.items()))


_DUE = "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_months(1 + o_orderkey % 14) + to_days(2) + to_hours(3)"


@query(f"SELECT o_orderkey, {_DUE} AS due, 'P' || date_diff('day', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), {_DUE}) || 'DT3H' AS distance, monthname(CAST(o_orderdate AS DATE)) AS month, dayname(CAST(o_orderdate AS DATE)) AS day FROM orders")
def date_add_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date:add of 1 to 14 months, 2 days and 3 hours; date:difference; names"""
    day = F.col("o_orderdate").cast("date")
    months = (F.col("o_orderkey") % 14 + 1).cast("int")
    length = F.concat(F.lit("P"), F.floor(months / 12).cast("string"), F.lit("Y"), (months % 12).cast("string"), F.lit("M2DT3H"))
    due = E.date_add(day, length)
    return table(spark, sf_dir, "orders").select("o_orderkey", due.alias("due"), E.date_difference(day, due).alias("distance"), E.month_name(day).alias("month"), E.day_name(day).alias("day"))


@query("SELECT o_custkey, CAST(sum(o_orderkey % 50 * 3600 + 90) AS BIGINT) AS seconds, 'P' || CASE WHEN sum(o_orderkey % 3 + 13) >= 12 THEN sum(o_orderkey % 3 + 13) // 12 || 'Y' ELSE '' END || CASE WHEN sum(o_orderkey % 3 + 13) % 12 > 0 THEN sum(o_orderkey % 3 + 13) % 12 || 'M' ELSE '' END AS months FROM orders GROUP BY o_custkey")
def date_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date:seconds, date:sum and date:add-duration of durations that are texts"""
    hours = F.concat(F.lit("PT"), (F.col("o_orderkey") % 50).cast("string"), F.lit("H1M30S"))
    months = E.add_durations(F.lit("P1Y"), F.concat(F.lit("P"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("M")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(E.date_seconds(hours)).cast("long").alias("seconds"), E.sum_durations(months).alias("months"))


@query("SELECT p_partkey, len(string_split(p_type, ' ')) AS n_parts, replace(replace(replace(p_type, 'ANODIZED', 'plain'), 'STEEL', 'iron'), 'TIN', 'foil') AS replaced, sqrt(p_size) AS root, power(p_size, 2) AS square, ln(p_size) AS log, 'Brand:' || p_brand AS joined FROM part")
def str_math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str:split, str:replace, math:sqrt, math:power, math:log, concat"""
    t, x = F.col("p_type"), F.col("p_size").cast("double")
    pairs = [("TIN", "foil"), ("ANODIZED", "plain"), ("STEEL", "iron")]
    return table(spark, sf_dir, "part").select("p_partkey", F.size(E.split(t)).cast("long").alias("n_parts"), E.replace(t, pairs).alias("replaced"), E.math("sqrt", x).alias("root"), E.power(x, F.lit(2.0)).alias("square"), E.math("log", x).alias("log"), F.concat(F.lit("Brand:"), X.string(F.col("p_brand"))).alias("joined"))


@query("SELECT c_nationkey, string_agg(c_name, '' ORDER BY c_custkey) AS names FROM customer GROUP BY c_nationkey")
def str_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str:concat of each group's names in order"""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(E.concat(F.col("c_name"), F.col("c_custkey")).alias("names"))


@query("SELECT p_brand, CASE WHEN count(*) FILTER (p_size = 50) > 0 THEN 'NaN' ELSE CAST(sum(p_size) AS VARCHAR) END AS texts, CAST(sum(p_size) AS DOUBLE) AS sizes, sum(p_size) > 0 AS some FROM part GROUP BY p_brand")
def sum_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sum() of texts: NaN if one is no number; boolean() of a number"""
    text = F.when(F.col("p_size") == 50, "fifty").otherwise(F.col("p_size").cast("string"))
    found = table(spark, sf_dir, "part").groupBy("p_brand").agg(X.sum_of(X.number(text)).alias("t"), X.sum_of(F.col("p_size").cast("double")).alias("sizes"))
    return found.select("p_brand", X.number_text(F.col("t")).alias("texts"), "sizes", X.boolean_of_number(F.col("sizes")).alias("some"))


@query("SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS VARCHAR) ELSE CAST(p_size / 8 AS VARCHAR) END AS size, p_size / 4 = floor(p_size / 4) AS whole, floor(p_size / 4 + 0.5) AS rounded, p_size % 7 AS rest FROM part")
def num_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    q = X.divide(size, F.lit(4))
    return table(spark, sf_dir, "part").select("p_partkey", X.number_text(X.divide(size, F.lit(8))).alias("size"), (q == F.floor(q)).alias("whole"), X.round_half_up(q).alias("rounded"), X.mod(size, F.lit(7)).cast("int").alias("rest"))


@query("SELECT c_custkey, format('{:,.2f}', CAST(round(c_acctbal, 2) AS DECIMAL(18, 2))) AS money FROM customer")
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format-number(x, '#,##0.00')"""
    return table(spark, sf_dir, "customer").select("c_custkey", X.format_number(F.col("c_acctbal"), 2, 2, 1, 3).alias("money"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' ELSE '' END || format('{:,.2f}', CAST(abs(round(c_acctbal, 2)) AS DECIMAL(18, 2))) || CASE WHEN c_acctbal < 0 THEN ')' ELSE '' END AS money, format('{:03d}', c_nationkey) || ' of 25' AS nation, CAST(c_nationkey * 4 AS VARCHAR) || '%' AS share, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || replace(replace(replace(format('{:,.2f}', CAST(abs(round(c_acctbal, 2)) AS DECIMAL(18, 2))), ',', 'x'), '.', ','), 'x', '.') AS european FROM customer")
def number_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format-number with a negative sub-pattern, a suffix, per cent, and a decimal format of its own"""
    x, n = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    european = E.picture(x, "#.##0,00", E.DecimalFormat(decimal=",", grouping="."))
    return table(spark, sf_dir, "customer").select("c_custkey", E.picture(x, "#,##0.00;(#,##0.00)").alias("money"), E.picture(n, "000 of 25").alias("nation"), E.picture(n / 25, "#0%").alias("share"), european.alias("european"))


_HOST = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
_FOLDER = "regexp_extract(regexp_extract(url, '^([^?#]*)'), '^[a-z]+://[^/]+(/.*)?/', 1)"


@query(f"SELECT page_id, {_HOST} || '/x/z?q=1' AS rooted, {_HOST} || {_FOLDER} || '/b/c.html#top' AS below, 'mailto:a@b.c' AS other, regexp_extract(url, '^([^#]*)') || '#f' AS fragment, lower({_HOST}) || '/a' AS normal FROM pages")
def uri_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against the pages' URLs, and normalised URIs"""
    of = lambda r: E.resolve_uri(F.lit(r), F.col("url"))
    shouted = F.concat(F.upper(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0)), F.lit("/./b/../a"))
    return table(spark, sf_dir, "pages").select("page_id", of("/x/y/../z?q=1").alias("rooted"), of("./a/../b/c.html#top").alias("below"), of("mailto:a@b.c").alias("other"), of("#f").alias("fragment"), E.normalize_uri(shouted).alias("normal"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.uri_parts(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", F.coalesce("u.path", F.lit("")).alias("path"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'mirror/' || substr(url, 9) WHEN starts_with(url, 'http') THEN 'never/' || substr(url, 5) ELSE url END AS resolved FROM pages")
def catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rewriteSystem: the longest prefix wins"""
    rules = spark.createDataFrame([("rewrite", "https://", "mirror/"), ("rewrite", "http", "never/"), ("uri", "urn:x", "x.xml")], "kind string, name string, target string")
    return resolved(table(spark, sf_dir, "pages").select("page_id", "url"), rules, "url").select("page_id", "resolved")


@query("SELECT n_nationkey, ['', 'I', 'II', 'III', 'IV'][n_regionkey + 1] AS numeral, chr(CAST(65 + n_nationkey AS INT)) AS letter FROM nation")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", X.roman(F.col("n_regionkey")).alias("numeral"), X.letters(F.col("n_nationkey") + 1).alias("letter"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, length(o_orderpriority) AS n_priority FROM orders")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as XML, with tags of records in comments, CDATA and attribute values, and read again as records by many tasks"""
    tag = F.format_string("<!-- <order> --><order key='%s'><!-- </order> --><cust>%s</cust>", "o_orderkey", "o_custkey")
    rest = F.concat(F.lit("<status note=\"a > b\">"), "o_orderstatus", F.lit("</status><p><![CDATA["), "o_orderpriority", F.lit("</order>]]></p></order\n>"))
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).select(F.concat(tag, rest).alias("value")).write.text(path)
    part = lambda p: F.regexp_extract("text", p, 1)
    keys = (part(r"^<order key='(\d+)'").cast("long").alias("o_orderkey"), part(r"<cust>(\d+)").cast("long").alias("o_custkey"))
    return read_records(spark, path, "order").where("complete").select(*keys, part(r"<status [^<]*>(\w*)<").alias("o_orderstatus"), F.length(part(r"\[CDATA\[([^<]*)<")).cast("long").alias("n_priority"))


_INSTANTS_SQL = "[DATE '1696-09-01', DATE '1697-02-01', DATE '1903-03-01', DATE '1903-07-01']"
_MONTHS_DAYS = f"list_distinct([sign(date_diff('day', CAST(i + to_days(CAST(o_custkey % 400 AS INTEGER)) AS DATE), CAST(i + to_months(CAST(o_orderkey % 14 AS INTEGER)) AS DATE))) FOR i IN {_INSTANTS_SQL}])"


@query(f"WITH d AS (SELECT o_orderkey, {_MONTHS_DAYS} AS s, o_custkey % 40 - 20 AS h FROM orders) SELECT o_orderkey, CASE WHEN len(s) > 1 THEN 'incomparable' ELSE ['less', 'equal', 'greater'][CAST(s[1] AS INTEGER) + 2] END AS durations, CASE WHEN h > 14 THEN 'greater' WHEN h < -14 THEN 'less' ELSE 'incomparable' END AS mixed, ['less', 'equal', 'greater'][CAST(sign(h - 2) AS INTEGER) + 2] AS zoned FROM d")
def typed_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months against days, times with and without a zone, and times of two zones, hours apart"""
    months = F.concat(F.lit("P"), (F.col("o_orderkey") % 14).cast("string"), F.lit("M"))
    days = F.concat(F.lit("P"), (F.col("o_custkey") % 400).cast("string"), F.lit("D"))
    noon = F.col("o_orderdate").cast("date").cast("timestamp") + F.expr("interval 30 hours")
    at = lambda t, zone="": F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    moved = at(noon + F.make_dt_interval(hours=(F.col("o_custkey") % 40 - 20).cast("int")))
    zoned = T.compare_times(F.concat(moved, F.lit("Z")), at(noon, "-02:00"))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", T.compare_durations(months, days).alias("durations"), T.compare_times(F.concat(moved, F.lit("Z")), at(noon)).alias("mixed"), zoned.alias("zoned"))


@query("SELECT c_custkey, CASE WHEN round(c_acctbal, 2) = 0 THEN '0.0' ELSE regexp_replace(CAST(CAST(round(c_acctbal, 2) AS DECIMAL(18, 2)) AS VARCHAR), '0$', '') END AS canonical, c_acctbal IS NOT NULL AS same FROM customer")
def canonical_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals with superfluous zeros: their canonical form, and that they are equal to it"""
    plain = F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string")
    padded = F.concat(F.when(plain.startswith("-"), "-000").otherwise("+00"), F.regexp_replace(plain, "^-", ""), F.lit("000"))
    canonical = T.canonical_decimal(padded)
    return table(spark, sf_dir, "customer").select("c_custkey", canonical.alias("canonical"), (T.compare_decimals(padded, canonical) == "equal").alias("same"))


# --- validation ----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, 'shipping' AS pattern, CASE WHEN l_returnflag = 'R' THEN 'returned at a discount' ELSE 'heavy' END AS message FROM lineitem WHERE (l_returnflag = 'R' AND l_discount > 0.05) OR (l_returnflag <> 'R' AND l_quantity > 45)")
def schematron_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"shipping": [(F.col("l_returnflag") == "R", "returned at a discount", F.col("l_discount") <= 0.05), (F.lit(True), "heavy", F.col("l_quantity") <= 45)]}
    return V.asserted(table(spark, sf_dir, "lineitem"), rules).select("l_orderkey", "l_linenumber", "pattern", "message")


@query("SELECT p_partkey, p_size > 40 AS bad_bounds, NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]*') AS bad_pattern FROM part WHERE p_size > 40 OR NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')")
def xsd_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.concat(V.facets(F.col("p_size"), bounds=(1, 40)), V.facets(F.col("p_brand"), pattern="Brand#[1-3][0-9]*"))
    return table(spark, sf_dir, "part").withColumn("bad", bad).where(F.size("bad") > 0).select("p_partkey", F.array_contains("bad", "bounds").alias("bad_bounds"), F.array_contains("bad", "pattern").alias("bad_pattern"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def keyref_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.repeated_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
