"""The queries of the corpus operators, with their production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from thicket.llm.chat import chat_digests
from thicket.llm.common import table
from thicket.llm.embedding_dedup import near_duplicates
from thicket.llm.fingerprints import fingerprints
from thicket.llm.html_extraction import extracted
from thicket.llm.jaccard import jaccard_components
from thicket.llm.mixing import Mixture, mixed
from thicket.llm.packing import pack, pieces
from thicket.llm.prefix_trie import prefix_trie
from thicket.llm.substring_dedup import deduplicated
from thicket.llm.token_counts import token_counts
from thicket.llm.token_output import read_shards, write_shards
from thicket.llm.toxicity import toxicity, train
from thicket.llm.vector_codes import vector_codes

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=2048, end_id=0), capacity=2048)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), limit=4096)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Equal weights would repeat the smaller sources more often than that, so the exponent is bisected.
    return mixed(table(spark, sf_dir, "documents"), Mixture(max_repeats=1.05))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), rounds=4).drop("scanned")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_jaccard_join,
        op3_toxicity,
        op4_html_extraction,
        op5_best_fit_packing,
        op6_substring_dedup,
        op7_token_counts,
        op8_fingerprints,
        op9_embedding_dedup,
        op10_mixing,
        op11_chat_formatting,
        op12_prefix_trie,
        op13_vector_codes,
    )
}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORDERED = "ORDER BY turn NULLS FIRST, role, text"
_WRITTEN = "length(regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))"
#: CRC-32 bit by bit, of a decimal number; only its last two bits count, which the final complement turns over.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length(c))), lambda a, i:
  CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(a, ascii(substr(c, (i // 8 + 1)::INT, 1))) ELSE a END) & 1 = 1
  THEN xor((CASE WHEN i % 8 = 0 THEN xor(a, ascii(substr(c, (i // 8 + 1)::INT, 1))) ELSE a END) >> 1, 3988292384)
  ELSE (CASE WHEN i % 8 = 0 THEN xor(a, ascii(substr(c, (i // 8 + 1)::INT, 1))) ELSE a END) >> 1 END)"""


def _lloyd_sql(rounds: int) -> str:
    """Rounds of Lloyd as plain SQL: every part against every entry, the lower index of equal distances first."""
    sql = [
        """WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS x FROM kept, range(4) r(p)),
books0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"""
    ]
    for k in range(rounds + 1):
        sql.append(f"near{k} AS (SELECT vec_id, p, x, e, d FROM (SELECT vec_id, p, x, e, list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS d FROM parts JOIN books{k} USING (p)) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)")
        if k < rounds:
            sql.append(
                f"""sums{k} AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS s FROM near{k}, range(1, len(x) + 1) r(i) GROUP BY ALL),
books{k + 1} AS (SELECT p, e, coalesce(z, y) AS y FROM books{k} LEFT JOIN (SELECT p, e, list(s ORDER BY i) AS z FROM sums{k} GROUP BY ALL) USING (p, e))"""
            )
    sql.append(
        f"""coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
    )
    return ",\n".join(sql)


#: Components: what is reachable over links, round by round.
_REACH = "reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, linked.y FROM reach JOIN linked ON reach.other = linked.x)"

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": f"""
WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM split, range(1, greatest(len(w) - 3, 1) + 1) r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id) USING (doc_id)""",
    "op6_substring_dedup": f"""
WITH split AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM split, range(1, len(w) - 48) r(i)),
covered AS (SELECT doc_id, i FROM windows JOIN (SELECT h, min(doc_id) AS least FROM windows GROUP BY h) USING (h) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
judged AS (SELECT p.doc_id, p.i, word, max(c.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM judged GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)""",
    "op9_embedding_dedup": f"""
WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM linked GROUP BY x) USING (vec_id) JOIN (SELECT id AS vec_id, min(other) AS component_id FROM reach GROUP BY id) USING (vec_id)""",
    "op11_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDERED})) AS turns_sha256,
  coalesce(string_agg(text, '' {_ORDERED}) FILTER (role = 'assistant'), '') AS loss,
  sum(24 + {_WRITTEN.format("role")} + 5 * (length(role) - length(replace(role, chr(10), ''))) + {_WRITTEN.format("text")})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op12_prefix_trie": f"""
WITH turns AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, turn, len({_WORDS.format("coalesce(text, '')")}) AS w FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, t, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS pos FROM turns),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, 3 - ({_CRC}) % 4 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS c FROM turns)),
borrowed AS (SELECT c.conv_id, t, w, pos FROM convs c JOIN placed p ON p.conv_id = base AND pos < h),
lent AS (SELECT conv_id, count(*) AS k FROM borrowed GROUP BY conv_id),
built AS (SELECT * FROM borrowed UNION ALL SELECT conv_id, t, w, coalesce(k, 0) + pos - h FROM convs JOIN placed USING (conv_id) LEFT JOIN lent USING (conv_id) WHERE pos >= h),
prefixes AS (SELECT conv_id, pos + 1 AS depth, w, list(t) OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM built UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved FROM prefixes GROUP BY key, depth),
below AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN below USING (key)),
sums AS (SELECT list_slice(key, 1, d) AS key, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM tree, range(0, depth + 1) r(d) GROUP BY ALL),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, key FROM prefixes QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY key)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM tree t JOIN sums USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON t.depth > 0 AND p.key = list_slice(t.key, 1, t.depth - 1)""",
    "op13_vector_codes": _lloyd_sql(4),
}
