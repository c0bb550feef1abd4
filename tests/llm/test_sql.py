"""The corpus queries against their DuckDB SQL, and fingerprints against a plain version."""

import glob
import math
import os

import duckdb
import pytest
import xxhash

from thicket.llm.fingerprints import fingerprints
from thicket.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns, key = sorted(want.columns), want.columns[0]
    assert got[columns].sort_values(key).values.tolist() == want[columns].sort_values(key).values.tolist()


def lanes(text):
    """128 counters of the bits of trigram hashes, and the number of trigrams."""
    counts, n = [0] * 128, 0
    for paragraph in text.split("\n"):
        words = paragraph.split(" ")
        for i in range(len(words)):
            g = 42
            for w in words[i : i + 3]:
                g = xxhash.xxh64_intdigest(w.encode(), g)
            g2 = xxhash.xxh64_intdigest(g.to_bytes(8, "little"), 42)
            for b in range(64):
                counts[b] += g >> b & 1
                counts[64 + b] += g2 >> b & 1
            n += 1
    return [*counts, n]


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = [2 * v - a[-1] for v in a[:-1]], [2 * v - b[-1] for v in b[:-1]]
    size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / size)) if size else 0.0


def test_fingerprints_by_definition(spark):
    import hashlib

    texts = ["one two three\nfour  five", "one two three\nfour  five six", "", "\n\n", "a " * 400 + "\n" + "b c d " * 300, "ünï \U0001f600 code points of more than one unit"]
    rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]

        def written(t):
            strong = [0] * 8
            for p in t.split("\n"):
                d = hashlib.sha256(p.encode()).hexdigest()
                strong = [(s + int(d[8 * i : 8 * i + 8], 16)) % (1 << 32) for i, s in enumerate(strong)]
            return "".join(f"{v:08x}" for v in [*strong, *lanes(t)])

        assert (r.fingerprint, r.edited_fingerprint) == (written(text), written(edited))
        assert abs(r.near_edited - likeness(lanes(text), lanes(edited))) < 1e-9
        assert abs(r.near_next - likeness(lanes(text), lanes(following))) < 1e-9
