"""Chat formatting, the prefix trie and vector codes against plain versions, on small tables with nulls, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm.chat import PARTS, PROBE, chat_digests, formatted, parts_of, read_back
from thicket.llm.prefix_trie import prefix_trie, running
from thicket.llm.vector_codes import Assigned, Codebooks, ceil_root, floor_root, vector_codes

TURNS = "conv_id long, turn long, role string, text string, place int, name string, pos string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    """Shared openings, nulls, ties, repeated rows, control strings, line feeds in roles, and one long conversation."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 47), 60, 61, 1000, -20, -3]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["a", "b", f"own {c}"]) if t < 3 else f"t {c % 3} {t}"))
    rows += [(70, 0, None, None), (70, None, "user", "first"), (70, None, "user", "first"), (71, 5, "assistant", ""), (72, 1, "role\nof <|nl|> two", "<|im_end|>\n<|im_start|>"), (72, 2, "assistant", r"<\|x|> <\\| <| < |"), (None, 1, "user", "no id"), (80, 1, "assistant", "é 😀   x")]
    rows += [(81, t, "user" if t % 2 else "assistant", f"turn {t % 4}") for t in range(137)]
    rows += [(82, t, "user" if t % 2 else "assistant", f"turn {t % 4}") for t in range(90)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in conversations()], TURNS).repartition(5).cache()


def plain_order(rows):
    return sorted(((t is not None, t or 0), r or "", x or "") for _, t, r, x in rows)


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_chat_reads_back(spark, table):
    rows = [*conversations(), (-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    got = {r.conv_id: r for r in chat_digests(table).collect()}
    assert set(got) == set(by_conv(rows))
    for c, own in by_conv(rows).items():
        turns = [(r, x) for _, r, x in plain_order(own)]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert chat_digests(table.limit(0)).count() == 1


def test_chat_parts(spark):
    rows = [
        (1, 1, "user", [("text", "a <|", None, None, None, None, None), ("text", "|b", None, None, None, None, None), ("Image", None, "i.png", 57, 28, None, None), None, ("audio", None, "s.wav", None, None, 1.01, None)]),
        (1, 2, "assistant", [("document", None, "d.pdf", None, None, None, 3), ("text", "<|image_1|>", None, None, None, None, None), ("video", None, "v", None, None, None, None), ("text", "end", None, None, None, None, None)]),
        (1, 3, "assistant", None),
        (1, 4, "user", [("image", None, "none", None, -3, None, None), ("audio", None, "nan", None, None, float("nan"), None)]),
    ]
    chats = formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}"))
    row = chats.first()
    assert row.formatted == (
        "<|im_start|>user\na <\\|<|part|>|b<|image_1|><|audio_2|><|im_end|>\n<|im_start|>assistant\n<|document_3|><\\|image_1|><|other_4|>end<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\n<|image_5|><|audio_6|><|im_end|>\n"
    )
    assert [(a.ordinal, a.turn, a.type, a.ref, a.tokens) for a in row.attachments] == [(1, 0, "image", "i.png", 3), (2, 0, "audio", "s.wav", 26), (3, 1, "document", "d.pdf", 774), (4, 1, "other", "v", 0), (5, 3, "image", "none", 0), (6, 3, "audio", "nan", 0)]
    assert all(row.formatted[a.start :].startswith(f"<|{a.type}_{a.ordinal}|>") for a in row.attachments)
    spans = [row.formatted[s.start : s.start + s.length] for t in row.turns for s in t.loss]
    assert spans == ["<\\|image_1|>", "end"]
    assert row.n_tokens == 2 + 1 + 3 + 26 + 774 + 1 + 1
    back = read_back(chats).first().read
    assert [(t.role, t.loss) for t in back] == [("user", ""), ("assistant", "<|image_1|>end"), ("assistant", ""), ("user", "")]
    body = spark.createDataFrame([("a <\\|<|part|>|b<|image_1|><|other_12|>",)], "body string").select(parts_of(F.col("body")).alias("p")).first().p
    assert [(p.type, p.ordinal, p.text) for p in body] == [("text", None, "a <|"), ("text", None, "|b"), ("image", 1, None), ("other", 12, None)]


def plain_trie(rows):
    turns = {c: sorted(((t is not None, t or 0), sha(f"{len(r or '')}:{r or ''}{x or ''}"), (r or "", x or "")) for _, t, r, x in own) for c, own in by_conv(rows).items() if c is not None}
    turns = {c: [x[-1] for x in own] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + own[h:]
    nodes = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = sum(len(k) == len(key) + 1 for k in below)
        leaves = sum(not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below) for k in below)
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = sorted(c for c in members if len(built[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), children, leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def test_prefix_trie(spark, table):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie(table)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(conversations())
    assert prefix_trie(table.limit(0)).count() == 0
    # One conversation without turns of its own is left after rebuilding: only the root.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(21, 40)}
    lone = next(c for c, v in h.items() if v)
    assert [(r.conv_id, r.depth, r.n_leaves, r.ends_sha256) for r in prefix_trie(table.limit(0).select(*table.columns).union(spark.createDataFrame([(lone, 1, "user", "x", 1, "", "")], TURNS))).collect()] == [(lone, 0, 1, sha(str(lone)))]


def test_running_sums_over_ranges(spark):
    """Groups that span several ranges, and ranges of one group."""
    rng = random.Random(5)
    rows = [(g, i, rng.randint(-5, 5)) for g, n in ((1, 3), (2, 900), (3, 1), (4, 40), (5, 2000), (9, 2)) for i in range(n)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(r.g, r.i): r.v for r in running(spark.createDataFrame(rows, "g long, i long, v long").repartition(4), "g", ["i"], ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    total = {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + v
        assert got[g, i] == total[g]
    assert len(got) == len(rows)


def plain_codes(rows, rounds=4):
    """Lloyd without bounds, in Python integers."""
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(4, -(-max((len(v) for _, _, v in kept), default=0) // 4) * 4)
    ints = [[int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)) for _, _, v in kept]
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2]))[:256]
    n = width // 4
    part = lambda v, p: v[p * n : (p + 1) * n]
    books = [[part(ints[k], p) for k in order] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(4):
            got = [nearest(part(v, p), p) for v in ints]
            for e in range(len(books[p])):
                own = [part(v, p) for v, g in zip(ints, got, strict=True) if g == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for (i, lab, _), v in zip(kept, ints, strict=True):
        codes = [nearest(part(v, p), p) for p in range(4)]
        out.append([i, "".join(f"{c:02x}" for c in codes), sum(far(part(v, p), books[p][c]) for p, c in enumerate(codes)), lab])
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted([(r[0], r[1], r[2], sums[r[3]], digest) for r in out], key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, parts string, error int, code string"


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (9, 10))
    rows = [(int(k), [float(x) for x in np.float32(centres[k % 9] + rng.normal(0, 0.05, 10))], int(k % 3)) for k in rng.permutation(n)]
    return rows


def odd_vectors():
    rows = vectors(300, 1)
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 10, 1), (1003, [float("inf")] * 10, 1), (1004, [], None), (1005, [0.5] * 3, None), (None, [0.25] * 10, None), (7, [0.1] * 10, 2)]
    return rows + [(2000 + k, [0.5] * 10, 5) for k in range(120)] + [(2000, [0.5] * 10, 5)]


@pytest.mark.parametrize("rows", [vectors(40, 0), odd_vectors(), [(k, [1.0, 2.0, 3.0, 4.0], None) for k in range(5)], [(None, [0.5], 1)]], ids=["few", "odd", "equal", "no ids"])
def test_vector_codes(spark, rows):
    got = vector_codes(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4))
    found = sorted((tuple(r)[:5] for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    if any(r[0] is not None for r in rows):
        assert found == plain_codes(rows)
    else:
        assert [f[1] for f in found] == ["00000000"]


def test_vector_codes_bounds(spark):
    empty = vector_codes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    huge = vector_codes(spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [1e9] * 4, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.code for r in huge} == {1: "00000000", 2: "01010101", 3: "00000000"}
    # Bounds spare most scans once the entries settle, and never change what a scan would give.
    rng = np.random.default_rng(2)
    x = rng.integers(-400, 400, (16, 1, 4, 3)).repeat(200, axis=1).reshape(-1, 4, 3) + rng.integers(-9, 9, (3200, 4, 3))
    books = Codebooks.of(np.ascontiguousarray(x[::200].transpose(1, 0, 2)))
    state = Assigned.unknown(len(x)).moved(x, books)
    for _ in range(4):
        counts = np.stack([np.bincount(state.codes[:, p], minlength=16) for p in range(4)])
        sums = np.zeros((4, 16, 3), np.int64)
        for p in range(4):
            np.add.at(sums[p], state.codes[:, p], x[:, p])
        books = books.updated(counts, sums)
        state = state.moved(x, books)
        full = Assigned.unknown(len(x)).moved(x, books)
        assert (state.codes == full.codes).all()
    assert state.scanned.sum() < 0.2 * full.scanned.sum()


def test_roots():
    values = np.array([0, 1, 2, 3, 4, (1 << 52) + 1, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 61) + 12345], np.int64)
    for v, lo, hi in zip(values.tolist(), floor_root(values).tolist(), ceil_root(values).tolist(), strict=True):
        assert lo * lo <= v < (lo + 1) ** 2 and hi == lo + (lo * lo < v)
