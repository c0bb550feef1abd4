"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows, and more columns than they read."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from thicket.llm import embedding_dedup, jaccard, substring_dedup
from thicket.llm.embedding_dedup import near_duplicates
from thicket.llm.fingerprints import combined, fingerprints
from thicket.llm.html_extraction import extracted, main_text
from thicket.llm.mixing import Mixture, mixed, repeated
from thicket.llm.packing import best_fit, pack, pieces, solve
from thicket.llm.token_counts import PrefixCounter, token_counts
from thicket.llm.token_output import PerfectHash, lookup, read_shards, write_shards
from thicket.llm.toxicity import Landmarks, WordMachine, train, toxicity, without_toxic

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, tie string, spans string, h int"
WORDS = [f"w{i}" for i in range(60)]


def words(rng, n):
    return [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n)]


def corpus():
    """Texts with a shared passage, exact and near copies, odd white space, and null and empty ones."""
    rng = random.Random(4)
    passage, base = words(rng, 70), words(rng, 120)
    texts = {1: " ".join(base), 2: " ".join(base), 3: " ".join([*base[:60], "new", *base[61:]]), 4: None, 5: "", 6: "  \t\n ", 7: "One two", 8: "one TWO", 9: "é ñ 😀 <|endoftext|> a  b\n\nc"}
    texts |= {k: " ".join([*words(rng, 20 * k % 90), *passage, *words(rng, 30)]) for k in range(10, 20)}
    texts[20] = " ".join(words(rng, 9000))
    texts[21] = "a " * 300
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}" if k % 7 else None, "x", "y", k) for k, t in corpus().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, and repeated rows."""
    return spark.createDataFrame([(None, "a b c", "s", "x", "y", 1), (1, "d e", None, "x", "y", 1), (1, "f", "s", "x", "y", 1), (1, "f", "s", "x", "y", 1), (None, None, None, None, None, None)], SCHEMA)


def ids_of(text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_output(spark, docs, empty, odd):
    manifest = write_shards(docs, BPE, 2)
    got = {r.doc_id: r for r in read_shards(manifest).collect()}
    at = 0
    for k, text in sorted(corpus().items()):
        ids = ids_of(text, 2)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = lookup(manifest, spark.createDataFrame([(3,), (999,), (None,)], "doc_id long")).collect()
    assert [(r.doc_id, r.ids) for r in found] == [(3, ids_of(corpus()[3], 2).tolist())]
    assert read_shards(write_shards(empty, BPE, 2)).count() == 0
    assert sorted(r.n_tokens for r in read_shards(write_shards(odd, BPE, 2)).collect()) == sorted(len(ids_of(t, 2)) for t in ("a b c", "d e", "f", "f", None))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    index = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.load(PerfectHash.build(keys[:0]).dump()).slots(keys[:3]).tolist() == [-1, -1, -1]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(texts, n, num):
    sets = {k: shingles(t, n) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize("small", [24, 0])
def test_jaccard(docs, empty, odd, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == components(corpus(), 4, 85)
    if small:
        assert jaccard.jaccard_components(empty, 4, 85, 100).count() == 0
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(odd, 4, 85, 100).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1)]


def test_signatures_meet():
    """Sets at the threshold share a signature, whatever their size."""
    rng = np.random.default_rng(7)
    for size in [3, 8, 17, 60, 200, 700]:
        for _ in range(20):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64) * 2
            k = int(size * 0.15 / 1.85 * 2)
            drop = rng.integers(0, k + 1)
            a, b = np.unique(base[drop // 2 :]), np.unique(base[: size - (drop - drop // 2)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert np.intersect1d(jaccard.signatures(a, 85, 100), jaccard.signatures(b, 85, 100)).size
                assert jaccard.sketch_distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(a) + len(b) - 2 * both


@pytest.mark.parametrize("hot", [1_000, 0])
def test_substring_dedup(docs, empty, odd, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicated(docs, 50).collect()}
    first, split = {}, {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in corpus().items()}
    for k in sorted(split):
        for i in range(len(split[k]) - 49):
            first.setdefault(tuple(split[k][i : i + 50]), k)
    for k, w in split.items():
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert got[k] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    if hot:
        assert substring_dedup.deduplicated(empty, 50).count() == 0
        assert substring_dedup.deduplicated(odd, 50).count() == 5
        assert substring_dedup.without_repeats(docs, 50).columns == docs.columns


def test_packing(docs, empty, odd):
    got = pack(pieces(docs, BPE, 256, 0), 256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for k, text in corpus().items():
        ids, at = ids_of(text, 0), 0
        total += len(ids)
        for i, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and len(by_doc[k]) == -(-len(ids) // 256)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_sequence) <= -(-total // 256) + 1
    assert pack(pieces(empty, BPE, 256, 0), 256).count() == 0
    assert pack(pieces(odd, BPE, 256, 0), 256).count() == 5


def test_solve_places_every_piece():
    rng = np.random.default_rng(2)
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(rng.lognormal(5, 1, 20000).astype(int) + 1, 2048), return_counts=True))}
    single = {k: 1 for k in range(1, 2049, 3)}  # no length twice: the program runs there too
    for own in (counts, single, {700: 10, 701: 10}, {}):
        plan, placed = solve(own, 2048), {}
        for config, n in plan.runs:
            assert sum(i * a for i, a in config) <= 2048
            for i, a in config:
                placed[i] = placed.get(i, 0) + a * n
        assert placed == own
        assert plan.bound <= plan.sequences <= 1.01 * plan.bound + 1
        assert not own or plan.by_program >= plan.sequences // 3
    assert solve({1100: 7}, 2048).bound == solve({1100: 7}, 2048).sequences == 7  # the volume alone would say 4
    assert sum(n for _, n in best_fit(np.array([0, 5]), 4)) == 2


def test_token_counts(docs, empty, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in token_counts(docs, PIECES, 40).collect():
        text = corpus()[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(sp.encode(text)), len(sp.encode(text)) > 40)
        if r.over_limit:
            assert len(sp.encode(text[: r.cut_chars])) <= 40 < len(sp.encode(text[: r.cut_chars + 12]))
    assert token_counts(empty, PIECES, 40).count() == 0 and token_counts(odd, PIECES, 40).count() == 5


def test_every_prefix():
    import sentencepiece

    sp, counter, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), PrefixCounter(PIECES), random.Random(6)
    for _ in range(150):
        text = "".join(rng.choice("ab the  in\n▁<s>éß中​\t0.,😀") for _ in range(rng.randint(0, 14)))
        assert counter.count_prefixes(text) == [len(sp.encode(text[:i])) for i in range(len(text) + 1)]


def test_fingerprints(spark, docs, empty, odd):
    rows = sorted(fingerprints(docs).collect(), key=lambda r: r.doc_id)
    texts = [corpus()[k] or "" for k in sorted(corpus())]
    seen = {}
    for r, text, following in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        take = len(text) // 2
        edited = text[: len(text) - take] + following[:take]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
    assert len(set(seen.values())) == len(seen)
    assert fingerprints(empty).count() == 0 and fingerprints(odd).count() == 5
    para = spark.createDataFrame([(1, "p one x\nq two y"), (2, "q two y\np one x"), (3, "p one x"), (4, "q two y")], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprints(para).collect()}
    assert f[1] == f[2]
    made = spark.createDataFrame([(f[3], f[4], f[1])], "a string, b string, c string")
    assert made.select(combined(made.a, made.b), combined(made.c, made.b, -1)).first()[:] == (f[1], f[3])


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.vstack([base, base[:10], base[:15] + 0.05 * rng.standard_normal((15, 16)), base[3] + 0.02 * rng.standard_normal((20, 16))]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 2 if i < 40 else (i - 40) % 2) for i in range(len(x))]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (None, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "z") for r in rows + bad], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in near_duplicates(frame, 0.93).collect()}
    assert len(got) == len(rows) + len(bad)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    for i in range(len(x)):
        assert got[i].n_links == near[i].sum() - 1
        assert got[i].kept == (got[i].component_id == i)
        assert got[i].component_id <= np.flatnonzero(near[i]).min()
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904, None))
    assert near_duplicates(frame.limit(0), 0.93).count() == 0
    shapes = spark.createDataFrame([(1, [], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0, 0.0], 1), (4, [2.0, 4.0], 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(shapes, 0.93).collect()) == [(1, 0, 1), (2, 2, 2), (2, 2, 2), (3, 0, 3), (4, 2, 2)]


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_recall(spark, monkeypatch, block):
    """Links and components of a whole table against brute force."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rng = np.random.default_rng(5)  # near copies at all distances up to beyond the threshold, and a large group of them
    base = np.vstack(table.embedding).astype(float)
    source = np.concatenate([np.repeat(np.arange(300), 3), np.full(150, 7)])
    noise = rng.standard_normal((len(source), base.shape[1]))
    noise *= (np.linalg.norm(base[source], axis=1) * rng.uniform(0.05, 0.42, len(source)))[:, None] / np.linalg.norm(noise, axis=1)[:, None]
    x = np.vstack([base, base[source] + noise])
    table = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": np.concatenate([table.label, table.label.to_numpy()[source]])})
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").repartition(3)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = near_duplicates(frame, 0.93).toPandas().set_index("vec_id").loc[table.vec_id]
    label, ids, component = table.label.to_numpy(), table.vec_id.to_numpy(), got.component_id.to_numpy()
    want = found = 0
    for i in range(len(ids)):
        near = np.flatnonzero((x @ x[i] >= 0.93) & (label == label[i]) & (ids != ids[i]))
        assert got.n_links.iloc[i] <= len(near)
        want, found = want + len(near), found + int(got.n_links.iloc[i])
        assert (component[near] == component[i]).mean() > 0.98 if len(near) else component[i] == ids[i]
    assert want and found / want >= 0.99


def test_mixing(docs, empty, odd):
    tokens = {k: len(re.findall(r"[^ \t\n\x0B\f\r]+", t or "")) for k, t in corpus().items()}
    plan = mixed(docs, Mixture(max_repeats=3.0)).collect()
    assert all(r.n_tokens == tokens[r.doc_id] and 0 <= r.position <= 1 for r in plan)
    totals, used = {}, {}
    for r in plan:
        used.setdefault(r.source, []).append(r.n_tokens)
    for k in corpus():
        s = f"s{k % 3}" if k % 7 else None
        totals[s] = totals.get(s, 0) + tokens[k]
    weight = {r.source: r.weight for r in plan}
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s, w in weight.items():
        budget = w * sum(totals.values())
        assert budget <= 3.0 * totals[s] * (1 + 1e-6)
        assert budget - 1e-6 <= sum(used[s]) <= budget + max(tokens.values())
    # The limit binds, and the smallest source meets it; a target entropy is met too.
    plan = mixed(docs, Mixture(max_repeats=1.05)).select("source", "weight").distinct().collect()
    assert abs(max(r.weight * sum(totals.values()) / totals[r.source] for r in plan) - 1.05) < 1e-6
    p = np.array([totals[s] for s in totals]) / sum(totals.values())
    share = (-(p * np.log(p)).sum() / np.log(len(p)) + 1) / 2
    q = np.array([r.weight for r in mixed(docs, Mixture(entropy=share)).select("source", "weight").distinct().collect()])
    assert abs(-(q * np.log(q)).sum() / np.log(len(q)) - share) < 1e-6
    counted = mixed(docs.withColumn("n", F.length("text")), Mixture(max_repeats=1.05), F.col("n")).collect()
    assert {r.doc_id: r.n_tokens for r in counted}[20] == len(corpus()[20])
    mapped = docs.withColumn("extra", F.create_map(F.lit("a"), F.lit(1))).withColumn("a.b", F.lit(1))
    assert repeated(mapped, Mixture(max_repeats=2.0, tokens=None)).columns == mapped.columns
    assert substring_dedup.without_repeats(mapped, 50).columns == mapped.columns
    every = repeated(docs, Mixture(max_repeats=2.0, tokens=None))
    assert every.columns == docs.columns and every.select("doc_id").distinct().count() == len(corpus())
    assert mixed(empty, Mixture(max_repeats=2.0)).count() == 0
    assert repeated(odd, Mixture(max_repeats=1.0, tokens=None)).count() == 5


def test_main_text(spark):
    page = '<html><body><nav><a href="/">Home page</a></nav><div class="ad">Buy now, really cheap.</div><article><h1>T &amp; U</h1><p>First <b>bo</b>ld\n words.<br>More<p>Second &lt;one&gt;</article><footer>The end of it</footer>'
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (None, "v", "", 1), (1, "u", "x < y & z", 1)], "page_id long, url string, html string, text int")
    got = extracted(rows).collect()
    assert [r.text for r in got] == ["T & U First bold words. More Second <one>", "", "", "x < y & z"]
    assert all(r.n_chars == len(r.text) for r in got) and extracted(rows.limit(0)).count() == 0
    boxed = "<main><p>Some text to be read by people.</p>{}<p>And some more of that text.</p></main>"
    for box in ["<aside><p>No no.</p></aside>", '<div id="comments"><p>No no.</p></div>', "<script>if (a < b) no()</script>", "<form><label>No</label><input></form>", '<div class="cookie-notice">No no.</div>', "<style>p{}</style>", "<!-- no -->", "<nav><ul><li>No</li></ul></nav>"]:
        assert main_text(boxed.format(box)) == "Some text to be read by people. And some more of that text.", box


def kernel_by_definition(x, y):
    """Common subsequences of three characters, gaps included, scaled by length."""
    import itertools

    def weights(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            out.setdefault(w[i] + w[j] + w[k], []).append(0.6 ** (k - i + 1))
        norm = sum(v * v for vs in out.values() for v in vs) ** 0.5
        return {key: sum(vs) / norm for key, vs in out.items()}

    a, b = weights(x), weights(y)
    return sum(v * b.get(key, 0.0) for key, v in a.items())


def test_string_kernel():
    words = ["^idiot", "^idiots", "^idxiot", "^toidi", "^banana", "^ab", "^straße", "^приве", "^другой", "abcabcabcabcab"]
    marks = Landmarks([w for w in words if len(w) >= 3])
    got = marks.kernel(words)
    for i, x in enumerate(words):
        for j, y in enumerate(w for w in words if len(w) >= 3):
            assert abs(got[i, j] - kernel_by_definition(x, y)) < 1e-5, (x, y)
    assert kernel_by_definition("^приве", "^другой") < 0.2  # letters of other alphabets are told apart


def test_toxic_words():
    rng = random.Random(2)
    syllables = ["an", "the", "ing", "re", "on", "tion", "er", "st", "ha", "ea"]
    clean = list(dict.fromkeys("^" + "".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(600)))
    insults = ["^idiot", "^moron", "^scumbag", "^worthless"]
    machine = WordMachine(insults, clean)
    model = machine.fit(dict.fromkeys(insults, 1.0), dict.fromkeys(clean, 1.0))
    assert (model.decisions(insults) > 0).all()
    assert (model.decisions(clean) > 0).mean() < 0.01
    assert model.decisions(["^idxiot", "^moroon"]).min() > np.quantile(model.decisions(clean), 0.99)
    # One clean row with an insult among many toxic ones moves its weight and does not take it away.
    noisy = machine.fit(dict.fromkeys(insults, 20.0), dict.fromkeys([*clean, "^idiot"], 1.0))
    assert noisy.decisions(["^idiot"])[0] > 0


def quality(model, docs, labels):
    held = toxicity(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    return hit / (held.toxic == 1).sum(), hit / max(1, (held.predicted == 1).sum())


def test_toxicity(spark, empty):
    """Held-out recall and precision, also with wrong labels in training (always saying "clean" would have no recall)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = train(docs, labels)
    recall, precision = quality(model, docs, labels)
    assert recall >= 0.9 and precision >= 0.9
    scored = toxicity(docs, model).toPandas()
    assert ((scored.score >= 0.5) == (scored.predicted == 1)).all() and scored.score.between(0, 1).all() and len(scored) == docs.count()
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(20)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    noisy_recall, noisy_precision = quality(train(docs, flipped), docs, labels)
    assert noisy_recall >= recall - 0.05 and noisy_precision >= precision - 0.05
    more = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a" * 3000 + " 中" * 50, 3)], "doc_id long, text string, score int")
    assert toxicity(more, model).count() == 3 and without_toxic(more, model).columns == more.columns
    assert toxicity(empty, model).count() == 0 and without_toxic(empty, model).count() == 0
    odd = [(1, "you idiot, you stupid worthless moron", "fine words"), (2, "The house is here", "idiot moron stupid scum")]
    for columns in ("doc_id long, Text string, words string", "doc_id long, TEXT string, first string"):  # the text column is found as Spark finds it
        assert [r[0] for r in without_toxic(spark.createDataFrame(odd, columns), model).collect()] == [2]
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert toxicity(small, train(small, labels.limit(0))).where("predicted = 1").count() == 0
    assert toxicity(small, train(empty, labels)).where("predicted = 1").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in components(texts, 5, 80).items() if c == k}
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(texts)
    assert out.groupBy("sequence_id").sum("length").toPandas()["sum(length)"].max() <= 2048
