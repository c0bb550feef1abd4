"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel compares words by their common subsequences of three characters, gaps included: a subsequence
that spans n characters weighs ``DECAY**n``, so gaps and inserted characters cost a little instead of
breaking the match. Words are folded to lower case, with a mark at their start, and scaled by their length.

The machine is trained on labelled rows, each a bag of its words' Nyström features with the row's label. First every word
counts as toxic as often as toxic rows have it and as clean as often as clean rows do. Then, round by round, a toxic row
counts by the word that the machine finds most toxic in it, a clean row by its most toxic words (multiple-instance
learning with the largest decision as the pool). The loss of a toxic row is capped (a ramp): one in which no word comes near
the margin is left aside in that round. And a word counts by the share of its rows that have the label in question, as rows
with the other label have it by the same right. So a row with a wrong label moves weights a little and rules nothing out. The
decision is a sum over landmarks of kernel values, hence a sum over a word's subsequences of one number each, which is how
it is evaluated. A row's score is a logistic function of its highest decision, the sum of its positive ones and its number
of words, fitted on the labelled rows with a share of wrong labels as one more unknown.

Fitting is done on a bounded sample of the labelled rows (``rows``, a parameter), and the driver receives a
bounded number of words. Scoring reads whole texts.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import LONG, Memo, claim, discard, map_rows, place, stored, tidy

DECAY = 0.6
COST = 30.0
EVIDENCE = 8.0  # log-likelihood beyond which a word's share of toxic rows is no chance
LONGEST = 14  # letters of a piece; longer words are cut into overlapping pieces
BITS = 6  # of a character
CODES = 1 << 3 * BITS
MARK = 27
SCORED = "doc_id long, held_out boolean, score double, predicted int"
DECIDED = "doc_id long, first double, positive double, words long"
RAMPS = (-1.0, -0.5, -0.5)  # by round: least decision of a toxic row's best word, for the row to count
_SPACED = re.compile(r"(?<!\S)\w(?:[^\w\n]+\w){2,}(?!\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_CHUNK = 1 << 19  # subsequences that are worked on at a time


def fold(word: str) -> str:
    """Lower case, compatibility forms folded; accents stay, as they tell words of some languages apart."""
    return word.lower() if word.isascii() else unicodedata.normalize("NFKC", word.casefold())


def pieces(token: str) -> list[str]:
    """What a token is scored by: its runs of letters, and all its letters together; long ones in overlapping parts."""
    runs = _LETTERS.findall(fold(token))
    if len(runs) > 1:
        runs.append("".join(runs))
    out = []
    for r in runs:
        out.append("^" + r[:LONGEST])
        if len(r) > LONGEST:
            out += [r[k : k + LONGEST] for k in range(LONGEST // 2, len(r) - LONGEST // 2, LONGEST // 2)]
    return out


def _alphabet() -> np.ndarray:
    """Codes of all characters: a to z, the mark, and 36 for others, by which the letters of one other alphabet differ."""
    points = np.arange(0x110000, dtype=np.int64)
    codes = MARK + 1 + points % ((1 << BITS) - MARK - 1)
    codes[97:123] = np.arange(1, 27)
    codes[94] = MARK
    return codes.astype(np.uint8)


_CODE_OF = _alphabet()
_TRIPLES: dict[int, tuple[np.ndarray, ...]] = {}


def _triples(size: int) -> tuple[np.ndarray, ...]:
    """Places of all subsequences of a word of a length, and their weights, whose squares sum to 1."""
    if size not in _TRIPLES:
        i, j, k = (x.astype(np.int64) for x in np.nonzero(np.fromfunction(lambda a, b, c: (a < b) & (b < c), (size, size, size))))
        weight = DECAY ** (k - i + 1.0)
        _TRIPLES[size] = i, j, k, weight / np.sqrt((weight * weight).sum())
    return _TRIPLES[size]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The feature map of the kernel in chunks of words of one length: their places in ``words``, the code of every
    subsequence (a row a word; equal ones add up) and the weights. Words of fewer than three characters have none."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes[sizes >= 3]).tolist():
        i, j, k, weight = _triples(size)
        everyone = np.flatnonzero(sizes == size)
        step = max(1, _CHUNK // len(weight))
        for n in range(0, len(everyone), step):
            at = everyone[n : n + step]
            points = np.frombuffer("".join([words[x] for x in at.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), size)
            c = _CODE_OF[points].astype(np.int32)
            yield at, (c[:, i] << 2 * BITS) | (c[:, j] << BITS) | c[:, k], weight


class Landmarks:
    """Kernel values with some words, whose subsequences are the only ones that matter."""

    def __init__(self, words: list[str]):
        found = []
        for at, code, weight in subsequences(words):
            found.append((np.repeat(at, code.shape[1]), code.ravel(), np.tile(weight, len(at))))
        row, code, value = (np.concatenate(c) for c in zip(*found, strict=True))
        self.codes, column = np.unique(code, return_inverse=True)
        self.features = np.zeros((len(self.codes), len(words)), np.float32)
        np.add.at(self.features, (column, row), value.astype(np.float32))
        self.column = np.full(CODES, -1, np.int32)
        self.column[self.codes] = np.arange(len(self.codes))

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.features.shape[1]), np.float32)
        for at, code, weight in subsequences(words):
            column = self.column[code]
            for k in range(0, len(at), 256):
                own, where = np.nonzero(column[k : k + 256] >= 0)
                for n in range(0, len(own), 20_000):  # some 30 MB at a time
                    rows, t = own[n : n + 20_000], where[n : n + 20_000]
                    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                    part = self.features[column[k + rows, t]] * weight[t].astype(np.float32)[:, None]
                    out[at[k + rows[first]]] += np.add.reduceat(part, first, axis=0)
        return out

    def spread(self, alpha: np.ndarray) -> np.ndarray:
        """Weights of landmarks as weights of subsequences."""
        table = np.zeros(CODES, np.float32)
        table[self.codes] = self.features @ alpha
        return table


@dataclass
class Model:
    """``table``: the decision's part of each subsequence. ``logistic``: of a row's pooled decisions (see ``pool``)."""

    table: np.ndarray
    bias: float
    logistic: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)

    def decisions(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for at, code, weight in subsequences(words):
            out[at] += self.table[code] @ weight
        return out

    def pool(self, decisions: list[float]) -> tuple[float, float, int]:
        """Of a row's words: the highest decision (without words: the bias), the sum of the positive ones, and how many there are."""
        v = np.array(decisions)
        v = v[v > -np.inf]
        return (float(v.max()), float(v[v > 0].sum()), len(v)) if len(v) else (self.bias, 0.0, 0)

    def score(self, first: np.ndarray, positive: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c, d = self.logistic
        return 1 / (1 + np.exp(-np.clip(a + b * first + c * np.log1p(positive) + d * np.log1p(words), -50, 50)))


def fit_svm(features: np.ndarray, at: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps on the rows ``at`` of the features; the last weight is the bias."""
    w = np.zeros(features.shape[1] + 1)
    for _ in range(rounds):
        margin = 1 - y * ((features @ w[:-1].astype(np.float32))[at].astype(float) + w[-1])
        active = np.flatnonzero(margin > 0)
        gradient, hessian = 1e-2 * w, 1e-2 * np.eye(len(w))
        for k in range(0, len(active), 2000):
            own = active[k : k + 2000]
            part, c = np.hstack([features[at[own]].astype(float), np.ones((len(own), 1))]), cost[own]
            gradient -= part.T @ (c * y[own] * margin[own])
            hessian += (part * c[:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class WordMachine:
    """Nyström features on landmarks, and machines on them."""

    def __init__(self, toxic: list[str], clean: list[str], landmarks: int = 384):
        """Landmarks are the farthest points of ``toxic`` (candidates, the best first), and some of ``clean``."""
        chosen = self._farthest(toxic[:800], landmarks * 3 // 4)
        self.marks = Landmarks([*chosen, *clean[: landmarks - len(chosen)]])
        gram = self.marks.features.T.astype(float) @ self.marks.features
        values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        self.known: dict[str, int] = {}
        self.features = np.zeros((0, len(gram)), np.float32)

    @staticmethod
    def _farthest(words: list[str], n: int) -> list[str]:
        def near(word: str) -> np.ndarray:
            """The kernel of a word with all of them."""
            table = np.zeros(CODES)
            for _, code, weight in subsequences([word]):
                np.add.at(table, code[0], weight)
            return Model(table, 0.0).decisions(words)

        chosen = [0]
        closest = near(words[0])
        while len(chosen) < min(n, len(words)):
            chosen.append(int(np.argmin(closest)))
            closest = np.maximum(closest, near(words[chosen[-1]]))
        return [words[i] for i in chosen]

    def places_of(self, words: list[str]) -> np.ndarray:
        """Rows of the words in ``features``, which new words join."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            root = self.root.astype(np.float32)
            self.features = np.vstack([self.features, *(self.marks.kernel(new[k : k + 4000]) @ root for k in range(0, len(new), 4000))])
        return np.array([self.known[w] for w in words])

    def fit(self, toxic: dict[str, float], clean: dict[str, float], even: bool = True) -> Model:
        """A machine for words that stand for so many toxic and so many clean rows; both sides weigh the same if ``even``."""
        words = [*toxic, *clean]
        weight = np.array([*toxic.values(), *clean.values()], float)
        y = np.repeat([1.0, -1.0], [len(toxic), len(clean)])
        for side in (y > 0, y < 0) if even else (y != 0,):
            weight[side] *= COST / max(weight[side].sum(), 1e-9)
        at = self.places_of(words)
        w = fit_svm(self.features, at, y, weight)
        return Model(self.marks.spread((self.root @ w[:-1]).astype(np.float32)), float(w[-1]))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, ...]:
    """Logistic regression on labels of which a share is wrong (as many of each kind): expectation and maximisation in turn."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, wrong, target = np.zeros(x.shape[1]), 0.0, y.astype(float)
    for _ in range(rounds):
        before = w.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
            step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-2 * w)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        wrong = min(max(wrong, 0.02), 0.2)
        toxic, clean = p * np.where(y == 1, 1 - wrong, wrong), (1 - p) * np.where(y == 1, wrong, 1 - wrong)
        target = toxic / (toxic + clean)
        wrong = float(np.abs(target - y).mean())
        if np.abs(w - before).max() < 1e-3:
            break
    return tuple(float(v) for v in w)


class _Scorer:
    def __init__(self, model: Model):
        claim("toxicity")
        self.model, self.memo = model, Memo(64 << 20)

    def learn(self, tokens: list[str]) -> None:
        parts, owner = [], []
        for i, t in enumerate(tokens):
            own = pieces(t)
            parts += own
            owner += [i] * len(own)
        best = np.full(len(tokens), -np.inf)
        np.maximum.at(best, np.array(owner, np.int64), self.model.decisions(parts))
        self.memo.put(dict(zip(tokens, best.tolist(), strict=True)), sum(map(len, tokens)))

    def bags(self, texts: list[str], some: int = 400) -> Iterator[tuple[list[str], list[float]]]:
        """The distinct words of each text, and their decisions (of those without letters: -inf)."""
        for k in range(0, len(texts), some):
            split = []
            for text in texts[k : k + some]:
                tokens = set(text.split())
                tokens.update("".join(_LETTERS.findall(s)) for s in _SPACED.findall(text))
                split.append(tokens)
            new = list(self.memo.missing(set().union(*split)))
            if new:
                self.learn(new)
            get = self.memo.young.__getitem__
            for tokens in split:
                own = list(tokens)
                yield own, list(map(get, own))
            self.memo.forget(t for t in new if len(t) > LONG)

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """``Model.pool`` of each text's distinct words."""
        found = [self.model.pool(v) for _, v in self.bags(texts)]
        return tuple(np.array(c, t) for c, t in zip(zip(*found, strict=True), (float, float, np.int64), strict=True)) if found else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64))


def _decisions(texts: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 400):
                pooled = scorer.pooled([t or "" for t in batch.column(1).slice(k, 400).to_pylist()])
                yield pa.record_batch([batch.column(0).slice(k, 400).cast(pa.int64()), *map(pa.array, pooled)], names=["doc_id", "first", "positive", "words"])

    return texts.select("doc_id", "text").mapInArrow(run, DECIDED)


def held_out():
    """Rows that are never learned from: crc32 of the doc_id as text divisible by 5 (and rows without one)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _word_counts(rows: DataFrame) -> DataFrame:
    """``word``, and of the rows (``text``, ``toxic``) those toxic (``p``) and clean (``n``) that have it; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update({p for t in set(text.split()) for p in pieces(t) if len(p) > 3})
            words = list(found[0] | found[1])
            yield pa.record_batch([pa.array(words, pa.string()), *(pa.array([found[y][w] for w in words], pa.int64()) for y in (1, 0))], names=["word", "p", "n"])

    counted = rows.select("text", "toxic").mapInArrow(run, "word string, p long, n long")
    return stored(counted.groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "word-counts")


def _witnesses(rows: DataFrame, model: Model, each: int = 3) -> pa.Table:
    """Of the labelled rows (``toxic``): the ``each`` highest words (``w``) with their decisions (``v``), and the pooled decisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            tops, names, pools = [], [], []
            for words, decided in scorer.bags(batch.column(0).to_pylist()):
                best = heapq.nlargest(each, ((v, w[:LONG]) for v, w in zip(decided, words, strict=True) if v > -np.inf))
                tops.append([v for v, _ in best])
                names.append([w for _, w in best])
                pools.append(model.pool(decided))
            pooled = [pa.array(c, t) for c, t in zip(zip(*pools, strict=True), (pa.float64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.record_batch([batch.column(1), pa.array(tops, pa.list_(pa.float64())), pa.array(names, pa.list_(pa.string())), *pooled], names=["toxic", "v", "w", "first", "positive", "words"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, v array<double>, w array<string>, first double, positive double, words long").toArrow()


def _worst_piece(model: Model, token: str) -> str:
    own = [p for p in pieces(token) if len(p) >= 3]
    return own[int(np.argmax(model.decisions(own)))] if own else ""


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, toxic_words: int = 3_000, other_words: int = 12_000) -> Model:
    """Fits on at most ``rows`` labelled rows, chosen by a hash of doc_id (a third of them toxic, if there are as many).

    ``toxic_words`` and ``other_words`` bound how many different words the first machine learns from. Rows with one text are one.
    A null label or doc_id counts for nothing, a null text is empty. Where one class has no row, nothing is predicted toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(rows // 3).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(rows - rows // 3))
    # At most ``rows`` rows of 12 bytes are broadcast.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.round(F.avg("toxic")).cast("int").alias("toxic"))
    sample = stored(sample.repartition(32, "h"), "labelled-rows")
    counts = _word_counts(sample)
    try:
        return _fitted(sample, counts, toxic_words, other_words)
    finally:
        discard(sample, counts)


def _fitted(sample: DataFrame, counts: DataFrame, toxic_words: int, other_words: int) -> Model:
    """Fits on stored rows (``text``, ``toxic``), whose words ``counts`` has (see ``_word_counts``)."""
    clean_rows, toxic_rows = sample.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    if not clean_rows or not toxic_rows:
        return Model(np.zeros(CODES, np.float32), -1.0, (-5.0, 0.0, 0.0, 0.0))
    share = toxic_rows / (clean_rows + toxic_rows)
    evidence = F.col("p") * F.log((F.col("p") + share) / (F.col("p") + F.col("n") + 1) / share)
    toxic = counts.where("p >= 2 and p > n").select("*", evidence.alias("evidence")).orderBy(F.desc("evidence"), "word").limit(toxic_words).collect()
    usual = counts.orderBy(F.desc("n"), "word").limit(other_words // 4).collect()
    others = counts.orderBy(F.xxhash64("word"), "word").limit(other_words).collect()
    candidates = [r["word"] for i, r in enumerate(toxic) if r["evidence"] >= EVIDENCE or i < 50] or [r["word"] for r in sorted(others, key=lambda r: -r["p"])[:100]]
    if not candidates:
        return Model(np.zeros(CODES, np.float32), -1.0, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    machine = WordMachine(candidates, [r["word"] for r in others if r["p"] <= r["n"]])
    # Frequent words count less, in proportion.
    first = {r["word"]: (r["p"], r["n"], min(1.0, 20 / max(r["p"], r["n"], 1))) for r in (*toxic, *usual, *others)}
    clean = {w: n * scale for w, (_, n, scale) in first.items() if n}
    model = machine.fit({w: p * scale for w, (p, _, scale) in first.items() if p}, clean, even=False)
    shares: dict[str, float] = {}
    for k, ramp in enumerate(RAMPS):
        found, seen = [], _witnesses(sample, model)
        for y, decided, words in zip(*(seen.column(c).to_pylist() for c in ("toxic", "v", "w")), strict=True):
            for v, w in list(zip(decided, words, strict=True))[: 1 if y else 3]:
                if v > (ramp if y else -1.0) and (w := _worst_piece(model, w)):
                    found.append((bool(y), w))
        if not any(toxic for toxic, _ in found):
            break
        new = sample.sparkSession.createDataFrame([(w,) for w in {w for _, w in found if w not in shares}], "word string")
        shares |= {r["word"]: r["p"] / (r["p"] + r["n"]) for r in counts.join(F.broadcast(new), "word").collect()}  # 3 words a row at most
        positive, negative = Counter(), Counter()
        for toxic, w in found:
            (positive if toxic else negative)[w] += shares.get(w, share) if toxic else 1 - shares.get(w, share)
        if k == 0:  # landmarks among the clean words that are most like toxic ones
            machine = WordMachine(candidates, [w for w, _ in negative.most_common()] + [r["word"] for r in others if r["p"] <= r["n"]])
        model = machine.fit(positive, {w: clean.get(w, 0) + negative[w] for w in {**clean, **negative}})
    seen = _witnesses(sample, model)
    first, positive, words, toxic = (seen.column(c).to_numpy().astype(float) for c in ("first", "positive", "words", "toxic"))
    model.logistic = fit_logistic(np.column_stack([first, np.log1p(positive), np.log1p(words)]), toxic)
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1: score at least 0.5) of whole texts.

    One row per row of ``docs``. Null and empty texts, and texts without letters, get the score of a text whose words
    all have the machine's bias. Only ``text`` decides a score. Rows without ``doc_id`` count as held out.
    """

    decided = _decisions(docs, model)
    a, b, c, d = model.logistic
    x = F.lit(a) + F.lit(b) * F.col("first") + F.lit(c) * F.log1p("positive") + F.lit(d) * F.log1p("words")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))
    return decided.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the same columns, without the rows predicted toxic. The text column is the one that Spark finds as ``text``."""
    at = place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            keep = model.score(*scorer.pooled([t or "" for t in batch.column(at).to_pylist()])) < 0.5
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, tidy(run))
