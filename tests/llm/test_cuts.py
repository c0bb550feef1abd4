"""Where the encoder cuts texts: units don't multiply with punctuation, requests stay small, ids are the library's."""

import random

import numpy as np
import public_tokenizers

from thicket.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


def same(coder, texts):
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_punctuation_makes_no_new_units():
    """A known word behind which a sign stands is no entry of its own in the memo."""
    words = ["word" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10] for i in range(60)] + ["été", "naïveté", "Ærø"]
    ends = [".", ",", "!", "?!", ").", "'s", "-", "...", '".', "'re,"]
    coder = bpe.Encoder(FILE)
    same(coder, [" " + " ".join(words)])
    before = len(coder.memo.young)
    same(coder, [" " + " ".join(w + e for w in words) for e in ends])
    assert len(coder.memo.young) <= before + len(ends) + 1


def test_requests_are_bounded():
    """New words of long texts go to the library in calls of a bounded size."""
    chosen, sizes = random.Random(11), []
    coder = bpe.Encoder(FILE)
    ids = coder._ids
    coder._ids = lambda text: sizes.append(len(text)) or ids(text)
    words = ["".join(chosen.choices("abcdefghij", k=9)) for _ in range(120_000)]
    coder.encode_all([" ".join(words)])
    assert max(sizes) < 300_000


def test_any_characters():
    """Signs, contractions, letters and signs beyond ASCII, control characters and special strings in any order, in one part and in many."""
    chosen = random.Random(13)
    parts = ["a", "Ab", "é", "×", "÷", "Ã", "ÿ", "¡", "ß", "Ŀ", "漢", "1", "²", "_", "'", "'s", "'ll", "’s", ".", "-", "(", '"', "<|endoftext|>", "<|", "|>", "endoftext"]
    parts += [" ", " ", " ", "\n", "\n", "  ", "\r", "\t", "\v", "\x00", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\ufeff", "\u0301", "\U0001f600"]
    texts = ["", "\n", " ", "", *("".join(chosen.choices(parts, k=chosen.randint(1, 14))) for _ in range(20_000)), ""]
    same(bpe.Encoder(FILE), texts)
    coder = bpe.Encoder(FILE, room=100_000)
    out = coder.encode_all(texts, some=50)
    assert out == bpe.Encoder(FILE).encode_all(texts)
