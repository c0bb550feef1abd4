"""The encoder's units: what the library is asked for, and texts with every kind of white space."""

import random

import numpy as np
import public_tokenizers

from thicket.llm.bpe import Encoder

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_lines_and_punctuation_are_not_new_units():
    """Known words in new lines, or with punctuation behind them, cost no call of the library for each pair."""
    chosen = random.Random(3)
    words = ["".join(chosen.choices("abcdefghij", k=5)) for _ in range(60)]
    coder, asked = Encoder(FILE), []
    coder.encode_all([" ".join(words) + "".join("\n" + w for w in words)])
    ids, coder._ids = coder._ids, lambda text: asked.append(text) or coder.library_ids(text)
    coder.library_ids = ids
    texts = [" ".join(a + chosen.choice(["\n", ".\n", "&&&\n", "?! ", ",## "]) + b for b in words) for a in words]
    for text, got in zip(texts, coder.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, asked)) < 100  # the ends alone; each pair asked for: some 30,000 characters


def test_any_white_space():
    chosen = random.Random(7)
    parts = ["a", "Ab", "été", "12", "'s", ".", "##", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\r\n", "\t", " ", " ", "\x1c", "漢", "x" * 200]
    texts = ["", " ", "\n", " a", "\na", "a\n", "a\n\nb\nc\n\nd e", "a\n b", *("".join(chosen.choices(parts, k=chosen.randint(1, 12))) for _ in range(6000))]
    texts += ["\n".join(chosen.choices(parts[:8], k=chosen.randint(1, 9))) for _ in range(1000)]
    coder = Encoder(FILE)
    for text, got in zip(texts, coder.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids, repr(text)
