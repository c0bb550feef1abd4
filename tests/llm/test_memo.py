"""Memos that are full in the middle of a batch."""

import random

import numpy as np
import public_tokenizers

from thicket.llm.bpe import Encoder


def test_encoder_with_a_full_memo():
    """A batch's units stay readable while its new ones are learned, whatever the memo has to let go."""
    chosen = random.Random(5)
    words = [w + e for w in ("".join(chosen.choices("abcdefghij", k=chosen.randint(2, 6))) for _ in range(3000)) for e in ("", ".")]
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), room=400_000)
    turned, old = 0, coder.memo.old
    for _ in range(200):
        texts = [" ".join(chosen.choices(words[: chosen.randint(100, len(words))], k=chosen.randint(1, 200))) for _ in range(4)]
        for text, ids in zip(texts, coder.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids
        turned, old = turned + (coder.memo.old is not old), coder.memo.old
    assert turned > 5
