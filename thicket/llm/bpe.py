"""Byte-level BPE ids of whole texts through the tokenizers library, memoised by unit.

The pre-tokenizer of these vocabularies always starts a new piece at a space that
follows a non-space character, or that is the last of a run of white space, makes
a line feed between two such characters a piece of its own, and starts a new piece at
punctuation behind a letter. So a text's units, cut before each such space, line feed and
sign, encode independently, unless a unit is empty, or starts or ends with white space (runs
of white space are one piece). Texts with such units, or with special strings, are encoded
by the library in one piece. A first unit is treated as if it followed a line feed.

Texts are cut as bytes, many at a time, by Arrow arrays: the units are slices of them, each
distinct one is looked up once, and the ids are taken from these.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from thicket.llm.common import KEPT, LONG, Memo, claim

ROOM = 256 << 20
SOME = 8 << 20  # characters that are cut at a time
SLICE = 800  # texts that callers hand over at a time
ASKED = 256 << 10  # characters of units in a call of the library, whose results take many times that


def _bytes(chars: str) -> np.ndarray:
    """Which bytes are one of these ASCII characters."""
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


WHITE, LETTERS, SIGNS = _bytes("\t\n\v\f\r\x1c\x1d\x1e\x1f "), _bytes(string.ascii_letters), _bytes(string.punctuation)


def _letters_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter of ASCII or Latin-1 (U+00C0 to U+00FF but the signs of multiplication and division) stands before each place."""
    last = raw[at - 1]
    return LETTERS[last] | ((raw[at - 2] == 0xC3) & (last != 0x97) & (last != 0xB7))


def _groups(texts: list[str], some: int) -> Iterator[list[str]]:
    """Consecutive texts, of little more than ``some`` characters unless one is longer."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text) + 1
        if size >= some:
            yield part
            part, size = [], 0
    if part:
        yield part


class Encoder:
    """``encode_all(texts)``: the ids of each as little-endian unsigned 32-bit integers, equal to the library's of the whole text."""

    def __init__(self, tokenizer_file: str, room: int = ROOM):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.starts = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        for token, i in self.library.get_vocab().items():
            self.starts[i] = token.startswith("\u0120")  # how byte-level vocabularies write a space
        self.line = self._whole("\n")
        # Units with the space, line feed or sign that they begin with (null: they don't stand alone).
        self.memo = Memo(room)

    def _ids(self, text: str) -> np.ndarray:
        # Of one text; this form leaves out places in the text, which nothing here needs.
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _cut(self, units: list[str], starts: np.ndarray) -> list[bytes]:
        """The ids of units that the library reads in one piece: of each, the first id alone is in ``starts``."""
        out = []
        for part in _groups(units, ASKED):
            ids = self._ids("".join(part))
            cuts = np.flatnonzero(starts[ids])
            if len(cuts) != len(part):
                raise ValueError("the vocabulary joins words across a space or a line feed")
            cuts, raw = (4 * cuts).tolist(), ids.tobytes()
            out += [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def _each(self, units: list[str]) -> list[bytes]:
        """The ids of units that the library reads one by one."""
        return [np.array(x.ids, "<u4").tobytes() for part in _groups(units, ASKED) for x in self.library.encode_batch_fast(part, add_special_tokens=False)]

    def _learn(self, units: set[bytes]) -> list[bytes]:
        """Puts the ids of units into the memo, by few calls of the library; returns the long units.

        Units behind a space are sent as one line, and those behind a line feed as lines. Only the first id of each then starts with
        a space, or is a line feed, which is where the ids are cut again. Units that don't stand alone get no ids (null).
        """
        known: dict[bytes, bytes | None] = dict.fromkeys(units)
        spaced, lines, others = ([], []), ([], []), ([], [])  # units, their texts
        for u in units:
            text = u.decode()
            word = text[1:] if text[0] in " \n" else text
            if word and word.strip() == word:
                kind = spaced if text[0] == " " else lines if text[0] == "\n" and "\n" not in word else others
                kind[0].append(u)
                kind[1].append(text)
        feeds = np.arange(len(self.starts)) == np.frombuffer(self.line, "<u4")[0]
        known.update(zip(spaced[0], self._cut(spaced[1], self.starts), strict=True))
        known.update(zip(lines[0], self._cut(lines[1], feeds), strict=True))
        known.update(zip(others[0], self._each(others[1]), strict=True))
        if b"\n" in known:
            known[b"\n"] = self.line  # before an empty text, or one that begins with a space
        self.memo.put(known, 2 * (sum(map(len, units)) + sum(len(v) for v in known.values() if v)))
        return [u for u in units if len(u) > LONG]

    def encode_all(self, texts: list[str], some: int = SOME) -> list[bytes]:
        return [ids for part in _groups(texts, some) for ids in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        apart = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        coded = [b"" if i in apart else t.encode() for i, t in enumerate(texts)]
        # Each text stands behind a line feed.
        begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
        raw = np.frombuffer(b"\n".join([b"", *coded, b""]), np.uint8)
        del coded
        cut = raw == ord(" ")
        lines = np.flatnonzero(raw == ord("\n"))[1:-1]
        cut[lines[~WHITE[raw[lines - 1]] & ~WHITE[raw[lines + 1]]]] = True
        signs = np.flatnonzero(SIGNS[raw])
        cut[signs[_letters_before(raw, signs)]] = True
        cut[begin] = True
        at = np.flatnonzero(cut)
        del cut, lines, signs
        units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        distinct, indices = units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices
        first = np.searchsorted(at, begin)
        del units, at, raw
        new = self.memo.missing(set(distinct))
        long = self._learn(new) if new else ()
        del new
        ids = pa.array(list(map(self.memo.young.__getitem__, distinct)), pa.large_binary())
        self.memo.forget(long)
        taken = ids.take(indices)
        if taken.null_count:
            apart.update((np.searchsorted(first, np.flatnonzero(taken.is_null().to_numpy(zero_copy_only=False)), side="right") - 1).tolist())
        _, ends, body = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[first].tolist()
        body = memoryview(body or b"")
        return [self._whole(t) if k in apart else bytes(body[i + 4 : j]) for k, (t, i, j) in enumerate(zip(texts, ends, ends[1:], strict=False))]


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str, room: int) -> Encoder:
    return Encoder(tokenizer_file, room)


KEPT["bpe"] = _encoder.cache_clear


def encoder(tokenizer_file: str, room: int = ROOM) -> Encoder:
    """The worker's encoder, with what it learned in earlier tasks (in at most some ``room`` bytes)."""
    claim("bpe")
    return _encoder(tokenizer_file, room)
