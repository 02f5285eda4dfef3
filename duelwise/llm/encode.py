"""Token ids by the tokenizers library, with repeated pieces of text encoded once.

A text is cut where a non-space meets a space, and where a Latin letter meets one of ASCII's signs (the apostrophe isn't
one of these): no pre-token of either vocabulary spans such a place, so the ids of the pieces, joined, are the ids of the
text. A plain piece (a space perhaps, then Latin letters or signs) goes to the library's BPE model at once; any other
piece goes through the library's whole pipeline, and a text with spaces other than the four plain ones is encoded whole.
Batches are cut by places of bytes, and Arrow finds the different pieces; Python sees only these.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import text_chunks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e"
_PLAIN = re.compile(rf"([ \n]?)([{_LETTERS}]+|[{_SIGNS}]+)")
#: Spaces other than the plain four, and what begins a special token.
_ODD_BYTES = re.compile(rb"[\x0b\x0c\x1c-\x1f<]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MAY, _GAP, _LETTER, _SIGN, _AFTER = (np.zeros(256, bool) for _ in range(5))
_MAY[[0x0B, 0x0C, *range(0x1C, 0x20), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_GAP[list(b" \n\t\r")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: The second byte of a Latin letter beyond ASCII, whose first one is C3.
_AFTER[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def cuts(buf: np.ndarray) -> np.ndarray:
    """Whether a piece begins at a byte, as far as that shows inside a text."""
    gap, sign, letter = _GAP[buf], _SIGN[buf], _LETTER[buf]
    ends = letter.copy()
    ends[1:] |= _AFTER[buf[1:]] & (buf[:-1] == 0xC3)
    cut = np.zeros(len(buf), bool)
    cut[1:] = (gap[1:] & ~gap[:-1]) | (sign[1:] & ends[:-1]) | (letter[1:] & sign[:-1])
    return cut


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class _Known(dict):
    def __init__(self, path: str, keeps_spaces: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_spaces = Tokenizer.from_file(path), keeps_spaces
        self.model, self.table, self.old = self.tokenizer.model, _byte_letters(), {}
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            m = _PLAIN.fullmatch(piece)
            if m is None:
                ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            else:
                space, word = m.groups()
                parts = [word.lower()] if not self.keeps_spaces else [space, word] if space == "\n" else [piece]
                ids = [t.id for p in parts for t in self.model.tokenize(p.translate(self.table))]
            out = np.array(ids, self.kind).tobytes()
        self[piece] = out
        return out

    def age(self, most: int) -> None:
        """Beyond ``most`` pieces, those that were met since the last time stay a while, the others are forgotten."""
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """One array of ids per text. The memory of known pieces has a bound: MOST of now and as many of before."""

    MOST = 400_000

    def __init__(self, path: str, keeps_spaces: bool):
        self.known = _Known(path, keeps_spaces)
        self.kind = self.known.kind

    def ids(self, text: str) -> np.ndarray:
        return next(self.rows(pa.array([text], pa.string())))

    def rows(self, column: pa.Array, limit: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of each text of a column (null: none), worked out for about ``limit`` bytes at a time."""
        for first, after, buf, off in text_chunks(column, limit):
            self.known.age(self.MOST)
            # Few bytes can begin an odd character; only texts that have one of them are searched.
            may = np.unique(np.searchsorted(off, np.flatnonzero(_MAY[buf]), "right") - 1)
            odd = {k for k in may.tolist() if _ODD_BYTES.search(buf[off[k] : off[k + 1]].tobytes())}
            ids, ends = self._pieces(buf, off)
            for k in range(after - first):
                if k in odd:
                    yield np.array(self.known.tokenizer.encode(column[first + k].as_py(), add_special_tokens=False).ids, self.kind)
                else:
                    yield ids[ends[k] : ends[k + 1]]

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): of all texts in a row, and where each text's begin and end."""
        cut = cuts(buf)
        cut[off[:-1][off[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut)
        places = pa.py_buffer(np.append(starts, len(buf)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(starts), places, pa.py_buffer(buf)).dictionary_encode()
        different, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.known.__getitem__, different if self.known.keeps_spaces else map(str.strip, different)))
        width = np.dtype(self.kind).itemsize
        pool, sizes = np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // width
        size = sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        shift = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
        return pool[np.arange(ends[-1]) + np.repeat(shift, size)], ends[np.searchsorted(starts, off)]


@lru_cache(maxsize=2)
def encoder(path: str, keeps_spaces: bool) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, keeps_spaces)
