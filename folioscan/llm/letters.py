"""Words as runs of letters of any alphabet, as numpy arrays over code points of lower-cased texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from . import textkernel as K

#: Texts are worked on in blocks of about so many bytes (a longer text makes a block of its own).
BLOCK = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def _values() -> np.ndarray:
    return K.mix(np.arange(1, 0x10001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of some texts: doc, start and length of each, and hashes of them or of parts of them."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        sizes = np.asarray(pc.utf8_length(lower)).astype(np.int64)
        code = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        self.code = code
        self.n_docs, self.offsets = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
        letter = _is_letter()[code]
        edge = np.zeros(len(code) + 1, bool)
        edge[self.offsets] = True
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1] | edge[1:-1]
        last[:-1] &= ~letter[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        up, self._down = K._tables(len(code) + 1)
        value = _values()[code & 0xFFFF]
        if len(code) and code.max() > 0xFFFF:
            value = value + (code >> 16).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        value *= up[: len(code)]
        self._sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(value, out=self._sums[1:])

    def spans(self, start: np.ndarray, length: np.ndarray, tag: np.ndarray | int = 0) -> np.ndarray:
        """Hashes of spans of letters; equal letters and tags give equal hashes."""
        h = (self._sums[start + length] - self._sums[start]) * self._down[start]
        return K.mix(h + (np.atleast_1d(np.asarray(tag, np.uint64)) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))

    def hashes(self) -> np.ndarray:
        """Hashes of whole words; long ones one by one, as in textkernel.word_hashes()."""
        out = self.spans(self.start, self.length)
        for i in np.flatnonzero(self.length >= K.LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.code[self.start[i] : self.start[i] + self.length[i]].tobytes())
        return out

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-letter grams of some words, marked at a word's begin and end, and the place in which."""
        per = np.maximum(self.length[which] - n + 1, 0)
        owner = np.repeat(np.arange(len(which)), per)
        k = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(per)])[:-1], per)
        tag = 8 * n + 2 * (k == 0) + 4 * (k == per[owner] - 1)
        return self.spans(self.start[which][owner] + k, np.full(len(owner), n), tag), owner


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + BLOCK, "right")) - 1)
        yield i, j, Words(texts.slice(i, j - i))
        i = j
