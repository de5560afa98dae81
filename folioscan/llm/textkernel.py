"""Vectorised text work over Arrow batches: a batch of texts is one byte buffer, and words, their hashes and
their n-grams are numpy arrays over it, so no Python code runs per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in blocks of about so many bytes (a longer text makes a block of its own).
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**63)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _rng.integers(1, 2**64, 8, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD_BYTE = np.where(IS_SPACE, np.uint64(0), _BYTE[LOWER])
_powers: list[np.ndarray] = []
#: Words of so many bytes are hashed by xxhash: a polynomial modulo 2**64 gives some long words of few letters one hash.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            x = np.ones(size, np.uint64)
            step = 1
            while step < size:
                x[step : 2 * step] = x[:step] * np.uint64(pow(base, step, 2**64))
                step *= 2
            made.append(x)
        _powers[:] = made
    return _powers[0], _powers[1]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over whole texts, about BLOCK bytes each."""
    data, offsets = buffer(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and the text that each word is in."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words that begin at starts, A-Z folded. A polynomial over random values for bytes,
    moved to the word's own origin by the inverse power; white space counts zero. Where ends are given, words of LONG
    bytes and more are hashed one by one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data))
    x = _WORD_BYTE[data]
    x *= up[: len(data)]
    out = mix(np.add.reduceat(x, starts) * down[starts])
    if ends is not None:
        for i in np.flatnonzero(ends - starts >= LONG):
            out[i] = xxhash.xxh3_64_intdigest(LOWER[data[starts[i] : ends[i]]].tobytes())
    return out


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text, ascending within a text, and offsets. A text with
    fewer words has its whole sequence as one; without words, none."""
    per = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(per)])
    made = np.maximum(per - (n - 1), np.minimum(per, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    which = np.repeat(np.arange(n_docs), made)
    start = first[which] + (np.arange(at[-1]) - at[which])
    left = np.minimum(first[which + 1] - start, n).astype(np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h = left * _ORDER[7]
    for k in range(n):
        h += np.where(left > np.uint64(k), padded[start + k], np.uint64(0)) * _ORDER[k] if k else padded[start] * _ORDER[0]
        h = mix(h)
    for i in np.flatnonzero(made > 1):
        h[at[i] : at[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(which[keep], minlength=n_docs))])


def segment_sum(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of x between offsets; empty segments are 0."""
    total = np.zeros(len(offsets) - 1, x.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        total[full] = np.add.reduceat(x, offsets[:-1][full])
    return total


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
