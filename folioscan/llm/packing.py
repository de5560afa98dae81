"""Packing of token sequences by minimum bin slack.

Every task tokenizes its own documents and packs them, without a shuffle: a document gives full windows of 1024
ids, and a remainder. The remainders of up to POOL documents form a multiset of lengths; for each window a
bitset dynamic programme over that multiset finds the reachable sum closest to the capacity (its largest length
is always taken, so that long ones don't linger), and backtracking gives how many of each length make it up.
Windows that stay below the capacity are topped up with cut pieces of the emptiest ones; the last one of a pool is
cut at powers of two, which need no padding.

Defined results: null and empty texts are one id (the end); every row is a document, repeated or not; an empty
table gives no piece; other columns are ignored. Very long texts are tokenized whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tuned

CAPACITY = 1024
#: Remainders that are packed together.
POOL = 20_000
#: White-space characters in a row that the fast library is not given.
LONG_RUN = 100_000
#: Sequences that a task can number.
TASK_SPAN = 1 << 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


@cache
def _whole(json_path: str):
    """The tokenizer itself, which only rare texts need and whose tables are large."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@cache
def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> ids as the JSON tokenizer gives them. Its byte-level BPE is run from the ranks of the same vocabulary,
    which is some four times faster; texts that hold one of its special tokens or LONG_RUN white-space characters in a
    row, and any other on which the fast library's regular expressions run out of stack, go to the tokenizer itself."""
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    long_run = re.compile(rf"\s{{{LONG_RUN}}}")

    def slow(text: str) -> list[int]:
        return _whole(json_path).encode(text, add_special_tokens=False).ids

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow(text)
        if len(text) < LONG_RUN:
            return fast.encode_ordinary(text)
        if long_run.search(text):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # a panic of the library is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return ids


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of a multiset of lengths (length -> count), the part whose sum is closest to room from below, as length -> count.
    Bit s of a bitset is set when s can be reached; a count is added in binary portions, and every portion's bitset is
    kept for the way back. Stops early once room itself is reached."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, portion = min(counts[length], room // length), 1
        while left:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, portion = left - take, portion * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def minimum_bin_slack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of indices into lengths (each at most capacity), filled one after the other with as little slack as the
    remaining multiset allows. The same filling is used as often as its counts last."""
    stock: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        stock.setdefault(x, []).append(i)
    counts, windows = {x: len(v) for x, v in stock.items()}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        used = best_fill(counts, capacity - largest)
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        for _ in range(min(counts[x] // n for x, n in used.items())):
            windows.append([stock[x].pop() for x, n in used.items() for _ in range(n)])
        for x, n in used.items():
            counts[x] = len(stock[x])
            if not counts[x]:
                del counts[x]
    return windows


def binary_parts(total: int) -> list[int]:
    """total as a sum of falling powers of two."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def topped_up(windows: list[list[tuple]]) -> list[list[tuple]]:
    """Windows of (document, start, ids, tokens), all filled to CAPACITY but one: the emptiest are poured, cut to size,
    into the slack of the others."""
    total = [sum(len(p[2]) for p in w) for w in windows]
    done = [w for w, t in zip(windows, total) if t == CAPACITY]
    slack = sorted(((t, i) for i, t in enumerate(total) if t < CAPACITY), reverse=True)
    rest = [windows[i] for _, i in slack]
    while len(rest) > 1:
        into, room = rest[0], CAPACITY - sum(len(p[2]) for p in rest[0])
        while room and len(rest) > 1:
            doc, start, ids, n = rest[-1].pop()
            into.append((doc, start, ids[:room], n))
            if len(ids) > room:
                rest[-1].append((doc, start + room, ids[room:], n))
            elif not rest[-1]:
                rest.pop()
            room -= min(room, len(ids))
        if not room:
            done.append(rest.pop(0))
    return done + rest


class _Packer:
    """One task's packing: full windows leave at once, remainders wait for their pool."""

    def __init__(self, first: int):
        self.next, self.waiting, self.rows = first, [], []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n - CAPACITY + 1, CAPACITY):
            self.rows.append((doc, start, CAPACITY, zlib.crc32(ids[start : start + CAPACITY]), n, self.next, 0))
            self.next += 1
        if n % CAPACITY:
            self.waiting.append((doc, n - n % CAPACITY, ids[n - n % CAPACITY :].copy(), n))
            if len(self.waiting) >= POOL:
                self.flush()

    def flush(self) -> None:
        windows = [[self.waiting[i] for i in w] for w in minimum_bin_slack([len(w[2]) for w in self.waiting])]
        for pieces in topped_up(windows):
            parts = binary_parts(sum(len(p[2]) for p in pieces))
            room, at = parts.pop(0), 0
            for doc, start, ids, n in pieces:
                while len(ids):
                    cut = ids[: room - at]
                    self.rows.append((doc, start, len(cut), zlib.crc32(cut), n, self.next, at))
                    start, ids, at = start + len(cut), ids[len(cut) :], at + len(cut)
                    if at == room:
                        room, at, self.next = parts.pop(0) if parts else 0, 0, self.next + 1
        self.waiting = []

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def packer(json_path: str, ranks_path: str, pattern: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packed = encoder(json_path, ranks_path, pattern), _Packer(TaskContext.get().partitionId() * TASK_SPAN)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed.add(doc, np.array([*encode(text.as_py() or ""), 0], "<u4"))
            yield packed.take()
        packed.flush()
        yield packed.take()

    return pack


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tuned(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(packer(json_path, ranks_path, pattern), SCHEMA)
