"""N-gram Jaccard join with signature trees.

A document is the set of its distinct n-word shingles (64-bit hashes). Two documents link when 100 * intersection
>= percent * union. Equal sets are one class, so copies cost no comparison. Steps:

1. One pass describes every document (set size, class) and counts shingles in a sketch of fixed size.
2. Shingles are ordered: those of one class only, then by how common the sketch finds them, then by hash. Two sets
   above the threshold share one of the first n - ceil(n * percent / 100) + 1 of either. Which shingles have one
   class only is found by sending sorted, coded shingles to owners of hash ranges; common ones, by the sketch, don't
   pass through owners, so no owner gets a hot one. A message names its chunk and the places of classes in it; what
   classes these are travels once a chunk, so messages do not grow with the number of owners. Shared shingles meet
   their class again by chunk and place, and those behind the prefix are dropped there.
3. Shingles that are left are dealt by ranges of (shingle, size, class), so a common one is spread; classes that are
   neighbours there with admissible sizes are chained, and the chains' components are groups that no link leaves.
4. Each group is a task with its sets: a signature tree, whose nodes hold OR-combined bitmaps, size ranges and
   collision counts, is traversed against itself. A pair of nodes is dropped when the largest overlap that its
   bitmaps allow is below the least that its sizes need, or when it lies in one component already; pairs of
   documents that remain are compared exactly.
5. Chains say nothing of similarity, so on a large corpus they may fuse. In groups beyond GROUP_ROWS or GROUP_SHINGLES
   the chained pairs are compared first; a shingle whose classes these links leave in several components becomes
   a task of its own with a tree, once for all shingles of the same classes. Tasks beyond the same bounds are cut into blocks
   by size band and hash, and each pair of blocks of equal or neighbouring bands is a task.

Defined results: null texts and texts without words have the empty set and link with nothing; fewer than n words
are one shingle; a very long text is one set, held by the tasks that compare it; repeated rows and copies are in one
component; a null id is never the least id of a component unless all are null; an id may have several texts, each of
which has its own component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import dropped, semi, stored, tuned, without
from .components import components, local_components

#: Counters of the sketch (a power of two) and the rows that carry it.
SKETCH, SLICES = 1 << 18, 64
#: Largest group or block that one task compares, in documents and in shingles.
GROUP_ROWS, GROUP_SHINGLES = 4096, 4_000_000
FAN = 16


def _sets(batch: pa.RecordBatch, n: int):
    """For each block of a batch (key, text): keys, shingle hashes, offsets, sizes, classes."""
    for i, j, data, offsets in K.blocks(batch.column(1)):
        starts, ends, doc = K.word_bounds(data, offsets)
        h, at = K.shingles(K.word_hashes(data, starts, ends), doc, j - i, n)
        size = np.diff(at)
        cls = K.mix(K.segment_sum(K.mix(h ^ np.uint64(0x9E3779B97F4A7C15)), at) + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        yield batch.column(0).slice(i, j - i), h, at, size, K.signed(cls)


def _describe(n: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, names = np.zeros(SKETCH, np.int64), ["doc_id", "print", "n_shingles", "cls", "slice", "counts"]
        for batch in batches:
            done = 0
            for ids, h, _, size, cls in _sets(batch, n):
                count += np.bincount(h >> np.uint64(64 - 18), minlength=SKETCH)
                none = [pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(done, len(ids)), pa.array(size, pa.int64()), pa.array(cls, mask=size == 0), *none], names)
                done += len(ids)
        if count.any():
            parts = [pa.array([x.astype("<u8").tobytes() for x in np.split(count, SLICES)], pa.binary())]
            none = [pa.nulls(SLICES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), *parts], names)

    return describe


def _add_up(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<u8").astype(np.int64) for x in frame["counts"].to_pylist())
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})


def commonness(slices: DataFrame) -> np.ndarray:
    """A weight for each counter: 0 where it is no more than chance makes of rare shingles, else a logarithm."""
    rows = slices.groupBy("slice").applyInArrow(_add_up, "slice int, counts binary").collect()  # SLICES rows at most
    count = np.zeros(SKETCH)
    for r in rows:
        count.reshape(SLICES, -1)[r["slice"]] = np.frombuffer(r["counts"], "<u8")
    usual = np.median(count)
    return np.log2(np.maximum((count - usual) / (6 * math.sqrt(usual) + 40), 0.5)).astype(np.int64).clip(-1, 62) + 1


#: Bits of a shingle in the exchange, and those of them that are sent as they are, in so many bytes.
WIDTH, LOW = 56, 40
LOW_BYTES = LOW // 8
#: Shingles of an owner on average at least, classes of a chunk at most, and shingles of a message at least, about.
OWNER_SHINGLES, CHUNK_DOCS, MESSAGE = 2_000_000, 65_536, 16


def exchange_sizes(shingles: int) -> tuple[int, int]:
    """Bits of an owner's number, and shingles of a chunk (the unit that sends). Chunks have half of an owner's shingles; both
    grow with the root of a very large input, so that a chunk's message to an owner keeps MESSAGE of them."""
    each = max(OWNER_SHINGLES, math.isqrt(2 * MESSAGE * shingles))
    return min(30, max(3, (shingles // each).bit_length())), each // 2


def code_tokens(rest: np.ndarray, width: int) -> bytes:
    """Ascending values below 2**width: their high bits in unary, as a bitmap."""
    bits = np.zeros((1 << max(width - LOW, 0)) + len(rest), bool)
    bits[(rest >> np.uint64(LOW)).astype(np.int64) + np.arange(len(rest))] = True
    return np.packbits(bits).tobytes()


def low_bytes(rest: np.ndarray) -> bytes:
    return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES].tobytes()


def decode_tokens(high: bytes, low: bytes) -> np.ndarray:
    low = np.frombuffer(low, np.uint8).reshape(-1, LOW_BYTES)
    whole = np.zeros((len(low), 8), np.uint8)
    whole[:, :LOW_BYTES] = low
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))
    return ((ones - np.arange(len(low))).astype(np.uint64) << np.uint64(LOW)) | whole.view("<u8").ravel()


_SENT = ["owner", "chunk", "doc", "low", "high", "cls", "n"]
_SENT_SCHEMA = "owner long, chunk long, doc binary, low binary, high binary, cls binary, n binary"


def _send(n: int, weight: np.ndarray, owner_bits: int, chunk_shingles: int):
    """Chunks of classes to owners. A chunk's classes and its common shingles, uncoded, go to a spare owner (negative)."""

    def rows(h: np.ndarray, doc: np.ndarray, cls: np.ndarray, size: np.ndarray, chunk: int) -> pa.RecordBatch:
        common = weight[h >> np.uint64(64 - 18)] > 0
        token = h >> np.uint64(64 - WIDTH)
        out = [(-1 - chunk, doc[common].tobytes(), token[common].astype("<u8").tobytes(), None, cls.astype("<i8").tobytes(), size.astype("<i4").tobytes())]
        token, doc = token[~common], doc[~common]
        order = np.argsort(token)
        token, doc = token[order], doc[order]
        del order, common
        width = WIDTH - owner_bits
        cuts = np.searchsorted(token, np.arange(1 << owner_bits, dtype=np.uint64) << np.uint64(width))
        for owner, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(token)))):
            if a < b:
                rest = token[a:b] & np.uint64((1 << width) - 1)
                out.append((owner, doc[a:b].tobytes(), low_bytes(rest), code_tokens(rest, width), None, None))
        columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([chunk] * len(out), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3, 4, 5))], _SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, docs, shingles, number = [], 0, 0, TaskContext.get().partitionId() << 24

        def chunk() -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            return rows(*whole, number)

        for batch in batches:
            for _, h, at, size, cls in _sets(batch, n):
                new = size > 0
                # of a block's copies one is sent; classes that other blocks send too are found later
                new[np.setdiff1d(np.arange(len(cls)), np.unique(cls, return_index=True)[1])] = False
                if not new.any():
                    continue
                if parts and (shingles + len(h) > chunk_shingles or docs + new.sum() > CHUNK_DOCS):
                    yield chunk()
                    parts, docs, shingles, number = [], 0, 0, number + 1
                keep = np.repeat(new, size)
                parts.append((h[keep], (docs + np.repeat(np.arange(new.sum()), size[new])).astype("<u2"), cls[new], size[new]))
                docs, shingles = docs + int(new.sum()), shingles + int(size[new].sum())
        if parts:
            yield chunk()

    return send


_SHARED_SCHEMA = "chunk long, doc int, token long, w int, cls long, n int"


def _share(weight: np.ndarray, owner_bits: int):
    def table(chunk, doc, token=None, w=None, cls=None, n=None) -> pa.Table:
        size = len(doc)
        columns = [(chunk, pa.int64()), (doc, pa.int32()), (token, pa.int64()), (w, pa.int32()), (cls, pa.int64()), (n, pa.int32())]
        return pa.table([pa.nulls(size, kind) if x is None else pa.array(x.astype(kind.to_pandas_dtype()), kind) for x, kind in columns], ["chunk", "doc", "token", "w", "cls", "n"])

    def share(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        """One owner: (chunk, place, token, commonness) of the tokens that several classes have; a spare one: the common
        tokens of a chunk, and (chunk, place, class, size) of its classes."""
        owner, chunks = key[0].as_py(), np.asarray(frame["chunk"])
        if owner < 0:
            out = []
            for chunk, doc, low, cls, n in zip(chunks, *(frame[c] for c in ("doc", "low", "cls", "n"))):
                cls, doc, token = np.frombuffer(cls.as_buffer(), "<i8"), np.frombuffer(doc.as_buffer(), "<u2"), np.frombuffer(low.as_buffer(), "<u8")
                out.append(table(np.full(len(cls), chunk), np.arange(len(cls)), cls=cls, n=np.frombuffer(n.as_buffer(), "<i4")))
                out.append(table(np.full(len(doc), chunk), doc, token, weight[token >> np.uint64(WIDTH - 18)]))
            return pa.concat_tables(out)
        doc = [np.frombuffer(x.as_buffer(), "<u2") for x in frame["doc"]]
        token = [decode_tokens(high.as_buffer(), low.as_buffer()) for high, low in zip(frame["high"], frame["low"])]
        chunk = np.repeat(np.arange(len(token)), [len(t) for t in token])
        token, doc = np.concatenate(token), np.concatenate(doc)
        order = np.argsort(token)
        token = token[order]
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        several = same[1:] | same[:-1]
        token, order = token[several] | np.uint64(owner << (WIDTH - owner_bits)), order[several]
        return table(chunks[chunk[order]], doc[order], token, np.zeros(len(token), np.int32))

    return share


#: Rows of shared tokens that are worked on together, or one class's if it has more.
PREFIX_ROWS = 200_000


def _prefixes(percent: int):
    def cut(chunk, doc, token, w, cls, n) -> pa.RecordBatch:
        """Whole classes, each beginning with the row that names it: the tokens of their prefixes."""
        names = n >= 0
        owner = np.cumsum(names) - 1
        size, cls = n[names].astype(np.int64), cls[names]
        token, w, owner = token[~names], w[~names], owner[~names]
        order = np.lexsort((token, w, owner))
        token, owner = token[order], owner[order]
        shared = np.bincount(owner, minlength=len(size))
        rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
        # unshared shingles come first; what the prefix has room for besides them
        keep = rank < (size - -(-percent * size // 100) + 1 - (size - shared))[owner]
        keep[1:] &= (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        owner = owner[keep]
        return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(size[owner].astype(np.int32)), pa.array(cls[owner])], ["token", "n", "cls"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append([batch.column(i).fill_null(-1 if i != 4 else 0).to_numpy(zero_copy_only=False) for i in range(6)])
            rows += len(batch)
            if rows >= PREFIX_ROWS:
                whole = [np.concatenate(x) for x in zip(*held)]
                last = int(np.flatnonzero(whole[5] >= 0)[-1])  # the class that may go on
                if last:
                    yield cut(*(x[:last] for x in whole))
                held, rows = [[x[last:] for x in whole]], 0
        if held:
            yield cut(*(np.concatenate(x) for x in zip(*held)))

    return prefixes


def prefix_tokens(docs: DataFrame, n: int, percent: int, weight: np.ndarray, shingles: int) -> DataFrame:
    """(token, n, cls): for each class the part of its prefix that other classes have too. docs: a document or more
    of each class."""
    bits, chunk = exchange_sizes(shingles)
    weight = weight.astype(np.uint8)
    sent = docs.select("doc_id", "text").mapInArrow(_send(n, weight, bits, chunk), _SENT_SCHEMA)
    shared = sent.groupBy("owner").applyInArrow(_share(weight, bits), _SHARED_SCHEMA)
    shared = shared.repartition("chunk", "doc").sortWithinPartitions("chunk", "doc", F.desc("n"))
    return stored(shared.mapInArrow(_prefixes(percent), "token long, n int, cls long").distinct(), "tokens")


def _neighbours(percent: int):
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by token, size and class: distinct pairs of neighbours (a, b), then the partition's first and last row."""
        from pyspark import TaskContext

        first = last = None
        pairs = [np.zeros((0, 2), np.int64)]
        for batch in batches:
            if not len(batch):
                continue
            token, n, cls = (np.asarray(batch.column(i)) for i in range(3))
            if last is not None:
                token, n, cls = (np.concatenate([x, y]) for x, y in zip(last, (token, n, cls)))
            near = (token[1:] == token[:-1]) & (cls[1:] != cls[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            pairs.append(np.stack([cls[:-1][near], cls[1:][near]], 1))
            first = first or tuple(int(x[0]) for x in (token, n, cls))
            last = [x[-1:] for x in (token, n, cls)]
            if len(pairs) > 500:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
        pairs = np.unique(np.concatenate(pairs), axis=0)
        names = ["a", "b", "part", "token", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int64())], names)
        if last is not None:
            token, n, cls = zip(first, (int(x[0]) for x in last))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([0, 1]), pa.array([TaskContext.get().partitionId()] * 2, pa.int32()), pa.array(token), pa.array(n)], names)

    return neighbours


def chained_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes that are neighbours, by size, at one of their tokens and may link by size. Rows are dealt by ranges, so
    that a token's rows may lie in several partitions; the ends of partitions (two rows each) are joined here."""
    spark = tokens.sparkSession
    dealt = tokens.repartitionByRange("token", "n", "cls").sortWithinPartitions("token", "n", "cls").select("token", "n", "cls")
    found = stored(dealt.mapInArrow(_neighbours(percent), "a long, b long, part int, token long, n long"), "neighbours")
    ends = sorted(found.filter("part is not null").collect(), key=lambda r: (r["part"], r["b"]))
    across = [(x["a"], y["a"]) for x, y in zip(ends, ends[1:]) if x["part"] != y["part"] and x["token"] == y["token"] and x["a"] != y["a"] and 100 * x["n"] >= percent * y["n"]]
    pairs = found.filter("part is null").select("a", "b")
    return (pairs.union(spark.createDataFrame(across, "a long, b long")) if across else pairs).distinct()


def _set_rows(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, at, size, cls in _sets(batch, n):
                sets = [h[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(size, pa.int64()), pa.array(sets, pa.binary())], ["cls", "n", "hashes"])

    return rows


class SignatureTree:
    """Sets under OR-combined bitmaps, FAN children to a node. label: a component for each set, or -1 for nodes that hold
    several."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        width = 1 << int(np.clip(4 * np.median(n), 256, 16384)).bit_length()
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for i, s in enumerate(sets):
            row = np.zeros(width, bool)
            row[s & np.uint64(width - 1)] = True
            bits[i] = np.packbits(row).view(np.uint64)
        low, high, clash = n, n, n - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, low, high, clash)]
        while len(bits) > 1:
            cuts = np.arange(0, len(bits), FAN)
            bits = np.bitwise_or.reduceat(bits, cuts)
            low, high, clash = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(clash, cuts)
            self.levels.append((bits, low, high, clash))

    def labels(self, label: np.ndarray) -> list[np.ndarray]:
        out = [label]
        for bits, *_ in self.levels[1:]:
            cuts = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], cuts), np.maximum.reduceat(out[-1], cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def admits(self, level: int, u: np.ndarray, v: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a link between two components."""
        bits, low, high, clash = self.levels[level]
        ok = (label[u] != label[v]) | (label[u] < 0)
        ok &= (100 * high[u] >= percent * low[v]) & (100 * high[v] >= percent * low[u])
        u, v = u[ok], v[ok]
        most = np.bitwise_count(bits[u] & bits[v]).sum(1, dtype=np.int64) + np.minimum(clash[u], clash[v])
        ok[ok] = (100 + percent) * most >= percent * (low[u] + low[v])
        return ok


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are at least percent alike."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_sets(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> np.ndarray:
    """Component of each of some distinct, ascending, non-empty sets, as the least index in it; known: components that
    are known already, by any number."""
    m = len(sets)
    label = np.arange(m)
    if known is not None:
        _, first, at = np.unique(known, return_index=True, return_inverse=True)
        label = first[at]
    tried: set[tuple[int, int]] = set()

    def check(i: int, j: int) -> None:
        if label[i] == label[j] or (i, j) in tried:
            return
        tried.add((i, j))
        if linked(sets[i], sets[j], percent):
            x, y = sorted((label[i], label[j]))
            label[label == y] = x

    if m == 2:
        check(0, 1)
        return label
    # sets that share their least hash are likely alike: neighbours in the tree, and first to be linked
    order = np.lexsort(([len(s) for s in sets], [int(s[0]) for s in sets]))
    tree = SignatureTree([sets[i] for i in order])
    for key in (0, 1, -1, -2):
        row = sorted(range(m), key=lambda i: int(sets[i][key % len(sets[i])]))
        for i, j in zip(row, row[1:]):
            check(min(i, j), max(i, j))
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, u, v = stack.pop()
        labels = tree.labels(label[order])[level]
        if level == 0:
            distinct = u < v
            u, v = u[distinct], v[distinct]
        ok = tree.admits(level, u, v, labels, percent)
        u, v = u[ok], v[ok]
        if level == 0:
            for i, j in zip(order[u].tolist(), order[v].tolist()):
                check(min(i, j), max(i, j))
            continue
        size = len(tree.levels[level - 1][0])
        kid = np.arange(FAN)
        left = np.repeat(u[:, None] * FAN + kid, FAN, axis=1).ravel()
        right = np.tile(v[:, None] * FAN + kid, FAN).ravel()
        ok = (left < size) & (right < size) & (left <= right)
        left, right = left[ok], right[ok]
        for k in range(0, len(left), 20_000):
            stack.append((level - 1, left[k : k + 20_000], right[k : k + 20_000]))
    return label


def _linker(percent: int):
    def finish(rows: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
        names = sorted(rows)
        known = [rows[c][0] for c in names]
        label = link_sets([np.frombuffer(rows[c][1], "<u8") for c in names], percent, known)
        pairs = [(c, names[x]) for c, x, k in zip(names, label, known) if k != known[x]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (root, task, cls, known, hashes), sorted by root and task: one comparison for each run."""
        at, rows = None, {}
        for batch in batches:
            root, task, cls, known = (batch.column(i).to_pylist() for i in range(4))
            for r, t, c, k, h in zip(root, task, cls, known, batch.column(4)):
                if (r, t) != at:
                    if len(rows) > 1:
                        yield finish(rows)
                    at, rows = (r, t), {}
                rows[c] = (k, h.as_py())
        if len(rows) > 1:
            yield finish(rows)

    return link


def _compared(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, set of a, set of b): those that link."""
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(i)] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array([linked(x, y, percent) for x, y in zip(*sets)], pa.bool_()))

    return compare


def _tasks(members: DataFrame, percent: int) -> DataFrame:
    """members (cls, root, n) with the tasks (cls, root, task) that each takes part in: one a root, or pairs of blocks."""
    few = F.ceil(F.greatest(F.col("rows") / GROUP_ROWS, F.col("shingles") / GROUP_SHINGLES))
    totals = [F.count("*").alias("rows"), F.sum("n").alias("shingles")]
    large = stored(members.groupBy("root").agg(*totals).filter(few > 1).select("root"), "large")
    if large.isEmpty():
        return members.select("cls", "root", F.lit("").alias("task"))
    members = members.withColumn("band", F.floor(F.log("n") / math.log(100 / percent)))
    small = members.join(large, "root", "left_anti").select("cls", "root", F.lit("").alias("task"))
    bands = members.join(large, "root", "left_semi").groupBy("root", "band").agg(*totals).select("root", "band", few.alias("k"))
    rest = members.join(bands, ["root", "band"])
    for step in (1, -1):
        rest = rest.join(bands.select("root", (F.col("band") - step).alias("band"), F.col("k").alias(f"k{step}")), ["root", "band"], "left")
    key = "concat_ws(',', {}, {}, {}, {})"
    tasks = f"""concat(transform(sequence(0, k - 1), x -> {key.format("band", "least(h, x)", "band", "greatest(h, x)")}),
                       if(k1 is null, array(), transform(sequence(0, k1 - 1), x -> {key.format("band", "h", "band + 1", "x")})),
                       if(`k-1` is null, array(), transform(sequence(0, `k-1` - 1), x -> {key.format("band - 1", "x", "band", "h")})))"""
    rest = rest.withColumn("h", F.expr("pmod(xxhash64(cls), k)")).select("cls", "root", F.explode(F.expr(tasks)).alias("task"))
    return small.union(rest)


def _run(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that the trees of tasks (cls, root, task, known) find."""
    work = tasks.join(sets, "cls").select("root", "task", "cls", "known", "hashes").repartition("root", "task").sortWithinPartitions("root", "task")
    return work.mapInArrow(_linker(percent), "a long, b long")


def _fused(tokens: DataFrame, pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes of large groups, members (cls): chained pairs first, then tokens between components."""
    sets = stored(sets, "sets")
    near = pairs.join(members.withColumnRenamed("cls", "a"), "a", "left_semi")
    both = near.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
    links = stored(both.mapInArrow(_compared(percent), "a long, b long"), "links")
    known = components(links).toDF("cls", "known")
    rows = tokens.join(members, "cls", "left_semi").join(known, "cls", "left").withColumn("known", F.coalesce("known", "cls"))
    # tokens of several components; of tokens with the same classes, one
    spread = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("known").alias("low"), F.max("known").alias("high"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("mark")).filter("low <> high")
    chosen = stored(spread.groupBy("size", "mark", "low", "high").agg(F.min("token").alias("token")).select("token"), "chosen")
    if not chosen.isEmpty():
        rows = stored(rows.join(chosen, "token", "left_semi").select("cls", F.col("token").alias("root"), "n", "known"), "between")
        tasks = _tasks(rows.select("cls", "root", "n"), percent).join(rows.select("cls", "known").distinct(), "cls")
        links = links.union(_run(tasks, sets, percent))
    return components(links)


def _key(doc_id, print_) -> F.Column:
    """A row's id and text as a key; a null id is an id of its own."""
    return F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(print_).cast("string"))


def _joined(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, print, n_shingles, cls) of every row, print a hash of its text; (cls, root) of every class of one row or more."""
    tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    described = stored(docs.mapInArrow(_describe(n), "doc_id long, print long, n_shingles long, cls long, slice int, counts binary"), "described")
    weight = commonness(described.filter("slice is not null").select("slice", "counts"))
    rows = described.filter("slice is null").select("doc_id", "print", "n_shingles", "cls")

    # of each class the first row is worked on
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print")).alias("first"), F.first("n_shingles").alias("n"))
    classes = stored(classes.select("cls", "n", _key("first.doc_id", "first.print").alias("_key")), "classes")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    keyed = docs.withColumn("_key", _key("doc_id", "print"))
    others = rows.filter("cls is not null").select(_key("doc_id", "print").alias("_key"), "cls").distinct().join(classes, ["cls", "_key"], "left_anti").select("_key")
    tokens = prefix_tokens(without(keyed, others, "_key"), n, percent, weight, shingles)
    pairs = stored(chained_pairs(tokens, percent), "pairs")
    found = components(pairs)
    found = stored(found.union(found.select("root", "root").distinct()).toDF("cls", "root"), "groups")

    members = stored(classes.join(found, "cls"), "members")
    totals = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    large = stored(totals.filter((F.col("rows") > GROUP_ROWS) | (F.col("shingles") > GROUP_SHINGLES)).select("root"), "large")

    def sets(of: DataFrame) -> DataFrame:
        return semi(keyed, of.select("_key"), "_key").select("doc_id", "text").mapInArrow(_set_rows(n), "cls long, n long, hashes binary").select("cls", "hashes")

    small = without(members, large, "root")
    labels = _run(small.select("cls", "root", F.lit("").alias("task"), F.col("cls").alias("known")), sets(small), percent).toDF("cls", "root")
    if not large.isEmpty():
        fused = semi(members, large, "root")
        labels = labels.union(_fused(tokens, pairs, fused.select("cls"), sets(fused), percent))
    return rows, classes.select("cls").join(stored(labels, "labels"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    rows, classes = _joined(docs, n, percent)
    ids = rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    least = classes.join(ids, "cls").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(least, "root").select("cls", "component_id")
    return rows.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with exactly one row of each component: that of the least id. Rows are told apart by id and
    text, so another text of an id stays, a null id goes like any other, and of rows that repeat both one stays. Rows without words
    stay, all of them."""
    rows, classes = _joined(docs, n, percent)
    rows = rows.join(classes, "cls").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print").alias("row"), _key("doc_id", "print").alias("_row_key"))
    decided = rows.groupBy("root", "row", "_row_key").agg(F.count("*").alias("n"))
    first = decided.groupBy("root").agg(F.min("row").alias("row")).withColumn("first", F.lit(True))
    decided = stored(decided.join(first, ["root", "row"], "left").filter("first is null or n > 1").select("_row_key", F.coalesce("first", F.lit(False)).alias("kept")), "decided")
    keyed = docs.withColumn("_row_key", F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")))
    out, repeated = without(keyed, decided.select("_row_key"), "_row_key"), decided.filter("kept").select("_row_key")
    if not repeated.isEmpty():
        out = out.unionByName(semi(keyed, repeated, "_row_key").dropDuplicates(["_row_key"]))
    return out.drop("_row_key")
