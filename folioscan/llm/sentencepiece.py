"""SentencePiece encoding and decoding with weighted finite-state transducers.

Two transducers are compiled from a model and composed once: the normaliser (a mark U+2581 before the text and for
each space) and the lexicon of pieces (a trie; behind a piece an empty move emits it at weight 1; any character that
begins no piece is read as its bytes at weight BYTE_WEIGHT). With each input the result is composed, and with a
pair acceptor, state by state (wfst.Segmenter), and the shortest path in the tropical semiring is taken: the fewest
pieces, bytes last.

The model is a byte-pair one: its encoding comes from merges in the order of scores and is not the path of the best
summed score. What makes the shortest path right is the pair acceptor: it admits a piece after another only if
merging the two's characters from the start ends in just these two. A sequence whose neighbours are all admitted
is the merges' result, so at most one path is left to each place; the walk keeps several where a model has them.

Defined results: nulls and empty texts have no pieces; repeated rows are encoded alike; ties between paths go to the
lesser ids; an empty table gives an empty result; other columns are ignored. Ids decode to the text they came from, but
that the mark itself, in a text, decodes to a space. Texts are encoded whole, in memory that grows with the longest
run without a space; words are remembered in tables of bounded size.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tuned
from .wfst import EPSILON, PASS, Segmenter, Wfst, compose, renumbered

MARK = "▁"
#: Words, and pairs of pieces, that a task remembers.
WORDS, PAIRS = 800_000, 500_000
#: What stands before the first piece, and bytes in place of a piece.
START, BYTES = -1, -2
#: The weight of a character in bytes, beyond that of any sequence of pieces for it.
BYTE_WEIGHT = 64.0
#: The type code of unsigned 32-bit integers, whose bytes are little-endian on the machines that this runs on.
_WORD = "I"
assert sys.byteorder == "little" and array(_WORD).itemsize == 4
_CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")


def normaliser() -> Wfst:
    """Characters -> characters: a mark first, and marks for spaces. Other characters pass."""
    out = Wfst("begin", finals={"text": 0.0})
    out.add("begin", EPSILON, MARK, 0.0, "text")
    out.add("text", " ", MARK, 0.0, "text")
    out.add("text", PASS, PASS, 0.0, "text")
    return out


def lexicon(pieces: dict[str, int]) -> Wfst:
    """Characters -> ids of pieces put one after another, or BYTES for a character that begins none. States are the
    beginnings of pieces."""
    out = Wfst("", finals={"": 0.0})
    for begin in {p[:k] for p in pieces for k in range(1, len(p) + 1)}:
        out.add(begin[:-1], begin[-1], EPSILON, 0.0, begin)
    for piece, i in pieces.items():
        out.add(piece, EPSILON, i, 1.0, "")
    out.add("", PASS, BYTES, BYTE_WEIGHT, "")
    return out


class _Words(dict):
    """chunk -> ids, worked out when first asked for; full tables take no more."""

    def __init__(self, model: Model, prefix: str):
        self.model, self.prefix = model, prefix

    def __missing__(self, word: str) -> bytes:
        ids = array(_WORD, self.model.segment(self.prefix + word)).tobytes()
        if len(self) < WORDS:
            self[word] = ids
        return ids


class Model:
    """pieces: piece -> (id, score). byte_ids: the 256 ids of byte pieces."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        if MARK not in pieces:
            raise ValueError("a model needs a piece for the mark")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.names = {i: p for p, (i, _) in pieces.items()}
        made = compose(normaliser(), lexicon({p: i for p, (i, _) in pieces.items()}))
        numbers = {made.start: 0, ("text", ""): 1}
        self.machine = Segmenter(renumbered(made, numbers), 1)
        self.inner = any(MARK in p.lstrip(MARK) for p in pieces)
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.spaced, self.bare = _Words(self, " "), _Words(self, "")
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @staticmethod
    def from_file(path: str) -> Model:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        plain = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return Model({m.id_to_piece(i): (i, m.get_score(i)) for i in plain}, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def merge(self, chars: str) -> list[str]:
        """The merges' result on a short string: the best-scored neighbours join first, ties from the left."""
        parts = list(chars)
        while True:
            scored = [(-self.pieces[a + b][1], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.pieces]
            if not scored:
                return parts
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def admits(self, a: int, b: int) -> bool:
        """The pair acceptor, on ids; START stands before the first piece."""
        known = self.pairs.get(a, {}).get(b)
        if known is None:
            left, right = self.names.get(a, ""), self.names[b]
            known = self.merge(left + right) == ([left, right] if left else [right])
            if self.n_pairs < PAIRS:
                self.n_pairs += 1
                self.pairs.setdefault(a, {})[b] = known
        return known

    def segment(self, chunk, opening: bool = False) -> list[int]:
        """Ids of the shortest path of a chunk of raw text; opening: the normaliser is at its beginning, so the empty move
        that makes the first mark is taken before the chunk."""
        labels = [EPSILON, *chunk] if opening else chunk
        machine, out = self.machine, []
        for entry, i, j in machine.shortest(labels, machine.start if opening else machine.home, START, BYTES, self.pairs, self.admits):
            out += [entry] if entry != BYTES else [self.byte_ids[b] for c in labels[i:j] for b in (MARK if c in (" ", EPSILON) else c).encode()]
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit integers. Where no piece holds a mark behind another character, no piece
        spans the begin of a word, so words are encoded by themselves."""
        if not text:
            return np.zeros(0, "<u4")
        if self.inner:
            return np.array(self.segment(text, True), "<u4")
        out, spaced, bare = [], self.spaced, self.bare
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(bare["\n"])
            words = line.split(" ")
            if "" in words or MARK in line:  # runs of marks are pieces of their own
                chunks = _CHUNK.findall(line)
                if not k:
                    out.append(array(_WORD, self.segment(chunks[0] if chunks else "", True)).tobytes())
                out += [bare[c] for c in (chunks if k else chunks[1:])]
            else:
                out.append(bare[words[0]] if k else array(_WORD, self.segment(words[0], True)).tobytes())
                out += [spaced[w] for w in words[1:]]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes are put together, and the first mark goes."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return data.decode(errors="replace")[1:] if data[:1] == b" " else data.decode(errors="replace")


@cache
def _model(path: str) -> Model:
    return Model.from_file(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array) and whether decoding gives the text back, of every row of docs."""
    tuned(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in batches:
            ids = [m.encode(t.as_py() or "") for t in batch.column(1)]
            same = [m.decode(i) == (t.as_py() or "") for i, t in zip(ids, batch.column(1))]
            cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), values), pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>, round_trip boolean")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip of every row of docs."""
    tuned(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                ids = m.encode(text)
                rows.append((len(ids), zlib.crc32(ids), m.decode(ids) == text))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
