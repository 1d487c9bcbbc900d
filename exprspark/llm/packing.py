"""Vector bin packing of examples into training sequences.

A sequence has room for so many tokens, segments and loss-bearing tokens. It is filled by the dot-product heuristic: of
the pieces that fit, the one goes in whose demand, weighted by how scarce each kind of room is, points most along the
room that is left. When none fits, the largest example is cut to what is left, and its rest returns to
the pool. Each task fills its sequences from a pool of some thousand examples while it reads on, so nothing is shuffled
and memory is bounded by the pool. A task's last sequence, which may stay short, is closed as a few ones of
power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.llm import common

#: Place of the vocabulary, read by the driver and broadcast (some MB).
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 2
POOL, POOL_BYTES = 2048, 16 << 20
#: Words of a generation whose ids a Python worker remembers, 250 bytes each.
REMEMBERED = 150_000
SLICE_BYTES = 3 << 20
PIECES = "doc_id bigint, start bigint, length bigint, loss bigint, ids binary, doc_tokens bigint, sequence_id bigint, segment int, offset bigint"


Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Limits:
    """Room of one sequence."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("A sequence needs room for a token, a segment and a loss-bearing token.")


class Words:
    """Ids of UTF-8 texts, word by word: no token crosses ASCII white space, so each distinct word is encoded once.

    ASCII capitals are lowered first and sentence marks behind a letter are encoded apart, as the vocabulary's own rules do; words of
    letters alone go to the tokenizer's model at once. Texts with the opening of a special token are left to the
    tokenizer whole. Two generations of words are remembered.
    """

    MARKS = ".,;:!?"
    #: Scripts with letters that count as such under every Unicode version in use: Latin, Greek, Cyrillic.
    PLAIN = "\u0530"

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for 256, 257, ... in order
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted(set(range(256)) - set(visible))
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word without ASCII capitals and white space."""
        if word.isalpha():
            mapped = word
            if not word.isascii():
                small = word.lower()
                plain = max(word) < self.PLAIN and "Σ" not in word and small.isalpha() and is_normalized("NFC", word) and is_normalized("NFC", small)
                mapped = small.encode().decode("latin-1").translate(self.alphabet) if plain else None
            if mapped:
                return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        core = word.rstrip(self.MARKS)
        if core and core != word and normalize("NFC", core[-1].lower()).isalpha():  # stays a letter
            return self._remember(core.encode()) + self._remember(word[len(core):].encode())
        return self._text(word)

    def _remember(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = self.older.get(word) or self._word(word.decode())
        return ids

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        split = [None if b"<|" in text else text.lower().split() for text in texts]
        remember = self._remember
        mine = {word: remember(word) for word in set().union(*(words for words in split if words))}
        return [self._text(text.decode()) if words is None else b"".join(map(mine.__getitem__, words)) for text, words in zip(texts, split)]


@lru_cache(maxsize=2)
def _words(vocabulary: str) -> Words:
    return Words(vocabulary)


def _encoder(docs: DataFrame, vocabulary: str, end: int) -> Callable[[Batches], Batches]:
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    stop = np.asarray([end], "<u4").tobytes()

    def work(batches: Batches) -> Batches:
        words = _words(shared.value)
        for batch in batches:
            for part in common.slices(batch, limit=SLICE_BYTES):
                ids = [x + stop for x in words(common.encoded(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int64())], names=["doc_id", "ids", "loss_from"])

    return work


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), loss_from of every row: the text's ids, then `end`; a null text is empty.

    Loss is borne from the second token on, since nothing precedes the first.
    """
    return _texts(docs).mapInArrow(_encoder(docs, vocabulary, end), "doc_id bigint, ids binary, loss_from bigint")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


Piece = tuple[int, int, int]  # example, start, length


class Packer:
    """Examples waiting for room, and the sequences made of them.

    An example has a number of tokens and a first loss-bearing one. `fill` gives the pieces of one sequence; an example
    whose last token is placed leaves the pool.
    """

    def __init__(self, limits: Limits):
        self.room = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.size = 0
        self.names = np.empty(POOL, np.int64)
        self.at = np.empty((3, POOL), np.int64)  # start, end, first loss-bearing token
        self.demand = np.empty((POOL, 3))
        self.weights = np.ones(3)

    def add(self, name: int, tokens: int, loss_from: int) -> None:
        if self.size == len(self.names):
            self.names = np.resize(self.names, 2 * self.size)
            self.at, self.demand = np.concatenate([self.at, self.at], axis=1), np.concatenate([self.demand, self.demand])
        self.names[self.size] = name
        self._set(self.size, 0, tokens, loss_from)
        self.size += 1

    def _set(self, k: int, start: int, end: int, loss_from: int) -> None:
        self.at[:, k] = start, end, loss_from
        self.demand[k] = end - start, 1, max(0, end - max(start, loss_from))

    def _drop(self, k: int) -> None:
        self.size -= 1
        self.names[k], self.at[:, k], self.demand[k] = self.names[self.size], self.at[:, self.size], self.demand[self.size]

    def weigh(self) -> None:
        """Weights of the kinds of room: the pool's demand of each, in sequences."""
        self.weights = self.demand[: self.size].sum(0) / self.room
        self.weights /= max(self.weights.sum(), 1e-12)

    def _prefix(self, k: int, left: np.ndarray) -> int:
        """Tokens of example k that fit into what is left."""
        start, end, loss_from = self.at[:, k].tolist()
        return int(min(end - start, left[0], max(0, loss_from - start) + left[2])) if left[1] >= 1 else 0

    def fill(self) -> list[Piece]:
        left = self.room.copy()
        pieces: list[Piece] = []

        def take(k: int, length: int) -> None:
            start, end, loss_from = self.at[:, k].tolist()
            pieces.append((int(self.names[k]), start, length))
            left[:] -= (length, 1, max(0, start + length - max(start, loss_from)))
            if start + length == end:
                self._drop(k)
            else:
                self._set(k, start + length, end, loss_from)

        large = np.flatnonzero((self.demand[: self.size] > self.room).any(1))
        if len(large):  # fits no empty sequence: it opens this one
            take(int(large[0]), self._prefix(int(large[0]), left))
        while self.size and left[0] >= 1 and left[1] >= 1:
            demand = self.demand[: self.size]
            score = demand @ (self.weights * left / self.room / self.room)
            score[(demand > left).any(1)] = -1.0
            k = int(score.argmax())
            if score[k] >= 0:
                take(k, int(demand[k, 0]))
                continue
            k = int(demand[:, 0].argmax())
            length = self._prefix(k, left)
            if not length:  # no room for loss: only an example that still has tokens without it can go on
                free = np.minimum(self.at[2, : self.size], self.at[1, : self.size]) - self.at[0, : self.size]
                k = int(free.argmax())
                length = self._prefix(k, left)
            if not length:
                break
            take(k, length)
        return pieces


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces of a short sequence as sequences of falling power-of-two lengths."""
    left = sum(length for _, _, length in pieces)
    waiting, out = pieces[::-1], []
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out.append([])
        while want:
            name, start, length = waiting.pop()
            used = min(length, want)
            out[-1].append((name, start, used))
            want -= used
            if used < length:
                waiting.append((name, start + used, length - used))
    return out


def _packer(limits: Limits) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        packer = Packer(limits)
        held: dict[int, tuple[int | None, bytes, int]] = {}
        open_: dict[int, int] = {}  # tokens of an example not yet placed
        ready: list[tuple] = []
        base, names, made = TaskContext.get().partitionId() << 32, 0, 0
        waiting = shipped = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal made, waiting, shipped
            offset = 0
            for segment, (name, start, length) in enumerate(pieces):
                doc_id, ids, loss_from = held[name]
                ready.append((doc_id, start, length, max(0, start + length - max(start, loss_from)), ids[4 * start : 4 * (start + length)], len(ids) // 4, base + made, segment, offset))
                shipped += 4 * length
                offset += length
                open_[name] -= length
                if not open_[name]:
                    waiting -= len(ids)
                    del held[name], open_[name]
            made += 1

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shipped
            if ready:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])
                ready.clear()
                shipped = 0

        for part in (p for batch in batches for p in common.slices(batch, "ids", SLICE_BYTES)):
            for doc_id, ids, loss_from in zip(*(part.column(c).to_pylist() for c in ("doc_id", "ids", "loss_from"))):
                n = len(ids or b"") // 4
                if not n:
                    continue
                first = n if loss_from is None else min(max(loss_from, 0), n)
                held[names], open_[names] = (doc_id, ids, first), n
                packer.add(names, n, first)
                names += 1
                waiting += len(ids)
                if packer.size >= POOL or waiting >= POOL_BYTES:
                    packer.weigh()
                    while packer.size > POOL // 2 or waiting > POOL_BYTES // 2:
                        emit(packer.fill())
                        if shipped > POOL_BYTES:
                            yield from flush()
        packer.weigh()
        while packer.size:
            pieces = packer.fill()
            for part in [pieces] if packer.size else powers(pieces):
                emit(part)
            if shipped > POOL_BYTES:
                yield from flush()
        yield from flush()

    return work


def pack(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces of every row of examples (doc_id, ids, loss_from): doc_id, start, length, loss, ids, doc_tokens, sequence_id, segment, offset.

    ids are little-endian unsigned 32-bit token ids, loss_from is the first loss-bearing one (null: none is). Each id lies in exactly
    one piece; no sequence exceeds a limit. Rows are packed one by one, so repeated rows and ids repeat; an example
    without ids (null or empty) has no piece. Other columns are ignored. Of a task only the last sequence is short because nothing
    is left; one may also be short where another limit is reached first. An empty table gives no rows.
    """
    rows = examples.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids", F.col("loss_from").cast("bigint").alias("loss_from"))
    return rows.mapInArrow(_packer(limits), PIECES)


def pack_texts(docs: DataFrame, limits: Limits = Limits(), vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """pack(encode(docs)) in one pass, without token ids on their way through Spark twice."""
    encoder, packer = _encoder(docs, vocabulary, end), _packer(limits)
    return _texts(docs).mapInArrow(lambda batches: packer(encoder(batches)), PIECES)
