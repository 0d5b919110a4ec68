"""Packing by vector bin packing with the dot-product heuristic.

An item asks for tokens, segments and loss-bearing tokens; a sequence has a limit
on each. Into the open sequence goes, of the pooled items that fit, the one whose
demand has the largest dot product with what is left, all as shares of the
limits. Where nothing fits and cutting is allowed (every token bears loss), a
piece of the longest item fills the gap. Every task packs its own rows as they
come, from a pool of bounded size, so nothing is shuffled and reruns agree.

Sequences are padded to the limit unless their length is a power of two. What a
task has left for its last sequence is dealt into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.io import table, text_batches
from riskloom.llm.tokens import END_ID, encoder, vocabulary_path

SEQUENCE_TOKENS = 2048
SEQUENCE_SEGMENTS = 256
#: Items a task holds at once to choose from.
POOL = 768
#: Gaps below so many tokens stay padding rather than cutting an item.
LEAST_CUT = 8


@dataclass(frozen=True)
class Limits:
    tokens: int = SEQUENCE_TOKENS
    segments: int = SEQUENCE_SEGMENTS
    loss: int = SEQUENCE_TOKENS

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.float64)


class Packer:
    """Items in by add(), sequences out by closed(); each is a list of (key, start, length)."""

    def __init__(self, limits: Limits, cut: bool, pool: int = POOL, least_cut: int = LEAST_CUT):
        self.limits, self.cut, self.pool, self.least_cut = limits.array(), cut, pool, least_cut
        self.keys: list[object] = []
        self.starts: list[int] = []
        self.need = np.zeros((2 * pool, 3))
        self.n = 0

    def add(self, key: object, start: int, tokens: int, loss: int, segments: int = 1) -> None:
        if self.n == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[self.n] = tokens, segments, loss
        self.keys.append(key)
        self.starts.append(start)
        self.n += 1

    def _take(self, i: int) -> tuple[object, int, int]:
        piece = self.keys[i], self.starts[i], int(self.need[i, 0])
        self.n -= 1
        last = self.n
        self.need[i] = self.need[last]
        self.keys[i], self.starts[i] = self.keys[last], self.starts[last]
        self.keys.pop()
        self.starts.pop()
        return piece

    def closed(self, flush: bool = False) -> Iterator[list[tuple[object, int, int]]]:
        """Sequences from the pool while it is full, or until it is empty."""
        while self.n > (0 if flush else self.pool):
            left, pieces = self.limits.copy(), []
            while self.n:
                need = self.need[: self.n]
                fits = (need <= left).all(1)
                if fits.any():
                    gain = np.where(fits, (need / self.limits) @ (left / self.limits), -1.0)
                    i = int(gain.argmax())
                    left -= need[i]
                    pieces.append(self._take(i))
                elif self.cut and left[0] >= self.least_cut and left[1] >= 1:
                    i = int(need[:, 0].argmax())
                    k = int(min(left[0], left[2]))
                    pieces.append((self.keys[i], self.starts[i], k))
                    self.starts[i] += k
                    self.need[i, [0, 2]] -= k
                    left -= (k, 1, k)
                else:
                    break
                if left[0] < 1:
                    break
            if not pieces:
                raise ValueError(f"an item asks for more than a whole sequence: {self.need[0].tolist()}")
            yield pieces


def powers(pieces: list[tuple[object, int, int]]) -> Iterator[list[tuple[object, int, int]]]:
    """The pieces dealt into sequences whose lengths are the powers of two in their sum."""
    total = sum(p[2] for p in pieces)
    rest = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        want, own = 1 << bit, []
        while want:
            key, start, length = rest.pop()
            k = min(length, want)
            own.append((key, start, k))
            want -= k
            if k < length:
                rest.append((key, start + k, length - k))
        yield own


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = END_ID, ids: bool = False, loss: str | None = None) -> DataFrame:
    """One row for each piece of every text (null: empty), in sequences of the limits; with ids, the piece's ids as well.

    A text's ids end with end_id, so an empty text is one token. Texts longer than
    a sequence fill whole ones first. Rows that repeat are packed each for itself;
    an empty table gives no rows; columns besides doc_id and text don't matter.
    loss names a boolean column: whether a row's tokens bear loss (null: they don't);
    without it all do. Where fewer may bear loss than a sequence holds, a row that
    does is cut into pieces within that limit.
    """
    size = limits.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(limits, cut=loss is None and limits.loss >= limits.tokens)
        sequence, rows = TaskContext.get().partitionId() << 40, []

        def put(pieces: list[tuple[tuple, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for (doc, own, whole), start, length in pieces:
                piece = own[start : start + length].astype("<u4").tobytes()
                rows.append((doc, start, length, zlib.crc32(piece), whole, sequence, offset, *([piece] if ids else [])))
                offset += length
            sequence += 1

        def table_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * (7 + ids)
            kinds = [pa.int64()] * 7 + [pa.binary()] * ids
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*(x.split()[0] for x in SCHEMA.split(", ")), *["ids"] * ids])
            rows.clear()
            return out

        for batch in batches:
            doc_ids, bears = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, all_ids, bounds in enc.texts(batch.column(1), end_id):
                edges = bounds.tolist()
                for i in range(len(edges) - 1):
                    own = all_ids[edges[i] : edges[i + 1]]
                    n = len(own)
                    if bears[at + i] and limits.loss < size:
                        key = (doc_ids[at + i], own.copy(), n)
                        for start in range(0, n, limits.loss):
                            k = min(limits.loss, n - start)
                            packer.add(key, start, k, k)
                        for pieces in packer.closed():
                            put(pieces)
                        continue
                    key = (doc_ids[at + i], own if n >= size else own.copy(), n)
                    full = n - n % size
                    for start in range(0, full, size):
                        put([(key, start, size)])
                    if n > full:
                        packer.add((key[0], own.copy() if not full else own, n), full, n - full, n - full if bears[at + i] else 0)
                    for pieces in packer.closed():
                        put(pieces)
                if rows:
                    yield table_of()
        for pieces in packer.closed(flush=True):
            length = sum(p[2] for p in pieces)
            if packer.n or length == size or not packer.cut:
                put(pieces)
            else:
                for part in powers(pieces):
                    put(part)
        if rows:
            yield table_of()

    bearing = F.lit(True) if loss is None else F.coalesce(F.col(loss), F.lit(False))
    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), bearing.alias("bears")).mapInArrow(run, SCHEMA + ", ids binary" * ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
