"""Token ids in entropy-coded files: canonical length-limited Huffman codes in independent blocks.

A dataset is a folder with `codebook` (id, bits) and `blocks` (shard, block, docs,
ids, payload), both read and written by Spark alone. Code lengths come from the
counts of all ids by package-merge, 16 bits at most unless more than 65,536 ids
occur; codes are canonical, so the lengths are the whole code. Shards are ranges
of doc_id in ascending order, a document is never cut between blocks, and every
block decodes by itself:

    docs uint32, ids uint64, start uint64 (ids of this shard before the block),
    nulls uint8[docs], doc ids int64[docs], lengths uint32[docs],
    bit offset uint64 of every LANE-th id, then the code bits, first bit highest.

The bit offsets let a reader start at any LANE-th id; decoding walks all of a
block's lanes at once, one table lookup a step for every lane.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.io import new_path, shuffle_partitions, table, text_batches, written
from riskloom.llm.tokens import END_ID, encoder, vocabulary_path

LANE = 256
BLOCK_IDS = 1 << 19
MAX_BITS = 16
_HEAD = "<IQQ"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code, 0 where it doesn't occur: optimal under the limit, by package-merge."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    leaf_rows, packages = [], np.zeros(0)
    for _ in range(limit):
        values = np.concatenate([weights, packages])
        order = np.argsort(values, kind="stable")
        leaf_rows.append(order < n)
        merged = values[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    bits = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaf_rows):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = bits
    return out


class Code:
    """The canonical code of some lengths: shorter codes first, then smaller ids."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        used = np.flatnonzero(bits)
        self.order = used[np.lexsort((used, bits[used]))]
        self.width = int(bits.max(initial=1))
        sizes = bits[self.order].astype(np.int64)
        span = np.left_shift(np.int64(1), self.width - sizes)
        first = np.cumsum(span) - span
        self.code = np.zeros(len(bits), np.uint64)
        self.code[self.order] = (first >> (self.width - sizes)).astype(np.uint64)
        self.span = span
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and bits for each value of the next width bits."""
        if self._table is None:
            ids = np.zeros(1 << self.width, np.uint32)
            bits = np.ones(1 << self.width, np.uint8)
            n = int(self.span.sum())
            ids[:n] = np.repeat(self.order, self.span)
            bits[:n] = np.repeat(self.bits[self.order], self.span)
            self._table = ids, bits
        return self._table

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offset of every LANE-th id, and the bits."""
        size = self.bits[ids].astype(np.int64)
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        words = np.zeros((int(at[-1]) + 31) // 32 + 1, np.uint64)
        if len(ids):
            word = at[:-1] >> 5
            window = self.code[ids] << (64 - size - (at[:-1] & 31)).astype(np.uint64)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[begin]] += np.add.reduceat(window >> np.uint64(32), begin)
            words[word[begin] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), begin)
        return at[:-1:LANE].astype("<u8"), words.astype(">u4").tobytes()

    def unpack(self, n: int, offsets: np.ndarray, packed: bytes) -> np.ndarray:
        ids, bits = self.table
        raw = np.frombuffer(packed + bytes(16), ">u4").astype(np.uint64)
        pairs = (raw[:-1] << np.uint64(32)) | raw[1:]
        lanes = len(offsets)
        out = np.zeros((LANE, lanes), np.uint32)
        at = offsets.astype(np.int64)
        shift = np.uint64(64 - self.width)
        last = n - (lanes - 1) * LANE if lanes else 0
        for k in range(min(LANE, n)):
            if k == last and lanes > 1:
                at, out_k = at[:-1], out[k, : lanes - 1]
            else:
                out_k = out[k, : len(at)]
            window = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift
            out_k[:] = ids[window]
            at = at + bits[window]
        return out.T.reshape(-1)[:n]


def token_table(docs: DataFrame, path: str, end_id: int | None = END_ID, order_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 2 bytes an id where the vocabulary allows, else 4) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids_of, size_of = [], []
            for _, ids, bounds in enc.texts(batch.column(1), end_id):
                width = ids.itemsize
                raw = ids.tobytes()
                ids_of += [raw[a * width : b * width] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                size_of.append(np.diff(bounds))
            sizes = np.concatenate(size_of) if size_of else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_of, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return text_batches(docs).select(F.col(order_col).cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _id_counts(tokens: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n:
                    seen = np.bincount(np.frombuffer(raw, f"<u{len(raw) // n}"), minlength=len(total))
                    seen[: len(total)] += total
                    total = seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return text_batches(tokens).select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(tokens: DataFrame, path: str, shards: int | None = None) -> None:
    """Writes doc_id, n_tokens, ids in ascending doc_id order (nulls first, repeats of an id in order of their ids' hash and bytes).

    Shards are ranges of both, so the rows of a repeated or null id spread too.
    """
    spark = tokens.sparkSession
    # bounded by the vocabulary
    rows = _id_counts(tokens).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    bits = code_lengths(counts)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, block, start = Code(shared.value), TaskContext.get().partitionId(), 0, 0

        def close(docs: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
            nonlocal block, start
            ids = np.concatenate([np.frombuffer(raw, f"<u{len(raw) // n}" if n else "<u2") for _, n, raw in docs])
            offsets, packed = code.pack(ids)
            head = struct.pack(_HEAD, len(docs), len(ids), start) + bytes(d is None for d, _, _ in docs)
            payload = head + np.array([d or 0 for d, _, _ in docs], "<i8").tobytes() + np.array([n for _, n, _ in docs], "<u4").tobytes() + offsets.tobytes() + packed
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "docs": pa.array([len(docs)], pa.int64()), "ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})
            block, start = block + 1, start + len(ids)
            return out

        held, size = [], 0
        for batch in batches:
            for doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(doc)
                size += doc[1]
                if size >= BLOCK_IDS:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    spread = F.xxhash64("ids")
    ordered = tokens.select("doc_id", "n_tokens", "ids").repartitionByRange(shards or shuffle_partitions(spark), F.col("doc_id"), spread).sortWithinPartitions(F.col("doc_id"), spread, F.col("ids"))
    blocks = ordered.mapInArrow(run, "shard int, block int, docs long, ids long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from a dataset; blocks decode independently."""
    rows = spark.read.parquet(f"{path}/codebook").collect()
    bits = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        bits[r.id] = r.bits
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, starts, sizes, ids = decode(code, payload.as_buffer())
                width = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.full(len(docs), shard), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([raw[a * 4 : b * 4] for a, b in zip(width[:-1].tolist(), width[1:].tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "shard", "start", "n_tokens", "ids"],
                )

    stored = spark.read.parquet(f"{path}/blocks")
    decoded = stored.select("shard", "payload").mapInArrow(run, "doc_id long, shard int, start long, n_tokens long, ids binary")
    return decoded.join(F.broadcast(_bases(stored)), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def _bases(stored: DataFrame) -> DataFrame:
    """Ids before each shard; one row a shard, as many as the writer's range partitions."""
    totals = stored.groupBy("shard").agg(F.sum("ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def decode(code: Code, payload) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, starts in the shard, lengths and all ids of one block."""
    n_docs, n_ids, start = struct.unpack_from(_HEAD, payload)
    at = struct.calcsize(_HEAD)
    nulls = np.frombuffer(payload, np.uint8, n_docs, at)
    docs = np.frombuffer(payload, "<i8", n_docs, at := at + n_docs)
    sizes = np.frombuffer(payload, "<u4", n_docs, at := at + 8 * n_docs).astype(np.int64)
    lanes = -(-n_ids // LANE)
    offsets = np.frombuffer(payload, "<u8", lanes, at := at + 4 * n_docs)
    ids = code.unpack(n_ids, offsets, bytes(memoryview(payload)[at + 8 * lanes :]))
    return pa.array(docs, pa.int64(), mask=nulls.astype(bool)), start + np.cumsum(sizes) - sizes, sizes, ids


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, null ids first, null texts (the end id alone) and repeats included; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    tokens = written(token_table(docs, vocabulary_path()), "ids")
    path = new_path(spark, "huffman")
    write(tokens, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
