"""Sparse logistic regression by follow-the-regularised-leader updates, on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.io import text_batches

#: Labelled documents a classifier is fitted on at most, chosen by a hash of their ids.
TRAIN_ROWS = 12_000
THRESHOLD = 0.7

#: Features of a run of documents: hashed indices, values, and where each document's begin.
Features = tuple[np.ndarray, np.ndarray, np.ndarray]


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 and L2; index 0 is the bias and not shrunk by L1.

    With rising, no weight but the bias falls below 0: a feature can speak for label 1, never against it.
    A fixed bias is the score of a text without any feature and is not learnt.
    """

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float, rising: bool = False, fixed: float | None = None):
        self.alpha, self.beta, self.l1, self.l2, self.rising, self.fixed = alpha, beta, l1, l2, rising, fixed
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        bias = np.zeros(len(z), bool)
        bias[0] = isinstance(at, slice) or at[0] == 0
        l1 = np.where(bias, 0.0, self.l1)
        none = (z >= -l1) & ~bias if self.rising else np.abs(z) <= l1
        out = np.where(none, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return out if self.fixed is None else np.where(bias, self.fixed, out)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def in_fold(doc_id, folds: int, held_out: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, y of at most rows labelled documents outside the held-out fold.

    Labels are sampled first, so only their ids (rows at most, a bounded broadcast)
    meet the texts. An id with several labels takes the larger; one with several
    rows gives each of them.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def fit(sample: DataFrame, features: Callable[[pa.Array], Iterator[Features]], size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, rising: bool = False, fixed: float | None = None, support: int = 0) -> np.ndarray:
    """Weights as float32: features are made where the texts lie, the bounded rows are learnt in order by one task.

    With support, a feature counts that occurs in so many rows of label 1, and in four times as many of those as of others.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for index, value, begin in features(batch.column(1)):
                for a, b in zip(begin[:-1], begin[1:], strict=True):
                    own, place = np.unique(index[a:b], return_inverse=True)
                    at.append(own.astype("<u4").tobytes())
                    values.append(np.bincount(place, value[a:b], minlength=len(own)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "y", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(at, "<u4"), np.frombuffer(x, "<f4")) for batch in batches for y, at, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        model = Ftrl(size, alpha, beta, l1, l2, rising, fixed)
        if support:
            seen = np.zeros((2, size), np.int64)
            for y, at, _ in rows:
                seen[y, at] += 1
            keep = (seen[1] >= support) & (seen[1] >= 4 * seen[0])
            rows = [(y, at[keep[at]], x[keep[at]]) for y, at, x in rows]
        rows = [(float(y), np.concatenate([[0], at]), np.concatenate([[1.0], x])) for y, at, x in rows]
        for _ in range(epochs):
            for y, at, x in rows:
                model.learn(at, x, y)
        yield pa.RecordBatch.from_pydict({"w": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})

    made = text_batches(sample).select("doc_id", "text", "y").mapInArrow(make, "doc_id long, y int, at binary, x binary")
    ordered = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "at")
    row = ordered.mapInArrow(learn, "w binary").first()
    if row is None:
        # no labelled rows at all: nothing speaks for either label
        nothing = np.zeros(size, "<f4")
        nothing[0] = fixed or 0.0
        return nothing
    return np.frombuffer(row.w, "<f4")
