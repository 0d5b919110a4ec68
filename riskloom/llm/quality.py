"""Quality classifier: hashed word n-grams, FTRL logistic regression, sparse dot products.

Words are runs of letters and digits or of other signs. Features are single words
and pairs, lower-cased, and triples of word shapes (case, digits, length, which
sign), each a share of the text's words, so a text of any length scores on one
scale and scoring is one weighted sum over the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.io import table, text_batches
from riskloom.llm.linear import THRESHOLD, Features, fit, in_fold, labelled_sample, sigmoid
from riskloom.llm.textkernel import mix, running, slices, span_hashes

FOLDS, HELD_OUT = 4, 2
BITS = 18
SCALE = 8.0

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = 1
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[128:] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of one kind of byte, and where each document's begin."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    if len(data):
        change[1:-1] = kind[1:] != kind[:-1]
        change[bounds] = True
    edge = np.flatnonzero(change)
    starts, ends = edge[:-1], edge[1:]
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    return starts, ends, np.searchsorted(starts, bounds)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small number for each word: the sign and how often, or case, digits and length."""
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int32)])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    size = (ends - starts).astype(np.int64)
    ups, digits = upper[ends] - upper[starts], digit[ends] - digit[starts]
    case = np.where(ups == 0, 0, np.where(ups == size, 2, np.where((ups == 1) & (_UPPER[data[starts]] == 1), 1, 3)))
    letters = 256 + case * 64 + (digits > 0) * 16 + np.minimum(size // 4, 15)
    return np.where(_KIND[data[starts]] == 2, data[starts].astype(np.int64) * 4 + np.minimum(size, 4) - 1, letters + 1024)


def features(texts: pa.Array) -> Iterator[Features]:
    mask = np.uint64((1 << BITS) - 1)
    for _, _, data, bounds in slices(texts):
        starts, ends, first = runs(data, bounds)
        word = span_hashes(data, starts, ends, total=running(data))
        shape = mix(shapes(data, starts, ends).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        n = len(word)
        pair, triple = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        pair[: n - 1] = word[:-1] * np.uint64(3) + word[1:]
        triple[: max(n - 2, 0)] = shape[: max(n - 2, 0)] * np.uint64(9) + shape[1 : max(n - 1, 1)] * np.uint64(5) + shape[2:]
        index = np.empty((n, 3), np.int64)
        for j, h in enumerate((word, mix(pair + np.uint64(1)), mix(triple + np.uint64(2)))):
            index[:, j] = h & mask
        value = np.ones((n, 3))
        # pairs and triples end with their document
        last = first[1:][np.diff(first) > 0] - 1
        value[last, 1:] = 0
        value[np.maximum(last - 1, 0), 2] = 0
        counts = np.diff(first)
        value *= np.repeat(SCALE / np.maximum(counts, 1), counts)[:, None]
        # index 0 is the bias
        yield np.maximum(index, 1).reshape(-1), value.reshape(-1), first * 3


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learnt from a bounded sample of labelled rows outside the held-out fold.

    An id with several labels counts as good if one says so, one with several rows is
    learnt from each; null ids and null labels teach nothing. Without labels all
    weights are 0 and every text scores 0.5.
    """
    return fit(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT), features, 1 << BITS, alpha=0.5, beta=1.0, l1=0.02, l2=0.0, epochs=2)


def score(docs: DataFrame, weights: np.ndarray, column: str = "quality_score") -> DataFrame:
    """docs (any columns, text among them) with the chance that label 1 holds in a column of this name, which docs must lack.

    A null text scores as an empty one; a long text is read whole; rows that repeat
    score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = []
            for index, value, begin in features(batch.column(at)):
                total = np.concatenate([[0.0], np.cumsum(w[index] * value)])
                out.append(sigmoid(total[begin[1:]] - total[begin[:-1]] + w[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*batch.schema.names, column])

    return text_batches(docs).mapInArrow(run, docs.select("*", F.lit(0.0).cast("double").alias(column)).schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, null ids, null texts and repeats included; see train and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, weights, "score")
    return out.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
