"""Vectors as dense blocks: what the exact and the approximate search share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Not null, not empty, every component finite (and one not zero)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite
    return ok & F.exists(vector, lambda x: x != 0) if nonzero else ok


def clean(rows: DataFrame, nonzero: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dims, vector (doubles) of the rows that take part; a null id takes none."""
    vector = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector"), nonzero)).select("vec_id", F.size("vector").alias("dims"), "vector")


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64, copy=False)


def by_dims(batches: Iterator[pa.RecordBatch], vector_col: int, dims_col: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Each batch's rows of one length of vector at a time."""
    for batch in batches:
        dims = batch.column(dims_col).to_numpy()
        for d in np.unique(dims):
            part = batch if (dims == d).all() else batch.filter(pa.array(dims == d))
            yield int(d), part, matrix(part.column(vector_col), int(d))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of each row's k smallest scores, ties to smaller ids; non-finite scores are none.

    ids ascend along the columns. A partial selection finds the k-th score; only
    what is at or below it is sorted.
    """
    if scores.shape[1] > k:
        edge = np.partition(scores, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((scores <= edge) & np.isfinite(scores))
    else:
        row, column = np.nonzero(np.isfinite(scores))
    value = scores[row, column]
    order = np.lexsort((column, value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], ids[column[keep]], value[keep]
