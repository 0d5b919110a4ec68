"""Sums of fixed-size count arrays over all rows, added up in two levels of bounded groups."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskloom.llm.io import forget, written

PARTS = 16
DEALS = 64


def tally(rows: DataFrame, counts_of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all Arrow batches of counts_of(batch), an array of this size."""
    width = -(-size // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * PARTS, np.int64)
        for batch in batches:
            total[:size] += counts_of(batch)
        blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(total, PARTS)]
        deal = TaskContext.get().partitionId() % DEALS
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "deal": pa.array([deal] * PARTS, pa.int32()), "counts": pa.array(blobs, pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for raw in group["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.int64)
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    made = rows.mapInArrow(run, "part int, deal int, counts binary")
    added = made.groupBy("part", "deal").applyInArrow(add, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    out = np.zeros(width * PARTS, np.int64)
    added = written(added, "tally")
    for row in added.collect():
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    forget(added)
    return out[:size]
