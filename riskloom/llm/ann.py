"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is then put into a leaf. A
query walks the tree through a priority queue of bins by distance to their
centres, so leaves come out nearest first. How many leaves a search visits is
calibrated: a bounded set of calibration queries is answered exactly against all
rows, and leaves are widened until the share of true neighbours among the
visited leaves reaches the target. A search also goes on until its leaves hold
enough rows for k answers. Distances of what is visited are exact.

A leaf with many rows is split into parts of bounded size by a hash of the id,
so neither a common vector nor a dense region lands in one task.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.io import table, written
from riskloom.llm.vectors import best, by_dims, clean, matrix

K = 10
QUERY_EVERY = 100
#: Rows the tree is fitted on: so many, or with large tables this factor times the square root of their rows, up to the most.
SAMPLE_ROWS, SAMPLE_ROOT, SAMPLE_MOST = 8192, 24, 400_000
#: Queries that calibrate it.
CALIBRATION_QUERIES = 64
TARGET_RECALL = 0.97
BRANCHES = 8
LEAF_ROWS = 64
#: Rows of a part of a leaf, on average, and cells of differences held at once.
PART_ROWS = 4096
CELLS = 1 << 20


class Tree:
    """Centres by node; a node's children are a range of nodes, a leaf has a number."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, children, leaf, todo, leaves = [sample.mean(0)], [None], [-1], [(0, np.arange(len(sample)))], 0
        while todo:
            node, rows = todo.pop()
            own = _k_means(sample[rows], branches, rng) if len(rows) > leaf_rows else None
            if own is None:
                leaf[node], leaves = leaves, leaves + 1
                continue
            mids, label = own
            children[node] = (len(centres), len(centres) + len(mids))
            for j, mid in enumerate(mids):
                todo.append((len(centres), rows[label == j]))
                centres.append(mid)
                children.append(None)
                leaf.append(-1)
        self.centres, self.children, self.leaf, self.leaves = np.array(centres), children, leaf, leaves

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            span = self.children[node]
            if span is None:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _squares(x[rows], self.centres[slice(*span)]).argmin(1)
                todo += [(span[0] + j, rows[near == j]) for j in range(span[1] - span[0])]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            span = self.children[node]
            if span is None:
                yield self.leaf[node]
            else:
                gap = ((self.centres[slice(*span)] - q) ** 2).sum(1)
                for j, d in enumerate(gap.tolist()):
                    heapq.heappush(queue, (d, span[0] + j))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2.0 * (x @ c.T)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8):
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return None
    mids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        label = _squares(x, mids).argmin(1)
        used = np.unique(label)
        mids = np.array([x[label == j].mean(0) for j in used])
    label = _squares(x, mids).argmin(1)
    used, label = np.unique(label, return_inverse=True)
    return (mids[used], label) if len(used) > 1 else None


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances, each from its own differences in double precision."""
    out = np.empty((len(q), len(c)))
    step = max(1, CELLS // max(1, c.size))
    for a in range(0, len(q), step):
        gap = q[a : a + step, None, :] - c[None, :, :]
        out[a : a + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


class Search:
    """An index over rows (vec_id, dims, vector) of one length of vector."""

    def __init__(self, rows: DataFrame, dims: int, k: int = K, target: float = TARGET_RECALL, sample_rows: int | None = None):
        self.spark, self.k, self.dims = rows.sparkSession, k, dims
        rows = rows.where(F.col("dims") == dims)
        # leaves grow in number and in rows alike, with the root of the table
        sample_rows = sample_rows or min(SAMPLE_MOST, max(SAMPLE_ROWS, int(SAMPLE_ROOT * rows.count() ** 0.5)))
        # bounded samples, in order of a hash of the id; what calibrates the tree has not made it
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "vector").limit(sample_rows + CALIBRATION_QUERIES).toArrow()
        fitted = sample.slice(min(CALIBRATION_QUERIES, sample.num_rows // 2))
        self.tree = Tree(matrix(fitted["vector"], dims)) if sample.num_rows else None
        self.index = written(self._assigned(rows), "leaves")
        counts = self.index.groupBy("leaf").count().collect()
        self.sizes = np.zeros(self.tree.leaves if self.tree else 0, np.int64)
        for leaf, n in counts:
            self.sizes[leaf] = n
        self.parts = np.maximum(1, -(-self.sizes // PART_ROWS))
        self.visits = self._calibrate(sample.slice(0, CALIBRATION_QUERIES), target) if self.tree else 0

    def _assigned(self, rows: DataFrame) -> DataFrame:
        tree = self.spark.sparkContext.broadcast(pickle.dumps(self.tree))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(tree.value)
            for _, part, x in by_dims(batches, 2, 1):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.assign(x), pa.int64())], names=["vec_id", "dims", "vector", "leaf"])

        return rows.select("vec_id", "dims", "vector").mapInArrow(run, "vec_id long, dims int, vector array<double>, leaf long")

    def _calibrate(self, sample: pa.Table, target: float) -> int:
        """Leaves to visit so that the calibration queries' true neighbours lie in them to the target."""
        ids, q = sample["vec_id"].to_numpy(), matrix(sample["vector"], self.dims)
        shared, k = self.spark.sparkContext.broadcast((ids, q)), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_ids, own = shared.value
            for _, part, x in by_dims(batches, 2, 1):
                part_ids, leaf = part.column(0).to_numpy(), part.column(3).to_numpy()
                order = np.argsort(part_ids, kind="stable")
                d = _distances(own, x[order])
                d[own_ids[:, None] == part_ids[order][None, :]] = np.inf
                row, at, value = best(d, np.arange(len(order)), k)
                yield pa.RecordBatch.from_pydict({"query": pa.array(row, pa.int64()), "vec_id": pa.array(part_ids[order][at], pa.int64()), "score": pa.array(value), "leaf": pa.array(leaf[order][at], pa.int64())})

        near = self.index.select("vec_id", "dims", "vector", "leaf").mapInArrow(run, "query long, vec_id long, score double, leaf long")
        # two levels, so that no group grows with the table's batches alone
        first = near.groupBy("query", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("deal")).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id", "leaf"))), 1, k).alias("top"))
        top = first.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")).collect()
        needed = []
        for row in top:
            order = {leaf: i for i, leaf in enumerate(self.tree.visit(q[row.query]))}
            needed += [order[hit.leaf] for hit in row.top]
        needed.sort()
        return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] + 1 if needed else 1

    def nearest(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score of each query's k nearest found; its own id is no answer."""
        spark, k, visits = self.spark, self.k, self.visits
        tree, sizes, parts = spark.sparkContext.broadcast(pickle.dumps(self.tree)), self.sizes, self.parts

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(tree.value)
            for _, part, x in by_dims(batches, 2, 1):
                at, leaves, splits = [], [], []
                for i in range(len(x)):
                    held = 0
                    for n, leaf in enumerate(own.visit(x[i])):
                        # an id's own rows don't count; twice k leaves room for them
                        if n >= visits and held > 2 * k:
                            break
                        held += int(sizes[leaf])
                        if sizes[leaf]:
                            for s in range(int(parts[leaf])):
                                at.append(i)
                                leaves.append(leaf)
                                splits.append(s)
                taken = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(2), pa.array(leaves, pa.int64()), pa.array(splits, pa.int64())], names=["query_id", "query", "leaf", "part"])

        def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = ([], [], [])
            if left.num_rows and right.num_rows:
                right = right.sort_by("vec_id")
                ids, c = right["vec_id"].to_numpy(), matrix(right["vector"], dims)
                q_ids, q = left["query_id"].to_numpy(), matrix(left["query"], dims)
                for a in range(0, len(q), 256):
                    d = _distances(q[a : a + 256], c)
                    d[q_ids[a : a + 256, None] == ids[None, :]] = np.inf
                    row, vec, value = best(d, ids, k)
                    for have, more in zip(out, (q_ids[a + row], vec, value), strict=True):
                        have.append(more)
            return pa.table({n: pa.array(np.concatenate(x) if x else [], t) for n, x, t in zip(("query_id", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

        dims = self.dims
        asked = queries.where(F.col("dims") == dims).dropDuplicates(["vec_id", "vector"]).select("vec_id", "dims", "vector")
        split = F.create_map(*[F.lit(int(v)) for leaf in np.flatnonzero(parts > 1) for v in (leaf, parts[leaf])]) if (parts > 1).any() else None
        part = F.pmod(F.xxhash64("vec_id"), F.coalesce(split[F.col("leaf").cast("int")], F.lit(1))) if split is not None else F.lit(0)
        stored = self.index.select("vec_id", "vector", "leaf", part.cast("long").alias("part"))
        visited = asked.mapInArrow(walk, "query_id long, query array<double>, leaf long, part long")
        keys = ["leaf", "part"]
        found = visited.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
        hit = F.struct("score", "vec_id")
        first = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("deal")).agg(F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("top"))
        top = first.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        return top.select("query_id", F.posexplode("top").alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, target: float = TARGET_RECALL) -> DataFrame:
    """Each query's k nearest rows found, by length of vector: vectors of other lengths are no candidates.

    Rows and queries are (vec_id, dims, vector). Fewer than k candidates give all
    of them; empty tables give no rows; rows that repeat count each time.
    """
    lengths = [r.dims for r in rows.groupBy("dims").count().orderBy(F.desc("count")).collect()]
    found = [Search(rows, d, k, target).nearest(queries) for d in lengths]
    out = found[0] if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null, zero or holding null or non-finite numbers take no part; ties go to the smaller id; an empty table gives no rows; see nearest."""
    rows = written(clean(table(spark, sf_dir, "embeddings"), nonzero=True), "vectors")
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))
