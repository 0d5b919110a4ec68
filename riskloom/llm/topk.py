"""Exact top-k by inner product: tiles of queries and shards, partial selection, tree merging.

Queries stand in blocks of bounded size, candidates in shards of bounded size. A
tile is one block against one shard: a matrix product, a partial selection of
each query's k best, ties to the smaller id. A query's lists from all shards are
merged FAN_IN at a time until one is left, so no task ever sees more than
FAN_IN lists of k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.io import table, written
from riskloom.llm.vectors import best, clean, matrix

K = 5
QUERY_EVERY = 50
#: Rows of a query block and of a shard, on average.
BLOCK_ROWS = 2048
SHARD_ROWS = 8192
#: Cells of a score matrix held at once.
CELLS = 1 << 21
FAN_IN = 16
#: Sums up to here are exact in doubles.
EXACT = 2.0**53


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64: exact; beyond 64 bits the nearest bound."""
    reach = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1]
    if reach < EXACT:
        return q @ c.T
    big = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
    return np.clip(big, -(2**63), 2**63 - 1)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest inner products, ties to the smaller id.

    Both sides are (vec_id, dims, vector of whole numbers); a query's own id is
    none of its candidates, and only vectors of one length meet. Fewer than k
    candidates give all of them; a query without any, and empty tables, give no
    rows. A candidate row that repeats counts once for each time; a query row
    that repeats is answered once.
    """
    queries = queries.dropDuplicates(["vec_id", "dims", "vector"])
    blocks = max(1, -(-queries.count() // block_rows))
    shards = max(1, -(-candidates.count() // shard_rows))
    # columns of their own names: both sides may stem from one table
    side_q = queries.select(
        F.col("vec_id").alias("query_id"), F.col("dims").alias("q_dims"), F.col("vector").alias("query"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("q_block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("q_shard"),
    )
    side_c = candidates.select(
        F.col("vec_id").alias("candidate_id"), F.col("dims").alias("c_dims"), F.col("vector").alias("candidate"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).alias("c_shard"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("c_block"),
    )

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard, dims = key[1].as_py(), key[2].as_py()
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            right = right.sort_by("candidate_id")
            ids = right["candidate_id"].to_numpy()
            c = matrix(right["candidate"], dims)
            q_ids, q = left["query_id"].to_numpy(), matrix(left["query"], dims)
            step = max(1, CELLS // len(ids))
            for a in range(0, len(q_ids), step):
                scores = _products(q[a : a + step], c)
                if scores.dtype == object:
                    rows = _best_whole(scores, ids, q_ids[a : a + step], k)
                else:
                    own = -scores
                    own[q_ids[a : a + step, None] == ids[None, :]] = np.inf
                    row, vec, value = best(own, ids, k)
                    rows = q_ids[a + row].tolist(), vec.tolist(), (-value).astype(np.int64).tolist()
                for name, part in zip(out, rows, strict=True):
                    out[name] += part
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "shard": pa.array([shard] * len(out["vec_id"]), pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    tiles = side_q.groupBy("q_block", "q_shard", "q_dims").cogroup(side_c.groupBy("c_block", "c_shard", "c_dims")).applyInArrow(tile, "query_id long, shard long, vec_id long, score long")
    return merge_tree(tiles, shards, k)


def _best_whole(scores: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """As best(), for scores beyond exact doubles."""
    out: tuple[list, list, list] = ([], [], [])
    for i, q in enumerate(q_ids.tolist()):
        rows = sorted((-int(s), int(v)) for s, v in zip(scores[i], ids.tolist(), strict=True) if v != q)[:k]
        out[0].extend([q] * len(rows))
        out[1].extend(v for _, v in rows)
        out[2].extend(-s for s, _ in rows)
    return out


def merge_tree(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """Each query's k best of (query_id, shard, vec_id, score), largest first, FAN_IN shards' lists at a time."""
    entry = F.struct((-F.col("score")).alias("less"), F.col("vec_id"), F.col("score"))
    while True:
        shards = -(-shards // FAN_IN)
        lists = rows.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("query_id", "shard").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
        at = lists.select("query_id", "shard", F.posexplode("top").alias("place", "hit"))
        rows = at.select("query_id", "shard", F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"), (F.col("place") + 1).cast("int").alias("rank"))
        if shards <= 1:
            return rows.select("query_id", "rank", "vec_id", "score")


def whole_numbers(rows: DataFrame) -> DataFrame:
    """floor(256 * x) of every component."""
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256.0).cast("double")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null or holding null or non-finite numbers take no part; fewer candidates give fewer ranks; an id on several rows is several candidates, none of its own queries'; ties go to the smaller id; an empty table gives no rows."""
    rows = written(whole_numbers(clean(table(spark, sf_dir, "embeddings"))), "vectors")
    return top_k(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
