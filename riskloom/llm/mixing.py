"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, the source's
target over its size, so the running sum of expected copies before a document is
its rank times that rate. With one random offset u a source, a document is
emitted floor((rank + 1) * rate + u) - floor(rank * rate + u) times: once for
every integer boundary its stretch crosses. Documents stand in order of size
class, so the words taken come near the target, and no document exceeds the
ceiling of the rate, MOST copies at most.

A rank over a whole source is never sorted in one task. Documents are dealt into
(source, size class, bucket) cells, the number of buckets growing with the table;
cells are counted, the counts are summed up in two levels (classes in a source,
buckets in a class), and only within one cell are rows numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.io import free_name, table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
#: Rows of the whole table for each bucket.
ROWS_PER_BUCKET = 20_000
SEED = "riskloom-mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(*parts: Column) -> Column:
    """32 bits of an md5, alike in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Bit length and the three bits after the leading one: classes an eighth of an octave wide."""
    bits = F.length(F.bin(size)).cast("long")
    return bits * 8 + F.when(bits > 3, F.expr("size >> cast(length(bin(size)) - 4 as int)") % 8).otherwise(size)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target from rows (source, size, ...): weights share all words; none above most times its size.

    The cap is water-filling in closed form: with sources in order of cap over
    weight, the level is the first at which the rest, shared by weight, stays
    below its caps.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, most: float = MOST, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for rows (doc_id, source, size).

    Null sources form a source of their own, the last. A source without words has
    target 0 and copies 0. Rows that repeat are sampled each for itself. Null ids
    take part and stand first. An empty table gives no rows.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col), "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    buckets = max(1, -(-base.count() // rows_per_bucket))
    cells = base.withColumn("class", size_class(F.col("size"))).withColumn("bucket", _hash32(F.lit(SEED), id_text) % F.lit(buckets))
    named = cells.withColumn("has_source", F.col("source").isNotNull()).withColumn("source_key", F.coalesce("source", F.lit("")))
    cell = ["has_source", "source_key", "class", "bucket"]
    counted = named.groupBy(*cell).agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    rolled = counted.groupBy(*cell[:3]).agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    above = rolled.select(*cell[:3], F.coalesce(F.sum("rows").over(Window.partitionBy(*cell[:2]).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_in_classes"))
    shares = targets(rolled.select(F.when(F.col("has_source"), F.col("source_key")).alias("source"), F.col("words").alias("size")), weights, most)
    shares = shares.select(F.col("source").isNotNull().alias("has_source"), F.coalesce("source", F.lit("")).alias("source_key"), "source_size", "target")
    inside = Window.partitionBy(*cell[:3]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.select(*cell, F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("rows_in_buckets"))
        .join(above, cell[:3])
        .join(shares, cell[:2])
        .select(*cell, (F.col("rows_in_classes") + F.col("rows_in_buckets")).alias("rows_before"), "source_size", "target")
    )
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("size", id_col))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash32(F.lit(SEED + "-offset"), F.col("source_key")) / F.lit(4294967296.0)
    return (
        named.withColumn("rank", rank)
        .join(starts, cell)
        .withColumn("at", (F.col("rows_before") + F.col("rank")).cast("double"))
        .withColumn("rate", rate)
        .withColumn("u", offset)
        .withColumn("copies", F.floor(F.col("at") * F.col("rate") + F.col("u")) - F.floor((F.col("at") - 1) * F.col("rate") + F.col("u")))
        .select(id_col, "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mixed documents: each row of docs (doc_id, text, source, ...) as often as the mix takes it, other columns kept.

    Copies are decided per (doc_id, source, size); rows that agree in all three
    share the copies their group is given, in order of their text's hash. Columns of
    any names stay as they are. A null text has no words; an empty table gives no rows.
    """
    columns = docs.columns
    size, nth, times = free_name(columns, "mix_size"), free_name(columns, "mix_nth"), free_name(columns, "mix_copies")
    sized = docs.withColumn(size, word_count(F.col("text")))
    key = ["doc_id", "source", size]
    sizes = written(sized.select("doc_id", "source", F.col(size).alias("size")), "sizes")
    taken = copies(sizes, weights=weights, most=most).select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "copies")
    own = Window.partitionBy("t_id", "t_source", "t_size").orderBy("copies")
    taken = taken.select("t_id", "t_source", "t_size", F.row_number().over(own).alias("t_nth"), F.col("copies").alias(times)).where(F.col(times) > 0)
    # the other side's names are set apart from all columns of docs
    apart = {c: free_name(columns, c) for c in ("t_id", "t_source", "t_size", "t_nth")}
    taken = taken.withColumnsRenamed(apart)
    numbered = sized.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    same = [F.col(a).eqNullSafe(F.col(apart[b])) for a, b in zip([*key, nth], ("t_id", "t_source", "t_size", "t_nth"), strict=True)]
    out = numbered.join(taken, same, "inner")
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(nth)).select(*columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents, null ids, null sources, null texts (no words) and repeats included; an empty table gives no rows; see copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return copies(written(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
classed AS (
  SELECT *, source IS NOT NULL AS has_source, coalesce(source, '') AS source_key, CAST(length(bin(size)) AS BIGINT) AS bits,
    CAST('0x' || substr(md5('riskloom-mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      % (SELECT greatest(1, CAST(ceil(count(*) / 20000.0) AS BIGINT)) FROM documents) AS bucket
  FROM sized),
celled AS (
  SELECT *, bits * 8 + CASE WHEN bits > 3 THEN (size >> (bits - 4)) % 8 ELSE size END AS class FROM classed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY has_source, source_key ORDER BY class, bucket, size, doc_id NULLS FIRST) AS rnk FROM celled),
by_source AS (
  SELECT has_source, source_key, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY has_source DESC, source_key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM celled GROUP BY has_source, source_key),
capped AS (SELECT *, 3 * source_size::DOUBLE AS cap, 3 * source_size::DOUBLE / weight AS ratio FROM by_source),
levelled AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, has_source DESC, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, has_source DESC, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
shared AS (
  SELECT has_source, source_key, source_size, least(cap, coalesce(water * weight, cap)) AS target
  FROM (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM levelled)),
rated AS (
  SELECT r.*, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('riskloom-mix-1-offset|' || r.source_key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked r JOIN shared s USING (has_source, source_key)),
counted AS (SELECT *, CAST(floor(rnk * rate + u) - floor((rnk - 1) * rate + u) AS BIGINT) AS copies FROM rated)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM counted
"""
