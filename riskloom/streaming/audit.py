"""Audit events and feed updates as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.packages import upsert

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; events later than the watermark allows no longer count."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def append_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append-only JSON by day."""
    dated = stream.withColumn("day", F.to_date("ts"))
    return dated.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start()


def scan_events(found: DataFrame, tool: str) -> DataFrame:
    """Findings as audit events: hashes, never the text itself."""
    kind = F.when(F.col("decision") == "block", "block").when(F.col("decision") == "warn", "warn").otherwise("approve")
    return found.select(F.lit(tool).alias("tool"), kind.alias("event_type"), "rule_id", "decision", F.sha2("path", 256).alias("target_hash"), F.col("id").alias("finding_id"))


def keep_current(stream: DataFrame, folder: str, checkpoint: str, key: str, newest: str, cap: int) -> StreamingQuery:
    """A keyed table of the newest rows, rewritten version by version; the last complete version is the current one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        last = f"{folder}/v={number - 1}"
        if number > 0 and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{last}/_SUCCESS")):
            raise RuntimeError(f"{last} is not complete; merging without it would lose the table")
        before = spark.read.schema(batch.schema).parquet(last) if number > 0 else batch.limit(0)
        upsert(before, batch, key, newest, cap).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
