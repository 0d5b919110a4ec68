"""The whole scan of a folder or table of texts, put together from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import detect, flow, judge, summary, surface
from riskloom.sources import texts


def scan_files(files: DataFrame) -> dict[str, DataFrame]:
    """findings, summary, failures, hosts and settings of files (path, language, text)."""
    lines = texts.lines(files, "path", "language")
    found = detect.without_ignored(detect.findings(lines), lines)
    analysed = flow.flow_findings(files)
    verdicts = flow.sink_verdicts(files)
    judged = judge.judged(judge.taint_verdicts(found, verdicts))
    return {
        "findings": judged,
        "summary": summary.summary(judged),
        "flows": analysed.where("failure is null").drop("failure"),
        "failures": analysed.where("failure is not null").select("path", "failure"),
        "hosts": surface.external_hosts(lines),
        "settings": surface.settings_findings(files),
        "workflows": surface.workflow_findings(lines),
        "hidden": surface.hidden_text(files),
        "pins": surface.runtime_pins(lines),
    }


def scan_folder(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """As scan_files over a folder, with the files that were skipped and why."""
    files, skipped = texts.read_files(spark, root)
    return scan_files(files) | {"skipped": skipped, "tree": texts.tree_hash(files)}


def gate_of(parts: dict[str, DataFrame]) -> DataFrame:
    """The verdict on a scan's parts: what could not be analysed keeps it from passing."""
    counted = parts["summary"].select(F.col("n_findings").alias("findings"))
    failed = parts["failures"].agg((F.count("*") > 0).alias("coverage"))
    examined = parts["tree"].select(F.col("tree_hash").isNotNull().cast("int").alias("scanned"))
    # three tables of one row each
    row = counted.join(F.broadcast(failed), F.lit(True)).join(F.broadcast(examined), F.lit(True))
    return summary.gate(row.withColumn("source", F.col("findings") > 0).withColumn("vulnerable", F.lit(False)).withColumn("unchecked", F.lit(False)).withColumn("intel_missing", F.lit(False)))
