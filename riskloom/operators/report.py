"""Findings and components as exchange documents, one JSON text a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.package import purl


def sarif_level(severity: Column, decision: Column) -> Column:
    return F.when((decision == "block") | severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_results(found: DataFrame) -> DataFrame:
    """A SARIF result for each finding; a run's results can be of any number, so they stay rows."""
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity"), F.col("decision")).alias("level"), F.struct(F.col("evidence").alias("text")).alias("message"), F.array(location).alias("locations"), F.struct(F.col("id").alias("findingId")).alias("partialFingerprints"))
    return found.select("path", F.to_json(result).alias("result"))


def cyclonedx_components(checks: DataFrame) -> DataFrame:
    """A CycloneDX component for each purl, with the heaviest verdict."""
    weight = F.when(F.col("verdict").isin("malicious", "not_found"), 3).when(F.col("verdict") == "vulnerable", 2).otherwise(1)
    own = checks.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version"))).groupBy("purl").agg(F.max_by(F.struct("name", "version", "verdict"), F.struct(weight, "verdict")).alias("c"))
    component = F.struct(F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), F.col("c.name").alias("name"), F.col("c.version").alias("version"), "purl", F.array(F.struct(F.lit("verdict").alias("name"), F.col("c.verdict").alias("value"))).alias("properties"))
    return own.select("purl", F.to_json(component).alias("component"))


def markdown(summary_row: dict, rules: list[dict]) -> str:
    """A short report from counts already made: one row of totals, and the rules in the order to act on."""
    head = ["# Scan report", "", f"Findings: {summary_row['n_findings']} at {summary_row['n_locations']} places; blocked: {'yes' if summary_row['blocked'] else 'no'}", "", "| # | rule | severity | decision | findings | files |", "|-|-|-|-|-|-|"]
    return "\n".join(head + [f"| {r['place']} | {r['rule_id']} | {r['severity']} | {r['decision']} | {r['n']} | {r['n_files']} |" for r in rules]) + "\n"
