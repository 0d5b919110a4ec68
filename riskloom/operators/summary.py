"""Counts, distributions and the release verdict over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.judge import path_class
from riskloom.ranks import DECISION, SEVERITY, name_of, rank

# fixed values: criteria that block a release, and those that make it conditional, in order
BLOCKING = ("unsupported_platform", "malicious", "registry_rejected", "not_found", "kev", "critical")
CONDITIONAL = ("vulnerable", "cooldown", "unchecked", "suspicious_name", "version_not_found", "source", "license", "unpinned", "malicious_possible", "dependency_truncated", "trust", "coverage", "intel_stale", "intel_old_format")


def summary(found: DataFrame) -> DataFrame:
    """One row of counts over findings not suppressed."""
    live = found.where(~F.coalesce(F.col("suppressed"), F.lit(False))) if "suppressed" in found.columns else found
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY] + [F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in DECISION]
    return live.agg(F.count("*").alias("n_findings"), F.count_distinct("path", "line_no").alias("n_locations"), *counts, F.coalesce(F.bool_or(F.col("decision") == "block"), F.lit(False)).alias("blocked"), name_of(SEVERITY, F.max(rank(SEVERITY, "severity"))).alias("highest"))


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id", "severity", "decision").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))


def by_path_class(found: DataFrame) -> DataFrame:
    return found.groupBy(path_class(F.col("path")).alias("path_class")).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "block").alias("n_block"))


def by_file(found: DataFrame) -> DataFrame:
    """Files by highest severity and count, then path."""
    return found.groupBy("path").agg(F.count("*").alias("n"), name_of(SEVERITY, F.max(rank(SEVERITY, "severity"))).alias("highest"))


def adjustment_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("adjustments").alias("a")).groupBy(F.col("a.step").alias("step")).agg(F.count("*").alias("n"))


def multi_rule_lines(found: DataFrame) -> DataFrame:
    return found.groupBy("path", "line_no").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"), F.count_distinct("rule_id").alias("n_rules")).where("n_rules >= 2")


def action_tier(severity: Column, decision: Column) -> Column:
    return F.when(decision == "block", 0).when(severity.isin("critical", "high"), 1).otherwise(2)


def action_order(found: DataFrame) -> DataFrame:
    """Rules in the order to act on: blocks, then critical and high, then the rest; by severity, count and id within."""
    from pyspark.sql import Window

    tiers = by_rule(found).withColumn("tier", action_tier(F.col("severity"), F.col("decision")))
    # a row for each rule, severity and decision: as many as the rule set allows
    return tiers.withColumn("place", F.row_number().over(Window.orderBy("tier", rank(SEVERITY, "severity").desc(), F.col("n").desc(), "rule_id")))


def rollup(found: DataFrame, *columns: str) -> DataFrame:
    """All one-column counts and the total in one pass."""
    sets = [[F.col(c)] for c in columns] + [[]]
    return found.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def gate(flags: DataFrame) -> DataFrame:
    """The verdict of one row of criteria flags: blocked, undetermined, conditional or approved, with the criteria that say so.

    flags: a boolean for each criterion, scanned (files examined), findings, intel_missing.
    Nothing examined, gaps alone, or missing feeds never pass.
    """
    have = lambda names: F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in names if c in flags.columns]))
    blocks, conditions = have(BLOCKING), have(CONDITIONAL)
    nothing = (F.col("scanned") == 0) & (F.col("findings") == 0) & ~F.coalesce(F.col("vulnerable"), F.lit(False)) & ~F.coalesce(F.col("unchecked"), F.lit(False))
    undetermined = nothing | (conditions == F.array(F.lit("coverage"))) | F.coalesce(F.col("intel_missing"), F.lit(False))
    verdict = F.when(F.size(blocks) > 0, "blocked").when(undetermined, "undetermined").when(F.size(conditions) > 0, "conditional").otherwise("approved")
    keep = [F.col(c) for c in flags.columns if c not in (*BLOCKING, *CONDITIONAL, "scanned", "findings", "intel_missing")]
    return flags.select(*keep, verdict.alias("verdict"), F.array_join(blocks, ",").alias("block_reasons"), F.array_join(conditions, ",").alias("conditional_criteria"), exit_code(verdict).alias("exit_code"))


def exit_code(verdict: Column) -> Column:
    """0 pass, 1 conditional, 2 blocked, 3 undetermined."""
    return F.when(verdict == "approved", 0).when(verdict == "conditional", 1).when(verdict == "blocked", 2).otherwise(3)
