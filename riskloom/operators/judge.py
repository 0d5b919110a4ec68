"""Ordered, lower-only judgement of findings, duplicates, profiles and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.ranks import CONFIDENCE, DECISION, ENGINE, SEVERITY, name_of, rank
from riskloom.rules.cards import CONSTRUCT_RULES, EXPOSURE

# fixed values: path segments by class, first class that matches counts
UPLOAD_SEGMENTS = ("uploads", "upload", "user-data", "userdata", "attachments")
SAMPLE_SEGMENTS = ("samples", "sample", "examples", "example", "demo", "demos", "fixtures")
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "e2e")
BUILD_SEGMENTS = ("scripts", "tools", "build", "ci")
PATH_CLASSES = ("runtime", "test", "sample", "upload-data", "build-tool")


def path_class(path: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), lambda x: x != "")
    folders, name = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    has = lambda names: F.exists(folders, lambda x: x.isin(*names))
    return (
        F.when(path.isNull() | (F.size(parts) == 0), "runtime")
        .when(has(UPLOAD_SEGMENTS), "upload-data")
        .when(has(SAMPLE_SEGMENTS), "sample")
        .when(has(TEST_SEGMENTS) | name.rlike(r"(^test_|_test\.|\.test\.|\.spec\.)"), "test")
        .when(F.get(folders, F.lit(0)).isin(*BUILD_SEGMENTS) | name.rlike(r"(^makefile$|\.config\.[a-z]+$)"), "build-tool")
        .otherwise("runtime")
    )


def value_based() -> Column:
    """Evidence is a value, not the shape of code."""
    return F.col("category").isin(*EXPOSURE) | (F.col("engine") == "secret-file")


def lowered(found: DataFrame, when: Column, step: str, reason: str, severity: str | None = None, decision: str | None = None) -> DataFrame:
    """Severity and decision of the rows brought down to these at most; a step that changes nothing leaves no trace."""
    when = F.coalesce(when, F.lit(False))
    to_severity = F.col("severity") if severity is None else F.when(when & (rank(SEVERITY, "severity") > SEVERITY[severity]), F.lit(severity)).otherwise(F.col("severity"))
    cap = decision or ("warn" if severity == "low" else None)
    to_decision = F.col("decision") if cap is None else F.when(when & (rank(DECISION, "decision") > DECISION[cap]), F.lit(cap)).otherwise(F.col("decision"))
    entry = F.struct(F.lit(step).alias("step"), F.col("severity").alias("from_severity"), to_severity.alias("to_severity"), F.col("decision").alias("from_decision"), to_decision.alias("to_decision"), F.lit(reason).alias("reason"))
    changed = (to_severity != F.col("severity")) | (to_decision != F.col("decision"))
    return found.select(*[c for c in found.columns if c not in ("severity", "decision", "adjustments")], to_severity.alias("severity"), to_decision.alias("decision"), F.when(changed, F.array_append("adjustments", entry)).otherwise(F.col("adjustments")).alias("adjustments"))


def test_paths(found: DataFrame) -> DataFrame:
    return lowered(found, (path_class(F.col("path")) == "test") & value_based(), "test_path", "value in a test path", "low")


def upload_data(found: DataFrame) -> DataFrame:
    return lowered(found, (path_class(F.col("path")) == "upload-data") & ~value_based(), "upload_data", "code shape in uploaded data", "low")


def prohibition_prose(found: DataFrame) -> DataFrame:
    """The line says what not to do. Needs the column line_text."""
    return lowered(found, F.col("line_text").rlike(r"(?i)\b(do not|don't|never|must not|avoid)\b") & ~value_based(), "prohibition_prose", "the line forbids what it names", "low")


def card_context(found: DataFrame, card_rule: str = "RL-PII-CARD") -> DataFrame:
    """A card number still at block whose line and neighbours (column context) speak of items and not of payment."""
    item = F.col("context").rlike(r"(?i)\b(code|sku|item|part|serial|barcode|model)\b")
    pay = F.col("context").rlike(r"(?i)(card|payment|cvv|cvc|billing|checkout)")
    return lowered(found, (F.col("rule_id") == card_rule) & (F.col("decision") == "block") & item & ~pay, "card_context", "looks like an item code", "medium", "warn")


def evidence_policy(found: DataFrame) -> DataFrame:
    """A block stands on confirmed evidence, on exposed values and on constructs that are the weakness themselves; else it warns."""
    keeps = (F.col("confidence") == "confirmed") | value_based() | F.col("rule_id").isin(*CONSTRUCT_RULES)
    return lowered(found, ~keeps & (F.col("decision") == "block"), "evidence_policy", "a pattern alone does not block", None, "warn")


def taint_verdicts(found: DataFrame, verdicts: DataFrame, rules: tuple[str, ...] = ("RL-CODE-HTML-SINK",)) -> DataFrame:
    """Findings at markup sinks by the data flow's verdict on their line: constant drops them, sanitized and unknown lower them."""
    v = verdicts.select(F.col("path").alias("v_path"), F.col("line_no").alias("v_line"), F.col("verdict"))
    joined = found.join(v, F.col("rule_id").isin(*rules) & (F.col("path") == F.col("v_path")) & (F.col("line_no") == F.col("v_line")), "left").where(~F.col("verdict").eqNullSafe(F.lit("const")))
    out = lowered(joined, F.col("verdict") == "sanitized", "taint_sanitized", "value is sanitized", "medium", "warn")
    return lowered(out, F.col("verdict") == "unknown", "taint_unknown", "value's source is unknown", None, "warn").drop("v_path", "v_line", "verdict")


def context_of(found: DataFrame, lines: DataFrame, before: int, after: int, name: str = "context") -> DataFrame:
    """Findings with the text of their line and its neighbours, joined on the few lines that matter."""
    around = found.select("path", "line_no").distinct().select("path", "line_no", F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("near"))
    near = around.join(lines.select("path", F.col("line_no").alias("near"), "line"), ["path", "near"])
    text = near.groupBy("path", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("near", "line"))), lambda x: x["line"]), "\n").alias(name))
    return found.join(text, ["path", "line_no"], "left")


def dedupe(found: DataFrame) -> DataFrame:
    """One finding for each rule, path and line: the most precise engine's, ties to the first."""
    order = Window.partitionBy("rule_id", "path", "line_no").orderBy(rank(ENGINE, "engine").desc(), "rule_seq", "id")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def merge_groups(found: DataFrame) -> DataFrame:
    """In a group of one line the best finding wins; the losers' ids go to also_matched. Findings of no group stay."""
    key = F.coalesce(F.col("dedup_group"), F.concat(F.lit("rule:"), F.col("rule_id")))
    group = Window.partitionBy("path", "line_no", "group_key")
    order = group.orderBy(rank(ENGINE, "engine").desc(), rank(CONFIDENCE, "confidence").desc(), rank(SEVERITY, "severity").desc(), rank(DECISION, "decision").desc(), "rule_id")
    placed = found.withColumn("group_key", key).withColumn("place", F.row_number().over(order)).withColumn("all_ids", F.sort_array(F.collect_set("rule_id").over(group)))
    return placed.where("place = 1").withColumn("also_matched", F.array_sort(F.array_union("also_matched", F.array_remove("all_ids", F.col("rule_id"))))).drop("place", "all_ids", "group_key")


def apply_profile(found: DataFrame, severity_min: str = "low", rules: dict[str, str] | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """Findings of that severity at least, with a profile's decisions: the strictest of a finding's rules, else its category's."""
    out = found.where(rank(SEVERITY, "severity") >= SEVERITY[severity_min])
    as_map = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else None
    by_rule, by_category = as_map(rules), as_map(categories)
    decided = F.lit(None).cast("string")
    if by_category is not None:
        decided = by_category[F.col("category")]
    if by_rule is not None:
        ranks = F.transform(F.concat(F.array("rule_id"), "also_matched"), lambda x: rank(DECISION, by_rule[x], -1))
        decided = F.coalesce(F.when(F.array_max(ranks) >= 0, name_of(DECISION, F.array_max(ranks))), decided)
    return out.withColumn("decision", F.coalesce(decided, "decision"))


def apply_exceptions(found: DataFrame, exceptions: DataFrame, today: Column, fingerprints: DataFrame | None = None) -> DataFrame:
    """Findings marked, not dropped, by the first exception in force that names rule and file (and line), has reason and approver."""
    e = exceptions.select(*[F.col(c).alias(f"e_{c}") for c in exceptions.columns])
    in_force = F.col("e_reason").isNotNull() & (F.trim("e_reason") != "") & F.col("e_approved_by").isNotNull() & F.col("e_expires").isNotNull() & (F.col("e_expires") >= today)
    if fingerprints is not None:
        found = found.join(fingerprints, ["path", "line_no"], "left")
    else:
        found = found.withColumn("fingerprint", F.lit(None).cast("string"))
    on = (F.array_contains(F.concat(F.array("rule_id"), "also_matched"), F.col("e_rule_id"))) & (F.lower("path") == F.lower("e_file")) & (F.col("e_line").isNull() | (F.col("e_line") == F.col("line_no"))) & (F.col("e_fingerprint").isNull() | (F.col("e_fingerprint") == F.col("fingerprint")))
    joined = found.join(e.where(in_force), on, "left")
    first = Window.partitionBy("path", "line_no", "rule_id", "id").orderBy(F.col("e_priority").asc_nulls_last())
    out = joined.withColumn("place", F.row_number().over(first)).where("place = 1")
    return out.withColumn("suppressed", F.col("e_rule_id").isNotNull()).withColumn("suppress_reason", F.col("e_reason")).drop("place", *[c for c in out.columns if c.startswith("e_")])


def judged(found: DataFrame) -> DataFrame:
    """The part of the pipeline that needs no more than the findings."""
    return found.transform(test_paths).transform(upload_data).transform(evidence_policy).transform(dedupe).transform(merge_groups)
