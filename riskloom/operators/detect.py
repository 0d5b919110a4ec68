"""Rules compiled to columns: each line against every rule in one projection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import BLANK, evidence_window, finding_id, redact
from riskloom.functions.validate import VALIDATORS
from riskloom.rules.cards import EXPOSURE, Rule, enforced

ADJUSTMENT = "struct<step:string,from_severity:string,to_severity:string,from_decision:string,to_decision:string,reason:string>"


# fixed values: letters beyond a-z that patterns of any case take for s and k, as Unicode folds them
ALSO_FOLDED = {"s": "\u017f", "k": "\u212a"}


def as_java(pattern: str) -> str:
    """A rule's pattern as it means the same to Java: white space without the vertical tab, and behind a leading (?i) the long s and the Kelvin sign as letters."""
    out, inside, any_case = [], False, pattern.startswith("(?i)")
    for part in re.findall(r"\(\?(?:P?<\w+>|[a-zA-Z-]*[:)])|\\.|\[\^?|.", pattern, re.DOTALL):
        folded = ALSO_FOLDED.get(part.lower()) if any_case else None
        if part == r"\s":
            part = BLANK if inside else f"[{BLANK}]"
        elif folded:
            part = part + folded if inside else f"[{part}{folded}]"
        elif part.startswith("[") and not inside:
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
    return "".join(out)


def hinted(line: Column, rule: Rule) -> Column | None:
    """Whether a line holds one of the rule's hints, or a long s that may stand in one; None for a rule without."""
    low = F.lower(line)
    hints = (*rule.hints, ALSO_FOLDED["s"]) if any(p.startswith("(?i)") for p in rule.patterns) else rule.hints
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in hints]) if rule.hints else None


def valid(line: Column, rule: Rule, value: Column) -> Column:
    """Whether what a pattern found passes all validators, on a line that is not excluded."""
    ok = value != ""
    for name in rule.validators:
        ok = ok & VALIDATORS[name](value)
    for pattern in rule.excludes:
        ok = ok & ~line.rlike(as_java(pattern))
    return ok


def first_match(line: Column, rule: Rule) -> Column:
    """The value of the first pattern whose first match passes all validators; null if none, or if the line is excluded."""
    value = F.lit(None).cast("string")
    for p in reversed(rule.patterns):
        found = F.regexp_extract(line, as_java(p), rule.take)
        value = F.when(valid(line, rule, found), found).otherwise(value)
    hint = hinted(line, rule)
    return value if hint is None else F.when(hint, value)


def applies(rule: Rule, language: Column) -> Column:
    """A language filter counts only where both sides are known; markdown takes exposure rules alone."""
    ok = F.lit(True) if rule.category in EXPOSURE else ~language.eqNullSafe(F.lit("markdown"))
    return ok & (language.isNull() | language.isin(*rule.languages)) if rule.languages else ok


def is_comment(line: Column, language: Column) -> Column:
    hash_languages = language.isin("python", "yaml")
    slash_languages = language.isin("javascript", "typescript", "java", "go")
    return (hash_languages & line.rlike(r"^\s*#")) | (slash_languages & line.rlike(r"^\s*(//|/\*|\*)"))


def ignored_ids(line: Column) -> Column:
    """What a directive `riskloom: ignore [RULE ...]` on the line names; empty for all rules; null without one."""
    return F.when(line.rlike(r"riskloom:\s*ignore"), F.filter(F.split(F.regexp_extract(line, r"riskloom:\s*ignore\s*\[?([A-Z0-9, -]*)\]?", 1), r"[ ,]+"), lambda x: x != ""))


def matches(lines: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row for each line and rule that fires, with the matched value. lines: path, language, line_no, line, ...

    A rule's pattern runs once a line, behind its hints, inside one generator; only what
    it found is validated and gets the rule's columns.
    """
    rules = enforced() if rules is None else rules
    line, language, found = F.col("line"), F.col("language"), []
    for rule in rules:
        # of several patterns the first that passes counts, so those are validated at once
        value = F.regexp_extract(line, as_java(rule.patterns[0]), rule.take) if len(rule.patterns) == 1 else F.coalesce(first_match(line, rule), F.lit(""))
        hint = hinted(line, rule)
        found.append(value if hint is None else F.when(hint, value).otherwise(""))
    rows = lines.select("*", F.posexplode(F.array(*found)).alias("rule_seq", "match")).where("match <> ''")
    ok = F.lit(False)
    for n, rule in enumerate(rules):
        own = applies(rule, language) & valid(line, rule, F.col("match"))
        if rule.category not in EXPOSURE:
            own = own & ~F.coalesce(is_comment(line, language), F.lit(False))
        ok = F.when(F.col("rule_seq") == n, own).otherwise(ok)
    columns = F.array(*[
        F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.decision).alias("decision"), F.lit(r.confidence).alias("confidence"), F.lit(r.group).cast("string").alias("dedup_group"), F.lit("regex").alias("engine"))
        for r in rules
    ])
    return rows.where(ok).withColumn("rule", F.get(columns, F.col("rule_seq"))).select(*lines.columns, "rule_seq", "match", "rule.*")


def findings(lines: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Matches as findings: evidence is masked before it is stored, ids follow from it. Inline ignores are not applied here."""
    found = matches(lines, rules).withColumn("evidence", redact(evidence_window(F.col("line"), F.col("match"))))
    return found.withColumn("id", finding_id(F.col("rule_id"), F.col("path"), F.col("line_no"), F.col("evidence"))).withColumn("also_matched", F.array().cast("array<string>")).withColumn("adjustments", F.array().cast(f"array<{ADJUSTMENT}>")).drop("line", "match")


def without_ignored(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings that no directive on their line, or on a comment line just before, silences; exposure and confirmed ones stay."""
    directives = lines.where(F.col("line").contains("riskloom:")).select(
        F.col("path").alias("d_path"), F.explode(F.when(F.col("line").rlike(r"^\s*(#|//|<!--)"), F.array(F.col("line_no") + 1)).otherwise(F.when(F.col("line").contains("#"), F.array(F.col("line_no"))))).alias("d_line"), ignored_ids(F.col("line")).alias("ids"),
    ).where("ids is not null")
    silenced = (F.col("path") == F.col("d_path")) & (F.col("line_no") == F.col("d_line")) & ((F.size("ids") == 0) | F.array_contains("ids", F.col("rule_id"))) & ~F.col("category").isin(*EXPOSURE) & (F.col("confidence") != "confirmed")
    return found.join(directives, silenced, "left_anti")


def multiline_matches(files: DataFrame, rule_id: str, pattern: str) -> DataFrame:
    """path, rule_id, line_no of each match of a pattern over whole texts, one a line: the line by the line feeds before it.

    The text before the k-th match is what stands before it once earlier matches are cut by their lengths.
    """
    found = files.select("path", F.col("text"), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("found")).where(F.size("found") > 0)
    lines_at = F.expr("""
        aggregate(found, named_struct('at', 1, 'rows', cast(array() as array<int>)),
          (acc, m) -> named_struct(
            'at', locate(m, text, acc.at) + greatest(length(m), 1),
            'rows', array_append(acc.rows, 1 + length(substring(text, 1, locate(m, text, acc.at) - 1)) - length(replace(substring(text, 1, locate(m, text, acc.at) - 1), '\\n', '')))),
          acc -> array_distinct(acc.rows))""")
    return found.select("path", F.lit(rule_id).alias("rule_id"), F.explode(lines_at).alias("line_no"))
