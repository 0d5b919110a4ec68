"""Rules, profiles and exceptions from files of text with a head of settings between lines of ---."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, fields

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.rules.cards import Rule, enforced

HEAD = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?(?:\n|\Z)", re.S)
EXCEPTION_SCHEMA = "rule_id string, file string, line int, reason string, approved_by string, expires date, fingerprint string, origin string, priority int"


class RuleError(ValueError):
    """All that is wrong with a set of rule files."""


def rule_of(text: str, name: str = "") -> Rule:
    """The rule of one file; what it does not state has the default, a pattern that does not compile is an error."""
    head = HEAD.match(text.lstrip("﻿"))
    data = yaml.safe_load(head[1]) if head else None
    if not isinstance(data, dict):
        raise RuleError(f"{name}: no settings between lines of ---")
    known = {f.name: f for f in fields(Rule)}
    unknown, missing = sorted(set(data) - set(known)), sorted({"id", "title", "category", "severity", "decision", "patterns"} - set(data))
    if unknown or missing:
        raise RuleError(f"{name}: " + "; ".join([*(f"unknown field {x}" for x in unknown), *(f"missing field {x}" for x in missing)]))
    values = {k: tuple(map(str, v)) if isinstance(v, list) else str(v) if k == "review_due" else v for k, v in data.items()}
    for p in (*values["patterns"], *values.get("excludes", ())):
        try:
            re.compile(p)
        except re.error as e:
            raise RuleError(f"{name}: pattern does not compile: {e}") from e
    return Rule(**values)


def load_rules(spark: SparkSession, folder: str, strict: bool = False) -> tuple[tuple[Rule, ...], list[str]]:
    """(rules by id, problems) of all .md files of a folder Spark reads; strict raises the problems, all of them at once."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value").collect()
    rules, problems = {}, []
    for row in sorted(files, key=lambda r: r.path):
        try:
            rule = rule_of(row.value, row.path)
        except (RuleError, yaml.YAMLError) as e:
            problems.append(str(e))
            continue
        if rule.id in rules:
            problems.append(f"{row.path}: id {rule.id} stands twice")
        rules.setdefault(rule.id, rule)
    if strict and problems:
        raise RuleError("\n".join(problems))
    return tuple(rules[k] for k in sorted(rules)), problems


def load_profile(spark: SparkSession, folder: str, profile: str) -> dict:
    """severity_min, rules, categories of a profile; one that is not there says so and changes nothing."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.y*ml").select(F.input_file_name().alias("path"), "value").collect()
    for row in found:
        data = yaml.safe_load(row.value) or {}
        if data.get("profile_id") == profile:
            return {"resolved": True, "severity_min": data.get("severity_min", "low"), "rules": data.get("decision_overrides") or {}, "categories": data.get("category_overrides") or {}}
    return {"resolved": False, "severity_min": "low", "rules": {}, "categories": {}}


def load_exceptions(spark: SparkSession, *folders: str) -> DataFrame:
    """Exceptions of all folders, those of earlier ones first; order in a file counts next."""
    rows = []
    for origin in folders:
        for row in sorted(spark.read.text(origin, wholetext=True, pathGlobFilter="*.y*ml").select(F.input_file_name().alias("path"), "value").collect(), key=lambda r: r.path):
            data = yaml.safe_load(row.value) or {}
            for e in data.get("exceptions") or []:
                text = lambda k, e=e: None if e.get(k) is None else str(e[k])
                rows.append((text("rule_id"), text("file"), e.get("line"), text("reason"), text("approved_by"), e.get("expires"), text("fingerprint"), origin, len(rows)))
    return spark.createDataFrame(rows, EXCEPTION_SCHEMA)


def digest(rules: Iterable[Rule]) -> str:
    """blake2b-128 over the enforced rules, by id: two sets that detect alike share it."""
    own = sorted((asdict(r) for r in enforced(tuple(rules))), key=lambda r: r["id"])
    return hashlib.blake2b(json.dumps(own, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode(), digest_size=16).hexdigest()


def verify_lock(rules: Iterable[Rule], lock: dict | None) -> dict:
    """Whether rules are those a lock names: locked, matches, expected, actual. Without a lock nothing is claimed."""
    actual = digest(rules)
    return {"locked": lock is not None, "matches": None if lock is None else lock.get("digest") == actual, "expected": (lock or {}).get("digest"), "actual": actual}
