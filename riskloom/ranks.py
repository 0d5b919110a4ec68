"""Orderings of severities, decisions, engines and confidences, as data and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ranks that verdicts depend on
SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}
DECISION = {"allow": 0, "warn": 1, "block": 2}
ENGINE = {"python-ast": 3, "js-taint": 2, "semgrep": 2, "secret-file": 1, "regex": 1}
CONFIDENCE = {"pattern-only": 1, "likely": 2, "confirmed": 3}
#: Severity of an advisory; a missing label on a real advisory is UNKNOWN, above NONE and below LOW.
ADVISORY = {"NONE": 0, "UNKNOWN": 1, "LOW": 2, "MEDIUM": 3, "HIGH": 4, "CRITICAL": 5}


def rank(values: dict[str, int], name: Column | str, missing: int = 0) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit(missing)
    for key, n in values.items():
        out = F.when(name == key, F.lit(n)).otherwise(out)
    return out


def name_of(values: dict[str, int], n: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, k in values.items():
        out = F.when(n == k, F.lit(key)).otherwise(out)
    return out


def rank_sql(values: dict[str, int], name: str, missing: int = 0) -> str:
    return "CASE " + name + "".join(f" WHEN '{k}' THEN {n}" for k, n in values.items()) + f" ELSE {missing} END"
