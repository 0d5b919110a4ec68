"""Package names, purls, licences and CVSS vectors, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: licences of few conditions, and those to be reviewed
ALLOWED_LICENCES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "PSF-2.0")
REVIEWED_LICENCES = (
    "LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "BSL-1.1", "SSPL-1.0",
    "PolyForm-Noncommercial-1.0.0", "PolyForm-Internal-Use-1.0.0", "PolyForm-Small-Business-1.0.0", "Elastic-2.0",
)
# fixed values: how names of whole families begin
ALLOWED_FAMILIES = ("apache", "bsd", "isc")
REVIEWED_FAMILIES = ("gpl", "agpl", "sspl", "bsl", "polyform")
LICENCE_RANK = {"allowed": 0, "unknown": 1, "review_required": 2}


def index_name(name: Column) -> Column:
    """Lower case, runs of -_. as one hyphen, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(name), r"[-_.]+", "-")), r"^-+|-+$", "")


def advisory_name(name: Column, ecosystem: Column) -> Column:
    return F.when(F.lower(ecosystem) == "pypi", F.lower(F.regexp_replace(name, r"[-_.]+", "-"))).otherwise(F.lower(name))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    base = F.concat(F.lit("pkg:"), F.lower(ecosystem), F.lit("/"), F.regexp_replace(name, "^@", "%40"))
    return F.when(version.isNull(), base).otherwise(F.concat(base, F.lit("@"), version))


def parse_purl(text: Column) -> Column:
    """struct(ecosystem, name, version); the version stands behind the last @; null if not a purl."""
    core = F.regexp_replace(text, r"[?#].*$", "")
    rest = F.regexp_extract(core, r"^pkg:[A-Za-z0-9.+-]+/(.+)$", 1)
    has = F.locate("@", rest, 2) > 0
    version = F.when(has, F.substring_index(rest, "@", -1))
    name = F.when(has, F.substring(rest, F.lit(1), F.length(rest) - F.length(F.substring_index(rest, "@", -1)) - 1)).otherwise(rest)
    return F.when(core.rlike("^pkg:[A-Za-z0-9.+-]+/.+"), F.struct(F.lower(F.regexp_extract(core, "^pkg:([A-Za-z0-9.+-]+)/", 1)).alias("ecosystem"), F.regexp_replace(name, "^%40", "@").alias("name"), version.alias("version")))


def remote_unauthenticated(vector: Column) -> Column:
    """AV:N and PR:N of a CVSS 3 vector; null where it can't be read."""
    part = lambda k: F.regexp_extract(vector, f"(?:^|/){k}:([A-Z])", 1)
    return F.when((part("AV") != "") & (part("PR") != ""), (part("AV") == "N") & (part("PR") == "N"))


def _begins(name: Column, heads: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.startswith(h.lower()) for h in heads])


def _one_licence(name: Column) -> Column:
    """By what the lower-cased name begins with: listed licences first (those to be reviewed before the others), then whole families."""
    low = F.lower(F.trim(name))
    return (
        F.when(_begins(low, REVIEWED_LICENCES), F.lit(2))
        .when(_begins(low, ALLOWED_LICENCES) | F.array_contains(F.split(low, r"\s+"), "mit") | _begins(low, ALLOWED_FAMILIES), F.lit(0))
        .when(_begins(low, REVIEWED_FAMILIES), F.lit(2))
        .otherwise(F.lit(1))
    )


def licence_verdict(text: Column) -> Column:
    """allowed, unknown or review_required: OR takes the most lenient, AND the strictest, an exception behind WITH its base; only capital operators count, in texts of up to 200 characters."""
    plain = F.trim(text)
    compound = (F.length(plain) <= 200) & plain.rlike(r"\b(AND|OR|WITH)\b")
    ranks = lambda side: F.transform(F.filter(F.transform(F.split(side, r"\bAND\b"), lambda x: F.trim(F.regexp_replace(x, r"\bWITH\b.*$", ""))), lambda x: x != ""), _one_licence)
    sides = F.filter(F.transform(F.split(F.translate(plain, "()", "  "), r"\bOR\b"), lambda x: F.array_max(ranks(x))), lambda r: r.isNotNull())
    best = F.when(compound, F.coalesce(F.array_min(sides), F.lit(LICENCE_RANK["unknown"]))).otherwise(_one_licence(plain))
    return F.when(text.isNull() | (plain == ""), F.lit("unknown")).otherwise(reduce(lambda acc, kv: F.when(best == kv[1], F.lit(kv[0])).otherwise(acc), LICENCE_RANK.items(), F.lit("unknown")))


def name_signals(name: Column) -> Column:
    count = lambda c: F.length(name) - F.length(F.replace(name, F.lit(c), F.lit("")))
    return F.struct(
        count("-").alias("hyphens"), count("_").alias("underscores"), F.length(name).alias("length"),
        (count("-") + count("_") >= 2).alias("compound"), name.rlike("(?i)(ai|gpt|llm|copilot|tool|helper|agent)").alias("ai_words"),
    )


def cve_ids(vuln_id: Column, aliases: Column) -> Column:
    return F.filter(F.array_distinct(F.array_compact(F.array_union(F.array(vuln_id), F.coalesce(aliases, F.array().cast("array<string>"))))), lambda x: x.startswith("CVE-"))
