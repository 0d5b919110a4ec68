"""Queries over package inventories and feeds made of the order tables: parts are packages, orders are advisories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import packages as K
from riskloom.operators import verdicts as N
from riskloom.sources.texts import table

TODAY = date(2026, 11, 26)
STATES = {"malicious": N.Source(date(2026, 11, 25), 7, ("npm", "pypi")), "vulnerable": N.Source(date(2026, 11, 25), 7, ("npm",)), "kev": N.Source(date(2026, 11, 20), 7, ())}
EVENT = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages from parts: 300 names in two ecosystems, versions of three numbers, some unknown."""
    k = F.col("p_partkey")
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    return table(spark, sf_dir, "part").select(
        F.when(k % 3 == 0, "PyPI").otherwise("npm").alias("ecosystem"), text("Lib_", k % 300).alias("name"), F.when(k % 13 != 0, text(F.col("p_size") % 4, ".", k % 7, ".", k % 3)).alias("version"), (k % 13 != 0).alias("version_exact"), F.lit(None).cast("string").alias("spec"),
    )


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories from orders: some name whole packages as malicious, the rest a range from a version to a fix or to a last affected one."""
    o = F.col("o_orderkey")
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    malicious, none = o % 97 == 0, F.lit(None).cast("string")
    first, last = text(o % 3, ".", o % 5), text(o % 3 + o % 2, ".", o % 5 + 1)
    event = lambda i, f, u: F.struct(i.alias("introduced"), f.alias("fixed"), u.alias("last_affected"), none.alias("limit"))
    whole = F.array(event(F.lit("0"), none, none))
    some = F.when(o % 4 == 0, F.array(event(first, none, none), event(none, none, last))).otherwise(F.array(event(first, none, none), event(none, last, none)))
    one = F.struct(text("lib-", o % 450).alias("name"), F.when(o % 6 == 0, "PyPI").otherwise("npm").alias("ecosystem"), F.array().cast("array<string>").alias("versions"), F.array(F.struct(F.lit("SEMVER").alias("type"), F.when(malicious, whole).otherwise(some).alias("events"))).alias("ranges"))
    return table(spark, sf_dir, "orders").where(o % 3 == 0).select(
        F.when(malicious, text("MAL-", o)).otherwise(text("ADV-", o)).alias("id"), F.array(text("CVE-2026-", o + 10000)).alias("aliases"), F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL", None)]), (o % 5 + 1).cast("int")).alias("severity"), F.array(one).alias("affected"),
    )


def exploited(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(o % 45 == 0).select(F.concat(F.lit("CVE-2026-"), (o + 10000).cast("string")).alias("cveID"), F.to_date("o_orderdate").alias("dateAdded"), F.concat(F.lit("v"), o.cast("string")).alias("vulnerabilityName"), F.when(o % 2 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"))


def feeds(spark: SparkSession, sf_dir: str, states=STATES) -> N.Feeds:
    return N.Feeds(advisories(spark, sf_dir), exploited(spark, sf_dir), states, TODAY)


def inventory_matches(spark, sf_dir):
    met = K.vulnerability_matches(inventory(spark, sf_dir).select("ecosystem", "name", "version").distinct(), advisories(spark, sf_dir).where("id not like 'MAL-%'"))
    return met.select("ecosystem", "name", "version", "id", "affected")


def offline_check(spark, sf_dir):
    return N.offline_check(inventory(spark, sf_dir), feeds(spark, sf_dir)).select("ecosystem", "name", "version", "verdict", "severity", "n_malicious", "n_vulnerable", "max_severity", "kev")


def offline_check_stale(spark, sf_dir):
    old = {k: N.Source(date(2026, 10, 1), s.days, s.ecosystems) for k, s in STATES.items()}
    return N.offline_check(inventory(spark, sf_dir), feeds(spark, sf_dir, old)).groupBy("verdict", "stale").agg(F.count("*").alias("n"))


def offline_check_without_feeds(spark, sf_dir):
    return N.offline_check(inventory(spark, sf_dir), feeds(spark, sf_dir, {})).groupBy("verdict", "severity").agg(F.count("*").alias("n"))


def _manifests(spark, sf_dir) -> DataFrame:
    """Packages of files: each file of some 25 parts, every fifth a lockfile; each 40th file could not be parsed."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.floor(k / 25).cast("string"), F.lit("/list")).alias("path"), F.when(F.floor(k / 25) % 5 == 0, "lock").otherwise("manifest").alias("kind"), k.alias("place"), "p_size", "p_partkey")
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    bad = F.floor(k / 25) % 40 == 7
    return rows.select("path", "kind", "place", F.when(k % 3 == 0, "PyPI").otherwise("npm").alias("ecosystem"), F.when(~bad, text("Lib_", k % 300)).alias("name"), F.when(k % 13 != 0, text(F.col("p_size") % 4, ".", k % 7, ".", k % 3)).alias("version"), (k % 13 != 0).alias("version_exact"), F.lit(None).cast("string").alias("spec"), F.when(bad, "unreadable").alias("problem"))


def audit_manifests(spark, sf_dir):
    return N.audit_manifests(_manifests(spark, sf_dir), feeds(spark, sf_dir))


def _meta(spark, sf_dir) -> DataFrame:
    names = inventory(spark, sf_dir).select("ecosystem", "name").distinct().withColumn("k", F.substring_index("name", "_", -1).cast("int"))
    k = F.col("k")
    return names.select("ecosystem", "name", F.when(k % 9 != 0, k % 10 != 0).alias("exists"), F.when(k % 4 == 0, k % 8 == 0).alias("version_exists"), F.when(k % 5 != 0, k % 20).alias("version_age_days"), F.element_at(F.array(*[F.lit(x) for x in ("MIT", "GPL-3.0-only", "BSD License", "GPLv3", None)]), (k % 5 + 1)).alias("licence"), (k % 7 == 0).alias("install_scripts"))


def registry_meta_verdicts(spark, sf_dir):
    checks = N.offline_check(inventory(spark, sf_dir), feeds(spark, sf_dir))
    return N.with_registry_meta(checks, _meta(spark, sf_dir)).groupBy("verdict", "licence_verdict").agg(F.count("*").alias("n"))


def _decisions(spark) -> DataFrame:
    b = lambda i: (F.shiftright("id", i) % 2) == 1
    return spark.range(4096).select("id", F.element_at(F.array(*[F.lit(x) for x in ("approved", "REJECTED", "under_review", "odd")]), (F.col("id") % 4 + 1).cast("int")).alias("decision"), F.element_at(F.array(*[F.lit(x) for x in ("checked_clean", "malicious", "vulnerable", "unknown")]), (F.shiftright("id", 2) % 4 + 1).cast("int")).alias("verdict"), b(4).alias("kev"), b(5).alias("possible"), b(6).alias("compared"), F.when(b(7), F.when(b(8), F.lit(31)).otherwise(30)).alias("feed_age"), b(9).alias("cached_stale"), (~b(10)).alias("asked"))


def registry_matrix(spark, sf_dir):
    """All combinations of a registry's answer with what is known locally."""
    rows = _decisions(spark)
    named = rows.select(F.lit("npm").alias("ecosystem"), F.col("id").cast("string").alias("name"), F.lit("1").alias("version"), "verdict", F.lit("low").alias("severity"), "kev", "possible", "compared", "feed_age")
    decided = rows.where("asked").select(F.lit("npm").alias("ecosystem"), F.col("id").cast("string").alias("name"), F.lit("1").alias("version"), "decision", "cached_stale")
    return K.registry_decision(named, decided).groupBy("verdict", "severity", "requires_review", "checked", "registry_status", "stale_rejection").agg(F.count("*").alias("n"))


def _checks(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    b = lambda m: k % m == 0
    return table(spark, sf_dir, "part").select(
        F.floor(k / 50).alias("audit"), F.lit("npm").alias("ecosystem"), F.when(~b(101), F.concat(F.lit("lib"), (k % 300).cast("string"))).alias("name"), F.when(~b(13), (k % 7).cast("string")).alias("version"), (~b(6)).alias("version_exact"),
        F.element_at(F.array(*[F.lit(x) for x in ("checked_clean", "vulnerable", "unknown", "malicious", "not_found", "checked_stale")]), (k % 6 + 1).cast("int")).alias("verdict"), b(17).alias("kev"), b(19).alias("possible"), b(5).alias("latest_assumed"),
        F.element_at(F.array(*[F.lit(x) for x in ("MIT", "GPL-3.0-only", "LGPL-2.1-or-later WITH x", None)]), (k % 4 + 1).cast("int")).alias("licence"), F.when(b(8), F.array(F.lit("size"))).otherwise(F.array().cast("array<string>")).alias("signals"), F.lit("info").alias("severity"),
    )


def gate_inputs(spark, sf_dir):
    return N.gate_inputs(_checks(spark, sf_dir))


def block_reasons(spark, sf_dir):
    return N.block_reasons(N.gate_inputs(_checks(spark, sf_dir)))


def audit_stats(spark, sf_dir):
    return N.audit_stats(_checks(spark, sf_dir))


def possible_raised(spark, sf_dir):
    return N.raise_possible(_checks(spark, sf_dir)).groupBy("verdict", "severity", "requires_review").agg(F.count("*").alias("n"))


def _rows(spark, sf_dir) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), (o % 40).cast("string")).alias("package"), F.floor(o / 3).alias("group_id"), F.when(o % 7 != 0, F.concat((o % 9).cast("string"), F.lit("."), (o % 11).cast("string"))).alias("target"), F.element_at(F.array(*[F.lit(x) for x in ("low", "HIGH", "Critical", None)]), (o % 4 + 1).cast("int")).alias("severity"), (o % 17 == 0).alias("kev"))


def advisory_totals(spark, sf_dir):
    return N.advisory_totals(_rows(spark, sf_dir))


def upgrade_plans(spark, sf_dir):
    return N.upgrade_plan(_rows(spark, sf_dir))


def notice_matches(spark, sf_dir):
    k = F.col("s_suppkey")
    cve = lambda x: F.concat(F.lit("CVE-2026-"), (x + 10000).cast("string"))
    notices = table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://notices.example/"), k.cast("string")).alias("link"), F.col("s_name").alias("title"), F.array(cve(k * 3), cve(k * 3), cve(k * 6)).alias("cve_ids"))
    return N.notices_for(advisories(spark, sf_dir), notices).groupBy("link").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def feed_states(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("item"), F.to_date("o_orderdate").alias("fetched_on"))
    return N.feed_summary(own, F.lit("1998-08-05").cast("date"), 3)


def kev_proposals(spark, sf_dir):
    return N.proposed_from_kev(exploited(spark, sf_dir), F.lit("1997-01-01").cast("date"))


def direct_packages(spark, sf_dir):
    k = F.col("s_suppkey")
    named = table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"), F.concat(F.lit("LIB."), (k % 150).cast("string")).alias("name"))
    return N.direct_packages(inventory(spark, sf_dir).select("ecosystem", "name").distinct(), named)


def dependency_refs(spark, sf_dir):
    p, s = F.col("p_partkey"), F.concat(F.lit("lib"), (F.col("p_partkey") % 60).cast("string"))
    edges = table(spark, sf_dir, "part").select(F.when(p % 10 != 0, s).alias("parent"), F.concat(F.lit("LIB"), ((p * 7) % 80).cast("string")).alias("child"))
    components = spark.range(70).select(F.concat(F.lit("Lib"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("pkg:npm/lib"), F.col("id").cast("string")).alias("ref"))
    out = N.dependency_refs(edges, components)
    return out.select("ref", F.array_join("depends_on", ",").alias("depends_on"))


QUERIES = {f.__name__: f for f in (
    inventory_matches, offline_check, offline_check_stale, offline_check_without_feeds, audit_manifests, registry_meta_verdicts, registry_matrix, gate_inputs, block_reasons, audit_stats, possible_raised, advisory_totals, upgrade_plans, notice_matches, feed_states, kev_proposals, direct_packages, dependency_refs,
)}

_KEY = "list_transform(string_split({v}, '.'), lambda x: CAST(x AS INTEGER))"
#: Versions hold three numbers at most, so a triple of numbers compares as they do, whatever zeros stand at the end.
_TRIPLE = lambda v: f"[coalesce(TRY_CAST(split_part({v}, '.', 1) AS INTEGER), 0), coalesce(TRY_CAST(split_part({v}, '.', 2) AS INTEGER), 0), coalesce(TRY_CAST(split_part({v}, '.', 3) AS INTEGER), 0)]"
_FEEDS = f"""
inv AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, 'Lib_' || (p_partkey % 300) AS name, CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 4) || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) END AS version FROM part),
adv AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 97 = 0 THEN 'MAL-' ELSE 'ADV-' END || o_orderkey AS id, o_orderkey % 97 = 0 AS mal, 'CVE-2026-' || (o_orderkey + 10000) AS cve, [2, 3, 4, 5, 1][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS sev, 'lib-' || (o_orderkey % 450) AS aname, CASE WHEN o_orderkey % 6 = 0 THEN 'PyPI' ELSE 'npm' END AS aeco,
  [o_orderkey % 3, o_orderkey % 5, 0] AS lo, [o_orderkey % 3 + o_orderkey % 2, o_orderkey % 5 + 1, 0] AS hi, o_orderkey % 4 = 0 AS inclusive FROM orders WHERE o_orderkey % 3 = 0),
kev AS (SELECT 'CVE-2026-' || (o_orderkey + 10000) AS cve FROM orders WHERE o_orderkey % 45 = 0),
met AS (SELECT i.*, a.*, i.version IS NULL OR ({_TRIPLE('i.version')} >= a.lo AND ({_TRIPLE('i.version')} < a.hi OR (a.inclusive AND {_TRIPLE('i.version')} = a.hi))) AS affected
  FROM inv i JOIN adv a ON i.ecosystem = a.aeco AND CASE WHEN i.ecosystem = 'PyPI' THEN replace(lower(i.name), '_', '-') ELSE lower(i.name) END = a.aname)"""
_CHECKED = _FEEDS + """,
res AS (SELECT i.ecosystem, i.name, i.version, count(m.id) FILTER (m.mal) AS n_malicious, count(m.id) FILTER (NOT m.mal AND m.affected) AS n_vulnerable, max(m.sev) FILTER (NOT m.mal AND m.affected) AS worst, coalesce(bool_or(NOT m.mal AND m.affected AND m.cve IN (SELECT cve FROM kev)), false) AS kev
  FROM inv i LEFT JOIN met m ON i.ecosystem = m.ecosystem AND i.name = m.name AND i.version IS NOT DISTINCT FROM m.version GROUP BY ALL),
chk AS (SELECT *, CASE WHEN n_malicious > 0 THEN 'malicious' WHEN n_vulnerable > 0 AND ecosystem = 'npm' THEN 'vulnerable' WHEN ecosystem = 'npm' THEN 'checked_clean' ELSE 'unknown' END AS verdict,
  CASE WHEN n_vulnerable = 0 THEN CASE WHEN ecosystem = 'npm' THEN 'NONE' ELSE 'UNKNOWN' END ELSE ['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][worst] END AS max_severity FROM res)"""
_BITS = lambda i: f"((id >> {i}) % 2 = 1)"
_CHK = """c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 101 <> 0 THEN 'lib' || (p_partkey % 300) END AS name, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 7 AS VARCHAR) END AS version, ['checked_clean', 'vulnerable', 'unknown', 'malicious', 'not_found', 'checked_stale'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS verdict FROM part)"""
_INPUTS = "i AS (SELECT count(*) FILTER (verdict = 'malicious') AS n_malicious, count(*) FILTER (k % 17 = 0) AS n_kev, count(*) FILTER (verdict = 'vulnerable') AS n_vulnerable, count(*) FILTER (verdict = 'vulnerable' AND k % 5 = 0) AS n_assumed_vulnerable, count(*) FILTER (k % 13 = 0 OR k % 6 = 0) AS n_unpinned, count(*) FILTER (k % 8 = 0) AS n_signals, count(*) FILTER (k % 4 IN (1, 2)) AS n_licence_review, count(*) FILTER (verdict IN ('unknown', 'checked_stale')) AS n_unchecked, count(*) FILTER (verdict = 'not_found') AS n_not_found FROM c)"

ORACLES = {
    "inventory_matches": f"WITH {_FEEDS} SELECT ecosystem, name, version, id, affected FROM met WHERE NOT mal",
    "offline_check": f"WITH {_CHECKED} SELECT ecosystem, name, version, verdict, CASE verdict WHEN 'malicious' THEN 'high' WHEN 'vulnerable' THEN CASE WHEN version IS NOT NULL AND (kev OR max_severity IN ('HIGH', 'CRITICAL')) THEN 'high' ELSE 'medium' END ELSE 'info' END AS severity, n_malicious, n_vulnerable, max_severity, kev FROM chk",
    "offline_check_stale": f"WITH {_CHECKED} SELECT CASE WHEN verdict IN ('malicious', 'vulnerable') THEN verdict ELSE 'checked_stale' END AS verdict, true AS stale, count(*) AS n FROM chk GROUP BY ALL",
    "offline_check_without_feeds": f"WITH {_FEEDS} SELECT 'unknown' AS verdict, 'info' AS severity, count(*) AS n FROM inv",
    "audit_manifests": f"""WITH {_CHECKED}, f AS (SELECT 'm' || (p_partkey // 25) || '/list' AS path, (p_partkey // 25) % 5 = 0 AS lock, (p_partkey // 25) % 40 = 7 AS bad, CASE WHEN p_partkey % 3 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, 'Lib_' || (p_partkey % 300) AS name, CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 4) || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) END AS version, p_partkey AS place FROM part),
d AS (SELECT path, lock, ecosystem, name, version, min(place) AS place FROM f WHERE NOT bad GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place, name, version) <= CASE WHEN lock THEN 2000 ELSE 20 END AS taken FROM d),
n AS (SELECT p.path, count(*) AS n_packages, count(*) FILTER (taken) AS n_checked, count(*) FILTER (NOT taken) AS truncated, """ + ", ".join(f"count(*) FILTER (taken AND verdict = '{v}') AS n_{v}" for v in ("malicious", "vulnerable", "checked_clean", "checked_stale", "unknown")) + """, count(*) FILTER (taken AND kev) AS n_kev
  FROM p JOIN chk c ON p.ecosystem = c.ecosystem AND p.name = c.name AND p.version IS NOT DISTINCT FROM c.version GROUP BY p.path)
SELECT a.path, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_packages", "n_checked", "truncated", "n_malicious", "n_vulnerable", "n_checked_clean", "n_checked_stale", "n_unknown", "n_kev")) + ", a.unparsed FROM (SELECT path, bool_or(bad) AS unparsed FROM f GROUP BY path) a LEFT JOIN n USING (path)",
    "registry_meta_verdicts": f"""WITH {_CHECKED}, m AS (SELECT *, CAST(split_part(name, '_', 2) AS INTEGER) AS k FROM chk)
SELECT CASE WHEN verdict IN ('malicious', 'vulnerable') THEN verdict WHEN k % 9 <> 0 AND k % 10 = 0 THEN 'not_found' WHEN k % 5 <> 0 AND k % 20 < 7 THEN 'cooldown_hold' WHEN k % 8 = 4 AND version IS NOT NULL THEN 'version_not_found' ELSE verdict END AS verdict,
  ['allowed', 'review_required', 'allowed', 'review_required', 'unknown'][k % 5 + 1] AS licence_verdict, count(*) AS n FROM m GROUP BY ALL""",
    "registry_matrix": f"""WITH r AS (SELECT id, ['APPROVED', 'REJECTED', 'UNDER_REVIEW', 'ODD'][CAST(id % 4 + 1 AS INTEGER)] AS d, ['checked_clean', 'malicious', 'vulnerable', 'unknown'][CAST((id >> 2) % 4 + 1 AS INTEGER)] AS v, {_BITS(4)} AS kev, {_BITS(5)} AS maybe, {_BITS(6)} AS compared, CASE WHEN {_BITS(7)} THEN CASE WHEN {_BITS(8)} THEN 31 ELSE 30 END END AS age, {_BITS(9)} AS old, NOT {_BITS(10)} AS asked FROM range(4096) t(id)),
s AS (SELECT *, asked AND d = 'REJECTED' AS rej, asked AND d = 'APPROVED' AND v <> 'malicious' AND NOT kev AND NOT maybe AS app FROM r)
SELECT CASE WHEN rej THEN 'registry_rejected' WHEN app THEN 'registry_approved' ELSE v END AS verdict, CASE WHEN rej THEN 'critical' WHEN app THEN 'info' ELSE 'low' END AS severity,
  CASE WHEN rej THEN true WHEN app THEN coalesce(age > 30, false) OR (NOT compared AND age IS NULL) ELSE v <> 'checked_clean' END AS requires_review, CASE WHEN app THEN compared ELSE CASE WHEN rej THEN v <> 'unknown' ELSE v <> 'unknown' END END AS checked,
  CASE WHEN NOT asked THEN 'not_asked' WHEN d = 'ODD' THEN 'item_failed' ELSE 'ok' END AS registry_status, rej AND old AS stale_rejection, count(*) AS n FROM s GROUP BY ALL""",
    "gate_inputs": f"WITH {_CHK}, {_INPUTS} SELECT * FROM i",
    "block_reasons": f"WITH {_CHK}, {_INPUTS} SELECT reason, n FROM (SELECT unnest(['malicious package', 'exploited vulnerability', 'package not found']) AS reason, unnest([n_malicious, n_kev, n_not_found]) AS n FROM i) WHERE n > 0",
    "audit_stats": f"WITH {_CHK}, u AS (SELECT *, name IS NULL OR verdict IN ('unknown', 'checked_stale') AS un FROM c) SELECT count(*) FILTER (NOT un) AS n_checked, count(*) FILTER (un) AS n_unchecked, CAST(count(DISTINCT (coalesce(name, ''), coalesce(version, ''))) FILTER (verdict = 'vulnerable') AS INTEGER) AS n_vulnerable, CAST(count(DISTINCT (coalesce(name, ''), coalesce(version, ''))) FILTER (verdict = 'not_found') AS INTEGER) AS n_not_found, bool_or(verdict = 'malicious') AS any_malicious FROM u",
    "possible_raised": f"WITH {_CHK} SELECT verdict, CASE WHEN k % 19 = 0 AND verdict <> 'malicious' THEN 'medium' ELSE 'info' END AS severity, verdict <> 'checked_clean' OR k % 19 = 0 AS requires_review, count(*) AS n FROM c GROUP BY ALL",
    "advisory_totals": "SELECT 'p' || (o_orderkey % 40) AS package, count(*) FILTER (o_orderkey % 17 = 0) AS now, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 4 IN (1, 2)) AS soon, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 4 IN (0, 3)) AS later FROM orders GROUP BY 1",
    "upgrade_plans": "WITH g AS (SELECT 'p' || (o_orderkey % 40) AS package, o_orderkey // 3 AS gid, max([o_orderkey % 9, o_orderkey % 11]) FILTER (o_orderkey % 7 <> 0) AS t FROM orders GROUP BY ALL) SELECT package, (max(t))[1] || '.' || (max(t))[2] AS target, count(t) AS resolves, count(*) FILTER (t IS NULL) AS unfixed, count(*) FILTER (t IS NULL) = 0 AS complete FROM g GROUP BY package",
    "notice_matches": "WITH a AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'MAL-' ELSE 'ADV-' END || o_orderkey AS id, o_orderkey AS o FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT s_suppkey AS k, unnest([s_suppkey * 3, s_suppkey * 6]) AS o FROM supplier) SELECT 'https://notices.example/' || k AS link, count(DISTINCT id) AS n, min(id) AS first_id FROM n JOIN a USING (o) GROUP BY k",
    "feed_states": "WITH s AS (SELECT o_orderpriority AS source, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS n, min(CAST(o_orderdate AS DATE)) AS oldest, max(CAST(o_orderdate AS DATE)) AS newest FROM orders GROUP BY 1) SELECT *, CAST(DATE '1998-08-05' - newest AS INTEGER) AS age_days, CASE WHEN n = 0 THEN 'empty' WHEN DATE '1998-08-05' - newest > 3 THEN 'stale' ELSE 'fresh' END AS state FROM s",
    "kev_proposals": "SELECT 'RL-KEV-CVE-2026-' || (o_orderkey + 10000) AS id, 'v' || o_orderkey AS vulnerabilityName, CASE WHEN o_orderkey % 2 = 0 THEN 'critical' ELSE 'high' END AS severity, 'proposed' AS status, CAST(CAST(o_orderdate AS DATE) + 365 AS DATE) AS review_due FROM orders WHERE o_orderkey % 45 = 0 AND DATE '1997-01-01' - CAST(o_orderdate AS DATE) BETWEEN 0 AND 90",
    "direct_packages": f"WITH {_FEEDS} SELECT DISTINCT ecosystem, name, EXISTS (SELECT 1 FROM supplier WHERE CASE WHEN s_suppkey % 2 = 0 THEN 'npm' ELSE 'pypi' END = lower(ecosystem) AND s_suppkey % 150 = CAST(split_part(name, '_', 2) AS INTEGER)) AS direct FROM inv",
    "dependency_refs": "WITH e AS (SELECT DISTINCT CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 60 END AS p, (p_partkey * 7) % 80 AS c FROM part) SELECT coalesce('pkg:npm/lib' || p, 'project') AS ref, string_agg('pkg:npm/lib' || c, ',' ORDER BY 'pkg:npm/lib' || c) AS depends_on FROM e WHERE c < 70 GROUP BY p",
}
