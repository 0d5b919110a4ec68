"""Queries over package inventories and feeds, on small literal tables, and over rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalogue.sqlgen import quote
from riskloom.functions import package as P
from riskloom.functions import version as V
from riskloom.operators import packages as K
from riskloom.operators import search as R
from riskloom.operators import summary as M
from riskloom.rules.cards import RULES, problems

AFFECTED = "array<struct<name:string,ecosystem:string,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>>>"


def _event(**k):
    return (k.get("introduced"), k.get("fixed"), k.get("last_affected"), k.get("limit"))


ADVISORIES = [
    ("GHSA-1", ["CVE-2024-0001"], "HIGH", [("Foo_Bar", "PyPI", [], [("ECOSYSTEM", [_event(introduced="0"), _event(fixed="1.3")])])]),
    ("GHSA-2", ["CVE-2024-0002"], "CRITICAL", [("left-pad", "npm", ["1.1.0"], [("SEMVER", [_event(introduced="2.0.0"), _event(last_affected="2.4.0"), _event(introduced="3.0.0")])])]),
    ("GHSA-3", ["CVE-2024-0002", "OSV-9"], None, [("zed", "npm", [], [("SEMVER", [_event(introduced="1.0.0"), _event(fixed="1.0.5")])])]),
    ("MAL-1", [], None, [("evil-pkg", "npm", [], [("SEMVER", [_event(introduced="0")])])]),
    ("MAL-2", [], None, [("left-pad", "npm", ["5.6.1"], [])]),
    ("MAL-3", [], None, [("ghost", "npm", ["1.0.0"], [])]),
    ("MAL-4", [], None, [("oldform", "npm", [], [])]),
]
PACKAGES = [
    ("PyPI", "foo-bar", "1.2.9", True, "==1.2.9"), ("PyPI", "foo.bar", "1.3.0", True, "==1.3.0"), ("PyPI", "FOO_BAR", None, False, None), ("PyPI", "foo-bar", "1.3-rc.1", True, None), ("PyPI", "foo-bar", "banana", True, None),
    ("npm", "left-pad", "2.4.0", True, None), ("npm", "left-pad", "2.4.1", True, None), ("npm", "left-pad", "5.6.1", True, None), ("npm", "left-pad", "^4.1.2", False, "^4.1.2"), ("npm", "zed", "1.0.4", True, None), ("npm", "zed", "1.0.5", True, None),
    ("npm", "evil-pkg", None, False, None), ("npm", "ghost", "0.9.0", True, None), ("npm", "oldform", "1.0.0", True, None), ("npm", "expresss", "1.0.0", True, None), ("npm", "lodahs", "1.0.0", True, None), ("PyPI", "reqeusts", "1.0", True, None), ("PyPI", "requests", "2.0", True, None),
]


def packages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PACKAGES, "ecosystem string, name string, version string, version_exact boolean, spec string")


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, f"id string, aliases array<string>, severity string, affected {AFFECTED}")


VERSIONS = ["1.10", "1.9", "1.3.0", "1.3", "2.0.0-rc.1", "v2", "", "10", "1.0.0+b.1", "0.0", "1..2"]


def version_key_order(spark, sf_dir):
    rows = spark.createDataFrame([(v,) for v in VERSIONS], "version string")
    key = V.version_key(F.col("version"))
    return rows.select("version", F.concat_ws(".", F.transform(key, lambda x: x.cast("string"))).alias("version_key"), key.isNull().alias("unreadable"), V.prerelease(F.col("version")).alias("tag"), V.is_prerelease(F.col("version")).alias("is_pre"))


def affected_interval_match(spark, sf_dir):
    return K.vulnerability_matches(packages(spark), advisories(spark).where("id not like 'MAL-%'")).select("ecosystem", "name", "version", "id", "affected")


def mal_scope_matrix(spark, sf_dir):
    ordinary = K.affected_rows(advisories(spark).where("id not like 'MAL-%'")).select("ecosystem", "name_key")
    return K.malicious_matches(packages(spark), advisories(spark), ordinary)


def typosquat_theta(spark, sf_dir):
    return K.typosquats(packages(spark))


KEV = ["CVE-2024-0002", "CVE-1999-1"]


def kev_semi(spark, sf_dir):
    return K.kev_hits(advisories(spark), spark.createDataFrame([(c,) for c in KEV], "cveID string"))


def epss_nvd_enrichment(spark, sf_dir):
    """Orders as CVEs, of which some have scores, some base scores, some rejected ones."""
    o = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cve = F.concat(F.lit("CVE-"), o.cast("string"))
    epss = orders.where(o % 3 == 0).select(cve.alias("cve"), (o % 100 / 128.0).alias("epss"), (o % 50 / 64.0).alias("percentile"))
    nvd = orders.where(o % 4 == 0).select(cve.alias("id"), F.when(o % 5 == 0, "Rejected").when(o % 7 != 0, "Analyzed").alias("vulnStatus"), (o % 20 / 2.0).alias("cvss31_base_score"))
    return K.enriched(orders.where(o % 2 == 0).select(cve.alias("cve")), epss, nvd)


AGES = [(None, "E1"), (2, "E0"), (3, "E0"), (6, "E1"), (7, "e1 "), (13, "E2"), (14, "E2"), (8, None), (8, "E3")]


def cooldown_tristate(spark, sf_dir):
    rows = spark.createDataFrame(AGES, "age int, grade string")
    return rows.select("age", "grade", V.cooled_down(F.col("age"), F.col("grade")).alias("cooled"), V.grade_supported(F.col("grade")).alias("supported"))


LICENCES = [
    "MIT", "GPL-3.0", "MIT OR GPL-3.0", "MIT AND GPL-3.0", "(MIT OR GPL-2.0-only) AND ISC", "Custom", "", None, "GPL-2.0-or-later WITH Classpath-exception-2.0", "mit or gpl-3.0", "GPL-3.0-only WITH GCC-exception-3.1", "GPLv3", "MIT License", "Apache License 2.0",
    "BSD License", "The MIT License", "PolyForm Noncommercial License 1.0.0", "MPL-2.0 AND Custom", "Custom OR Elastic-2.0", "LGPLv3", "  ", "AND", "Apache-2.0 WITH LLVM-exception OR AGPL-3.0-only", "bslish",
]


def license_expr(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in LICENCES], "licence string").select("licence", P.licence_verdict(F.col("licence")).alias("verdict"))


PURLS = ["pkg:npm/%40scope/name@1.2.3", "pkg:pypi/requests@2.0?x=1", "pkg:npm/left-pad", "nonsense", "pkg:NPM/@a/b", "pkg:npm/a@1@2#sub", "pkg:npm/", None]


def purl_parts(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in PURLS], "purl string").withColumn("p", P.parse_purl(F.col("purl")))
    return rows.select("purl", "p.ecosystem", "p.name", "p.version", P.purl(F.col("p.ecosystem"), F.col("p.name"), F.col("p.version")).alias("again"))


TARGETS = [("a", "1.2.0", ["1.2.5", "2.0.0"]), ("b", "1.2.0", ["2.0.0-rc.1", "2.1.0"]), ("c", "3.0", ["1.0"]), ("d", "1.0.0", ["1.0.1-beta", "1.1.0", "1.0.9"])]


def recommended_version(spark, sf_dir):
    rows = spark.createDataFrame(TARGETS, "name string, current string, fixes array<string>")
    targets = rows.select("name", K.target_version(F.col("current"), F.col("fixes")).alias("target"))
    return targets.join(K.recommended(targets, "name"), "name")


def upgrade_components(spark, sf_dir):
    """Suppliers as advisories whose aliases chain some of them together."""
    k = F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("A"), F.lpad(x.cast("string"), 6, "0"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(name(k).alias("id"), F.when(k % 4 != 0, F.array(F.concat(F.lit("link-"), F.floor(k / 2).cast("string")), F.concat(F.lit("pair-"), F.floor((k + 1) / 2).cast("string")))).alias("aliases"))
    return K.advisory_groups(rows)


def epss_upsert(spark, sf_dir):
    old = spark.createDataFrame([("CVE-1", 0.1, "2026-01-01"), ("CVE-2", 0.2, "2026-01-02"), ("CVE-3", 0.3, "2026-01-01")], "cve string, epss double, date string")
    new = spark.createDataFrame([("CVE-1", 0.9, "2026-01-03"), ("CVE-2", 0.8, "2026-01-02"), ("CVE-3", 0.7, "2025-12-01"), ("CVE-4", 0.4, "2026-01-05")], "cve string, epss double, date string")
    return K.upsert(old, new, "cve", "date", 3)


def offline_verdicts(spark, sf_dir):
    flags = ("grade_ok", "feeds", "malicious", "vulnerable", "mal_covered", "stale", "undetermined", "vuln_covered")
    rows = spark.range(256).select("id", *[((F.shiftright("id", i) % 2) == 1).alias(f) for i, f in enumerate(flags)])
    return K.local_verdict(rows).groupBy("verdict").agg(F.count("*").alias("n"))


def online_verdicts(spark, sf_dir):
    b = lambda i: (F.shiftright("id", i) % 2) == 1
    rows = spark.range(2048).select(
        F.when(b(0), b(1)).alias("exists"), b(2).alias("malicious"), b(3).alias("vulnerable"), b(4).alias("kev"), F.when(b(5), "HIGH").otherwise("LOW").alias("max_severity"), F.when(b(6), F.lit(1)).alias("age_days"), F.lit("E1").alias("grade"),
        F.when(b(7), "1.0").alias("version"), b(8).alias("version_exact"), F.when(b(9), b(8)).alias("version_exists"), F.when(b(10), 1).alias("edit_distance"), b(7).alias("resolved"),
    )
    return K.online_verdict(rows).groupBy("verdict", "severity").agg(F.count("*").alias("n"))


def advisory_severity(spark, sf_dir):
    rows = spark.createDataFrame([("a", "1", "LOW"), ("a", "2", None), ("b", None, None), ("c", "3", "critical"), ("d", "4", None)], "package string, id string, severity string")
    return K.max_severity(rows, "package")


def advisory_priority(spark, sf_dir):
    rows = spark.createDataFrame([("p", "1", "LOW", True, 1), ("p", "2", "CRITICAL", False, 2), ("p", "3", None, False, 3), ("p", "4", "CRITICAL", False, 0), ("q", "5", "HIGH", False, 1)], "package string, id string, severity string, kev boolean, seq int")
    return K.prioritized(rows).select("package", "id", "priority")


def release_signals(spark, sf_dir):
    rows = spark.createDataFrame([("p", "1.9.0", "ann", 100, False), ("p", "1.10.0", "bob", 150, True), ("p", "1.10.1-rc.1", "eve", 1, True), ("p", "1.2.0", "ann", 100, False), ("q", "1", "x", None, False)], "name string, version string, maintainer string, size long, install_hook boolean")
    return K.previous_release(rows)


MANIFESTS = [("a/package.json", "npm", "manifest"), ("a/package-lock.json", "npm", "lock"), ("b/package.json", "npm", "manifest"), ("a/requirements.txt", "pypi", "manifest"), ("poetry.lock", "pypi", "lock"), ("pyproject.toml", "pypi", "manifest"), ("a/b/package.json", "npm", "manifest")]


def manifest_shadowing(spark, sf_dir):
    return K.shadowed_manifests(spark.createDataFrame(MANIFESTS, "path string, ecosystem string, kind string"))


def merged_components(spark, sf_dir):
    p = F.col("p_partkey")
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("checked_clean", "vulnerable", "unknown", "malicious", "not_found", "checked_stale", "checked_clean")]), (p % 7 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("lib"), (p % 90).cast("string")).alias("name"), (p % 4).cast("string").alias("version"), verdict.alias("verdict"), F.concat(F.lit("lock"), (p % 13).cast("string")).alias("source"), p.alias("seq"))
    return K.merged_components(rows)


def gate_matrix(spark, sf_dir):
    names = ("malicious", "kev", "vulnerable", "unchecked", "source", "coverage", "intel_missing")
    rows = spark.range(256).select(*[((F.shiftright("id", i) % 2) == 1).alias(n) for i, n in enumerate(names)], (F.shiftright("id", 7) % 2).alias("scanned"))
    return M.gate(rows.withColumn("findings", F.col("source").cast("int"))).groupBy("verdict", "exit_code").agg(F.count("*").alias("n"))


def rule_search_rank(spark, sf_dir):
    return R.search(R.rule_table(spark), "password card")


def eval_precision_recall(spark, sf_dir):
    return R.evaluated(spark)


def rule_coverage_pairs(spark, sf_dir):
    return R.covering_pairs(spark)


def rule_problems(spark, sf_dir):
    return spark.createDataFrame(problems(RULES, "2027-07-01"), "rule_id string, problem string").groupBy("problem").agg(F.count("*").alias("n"))


def _audit(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def audit_events(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


def audit_hourly(spark, sf_dir):
    own = _audit(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def label_agreement(spark, sf_dir):
    """Labelled evaluation: card findings as a predictor of labels.quality = 0, counts by cell."""
    from riskloom.catalogue import texts as T
    from riskloom.operators import detect as D

    hits = D.matches(T._lines(spark, sf_dir), tuple(r for r in RULES if r.id == "RL-PII-CARD")).select("doc_id").distinct().withColumn("hit", F.lit(True))
    own = spark.read.parquet(f"{sf_dir}/labels.parquet").join(hits, "doc_id", "left")
    return own.groupBy("quality", F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    version_key_order, affected_interval_match, mal_scope_matrix, typosquat_theta, kev_semi, epss_nvd_enrichment, cooldown_tristate, license_expr, purl_parts, recommended_version, upgrade_components, epss_upsert, offline_verdicts, online_verdicts,
    advisory_severity, advisory_priority, release_signals, manifest_shadowing, merged_components, gate_matrix, rule_search_rank, eval_precision_recall, rule_coverage_pairs, rule_problems, audit_events, audit_hourly, label_agreement,
)}


def _values(rows, names):
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else quote(x) if isinstance(x, str) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(show(x) for x in r) + ")" for r in rows) + f") t({names})"


_KEY = "list_transform(list_filter(string_split(regexp_extract(trim({v}), '^([^-+ ]*)', 1), '.'), lambda x: x <> ''), lambda x: TRY_CAST(x AS INTEGER))"
_READ = "regexp_matches(regexp_extract(trim({v}), '^([^-+ ]*)', 1), '^[0-9.]*[0-9][0-9.]*$')"
_TRIM = "list_slice({k}, 1, greatest(1, coalesce(list_max(list_transform(range(1, len({k}) + 1), lambda i: CASE WHEN {k}[i] <> 0 THEN i ELSE 0 END)), 1)))"
_POPULAR = _values([(e, n) for e, ns in K.POPULAR.items() for n in ns], "eco, similar_to")
_P4 = _values([p[:3] for p in PACKAGES], "ecosystem, name, version")

ORACLES = {
    "epss_nvd_enrichment": "SELECT 'CVE-' || o_orderkey AS cve, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 128.0::DOUBLE END AS epss, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50) / 64.0::DOUBLE END AS percentile, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 THEN (o_orderkey % 20) / 2.0::DOUBLE END AS cvss31_base_score FROM orders WHERE o_orderkey % 2 = 0",
    "license_expr": f"""WITH t AS (SELECT licence, trim(licence) AS plain FROM {_values([(x,) for x in LICENCES], 'licence')}),
sides AS (SELECT *, length(plain) <= 200 AND regexp_matches(plain, '\\b(AND|OR|WITH)\\b') AS compound, CASE WHEN length(plain) <= 200 AND regexp_matches(plain, '\\b(AND|OR|WITH)\\b') THEN regexp_split_to_array(translate(plain, '()', '  '), '\\bOR\\b') ELSE [plain] END AS alt FROM t),
one AS (SELECT *, list_transform(alt, lambda a: list_max(list_transform(list_filter(list_transform(CASE WHEN compound THEN regexp_split_to_array(a, '\\bAND\\b') ELSE [a] END, lambda x: lower(trim(CASE WHEN compound THEN regexp_replace(x, '\\bWITH\\b.*$', '') ELSE x END))), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_matches(x, '^(lgpl-2\\.1|lgpl-3\\.0|gpl-2\\.0|gpl-3\\.0|agpl-3\\.0|bsl-1\\.1|sspl-1\\.0|polyform|elastic-2\\.0)') THEN 2 WHEN regexp_matches(x, '^(mit|apache|bsd|isc|mpl-2\\.0|psf-2\\.0)') OR regexp_matches(x, '(^|\\s)mit(\\s|$)') THEN 0 WHEN regexp_matches(x, '^(gpl|agpl|sspl|bsl)') THEN 2 ELSE 1 END))) AS r FROM sides)
SELECT licence, CASE WHEN plain IS NULL OR plain = '' THEN 'unknown' ELSE ['allowed', 'unknown', 'review_required'][coalesce(list_min(list_filter(r, lambda x: x IS NOT NULL)), 1) + 1] END AS verdict FROM one""",
    "upgrade_components": "WITH RECURSIVE n AS (SELECT 'A' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, unnest(CASE WHEN s_suppkey % 4 <> 0 THEN ['link-' || (s_suppkey // 2), 'pair-' || ((s_suppkey + 1) // 2)] ELSE ['only-' || s_suppkey] END) AS name FROM supplier), reach AS (SELECT DISTINCT id, id AS r FROM n UNION SELECT reach.id, b.id FROM reach JOIN n a ON a.id = reach.r JOIN n b ON b.name = a.name) SELECT id, min(r) AS group_id FROM reach GROUP BY id",
    "manifest_shadowing": f"WITH f AS (SELECT *, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS folder FROM {_values(MANIFESTS, 'path, ecosystem, kind')}) SELECT path, ecosystem FROM f WHERE kind = 'manifest' AND NOT EXISTS (SELECT 1 FROM f l WHERE l.kind = 'lock' AND l.folder = f.folder AND l.ecosystem = f.ecosystem)",
    "merged_components": "WITH c AS (SELECT 'npm' AS ecosystem, 'lib' || (p_partkey % 90) AS name, CAST(p_partkey % 4 AS VARCHAR) AS version, ['checked_clean', 'vulnerable', 'unknown', 'malicious', 'not_found', 'checked_stale', 'checked_clean'][CAST(p_partkey % 7 + 1 AS INTEGER)] AS verdict, 'lock' || (p_partkey % 13) AS source, p_partkey AS seq FROM part) SELECT ecosystem, name, version, arg_max(verdict, CASE WHEN verdict IN ('malicious', 'not_found') THEN 3 WHEN verdict = 'vulnerable' THEN 2 ELSE 1 END * 1000000000::BIGINT - seq) AS verdict, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM c GROUP BY ALL",
    "purl_parts": f"WITH t AS (SELECT purl, regexp_extract(regexp_replace(purl, '[?#].*$', ''), '^pkg:([A-Za-z0-9.+-]+)/(.+)$', ['eco', 'rest']) AS m FROM {_values([(x,) for x in PURLS], 'purl')}), v AS (SELECT purl, nullif(lower(m.eco), '') AS ecosystem, CASE WHEN m.eco <> '' THEN regexp_extract(m.rest, '^(.+?)(?:@([^@]*))?$', 1) END AS n, CASE WHEN m.eco <> '' AND regexp_matches(m.rest, '^.+@[^@]*$') THEN regexp_extract(m.rest, '@([^@]*)$', 1) END AS version FROM t), w AS (SELECT purl, ecosystem, regexp_replace(n, '^%40', '@') AS name, version FROM v) SELECT *, CASE WHEN ecosystem IS NOT NULL THEN 'pkg:' || ecosystem || '/' || regexp_replace(name, '^@', '%40') || coalesce('@' || version, '') END AS again FROM w",
    "recommended_version": f"WITH t AS (SELECT name, current, unnest(string_split(fixes, ' ')) AS f FROM {_values([(n, c, ' '.join(f)) for n, c, f in TARGETS], 'name, current, fixes')}), k AS (SELECT *, list_transform(string_split(split_part(f, '-', 1) || '.0.0', '.')[1:3], lambda x: CAST(x AS INTEGER)) AS fk, list_transform(string_split(split_part(current, '-', 1) || '.0.0', '.')[1:3], lambda x: CAST(x AS INTEGER)) AS ck FROM t), b AS (SELECT name, arg_min(f, [CASE WHEN fk[1] = ck[1] AND NOT contains(f, '-') THEN 0 WHEN fk[1] = ck[1] THEN 1 WHEN NOT contains(f, '-') THEN 2 ELSE 3 END] || fk) FILTER (fk > ck) AS target FROM k GROUP BY name) SELECT name, target, target AS recommended, CAST(CASE WHEN target IS NULL THEN 1 ELSE 0 END AS BIGINT) AS unfixed FROM b",
    "version_key_order": f"WITH v AS (SELECT version, {_KEY.format(v='version')} AS k, {_READ.format(v='version')} AS ok FROM {_values([(v,) for v in VERSIONS], 'version')}) SELECT version, CASE WHEN ok THEN array_to_string({_TRIM.format(k='k')}, '.') ELSE '' END AS version_key, NOT ok AS unreadable, lower(regexp_extract(regexp_replace(trim(version), '\\+.*$', ''), '^[^-]*-(.*)$', 1)) AS tag, regexp_matches(version, '(?i)-(?:rc|alpha|beta|next|canary|dev|pre|preview|snapshot)') AS is_pre FROM v",
    "typosquat_theta": f"WITH p AS (SELECT ecosystem, name, lower(ecosystem) AS eco, lower(name) AS low FROM {_P4}), pop AS (SELECT * FROM {_POPULAR}) SELECT ecosystem, name, similar_to, CAST(levenshtein(low, similar_to) AS INTEGER) AS edit_distance FROM p JOIN pop USING (eco) WHERE length(low) >= 5 AND NOT EXISTS (SELECT 1 FROM pop q WHERE q.eco = p.eco AND q.similar_to = p.low) AND levenshtein(low, similar_to) BETWEEN 1 AND 2",
    "kev_semi": "WITH a AS (SELECT * FROM " + _values([(r[0], c) for r in ADVISORIES for c in [r[0], *r[1]]], "id, cve") + f") SELECT id, cve FROM a WHERE cve LIKE 'CVE-%' AND cve IN ({', '.join(map(quote, KEV))})",
    "cooldown_tristate": f"SELECT age, grade, age >= CASE upper(trim(grade)) WHEN 'E0' THEN 3 WHEN 'E2' THEN 14 ELSE 7 END AS cooled, grade IS NULL OR upper(trim(grade)) IN ('E0', 'E1', 'E2') AS supported FROM {_values(AGES, 'age, grade')}",
    "epss_upsert": "WITH b AS (SELECT * FROM (VALUES ('CVE-1', 0.1::DOUBLE, '2026-01-01', 0), ('CVE-2', 0.2, '2026-01-02', 0), ('CVE-3', 0.3, '2026-01-01', 0), ('CVE-1', 0.9, '2026-01-03', 1), ('CVE-2', 0.8, '2026-01-02', 1), ('CVE-3', 0.7, '2025-12-01', 1), ('CVE-4', 0.4, '2026-01-05', 1)) t(cve, epss, date, src)) SELECT cve, epss, date FROM b QUALIFY row_number() OVER (PARTITION BY cve ORDER BY date DESC, src DESC) = 1 ORDER BY date DESC, cve LIMIT 3",
    "offline_verdicts": "WITH f AS (SELECT " + ", ".join(f"(id >> {i}) % 2 = 1 AS {n}" for i, n in enumerate(("grade_ok", "feeds", "malicious", "vulnerable", "mal_covered", "stale", "undetermined", "vuln_covered"))) + " FROM range(256) r(id)) SELECT CASE WHEN NOT grade_ok THEN 'unsupported_env_grade' WHEN NOT feeds THEN 'unknown' WHEN malicious THEN 'malicious' WHEN vulnerable THEN 'vulnerable' WHEN NOT mal_covered THEN 'unknown' WHEN stale THEN 'checked_stale' WHEN undetermined THEN 'unknown' WHEN vuln_covered THEN 'checked_clean' ELSE 'unknown' END AS verdict, count(*) AS n FROM f GROUP BY 1",
    "advisory_severity": "WITH r AS (SELECT * FROM (VALUES ('a', '1', 'LOW'), ('a', '2', NULL), ('b', NULL, NULL), ('c', '3', 'critical'), ('d', '4', NULL)) t(package, id, severity)) SELECT package, list_extract(['NONE', 'UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], CAST(max(CASE WHEN id IS NULL THEN 0 ELSE CASE upper(severity) WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 WHEN 'CRITICAL' THEN 5 ELSE 1 END END) + 1 AS INTEGER)) AS max_severity FROM r GROUP BY package",
    "advisory_priority": "SELECT package, id, CAST(row_number() OVER (PARTITION BY package ORDER BY kev DESC, CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'LOW' THEN 2 ELSE 1 END DESC, seq) AS INTEGER) AS priority FROM (VALUES ('p', '1', 'LOW', true, 1), ('p', '2', 'CRITICAL', false, 2), ('p', '3', NULL, false, 3), ('p', '4', 'CRITICAL', false, 0), ('q', '5', 'HIGH', false, 1)) t(package, id, severity, kev, seq)",
    "gate_matrix": "WITH f AS (SELECT " + ", ".join(f"(id >> {i}) % 2 = 1 AS {n}" for i, n in enumerate(("malicious", "kev", "vulnerable", "unchecked", "source", "coverage", "intel_missing", "scanned"))) + " FROM range(256) r(id)), v AS (SELECT CASE WHEN malicious OR kev THEN 'blocked' WHEN (NOT scanned AND NOT source AND NOT vulnerable AND NOT unchecked) OR (coverage AND NOT vulnerable AND NOT unchecked AND NOT source) OR intel_missing THEN 'undetermined' WHEN vulnerable OR unchecked OR source OR coverage THEN 'conditional' ELSE 'approved' END AS verdict FROM f) SELECT verdict, CASE verdict WHEN 'approved' THEN 0 WHEN 'conditional' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END AS exit_code, count(*) AS n FROM v GROUP BY ALL",
    "audit_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL",
    "audit_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}

_b = lambda i: f"((id >> {i}) % 2 = 1)"
ORACLES["online_verdicts"] = f"""
WITH f AS (SELECT CASE WHEN {_b(0)} THEN {_b(1)} END AS ex, {_b(2)} AS mal, {_b(3)} AS vul, {_b(4)} OR {_b(5)} AS severe, CASE WHEN {_b(6)} THEN 1 END AS age, {_b(7)} AS has_version, {_b(8)} AS exact, CASE WHEN {_b(9)} THEN {_b(8)} END AS vex, {_b(10)} AS near FROM range(2048) r(id)),
v AS (SELECT *, CASE WHEN ex = false THEN 'not_found' WHEN mal THEN 'malicious' WHEN vul THEN 'vulnerable' WHEN age < 7 THEN 'cooldown_hold' WHEN vex = false AND NOT exact THEN 'unknown' WHEN vex = false THEN 'version_not_found' WHEN near THEN 'suspicious_name' WHEN NOT has_version THEN 'unknown' ELSE 'checked_clean' END AS verdict FROM f)
SELECT verdict, CASE verdict WHEN 'malicious' THEN 'critical' WHEN 'vulnerable' THEN CASE WHEN has_version AND severe THEN 'high' ELSE 'medium' END WHEN 'not_found' THEN 'high' WHEN 'version_not_found' THEN 'high' WHEN 'suspicious_name' THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM v GROUP BY ALL"""
ORACLES["release_signals"] = """
WITH r AS (SELECT * FROM (VALUES ('p', '1.9.0', 'ann', 100, false, 2), ('p', '1.10.0', 'bob', 150, true, 3), ('p', '1.2.0', 'ann', 100, false, 1), ('q', '1', 'x', NULL, false, 1)) t(name, version, maintainer, size, hook, k)),
l AS (SELECT *, lag(version) OVER w AS previous, lag(maintainer) OVER w AS m0, lag(size) OVER w AS s0, lag(hook) OVER w AS h0 FROM r WINDOW w AS (PARTITION BY name ORDER BY k))
SELECT name, version, previous, previous IS NOT NULL AND maintainer IS DISTINCT FROM m0 AS maintainer_changed, coalesce(abs((size - s0) / s0) >= 0.3, false) AS size_jump, coalesce(hook AND NOT h0, false) AS hook_added FROM l"""


def _evaluation() -> str:
    from riskloom.catalogue.sqlgen import value

    rows = [(r.id, text, fire) for r in RULES for texts, fire in ((r.positives, True), (r.negatives, False)) for text in texts]
    fired = "CASE rule_id " + " ".join(f"WHEN {quote(r.id)} THEN ({value(r)}) IS NOT NULL" for r in RULES) + " END"
    counts = ", ".join(f"count(*) FILTER (expect = {e} AND fired = {f}) AS {n}" for n, e, f in (("tp", "true", "true"), ("fp", "false", "true"), ("tn", "false", "false"), ("fn", "true", "false")))
    return f"WITH e AS (SELECT *, {fired} AS fired FROM {_values(rows, 'rule_id, line, expect')}), c AS (SELECT rule_id, {counts} FROM e GROUP BY rule_id), p AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM c) SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM p"


ORACLES["eval_precision_recall"] = _evaluation()


def _coverage() -> str:
    from riskloom.catalogue.sqlgen import value

    rows = [(a.id, b.id, t) for a in RULES for b in RULES if a.id < b.id and a.category == b.category and not (a.group and a.group == b.group) for t in b.positives]
    fired = "CASE a " + " ".join(f"WHEN {quote(r.id)} THEN ({value(r)}) IS NOT NULL" for r in RULES) + " END"
    return f"SELECT a, b FROM (SELECT a, b, {fired} AS fired FROM {_values(rows, 'a, b, line')}) GROUP BY a, b HAVING bool_and(fired)"


def _ranked() -> str:
    rows = [(r.id, r.title, " ".join(r.tags), " ".join((*r.patterns, *r.positives)), r.status) for r in RULES]
    terms = [("password", 1.0), ("card", 1.0), ("secret", 0.4), ("token", 0.4), ("payment", 0.4)]
    one = " + ".join(f"{w} * (CASE WHEN contains(lower(title), '{t}') THEN 10.0 ELSE 0.0 END + CASE WHEN contains(lower(id), '{t}') THEN 6.0 ELSE 0.0 END + 3.0 * len(list_filter(string_split(tags, ' '), lambda x: contains(x, '{t}'))) + least(5, (length(body) - length(replace(lower(body), '{t}', ''))) // {len(t)}))" for t, w in terms)
    return f"SELECT id, score FROM (SELECT id, round(CAST({one} AS DOUBLE), 6) AS score FROM {_values(rows, 'id, title, tags, body, status')} WHERE status <> 'deprecated') WHERE score > 0 ORDER BY score DESC, id LIMIT 10"


def _agreement() -> str:
    from riskloom.catalogue.sqlgen import matches

    return f"WITH {matches(tuple(r for r in RULES if r.id == 'RL-PII-CARD'))}, h AS (SELECT DISTINCT doc_id FROM matches) SELECT quality, h.doc_id IS NOT NULL AS hit, count(*) AS n FROM labels LEFT JOIN h ON labels.doc_id = h.doc_id GROUP BY ALL"


ORACLES |= {"rule_coverage_pairs": _coverage(), "rule_search_rank": _ranked(), "label_agreement": _agreement()}
