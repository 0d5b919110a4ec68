"""Queries over texts: lines, detection, judgement, summaries, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalogue import sqlgen as S
from riskloom.functions import validate as V
from riskloom.functions.text import context_fingerprint, lines_of
from riskloom.operators import detect as D
from riskloom.operators import judge as J
from riskloom.operators import summary as M
from riskloom.ranks import CONFIDENCE, DECISION, SEVERITY
from riskloom.rules.cards import RULES, enforced
from riskloom.sources import texts as X

TODAY = "2026-11-26"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.documents_as_files(X.table(spark, sf_dir, "documents"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lines(X.spread(_files(spark, sf_dir)), "path", "language", "doc_id", "lang", "source")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.findings(_lines(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.judged(_findings(spark, sf_dir))


def line_index(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").alias("n_chars"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


def doc_line_stats(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"), F.count_if(F.trim("line") == "").alias("n_blank"))


def _by_rule(rule_id: str):
    rule = next(r for r in RULES if r.id == rule_id)

    def query(spark, sf_dir):
        return D.matches(_lines(spark, sf_dir), (rule,)).select("doc_id", "line_no", "match")

    return query, f"WITH {S.matches((rule,))} SELECT doc_id, line_no, match FROM matches"


def findings_union(spark, sf_dir):
    return D.matches(_lines(spark, sf_dir)).select("path", "line_no", "rule_id", "match", "severity", "decision", "category", "confidence")


def evidence_masked(spark, sf_dir):
    return _findings(spark, sf_dir).select("path", "line_no", "rule_id", "evidence")


def finding_ids(spark, sf_dir):
    return _findings(spark, sf_dir).select("path", "line_no", "rule_id", "id")


def findings_dedup(spark, sf_dir):
    twice = _findings(spark, sf_dir)
    both = twice.unionByName(twice.withColumn("engine", F.lit("python-ast")))
    return J.dedupe(both).select("path", "line_no", "rule_id", "engine")


def dedup_group_merge(spark, sf_dir):
    return _judged(spark, sf_dir).select("path", "line_no", "rule_id", "decision", F.array_join("also_matched", ",").alias("also"))


def evidence_policy(spark, sf_dir):
    found = _findings(spark, sf_dir).transform(J.evidence_policy)
    return found.groupBy("rule_id", "decision").agg(F.count("*").alias("n"), F.sum(F.size("adjustments")).alias("n_adjusted"))


def attenuation_test_path(spark, sf_dir):
    moved = _findings(spark, sf_dir).withColumn("path", F.concat(F.when(F.col("doc_id") % 2 == 0, "tests/").otherwise("src/"), "path"))
    return moved.transform(J.test_paths).groupBy("rule_id", "severity", "decision").agg(F.count("*").alias("n"), F.sum(F.size("adjustments")).alias("n_adjusted"))


def attenuation_upload(spark, sf_dir):
    moved = _findings(spark, sf_dir).withColumn("path", F.concat(F.when(F.col("doc_id") % 2 == 0, "uploads/").otherwise("src/"), "path"))
    return moved.transform(J.upload_data).groupBy("rule_id", "severity", "decision").agg(F.count("*").alias("n"), F.sum(F.size("adjustments")).alias("n_adjusted"))


def card_context(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    found = D.findings(lines, tuple(r for r in RULES if r.id == "RL-PII-CARD"))
    out = J.context_of(found, lines, 1, 1).transform(J.card_context)
    return out.select("path", "line_no", "severity", "decision", F.md5(F.col("context").cast("binary")).alias("context_md5"))


PROFILES = {"RL-PII-EMAIL": "block", "RL-NET-ANY-IP": "warn"}, {"licence": "warn"}


def profile_overrides(spark, sf_dir):
    out = J.apply_profile(_judged(spark, sf_dir), "low", *PROFILES)
    return out.groupBy("rule_id", "decision").agg(F.count("*").alias("n"))


def severity_min_filter(spark, sf_dir):
    return J.apply_profile(_judged(spark, sf_dir), "medium").groupBy("severity").agg(F.count("*").alias("n"))


EXCEPTIONS = [
    ("RL-PII-EMAIL", None, None, "known test address", "lead", "2027-01-01", 1),
    ("RL-PII-EMAIL", None, None, "", "lead", "2027-01-01", 0),
    ("RL-NET-ANY-IP", None, None, "documented range", "lead", "2026-01-01", 0),
    ("RL-PII-PHONE-ANY", None, 1, "switchboard", "lead", "2027-01-01", 2),
]


def exceptions_applied(spark, sf_dir):
    files = _files(spark, sf_dir).where("doc_id % 3 = 0").select("path").distinct()
    rows = spark.createDataFrame(EXCEPTIONS, "rule_id string, fingerprint string, line int, reason string, approved_by string, expires string, priority int").withColumn("expires", F.to_date("expires"))
    exceptions = files.withColumnRenamed("path", "file").join(F.broadcast(rows), F.lit(True))
    out = J.apply_exceptions(_judged(spark, sf_dir), exceptions, F.lit(TODAY).cast("date"))
    return out.groupBy("rule_id", "suppressed", "suppress_reason").agg(F.count("*").alias("n"))


def findings_summary(spark, sf_dir):
    return M.summary(_judged(spark, sf_dir))


def severity_summary(spark, sf_dir):
    return M.by_rule(_judged(spark, sf_dir))


def path_class_summary(spark, sf_dir):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("", "tests/", "examples/", "uploads/", "scripts/")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return M.by_path_class(_judged(spark, sf_dir).withColumn("path", F.concat(prefix, "path")))


def file_ranking(spark, sf_dir):
    return M.by_file(_judged(spark, sf_dir))


def multi_rule_lines(spark, sf_dir):
    return M.multi_rule_lines(_findings(spark, sf_dir))


def action_order(spark, sf_dir):
    return M.action_order(_judged(spark, sf_dir)).select("place", "tier", "rule_id", "severity", "decision", "n", "n_files")


def source_rollup(spark, sf_dir):
    found = _judged(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), "severity")
    return M.rollup(found, "source", "lang", "severity").select("source", "lang", "severity", "n")


def rules_per_language(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("lang", "rule_id").agg(F.count("*").alias("n"))


def duplicate_documents(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


#: Lines planted behind a turn or a document by its id, so that every rule about persons and networks meets something.
PLANTED_LINES = ("call +1 (212) 555-0143 today", "card 4111 1111 1111 1111 and card 4111 1111 1111 1112", "id 900101-1234567", "mail jo@mail.example or 10.1.2.3", "token = \"abc123def456\" password: hunter2horse", "host 172.20.0.9 beside 172.40.0.9", "use sk-abcdefghijklmnop1234 and sk-ponmlkjihgfedcba4321", "nothing to see")


def _planted(key: str):
    return F.element_at(F.array(*[F.lit(x) for x in PLANTED_LINES]), (F.col(key) % len(PLANTED_LINES) + 1).cast("int"))


def prompt_pii(spark, sf_dir):
    turns = X.table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").withColumn("text", F.concat("text", F.lit("\n"), _planted("conv_id")))
    own = turns.select("conv_id", "turn", F.lit(None).cast("string").alias("language"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    private = tuple(r for r in enforced() if r.category in ("privacy", "secret"))
    return D.matches(own.select("conv_id", "turn", "language", (F.col("at") + 1).alias("line_no"), "line"), private).select("conv_id", "turn", "line_no", "rule_id", "match")


def _planted_lines(spark, sf_dir):
    docs = X.spread(X.documents_as_files(X.table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")))
    return X.lines(docs.withColumn("text", F.concat("text", F.lit("\n"), _planted("doc_id"))), "path", "language", "doc_id", "lang", "source")


def internal_ip(spark, sf_dir):
    return D.matches(_planted_lines(spark, sf_dir), tuple(r for r in RULES if r.id == "RL-NET-PRIVATE-IP")).select("doc_id", "line_no", "match")


def planted_evidence(spark, sf_dir):
    """Evidence of lines with several values of a kind, of which none may come through whole."""
    return D.findings(_planted_lines(spark, sf_dir)).select("path", "line_no", "rule_id", "evidence")


def secret_only_findings(spark, sf_dir):
    from riskloom.operators.secrets import secret_only_findings as only

    return only(_planted_lines(spark, sf_dir)).select("path", "line_no", "rule_id", "decision", "evidence")


def exposure_counts(spark, sf_dir):
    from riskloom.operators.verdicts import exposure_counts as counts

    return counts(J.judged(D.findings(_planted_lines(spark, sf_dir)).withColumn("path", F.concat(F.when(F.col("doc_id") % 2 == 0, "tests/").otherwise("src/"), "path"))))


def script_tag_inventory(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?i)(<script)"), F.lit(1))).cast("long").alias("n_script"), F.size(F.regexp_extract_all("html", F.lit("(?i)(<a [^>]*href=)"), F.lit(1))).cast("long").alias("n_links"), F.length("html").alias("n_chars"))


def url_host_inventory(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.count_if(F.col("url").startswith("https://")).alias("n_https"))


def gate_verdict(spark, sf_dir):
    found = _judged(spark, sf_dir)
    scanned = _files(spark, sf_dir).groupBy("source").agg(F.count("*").alias("scanned"))
    counted = found.groupBy("source").agg(F.count("*").alias("findings"), F.bool_or(F.col("rule_id") == "RL-PII-CARD").alias("critical"))
    flags = scanned.join(counted, scanned["source"].eqNullSafe(counted["source"]), "left").select(scanned["source"], "scanned", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("critical", F.lit(False)).alias("critical"))
    flags = flags.withColumn("source_name", F.coalesce("source", F.lit("none"))).withColumn("source", F.col("findings") > 0).withColumn("vulnerable", F.lit(False)).withColumn("unchecked", F.lit(False)).withColumn("intel_missing", F.lit(False)).withColumn("coverage", F.lit(False))
    return M.gate(flags)


def context_fingerprints(spark, sf_dir):
    files = _files(spark, sf_dir).where("text is not null").select("doc_id", lines_of(F.col("text")).alias("own"))
    return files.where(F.size("own") > 0).select("doc_id", context_fingerprint(F.col("own"), F.lit(1)).alias("fingerprint"))


def minified_documents(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", X.looks_minified(F.col("text")).alias("minified"), F.exists(lines_of(F.col("text")), lambda x: F.length(x) > X.GIANT_LINE).alias("has_giant_line"))


def validators(spark, sf_dir):
    rows = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",), ("900101-1234567",), ("9001011234568",), ("9001011234567",), ("10.2.3.4",), ("172.40.0.1",), ("192.168.1.300",), ("token = token",), ("token = t0k3nvalue",), ("",)], "value string")
    known = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("value", known(V.luhn_ok(F.col("value"))).alias("luhn"), known(V.resident_number_ok(F.col("value"))).alias("resident"), V.not_self_named(F.col("value")).alias("named"))


_DOCUMENTS = "SELECT doc_id, concat_ws('/', coalesce(source, 'none'), 'doc' || doc_id) AS path, text, lang, source FROM documents WHERE text IS NOT NULL"
_PLANT = "list_extract([" + ", ".join(S.quote(x) for x in PLANTED_LINES) + "], CAST({} % " + str(len(PLANTED_LINES)) + " + 1 AS INTEGER))"
_WITH_LINES = "SELECT doc_id, concat_ws('/', coalesce(source, 'none'), 'doc' || doc_id) AS path, text || chr(10) || " + _PLANT.format("doc_id") + " AS text, lang, source FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"
_J = "WITH " + S.matches() + ",\n" + S.evidence() + "," + S.judged() + "\n"
_F = "WITH " + S.matches() + ",\n" + S.evidence() + "\n"
_P = "CASE WHEN doc_id % 2 = 0 THEN '{}/' ELSE 'src/' END || path"
_VALUE = "(category IN ('privacy', 'secret'))"
_RANK = S.rank_sql({"low": 0, "medium": 1, "high": 2, "critical": 3}, "severity")
_HIGHEST = f"list_extract(['low', 'medium', 'high', 'critical'], max({_RANK}) + 1)"
_EXC = " UNION ALL ".join(f"SELECT {S.quote(r)} AS e_rule, {S.quote(str(line)) if line else 'NULL'}::INTEGER AS e_line, {S.quote(reason)} AS e_reason, DATE {S.quote(exp)} AS e_exp, {pri} AS pri" for r, _, line, reason, _, exp, pri in EXCEPTIONS)

QUERIES = {
    "line_index": line_index, "doc_line_stats": doc_line_stats, "findings_union": findings_union, "evidence_masked": evidence_masked, "finding_ids": finding_ids,
    "findings_dedup": findings_dedup, "dedup_group_merge": dedup_group_merge, "evidence_policy": evidence_policy, "attenuation_test_path": attenuation_test_path, "attenuation_upload": attenuation_upload,
    "card_context": card_context, "profile_overrides": profile_overrides, "severity_min_filter": severity_min_filter, "exceptions_applied": exceptions_applied, "findings_summary": findings_summary,
    "severity_summary": severity_summary, "path_class_summary": path_class_summary, "file_ranking": file_ranking, "multi_rule_lines": multi_rule_lines, "action_order": action_order, "source_rollup": source_rollup,
    "rules_per_language": rules_per_language, "duplicate_documents": duplicate_documents, "prompt_pii": prompt_pii, "internal_ip": internal_ip, "planted_evidence": planted_evidence, "secret_only_findings": secret_only_findings, "exposure_counts": exposure_counts, "script_tag_inventory": script_tag_inventory, "url_host_inventory": url_host_inventory,
    "gate_verdict": gate_verdict, "context_fingerprints": context_fingerprints, "minified_documents": minified_documents, "validators": validators,
}

ORACLES = {
    "line_index": f"WITH {S.LINES} SELECT doc_id, line_no, CAST(length(line) AS INTEGER) AS n_chars, md5(line) AS line_md5 FROM lines",
    "doc_line_stats": f"WITH {S.LINES} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, count(*) FILTER (trim(line) = '') AS n_blank FROM lines GROUP BY doc_id",
    "findings_union": f"WITH {S.matches()} SELECT path, line_no, rule_id, match, severity, decision, category, confidence FROM matches",
    "evidence_masked": _F + "SELECT path, line_no, rule_id, evidence FROM findings",
    "finding_ids": _F + "SELECT path, line_no, rule_id, id FROM findings",
    "findings_dedup": f"WITH {S.matches()}, both_engines AS (SELECT path, line_no, rule_id, unnest(['regex', 'python-ast']) AS engine FROM matches) SELECT path, line_no, rule_id, arg_max(engine, CASE engine WHEN 'python-ast' THEN 2 ELSE 1 END) AS engine FROM both_engines GROUP BY ALL",
    "dedup_group_merge": _J + "SELECT path, line_no, rule_id, decision, also FROM judged",
    "evidence_policy": "WITH " + S.matches() + ",\n" + S.evidence() + "," + S.judged() + " SELECT p.rule_id, p.decision, count(*) AS n, CAST(count(*) FILTER (f.decision <> p.decision) AS BIGINT) AS n_adjusted FROM policed p JOIN findings f USING (id, rule_id, path, line_no) GROUP BY ALL",
    "attenuation_test_path": f"WITH {S.matches()}, moved AS (SELECT *, {_P.format('tests')} AS p FROM matches), low AS (SELECT *, {_VALUE} AND {S.path_class('p')} = 'test' AS t FROM moved), done AS (SELECT rule_id, CASE WHEN t THEN 'low' ELSE severity END AS s2, CASE WHEN t AND decision = 'block' THEN 'warn' ELSE decision END AS d2, severity, decision FROM low) SELECT rule_id, s2 AS severity, d2 AS decision, count(*) AS n, CAST(count(*) FILTER (s2 <> severity OR d2 <> decision) AS BIGINT) AS n_adjusted FROM done GROUP BY rule_id, s2, d2",
    "attenuation_upload": f"WITH {S.matches()}, moved AS (SELECT *, {_P.format('uploads')} AS p FROM matches), low AS (SELECT *, NOT {_VALUE} AND {S.path_class('p')} = 'upload-data' AS t FROM moved), done AS (SELECT rule_id, CASE WHEN t THEN 'low' ELSE severity END AS s2, CASE WHEN t AND decision = 'block' THEN 'warn' ELSE decision END AS d2, severity, decision FROM low) SELECT rule_id, s2 AS severity, d2 AS decision, count(*) AS n, CAST(count(*) FILTER (s2 <> severity OR d2 <> decision) AS BIGINT) AS n_adjusted FROM done GROUP BY rule_id, s2, d2",
    "card_context": f"WITH {S.matches(tuple(r for r in RULES if r.id == 'RL-PII-CARD'))}, near AS (SELECT m.path, m.line_no, m.severity, m.decision, string_agg(l.line, chr(10) ORDER BY l.line_no) AS context FROM matches m JOIN lines l ON l.path = m.path AND l.line_no BETWEEN m.line_no - 1 AND m.line_no + 1 GROUP BY ALL), j AS (SELECT *, regexp_matches(context, '(?i)\\b(code|sku|item|part|serial|barcode|model)\\b') AND NOT regexp_matches(context, '(?i)(card|payment|cvv|cvc|billing|checkout)') AS item FROM near) SELECT path, line_no, CASE WHEN item THEN 'medium' ELSE severity END AS severity, CASE WHEN item THEN 'warn' ELSE decision END AS decision, md5(context) AS context_md5 FROM j",
    "profile_overrides": _J + "SELECT rule_id, CASE WHEN rule_id = 'RL-PII-EMAIL' OR contains(also, 'RL-PII-EMAIL') THEN 'block' WHEN rule_id = 'RL-NET-ANY-IP' OR contains(also, 'RL-NET-ANY-IP') THEN 'warn' WHEN category = 'licence' THEN 'warn' ELSE decision END AS decision, count(*) AS n FROM judged GROUP BY ALL",
    "severity_min_filter": _J + "SELECT severity, count(*) AS n FROM judged WHERE severity <> 'low' GROUP BY severity",
    "exceptions_applied": "WITH " + S.matches() + ",\n" + S.evidence() + "," + S.judged() + f""",
exc AS ({_EXC}), hit AS (SELECT j.*, e.e_reason, row_number() OVER (PARTITION BY j.id, j.path, j.line_no, j.rule_id ORDER BY e.pri NULLS LAST) AS k FROM judged j
  LEFT JOIN exc e ON j.doc_id % 3 = 0 AND (j.rule_id = e.e_rule OR contains(j.also, e.e_rule)) AND (e.e_line IS NULL OR e.e_line = j.line_no) AND trim(e.e_reason) <> '' AND e.e_exp >= DATE '{TODAY}')
SELECT rule_id, e_reason IS NOT NULL AS suppressed, e_reason AS suppress_reason, count(*) AS n FROM hit WHERE k = 1 GROUP BY ALL""",
    "findings_summary": _J + "SELECT count(*) AS n_findings, count(DISTINCT (path, line_no)) AS n_locations, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ("low", "medium", "high", "critical")) + ", " + ", ".join(f"count(*) FILTER (decision = '{d}') AS n_{d}" for d in ("allow", "warn", "block")) + f", coalesce(bool_or(decision = 'block'), false) AS blocked, {_HIGHEST} AS highest FROM judged",
    "severity_summary": _J + "SELECT rule_id, severity, decision, count(*) AS n, count(DISTINCT path) AS n_files FROM judged GROUP BY ALL",
    "path_class_summary": _J + f"SELECT {S.path_class('p')} AS path_class, count(*) AS n, count(*) FILTER (decision = 'block') AS n_block FROM (SELECT *, list_extract(['', 'tests/', 'examples/', 'uploads/', 'scripts/'], CAST(doc_id % 5 + 1 AS INTEGER)) || path AS p FROM judged) GROUP BY ALL",
    "file_ranking": _J + f"SELECT path, count(*) AS n, {_HIGHEST} AS highest FROM judged GROUP BY path",
    "multi_rule_lines": f"WITH {S.matches()} SELECT path, line_no, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, count(DISTINCT rule_id) AS n_rules FROM matches GROUP BY path, line_no HAVING count(DISTINCT rule_id) >= 2",
    "action_order": _J + f", g AS (SELECT rule_id, severity, decision, count(*) AS n, count(DISTINCT path) AS n_files FROM judged GROUP BY ALL), t AS (SELECT *, CASE WHEN decision = 'block' THEN 0 WHEN severity IN ('critical', 'high') THEN 1 ELSE 2 END AS tier FROM g) SELECT CAST(row_number() OVER (ORDER BY tier, {_RANK} DESC, n DESC, rule_id) AS INTEGER) AS place, tier, rule_id, severity, decision, n, n_files FROM t",
    "source_rollup": _J + ", s AS (SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, severity FROM judged) SELECT source, lang, severity, count(*) AS n FROM s GROUP BY GROUPING SETS ((source), (lang), (severity), ())",
    "rules_per_language": _J + "SELECT lang, rule_id, count(*) AS n FROM judged GROUP BY ALL",
    "duplicate_documents": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "prompt_pii": "WITH " + S.matches(tuple(r for r in enforced() if r.category in ("privacy", "secret"))).replace(_DOCUMENTS, "SELECT conv_id AS doc_id, CAST(turn AS VARCHAR) AS path, text || chr(10) || " + _PLANT.format("conv_id") + " AS text, turn AS lang, conv_id AS source FROM conversations WHERE role = 'user' AND text IS NOT NULL") + " SELECT doc_id AS conv_id, lang AS turn, line_no, rule_id, match FROM matches",
    "internal_ip": f"WITH {S.matches(tuple(r for r in RULES if r.id == 'RL-NET-PRIVATE-IP')).replace(_DOCUMENTS, _WITH_LINES)} SELECT doc_id, line_no, match FROM matches",
    "planted_evidence": _F.replace(_DOCUMENTS, _WITH_LINES) + "SELECT path, line_no, rule_id, evidence FROM findings",
    "secret_only_findings": ("WITH " + S.matches(tuple(r for r in RULES if r.category == "secret")) + ",\n" + S.evidence() + " SELECT path, line_no, rule_id, decision, evidence FROM findings").replace(_DOCUMENTS, _WITH_LINES),
    "exposure_counts": f"WITH {S.matches()}, e AS (SELECT *, doc_id % 2 = 0 AS t, CASE WHEN doc_id % 2 = 0 THEN 'low' ELSE severity END AS s2, CASE WHEN doc_id % 2 = 0 AND decision = 'block' THEN 'warn' ELSE decision END AS d2 FROM matches WHERE category IN ('privacy', 'secret')), g AS (SELECT *, row_number() OVER (PARTITION BY path, line_no, coalesce(dedup_group, rule_id) ORDER BY {S.rank_sql(CONFIDENCE, 'confidence')} DESC, {S.rank_sql(SEVERITY, 's2')} DESC, {S.rank_sql(DECISION, 'd2')} DESC, rule_id) AS k FROM e) SELECT category, count(*) FILTER (s2 = severity AND d2 = decision) AS live, count(*) FILTER (s2 <> severity OR d2 <> decision) AS lowered, count(*) FILTER (d2 = 'block') AS blocking FROM g WHERE k = 1 GROUP BY category".replace(_DOCUMENTS, _WITH_LINES),
    "script_tag_inventory": "SELECT page_id, len(regexp_extract_all(html, '(?i)<script')) AS n_script, len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS n_links, length(html) AS n_chars FROM pages",
    "url_host_inventory": "SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, count(*) AS n_pages, min(page_id) AS first_page, count(*) FILTER (starts_with(url, 'https://')) AS n_https FROM pages GROUP BY 1",
    "gate_verdict": _J + ", s AS (SELECT source, count(*) AS scanned FROM documents GROUP BY source), c AS (SELECT source, count(*) AS findings, bool_or(rule_id = 'RL-PII-CARD') AS critical FROM judged GROUP BY source), f AS (SELECT coalesce(s.source, 'none') AS source_name, coalesce(findings, 0) AS findings, coalesce(critical, false) AS critical FROM s LEFT JOIN c ON s.source IS NOT DISTINCT FROM c.source), v AS (SELECT *, CASE WHEN critical THEN 'blocked' WHEN findings > 0 THEN 'conditional' ELSE 'approved' END AS verdict FROM f) SELECT source_name, verdict, CASE WHEN critical THEN 'critical' ELSE '' END AS block_reasons, CASE WHEN findings > 0 THEN 'source' ELSE '' END AS conditional_criteria, CASE verdict WHEN 'approved' THEN 0 WHEN 'conditional' THEN 1 ELSE 2 END AS exit_code FROM v",
    "context_fingerprints": f"WITH {S.LINES} SELECT doc_id, substr(sha256(string_agg(trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' '), chr(10) ORDER BY line_no)), 1, 16) AS fingerprint FROM lines WHERE line_no <= 3 GROUP BY doc_id",
    "minified_documents": f"WITH {S.LINES}, u AS (SELECT doc_id, regexp_replace(text, 'data:[a-z/+.-]+;base64,[A-Za-z0-9+/=]+', '', 'g') AS t FROM files), z AS (SELECT doc_id, t, list_sort(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: length(x))) AS s FROM u), g AS (SELECT doc_id, max(length(line)) AS longest FROM lines GROUP BY doc_id) SELECT z.doc_id, length(t) >= 1000 AND ((len(s) <= 5 AND s[len(s)] >= 2000) OR s[len(s) // 2 + 1] >= 400) AS minified, coalesce(longest > {X.GIANT_LINE}, false) AS has_giant_line FROM z LEFT JOIN g USING (doc_id)",
}
for _name, _rule in {"pii_email": "RL-PII-EMAIL", "pii_phone": "RL-PII-PHONE-US", "pii_card_luhn": "RL-PII-CARD", "hardcoded_assignment": "RL-SECRET-ASSIGN", "license_mentions": "RL-LICENCE-TEXT"}.items():
    QUERIES[_name], ORACLES[_name] = _by_rule(_rule)
_ROWS = ", ".join(f"({S.quote(v)})" for v in ("4111 1111 1111 1111", "4111 1111 1111 1112", "900101-1234567", "9001011234568", "9001011234567", "10.2.3.4", "172.40.0.1", "192.168.1.300", "token = token", "token = t0k3nvalue", ""))
ORACLES["validators"] = f"SELECT value, coalesce({S.luhn('value')}, false) AS luhn, coalesce({S.resident_number('value')}, false) AS resident, {S.not_self_named('value')} AS named FROM (VALUES {_ROWS}) t(value)"
