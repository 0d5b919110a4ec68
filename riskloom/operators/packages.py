"""Packages against advisories and feeds: three-valued version logic, verdict ladders, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.package import advisory_name, cve_ids, index_name, licence_verdict
from riskloom.functions.version import cooled_down, interval_contains, is_prerelease, npm_bounds, prerelease, version_key
from riskloom.ranks import ADVISORY, name_of, rank

# fixed values: names often imitated, by ecosystem
POPULAR = {
    "npm": ("express", "lodash", "react", "axios", "chalk", "commander", "moment", "webpack", "vue", "next", "typescript", "eslint", "prettier", "jest", "minimist", "debug", "async", "request", "bluebird", "underscore"),
    "pypi": ("requests", "numpy", "pandas", "django", "flask", "scipy", "matplotlib", "pytest", "urllib3", "setuptools", "cryptography", "sqlalchemy", "pillow", "boto3", "pyyaml", "fastapi", "pydantic", "tensorflow", "beautifulsoup4", "scikit-learn"),
}
VERDICTS = ("malicious", "not_found", "vulnerable", "cooldown_hold", "suspicious_name", "version_not_found", "checked_stale", "checked_clean", "unknown", "error", "registry_approved", "registry_rejected", "unsupported_env_grade")
MANIFEST_LIMIT, LOCKFILE_LIMIT = 20, 2000
# fixed values: what a registry may answer, and for how many days old feeds leave an approval standing
REGISTRY_STATES = ("APPROVED", "REJECTED", "UNDER_REVIEW", "UNKNOWN")
APPROVAL_GRACE_DAYS = 30


def intervals(events: Column) -> Column:
    """Events of a range folded to array<struct<start,end,inclusive>> of version keys: introduced opens, fixed, limit or last_affected close."""
    kind = "array<struct<start:array<int>,end:array<int>,inclusive:boolean>>"
    start = F.struct(F.lit(None).cast("array<int>").alias("open"), F.array().cast(kind).alias("done"))

    def step(acc: Column, e: Column) -> Column:
        closes = F.coalesce(e["fixed"], e["limit"], e["last_affected"])
        piece = F.struct(acc["open"].alias("start"), version_key(closes).alias("end"), (e["fixed"].isNull() & e["limit"].isNull()).alias("inclusive"))
        return (
            F.when(e["introduced"].isNotNull(), F.struct(F.coalesce(version_key(e["introduced"]), F.array(F.lit(0))).alias("open"), acc["done"].alias("done")))
            .when(closes.isNotNull() & acc["open"].isNotNull(), F.struct(F.lit(None).cast("array<int>").alias("open"), F.array_append(acc["done"], piece).alias("done")))
            .otherwise(acc)
        )

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["open"].alias("start"), F.lit(None).cast("array<int>").alias("end"), F.lit(False).alias("inclusive"))
        return F.when(acc["open"].isNotNull(), F.array_append(acc["done"], rest)).otherwise(acc["done"])

    return F.aggregate(events, start, step, finish)


def kleene_any(values: Column) -> Column:
    """True if any is, else null if any is null, else false."""
    return F.when(F.coalesce(F.exists(values, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)), F.lit(True)).when(F.exists(values, lambda x: x.isNull()), F.lit(None)).otherwise(F.lit(False))


def version_in(version: Column, versions: Column, spans: Column) -> Column:
    """Whether a version is affected: listed, or inside an interval; null where that can't be told.

    A prerelease of an interval's first version, and an unreadable version not listed, can't be told.
    """
    key = version_key(version)
    listed = F.exists(F.coalesce(versions, F.array().cast("array<string>")), lambda v: (v == version) | (version_key(v).isNotNull() & (version_key(v) == key) & (prerelease(v) == prerelease(version))))
    edge = lambda s: (prerelease(version) != "") & ((key == s["start"]) | (key == s["end"]))
    inside = F.transform(F.coalesce(spans, F.array().cast("array<struct<start:array<int>,end:array<int>,inclusive:boolean>>")), lambda s: F.when(key.isNull() | edge(s), F.lit(None)).otherwise(interval_contains(s["start"], s["end"], s["inclusive"], key)))
    return F.when(F.coalesce(listed, F.lit(False)), F.lit(True)).otherwise(kleene_any(inside))


def affected_rows(advisories: DataFrame) -> DataFrame:
    """One row for each advisory and package it names, with normalised name and folded intervals."""
    one = advisories.select("id", "aliases", "severity", F.explode("affected").alias("a"))
    return one.select(
        "id", "aliases", "severity", F.lower("a.ecosystem").alias("ecosystem"), advisory_name(F.col("a.name"), F.col("a.ecosystem")).alias("name_key"), F.col("a.versions").alias("versions"),
        F.flatten(F.transform(F.coalesce(F.col("a.ranges"), F.array()), lambda r: intervals(r["events"]))).alias("spans"),
    )


def vulnerability_matches(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages with the advisories of their name and whether each holds; a package without version gets them all.

    Joined on ecosystem and name; the interval test is what is left after that.
    """
    p = packages.select("ecosystem", "name", "version", F.lower("ecosystem").alias("p_eco"), advisory_name(F.col("name"), F.col("ecosystem")).alias("p_key"))
    a = affected_rows(advisories)
    joined = p.join(a, (p["p_eco"] == a["ecosystem"]) & (p["p_key"] == a["name_key"]))
    hit = F.when(F.col("version").isNull(), F.lit(True)).otherwise(version_in(F.col("version"), F.col("versions"), F.col("spans")))
    return joined.select(p["ecosystem"], "name", "version", "id", "aliases", "severity", hit.alias("affected"))


def malicious_scope(version: Column, exact: Column, recognized: Column, ecosystem: Column, spec: Column, versions: Column, spans: Column, has_ranges: Column) -> Column:
    """struct(scope, reason): hit, miss or possible. Without grounds that a package is genuine, doubt blocks."""
    known = F.size(F.coalesce(versions, F.array().cast("array<string>"))) > 0
    whole = F.exists(spans, lambda s: (s["start"] == F.array(F.lit(0))) & s["end"].isNull())
    closed = (F.size(spans) > 0) & F.forall(spans, lambda s: s["end"].isNotNull())
    npm = F.lower(ecosystem) == "npm"
    fixed = exact & ~(npm & ~version.rlike(r"^\d+\.\d+\.\d+([-+][0-9A-Za-z.-]+)?$"))
    answer = lambda scope, reason: F.struct(scope.alias("scope"), F.lit(reason).alias("reason"))
    doubt = lambda reason: answer(F.when(recognized, "possible").otherwise("hit"), reason)
    bounds = npm_bounds(spec)
    keys = F.filter(F.transform(F.coalesce(versions, F.array().cast("array<string>")), version_key), lambda k: k.isNotNull())
    outside = npm & bounds.isNotNull() & (F.size(keys) > 0) & ~has_ranges & ~F.exists(keys, lambda k: (k >= bounds["lo"]) & (k < bounds["hi"]))
    inside = version_in(version, versions, spans)
    return (
        F.when(whole, answer(F.lit("hit"), ""))
        .when(~known & ~has_ranges, doubt("advisory_without_versions"))
        .when(version.isNull(), doubt("version_unpinned"))
        .when(~fixed & outside, F.when(recognized, answer(F.lit("miss"), "")).otherwise(answer(F.lit("possible"), "version_outside_unverified")))
        .when(~fixed, doubt("version_range"))
        .when(inside, answer(F.lit("hit"), ""))
        .when(inside.isNull(), doubt("version_unparsed"))
        .when(recognized | closed, answer(F.lit("miss"), ""))
        .otherwise(answer(F.lit("possible"), "version_outside_unverified"))
    )


def malicious_matches(packages: DataFrame, advisories: DataFrame, genuine: DataFrame) -> DataFrame:
    """Packages by malicious advisory with the strongest scope; genuine: (ecosystem, name_key) of names with ordinary advisories."""
    a = affected_rows(advisories.where(F.col("id").startswith("MAL-")))
    p = packages.withColumn("p_eco", F.lower("ecosystem")).withColumn("p_key", advisory_name(F.col("name"), F.col("ecosystem")))
    g = genuine.select(F.col("ecosystem").alias("g_eco"), F.col("name_key").alias("g_key")).distinct().withColumn("recognized", F.lit(True))
    joined = p.join(a.drop("severity", "aliases").withColumnRenamed("ecosystem", "a_eco"), (F.col("p_eco") == F.col("a_eco")) & (F.col("p_key") == F.col("name_key")))
    joined = joined.join(g, (F.col("p_eco") == F.col("g_eco")) & (F.col("p_key") == F.col("g_key")), "left")
    scope = malicious_scope(F.col("version"), F.coalesce("version_exact", F.lit(False)), F.coalesce("recognized", F.lit(False)), F.col("ecosystem"), F.col("spec"), F.col("versions"), F.col("spans"), F.size("spans") > 0)
    order = F.when(F.col("s.scope") == "hit", 2).when(F.col("s.scope") == "possible", 1).otherwise(0)
    return joined.withColumn("s", scope).groupBy("ecosystem", "name", "version", "id").agg(F.max_by("s.scope", order).alias("scope"), F.max_by("s.reason", order).alias("reason"))


def kev_hits(advisories: DataFrame, kev: DataFrame) -> DataFrame:
    """Advisories one of whose CVE ids is known to be exploited."""
    ids = advisories.select("id", F.explode(cve_ids(F.col("id"), F.col("aliases"))).alias("cve"))
    return ids.join(kev.select(F.col("cveID").alias("cve")), "cve", "left_semi")


def enriched(cves: DataFrame, epss: DataFrame, nvd: DataFrame) -> DataFrame:
    """CVEs with exploitation score and base score; rejected entries give none."""
    n = nvd.where(F.coalesce(F.col("vulnStatus"), F.lit("")) != "Rejected").select(F.col("id").alias("cve"), "cvss31_base_score")
    return cves.join(epss.select("cve", "epss", "percentile"), "cve", "left").join(n, "cve", "left")


def typosquats(packages: DataFrame, distance: int = 2) -> DataFrame:
    """Names one or two edits from a popular one of their ecosystem, five letters or more and not popular themselves.

    The popular names are a fixed list, broadcast; lengths bound the comparison before the distance does.
    """
    spark = packages.sparkSession
    popular = spark.createDataFrame([(e, n) for e, names in POPULAR.items() for n in names], "eco string, similar_to string")
    p = packages.select("ecosystem", "name", F.lower("ecosystem").alias("eco"), F.lower("name").alias("low")).where(F.length("low") >= 5).join(F.broadcast(popular.withColumnRenamed("similar_to", "low")), ["eco", "low"], "left_anti")
    near = p.join(F.broadcast(popular), (p["eco"] == popular["eco"]) & (F.abs(F.length("low") - F.length("similar_to")) <= distance) & F.levenshtein("low", "similar_to", distance).between(1, distance))
    return near.select("ecosystem", "name", "similar_to", F.levenshtein("low", "similar_to").alias("edit_distance"))


def local_verdict(c: DataFrame) -> DataFrame:
    """The offline ladder over flags: feeds, malicious, vulnerable, mal_covered, stale, undetermined, vuln_covered, grade_ok."""
    verdict = (
        F.when(~F.col("grade_ok"), "unsupported_env_grade")
        .when(~F.col("feeds"), "unknown")
        .when(F.col("malicious"), "malicious")
        .when(F.col("vulnerable"), "vulnerable")
        .when(~F.col("mal_covered"), "unknown")
        .when(F.col("stale"), "checked_stale")
        .when(F.col("undetermined"), "unknown")
        .when(F.col("vuln_covered"), "checked_clean")
        .otherwise("unknown")
    )
    return c.withColumn("verdict", verdict).withColumn("requires_review", F.col("verdict") != "registry_approved")


def online_verdict(c: DataFrame) -> DataFrame:
    """The ladder with registry data: exists, malicious, vulnerable, kev, max_severity, age_days, grade, version, version_exact, version_exists, edit_distance, resolved."""
    severe = F.col("kev") | F.col("max_severity").isin("HIGH", "CRITICAL")
    verdict = (
        F.when(~F.coalesce(F.col("exists"), F.lit(True)), "not_found")
        .when(F.col("malicious"), "malicious")
        .when(F.col("vulnerable"), "vulnerable")
        .when(F.coalesce(~cooled_down(F.col("age_days"), F.col("grade")), F.lit(False)), "cooldown_hold")
        .when((F.col("version_exists") == F.lit(False)) & ~F.col("version_exact"), "unknown")
        .when(F.col("version_exists") == F.lit(False), "version_not_found")
        .when(F.col("edit_distance") == 1, "suspicious_name")
        .when(~F.col("resolved"), "unknown")
        .otherwise("checked_clean")
    )
    severity = F.when(verdict == "malicious", "critical").when(verdict == "vulnerable", F.when(F.col("version").isNull(), "medium").when(severe, "high").otherwise("medium")).when(verdict.isin("version_not_found", "suspicious_name", "not_found"), "high").when(verdict == "unknown", "low").otherwise("low")
    return c.withColumn("verdict", verdict).withColumn("severity", severity)


def registry_decision(local: DataFrame, decisions: DataFrame) -> DataFrame:
    """Local verdicts joined to a registry's decisions (ecosystem, name, version, decision, cached_stale).

    local: ecosystem, name, version, verdict, severity, kev, possible (a malicious
    advisory that may hold), compared (feeds were there and fresh), feed_age (days,
    null if unknown). A rejection wins, be it a stale one. An approval wins over all but
    malicious packages, exploited vulnerabilities and possible malice, a vulnerable
    verdict among them; feeds that are too old for too long then ask for review. A
    status nobody knows is no answer.
    """
    d = decisions.select("ecosystem", "name", "version", F.upper("decision").alias("decision"), F.coalesce("cached_stale", F.lit(False)).alias("cached_stale"))
    j = local.join(d, ["ecosystem", "name", "version"], "left")
    rejected = F.col("decision").eqNullSafe("REJECTED")
    held = (F.col("verdict") == "malicious") | F.coalesce("kev", F.lit(False)) | F.coalesce("possible", F.lit(False))
    approved = F.col("decision").eqNullSafe("APPROVED") & ~held
    compared = F.coalesce("compared", F.lit(False))
    too_old = F.coalesce(F.col("feed_age") > APPROVAL_GRACE_DAYS, F.lit(False))
    return j.select(
        "ecosystem", "name", "version",
        F.when(rejected, "registry_rejected").when(approved, "registry_approved").otherwise(F.col("verdict")).alias("verdict"),
        F.when(rejected, "critical").when(approved, "info").otherwise(F.col("severity")).alias("severity"),
        F.when(rejected, F.lit(True)).when(approved, too_old | (~compared & F.col("feed_age").isNull())).otherwise(~F.col("verdict").isin("checked_clean")).alias("requires_review"),
        F.when(approved, compared).otherwise(F.col("verdict").isin("checked_clean", "vulnerable", "malicious")).alias("checked"),
        F.when(F.col("decision").isNull(), "not_asked").when(F.col("decision").isin(*REGISTRY_STATES), "ok").otherwise("item_failed").alias("registry_status"),
        (rejected & F.col("cached_stale")).alias("stale_rejection"),
    )


def highest_version(versions: DataFrame, by: str) -> DataFrame:
    own = versions.withColumn("k", version_key(F.col("version"))).where("k is not null")
    return own.groupBy(by).agg(F.max_by("version", "k").alias("highest"))


def target_version(current: Column, fixes: Column) -> Column:
    """The nearest fix: in the branch and stable, in the branch, the lowest ahead and stable, the lowest ahead; null if none."""
    key = version_key(current)
    ahead = F.filter(fixes, lambda f: version_key(f).isNotNull() & (version_key(f) > key))
    branch = F.filter(ahead, lambda f: F.get(version_key(f), F.lit(0)) == F.get(key, F.lit(0)))
    lowest = lambda xs: F.element_at(F.array_sort(F.transform(xs, lambda f: F.struct(version_key(f).alias("k"), f.alias("v")))), 1)["v"]
    first = lambda xs: F.when(F.size(xs) > 0, lowest(xs))
    stable = lambda xs: F.filter(xs, lambda f: ~is_prerelease(f))
    return F.coalesce(first(stable(branch)), first(branch), first(stable(ahead)), first(ahead))


def recommended(rows: DataFrame, by: str) -> DataFrame:
    """The highest of a package's targets; null where one advisory has none. rows: by, target."""
    own = rows.withColumn("k", version_key(F.col("target")))
    return own.groupBy(by).agg(F.when(F.bool_or(F.col("target").isNull()), F.lit(None)).otherwise(F.max_by("target", "k")).alias("recommended"), F.count_if(F.col("target").isNull()).alias("unfixed"))


def advisory_groups(advisories: DataFrame) -> DataFrame:
    """id, group_id (the smallest id that shared ids and aliases lead to): rounds over (id, name) rows until no label changes.

    Each round takes the smallest label by name, then the label of that label, so
    chains halve. Rounds end their lineage with a checkpoint where a folder is set.
    """
    reliable = advisories.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    kept = lambda df: df.checkpoint(eager=True) if reliable else df.persist()
    names = kept(advisories.select("id", F.explode(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).distinct())
    labels = kept(names.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        low = names.join(labels, "id").groupBy("name").agg(F.min("label").alias("low"))
        near = names.join(low, "name").groupBy("id").agg(F.min("low").alias("near"))
        jumped = near.join(labels.select(F.col("id").alias("near"), F.col("label").alias("far")), "near", "left")
        after = kept(jumped.select("id", F.least("near", F.coalesce("far", "near")).alias("label")))
        changed = after.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").limit(1).count()
        labels = after
        if not changed:
            return labels.withColumnRenamed("label", "group_id")


def prioritized(rows: DataFrame) -> DataFrame:
    """Advisories by exploitation, severity and input order. rows: package, id, severity, kev, seq."""
    order = Window.partitionBy("package").orderBy(F.col("kev").desc(), rank(ADVISORY, "severity", 1).desc(), "seq")
    return rows.withColumn("priority", F.row_number().over(order))


def max_severity(rows: DataFrame, by: str) -> DataFrame:
    """NONE without advisories, UNKNOWN for one without label: unlabelled is not safe. rows: by, id, severity."""
    return rows.groupBy(by).agg(name_of(ADVISORY, F.max(F.when(F.col("id").isNull(), 0).otherwise(rank(ADVISORY, F.upper(F.coalesce("severity", F.lit("UNKNOWN"))), 1)))).alias("max_severity"))


def previous_release(releases: DataFrame) -> DataFrame:
    """Each stable release with the one before it by version: maintainers, size, hooks, repository compared."""
    stable = releases.where(~is_prerelease(F.col("version"))).withColumn("k", version_key(F.col("version"))).where("k is not null")
    w = Window.partitionBy("name").orderBy("k")
    before = lambda c: F.lag(c).over(w)
    change = F.try_divide((F.col("size") - before("size")).cast("double"), before("size").cast("double"))
    return stable.select(
        "name", "version", before("version").alias("previous"), F.coalesce(~F.col("maintainer").eqNullSafe(before("maintainer")) & before("version").isNotNull(), F.lit(False)).alias("maintainer_changed"),
        F.coalesce(F.abs(change) >= 0.3, F.lit(False)).alias("size_jump"), F.coalesce(F.col("install_hook") & ~before("install_hook"), F.lit(False)).alias("hook_added"),
    )


def upsert(before: DataFrame, new: DataFrame, key: str, newest: str, cap: int) -> DataFrame:
    """Rows by key, the newest kept, new ones on ties; the newest cap keys stay."""
    both = before.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(newest).desc(), F.col("src").desc())
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "src").orderBy(F.col(newest).desc(), key).limit(cap)


def shadowed_manifests(files: DataFrame) -> DataFrame:
    """Manifests without a lockfile of their ecosystem in the same folder. files: path, ecosystem, kind."""
    folder = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    own = files.withColumn("folder", folder)
    locks = own.where("kind = 'lock'").select("folder", "ecosystem").distinct()
    return own.where("kind = 'manifest'").join(locks, ["folder", "ecosystem"], "left_anti").select("path", "ecosystem")


def merged_components(checks: DataFrame) -> DataFrame:
    """One row a component over all audits: the heaviest verdict, first audit on ties, all sources."""
    weight = F.when(F.col("verdict").isin("malicious", "not_found"), 3).when(F.col("verdict") == "vulnerable", 2).otherwise(1)
    return checks.groupBy("ecosystem", "name", "version").agg(F.max_by("verdict", F.struct(weight, -F.col("seq"))).alias("verdict"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def licence_column(text: Column) -> Column:
    return licence_verdict(text)


def shard_of(name: Column, shards: int = 256) -> Column:
    """The shard of a name in an index by hash."""
    return F.conv(F.substring(F.sha2(index_name(name), 256), 1, 2), 16, 10).cast("int") % shards
