"""From feeds to verdicts: packages against malicious, vulnerability and exploitation feeds, manifests as a whole, and what a gate asks of the results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.package import cve_ids, licence_verdict
from riskloom.functions.version import cooled_down, grade_supported
from riskloom.operators.packages import LOCKFILE_LIMIT, MANIFEST_LIMIT, affected_rows, kev_hits, local_verdict, malicious_matches, max_severity, vulnerability_matches
from riskloom.ranks import ADVISORY, rank

SEVERE = ("HIGH", "CRITICAL")
#: Words on a line that say what is counted there guards secrets or personal data.
NOTICE_COLUMNS = ("link", "title", "cve_ids")


@dataclass(frozen=True)
class Source:
    """State of a feed: when it was fetched, for how many days that holds, and the ecosystems it covers (lower case)."""

    fetched_on: date
    days: int = 7
    ecosystems: tuple[str, ...] = ("pypi",)

    def stale(self, today: date) -> bool:
        return (today - self.fetched_on).days > self.days


@dataclass(frozen=True)
class Feeds:
    """Feeds as tables, and the state of each that is there: malicious, vulnerable, kev. A feed without state was never fetched."""

    advisories: DataFrame
    kev: DataFrame
    states: Mapping[str, Source]
    today: date


def offline_check(packages: DataFrame, feeds: Feeds, grade: str = "E1") -> DataFrame:
    """Each different package (ecosystem, name, version, version_exact, spec) with its verdict from feeds alone.

    verdict, severity, n_malicious, n_vulnerable, n_undetermined, max_severity, kev,
    possible (a malicious advisory that may hold), stale. Nothing found is clean only
    where fresh feeds cover the ecosystem and every advisory could be told; existence
    and age stay unknown. A null version gets the advisories of all versions, at medium
    at most. An empty table gives no rows.
    """
    states, today = feeds.states, feeds.today
    # an unknown version is a row like any other: keys are compared with nulls equal
    key = F.concat_ws("\x01", F.lower("ecosystem"), "name", F.coalesce("version", F.lit("\x02")))
    packages = packages.select("ecosystem", "name", "version", "version_exact", "spec").withColumn("key", key).dropDuplicates(["key"])
    ordinary = feeds.advisories.where(~F.col("id").startswith("MAL-"))
    covered = lambda source: F.lower("ecosystem").isin(*states[source].ecosystems) if source in states else F.lit(False)
    out = packages.withColumn("mal_covered", covered("malicious")).withColumn("vuln_covered", covered("vulnerable"))
    keyed = lambda df: df.withColumn("key", key)
    if "malicious" in states:
        genuine = affected_rows(ordinary).select("ecosystem", "name_key")
        mal = keyed(malicious_matches(packages.drop("key"), feeds.advisories, genuine)).groupBy("key").agg(F.count_if(F.col("scope") == "hit").alias("n_malicious"), F.bool_or(F.col("scope") == "possible").alias("possible"), F.sort_array(F.collect_set(F.when(F.col("scope") == "hit", F.col("reason")))).alias("mal_reasons"))
        out = out.join(mal, "key", "left")
    else:
        out = out.withColumns({"n_malicious": F.lit(0), "possible": F.lit(False), "mal_reasons": F.array().cast("array<string>")})
    if "vulnerable" in states:
        met = keyed(vulnerability_matches(packages.drop("key"), ordinary))
        exploited = kev_hits(ordinary, feeds.kev).select("id").distinct().withColumn("exploited", F.lit(True)) if "kev" in states else None
        met = met.withColumn("exploited", F.lit(False)) if exploited is None else met.join(exploited, "id", "left")
        hit = F.coalesce("affected", F.lit(False))
        vul = met.groupBy("key").agg(
            F.count_if(hit).alias("n_vulnerable"), F.count_if(F.col("affected").isNull()).alias("n_undetermined"),
            F.max(F.when(hit, rank(ADVISORY, F.upper(F.coalesce("severity", F.lit("UNKNOWN"))), 1))).alias("worst"), F.bool_or(hit & F.coalesce("exploited", F.lit(False))).alias("kev"),
        )
        out = out.join(vul, "key", "left")
    else:
        out = out.withColumns({"n_vulnerable": F.lit(0), "n_undetermined": F.lit(0), "worst": F.lit(None).cast("int"), "kev": F.lit(False)})
    out = out.fillna(0, ["n_malicious", "n_vulnerable", "n_undetermined"]).fillna(False, ["possible", "kev"])
    stale = any(s.stale(today) for s in states.values())
    flags = out.withColumns({
        "grade_ok": grade_supported(F.lit(grade)), "feeds": F.lit(bool(states)), "malicious": F.col("n_malicious") > 0,
        "vulnerable": (F.col("n_vulnerable") > 0) & F.col("vuln_covered"), "stale": F.lit(stale), "undetermined": (F.col("n_undetermined") > 0) | F.col("possible"),
    })
    names = F.array(*[F.lit(x) for x, _ in sorted(ADVISORY.items(), key=lambda kv: kv[1])])
    most = F.when(F.col("n_vulnerable") == 0, F.when(F.col("vuln_covered"), "NONE").otherwise("UNKNOWN")).otherwise(F.get(names, F.col("worst")))
    severity = (
        F.when(F.col("malicious"), "high")
        .when(F.col("vulnerable"), F.when(F.col("version").isNull(), "medium").when(F.col("kev") | F.col("max_severity").isin(*SEVERE), "high").otherwise("medium"))
        .when(F.col("possible"), "medium")
        .otherwise("info")
    )
    return local_verdict(flags.withColumn("max_severity", most)).withColumn("severity", severity).select(
        "ecosystem", "name", "version", "verdict", "severity", "n_malicious", "n_vulnerable", "n_undetermined", "max_severity", "kev", "possible", "mal_reasons", "stale"
    )


def with_registry_meta(checks: DataFrame, meta: DataFrame, grade: str = "E1") -> DataFrame:
    """Offline verdicts with what an imported register knows: ecosystem, name, exists, version_exists, version_age_days, licence, install_scripts.

    A name that does not exist, a version that does not, and one that is too young win over clean
    and unknown verdicts, never over malicious or vulnerable ones; what the register doesn't know changes nothing.
    """
    m = meta.select("ecosystem", "name", "exists", "version_exists", "version_age_days", "licence", "install_scripts")
    joined = checks.join(m, ["ecosystem", "name"], "left")
    firm = F.col("verdict").isin("malicious", "vulnerable", "unsupported_env_grade")
    young = F.coalesce(~cooled_down(F.col("version_age_days"), F.lit(grade)), F.lit(False))
    verdict = (
        F.when(firm, F.col("verdict"))
        .when(F.col("exists") == F.lit(False), "not_found")
        .when(young, "cooldown_hold")
        .when((F.col("version_exists") == F.lit(False)) & F.col("version").isNotNull(), "version_not_found")
        .otherwise(F.col("verdict"))
    )
    return joined.withColumn("verdict", verdict).withColumn("licence_verdict", licence_verdict(F.col("licence")))


def audit_manifests(packages: DataFrame, feeds: Feeds, grade: str = "E1") -> DataFrame:
    """One row for each file: packages it names, checked, truncated, and counts by verdict; never silently fewer.

    packages: path, kind (manifest or lock), place (order in the file), ecosystem, name,
    version, version_exact, spec, problem. A manifest's first 20 and a lockfile's first
    2,000 different packages are checked, as the feature has it; truncated says how many
    were not. A file that can't be parsed counts as unparsed, not as one without packages.
    """
    unparsed = packages.where("problem is not null").groupBy("path").agg(F.lit(True).alias("unparsed"))
    own = packages.where("problem is null and name is not null").groupBy("path", "kind", "ecosystem", "name", "version").agg(F.min("place").alias("place"), F.bool_or("version_exact").alias("version_exact"), F.min("spec").alias("spec"))
    order = Window.partitionBy("path").orderBy("place", "name", "version")
    limit = F.when(F.col("kind") == "lock", LOCKFILE_LIMIT).otherwise(MANIFEST_LIMIT)
    placed = own.withColumn("nth", F.row_number().over(order)).withColumn("taken", F.col("nth") <= limit)
    checks = offline_check(placed.where("taken"), feeds, grade).select(F.lower("ecosystem").alias("eco"), F.col("name").alias("c_name"), F.col("version").alias("c_version"), "verdict", "kev", "possible")
    met = placed.join(checks, (F.lower("ecosystem") == F.col("eco")) & (F.col("name") == F.col("c_name")) & F.col("version").eqNullSafe(F.col("c_version")) & F.col("taken"), "left")
    counts = met.groupBy("path").agg(
        F.count("*").alias("n_packages"), F.count_if("taken").alias("n_checked"), F.count_if(~F.col("taken")).alias("truncated"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("malicious", "vulnerable", "checked_clean", "checked_stale", "unknown")], F.count_if(F.coalesce("kev", F.lit(False))).alias("n_kev"),
    )
    return packages.select("path").distinct().join(counts, "path", "left").join(unparsed, "path", "left").fillna(0).fillna(False, ["unparsed"])


def raise_possible(checks: DataFrame) -> DataFrame:
    """Where a malicious advisory may hold, at least medium and a review; the verdict stays."""
    may = F.coalesce("possible", F.lit(False)) & (F.col("verdict") != "malicious")
    return checks.withColumn("severity", F.when(may & F.col("severity").isin("info", "low"), "medium").otherwise(F.col("severity"))).withColumn("requires_review", may | (F.col("verdict") != "checked_clean"))


def malicious_kind(verdict: Column, reasons: Column) -> Column:
    """confirmed where an advisory names the version, old_format where all lack versions, else unverified; null if not malicious."""
    doubts = F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r != "")
    plain = F.size(doubts) < F.size(F.coalesce(reasons, F.array().cast("array<string>")))
    return F.when(verdict == "malicious", F.when(plain | (F.size(doubts) == 0), "confirmed").when(F.forall(doubts, lambda r: r == "advisory_without_versions"), "old_format").otherwise("unverified"))


def advisory_severities(severities: Column, most: Column) -> Column:
    """All severities of a check, in capitals, with the highest it states."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.array_union(F.coalesce(severities, F.array().cast("array<string>")), F.array(most)), F.upper))))


def gate_inputs(checks: DataFrame) -> DataFrame:
    """One row of what the gate asks of package checks.

    checks: verdict, severity, kev, possible, version, version_exact, latest_assumed, licence, signals.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    vulnerable = F.col("verdict") == "vulnerable"
    return checks.agg(
        n(F.col("verdict") == "malicious").alias("n_malicious"), n(F.col("kev")).alias("n_kev"), n(vulnerable).alias("n_vulnerable"), n(vulnerable & F.col("latest_assumed")).alias("n_assumed_vulnerable"),
        n(F.col("version").isNull() | ~F.col("version_exact")).alias("n_unpinned"), n(F.size(F.coalesce("signals", F.array())) > 0).alias("n_signals"), n(licence_verdict(F.col("licence")) == "review_required").alias("n_licence_review"),
        n(F.col("verdict").isin("unknown", "error", "checked_stale")).alias("n_unchecked"), n(F.col("verdict") == "not_found").alias("n_not_found"),
    )


def should_fail(gate: DataFrame, fail_on: str = "blocked") -> DataFrame:
    """Whether a run fails: at blocked alone, or at conditional and undetermined too; undetermined never passes as clean."""
    states = {"blocked": ("blocked",), "undetermined": ("blocked", "undetermined"), "conditional": ("blocked", "undetermined", "conditional")}[fail_on]
    return gate.withColumn("fails", F.col("verdict").isin(*states))


def block_reasons(inputs: DataFrame) -> DataFrame:
    """reason, n of what blocks a release among package checks; none, no row."""
    reasons = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(c).alias("n")) for r, c in (("malicious package", "n_malicious"), ("exploited vulnerability", "n_kev"), ("package not found", "n_not_found"))])
    return inputs.select(F.explode(F.filter(reasons, lambda x: x["n"] > 0)).alias("r")).select("r.*")


def exposure_counts(found: DataFrame) -> DataFrame:
    """Exposed values by category: those that stand, those that judgement lowered, and what may be real."""
    lowered = F.size("adjustments") > 0
    return found.where(F.col("category").isin("privacy", "secret")).groupBy("category").agg(F.count_if(~lowered).alias("live"), F.count_if(lowered).alias("lowered"), F.count_if(F.col("decision") == "block").alias("blocking"))


def audit_stats(checks: DataFrame) -> DataFrame:
    """One row over audits: work done by check, risk by different component.

    checks: audit, ecosystem, name, version, verdict; an audit that could not be parsed is one row with a null name.
    """
    unchecked = F.col("name").isNull() | F.col("verdict").isin("unknown", "error", "checked_stale")
    component = F.struct("ecosystem", "name", "version")
    many = lambda verdict: F.size(F.collect_set(F.when(F.col("verdict") == verdict, component)))
    # sets of components at risk only: a report's length, not the inventory's
    return checks.agg(F.count_if(~unchecked).alias("n_checked"), F.count_if(unchecked).alias("n_unchecked"), many("vulnerable").alias("n_vulnerable"), many("not_found").alias("n_not_found"), F.bool_or(F.col("verdict") == "malicious").alias("any_malicious"))


def advisory_totals(rows: DataFrame) -> DataFrame:
    """package, and how many of its advisories to act on at once (exploited), soon (high or more), later."""
    soon = F.upper(F.coalesce("severity", F.lit(""))).isin(*SEVERE)
    return rows.groupBy("package").agg(F.count_if("kev").alias("now"), F.count_if(~F.col("kev") & soon).alias("soon"), F.count_if(~F.col("kev") & ~soon).alias("later"))


def upgrade_plan(rows: DataFrame) -> DataFrame:
    """package, target, resolves, unfixed, complete: the highest of its advisory groups' targets; a group without target stays open. rows: package, group_id, target."""
    from riskloom.functions.version import version_key

    groups = rows.groupBy("package", "group_id").agg(F.max_by("target", version_key(F.col("target"))).alias("target"))
    return groups.groupBy("package").agg(F.max_by("target", version_key(F.col("target"))).alias("target"), F.count("target").alias("resolves"), F.count_if(F.col("target").isNull()).alias("unfixed")).withColumn("complete", F.col("unfixed") == 0)


def notices_for(advisories: DataFrame, notices: DataFrame) -> DataFrame:
    """id, link, title of notices that name one of an advisory's CVE ids."""
    ids = advisories.select("id", F.explode(cve_ids(F.col("id"), F.col("aliases"))).alias("cve"))
    named = notices.select("link", "title", F.explode("cve_ids").alias("cve"))
    return ids.join(named, "cve").select("id", "link", "title").distinct()


def feed_summary(rows: DataFrame, today: Column, days: int) -> DataFrame:
    """source, n, oldest, newest, age_days and state (fresh, stale, empty) of feeds. rows: source, item, fetched_on."""
    out = rows.groupBy("source").agg(F.count("item").alias("n"), F.min("fetched_on").alias("oldest"), F.max("fetched_on").alias("newest"))
    age = F.datediff(today, F.col("newest"))
    return out.withColumn("age_days", age).withColumn("state", F.when(F.col("n") == 0, "empty").when(age > days, "stale").otherwise("fresh"))


def proposed_from_kev(kev: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Rules to propose for vulnerabilities that came to be exploited of late: id, title, severity, status, review_due."""
    recent = kev.where(F.datediff(today, F.col("dateAdded")).between(0, days))
    ransom = F.lower(F.coalesce("knownRansomwareCampaignUse", F.lit(""))) == "known"
    return recent.select(F.concat(F.lit("RL-KEV-"), "cveID").alias("id"), "vulnerabilityName", F.when(ransom, "critical").otherwise("high").alias("severity"), F.lit("proposed").alias("status"), F.date_add("dateAdded", 365).alias("review_due"))


def direct_packages(installed: DataFrame, named: DataFrame) -> DataFrame:
    """Installed packages that a manifest names itself, by normalised name; the others came along."""
    from riskloom.functions.package import index_name

    d = named.select(F.lower("ecosystem").alias("d_eco"), index_name(F.col("name")).alias("d_name")).distinct().withColumn("direct", F.lit(True))
    i = installed.withColumn("i_eco", F.lower("ecosystem")).withColumn("i_name", index_name(F.col("name")))
    return i.join(d, (F.col("i_eco") == F.col("d_eco")) & (F.col("i_name") == F.col("d_name")), "left").select(*installed.columns, F.coalesce("direct", F.lit(False)).alias("direct"))


def dependency_refs(edges: DataFrame, components: DataFrame) -> DataFrame:
    """ref, depends_on (sorted) over edges of names (parent null: the project): what no component is named like is left out."""
    c = components.select(F.lower("name").alias("c_name"), "ref")
    child = edges.join(c.select(F.col("c_name").alias("child_name"), F.col("ref").alias("child_ref")), F.lower("child") == F.col("child_name"))
    parent = child.join(c, F.lower("parent") == F.col("c_name"), "left").where(F.col("parent").isNull() | F.col("ref").isNotNull())
    return parent.groupBy(F.coalesce("ref", F.lit("project")).alias("ref")).agg(F.sort_array(F.collect_set("child_ref")).alias("depends_on"))


def worst_severity(rows: DataFrame, by: str) -> DataFrame:
    return max_severity(rows, by)
