"""What a project holds: hosts its pages load from, bundled components, installed packages, files by kind, findings by catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import lines_of
from riskloom.functions.version import version_key
from riskloom.operators.signals import any_of
from riskloom.sources.texts import suffix

# fixed values: words that mark a bundle's name as built, and file names of locks whose hashes a report states
BUILD_WORDS = ("min", "prod", "production", "bundle", "umd", "esm", "cjs", "slim", "core", "runtime", "global", "browser", "dist")
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Pipfile.lock")
#: Words that show code of a page, and code of a server.
PAGE_WORDS, SERVER_WORDS = ("document.", "window.", "addEventListener", "localStorage", "innerHTML"), ("require('fs')", 'require("fs")', "process.env", "module.exports", "http.createServer", "express(")
GUIDELINES = {"CWE": r"^CWE-[0-9]+", "OWASP": r"(?i)owasp", "CVE": r"^CVE-", "advisory": r"^(GHSA|OSV|MAL)-", "link": r"^https?://"}


def static_resources(pages: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, host, kind, n: hosts that scripts, styles, frames and pictures of pages are loaded from."""
    forms = {
        "script": r"(?i)<script[^>]+src\s*=\s*[\"']?(?:https?:)?//([a-z0-9.-]+)", "style": r"(?i)<link[^>]+href\s*=\s*[\"']?(?:https?:)?//([a-z0-9.-]+)", "picture": r"(?i)<img[^>]+src\s*=\s*[\"']?(?:https?:)?//([a-z0-9.-]+)",
        "frame": r"(?i)<iframe[^>]+src\s*=\s*[\"']?(?:https?:)?//([a-z0-9.-]+)", "import": r"(?i)@import\s+(?:url\()?[\"']?(?:https?:)?//([a-z0-9.-]+)",
    }
    kind = lambda k: lambda h: F.struct(F.lower(h).alias("host"), F.lit(k).alias("kind"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), kind(k)) for k, p in forms.items()]))
    return pages.select(key, F.explode(found).alias("f")).groupBy(key, "f.host", "f.kind").agg(F.count("*").alias("n"))


def linked_hosts(pages: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, host, n: hosts that links lead to."""
    hosts = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)<a\s[^>]*href\s*=\s*[\"']?https?://([a-z0-9.-]+)"), F.lit(1)), F.lower)
    return pages.select(key, F.explode(hosts).alias("host")).groupBy(key, "host").agg(F.count("*").alias("n"))


def extension_distribution(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(F.nullif(suffix(F.col("path")), F.lit("")), F.lit("none")).alias("extension")).agg(F.count("*").alias("n"))


def guideline_distribution(found: DataFrame) -> DataFrame:
    """kind, n of the references findings carry. found: references array<string>."""
    kind = F.lit("other")
    for name, pattern in reversed(GUIDELINES.items()):
        kind = F.when(F.col("r").rlike(pattern), name).otherwise(kind)
    return found.select(F.explode("references").alias("r")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def privacy_findings(found: DataFrame) -> DataFrame:
    return found.where(F.col("category") == "privacy")


def known_packages(packages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Packages with what a catalogue (ecosystem, name, purpose, host) says they connect to; unknown ones stay with nulls."""
    c = catalogue.select(F.lower("ecosystem").alias("c_eco"), F.lower("name").alias("c_name"), "purpose", "host")
    return packages.join(c, (F.lower("ecosystem") == F.col("c_eco")) & (F.lower("name") == F.col("c_name")), "left").drop("c_eco", "c_name")


def rule_items(rules: DataFrame, items: DataFrame) -> DataFrame:
    """rule_id, item: by the rule's own list of items, or by a weakness both name. rules: rule_id, cwe, items; items: item, cwe."""
    own = rules.select("rule_id", F.explode("items").alias("item")).join(items.select("item"), "item", "left_semi").select("rule_id", "item")
    shared = rules.select("rule_id", F.explode("cwe").alias("c")).join(items.select("item", F.explode("cwe").alias("c")), "c").select("rule_id", "item")
    return own.unionByName(shared).distinct()


def item_table(found: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """item, n, n_block, state of every item of a catalogue, and one row 'outside' for findings of no item."""
    mapped = rule_items(rules, items)
    counts = found.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "block").alias("n_block"))
    by_item = mapped.join(counts, "rule_id").groupBy("item").agg(F.sum("n").alias("n"), F.sum("n_block").alias("n_block"))
    inside = items.select("item").join(by_item, "item", "left").fillna(0, ["n", "n_block"])
    outside = counts.join(mapped.select("rule_id").distinct(), "rule_id", "left_anti").agg(F.lit("outside").alias("item"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_block"), F.lit(0)).alias("n_block"))
    return inside.unionByName(outside).withColumn("state", F.when(F.col("n_block") > 0, "fails").when(F.col("n") > 0, "review").otherwise("passes"))


def component_name(file: Column) -> Column:
    """A bundle's name without folder, kind, version and words of the build."""
    base = F.regexp_replace(F.lower(F.regexp_replace(file, r"^.*[/\\]", "")), r"(\.(js|mjs|cjs|css|map))+$", "")
    plain = F.regexp_replace(base, r"[-_.@]v?[0-9]+(\.[0-9]+)*([-.](rc|alpha|beta)[0-9.]*)?", "")
    return F.regexp_replace(plain, r"([-_.](" + "|".join(BUILD_WORDS) + r"))+$", "")


def component_version(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, r"[-_.@]v?([0-9]+\.[0-9]+(?:\.[0-9]+)?(?:-(?:rc|alpha|beta)[0-9.]*)?)", 1), F.lit(""))


def bundled_components(files: DataFrame) -> DataFrame:
    """path, name, version, by: what a bundled script is, by its file name, by the comment at its head, by the version it states itself.

    Two different versions in one kind of place tell nothing: the version is null then.
    """
    head = F.substring("text", 1, 2000)
    banners = F.regexp_extract_all(head, F.lit(r"(?i)/\*!?[\s*]*(?:@license\s+)?([a-z][a-z0-9 ._-]{1,40}?)(?:\.js)?[ ,-]+v?[0-9]+\.[0-9]+"), F.lit(1))
    versions = F.array_distinct(F.regexp_extract_all(head, F.lit(r"(?i)/\*!?[\s*]*(?:@license\s+)?[a-z][a-z0-9 ._-]{1,40}?(?:\.js)?[ ,-]+v?([0-9]+\.[0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    stated = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)\bversion\s*[:=]\s*[\"']([0-9]+\.[0-9]+\.[0-9]+)[\"']"), F.lit(1)))
    one = lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))
    by_name, by_head, by_text = component_version(F.col("path")), one(versions), one(stated)
    name = F.when(F.size(banners) > 0, F.lower(F.trim(F.get(banners, F.lit(0))))).otherwise(component_name(F.col("path")))
    return files.where(suffix(F.col("path")).isin(".js", ".mjs", ".cjs")).select("path", name.alias("name"), F.coalesce(by_name, by_head, by_text).alias("version"), F.when(by_name.isNotNull(), "file").when(by_head.isNotNull(), "head").when(by_text.isNotNull(), "text").alias("by"))


def installed_packages(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version of package records that lie in a project: dist-info and egg-info heads, package.json under node_modules."""
    field = lambda f: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{f}:\s*(.+)$", 1)), F.lit(""))
    python = files.where(F.col("path").rlike(r"(\.dist-info/METADATA|\.egg-info/PKG-INFO)$")).select("path", F.lit("pypi").alias("ecosystem"), field("Name").alias("name"), field("Version").alias("version"))
    node = files.where(F.col("path").rlike(r"(^|/)node_modules/(@[^/]+/)?[^/]+/package\.json$")).withColumn("j", F.from_json("text", "struct<name:string,version:string>"))
    return python.unionByName(node.select("path", F.lit("npm").alias("ecosystem"), "j.name", "j.version")).where("name is not null")


def frontend_script(path: Column, text: Column) -> Column:
    """Markup, or a script with words of a page and none of a server."""
    return F.lower(path).rlike(r"\.html?$") | (text.rlike(any_of(*PAGE_WORDS)) & ~text.rlike(any_of(*SERVER_WORDS)))


def lockfile_digests(files: DataFrame) -> DataFrame:
    """path, sha256 of known lockfiles. files: path, content."""
    return files.where(F.regexp_extract("path", r"([^/]+)$", 1).isin(*LOCKFILES)).select("path", F.sha2("content", 256).alias("sha256"))


def posture_notes(files: DataFrame, roots: DataFrame) -> DataFrame:
    """root, headers, cookies: project roots with an entry file, and whether any of their files shows security headers and safe cookies.

    A file belongs to the longest root its path begins with. roots: root (ending with /).
    """
    own = files.select("path", lines_of(F.col("text")).isNotNull().alias("has"), F.col("text").rlike(r"(?i)helmet\(|Content-Security-Policy|Strict-Transport-Security|X-Frame-Options").alias("h"), F.col("text").rlike(r"(?i)httponly|samesite|SESSION_COOKIE_SECURE").alias("c"), F.col("path").rlike(r"(^|/)(app|main|server|index|manage|wsgi)\.(py|js|ts)$").alias("entry"))
    folders = own.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.when(k == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), 1, k - 1), "/"), F.lit("/"))))))
    nearest = folders.join(roots.select("root").distinct(), "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"), F.first("h").alias("h"), F.first("c").alias("c"), F.first("entry").alias("entry"))
    return nearest.groupBy("root").agg(F.bool_or("entry").alias("entry"), F.bool_or("h").alias("headers"), F.bool_or("c").alias("cookies")).where("entry").drop("entry")


def newer(current: Column, published: Column) -> Column:
    """Whether the published version is ahead; null where either can't be read."""
    return version_key(published) > version_key(current)


def caller_name(raw: Column) -> Column:
    """A caller's name fit for a log: letters, figures and ._:@/- up to 64; anything else is unknown:invalid, nothing is unknown."""
    return F.when(raw.isNull() | (F.trim(raw) == ""), "unknown").when(F.trim(raw).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:@/-]{0,63}$"), F.trim(raw)).otherwise("unknown:invalid")


def report_path(target: Column, day: Column, folder: str = ".check-reports") -> Column:
    """Where a target's report of a day goes."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(target), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.lit(f"{folder}/"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("report")), F.lit("-"), F.date_format(day, "yyyyMMdd"), F.lit(".md"))
