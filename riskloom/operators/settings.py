"""Judges of settings files: editor and browser extensions, workflow triggers, runtime pins, instructions to agents, feed bundles, the fixed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "struct<rule_id:string,detail:string,confidence:string>"
# fixed values: what a browser extension may ask for that is private, and headers that guard a page
PRIVATE_PERMISSIONS = ("cookies", "webRequest", "webRequestBlocking", "scripting", "tabs", "history", "clipboardRead", "nativeMessaging", "debugger", "declarativeNetRequest", "management", "proxy")
GUARD_HEADERS = ("content-security-policy", "x-frame-options", "strict-transport-security")
STORE_HOSTS = ("clients2.google.com/service/update2/crx", "edge.microsoft.com/extensionwebstorebase", "addons.mozilla.org")
EVERYWHERE = r"^(<all_urls>|\*://\*/.*|https?://\*/.*)$"
#: Words that tell an agent to act behind its user's back.
DIRECTIVES = (r"(?i)ignore (?:all )?(?:previous|earlier) instructions", r"(?i)do not (?:tell|inform|show) the user", r"(?i)without (?:asking|confirmation|approval)", r"(?i)\b(?:curl|wget)\b[^\n|]*\|\s*(?:ba)?sh", r"(?i)send (?:the )?(?:contents?|keys?|tokens?|secrets?) to")


def _rule(when: Column, rule: str, detail: str, confidence: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(detail).alias("detail"), F.lit(confidence).alias("confidence")))


def _rows(files: DataFrame, *rules: Column) -> DataFrame:
    return files.select("path", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("path", "f.*")


def editor_manifests(files: DataFrame) -> DataFrame:
    """Editor extensions (package.json with engines.vscode): early activation, untrusted folders, bundled extensions."""
    shape = "struct<engines:struct<vscode:string>,activationEvents:array<string>,capabilities:struct<untrustedWorkspaces:struct<supported:string>>,extensionPack:array<string>,extensionDependencies:array<string>>"
    own = files.where(F.lower("path").rlike(r"(^|/)package\.json$")).withColumn("j", F.from_json("text", shape)).where("j.engines.vscode is not null")
    none = F.array().cast("array<string>")
    trust = F.col("j.capabilities.untrustedWorkspaces")
    return _rows(
        own,
        _rule(F.exists(F.coalesce("j.activationEvents", none), lambda e: e.isin("*", "onStartupFinished")), "RL-EDITOR-TRUST", "active in every folder", "likely"),
        _rule(trust.isNull(), "RL-EDITOR-TRUST", "says nothing about untrusted folders", "pattern-only"),
        _rule(trust["supported"] == "true", "RL-EDITOR-TRUST", "works in untrusted folders", "likely"),
        _rule(F.size(F.concat(F.coalesce("j.extensionPack", none), F.coalesce("j.extensionDependencies", none))) > 0, "RL-EDITOR-TRUST", "brings other extensions", "pattern-only"),
    )


def browser_manifests(files: DataFrame) -> DataFrame:
    """Browser extensions (manifest.json): old form, wide hosts with private permissions, open messaging, weak policy, updates from elsewhere."""
    shape = "struct<manifest_version:int,permissions:array<string>,host_permissions:array<string>,content_scripts:array<struct<matches:array<string>>>,externally_connectable:struct<matches:array<string>,ids:array<string>>,content_security_policy:string,update_url:string,background:string,action:string,browser_action:string>"
    own = files.where(F.lower("path").rlike(r"(^|/)manifest\.json$")).withColumn("j", F.from_json("text", shape))
    own = own.where("j.manifest_version is not null and (j.permissions is not null or j.background is not null or j.content_scripts is not null or j.action is not null or j.browser_action is not null)")
    none = F.array().cast("array<string>")
    hosts = F.concat(F.coalesce("j.host_permissions", none), F.flatten(F.transform(F.coalesce("j.content_scripts", F.array().cast("array<struct<matches:array<string>>>")), lambda c: F.coalesce(c["matches"], none))), F.when(F.col("j.manifest_version") == 2, F.coalesce("j.permissions", none)).otherwise(none))
    private = F.size(F.array_intersect(F.coalesce("j.permissions", none), F.array(*[F.lit(x) for x in PRIVATE_PERMISSIONS])))
    open_to = F.exists(F.coalesce("j.externally_connectable.matches", none), lambda m: m.rlike(EVERYWHERE)) | F.array_contains(F.coalesce("j.externally_connectable.ids", none), "*")
    update = F.col("j.update_url")
    stores = F.lit(False)
    for host in STORE_HOSTS:
        stores = stores | F.contains(update, F.lit(host))
    return _rows(
        own,
        _rule(F.col("j.manifest_version") == 2, "RL-BROWSER-PERMISSION", "old form of manifest", "likely"),
        _rule(F.exists(hosts, lambda h: h.rlike(EVERYWHERE)) & (private >= 2), "RL-BROWSER-PERMISSION", "every site and private permissions", "likely"),
        _rule(open_to, "RL-BROWSER-PERMISSION", "any page may send messages", "confirmed"),
        _rule(F.col("j.content_security_policy").rlike(r"unsafe-eval|script-src[^;]*https?://"), "RL-BROWSER-HEADER", "policy lets foreign code in", "confirmed"),
        _rule((update != "") & ~stores, "RL-BROWSER-PERMISSION", "updates from elsewhere", "likely"),
    )


def header_rules(files: DataFrame) -> DataFrame:
    """Rule files of extensions that take guarding headers off responses."""
    rule = "array<struct<action:struct<responseHeaders:array<struct<header:string,operation:string>>>>>"
    own = files.where(F.lower("path").rlike(r"rules?[^/]*\.json$")).select("path", F.coalesce(F.from_json("text", rule), F.from_json("text", f"struct<rules:{rule}>")["rules"]).alias("r"))
    headers = F.flatten(F.transform("r", lambda r: F.coalesce(r["action"]["responseHeaders"], F.array().cast("array<struct<header:string,operation:string>>"))))
    taken = F.exists(headers, lambda h: F.lower(h["header"]).isin(*GUARD_HEADERS) & F.lower(h["operation"]).isin("remove", "set"))
    return _rows(own, _rule(taken, "RL-BROWSER-HEADER", "takes guarding headers off", "confirmed"))


def ecosystems(files: DataFrame) -> DataFrame:
    """path, ecosystem: manifests that make a project a desktop app, an extension or a tool server."""
    shape = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>,engines:struct<vscode:string>,manifest_version:int>"
    own = files.withColumn("j", F.when(F.lower("path").rlike(r"(^|/)(package|manifest)\.json$"), F.from_json("text", shape)))
    empty = F.create_map().cast("map<string,string>")
    names = F.flatten(F.array(*[F.map_keys(F.coalesce(f"j.{k}", empty)) for k in ("dependencies", "devDependencies", "peerDependencies")]))
    python = F.lower("path").rlike(r"(^|/)(requirements[^/]*\.txt|pyproject\.toml)$") & F.col("text").rlike(r"(?im)^\s*[\"']?(fastmcp|mcp)\b")
    kinds = F.array_compact(F.array(
        F.when(F.array_contains(names, "electron"), "desktop"), F.when(F.col("j.engines.vscode").isNotNull(), "editor-extension"), F.when(F.array_contains(names, "@modelcontextprotocol/sdk") | F.array_contains(names, "fastmcp") | python, "tool-server"),
        F.when(F.lower("path").rlike(r"(^|/)manifest\.json$") & F.col("j.manifest_version").isNotNull(), "browser-extension"),
    ))
    return own.select("path", F.explode(kinds).alias("ecosystem"))


def workflow_triggers(files: DataFrame) -> DataFrame:
    """path, trigger of workflows: on one line, in a list, or as a block."""
    own = files.where(F.lower("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    line = F.regexp_extract("text", r"(?m)^[\"']?on[\"']?:[ \t]*\[?([^\]\n#]*)", 1)
    block = F.regexp_extract("text", r"(?m)^[\"']?on[\"']?:[ \t]*\n((?:[ \t]+[^\n]*\n|[ \t]*\n)+)", 1)
    inline = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
    first = F.length(F.regexp_extract(block, r"^([ \t]+)", 1))
    items = F.filter(F.transform(F.split(block, "\n"), lambda x: F.when(F.length(F.regexp_extract(x, r"^([ \t]*)", 1)) == first, F.regexp_extract(x, r"^[ \t]+(?:- *)?([a-z_]+)", 1))), lambda x: x.isNotNull() & (x != ""))
    return own.select("path", F.explode(F.array_distinct(F.concat(inline, items))).alias("trigger"))


def runtime_pins(files: DataFrame) -> DataFrame:
    """path, runtime, spec from version files, package.json engines and pyproject's requires-python."""
    name, text = F.regexp_extract(F.lower("path"), r"([^/]+)$", 1), F.trim("text")
    first = F.trim(F.regexp_extract(text, r"^([^\n#]*)", 1))
    of_file = F.when(name.isin(".nvmrc", ".node-version"), "node").when(name == ".python-version", "python").when(name == ".ruby-version", "ruby")
    own = files.where(of_file.isNotNull()).select("path", of_file.alias("runtime"), F.regexp_replace(first, "^v", "").alias("spec"))
    node = files.where(name == "package.json").select("path", F.lit("node").alias("runtime"), F.get_json_object("text", "$.engines.node").alias("spec"))
    python = files.where(name == "pyproject.toml").select("path", F.lit("python").alias("runtime"), F.regexp_extract("text", r"(?m)^\s*requires-python\s*=\s*[\"']([^\"']+)", 1).alias("spec"))
    return own.unionByName(node).unionByName(python).where("spec is not null and spec <> ''")


def instruction_directives(files: DataFrame) -> DataFrame:
    """path, line_no, detail of lines in instruction files that tell an agent to act behind its user's back."""
    from riskloom.functions.text import lines_of

    own = files.where(F.lower("path").rlike(r"(^|/)(agents|claude|gemini|copilot-instructions|\.cursorrules|skill)(\.md)?$|(^|/)\.cursor/rules/"))
    line = F.col("line")
    hit = F.coalesce(*[F.when(line.rlike(p), F.lit(p)) for p in DIRECTIVES])
    return own.select("path", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), hit.alias("detail")).where("detail is not null")


def pep440_key(version: Column) -> Column:
    """struct(epoch, numbers, stage, stage number) that orders Python versions, a development release before its stage; null if unreadable."""
    v = F.regexp_replace(F.lower(F.trim(version)), "^v", "")
    form = r"^(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?([0-9]*))?(?:[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?dev[-_.]?([0-9]*))?(?:\+.*)?$"
    part = lambda i: F.regexp_extract(v, form, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0))
    numbers = F.transform(F.split(part(2), r"\."), lambda x: x.cast("int"))
    last = F.aggregate(F.transform(numbers, lambda n, i: F.when(n != 0, i + 1).otherwise(0)), F.lit(1), lambda a, x: F.greatest(a, x))
    stage = F.when(part(3).isin("a", "alpha"), 1).when(part(3).isin("b", "beta"), 2).when(part(3) != "", 3).when(part(5) != "", 5).when(v.rlike(r"dev[-_.]?[0-9]*$"), 0).otherwise(4)
    dev = F.when(v.rlike(r"dev[-_.]?[0-9]*(\+.*)?$"), number(7)).otherwise(2**31 - 1)
    return F.when(v.rlike(form), F.struct(number(1).alias("epoch"), F.slice(numbers, F.lit(1), last).alias("numbers"), stage.alias("stage"), F.when(part(5) != "", number(6)).otherwise(number(4)).alias("stage_number"), dev.alias("dev")))


def package_events(checks: DataFrame, tool: str, caller: Column) -> DataFrame:
    """Package checks as audit events: names and verdicts, no file's text."""
    from riskloom.operators.inventory import caller_name

    checked = F.when(F.col("verdict").isin("unknown", "error"), F.lit(None).cast("boolean")).otherwise(~F.col("verdict").isin("checked_stale"))
    return checks.select(F.lit("package_check").alias("event_type"), F.lit(tool).alias("tool"), caller_name(caller).alias("caller"), F.concat_ws("/", "ecosystem", "name").alias("package"), "version", "verdict", checked.alias("checked"))


def export_bundle(feeds: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes feeds as tables under a folder with a list of them: source, n, digest. The digest is a sum over rows, so their order does not matter."""
    spark = next(iter(feeds.values())).sparkSession
    for name, rows in feeds.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    listed = [(name, *bundle_digest(spark.read.parquet(f"{folder}/{name}"))) for name in feeds]
    out = spark.createDataFrame(listed, "source string, n long, digest string")
    out.coalesce(1).write.mode("overwrite").json(f"{folder}/_list")
    return out


def bundle_digest(rows: DataFrame) -> tuple[int, str]:
    own = rows.select(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")).first()
    return own[0], own[1]


def import_bundle(spark: SparkSession, folder: str, before: dict[str, int] | None = None, keep_share: float = 0.8) -> tuple[dict[str, DataFrame], list[str]]:
    """(feeds, problems) of an exported folder: what does not match its list, or shrank below the share kept, is refused."""
    feeds, problems = {}, []
    for row in spark.read.json(f"{folder}/_list").collect():
        rows = spark.read.parquet(f"{folder}/{row.source}")
        if bundle_digest(rows) != (row.n, row.digest):
            problems.append(f"{row.source}: differs from the list")
        elif before and row.n < keep_share * before.get(row.source, 0):
            problems.append(f"{row.source}: shrank to {row.n}")
        else:
            feeds[row.source] = rows
    return feeds, problems


FORM = (("secrets", "no secret in the source"), ("privacy", "no personal data in the source"), ("malicious", "no malicious package"), ("vulnerable", "no known vulnerable package"), ("licence", "licences reviewed"), ("unpinned", "versions pinned"), ("coverage", "all files examined"), ("blocking", "no blocking finding"))


def fixed_form(counts: DataFrame) -> DataFrame:
    """The eight rows of the fixed form from one row of counts: item, statement, n, state. A null count is undetermined, never fine."""
    hard = ("secrets", "malicious", "blocking")
    rows = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(item).alias("item"), F.lit(text).alias("statement"), F.col(item).cast("long").alias("n"), F.when(F.col(item).isNull(), "undetermined").when(F.col(item) == 0, "ok").otherwise("fails" if item in hard else "review").alias("state")) for i, (item, text) in enumerate(FORM)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
