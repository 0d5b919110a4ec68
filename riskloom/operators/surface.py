"""Project surfaces: workflows, package scripts, agent and editor settings, hidden text, hosts, runtime pins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.manifests import load_json

FINDING = "path string, line_no int, rule_id string, severity string, decision string, confidence string, detail string"
# fixed values: install hooks, and command shapes by what they risk
INSTALL_HOOKS = ("preinstall", "install", "postinstall", "prepare")
NETWORK = r"(?i)\b(curl|wget|Invoke-WebRequest|iwr|nc)\b"
INTERPRETER = r"(?i)\b(python3?|node|bash|sh|powershell|pwsh|deno|bun)\b\s+(-[ce]\b|-Command)"


def surface_kind(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"), "workflow")
        .when(low.rlike(r"(^|/)package\.json$"), "package-json")
        .when(low.rlike(r"(^|/)\.vscode/tasks\.json$"), "editor-tasks")
        .when(low.rlike(r"(^|/)\.vscode/settings\.json$"), "editor-settings")
        .when(low.rlike(r"(^|/)(\.mcp|mcp)\.json$"), "tool-servers")
        .when(low.rlike(r"(^|/)\.[a-z]+/settings(\.local)?\.json$"), "agent-settings")
        .when(low.rlike(r"\.pth$"), "path-file")
        .when(low.rlike(r"(^|/)(sitecustomize|usercustomize)\.py$"), "startup-module")
        .when(low.rlike(r"(^|/)\.npmrc$"), "registry-settings")
        .when(low.rlike(r"(^|/)dockerfile[^/]*$"), "container-file")
    )


def workflow_findings(lines: DataFrame) -> DataFrame:
    """Steps of workflows, by line: unpinned actions, untrusted input in scripts, remote scripts, wide permissions."""
    line, checks = F.col("line"), []
    for rule, test, severity in (
        ("RL-CI-UNPINNED", line.rlike(r"^\s*-?\s*uses:\s*[^@\s./][^@\s]*@(?![0-9a-f]{40}\b)"), "low"),
        ("RL-CI-INJECTION", line.rlike(r"\$\{\{\s*github\.event\.(issue|pull_request|comment|review|head_commit)\.[\w.]*(title|body|ref|message|label)"), "high"),
        ("RL-CI-REMOTE-EXEC", line.rlike(r"(curl|wget)[^|\n]*\|\s*(sudo\s+)?(ba|z)?sh\b"), "high"),
        ("RL-CI-PERMISSIONS", line.rlike(r"^\s*permissions:\s*write-all\b"), "medium"),
        ("RL-CI-SECRETS-DUMP", line.rlike(r"toJSON\(\s*secrets\s*\)"), "critical"),
    ):
        checks.append(F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))))
    return lines.where(surface_kind(F.col("path")) == "workflow").select("path", "line_no", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("path", "line_no", "f.*")


def pwn_requests(files: DataFrame) -> DataFrame:
    """Workflows on pull_request_target that check out the head of the request before they run anything."""
    text = F.col("text")
    head = F.regexp_instr(text, F.lit(r"(?s)actions/checkout@.{0,400}?ref:\s*\$\{\{\s*github\.(event\.pull_request\.head|head_ref)"))
    run = F.regexp_instr(F.substring(text, head, F.length(text)), F.lit(r"\n\s*-?\s*run:"))
    return files.where((surface_kind(F.col("path")) == "workflow") & text.rlike(r"(?m)^(on:.*|\s*-?\s*[\"']?)pull_request_target") & (head > 0) & (run > 0)).select("path", F.lit("RL-CI-PWN-REQUEST").alias("rule_id"), F.lit("critical").alias("severity"))


def install_hooks(files: DataFrame) -> DataFrame:
    """Scripts that run on installation, and dependencies that come from elsewhere than the registry."""
    own = files.where(surface_kind(F.col("path")) == "package-json").withColumn("j", F.from_json("text", "struct<scripts:map<string,string>,dependencies:map<string,string>>"))
    hooks = own.select("path", F.explode("j.scripts").alias("name", "command")).where(F.col("name").isin(*INSTALL_HOOKS)).select("path", F.lit("RL-NPM-HOOK").alias("rule_id"), F.when(F.col("command").rlike(NETWORK) | F.col("command").rlike(INTERPRETER), "high").otherwise("medium").alias("severity"), F.concat_ws(": ", "name", "command").alias("detail"))
    foreign = own.select("path", F.explode("j.dependencies").alias("name", "spec")).where(F.col("spec").rlike(r"^(git\+|git:|https?:|github:|file:)|^[\w.-]+/[\w.-]+$")).select("path", F.lit("RL-NPM-FOREIGN").alias("rule_id"), F.lit("medium").alias("severity"), F.concat_ws(": ", "name", "spec").alias("detail"))
    return hooks.unionByName(foreign)


def lock_surface(packages: DataFrame, allowed_hosts: tuple[str, ...] = ("registry.npmjs.org",), allowed_hooks: tuple[str, ...] = ("esbuild", "fsevents")) -> DataFrame:
    """One finding for install scripts outside the allow list and one for foreign or unverified sources, a lockfile."""
    host = F.lower(F.regexp_extract("resolved", r"^[a-z+]+://([^/:]+)", 1))
    hook = F.col("install_script") & ~F.col("name").isin(*allowed_hooks)
    foreign = F.col("resolved").isNotNull() & ~host.isin(*allowed_hosts)
    counted = packages.groupBy("path").agg(F.count_if(hook).alias("hooks"), F.count_if(foreign).alias("foreign"), F.count_if(~F.col("has_integrity")).alias("unverified"))
    rows = F.array_compact(F.array(F.when(F.col("hooks") > 0, F.struct(F.lit("RL-LOCK-HOOK").alias("rule_id"), F.col("hooks").alias("n"))), F.when((F.col("foreign") > 0) | (F.col("unverified") > 0), F.struct(F.lit("RL-LOCK-SOURCE").alias("rule_id"), (F.col("foreign") + F.col("unverified")).alias("n")))))
    return counted.select("path", F.explode(rows).alias("f")).select("path", "f.*")


def _setting_rows(kind: str, path: str, text: str) -> Iterator[tuple]:
    import re

    data = load_json(text)
    if data is None:
        yield path, 1, "RL-SURFACE-UNREADABLE", "low", "warn", "confirmed", kind
        return
    sure = lambda command: "confirmed" if re.search(NETWORK, command) or re.search(INTERPRETER, command) else "likely"
    if kind == "editor-tasks":
        for task in data.get("tasks") or []:
            if (task.get("runOptions") or {}).get("runOn") == "folderOpen":
                yield path, 1, "RL-AUTO-TASK", "high", "block", sure(str(task.get("command", ""))), str(task.get("label", ""))
    elif kind == "editor-settings":
        approve = data.get("chat.tools.terminal.autoApprove")
        if data.get("chat.tools.autoApprove") is True or (isinstance(approve, dict) and any(approve.values())):
            yield path, 1, "RL-AUTO-APPROVE", "high", "block", "confirmed", "tools run without asking"
        if data.get("task.allowAutomaticTasks") == "on" or data.get("security.workspace.trust.enabled") is False:
            yield path, 1, "RL-AUTO-TRUST", "medium", "warn", "confirmed", "folder is trusted without asking"
    elif kind == "agent-settings":
        for event, groups in (data.get("hooks") or {}).items():
            for group in groups or []:
                for hook in group.get("hooks") or []:
                    yield path, 1, "RL-AGENT-HOOK", "high", "block", sure(str(hook.get("command", ""))), str(event)
        permissions = data.get("permissions") or {}
        if permissions.get("defaultMode") == "bypassPermissions" or "Bash" in (permissions.get("allow") or []) or "Bash(*)" in (permissions.get("allow") or []):
            yield path, 1, "RL-AGENT-BYPASS", "critical", "block", "confirmed", "commands run without asking"
        if data.get("enableAllProjectMcpServers") is True:
            yield path, 1, "RL-AGENT-SERVERS", "high", "block", "confirmed", "all servers are enabled"
    elif kind == "tool-servers":
        for name, server in (data.get("mcpServers") or data.get("servers") or {}).items():
            command = " ".join([str(server.get("command", "")), *map(str, server.get("args") or [])])
            if re.match(r"(?i)(ba|z)?sh\b|cmd\b|powershell", command):
                yield path, 1, "RL-SERVER-SHELL", "high", "block", "likely", name
            if re.match(r"(npx|uvx|bunx)\b", command) and not re.search(r"@\d|==\d", command):
                yield path, 1, "RL-SERVER-UNPINNED", "medium", "warn", "likely", name
            if server.get("autoApprove") or server.get("alwaysAllow") or server.get("trust") is True:
                yield path, 1, "RL-SERVER-APPROVE", "high", "block", "confirmed", name
            if re.match(r"http://(?!localhost|127\.|\[::1\])", str(server.get("url", ""))):
                yield path, 1, "RL-SERVER-PLAIN", "medium", "warn", "confirmed", name


def settings_findings(files: DataFrame) -> DataFrame:
    """Editor, agent and tool-server settings that run things without asking."""
    kinds = ("editor-tasks", "editor-settings", "agent-settings", "tool-servers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for k, p, t in zip(batch.kind, batch.path, batch.text, strict=True) for r in _setting_rows(k, p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDING.split(", ")])

    return files.withColumn("kind", surface_kind(F.col("path"))).where(F.col("kind").isin(*kinds)).select("kind", "path", "text").mapInPandas(run, FINDING)


def startup_findings(lines: DataFrame) -> DataFrame:
    """The first import line of a .pth file, and startup modules by their existence."""
    kind = surface_kind(F.col("path"))
    pth = lines.where((kind == "path-file") & F.col("line").rlike(r"^import[ \t]")).groupBy("path").agg(F.min("line_no").alias("line_no")).withColumn("rule_id", F.lit("RL-START-PTH"))
    return pth.unionByName(lines.where(kind == "startup-module").groupBy("path").agg(F.min("line_no").alias("line_no")).withColumn("rule_id", F.lit("RL-START-MODULE")))


def hidden_text(files: DataFrame) -> DataFrame:
    """Files with direction controls, and with invisible characters where no script or emoji calls for them."""
    text = F.col("text")
    bidi = text.rlike("[\\u202A-\\u202E\\u2066-\\u2069]")
    invisible = text.rlike("[\\u200B\\u2060\\uFEFF\\u00AD](?=.)|[\\x{E0000}-\\x{E007F}]{2,}|[A-Za-z0-9][\\u200C\\u200D][A-Za-z0-9]")
    rows = F.array_compact(F.array(F.when(bidi, F.lit("RL-HIDDEN-BIDI")), F.when(invisible, F.lit("RL-HIDDEN-INVISIBLE"))))
    return files.where(text.rlike("[^\\x00-\\xAC]")).select("path", F.explode(rows).alias("rule_id"))


def external_hosts(lines: DataFrame) -> DataFrame:
    """Hosts named in URLs by file: first line, times, and whether personal data stands on that line or the two after."""
    from pyspark.sql import Window

    near = F.concat_ws("\n", "line", *[F.lead("line", i).over(Window.partitionBy("path").orderBy("line_no")) for i in (1, 2)])
    found = lines.withColumn("near", near).where(F.col("line").contains("://")).select("path", "line_no", "near", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(r"https?://([A-Za-z0-9.-]+)"), F.lit(1)), F.lower))).alias("host"))
    private = F.col("near").rlike(r"(?i)(e-?mail|phone|resident|card[_ ]?number|passport)")
    return found.groupBy("path", "host").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.bool_or(private).alias("near_personal"))


def runtime_pins(lines: DataFrame) -> DataFrame:
    """Runtime versions that container files and workflows name, the first of each kind in a file."""
    line, kind = F.col("line"), surface_kind(F.col("path"))
    docker = F.when((kind == "container-file") & line.rlike(r"(?i)^FROM\s+(node|python):"), F.struct(F.lower(F.regexp_extract(line, r"(?i)^FROM\s+(node|python):", 1)).alias("runtime"), F.regexp_extract(line, r":([0-9][0-9.]*)", 1).alias("spec")))
    flow = F.when((kind == "workflow") & line.rlike(r"(node|python)-version:"), F.struct(F.regexp_extract(line, r"(node|python)-version:", 1).alias("runtime"), F.regexp_extract(line, r"version:\s*[\"']?([0-9][0-9.]*)", 1).alias("spec")))
    own = lines.withColumn("pin", F.coalesce(docker, flow)).where("pin is not null").select("path", "line_no", "pin.*")
    return own.groupBy("path", "runtime").agg(F.min_by("spec", "line_no").alias("spec"), F.min("line_no").alias("line_no"))


def pin_support(pins: DataFrame, baselines: DataFrame, today: Column) -> DataFrame:
    """supported, eol or unknown by a table (runtime, major, eol date)."""
    b = baselines.select(F.col("runtime").alias("b_runtime"), F.col("major").alias("b_major"), "eol")
    major = F.regexp_extract("spec", r"^(\d+(?:\.\d+)?)", 1)
    joined = pins.join(F.broadcast(b), (F.col("runtime") == F.col("b_runtime")) & ((major == F.col("b_major")) | (F.substring_index(major, ".", 1) == F.col("b_major"))), "left")
    return joined.select("path", "runtime", "spec", F.when(F.col("eol").isNull(), "unknown").when(F.col("eol") < today, "eol").otherwise("supported").alias("support"))
