"""Routes without a sign of authorization: one file at a time in a Python table function, since a handler's body ends where its indentation does."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, line_no int, rule_id string, method string, route string, confidence string"
# fixed values: words of paths and names that only some may use, of checks, of guards and of refusals
GUARDED_PATHS = ("admin", "manage", "internal", "superuser", "staff", "backoffice")
GUARDED_WRITES = ("setting", "settings", "config", "configuration", "role", "roles", "permission", "permissions")
GUARDS = ("login_required", "permission_required", "roles_required", "admin_required", "jwt_required", "auth_required", "requireauth", "requireadmin", "requirelogin", "ensureauth", "isadmin", "is_admin", "authorize", "authenticate", "passport.", "verifytoken", "checkauth", "withauth", "depends(")
CHECKS = ("session", "current_user", "request.user", "g.user", "is_admin", "is_staff", "role", "permission", "verify_token", "jwt.verify", "req.user", "getserversession", "authorization")
REFUSALS = ("401", "403", "unauthorized", "forbidden", "permissiondenied", "login")
WRITES = ("post", "put", "patch", "delete", "all")
MOST = 20
_PY_ROUTE = re.compile(r"\s*@[\w.]+\.(route|get|post|put|patch|delete|api_route)\(\s*['\"]([^'\"]+)['\"](.*)")
_JS_ROUTE = re.compile(r"\s*\w+\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)['\"`]\s*,(.*)")
_JS_SERVERS = ("express", "koa", "fastify", "hono", "restify", "polka", "Router()")


def _has(text: str, words: tuple[str, ...]) -> bool:
    low = text.lower()
    return any(w in low for w in words)


def _refuses(body: str) -> bool:
    return _has(body, CHECKS) and _has(body, REFUSALS)


def _guarded(route: str, name: str, writes: bool) -> bool:
    parts = re.split(r"[^a-z]+", route.lower())
    return bool({*GUARDED_PATHS} & {*parts, *re.split(r"[^a-z]+", name.lower())}) or (writes and bool({*GUARDED_WRITES} & {*parts}))


def _body(lines: list[str], at: int) -> str:
    """What is indented deeper than the line, up to 60 lines."""
    depth, out = len(lines[at]) - len(lines[at].lstrip()), []
    for line in lines[at + 1 : at + 61]:
        if line.strip() and len(line) - len(line.lstrip()) <= depth:
            break
        out.append(line)
    return "\n".join(out)


def python_routes(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, method, route, confidence) of handlers for the few that neither decorator, signature nor body guards."""
    lines = text.split("\n")
    everywhere = any(re.match(r"\s*@[\w.]+\.before_(app_)?request", x) and _refuses(_body(lines, i + 1)) for i, x in enumerate(lines[:-1])) or re.search(r"dependencies\s*=\s*\[\s*Depends\(|MIDDLEWARE\s*=[^\]]*(Authentication|LoginRequired)", text)
    for i, line in enumerate(lines):
        m = _PY_ROUTE.match(line)
        if not m or everywhere:
            continue
        end = next((k for k in range(i + 1, len(lines)) if not lines[k].lstrip().startswith("@")), None)
        name = re.match(r"\s*(?:async\s+)?def\s+(\w+)(.*)", lines[end]) if end is not None else None
        if not name:
            continue
        stated = re.search(r"methods\s*=\s*[\[(]([^\])]*)", m[3])
        methods = [x.strip(" '\"").lower() for x in stated[1].split(",")] if stated else ["get" if m[1] in ("route", "api_route") else m[1]]
        writes = bool({*methods} & {*WRITES})
        begin = i
        while begin and lines[begin - 1].lstrip().startswith("@"):
            begin -= 1
        if _guarded(m[2], name[1], writes) and not _has("\n".join(lines[begin : end + 1]), GUARDS) and not _refuses(_body(lines, end)):
            yield i + 1, "/".join(sorted(methods)), m[2], "likely" if writes else "pattern-only"


def script_routes(text: str) -> Iterator[tuple[int, str, str, str]]:
    if not any(s in text for s in _JS_SERVERS) or any(re.search(r"\.use\(", x) and _has(x, GUARDS) for x in text.split("\n")):
        return
    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = _JS_ROUTE.match(line)
        if m and _guarded(m[2], "", m[1] in WRITES) and not _has(m[3], GUARDS) and not _refuses("\n".join(lines[i : i + 30])):
            yield i + 1, m[1], m[2], "likely" if m[1] in WRITES else "pattern-only"


def route_findings(files: DataFrame) -> DataFrame:
    """Routes of Python and JavaScript files that only some may use and nothing guards, 20 a file at most: a report's length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                found = python_routes(text) if path.lower().endswith(".py") else script_routes(text)
                rows += [(path, line, "RL-ROUTE-OPEN", method, route, confidence) for line, method, route, confidence in list(found)[:MOST]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    own = files.where(F.lower("path").rlike(r"\.(py|js|jsx|ts|tsx|mjs|cjs)$") & F.col("text").isNotNull())
    return own.select("path", "text").mapInPandas(run, SCHEMA)
