"""Judges of whole files as data: a line that shows something, what must stand near it, and what the file must have or lack.

A signal's patterns avoid lookaround and back references, so they mean the same in
every engine. All signals of a set are read in one pass over the files; a file's
lines are an array, windows are slices of it, and nothing leaves the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import lines_of


def any_of(*words: str) -> str:
    """A pattern for any of these texts."""
    return "(?:" + "|".join(re.escape(w).replace("/", "\\/").replace("\\/", "/").replace('\\"', '"').replace("\\'", "'") for w in words) + ")"


@dataclass(frozen=True)
class Signal:
    """A finding on each line (or the first) with `pattern`, in files by path, if near lines and the file agree; `raises` lifts its confidence."""

    rule_id: str
    detail: str
    pattern: str
    confidence: str
    files: str = ""
    needs: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    near: tuple[str, ...] = ()
    near_lacks: str = ""
    before: int = 0
    after: int = 0
    every: bool = False
    raises: tuple[str, str] | None = None
    raises_near: tuple[str, str] | None = None


# fixed values: command-line agents, their options, and calls that start a process
AGENT_NAMES = ("claude", "gemini", "codex", "copilot", "kiro", "cursor-agent", "aider", "opencode", "goose", "cline", "amp")
UNATTENDED_OPTIONS = ("--print", "--prompt", "--message", "--non-interactive", "--no-interactive", "--headless", "--batch")
UNCHECKED_OPTIONS = (
    "--dangerously-skip-permissions", "--yolo", "--trust-all-tools", "--trust-all", "--allow-all", "--auto-approve", "--auto-accept", "--no-confirm",
    "--no-approval", "--skip-permissions", "--bypass-permissions", "--full-auto", "--sandbox=danger-full-access", "--approval-mode=never",
)
SPAWNING = (r"\b(?:execSync|execFileSync|execFile|spawnSync|spawn|execa|child_process)\b", r"\bsubprocess\.(?:run|call|Popen|check_output|check_call)\b", r"\bos\.(?:system|popen)\b")
SENDING = (r"\b(?:requests|httpx|aiohttp|axios|got)\.(?:post|put|request)\b", r"\burlopen\b", r"\bfetch\s*\(", r"\bsendBeacon\b", r"\bsmtplib\b", r"\bcurl\b", r"\bInvoke-(?:RestMethod|WebRequest)\b", r"\bsocket\.(?:connect|sendall|sendto)\b")
RUNNING = (r"\beval\s*\(", r"\bexec\s*\(", r"\bFunction\s*\(", r"\bchild_process\b", r"\bsubprocess\b", r"\bos\.system\b", r"\bexecSync\b", r"\bspawn\b")
PUBLIC_TEXT_HOSTS = ("raw.githubusercontent.com", "gist.githubusercontent.com", "pastebin.com/raw", "hastebin", "docs.google.com/document", "script.google.com")
WEBHOOK_HOSTS = ("discord.com/api/webhooks/", "discordapp.com/api/webhooks/", "hooks.slack.com/services/")
CHAIN_CALLS = ("eth_call", "eth_sendRawTransaction", "JsonRpcProvider", "@solana/web3", "infura.io", "alchemy.com/v2")
#: Places where credentials lie, by kind.
CREDENTIAL_PLACES = {
    "ssh-key": (".ssh/id_", "id_rsa", "id_ed25519", "id_ecdsa"), "aws": (".aws/credentials",), "gcp": (".config/gcloud", "application_default_credentials.json"), "azure": (".azure/accessTokens", ".azure/msal_token_cache"),
    "kube": (".kube/config",), "docker": (".docker/config.json",), "packages": ("~/.npmrc", ".pypirc", ".netrc", ".git-credentials"), "forge": (".config/gh/hosts", "gh auth token"),
    "agent": (".claude.json", ".claude/", ".codex/", ".cursor/", ".gemini/"), "browser": ("Login Data", "moz_cookies", "places.sqlite"), "process": ("/proc/self/environ",), "metadata": ("169.254.169.254", "metadata.google.internal"),
    "environment": ("dict(os.environ", "os.environ.copy(", "os.environ.items(", "JSON.stringify(process.env", "...process.env"), "keystore": ("login.keychain", "secretstorage", "libsecret", "wallet.dat"),
}
PACKING = ("Fernet", "base64.b64encode", "urlsafe_b64encode", "btoa(", "zlib.compress", "gzip.compress", "createCipher", "publicEncrypt")
WEB_PREFERENCES = (r"\bnodeIntegration\s*:\s*true", r"\bcontextIsolation\s*:\s*false", r"\bsandbox\s*:\s*false", r"\bwebSecurity\s*:\s*false", r"\ballowRunningInsecureContent\s*:\s*true", r"\bwebviewTag\s*:\s*true")
FUSES = ("RunAsNode", "EnableNodeOptionsEnvironmentVariable", "EnableNodeCliInspectArguments", "OnlyLoadAppFromAsar", "EnableEmbeddedAsarIntegrityValidation")

_EITHER = lambda patterns: "(?:" + "|".join(patterns) + ")"
_SCRIPT, _SOURCE = r"\.(js|jsx|ts|tsx|mjs|cjs)$", r"\.(py|js|jsx|ts|tsx|mjs|cjs|sh|ps1)$"
_AGENT_CALL = "['\"]" + any_of(*AGENT_NAMES) + r"(?:\.exe|\.cmd)?['\" ]"
_REMOTE_LOAD = r"\bloadURL\s*\(\s*['\"`]https?://[a-z0-9-]+\.[a-z]"
_PROCESS = r"\b(?:exec|execSync|execFile|spawn|spawnSync)\s*\(|\bsendText\s*\("

AGENT_SIGNALS = (
    Signal("RL-AGENT-CLI", "agent started without its checks", _EITHER(SPAWNING), "confirmed", _SOURCE, near=(_AGENT_CALL, any_of(*UNCHECKED_OPTIONS)), before=1, after=2, every=True),
    Signal("RL-AGENT-CLI", "agent started unattended", _EITHER(SPAWNING), "likely", _SOURCE, near=(_AGENT_CALL, any_of(*UNATTENDED_OPTIONS)), near_lacks=any_of(*UNCHECKED_OPTIONS), before=1, after=2, every=True),
    Signal("RL-AGENT-CHANNEL", "text of a public host is run", any_of(*PUBLIC_TEXT_HOSTS), "confirmed", _SOURCE, near=(_EITHER(RUNNING),), before=3, after=6),
    Signal("RL-AGENT-CHANNEL", "messenger webhook in code", any_of(*WEBHOOK_HOSTS), "pattern-only", _SOURCE, raises=(_EITHER(SENDING), "likely")),
    Signal("RL-AGENT-CHANNEL", "DNS answers drive code", r"(?:resolveTxt|dns\.resolver|nslookup)", "likely", _SOURCE, near=(r"\b(?:eval|exec|system|spawn|fetch|urlopen|connect)\b",), after=3),
    Signal("RL-AGENT-CHANNEL", "call to a chain's nodes", any_of(*CHAIN_CALLS), "pattern-only", _SOURCE),
)
DESKTOP_SIGNALS = (
    Signal("RL-DESKTOP-WEBPREFS", "window without isolation", r"new\s+BrowserWindow\s*\(", "likely", _SCRIPT, near=(_EITHER(WEB_PREFERENCES),), after=40, every=True, raises=(_REMOTE_LOAD, "confirmed")),
    Signal("RL-DESKTOP-BRIDGE", "bridge exposes a whole module", r"exposeInMainWorld\s*\(\s*['\"]\w+['\"]\s*,\s*(?:ipcRenderer|require|process)\b", "confirmed", _SCRIPT),
    Signal("RL-DESKTOP-BRIDGE", "handler with privileged calls and no check of the sender", r"ipcMain\.(?:handle|on|handleOnce|once)\s*\(", "likely", _SCRIPT, near=(r"\bfs\.(?:readFile|writeFile|unlink|rm)|\bchild_process\b|" + _PROCESS + r"|\bshell\.open|\bfetch\s*\(",), near_lacks=r"senderFrame|sender\.getURL|validateSender|isTrustedSender|allowedOrigins", after=25),
    Signal("RL-DESKTOP-OPEN", "outer programs opened on a value", r"shell\.openExternal\s*\(\s*[^'\"`)\s]", "likely", _SCRIPT, near_lacks=r"protocol|startsWith\s*\(\s*['\"]https|isSafeUrl|isAllowedUrl", before=8, after=2),
    Signal("RL-DESKTOP-HARDENING", "remote pages without a window handler", _REMOTE_LOAD, "likely", _SCRIPT, lacks=(r"setWindowOpenHandler|will-navigate|will-redirect",)),
    Signal("RL-DESKTOP-HARDENING", "remote pages without a permission handler", _REMOTE_LOAD, "likely", _SCRIPT, lacks=(r"setPermission(?:Request|Check)Handler",)),
)
EDITOR_SIGNALS = (
    Signal("RL-EDITOR-TRUST", "a setting of the workspace reaches a process", r"getConfiguration\s*\([^)]*\)\.get[^(]*\(\s*['\"][\w.]*(?:[Pp]ath|[Cc]ommand|[Aa]rgs|[Ee]xecutable|[Ss]hell|[Ss]cript)", "likely", _SCRIPT, needs=(_PROCESS,)),
    Signal("RL-EDITOR-WEBVIEW", "scripts without a content policy", r"enableScripts\s*:\s*true", "likely", _SCRIPT, lacks=(r"(?i)content-security-policy",)),
    Signal("RL-EDITOR-WEBVIEW", "markup put together from values", r"webview\.html\s*=\s*[^;]*(?:\$\{|\+\s*[\w$])", "likely", _SCRIPT),
    Signal("RL-EDITOR-WEBVIEW", "a message reaches a process", r"onDidReceiveMessage\s*\(", "likely", _SCRIPT, near=(_PROCESS,), after=30),
)
BROWSER_SIGNALS = (
    Signal("RL-BROWSER-HEADER", "security headers removed", r"(?i)(?:content-security-policy|x-frame-options|strict-transport-security)", "confirmed", _SCRIPT, near=(r"(?i)operation['\"]?\s*:\s*['\"]remove|\.(?:filter|splice|delete)\s*\(|\bdelete\b",), before=3, after=3),
    Signal("RL-BROWSER-REMOTE", "code from elsewhere", r"(?i)<script[^>]+src\s*=\s*['\"]https?://|\bimport\s*\(\s*['\"`]https?://|\beval\s*\(\s*(?:await\s+)?(?:fetch|resp)", "confirmed", _SCRIPT),
    Signal("RL-BROWSER-MESSAGE", "messages not checked reach private data", r"runtime\.onMessage(?:External)?\.addListener\s*\(", "likely", _SCRIPT, near=(r"chrome\.(?:cookies|scripting|history|storage|debugger|downloads|tabs\.executeScript)|\bfetch\s*\(",), near_lacks=r"sender\.(?:id|origin|url|tab)|runtime\.id", after=25, raises_near=(r"onMessageExternal", "confirmed")),
)
SERVER_SIGNALS = (
    Signal("RL-SERVER-ARGUMENT", "a tool's argument reaches a shell", r"(?:subprocess\.(?:run|Popen|call|check_output)|os\.(?:system|popen))\s*\([^\n]*(?:shell\s*=\s*True|f['\"]|\+\s*\w|\.format\()|\b(?:exec|execSync|spawn)\s*\([^\n]*(?:\$\{|\+\s*\w|args\.|params\.)", "confirmed", r"\.(py|js|ts|mjs)$", needs=(r"@modelcontextprotocol/sdk|\bfastmcp\b|\bfrom mcp\b|\bimport mcp\b",)),
    Signal("RL-SERVER-PATH", "a tool's argument is opened", r"\b(?:open|readFile|readFileSync|writeFile|Path)\s*\(\s*(?:args?|params|arguments)[.\[]", "likely", r"\.(py|js|ts|mjs)$", needs=(r"@modelcontextprotocol/sdk|\bfastmcp\b|\bfrom mcp\b|\bimport mcp\b",)),
    Signal("RL-SERVER-ORIGIN", "served without a check of the origin", r"host\s*=\s*['\"]0\.0\.0\.0|transport\s*=\s*['\"](?:sse|http|streamable-http)|--host 0\.0\.0\.0", "likely", r"\.(py|js|ts|mjs)$", needs=(r"@modelcontextprotocol/sdk|\bfastmcp\b|\bfrom mcp\b|\bimport mcp\b",), lacks=(r"\bOrigin\b|allowedOrigins|allowedHosts|TrustedHost",)),
)
PAGE_SIGNALS = (
    Signal("RL-CLIENT-GATE", "a secret's name in the public bundle", r"(?:process|meta)\.env\.(?:NEXT_PUBLIC|VITE|REACT_APP|EXPO_PUBLIC|PUBLIC|NUXT_PUBLIC|GATSBY)_\w*(?:PIN|PASS|SECRET|TOKEN|API_?KEY|ADMIN|PRIVATE_?KEY)", "likely", _SCRIPT),
    Signal("RL-CLIENT-GATE", "the browser's store decides who is admin", r"(?i)(?:session|local)Storage\.getItem\(\s*['\"]?[\w.]*admin[\w.]*['\"]?\s*\)\s*={2,3}\s*['\"](?:true|1|ok|yes)", "pattern-only", _SCRIPT),
)
SETTINGS_SIGNALS = (
    Signal("RL-NPM-HOOK", "install scripts switched on", r"(?i)^\s*ignore-scripts\s*=\s*false\s*$", "likely", r"(^|/)\.npmrc$", every=True),
    Signal("RL-LOCK-SOURCE", "registry without encryption", r"(?i)^\s*[^;#=\s]*registry\s*=\s*http://", "confirmed", r"(^|/)\.npmrc$", every=True),
    Signal("RL-LOCK-SOURCE", "package from a repository", r"^\s+resolved\s+\"?(?:git\+|git://|github:)", "likely", r"(^|/)yarn\.lock$", every=True),
    Signal("RL-LOCK-SOURCE", "package from a repository", r"^\s+resolution:\s*\{.*(?:type: git|repo:)", "likely", r"(^|/)pnpm-lock\.ya?ml$", every=True),
    Signal("RL-LOCK-HOOK", "package builds on installation", r"^\s+requiresBuild:\s*true", "likely", r"(^|/)pnpm-lock\.ya?ml$", every=True),
    Signal("RL-DESKTOP-HARDENING", "build without fuses", r"", "likely", r"(^|/)(forge\.config\.[jt]s|electron-builder\.(yml|json|config\.js))$", lacks=(r"(?i)FuseV1Options|@electron/fuses|flipFuses|FusesPlugin",)),
)
ALL_SIGNALS = (*AGENT_SIGNALS, *DESKTOP_SIGNALS, *EDITOR_SIGNALS, *BROWSER_SIGNALS, *SERVER_SIGNALS, *PAGE_SIGNALS, *SETTINGS_SIGNALS)


def window(lines: Column, at: Column, before: int, after: int) -> Column:
    """Lines around the line with number at, as one text."""
    first = F.greatest(F.lit(1), at - before)
    return F.array_join(F.slice(lines, first, at + after - first + 1), "\n")


def signal_rows(signal: Signal, lines: Column, text: Column, path: Column) -> Column:
    """array<struct<rule_id, line_no, confidence, detail>> of one signal on one file."""

    def near(at: Column) -> list[Column]:
        own = window(lines, at, signal.before, signal.after)
        return [own.rlike(p) for p in signal.near] + ([~own.rlike(signal.near_lacks)] if signal.near_lacks else [])

    def at(line: Column, k: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, [line.rlike(signal.pattern), *near(k + 1)]), k + 1)

    found = F.array_compact(F.transform(lines, at))
    found = found if signal.every else F.slice(found, 1, 1)

    def row(k: Column) -> Column:
        confidence = F.lit(signal.confidence)
        if signal.raises:
            confidence = F.when(text.rlike(signal.raises[0]), signal.raises[1]).otherwise(confidence)
        if signal.raises_near:
            confidence = F.when(F.get(lines, k - 1).rlike(signal.raises_near[0]), signal.raises_near[1]).otherwise(confidence)
        return F.struct(F.lit(signal.rule_id).alias("rule_id"), k.alias("line_no"), confidence.alias("confidence"), F.lit(signal.detail).alias("detail"))

    # the file is asked before its lines are
    ok = F.lower(path).rlike(signal.files) if signal.files else F.lit(True)
    for p in signal.needs:
        ok = ok & text.rlike(p)
    for p in signal.lacks:
        ok = ok & ~text.rlike(p)
    return F.when(ok, F.transform(found, row)).otherwise(F.array().cast("array<struct<rule_id:string,line_no:int,confidence:string,detail:string>>"))


def signal_findings(files: DataFrame, signals: tuple[Signal, ...] = ALL_SIGNALS) -> DataFrame:
    """path, rule_id, line_no, confidence, detail. files: path, text."""
    own = files.select("path", "text", lines_of(F.col("text")).alias("lines"))
    rows = F.flatten(F.array(*[signal_rows(s, F.col("lines"), F.col("text"), F.col("path")) for s in signals]))
    return own.select("path", F.explode(rows).alias("f")).select("path", "f.*")


def credential_theft(files: DataFrame) -> DataFrame:
    """Files that name three kinds of places with credentials or more and send something, or four without sending.

    path, line_no (of the first place named), n_kinds, kinds, confidence: confirmed if
    what is sent is packed too, likely if only sent, pattern-only if not sent.
    """
    text, lines = F.col("text"), F.col("lines")
    has = lambda x, words: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])
    kinds = F.array_compact(F.array(*[F.when(has(text, words), F.lit(kind)) for kind, words in sorted(CREDENTIAL_PLACES.items())]))
    every = tuple(w for words in CREDENTIAL_PLACES.values() for w in words)
    first = F.array_position(F.transform(lines, lambda x: has(x, every)), F.lit(True))
    own = files.where(F.lower("path").rlike(_SOURCE)).select("path", "text", lines_of(text).alias("lines")).withColumn("kinds", kinds).where(F.size("kinds") >= 3)
    sends, packs = text.rlike(_EITHER(SENDING)), has(text, PACKING)
    confidence = F.when(sends & packs, "confirmed").when(sends, "likely").when(F.size("kinds") >= 4, "pattern-only")
    return own.select("path", first.cast("int").alias("line_no"), F.size("kinds").alias("n_kinds"), F.array_join("kinds", ",").alias("kinds"), confidence.alias("confidence")).where("confidence is not null")
