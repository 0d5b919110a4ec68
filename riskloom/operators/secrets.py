"""Secret files, giant lines, and judgement that looks at what surrounds a finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import lines_of, redact_material
from riskloom.operators.detect import findings
from riskloom.operators.judge import lowered, value_based
from riskloom.rules.cards import RULES
from riskloom.sources.texts import EXCLUDED_FOLDERS, GIANT_LINE

GIANT_MARK = "<line of {} characters>"
# fixed values: how files that hold secrets are named
SECRET_NAMES = (r"(^|/)\.env(\.[a-z]+)?$", r"(^|/)(id_rsa|id_ed25519|id_ecdsa|id_dsa)$", r"\.(pem|key|p12|pfx|jks|keystore)$", r"(^|/)[^/]*(secret|password|passwd|credential|apikey|api_key)[^/]*\.(txt|key|json|ya?ml|ini|cfg)$", r"(^|/)\.(npmrc|pypirc|netrc|secret_key|htpasswd)$")
SECRET_RULES = tuple(r for r in RULES if r.category == "secret")
SWEEP_LIMIT = 200


def secret_name(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [low.rlike(p) for p in SECRET_NAMES])


def secret_value(line: Column) -> Column:
    """What looks like a secret on a line of a secret file: the part behind = or :, without quotes; empty if it is a path, a word or too short."""
    value = F.regexp_replace(F.trim(F.regexp_extract(line, r"^\s*(?:[A-Za-z0-9_.-]+\s*[:=])?\s*(.*?)\s*$", 1)), "^[\"']+|[\"']+$", "")
    shape = value.rlike(r"^[0-9a-fA-F]{32,}$") | (value.rlike(r"^[A-Za-z0-9+/=_-]{16,}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
    path = value.rlike(r"^(/|\./|~|https?://)") | value.rlike(r"^[a-z]+(-[a-z]+)+$")
    return F.when(shape & ~path, value).otherwise("")


def secret_material(files: DataFrame) -> DataFrame:
    """path, line_no, evidence of lines of secret files that hold a value; masked even where nothing on the line names one."""
    own = files.where(secret_name(F.col("path"))).select("path", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    return own.where(secret_value(F.col("line")) != "").select("path", (F.col("at") + 1).alias("line_no"), redact_material(F.col("line")).alias("evidence"))


def without_giant_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with lines over the limit replaced by a mark, those lines: path, language, line_no, line)."""
    lines = lines_of(F.col("text"))
    marked = F.array_join(F.transform(lines, lambda x: F.when(F.length(x) > GIANT_LINE, F.concat(F.lit("<line of "), F.length(x).cast("string"), F.lit(" characters>"))).otherwise(x)), "\n")
    giant = files.select("path", "language", F.posexplode(lines).alias("at", "line")).where(F.length("line") > GIANT_LINE)
    return files.withColumn("text", marked), giant.select("path", "language", (F.col("at") + 1).alias("line_no"), "line")


def secret_only_findings(lines: DataFrame) -> DataFrame:
    """Findings of the secret rules alone, for minified texts and giant lines."""
    return findings(lines, SECRET_RULES)


def swept_folders(files: DataFrame) -> DataFrame:
    """folder, path of secret-named files in folders that are not examined otherwise, the first 200 of each folder: a report's length."""
    from pyspark.sql import Window

    folder = F.regexp_extract("path", r"^((?:.*/)?(?:" + "|".join(x.replace(".", r"\.") for x in EXCLUDED_FOLDERS) + "))/", 1)
    own = files.select("path", folder.alias("folder")).where((F.col("folder") != "") & secret_name(F.col("path")))
    return own.withColumn("nth", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("nth") <= SWEEP_LIMIT).drop("nth")


def string_literals(found: DataFrame) -> DataFrame:
    """A code shape that stands wholly inside quotes is text about code. Needs the columns line_text and match."""
    before = F.substring("line_text", F.lit(1), F.greatest(F.instr(F.col("line_text"), F.col("match")) - 1, F.lit(0)))
    count = lambda q: F.length(before) - F.length(F.replace(before, F.lit(q), F.lit("")))
    inside = (F.instr(F.col("line_text"), F.col("match")) > 0) & ((count('"') % 2 == 1) | (count("'") % 2 == 1))
    return lowered(found, inside & ~value_based(), "string_literal", "stands inside a text", "low")


def rule_definitions(found: DataFrame) -> DataFrame:
    """A code shape on a line that builds a pattern, or in a file that defines rules. Needs line_text and defines_rules."""
    pattern = F.col("line_text").rlike(r"re\.compile\(|new RegExp\(|^\s*(patterns?|regex)\s*[:=]")
    return lowered(found, (pattern | F.coalesce("defines_rules", F.lit(False))) & ~value_based(), "rule_definition", "defines a rule", "low")


def defines_rules(path: Column, text: Column) -> Column:
    """A text file whose head states an id, a severity and patterns."""
    head = F.substring(text, 1, 4000)
    keys = [head.rlike(rf"(?m)^\s*-?\s*\"?{k}\"?\s*:") for k in ("id", "severity", "patterns?")]
    return F.lower(path).rlike(r"\.(md|ya?ml|json)$") & reduce(lambda a, b: a & b, keys)


def own_report(path: Column, text: Column) -> Column:
    """A report this package wrote."""
    return F.lower(path).rlike(r"\.(md|json|sarif|html)$") & F.substring(text, 1, 2000).rlike(r"riskloom report|\"name\"\s*:\s*\"riskloom\"")


def frontend_exceptions(found: DataFrame) -> DataFrame:
    """Errors shown by page code are low, unless what is sensitive stands within six lines. Needs context and frontend."""
    sensitive = F.col("context").rlike(r"(?i)token|password|secret|authorization|session|stack")
    return lowered(found, F.coalesce("frontend", F.lit(False)) & (F.col("rule_id") == "RL-CODE-ERROR-DETAIL") & ~sensitive, "frontend_exception", "page code shows its own error", "low")


def returned_resources(found: DataFrame) -> DataFrame:
    """A resource that the function hands back is closed by its caller. Needs context (the lines after)."""
    return lowered(found, (F.col("rule_id") == "RL-CODE-UNCLOSED") & F.col("context").rlike(r"(?m)^\s*(return|yield)\s+\w+"), "returned_resource", "the caller owns it", "low")


def owned_by_syntax(found: DataFrame, rules: tuple[str, ...] = ("RL-CODE-EVAL", "RL-CODE-SHELL")) -> DataFrame:
    """Pattern findings of rules the syntax engine owns go where that engine read the file. Needs the column parsed."""
    return found.where(~(F.col("rule_id").isin(*rules) & (F.col("engine") == "regex") & F.coalesce("parsed", F.lit(False))))


def path_policies(found: DataFrame) -> DataFrame:
    """The judgement that needs no more than path and category, in its order."""
    from riskloom.operators.judge import test_paths, upload_data

    return found.transform(test_paths).transform(upload_data)


def files_that_may_match(files: DataFrame, rules=RULES) -> DataFrame:
    """Files that hold a hint of any rule; a rule without hints keeps them all."""
    if any(not r.hints for r in rules):
        return files
    low = F.lower(F.col("text"))
    return files.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for r in rules for h in r.hints]))
