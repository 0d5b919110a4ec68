"""The same rules and masks as SQL text, for comparison on another engine."""

from __future__ import annotations

from riskloom.ranks import rank_sql
from riskloom.rules.cards import EXPOSURE, Rule, enforced

LINES = r"""
files AS (SELECT doc_id, concat_ws('/', coalesce(source, 'none'), 'doc' || doc_id) AS path, text, lang, source FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT *, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS p FROM files),
trimmed AS (SELECT *, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS q FROM pieces),
lines AS (SELECT path, doc_id, lang, source, CAST(i AS INTEGER) AS line_no, q[i] AS line FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM trimmed))"""


def quote(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    figure = f"TRY_CAST(substr({d}, length({d}) - CAST(i AS INTEGER), 1) AS INTEGER)"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {figure} WHEN {figure} > 4 THEN 2 * {figure} - 9 ELSE 2 * {figure} END)) % 10 = 0)"


def resident_number(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    total = f"list_sum(list_transform(range(1, 13), lambda i: TRY_CAST(substr({d}, CAST(i AS INTEGER), 1) AS INTEGER) * (CASE WHEN i <= 8 THEN i + 1 ELSE i - 7 END)))"
    return f"(length({d}) = 13 AND (contains({v}, '-') OR (11 - {total} % 11) % 10 = TRY_CAST(substr({d}, 13, 1) AS INTEGER)))"


def not_self_named(v: str) -> str:
    plain = lambda x: f"lower(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"
    return f"({plain(f'regexp_extract({v}, ' + quote(r'^([\w.-]+)\s*[:=]') + ', 1)')} <> {plain(f'regexp_extract({v}, ' + quote(r'[:=]\s*(.*)$') + ', 1)')})"


def private_address(v: str) -> str:
    p = lambda i: f"TRY_CAST(split_part({v}, '.', {i}) AS INTEGER)"
    return f"({' AND '.join(f'{p(i)} <= 255' for i in (1, 2, 3, 4))} AND ({p(1)} = 10 OR ({p(1)} = 172 AND {p(2)} BETWEEN 16 AND 31) OR ({p(1)} = 192 AND {p(2)} = 168)))"


CHECKS = {"luhn": luhn, "resident_number": resident_number, "not_self_named": not_self_named, "private_address": private_address}


def value(rule: Rule) -> str:
    out = "NULL"
    for p in reversed(rule.patterns):
        v = f"regexp_extract(line, {quote(p)}, {rule.take})"
        ok = " AND ".join([f"regexp_matches(line, {quote(p)})", *(CHECKS[name](v) for name in rule.validators)])
        out = f"CASE WHEN {ok} THEN {v} ELSE {out} END"
    for p in rule.excludes:
        out = f"CASE WHEN regexp_matches(line, {quote(p)}) THEN NULL ELSE {out} END"
    return out


def matches(rules: tuple[Rule, ...] | None = None) -> str:
    """CTEs up to `matches` over the lines of documents."""
    arms = [
        f"SELECT *, {quote(r.id)} AS rule_id, {n} AS rule_seq, {value(r)} AS match, {quote(r.category)} AS category, {quote(r.severity)} AS severity, {quote(r.decision)} AS decision, {quote(r.confidence)} AS confidence, {quote(r.group)} AS dedup_group FROM lines"
        for n, r in enumerate(enforced() if rules is None else rules)
    ]
    return LINES + ",\nmatches AS MATERIALIZED (SELECT * FROM (" + "\nUNION ALL ".join(arms) + ") WHERE match IS NOT NULL)"


def _partial(x: str) -> str:
    head, tail = f"least(8, length({x}) // 4)", f"least(4, length({x}) // 8)"
    return f"CASE WHEN {head} + {tail} < 6 THEN '****' ELSE substr({x}, 1, CAST({head} AS INTEGER)) || '****' || right({x}, CAST({tail} AS INTEGER)) END"


#: The masks once more, as SQL of their own: nothing here is read from riskloom.functions.
MASKS = [
    (
        r"\b([0-9]{6}-?[0-9]{7}|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}|[0-9]{3}-?[0-9]{3,4}-?[0-9]{4})\b",
        "CASE WHEN length(replace(x, '-', '')) = 13 AND regexp_matches(replace(x, '-', ''), '^[0-9]{6}[1-4][0-9]{6}$') THEN substr(x, 1, 6) || '-' || substr(replace(x, '-', ''), 7, 1) || '******' "
        "WHEN regexp_matches(translate(x, ' -', ''), '^(4[0-9]{14,15}|5[1-5][0-9]{13,14}|3[47][0-9]{13,14}|6011[0-9]{11,12}|65[0-9]{13,14})$') THEN substr(translate(x, ' -', ''), 1, 4) || '-****-****-' || substr(translate(x, ' -', ''), 13) "
        "WHEN regexp_matches(translate(x, ' -', ''), '^01[016789][0-9]{7,8}$') THEN substr(x, 1, 3) || '-****-' || right(x, 4) ELSE x END",
    ),
    (r"([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", "regexp_replace(x, '^([A-Za-z0-9]{1,2}).*@', '\\1***@')"),
    (r"(://[^\s/@\"']+@)", "regexp_replace(x, '^://([^:]*):.*@$', '://\\1:****@')"),
    (
        r"([A-Za-z0-9][A-Za-z0-9._-]{7,})",
        "CASE WHEN regexp_matches(x, '^eyJ[^.]*\\.eyJ[^.]*\\.') THEN substr(x, 1, 7) || '****' WHEN regexp_matches(x, '^(sk[-_].{8,}|AKIA[0-9A-Z._-]{16})$') THEN {partial} ELSE x END",
    ),
    (
        r"((?i:api[_ -]?key|secret[_ -]?key|signing[_ -]?key|private[_ -]?key|access[_ -]?key|auth[_ -]?token|secret|token|password|passwd|pwd|비밀번호|암호)[\"'*]*\s*[:=]\s*[\"']?[^\s\"',;]+)",
        "CASE WHEN contains(regexp_replace(x, '^[^:=]*[:=]\\s*[\"'']?', ''), '***') THEN x WHEN regexp_matches(x, '^(?i:password|passwd|pwd|비밀번호|암호)') THEN regexp_extract(x, '^([^:=]*[:=]\\s*[\"'']?)', 1) || '****' "
        "ELSE regexp_extract(x, '^([^:=]*[:=]\\s*[\"'']?)', 1) || {partial_value} END",
    ),
]


def evidence() -> str:
    """CTEs from `matches` to `findings`, with evidence, id and the rest of a finding."""
    begin = "greatest(1, instr(line, match) - 60)"
    cut = f"substr(line, {begin}, length(match) + 120)"
    expressions = [f"CASE WHEN length(line) <= 200 THEN line ELSE (CASE WHEN {begin} > 1 THEN '…' ELSE '' END) || {cut} || (CASE WHEN {begin} + length({cut}) <= length(line) THEN '…' ELSE '' END) END"]
    value = "regexp_replace(x, '^[^:=]*[:=]\\s*[\"'']?', '')"
    for pattern, masked in MASKS:
        masked = masked.replace("{partial}", _partial("x")).replace("{partial_value}", f"({_partial(value)})")
        expressions.append(f"list_reduce(list_prepend(evidence, list_distinct(regexp_extract_all(evidence, {quote(pattern)}, 1))), lambda acc, x: replace(acc, x, {masked}))")
    expressions.append("substr(trim(evidence), 1, 240)")
    steps, last = [], "matches"
    for i, e in enumerate(expressions):
        star = "*" if i == 0 else "* EXCLUDE (evidence)"
        steps.append(f"m{i} AS MATERIALIZED (SELECT {star}, {e} AS evidence FROM {last})")
        last = f"m{i}"
    steps.append(f"findings AS (SELECT *, rule_id || ':' || substr(sha256(concat_ws(':', rule_id, path, line_no, evidence)), 1, 10) AS id, 'regex' AS engine FROM {last})")
    return ",\n".join(steps)


def path_class(path: str) -> str:
    from riskloom.operators import judge as J

    folders = f"list_slice(string_split(lower({path}), '/'), 1, -2)"
    name = f"list_extract(string_split(lower({path}), '/'), -1)"
    has = lambda names: f"list_has_any({folders}, [{', '.join(quote(n) for n in names)}])"
    first = f"list_extract(string_split(lower({path}), '/'), 1)"
    return (
        f"CASE WHEN {has(J.UPLOAD_SEGMENTS)} THEN 'upload-data' WHEN {has(J.SAMPLE_SEGMENTS)} THEN 'sample' WHEN {has(J.TEST_SEGMENTS)} OR regexp_matches({name}, '(^test_|_test\\.|\\.test\\.|\\.spec\\.)') THEN 'test' "
        f"WHEN (contains({path}, '/') AND {first} IN ({', '.join(quote(n) for n in J.BUILD_SEGMENTS)})) OR regexp_matches({name}, '(^makefile$|\\.config\\.[a-z]+$)') THEN 'build-tool' ELSE 'runtime' END"
    )


def judged() -> str:
    """CTEs from `findings` to `judged`: evidence policy, one finding a rule and line, groups merged."""
    from riskloom.ranks import CONFIDENCE, DECISION, ENGINE, SEVERITY
    from riskloom.rules.cards import CONSTRUCT_RULES

    exposure = ", ".join(quote(c) for c in EXPOSURE)
    construct = ", ".join(quote(c) for c in CONSTRUCT_RULES)
    order = ", ".join(f"{rank_sql(v, c)} DESC" for v, c in ((ENGINE, "engine"), (CONFIDENCE, "confidence"), (SEVERITY, "severity"), (DECISION, "decision")))
    return f"""
policed AS (SELECT * EXCLUDE (decision), CASE WHEN decision = 'block' AND NOT (confidence = 'confirmed' OR category IN ({exposure}) OR rule_id IN ({construct})) THEN 'warn' ELSE decision END AS decision FROM findings),
grouped AS (SELECT *, coalesce(dedup_group, 'rule:' || rule_id) AS g FROM policed),
placed AS (SELECT *, row_number() OVER (PARTITION BY path, line_no, g ORDER BY {order}, rule_id) AS place, list(rule_id) OVER (PARTITION BY path, line_no, g) AS ids FROM grouped),
judged AS (SELECT * EXCLUDE (place, ids, g), array_to_string(list_sort(list_distinct(list_filter(ids, lambda x: x <> rule_id))), ',') AS also FROM placed WHERE place = 1)"""
