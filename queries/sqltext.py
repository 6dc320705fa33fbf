"""Helpers that write DuckDB SQL text for the checks."""

from __future__ import annotations

from siftlog.functions import fixed as X


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_map(expr: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {lit(k) if isinstance(k, str) else k} THEN {lit(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def masks(expr: str, table) -> str:
    for text, repl, ignore_case in table:
        repl = repl.replace("$2", "\\2")
        expr = f"regexp_replace({expr}, {lit(('(?i)' if ignore_case else '') + text)}, {lit(repl)}, 'g')"
    return expr


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def any_word(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def severity(expr: str) -> str:
    return case_map(f"upper({expr})", X.SEVERITY, str(X.DEFAULT_SEVERITY))


def infer_level(expr: str) -> str:
    return case_map(f"lower(regexp_extract({expr}, {lit('(?i)' + X.LEVEL_WORD_PATTERN)}, 1))", X.LEVEL_WORD, "'INFO'")


def norm_level(expr: str) -> str:
    return case_map(f"lower({expr})", X.LEVEL_WORD, f"upper({expr})")


def template_key(expr: str) -> str:
    return f"lower(regexp_replace({masks(strip(expr), X.TEMPLATE_MASKS)}, '\\s+', ' ', 'g'))"


def family_key(expr: str) -> str:
    return f"lower({strip(masks(expr, X.FAMILY_MASKS))})"


def scan_mask(expr: str) -> str:
    inner = strip(f"regexp_replace({masks(f'lower({expr})', X.SCAN_MASKS)}, '\\s+', ' ', 'g')")
    return f"CASE WHEN {inner} = '' THEN '<empty>' ELSE {inner} END"


def matches(expr: str, patterns) -> str:
    return f"regexp_matches({expr}, {lit('(?i)' + '|'.join(patterns))})"


def normalize(expr: str) -> str:
    """Message normalisation with the base synonyms, for text of any case."""
    conn = "regexp_extract(upper(t), '^ECONN(\\w+)$', 1)"
    part = case_map("p", X.BASE_SYNONYMS, "p")
    camel = ("lower(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'))")
    codes = " ".join(f"WHEN regexp_matches(upper(t), {lit(c)}) THEN {lit(w)}" for c, w in X.ERROR_CODES)
    rule = f"""CASE WHEN regexp_matches(t, '^\\d+$') THEN t
      WHEN lower(t) IN ({', '.join(lit(k) for k in X.BASE_SYNONYMS)}) THEN {case_map('lower(t)', X.BASE_SYNONYMS, 'NULL')}
      WHEN {conn} <> '' THEN lower({conn}) {codes}
      WHEN regexp_matches(upper(t), '^E[A-Z]{{2,10}}$') THEN lower(substr(t, 2))
      WHEN regexp_matches(t, '[a-z][A-Z]|[A-Z][A-Z][a-z]') THEN array_to_string(list_transform(string_split({camel}, ' '), lambda p: {part}), ' ')
      WHEN regexp_matches(lower(t), '^[a-z]+\\d+$') THEN array_to_string(list_transform(
        [regexp_extract(lower(t), '^([a-z]+)', 1), regexp_extract(lower(t), '(\\d+)$', 1)], lambda p: {part}), ' ')
      ELSE lower(t) END"""
    return f"array_to_string(list_transform(regexp_extract_all({expr}, '[A-Za-z][A-Za-z0-9]*|\\d+'), lambda t: {rule}), ' ')"


def features(level: str, service: str, message: str) -> dict[str, str]:
    """The fourteen features; look-around rewritten for an engine without it."""
    low = f"lower({message})"
    http = "(?i)" + X.HTTP_PATTERN.replace("(?=OK", "(?:OK")
    first, second = (f"regexp_extract({message}, {lit(http)}, {g})" for g in (1, 2))
    status = f"CAST(coalesce(nullif({first}, ''), nullif({second}, '')) AS INT)"
    top = f"list_max(list_transform(regexp_extract_all({low}, {lit(X.NUMBER_PATTERN)}, 1), lambda n: CAST(n AS DOUBLE)))"
    val = f"CAST(list_extract(regexp_extract_all({low}, {lit(X.DURATION_PATTERN)}, 1), -1) AS DOUBLE)"
    unit = f"list_extract(regexp_extract_all({low}, {lit(X.DURATION_PATTERN)}, 2), -1)"
    sec = f"CASE WHEN {unit} = 'ms' THEN {val} / 1000 WHEN {unit} IN ('minutes', 'min') THEN {val} * 60 ELSE {val} END"
    rep = f"regexp_extract({low}, {lit(X.REPEAT_PATTERN)}, 1)"
    norm = normalize(low)
    hits = " + ".join(f"CAST(contains(nrm, {lit(w)}) AS INT)" for w in X.FEATURE_WORDS)
    flag = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return {
        "_norm": norm,
        "level_score": "CAST(" + case_map(f"upper({level})", X.FEATURE_LEVEL_WEIGHT, str(X.DEFAULT_FEATURE_LEVEL_WEIGHT)) + " AS DOUBLE)",
        "error_score": f"({hits}) / 23.0::DOUBLE",
        "http_score": f"CASE WHEN {status} >= 500 THEN 1.0::DOUBLE WHEN {status} >= 400 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END",
        "has_number": flag(f"{top} IS NOT NULL"),
        "max_number": f"coalesce(least(log10(1.0::DOUBLE + {top}) / 9.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE)",
        "length_score": f"least(length({message}) / 200.0::DOUBLE, 1.0::DOUBLE)",
        "has_stack": flag(any_word(low, X.STACK_WORDS)),
        "has_ip": flag(f"regexp_matches({low}, {lit(X.IP_PATTERN)})"),
        "has_port": flag(f"regexp_matches({low}, '(^|[^0-9]):[0-9]{{2,5}}([^0-9]|$)')"),
        "has_duration": flag(f"{unit} IS NOT NULL"),
        "max_duration": f"coalesce(least(ln(1 + {sec}) / 10.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE)",
        "has_memory": flag(f"regexp_matches({low}, {lit(X.MEMORY_PATTERN)})"),
        "repeat_score": f"CASE WHEN {rep} <> '' THEN least(CAST({rep} AS DOUBLE) / 100.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END",
        "has_service": flag(f"lower(coalesce({service}, '')) NOT IN ('', 'unknown')"),
    }
