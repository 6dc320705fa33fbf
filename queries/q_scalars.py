"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.config import THRESHOLDS
from siftlog.functions import features as FE, fixed as X, levels as LV, text as T, times as D, vectors as V
from siftlog.operators.alerts import app_records as records

from . import corpus as C
from . import sqltext as S

Q, SQL = {}, {}


def _q(name, columns, sql, base="logs"):
    """A row-local query over the event logs: one output row per log entry."""
    def run(spark, sf):
        df = (C.logs if base == "logs" else C.raw_lines)(spark, sf)
        return df.select(F.col("entry_id"), *[c.alias(n) for n, c in columns().items()])
    Q[name] = run
    SQL[name] = f"WITH {C.LOGS_DUCK if base == 'logs' else C.RAW_DUCK} SELECT entry_id, {sql} FROM {'logs' if base == 'logs' else 'raw_lines'}"


_word = "split_part('fatal,severe,Exception,failure,trace,NOTICE,emerg,none,warning,debugging', ',', CAST(entry_id % 10 AS INT) + 1)"
_wordc = lambda: F.split_part(F.lit("fatal,severe,Exception,failure,trace,NOTICE,emerg,none,warning,debugging"), F.lit(","), (F.col("entry_id") % 10 + 1).cast("int"))
_q("infer_level", lambda: {"inferred": LV.infer_level(F.concat(F.lit("x "), _wordc(), F.lit(": "), F.col("message"))), "normalized": LV.norm_level(_wordc())},
   f"{S.infer_level(f'''('x ' || {_word} || ': ' || message)''')} AS inferred, {S.norm_level(_word)} AS normalized")

_pri = f"regexp_extract(value, {S.lit(X.PRI_PATTERN)}, 1)"
_fac = f"lower(regexp_extract(value, {S.lit('(?i)' + X.FACILITY_PATTERN)}, 1))"
_q("syslog_severity", lambda: {"level": LV.syslog_level("value")},
   f"CASE WHEN {_pri} <> '' THEN list_extract([{', '.join(S.lit(x) for x in X.SYSLOG_SEVERITY)}], CAST({_pri} AS INT) % 8 + 1) "
   f"ELSE {S.case_map(_fac, X.FACILITY_SEVERITY, S.lit('INFO'))} END AS level", "raw")

_st = "CAST(200 + c % 320 AS INT)"
_q("status_level", lambda: {"status": (200 + F.col("c") % 320).cast("int"), "level": LV.status_level(200 + F.col("c") % 320)},
   f"{_st} AS status, CASE WHEN {_st} IN (503, 504) THEN 'CRITICAL' WHEN {_st} >= 500 THEN 'ERROR' WHEN {_st} = 404 THEN 'INFO' "
   f"WHEN {_st} >= 400 THEN 'WARN' ELSE 'INFO' END AS level")

_lv = "CASE WHEN entry_id % 9 = 0 THEN 'emerg' WHEN entry_id % 9 = 1 THEN 'Warning' WHEN entry_id % 9 = 2 THEN 'odd' WHEN entry_id % 9 = 3 THEN 'trace' ELSE level END"
_lvc = lambda: (F.when(F.col("entry_id") % 9 == 0, "emerg").when(F.col("entry_id") % 9 == 1, "Warning")
        .when(F.col("entry_id") % 9 == 2, "odd").when(F.col("entry_id") % 9 == 3, "trace").otherwise(F.col("level")))
_q("severity_rank",
   lambda: {"severity": LV.severity(_lvc()), "display": LV.display_severity(_lvc()), "sort_rank": LV.sort_severity(_lvc()), "scan_weight": LV.scan_weight(F.upper(_lvc()))},
   f"{S.severity(_lv)} AS severity, {S.case_map(f'upper({_lv})', X.DISPLAY_SEVERITY, '2')} AS display, "
   f"{S.case_map(f'upper({_lv})', X.SORT_SEVERITY, '2')} AS sort_rank, CAST({S.case_map(f'upper({_lv})', X.SCAN_WEIGHT, '0.1')} AS DOUBLE) AS scan_weight")

_nm = "split_part('warning,FATAL,notset,critical,custom,INFO', ',', CAST(entry_id % 6 AS INT) + 1)"
_nmc = lambda: F.split_part(F.lit("warning,FATAL,notset,critical,custom,INFO"), F.lit(","), (F.col("entry_id") % 6 + 1).cast("int"))
_q("level_alias", lambda: {"level": LV.record_level(_nmc())}, f"{S.case_map(f'upper({_nm})', X.RECORD_LEVEL_ALIAS, f'upper({_nm})')} AS level")

_q("keyword_signals", lambda: {"catastrophe": LV.has_catastrophe("message"), "failure": LV.has_failure("message")},
   f"{S.matches('message', X.CATASTROPHE_PATTERNS)} AS catastrophe, {S.matches('message', X.FAILURE_PATTERNS)} AS failure")
_q("suppress_info", lambda: {"keep": LV.keep_in_report("level", "message")}, f"upper(level) <> 'INFO' OR {S.any_word('lower(message)', X.REPORT_INFO_WORDS)} AS keep")
_q("suppress_benign", lambda: {"benign": LV.is_benign_live("level", "message")},
   f"{S.severity('level')} >= 5 AND NOT {S.any_word('lower(message)', X.LIVE_INFO_WORDS)} AS benign")

_q("template_key", lambda: {"template": T.template_key("message")}, f"{S.template_key('message')} AS template")
_q("family_key", lambda: {"family": T.family_key("message")}, f"{S.family_key('message')} AS family")
_q("turbo_mask", lambda: {"mask": T.scan_mask("message")}, f"{S.scan_mask('message')} AS mask")
_q("alert_key", lambda: {"alert": T.alert_key("level", "service", "message")},
   "upper(level) || '|' || service || '|' || substr(regexp_replace(lower(message), '\\S*\\d\\S*', '<id>', 'g'), 1, 120) AS alert")


def page_masks(spark, sf):
    """Masks on long, messy, non-log text: whole pages, in three mask families."""
    pages = C.table(spark, sf, "pages")
    return pages.select("page_id", F.md5(T.template_key("html")).alias("template"), F.md5(T.family_key("html")).alias("family"),
                        F.md5(T.scan_mask("html")).alias("mask"))


Q["page_masks"] = page_masks
SQL["page_masks"] = (f"SELECT page_id, md5({S.template_key('html')}) AS template, md5({S.family_key('html')}) AS family, md5({S.scan_mask('html')}) AS mask "
                     "FROM pages")

_words = ["ECONNRESET", "ETIMEDOUT", "ENOENT", "executor", "NullPointerException", "dbConn", "node42", "k8s", "HTTPServer", "oom", "eval", "ERRNO", "abc12de", "cfg7"]
_pick = ", ".join(S.lit(w) for w in _words)
_q("normalize_message",
   lambda: {"norm": T.normalize_message(F.concat(F.element_at(F.array(*[F.lit(w) for w in _words]), (F.col("entry_id") % len(_words) + 1).cast("int")), F.lit(" "), F.col("message")))},
   f"{S.normalize(f'list_extract([{_pick}], CAST(entry_id % {len(_words)} AS INT) + 1) || chr(32) || message')} AS norm")

_stop = "[" + ", ".join(S.lit(w) for w in X.STOPWORDS) + "]"
TOKENS = ("list_filter(regexp_extract_all(lower({0}), '[A-Za-z][A-Za-z0-9]*|\\d+'), "
          "lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^\\d+$') AND NOT list_contains(" + _stop + ", t))")
_q("tokenize_messages", lambda: {"tokens": F.array_join(T.learner_tokens("message"), " ")}, f"array_to_string({TOKENS.format('message')}, ' ') AS tokens")

WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-zA-Z0-9_]{{2,}}'), lambda t: NOT list_contains(" + _stop + ", t))"
TERMS = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_q("tfidf_terms", lambda: {"terms": F.array_join(T.text_terms("message"), "|")},
   "array_to_string(" + TERMS.format(WORDS.format("message")) + ", '|') AS terms")

_hint = "CASE " + " ".join(
    f"WHEN {S.any_word('lower(message)', ws)} THEN {S.lit(v + ' (seen in ')} || CASE WHEN service IN ('', 'unknown') THEN 'the app' ELSE service END || ')'"
    for ws, v in X.CAUSE_HINTS) + " WHEN entry_id % 2 = 0 THEN 'first reason' ELSE level || ' condition in ' || service END"
_q("cause_hint", lambda: {"hint": T.cause_hint("level", "service", "message", F.when(F.col("entry_id") % 2 == 0, F.array(F.lit("first reason"))).otherwise(F.array().cast("array<string>")))},
   f"{_hint} AS hint")
_q("clip_text", lambda: {"clipped": T.clip(F.concat(F.lit("  "), F.repeat("message", 4)))},
   "CASE WHEN length(t) > 300 THEN left(t, 300) || '…' ELSE t END AS clipped")
SQL["clip_text"] = SQL["clip_text"].replace("FROM logs", "FROM (SELECT entry_id, repeat(message, 4) AS t FROM logs)")

# --- time stamps -----------------------------------------------------------

_STAMPS = [
    "ts_raw",
    "CAST(1704067200 + sec AS VARCHAR(20))",
    "CAST(1704067200 + sec AS VARCHAR(20)) || '123'",
    "'at ' || replace(replace(ts_raw, 'T', ' '), 'Z', '') || '.250+02:00 x'",
    "'Feb  ' || (c % 31 + 1) || ' 10:11:12'",
    "'[0' || (c % 9 + 1) || '/Mar/2024:23:' || lpad(CAST(c % 60 AS VARCHAR(20)), 2, '0') || ':05 +0000]'",
    "'2024-1' || (c % 9) || '-0' || (c % 9 + 1) || ' 08:00:' || (10 + c % 80)",
    "'soon'",
]
_tss = "CASE entry_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_STAMPS)) + " END"


def parse_timestamp(spark, sf):
    stamps = C.logs(spark, sf).select("entry_id", F.expr(_tss).alias("t"))
    return stamps.select("entry_id", D.parse_timestamp("t", 2024).alias("epoch"))


Q["parse_timestamp"] = parse_timestamp
_iso = f"regexp_extract(t, {S.lit(X.ISO_PATTERN)}, 0)"
SQL["parse_timestamp"] = f"""WITH {C.LOGS_DUCK}, x AS (SELECT entry_id, {_tss} AS t FROM logs) SELECT entry_id, CASE
  WHEN regexp_matches(t, {S.lit(X.EPOCH_PATTERN)}) THEN CAST(regexp_extract(t, {S.lit(X.EPOCH_PATTERN)}, 1) AS DOUBLE)
     + coalesce(CAST(nullif(regexp_extract(t, {S.lit(X.EPOCH_PATTERN)}, 2), '') AS DOUBLE) / 1000, 0)
  WHEN {_iso} <> '' THEN epoch(TRY_CAST(left(replace({_iso}, 'T', ' '), 19) AS TIMESTAMP))
  WHEN t LIKE 'Feb%' THEN epoch(TRY_CAST('2024-02-' || lpad(split_part(t, ' ', 3), 2, '0') || ' ' || split_part(t, ' ', 4) AS TIMESTAMP))
  WHEN t LIKE '[%' THEN epoch(TRY_CAST('2024-03-' || substr(t, 2, 2) || ' ' || substr(t, 14, 8) AS TIMESTAMP)) END AS epoch FROM x"""

# --- features and vectors --------------------------------------------------


def log_features(spark, sf):
    cols = FE.feature_columns("level", "service", "message")
    return C.logs(spark, sf).select("entry_id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


_f = S.features("level", "service", "message")
FEATURE_ROWS = "SELECT *, " + _f["_norm"] + " AS nrm FROM {0}"
FEATURE_LIST = ", ".join(f"round({v}, 9) AS {k}" for k, v in _f.items() if k != "_norm")
Q["log_features"] = log_features
SQL["log_features"] = f"WITH {C.LOGS_DUCK} SELECT entry_id, {FEATURE_LIST} FROM ({FEATURE_ROWS.replace('{0}', 'logs')})"


def row_normalize(spark, sf):
    e = C.table(spark, sf, "embeddings")
    v = V.row_normalize(F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(V.l2_norm(F.col("embedding").cast("array<double>")), 6).alias("norm"), F.round(F.get(v, F.lit(0)), 6).alias("x0"),
                    F.round(F.get(v, F.lit(63)), 6).alias("x63"))


Q["row_normalize"] = row_normalize
SQL["row_normalize"] = """SELECT vec_id, round(n, 6) AS norm, round(e[1] / n, 6) AS x0, round(e[64] / n, 6) AS x63 FROM (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


def combine_vectors(spark, sf):
    """Sentence vectors joined with a feature block at the weights of the deep mode."""
    e = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    f = C.logs(spark, sf).select("entry_id", FE.feature_vector("level", "service", "message").alias("f"))
    v = V.combine_blocks(F.col("embedding").cast("array<double>"), "f", 0.25)
    return e.join(f, "entry_id").select("entry_id", F.size(v).cast("bigint").alias("dims"), F.round(F.get(v, F.lit(0)), 6).alias("first"),
                                        F.round(F.get(v, F.lit(64)), 6).alias("level_part"), F.round(V.l2_norm(v), 6).alias("norm"))


Q["combine_vectors"] = combine_vectors
_fv = "[" + ", ".join(v for k, v in _f.items() if k != "_norm") + "]"
SQL["combine_vectors"] = f"""WITH {C.LOGS_DUCK}, f AS (SELECT entry_id, {_fv} AS f FROM ({FEATURE_ROWS.replace('{0}', 'logs')})),
j AS (SELECT entry_id, CAST(embedding AS DOUBLE[]) AS e, f FROM f JOIN embeddings ON vec_id = entry_id),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS ne, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS nf FROM j)
SELECT entry_id, CAST(len(e) + len(f) AS BIGINT) AS dims, round(0.75::DOUBLE * e[1] / ne / sqrt(0.625::DOUBLE), 6) AS first,
  round(0.25::DOUBLE * f[1] / nf / sqrt(0.625::DOUBLE), 6) AS level_part, 1.0::DOUBLE AS norm FROM n"""

_q("soft_cap", lambda: {"capped": F.round(V.soft_cap(F.col("value") / 100.0 - 0.2), 9)},
   "round(CASE WHEN x <= 0.8 THEN greatest(0.0::DOUBLE, x) ELSE 0.8::DOUBLE + (1.0::DOUBLE - 0.8::DOUBLE) * (1 - exp(-(x - 0.8::DOUBLE) / 0.6::DOUBLE)) END, 9) AS capped")
SQL["soft_cap"] = SQL["soft_cap"].replace("FROM logs", "FROM (SELECT entry_id, value / 100.0::DOUBLE - 0.2::DOUBLE AS x FROM logs)")


def flag_threshold(spark, sf):
    """Rows that each sensitivity preset flags, for a score made of the event value."""
    score = V.soft_cap(F.col("value") / 100.0)
    marks = F.array(*[F.struct(F.lit(k).alias("sensitivity"), (score >= t).alias("f")) for k, t in THRESHOLDS.items()])
    return (C.logs(spark, sf).select(F.explode(marks).alias("m")).groupBy("m.sensitivity")
            .agg(F.count_if("m.f").alias("flagged"), F.count_if(~F.col("m.f")).alias("normal")))


Q["flag_threshold"] = flag_threshold
SQL["flag_threshold"] = f"""WITH {C.LOGS_DUCK}, s AS (SELECT CASE WHEN x <= 0.8 THEN x ELSE 0.8::DOUBLE + 0.2::DOUBLE * (1 - exp(-(x - 0.8::DOUBLE) / 0.6::DOUBLE)) END AS score
  FROM (SELECT value / 100.0::DOUBLE AS x FROM logs))
SELECT p.sensitivity, count_if(score >= p.t) AS flagged, count_if(score < p.t) AS normal
FROM s, (VALUES ('low', 0.8), ('normal', 0.7), ('high', 0.6)) p(sensitivity, t) GROUP BY p.sensitivity"""


def app_records(spark, sf):
    logs = C.logs(spark, sf)
    r = logs.select("entry_id", "ts_raw", F.when(F.col("level") == "WARN", "Warning").otherwise(F.col("level")).alias("level_name"),
                    F.when(F.col("service") == "unknown", "").otherwise(F.col("service")).alias("logger"), "message", F.col("user_id").alias("pid"))
    return records(r).select("entry_id", "ts_raw", "level", "service", "message", F.try_element_at("metadata", F.lit("pid")).alias("pid"))


Q["app_records"] = app_records
SQL["app_records"] = f"""WITH {C.LOGS_DUCK} SELECT entry_id, ts_raw, CASE level WHEN 'FATAL' THEN 'CRITICAL' ELSE level END AS level, service, message,
  CAST(user_id AS VARCHAR) AS pid FROM logs"""


def stream_immediate(spark, sf):
    """Batch twin of immediate surfacing: severe entries with their fixed score."""
    from siftlog.streaming.live import immediate

    return immediate(C.logs(spark, sf)).select("entry_id", "level", "score", F.array_join("reasons", ";").alias("reasons"))


Q["stream_immediate"] = stream_immediate
SQL["stream_immediate"] = f"""WITH {C.LOGS_DUCK} SELECT entry_id, level, CAST(CASE WHEN level = 'FATAL' THEN 1.0 ELSE 0.95 END AS DOUBLE) AS score,
  level || ' severity — surfaced immediately' AS reasons FROM logs WHERE level IN ('FATAL', 'CRITICAL')"""
