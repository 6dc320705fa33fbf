"""Parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.functions import fixed as X
from siftlog.functions.levels import infer_level, status_level, syslog_level
from siftlog.operators import lines as L, parse as P
from siftlog.sources import labelled, readers, synthetic
from siftlog.runtime import stage

from . import corpus as C
from . import sqltext as S

Q, SQL = {}, {}

LN = S.strip("value")
PROBE = f"regexp_replace({LN}, '^<(\\d{{1,3}})>\\s*', '')"
_chain = " ".join(f"WHEN regexp_matches({PROBE}, {S.lit(p)}) THEN '{n}'" for n, p in X.LINE_PATTERNS.items())
DETECT = (f"CASE WHEN NOT regexp_matches(value, '\\S') THEN 'UNKNOWN' "
          f"WHEN regexp_matches({PROBE}, '^[{{\\[]') AND json_valid({PROBE}) THEN 'JSON' {_chain} ELSE 'PLAINTEXT' END")
DET_DUCK = C.RAW_DUCK + f",\ndet AS (SELECT *, {DETECT} AS fmt, {LN} AS ln FROM raw_lines)"


def _parsed(spark, sf):
    raw = P.with_format(C.raw_lines(spark, sf).select("line_no", "value"))
    return P.parse_lines(raw)


def _formats(*names):
    def run(spark, sf):
        raw = P.with_format(C.raw_lines(spark, sf).select("line_no", "value"))
        meta = F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";"), F.lit(""))
        return (P.parse_lines(raw.filter(F.col("format").isin(*names)))
                .select("line_no", "format", "ts_raw", "level", "service", "message", "parsed", meta.alias("meta")))
    return run


def _groups(fmt, ts, level, service, message, meta="''", subject="ln"):
    def g(x):
        return f"regexp_extract({subject}, {S.lit(X.LINE_PATTERNS[fmt])}, {x})" if isinstance(x, int) else x
    return (f"SELECT line_no, '{fmt}' AS format, {g(ts)} AS ts_raw, {level(g)} AS level, {service(g)} AS service, "
            f"{message(g)} AS message, TRUE AS parsed, {meta if isinstance(meta, str) else meta(g)} AS meta FROM det WHERE fmt = '{fmt}'")


def _sql(*parts):
    return "WITH " + DET_DUCK + "\n" + "\nUNION ALL\n".join(parts)


def _msg(i):
    return lambda g: S.strip(g(i))


def _status(g):
    s = f"CAST({g(5)} AS INT)"
    return f"CASE WHEN {s} IN (503, 504) THEN 'CRITICAL' WHEN {s} >= 500 THEN 'ERROR' WHEN {s} = 404 THEN 'INFO' WHEN {s} >= 400 THEN 'WARN' ELSE 'INFO' END"


def _nl(i):
    return lambda g: S.norm_level(g(i))


_access = [_groups(f, 2, _status, lambda g, f=f: f"'{f.lower()}'", lambda g: f"{g(3)} || ' ' || {g(4)} || ' ' || CAST({g(5)} AS INT)",
                   lambda g: f"'ip=' || {g(1)} || ';status=' || {g(5)}") for f in ("NGINX", "APACHE")]
_hpc = _groups("HPC", 3, lambda g: S.infer_level(g(5)), lambda g: g(4), _msg(5), lambda g: f"'alert_label=' || {g(1)}")
_pri = f"regexp_extract(ln, {S.lit(X.PRI_PATTERN)}, 1)"
_fac = f"lower(regexp_extract(ln, {S.lit('(?i)' + X.FACILITY_PATTERN)}, 1))"
SYSLEVEL = (f"CASE WHEN {_pri} <> '' THEN list_extract([{', '.join(S.lit(x) for x in X.SYSLOG_SEVERITY)}], CAST({_pri} AS INT) % 8 + 1) "
            f"ELSE {S.case_map(_fac, X.FACILITY_SEVERITY, S.lit('INFO'))} END")
_sysprobe = "regexp_replace(ln, '^<(\\d{1,3})>\\s*', '')"
_syslog = _groups("SYSLOG", 1, lambda g: f"CASE WHEN ({SYSLEVEL}) <> 'INFO' THEN ({SYSLEVEL}) ELSE {S.infer_level(g(4))} END",
                  lambda g: f"regexp_replace({g(3)}, ':+$', '')", _msg(4), subject=_sysprobe)
_many = [
    _groups("APP_LOG", 1, _nl(2), lambda g: S.strip(g(4)), _msg(5), lambda g: f"'thread=' || {g(3)}"),
    _groups("ZK_LOG", 1, _nl(2), lambda g: "'zookeeper'", _msg(4), lambda g: f"'thread=' || {g(3)}"),
    _groups("SPARK_LOG", 1, _nl(2), lambda g: S.strip(g(3)), _msg(4), "'thread='"),
    _groups("APACHE_ERR", 1, _nl(2), lambda g: "'apache'", _msg(3)),
    _groups("WINCBS", 1, _nl(2), lambda g: g(3), _msg(4)),
    _groups("HDFS", 1, _nl(4), lambda g: f"regexp_replace({g(5)}, ':+$', '')", _msg(6), lambda g: f"'pid=' || {g(3)}").replace(
        "AS ts_raw", "|| ' ' || regexp_extract(ln, " + S.lit(X.LINE_PATTERNS["HDFS"]) + ", 2) AS ts_raw"),
    _groups("HEALTHAPP", 1, lambda g: S.infer_level(g(4)), lambda g: S.strip(g(2)), _msg(4)),
    _groups("PROXIFIER", 1, lambda g: S.infer_level(g(3)), lambda g: S.strip(g(2)), _msg(3)),
]

Q["parse_standard"] = _formats("STANDARD")
SQL["parse_standard"] = _sql(_groups("STANDARD", 1, lambda g: f"upper({g(2)})", lambda g: g(3), _msg(4)))
Q["parse_plain_iso"] = _formats("PLAIN_ISO")
SQL["parse_plain_iso"] = _sql(_groups("PLAIN_ISO", 1, lambda g: f"upper({g(2)})", lambda g: f"trim({g(3)}, '[]')", _msg(4)))
Q["parse_access_log"] = _formats("NGINX", "APACHE")
SQL["parse_access_log"] = _sql(*_access)
Q["parse_formats"] = _formats("APP_LOG", "ZK_LOG", "SPARK_LOG", "APACHE_ERR", "WINCBS", "HDFS", "HEALTHAPP", "PROXIFIER")
SQL["parse_formats"] = _sql(*_many)
Q["parse_hpc"] = _formats("HPC")
SQL["parse_hpc"] = _sql(_hpc)
Q["parse_syslog"] = _formats("SYSLOG")
SQL["parse_syslog"] = _sql(_syslog)


def detect_format(spark, sf):
    return P.with_format(C.raw_lines(spark, sf)).select("line_no", "format")


Q["detect_format"] = detect_format
SQL["detect_format"] = "WITH " + DET_DUCK + " SELECT line_no, fmt AS format FROM det"


def parse_fallback(spark, sf):
    """Every line under two wrong formats: a JSON error gives INFO, a pattern error a guessed level."""
    raw = C.raw_lines(spark, sf).select("line_no", "value")
    raw = raw.withColumn("format", F.when(F.col("line_no") % 2 == 0, "JSON").otherwise("HEALTHAPP"))
    return P.parse_lines(raw).filter("not parsed").select("line_no", "format", "ts_raw", "level", "service", "message")


Q["parse_fallback"] = parse_fallback
SQL["parse_fallback"] = f"""WITH {C.RAW_DUCK}, x AS (SELECT line_no, {LN} AS ln FROM raw_lines WHERE regexp_matches(value, '\\S'))
SELECT line_no, CASE WHEN line_no % 2 = 0 THEN 'JSON' ELSE 'HEALTHAPP' END AS format, '' AS ts_raw,
  CASE WHEN line_no % 2 = 0 THEN 'INFO' ELSE {S.infer_level('ln')} END AS level, 'unknown' AS service, ln AS message
FROM x WHERE CASE WHEN line_no % 2 = 0 THEN NOT (json_valid(ln) AND ln LIKE '{{%') ELSE NOT regexp_matches(ln, {S.lit(X.LINE_PATTERNS['HEALTHAPP'])}) END"""

_obj = "CASE WHEN ln LIKE '{%' AND json_valid(ln) THEN ln END"


def _js(k):
    return f"json_extract_string(o, '$.{k}')"


def _has(k):
    return f"json_exists(o, '$.{k}')"


PROVIDER = (f"CASE WHEN {_has('eventSource')} OR ({_has('eventName')} AND {_has('awsRegion')}) THEN 'AWS' "
            f"WHEN {_has('logName')} OR {_has('protoPayload')} OR {_has('jsonPayload')} OR (json_type(o, '$.resource') = 'OBJECT' AND {_has('severity')}) THEN 'GCP' "
            f"WHEN {_has('resourceId')} AND ({_has('operationName')} OR {_has('category')}) THEN 'AZURE' "
            f"WHEN {_has('time')} AND {_has('operationName')} THEN 'AZURE' END")
JSON_DUCK = DET_DUCK + f",\njs AS (SELECT line_no, ln, {_obj} AS o FROM det WHERE fmt = 'JSON'),\nobj AS (SELECT *, {PROVIDER} AS provider FROM js WHERE o IS NOT NULL)"


def cloud_provider(spark, sf):
    raw = P.with_format(C.raw_lines(spark, sf)).filter("format = 'JSON'")
    obj = P.json_object("value")
    return raw.filter(obj.isNotNull()).select("line_no", P.cloud_provider("value").alias("provider"))


Q["cloud_provider"] = cloud_provider
SQL["cloud_provider"] = "WITH " + JSON_DUCK + " SELECT line_no, provider FROM obj"


def parse_json(spark, sf):
    raw = P.with_format(C.raw_lines(spark, sf).select("line_no", "value")).filter("format = 'JSON'")
    out = P.parse_lines(raw.filter(F.coalesce(P.cloud_provider("value"), F.lit("")) == ""))
    return out.select("line_no", "ts_raw", "level", "service", "message", "parsed", F.try_element_at("metadata", F.lit("k")).alias("k"))


Q["parse_json"] = parse_json
SQL["parse_json"] = "WITH " + JSON_DUCK + f""" SELECT line_no, coalesce({_js('timestamp')}, {_js('time')}, '') AS ts_raw,
  upper(coalesce({_js('level')}, {_js('severity')}, 'INFO')) AS level, coalesce({_js('service')}, {_js('logger')}, 'unknown') AS service,
  coalesce({_js('message')}, {_js('msg')}, ln) AS message, TRUE AS parsed, {_js('k')} AS k FROM obj WHERE provider IS NULL
UNION ALL SELECT line_no, '', 'INFO', 'unknown', ln, FALSE, NULL FROM js WHERE o IS NULL"""


def parse_cloud(spark, sf):
    raw = P.with_format(C.raw_lines(spark, sf).select("line_no", "value")).filter("format = 'JSON'")
    out = P.parse_lines(raw).filter(F.try_element_at("metadata", F.lit("provider")).isNotNull())
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    return out.select("line_no", "ts_raw", "level", "service", "message", get("provider").alias("provider"),
                      F.coalesce(get("user"), get("project"), get("status")).alias("extra"))


_failed = f"coalesce(nullif({_js('errorCode')}, ''), nullif({_js('errorMessage')}, '')) IS NOT NULL"
Q["parse_cloud"] = parse_cloud
SQL["parse_cloud"] = "WITH " + JSON_DUCK + f"""
SELECT line_no, coalesce({_js('eventTime')}, '') AS ts_raw, CASE WHEN {_failed} THEN 'ERROR' ELSE 'INFO' END AS level,
  split_part(coalesce({_js('eventSource')}, 'aws'), '.', 1) AS service,
  trim({_js('eventName')} || CASE WHEN {_failed} THEN ' [' || coalesce({_js('errorCode')}, '') || '] ' || coalesce({_js('errorMessage')}, '') ELSE '' END) AS message,
  provider, {_js('userIdentity.arn')} AS extra FROM obj WHERE provider = 'AWS'
UNION ALL SELECT line_no, {_js('timestamp')}, {S.case_map(f"upper({_js('severity')})", X.GCP_SEVERITY, "'INFO'")}, {_js('resource.type')},
  {S.strip(f"coalesce({_js('jsonPayload.message')}, {_js('jsonPayload.methodName')}, {_js('logName')})")}, provider, {_js('resource.labels.project_id')} FROM obj WHERE provider = 'GCP'
UNION ALL SELECT line_no, {_js('time')}, {S.case_map(f"lower({_js('level')})", X.AZURE_LEVEL, "'INFO'")}, coalesce({_js('category')}, {_js('resourceId')}),
  {_js('operationName')}, provider, {_js('resultType')} FROM obj WHERE provider = 'AZURE'"""

# --- order-dependent -------------------------------------------------------

BLOCK = 500     # rows per block in the checks, so that several blocks carry over


def _with_positions(spark, sf):
    return C.stream_lines(spark, sf)


def merge_multiline(spark, sf):
    merged = L.merge_multiline(_with_positions(spark, sf), BLOCK)
    text = F.array_join(F.concat(F.array(F.regexp_replace("value", r"^\s+|\s+$", "")), F.col("more")), " | ")
    return merged.select("source", "line_no", text.alias("message"), F.size("more").cast("bigint").alias("continuations"))


_cont = S.lit(X.CONTINUATION_PATTERN)
HEADS_DUCK = C.STREAM_DUCK + f""",
body AS (SELECT *, regexp_matches(value, {_cont}) AS cont FROM stream_lines WHERE regexp_matches(value, '\\S')),
runs AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY line_no) AS run FROM body),
nth AS (SELECT *, sum(CASE WHEN cont THEN 1 ELSE 0 END) OVER (PARTITION BY source, run ORDER BY line_no) AS j FROM runs),
marked AS (SELECT *, NOT cont OR CASE WHEN run = 0 THEN (j - 1) % 201 = 0 ELSE j % 201 = 0 END AS head FROM nth),
tagged AS (SELECT *, max(CASE WHEN head THEN line_no END) OVER (PARTITION BY source ORDER BY line_no) AS head_no FROM marked)"""
Q["merge_multiline"] = merge_multiline
SQL["merge_multiline"] = "WITH " + HEADS_DUCK + f"""
SELECT source, head_no AS line_no, string_agg({LN}, ' | ' ORDER BY line_no) AS message, count(*) - 1 AS continuations FROM tagged GROUP BY source, head_no"""


def sticky_format(spark, sf):
    heads = L.mark_heads(_with_positions(spark, sf), BLOCK).filter("is_head").select("source", "line_no", "value")
    return L.sticky_format(heads, BLOCK).select("source", "line_no", "detected", "format", "switched")


_fm = ["JSON", *X.LINE_PATTERNS]
_rawprobe = "regexp_replace(value, '^<(\\d{1,3})>\\s*', '')"
_set = ", ".join([f"CASE WHEN {LN} LIKE '{{%' THEN 'JSON' END"] + [f"CASE WHEN regexp_matches({_rawprobe}, {S.lit(p)}) THEN '{n}' END" for n, p in X.LINE_PATTERNS.items()])
STICKY_DUCK = HEADS_DUCK.replace("WITH ", "") + f""",
heads AS (SELECT source, line_no, value, {DETECT} AS d, list_filter([{_set}], lambda x: x IS NOT NULL) AS m FROM tagged WHERE head),
seq AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) AS k FROM heads),
walk AS (
  SELECT source, k, line_no, d, CAST(NULL AS VARCHAR) AS s0, CASE WHEN d NOT IN ('PLAINTEXT', 'UNKNOWN') THEN d END AS s FROM seq WHERE k = 1
  UNION ALL
  SELECT q.source, q.k, q.line_no, q.d, w.s, CASE WHEN w.s IS NOT NULL AND list_contains(q.m, w.s) THEN w.s
      WHEN q.d IN ('PLAINTEXT', 'UNKNOWN') THEN w.s ELSE q.d END
  FROM walk w JOIN seq q ON q.source = w.source AND q.k = w.k + 1)"""
Q["sticky_format"] = sticky_format
SQL["sticky_format"] = "WITH RECURSIVE " + STICKY_DUCK + " SELECT source, line_no, d AS detected, coalesce(s, d) AS format, s0 IS NOT NULL AND s <> s0 AS switched FROM walk"


def first_line_format(spark, sf):
    return L.first_line_format(_with_positions(spark, sf))


Q["first_line_format"] = first_line_format
SQL["first_line_format"] = f"""WITH {C.STREAM_DUCK}, f AS (SELECT source, min(line_no) AS line_no, arg_min(value, line_no) AS value FROM stream_lines
  WHERE regexp_matches(value, '\\S') GROUP BY source) SELECT source, line_no, {DETECT} AS format FROM f"""


def parse_stats(spark, sf):
    return L.parse_stats(_with_positions(spark, sf), BLOCK)


_ok = " OR ".join(f"(s.f = '{n}' AND regexp_matches({S.strip('h.value')}, {S.lit(p)}))" for n, p in X.LINE_PATTERNS.items())
Q["parse_stats"] = parse_stats
SQL["parse_stats"] = "WITH RECURSIVE " + STICKY_DUCK + f""",
s AS (SELECT source, line_no, coalesce(s, d) AS f, s0 IS NOT NULL AND s <> s0 AS sw FROM walk),
fb AS (SELECT s.source, count_if(s.sw) AS format_switches, count_if(NOT ({_ok})) AS fallback FROM s JOIN heads h ON h.source = s.source AND h.line_no = s.line_no GROUP BY s.source)
SELECT l.source, l.lines, l.blank, t.continuations, fb.format_switches, fb.fallback
FROM (SELECT source, count(*) AS lines, count_if(NOT regexp_matches(value, '\\S')) AS blank FROM stream_lines GROUP BY source) l
JOIN (SELECT source, count_if(NOT head) AS continuations FROM marked GROUP BY source) t ON t.source = l.source
JOIN fb ON fb.source = l.source"""


def parse_entries(spark, sf):
    """The whole reading path: merge, sticky format, parse, number."""
    merged = L.merge_multiline(_with_positions(spark, sf), BLOCK)
    sticky = L.sticky_format(merged, BLOCK).drop("detected", "switched")
    full = L.append_continuations(P.parse_lines(sticky)).select("source", "line_no", "format", "ts_raw", "level", "service", "message", "parsed")
    # numbering reads its rows several times: they are parsed once
    return L.number_entries(stage(full), BLOCK).select("source", "entry_id", "line_no", "format", "ts_raw", "level", "service", "message", "parsed")


Q["parse_entries"] = parse_entries


def entry_numbers(spark, sf):
    merged = L.merge_multiline(_with_positions(spark, sf), BLOCK).select("source", "line_no")
    return L.number_entries(merged, BLOCK).select("source", "line_no", "entry_id")


Q["entry_numbers"] = entry_numbers
SQL["entry_numbers"] = "WITH " + HEADS_DUCK + " SELECT source, line_no, row_number() OVER (ORDER BY source, line_no) - 1 AS entry_id FROM tagged WHERE head"

# --- scans and labels ------------------------------------------------------


def _text_files(spark, sf):
    """The stream corpus written out as one text file per source."""
    from siftlog.runtime import staging_root
    import uuid

    path = f"{staging_root(spark)}/{spark.sparkContext.applicationId}/text-{uuid.uuid4().hex}"
    lines = C.stream_lines(spark, sf)
    (lines.repartition("source").sortWithinPartitions("source", "line_no").select("source", "value")
     .write.partitionBy("source").text(path))
    return path


def _scanned(spark, sf):
    scanned = readers.scan_text(spark, _text_files(spark, sf))
    return scanned.withColumn("source", F.regexp_extract("source", "source=([^/]+)/", 1))


def scan_text(spark, sf):
    return _scanned(spark, sf).select("source", "value")


Q["scan_text"] = scan_text
SQL["scan_text"] = "WITH " + C.STREAM_DUCK + " SELECT source, value FROM stream_lines"


def line_numbers(spark, sf):
    return readers.number_lines(_scanned(spark, sf))


Q["line_numbers"] = line_numbers
SQL["line_numbers"] = "WITH " + C.STREAM_DUCK + " SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS line_no, value FROM stream_lines"


def scan_limit(spark, sf):
    return readers.limit_lines(readers.number_lines(_scanned(spark, sf)), 100)


Q["scan_limit"] = scan_limit
SQL["scan_limit"] = "SELECT * FROM (" + SQL["line_numbers"] + ") WHERE line_no < 100"


def multi_source_scan(spark, sf):
    """Lines of two systems as one scan: event logs and order records."""
    a = C.logs(spark, sf).select("source", F.col("entry_id").alias("line_no"), "level")
    b = C.table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("line_no"),
                                            infer_level(F.regexp_replace("o_orderpriority", "1-URGENT", "alert")).alias("level"))
    return a.unionByName(b).groupBy("source", "level").agg(F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("last_line"))


Q["multi_source_scan"] = multi_source_scan
SQL["multi_source_scan"] = f"""WITH {C.LOGS_DUCK}, u AS (SELECT source, entry_id AS line_no, level FROM logs UNION ALL
  SELECT 'orders', o_orderkey, {S.infer_level("replace(o_orderpriority, '1-URGENT', 'alert')")} FROM orders)
SELECT source, level, count(*) AS lines, max(line_no) AS last_line FROM u GROUP BY source, level"""


def _labelled(form):
    make = lambda: {"bgl": F.concat(F.when(F.col("level") == "INFO", "-").otherwise("ALERT"), F.lit(" "), F.col("line")),
            "labeled": F.concat((F.col("level") != "INFO").cast("int").cast("string"), F.lit("\t"), F.col("line")),
            "jsonl": F.to_json(F.struct((F.col("level") != "INFO").cast("int").alias("label"), "line"))}

    def run(spark, sf):
        rows = C.logs(spark, sf).select(F.col("entry_id").alias("line_no"), make()[form].alias("value"))
        return labelled.split_labels(rows, form).select("line_no", F.col("label").cast("int"), "line")
    return run


for _form, _name in (("bgl", "load_bgl_labels"), ("labeled", "load_tab_labels"), ("jsonl", "load_jsonl_labels")):
    Q[_name] = _labelled(_form)
    SQL[_name] = f"WITH {C.LOGS_DUCK} SELECT entry_id AS line_no, CASE WHEN level = 'INFO' THEN 0 ELSE 1 END AS label, line FROM logs"


def first_token_labels(spark, sf):
    rows = C.raw_lines(spark, sf).select("line_no", "value")
    return labelled.first_token_labels(rows).select("line_no", "label")


Q["first_token_labels"] = first_token_labels
SQL["first_token_labels"] = f"WITH {C.RAW_DUCK} SELECT line_no, CASE WHEN NOT regexp_matches(value, '\\S') OR split_part(value, ' ', 1) = '-' THEN 0 ELSE 1 END AS label FROM raw_lines"


def load_jsonl_entries(spark, sf):
    logs = C.logs(spark, sf)
    value = F.when(F.col("entry_id") % 5 == 0, F.to_json(F.struct("message"))).otherwise(F.to_json(F.struct(
        F.col("ts_raw").alias("timestamp"), "level", "service", "message", (F.col("level") == "ERROR").cast("int").alias("label"))))
    rows = logs.select(F.col("entry_id").alias("line_no"), value.alias("value"))
    return labelled.jsonl_entries(rows).drop("raw")


Q["load_jsonl_entries"] = load_jsonl_entries
SQL["load_jsonl_entries"] = f"""WITH {C.LOGS_DUCK} SELECT entry_id AS line_no, CASE WHEN entry_id % 5 = 0 THEN '' ELSE ts_raw END AS ts_raw,
  CASE WHEN entry_id % 5 = 0 THEN 'INFO' ELSE level END AS level, CASE WHEN entry_id % 5 = 0 THEN 'unknown' ELSE service END AS service,
  message, CASE WHEN entry_id % 5 <> 0 AND level = 'ERROR' THEN 1 ELSE 0 END AS label FROM logs"""


def join_label_sidecar(spark, sf):
    logs = C.logs(spark, sf).select("source", F.col("entry_id").alias("line_no"), "level")
    side = C.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), (F.col("event_type") == "error").cast("int").alias("label"))
    return labelled.join_sidecar(logs, side.filter("line_no % 9 <> 0"), ["line_no"])


Q["join_label_sidecar"] = join_label_sidecar
SQL["join_label_sidecar"] = f"WITH {C.LOGS_DUCK} SELECT l.source, l.entry_id AS line_no, l.level, CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS label FROM logs l JOIN events e ON e.event_id = l.entry_id WHERE e.event_id % 9 <> 0"


def load_labelled(spark, sf):
    """Labelled lines parsed under the first line's format of each source."""
    rows = C.logs(spark, sf).select("source", F.col("entry_id").alias("line_no"),
                                    F.concat(F.when(F.col("level") == "INFO", "-").otherwise("ALERT"), F.lit(" "), F.col("line")).alias("value"))
    return labelled.load_labelled(rows).select("source", "line_no", "label", "format", "level", "service", "message", "parsed")


Q["load_labelled"] = load_labelled
SQL["load_labelled"] = f"WITH {C.LOGS_DUCK} SELECT source, entry_id AS line_no, CASE WHEN level = 'INFO' THEN 0 ELSE 1 END AS label, 'STANDARD' AS format, level, service, message, TRUE AS parsed FROM logs"


def generate_logs(spark, sf):
    events = C.table(spark, sf, "events")
    return synthetic.generate_from(events.select(F.col("event_id").alias("id")), events.count())


Q["generate_logs"] = generate_logs
