"""Log corpora built from the given tables, in Spark SQL and in DuckDB SQL.

Every event becomes one log line, so the work grows with the table.  The same
text builds both versions; only date arithmetic and integer division differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlog.runtime import stage

MODULES = ("billing,search,checkout,catalog,profile,session,gateway,ledger,mailer,notifier,"
           "indexer,scheduler,uploader,renderer,exporter,importer,recommender,inventory,shipping,pricing")

_FORMATS = {   # Spark pattern, DuckDB pattern
    "iso": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    "space": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    "access": ("dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S"),
    "syslog": ("MMM dd HH:mm:ss", "%b %d %H:%M:%S"),
    "spark": ("yy/MM/dd HH:mm:ss", "%y/%m/%d %H:%M:%S"),
    "httpd": ("EEE MMM dd HH:mm:ss yyyy", "%a %b %d %H:%M:%S %Y"),
    "hdfs": ("yyMMdd HHmmss", "%y%m%d %H%M%S"),
    "bgl": ("yyyy.MM.dd", "%Y.%m.%d"),
    "health": ("yyyyMMdd-HH:mm:ss", "%Y%m%d-%H:%M:%S"),
    "proxy": ("MM.dd HH:mm:ss", "%m.%d %H:%M:%S"),
}


class _Spark:
    def ts(self, name: str) -> str:
        text = _FORMATS[name][0].replace("'", "''")
        return f"date_format(timestampadd(SECOND, cast(sec as int), TIMESTAMP_NTZ'2024-01-01 00:00:00'), '{text}')"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})"


class _Duck:
    def ts(self, name: str) -> str:
        return f"strftime(TIMESTAMP '2024-01-01 00:00:00' + sec * INTERVAL 1 SECOND, '{_FORMATS[name][1]}')"

    def div(self, a: str, b: int) -> str:
        return f"({a} // {b})"


def _logs_sql(e) -> str:
    mod = f"split_part('{MODULES}', ',', cast(user_id % 20 as int) + 1)"
    seconds = f"CASE WHEN event_id % 1000 < 60 THEN {e.div('event_id', 1000)} * 26000 + event_id % 50 ELSE event_id * 26 END"
    return f"""
    SELECT entry_id, event_id, user_id, event_type, value, c, sec, module, ts_raw, level, service, message, source,
           ts_raw || ' ' || level || ' [' || service || '] ' || message AS line
    FROM (
      SELECT event_id AS entry_id, event_id, user_id, event_type, value, c, sec, module,
        {e.ts('iso')} || 'Z' AS ts_raw,
        CASE WHEN event_type = 'error' AND value > 220 THEN 'FATAL'
             WHEN event_type = 'error' AND value > 100 THEN 'CRITICAL'
             WHEN event_type = 'error' THEN 'ERROR'
             WHEN event_type = 'purchase' AND value > 100 THEN 'WARN'
             WHEN event_type = 'signup' AND user_id % 11 = 0 THEN 'NOTICE'
             WHEN event_type = 'view' AND value > 180 THEN 'DEBUG'
             ELSE 'INFO' END AS level,
        CASE WHEN user_id % 13 = 0 THEN 'unknown' ELSE 'svc-' || (user_id % 7) END AS service,
        CASE WHEN user_id % 3 = 0 THEN 'src0' ELSE 'src' || (user_id % 5) END AS source,
        CASE
          WHEN event_type = 'error' AND event_id % 397 = 0 THEN 'kernel panic on node n' || (user_id % 64) || ': unrecoverable state in ' || module || ', machine halted'
          WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Connection refused to ' || module || '-db at 10.0.' || (user_id % 250) || '.' || (event_id % 250) || ':5432 after ' || c || 'ms'
          WHEN event_type = 'error' AND event_id % 5 = 1 THEN 'Request timeout in ' || module || ': upstream did not answer within ' || (c % 60) || ' seconds (attempt ' || (event_id % 3) || ' of 3)'
          WHEN event_type = 'error' AND event_id % 5 = 2 THEN 'Failed to write block 0x' || lpad(cast(event_id as varchar(20)), 8, '0') || ' for ' || module || ': no space left on device'
          WHEN event_type = 'error' AND event_id % 5 = 3 THEN 'OutOfMemoryError in ' || module || ': heap usage ' || (c % 100) || '% of 2048 MB'
          WHEN event_type = 'error' THEN 'GET /api/v1/' || module || '/' || event_id || ' "trace-' || user_id || '" failed with status ' || (500 + event_id % 5)
          WHEN event_type = 'purchase' AND value > 100 AND event_id % 2 = 0 THEN 'Slow payment for order ' || event_id || ': ' || c || ' ms, retry queued for ' || module
          WHEN event_type = 'purchase' AND value > 100 THEN 'Disk usage on ' || module || ' at ' || (c % 100) || '%: message repeated ' || (c % 150) || ' times'
          WHEN event_type = 'purchase' THEN 'order ' || event_id || ' paid by user ' || user_id || ' amount ' || c || ' cents via ' || module
          WHEN event_type = 'signup' THEN 'user ' || lpad(cast(event_id as varchar(20)), 8, '0') || '-12ab-4abc-8def-' || lpad(cast(user_id as varchar(20)), 12, '0') || ' signed up from 192.168.' || (user_id % 200) || '.' || (event_id % 200)
          WHEN event_type = 'view' THEN 'page ' || module || ' viewed in ' || (c % 900) || 'ms, HTTP/1.1 ' || (200 + c % 205) || ' by client 0x' || lpad(cast(user_id as varchar(20)), 6, '0')
          ELSE 'click on ' || chr(39) || 'button ' || (c % 9) || chr(39) || ' in ' || module || ' at 2024-01-01T10:00:' || lpad(cast(c % 60 as varchar(20)), 2, '0') || ' took 0.' || (c % 10) || ' s'
        END AS message
      FROM (SELECT event_id, user_id, event_type, value, cast(round(value * 100) as bigint) AS c, {seconds} AS sec, {mod} AS module FROM events)
    )"""


def _json_text(x: str) -> str:
    return f"replace({x}, chr(34), chr(92) || chr(34))"


def _raw_sql(e) -> str:
    """One line per event, cycling through all formats, blank and broken lines."""
    q = "chr(34)"
    msg = _json_text("message")

    def obj(pairs: list[tuple[str, str]]) -> str:
        body = " || ', ' || ".join(f"{q} || '{k}' || {q} || ': ' || {v}" for k, v in pairs)
        return "'{' || " + body + " || '}'"

    def s(x: str) -> str:
        return f"{q} || {x} || {q}"

    aws = obj([("eventTime", s("ts_raw")), ("eventSource", s("module || '.amazonaws.com'")), ("eventName", s("'Get' || module")),
               ("awsRegion", s("'eu-west-' || (c % 3)")), ("sourceIPAddress", s("'10.1.2.' || (c % 250)")),
               ("userIdentity", "'{' || " + f"{q} || 'arn' || {q} || ': ' || " + s("'arn:aws:iam::' || user_id") + " || '}'"),
               ("errorCode", s("CASE WHEN c % 2 = 0 THEN 'AccessDenied' ELSE '' END"))])
    gcp = obj([("timestamp", s("ts_raw")), ("severity", s("CASE WHEN c % 3 = 0 THEN 'warning' WHEN c % 3 = 1 THEN 'ALERT' ELSE 'odd' END")),
               ("logName", s("'projects/p/logs/' || module")),
               ("resource", "'{' || " + f"{q} || 'type' || {q} || ': ' || " + s("'gce_' || module") + f" || ', ' || {q} || 'labels' || {q} || ': {{' || "
                + f"{q} || 'project_id' || {q} || ': ' || " + s("'proj-' || user_id") + " || '}}'"),
               ("jsonPayload", "'{' || " + f"{q} || (CASE WHEN c % 2 = 0 THEN 'message' ELSE 'methodName' END) || {q} || ': ' || " + s(msg) + " || '}'")])
    azure = obj([("time", s("ts_raw")), ("resourceId", s("'/subscriptions/' || user_id")), ("operationName", s("'Op ' || module")),
                 ("level", s("CASE WHEN c % 3 = 0 THEN 'Warning' WHEN c % 3 = 1 THEN 'Critical' ELSE 'Verbose' END")),
                 ("resultType", s("'code-' || (c % 4)"))])
    plain = obj([("timestamp", s("ts_raw")), ("level", s("lower(level)")), ("service", s("service")), ("message", s(msg)), ("k", "(c % 100)")])
    other = obj([("time", s("ts_raw")), ("severity", s("level")), ("logger", s("module")), ("msg", s(msg))])
    return f"""
    SELECT entry_id, source, event_id AS line_no, c, level AS true_level, message AS true_message, CASE event_id % 20
      WHEN 0 THEN line
      WHEN 1 THEN ts_raw || ' ' || lower(level) || ' ' || service || ' ' || message
      WHEN 2 THEN '10.0.0.' || (c % 250) || ' - - [' || {e.ts('access')} || ' +0000] "GET /' || module || '/' || event_id || ' HTTP/1.1" ' || (200 + c % 305) || ' ' || c
      WHEN 3 THEN '10.0.1.' || (c % 250) || ' - u' || user_id || ' [' || {e.ts('access')} || ' +0000] "POST /' || module || ' HTTP/1.1" ' || (200 + c % 305) || ' ' || c
      WHEN 4 THEN {e.ts('space')} || ',' || (100 + c % 900) || ' ' || level || ' [main-' || (c % 9) || '] org.app.' || module || ': ' || message
      WHEN 5 THEN {e.ts('space')} || ',' || (100 + c % 900) || ' - ' || level || '  [Thread-' || (c % 9) || ':Q@' || (c % 99) || '] - ' || message
      WHEN 6 THEN {e.ts('spark')} || ' ' || level || ' storage.' || module || ': ' || message
      WHEN 7 THEN '[' || {e.ts('httpd')} || '] [' || lower(level) || '] ' || message
      WHEN 8 THEN {e.ts('space')} || ', ' || level || '                  CBS    ' || message
      WHEN 9 THEN {e.ts('hdfs')} || ' ' || (c % 999) || ' ' || level || ' dfs.' || module || '$Worker: ' || message
      WHEN 10 THEN CASE WHEN c % 2 = 0 THEN '-' ELSE 'KERNDTLB' END || ' ' || (1117838570 + event_id) || ' ' || {e.ts('bgl')} || ' R02-M1-N' || (c % 16) || ' ' || message
      WHEN 11 THEN {e.ts('health')} || ':' || (c % 999) || '|' || module || '|' || (30000000 + user_id) || '|' || message
      WHEN 12 THEN '[' || {e.ts('proxy')} || '] ' || module || '.exe *64 - ' || message
      WHEN 13 THEN CASE WHEN c % 3 = 0 THEN '<' || (c % 192) || '>' ELSE '' END || {e.ts('syslog')} || ' host' || (user_id % 8) || ' ' || module || '[' || (c % 9999) || ']: '
                   || CASE WHEN c % 3 = 1 THEN 'daemon.crit ' ELSE '' END || message
      WHEN 14 THEN {plain}
      WHEN 15 THEN {aws}
      WHEN 16 THEN {gcp}
      WHEN 17 THEN {azure}
      WHEN 18 THEN CASE WHEN c % 2 = 0 THEN 'note: ' || message ELSE {other} END
      ELSE CASE c % 4 WHEN 0 THEN '   ' WHEN 1 THEN '{{broken ' || message WHEN 2 THEN '[1, 2, ' || c || ']' ELSE '  ' || module || ' idle' END
      END AS value
    FROM logs"""


def _stream_sql(e) -> str:
    """Ordered lines per source with stack traces, blank lines and two overlapping formats."""
    return f"""
    SELECT source, event_id AS line_no, CASE
      WHEN event_id % 41 = 0 THEN '  '
      WHEN event_id % 11 IN (3, 4, 5) THEN '    at com.example.' || module || '.Handler.run(Handler.java:' || (c % 400) || ')'
      WHEN event_id % 11 = 6 THEN 'Caused by: java.io.IOException: ' || module
      WHEN event_id % 11 = 7 THEN '... ' || (c % 30) || ' more'
      WHEN event_id % 10 IN (0, 1, 8) THEN line
      WHEN event_id % 10 = 2 THEN ts_raw || ' ' || level || ' ' || service || ' ' || message
      WHEN event_id % 10 = 3 THEN '10.0.0.' || (c % 250) || ' - - [' || {e.ts('access')} || ' +0000] "GET /' || module || ' HTTP/1.1" ' || (200 + c % 305) || ' ' || c
      WHEN event_id % 10 = 4 THEN '10.0.1.' || (c % 250) || ' - u' || user_id || ' [' || {e.ts('access')} || ' +0000] "POST /' || module || ' HTTP/1.1" ' || (200 + c % 305) || ' ' || c
      WHEN event_id % 10 = 5 THEN {e.ts('hdfs')} || ' ' || (c % 999) || ' ' || level || ' dfs.' || module || ': ' || message
      WHEN event_id % 10 = 6 THEN {e.ts('syslog')} || ' host' || (user_id % 8) || ' ' || module || ': ' || message
      ELSE 'idle ' || module END AS value
    FROM logs"""


LOGS_DUCK = f"logs AS ({_logs_sql(_Duck())})"
RAW_DUCK = LOGS_DUCK + f",\nraw_lines AS ({_raw_sql(_Duck())})"
STREAM_DUCK = LOGS_DUCK + f",\nstream_lines AS ({_stream_sql(_Duck())})"


_staged: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Text corpora are written once per application, as a log store would hold them."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = stage(build().repartition(spark.sparkContext.defaultParallelism))
    return _staged[key]


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Typed log entries: entry_id, ts_raw, level, service, message, source, line and the event columns."""
    return _once(spark, sf, "logs", lambda: spark.sql(_bind(_logs_sql(_Spark()), "events"), events=table(spark, sf, "events")))


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "raw_lines", lambda: spark.sql(_bind(_raw_sql(_Spark()), "logs"), logs=logs(spark, sf)))


def stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "stream_lines", lambda: spark.sql(_bind(_stream_sql(_Spark()), "logs"), logs=logs(spark, sf)))


def _bind(sql: str, name: str) -> str:
    """Name a DataFrame parameter; other braces of the text are escaped for the formatter."""
    return sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return logs(spark, sf).select("source", "entry_id", "ts_raw", "level", "service", "message")
