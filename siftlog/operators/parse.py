"""Line → entry: format detection and one projection for all formats.

Each line is matched once.  The groups of the matching pattern are rewritten
into one separator-joined string, so that six output fields cost one regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X
from ..functions.base import col, extract, is_ascii, is_blank, literal_map, matches, pattern, strip
from ..functions.levels import infer_level, norm_level, status_level, syslog_level
from ..functions.text import fixed_point
from ..runtime import evaluate_once

SEP = "\x01"
ESCAPE = "\x02"               # stands before a sign of a line that itself holds the separator
FORMATS = ["JSON", *X.LINE_PATTERNS]

# ts | level token | service | message | first extra | second extra, as group references
FIELDS = {
    "NGINX": ("$2", "", "nginx", "$3 $4 ", "$1", "$5"),
    "APACHE": ("$2", "", "apache", "$3 $4 ", "$1", "$5"),
    "APP_LOG": ("$1", "$2", "$4", "$5", "$3", ""),
    "ZK_LOG": ("$1", "$2", "zookeeper", "$4", "$3", ""),
    "SPARK_LOG": ("$1", "$2", "$3", "$4", "", ""),
    "APACHE_ERR": ("$1", "$2", "apache", "$3", "", ""),
    "WINCBS": ("$1", "$2", "$3", "$4", "", ""),
    "HDFS": ("$1 $2", "$4", "$5", "$6", "$3", ""),
    "HPC": ("$3", "", "$4", "$5", "$1", ""),
    "HEALTHAPP": ("$1", "", "$2", "$4", "", ""),
    "PROXIFIER": ("$1", "", "$2", "$3", "", ""),
    "SYSLOG": ("$1", "", "$3", "$4", "", ""),
    "STANDARD": ("$1", "$2", "$3", "$4", "", ""),
    "PLAIN_ISO": ("$1", "$2", "$3", "$4", "", ""),
}
RESULT = ["ts_raw", "level", "service", "message", "parsed", "metadata"]
METADATA_KEYS = {
    "NGINX": ("ip", "status"), "APACHE": ("ip", "status"),
    "APP_LOG": ("thread",), "ZK_LOG": ("thread",), "SPARK_LOG": ("thread",),
    "HDFS": ("pid",), "HPC": ("alert_label",),
}


def without_pri(line: Column) -> Column:
    return F.when(line.startswith("<"), F.regexp_replace(line, pattern(X.PRI_PATTERN), "")).otherwise(line)


def json_is_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def with_format(df: DataFrame, line: str = "value", name: str = "format") -> DataFrame:
    """Add the detected format of each line, worked out once."""
    df = evaluate_once(df, _ln=strip(line))
    df = evaluate_once(df, _probe=without_pri(F.col("_ln")))
    return evaluate_once(df, **{name: detect_format("_ln", F.col("_probe"))}).drop("_ln", "_probe")


def detect_format(line, probe: Column | None = None) -> Column:
    """First format, in the fixed order, whose pattern matches at the start of the line.

    ``probe`` is the stripped line without <PRI>, for callers that have it as a column.
    """
    if probe is None:
        line = strip(line)
        probe = without_pri(line)
    line = col(line)

    def chain(unicode: bool) -> Column:
        out = F.when((probe.startswith("{") | probe.startswith("[")) & json_is_valid(probe), F.lit("JSON"))
        for name, text in X.LINE_PATTERNS.items():
            out = out.when(probe.rlike(pattern(text, unicode=unicode)), name)
        return out.otherwise("PLAINTEXT")

    return F.when(is_blank(line), "UNKNOWN").when(is_ascii(line), chain(False)).otherwise(chain(True))


def matching_formats(line) -> Column:
    """Bit set of all formats a line satisfies, bit i for FORMATS[i]; JSON by its first brace."""
    line = col(line)
    probe = without_pri(line)
    bits = F.when(strip(line).startswith("{"), F.lit(1)).otherwise(F.lit(0))
    for i, name in enumerate(X.LINE_PATTERNS, start=1):
        bits = bits + F.when(matches(probe, X.LINE_PATTERNS[name]), F.lit(1 << i)).otherwise(F.lit(0))
    return bits.cast("int")


def _py_get(m: Column, keys: list[str], default: Column) -> Column:
    """First key that is present; an explicit JSON null reads as the text None."""
    out = None
    for k in keys:
        value = F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("None"))
        test = F.map_contains_key(m, k)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def json_object(line) -> Column:
    """Top-level keys of a JSON object as text, NULL when the line is not an object."""
    line = strip(line)
    return F.when(line.startswith("{") & json_is_valid(line), F.from_json(line, "map<string,string>"))


def cloud_provider(line, keys: Column | None = None) -> Column:
    line = strip(line)
    m = json_object(line) if keys is None else keys

    def has(k: str) -> Column:
        return F.map_contains_key(m, k)

    resource_object = F.get_json_object(line, "$.resource").startswith("{")
    return (F.when(m.isNull(), F.lit(None).cast("string"))
            .when(has("eventSource") | (has("eventName") & has("awsRegion")), "AWS")
            .when(has("logName") | has("protoPayload") | has("jsonPayload")
                  | (F.coalesce(resource_object, F.lit(False)) & has("severity")), "GCP")
            .when(has("resourceId") & (has("operationName") | has("category")), "AZURE")
            .when(has("time") & has("operationName"), "AZURE"))


def _json_fields(line: Column, m: Column, provider: Column) -> dict[str, Column]:
    """ts, level, service, message and metadata of JSON lines, cloud mappings first."""
    def get(k: str) -> Column:
        return F.try_element_at(m, F.lit(k))

    def full(k: str) -> Column:
        return F.nullif(get(k), F.lit(""))

    def dig(path: str) -> Column:
        return F.get_json_object(line, "$." + path)

    # AWS
    failed = full("errorCode").isNotNull() | full("errorMessage").isNotNull()
    aws_message = F.when(failed, F.concat(
        _py_get(m, ["eventName"], F.lit("")), F.lit(" ["), F.coalesce(full("errorCode"), F.lit("")),
        F.lit("] "), F.coalesce(full("errorMessage"), F.lit("")))).otherwise(_py_get(m, ["eventName"], F.lit("")))
    aws_service = F.nullif(F.substring_index(_py_get(m, ["eventSource"], F.lit("aws")), ".", 1), F.lit(""))
    # GCP
    payload = F.when(F.get_json_object(line, "$.jsonPayload").isNotNull()
                     & ~F.get_json_object(line, "$.jsonPayload").isin("", "{}"), F.lit("jsonPayload")).otherwise("protoPayload")

    def in_payload(k: str) -> Column:
        return F.nullif(F.when(payload == "jsonPayload", dig(f"jsonPayload.{k}")).otherwise(dig(f"protoPayload.{k}")), F.lit(""))

    gcp_message = F.coalesce(full("textPayload"), in_payload("message"), in_payload("methodName"),
                             get("logName"), F.lit(""))
    gcp_level = F.coalesce(F.try_element_at(literal_map(X.GCP_SEVERITY),
                                            F.upper(_py_get(m, ["severity"], F.lit("DEFAULT")))), F.lit("INFO"))
    # Azure
    az_level = F.coalesce(F.try_element_at(literal_map(X.AZURE_LEVEL),
                                           F.lower(_py_get(m, ["level"], F.lit("")))), F.lit("INFO"))
    plain_keys = ["timestamp", "time", "level", "severity", "service", "logger", "message", "msg"]

    def pick(aws: Column, gcp: Column, azure: Column, plain: Column) -> Column:
        return F.when(provider == "AWS", aws).when(provider == "GCP", gcp).when(provider == "AZURE", azure).otherwise(plain)

    text = F.lit(None).cast("string")
    return {
        "ts_raw": pick(_py_get(m, ["eventTime"], F.lit("")), _py_get(m, ["timestamp"], F.lit("")),
                       _py_get(m, ["time"], F.lit("")), _py_get(m, ["timestamp", "time"], F.lit(""))),
        "level": pick(F.when(failed, F.lit("ERROR")).otherwise("INFO"), gcp_level, az_level,
                      F.upper(_py_get(m, ["level", "severity"], F.lit("INFO")))),
        "service": pick(F.coalesce(aws_service, F.lit("aws")),
                        F.coalesce(F.nullif(dig("resource.type"), F.lit("")), F.lit("gcp")),
                        F.coalesce(full("category"), full("resourceId"), F.lit("azure")),
                        _py_get(m, ["service", "logger"], F.lit("unknown"))),
        "message": pick(strip(aws_message), strip(gcp_message),
                        strip(F.coalesce(full("operationName"), F.nullif(dig("properties.statusMessage"), F.lit("")), F.lit(""))),
                        _py_get(m, ["message", "msg"], line)),
        "metadata": pick(
            F.create_map(F.lit("provider"), F.lit("AWS"), F.lit("region"), get("awsRegion"),
                         F.lit("source_ip"), get("sourceIPAddress"), F.lit("event_source"), get("eventSource"),
                         F.lit("user"), dig("userIdentity.arn")),
            F.create_map(F.lit("provider"), F.lit("GCP"), F.lit("log_name"), get("logName"),
                         F.lit("project"), dig("resource.labels.project_id")),
            F.create_map(F.lit("provider"), F.lit("AZURE"), F.lit("resource_id"), get("resourceId"),
                         F.lit("status"), F.coalesce(full("resultType"), dig("properties.status"), text)),
            F.map_filter(m, lambda k, _: ~k.isin(*plain_keys))),
    }


def _split_groups(line: Column, probe: Column, fmt: Column) -> Column:
    """[ts, level, service, message, extra, extra] of the line under its format, NULL if it does not match."""
    def chain(unicode: bool) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("array<string>"))
        for name, text in X.LINE_PATTERNS.items():
            subject = _guarded(probe if name == "SYSLOG" else line)
            full = pattern(text + r"[\s\S]*$", unicode=unicode)
            swapped = F.regexp_replace(subject, full, SEP.join(FIELDS[name]) + SEP + "x")
            out = out.when(fmt == name, F.when(swapped != subject, F.split(swapped, SEP)))
        return out

    parts = F.when(is_ascii(line), chain(False)).otherwise(chain(True))
    return F.when(line.contains(SEP), F.transform(parts, _unguarded)).otherwise(parts)


def _guarded(line: Column) -> Column:
    """A line that holds the separator has it, and the escape itself, written as two other control signs."""
    plain = F.replace(F.replace(line, F.lit(ESCAPE), F.lit(ESCAPE + "\x04")), F.lit(SEP), F.lit(ESCAPE + "\x03"))
    return F.when(line.contains(SEP), plain).otherwise(line)


def _unguarded(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit(ESCAPE + "\x03"), F.lit(SEP)), F.lit(ESCAPE + "\x04"), F.lit(ESCAPE))


def parse_lines(df: DataFrame, line: str = "value", fmt: str = "format") -> DataFrame:
    """Entries of the lines in ``line`` under the format named in column ``fmt``.

    Blank lines give no entry.  A line that does not fit its format becomes an
    unparsed entry; its level is guessed from the text, except after a JSON
    error, where it is INFO.
    """
    columns = df.columns
    df = evaluate_once(df.filter(~is_blank(line)), _line=strip(line))
    df = evaluate_once(df, _obj=F.when(F.col(fmt) == "JSON", json_object("_line")),
                       _parts=_split_groups(F.col("_line"), without_pri(F.col("_line")), F.col(fmt)))
    df = evaluate_once(df, _cloud=F.when(F.col("_obj").isNotNull(), cloud_provider("_line", F.col("_obj"))))
    line_c, f = F.col("_line"), F.col(fmt)

    def part(i: int) -> Column:
        return F.get("_parts", F.lit(i))

    ok_json, ok_text = F.col("_obj").isNotNull(), F.col("_parts").isNotNull()
    json_f = _json_fields(line_c, F.col("_obj"), F.col("_cloud"))
    access = f.isin("NGINX", "APACHE")
    message = F.when(access, F.concat(part(3), F.coalesce(part(5).try_cast("decimal(38,0)").cast("string"), part(5)))).otherwise(strip(part(3)))
    syslog = syslog_level(line_c)
    level = (F.when(access, status_level(part(5)))
             .when(f.isin("STANDARD", "PLAIN_ISO"), F.upper(part(1)))
             .when(f == "SYSLOG", F.when(syslog != "INFO", syslog).otherwise(infer_level(part(3))))
             .when(f.isin("HPC", "HEALTHAPP", "PROXIFIER"), infer_level(part(3)))
             .otherwise(norm_level(part(1))))
    service = (F.when(f.isin("HDFS", "SYSLOG"), F.regexp_replace(part(2), ":+$", ""))
               .when(f == "PLAIN_ISO", F.regexp_replace(part(2), r"^[\[\]]+|[\[\]]+$", ""))
               .when(f.isin("APP_LOG", "SPARK_LOG"), F.coalesce(F.nullif(strip(part(2)), F.lit("")), F.lit("zookeeper")))
               .when(f.isin("HEALTHAPP", "PROXIFIER"), strip(part(2)))
               .otherwise(part(2)))
    meta = F.when(F.lit(False), F.create_map().cast("map<string,string>"))
    for name, keys in METADATA_KEYS.items():
        pairs = []
        for i, k in enumerate(keys):
            pairs += [F.lit(k), part(4 + i)]
        meta = meta.when(f == name, F.create_map(*pairs))
    meta = meta.otherwise(F.create_map().cast("map<string,string>"))
    fallback_level = F.when(f == "JSON", F.lit("INFO")).otherwise(infer_level(line_c))
    empty = F.create_map().cast("map<string,string>")

    def choose(name: str, text: Column, otherwise: Column) -> Column:
        return F.when(ok_json, json_f[name]).when(ok_text, text).otherwise(otherwise)

    keep = [c for c in columns if c not in (line, fmt)]
    out = evaluate_once(
        df,
        **dict(zip(RESULT, [
            choose("ts_raw", part(0), F.lit("")),
            choose("level", level, fallback_level),
            choose("service", service, F.lit("unknown")),
            choose("message", message, line_c),
            ok_json | ok_text,
            F.when(ok_json, json_f["metadata"]).when(ok_text, meta).otherwise(empty)])))
    return out.select(*keep, f.alias("format"), "ts_raw", "level", "service", "message", line_c.alias("raw"), "parsed", "metadata")


def render_entry(level, service, score, message, reasons) -> Column:
    """``[LEVEL] service (score s) message  [reasons]``."""
    service, reasons = col(service), col(reasons)
    svc = F.when(service.isin("", "unknown"), F.lit("")).otherwise(F.concat(F.lit(" "), service))
    why = F.when(F.size(reasons) > 0, F.concat(F.lit("  ["), F.array_join(reasons, "; "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), col(level), F.lit("]"), svc,
                    F.lit(" (score "), fixed_point(score, 2), F.lit(") "), col(message), why)
