"""Fixed values.

Everything here is a value that decides results: word lists, level tables,
line patterns, masks and numeric constants.  They are stated once, as plain
text, and used by the Column helpers of this package.  Patterns are written
for Java regex; ``FLAGS`` adds Unicode classes and plain-newline rules.
"""

FLAGS = "(?dU)"
FLAGS_I = "(?diuU)"

# --- level tables ----------------------------------------------------------

SEVERITY = {
    "EMERGENCY": 0, "EMERG": 0, "PANIC": 0,
    "ALERT": 1, "FATAL": 1,
    "CRITICAL": 2, "CRIT": 2,
    "ERROR": 3, "ERR": 3,
    "WARN": 4, "WARNING": 4,
    "NOTICE": 5,
    "INFO": 6,
    "DEBUG": 7, "TRACE": 7,
}
DEFAULT_SEVERITY = 6

SEVERITY_BASE = {0: 1.0, 1: 1.0, 2: 0.70, 3: 0.55, 4: 0.42, 5: 0.08, 6: 0.0, 7: 0.0}

FEATURE_LEVEL_WEIGHT = {
    "EMERGENCY": 1.0, "EMERG": 1.0, "PANIC": 1.0,
    "ALERT": 0.95, "FATAL": 0.95,
    "CRITICAL": 0.9, "CRIT": 0.9,
    "ERROR": 0.75, "ERR": 0.75,
    "WARN": 0.5, "WARNING": 0.5,
    "NOTICE": 0.3, "INFO": 0.15, "DEBUG": 0.05, "TRACE": 0.0,
}
DEFAULT_FEATURE_LEVEL_WEIGHT = 0.15

DISPLAY_SEVERITY = {
    "EMERGENCY": 7, "EMERG": 7, "PANIC": 7, "ALERT": 6, "FATAL": 6,
    "CRITICAL": 5, "CRIT": 5, "ERROR": 4, "ERR": 4, "WARN": 3,
    "WARNING": 3, "NOTICE": 2, "INFO": 1, "DEBUG": 0, "TRACE": 0,
}
DEFAULT_DISPLAY_SEVERITY = 2

SORT_SEVERITY = {
    "EMERGENCY": 6, "FATAL": 5, "CRITICAL": 5, "ERROR": 4,
    "WARN": 3, "WARNING": 3, "INFO": 1, "DEBUG": 0,
}
DEFAULT_SORT_SEVERITY = 2

SCAN_WEIGHT = {
    "EMERGENCY": 1.0, "ALERT": 0.95, "CRITICAL": 0.9, "ERROR": 0.8,
    "WARN": 0.5, "NOTICE": 0.2, "INFO": 0.05, "DEBUG": 0.0, "TRACE": 0.0,
}
DEFAULT_SCAN_WEIGHT = 0.1

RECORD_LEVEL_ALIAS = {
    "WARNING": "WARN", "CRITICAL": "CRITICAL", "FATAL": "CRITICAL",
    "ERROR": "ERROR", "INFO": "INFO", "DEBUG": "DEBUG", "NOTSET": "INFO",
}

SYSLOG_SEVERITY = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]
FACILITY_SEVERITY = {
    "emerg": "EMERGENCY", "alert": "ALERT", "crit": "CRITICAL",
    "err": "ERROR", "error": "ERROR", "warning": "WARN", "warn": "WARN",
    "notice": "NOTICE", "info": "INFO", "debug": "DEBUG",
}
LEVEL_WORD = {
    "emerg": "EMERGENCY", "emergency": "EMERGENCY", "alert": "ALERT",
    "crit": "CRITICAL", "critical": "CRITICAL", "fatal": "CRITICAL",
    "severe": "CRITICAL", "error": "ERROR", "err": "ERROR",
    "exception": "ERROR", "fail": "ERROR", "failed": "ERROR",
    "failure": "ERROR", "warn": "WARN", "warning": "WARN",
    "notice": "NOTICE", "debug": "DEBUG", "trace": "DEBUG", "info": "INFO",
}
GCP_SEVERITY = {
    "DEFAULT": "INFO", "DEBUG": "DEBUG", "INFO": "INFO", "NOTICE": "NOTICE",
    "WARNING": "WARN", "ERROR": "ERROR", "CRITICAL": "CRITICAL",
    "ALERT": "ALERT", "EMERGENCY": "EMERGENCY",
}
AZURE_LEVEL = {
    "informational": "INFO", "information": "INFO", "verbose": "DEBUG",
    "warning": "WARN", "error": "ERROR", "critical": "CRITICAL",
}

PRI_PATTERN = r"^<(\d{1,3})>\s*"
FACILITY_PATTERN = (
    r"\b(?:kern|user|mail|daemon|auth(?:priv)?|syslog|lpr|news|uucp|cron|ftp|local[0-7])"
    r"\.(emerg|alert|crit|err|error|warning|warn|notice|info|debug)\b"
)
LEVEL_WORD_PATTERN = (
    r"\b(EMERG(?:ENCY)?|ALERT|CRIT(?:ICAL)?|FATAL|SEVERE|ERROR|ERR|EXCEPTION"
    r"|WARN(?:ING)?|FAIL(?:ED|URE)?|NOTICE|DEBUG|TRACE|INFO)\b"
)

# --- line formats, in the order they are tried -----------------------------
# Every pattern must match from the start of the line.

LINE_PATTERNS = {
    "NGINX": r'^(\S+) - - \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d+) (\d+)',
    "APACHE": r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d+) (\d+)',
    "APP_LOG": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,\.]\d+)\s+([A-Z]+)\s+\[([^\]]*)\]\s+([^:\s]+):\s*(.*)",
    "ZK_LOG": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,\.]\d+)\s+-\s+([A-Z]+)\s+\[(.+)\]\s+-\s+(.+)",
    "SPARK_LOG": r"^(\d\d/\d\d/\d\d \d\d:\d\d:\d\d)\s+([A-Z]+)\s+([^:]+):\s*(.*)",
    "APACHE_ERR": r"^\[(\w{3} \w{3} \d+ [\d:]+ \d{4})\]\s+\[(\w+)\]\s+(.+)",
    "WINCBS": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\s+(\w+)\s+(\w+)\s+(.+)",
    "HDFS": r"^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+(\S+?):\s+(.+)",
    "HPC": r"^(-|[A-Z0-9_]+)\s+(\d{9,10})\s+(\d{4}\.\d\d\.\d\d)\s+(\S+)\s+(.+)",
    "HEALTHAPP": r"^(\d{8}-\d{1,2}:\d{1,2}:\d{1,2}:\d+)\|([^|]+)\|([^|]+)\|(.+)",
    "PROXIFIER": r"^\[([\d.]+ [\d:]+)\]\s+(\S+?\.exe(?:\s+\*\d+)?)\s+-\s+(.+)",
    "SYSLOG": r"^(\w+\s+\d+\s+[\d:]+) (\S+) (\S+?):? (.+)",
    "STANDARD": r"^(\d{4}-\d{2}-\d{2}T[\d:]+Z)\s+(\w+)\s+\[([^\]]+)\]\s+(.+)",
    "PLAIN_ISO": r"^(\d{4}-\d{2}-\d{2}T[\d:]+Z)\s+(\w+)\s+(\S+)\s+(.+)",
}

CONTINUATION_PATTERN = (
    r'^[ \t]+\S|^(?:at\s+\S|Caused by:|\.\.\.\s*\d+\s+more|Traceback \(most recent call last\)|File ")'
)
MAX_CONTINUATION = 200

# --- masks -----------------------------------------------------------------

TEMPLATE_MASKS = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>", False),
    (r"\b0[xX][0-9a-fA-F]+\b", "<hex>", False),
    (r"\b[0-9a-fA-F]{12,}\b", "<hex>", False),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{2,5})?\b", "<ip>", False),
    (r"\b\d{4}-\d{2}-\d{2}[T ][\d:]{5,8}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?\b", "<ts>", False),
    (r"\b\d+(\.\d+)?\s*(ms|s|sec|seconds?|min|minutes?|h|hours?|kb|mb|gb|tb|kib|mib|gib|bytes?|%)\b",
     "<num>$2", True),
    (r"\b\d+(\.\d+)?\b", "<num>", False),
    (r'"[^"]*"', "<str>", False),
    (r"'[^']*'", "<str>", False),
    (r"\S*\d\S*", "<id>", False),
]
FAMILY_MASKS = [
    (r"0x[0-9a-fA-F]+", "<HEX>", False),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>", False),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<IP>", False),
    (r"\b\d+(?:\.\d+)?(?:ms|s|kb|mb|gb)?\b", "<NUM>", True),
]
SCAN_MASKS = [
    (r"\b\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:z|[+-]\d{2}:?\d{2})?\b", "<ts>", True),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>", True),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>", False),
    (r"\b[a-z_]*\d[\w]*\b", "<id>", True),
]
SCAN_EMPTY = "<empty>"
ALERT_MASK = r"\S*\d\S*"
ALERT_KEY_CHARS = 120

# --- timestamps ------------------------------------------------------------

EPOCH_PATTERN = r"^(1\d{9})(\d{3})?(\.\d+)?$"
ISO_PATTERN = r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
SYSLOG_TIME_PATTERN = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
ACCESS_TIME_PATTERN = r"(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}:\d{2}:\d{2})"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- words -----------------------------------------------------------------

CATASTROPHE_PATTERNS = [
    r"kernel panic", r"\bpanic\b", r"segfault", r"sigsegv",
    r"data loss", r"\bcorrupt\w*", r"split[- ]brain", r"power failure",
    r"cascading failure", r"unrecoverable", r"security breach",
    r"\bhalted\b", r"double fault", r"filesystem read-?only",
]
FAILURE_PATTERNS = [
    r"fail(?:ed|ure|ing)?\b", r"error", r"exception", r"timed?[ _-]?out",
    r"exhaust(?:ed|ion)", r"declin(?:ed|e)\b", r"denied", r"refus(?:ed|al)",
    r"reject(?:ed|ion)", r"crash(?:ed|ing)?", r"abort(?:ed|ing)?",
    r"out[ _-]?of[ _-]?memory", r"\boom\b", r"unreachable", r"unavailable",
    r"dead[ -]?lock", r"\bcannot\b", r"\bcan't\b", r"could not",
    r"unable to", r"no space left", r"enospc", r"\bexpired\b", r"\blost\b",
    r"too many", r"\bdown\b", r"not responding",
]
REPORT_INFO_WORDS = ["error", "fail", "timeout", "refused", "crash", "panic", "oom", "kill"]
LIVE_INFO_WORDS = [
    "error", "fail", "timeout", "refused", "crash", "panic", "oom", "kill",
    "exception", "denied", "unavailable", "corrupt", "fatal",
]
FEATURE_WORDS = [
    "error", "fail", "fatal", "exception", "timeout", "refused",
    "denied", "crash", "panic", "killed", "oom", "unavailable",
    "reset", "abort", "corrupt", "overflow", "underflow", "deadlock",
    "leak", "violation", "invalid", "missing", "unreachable",
]
STACK_WORDS = ["traceback", "at line", "stack", "caused by"]
CAUSE_HINTS = [
    (["connection refused", "connection reset", "unreachable"], "a dependency is down or refusing connections"),
    (["timeout", "timed out"], "a dependency is responding too slowly"),
    (["out of memory", "oom", "memoryerror"], "the process ran out of memory"),
    (["disk", "no space", "i/o error"], "storage/disk trouble"),
    (["permission", "denied", "unauthorized", "forbidden"], "an auth/permission problem"),
    (["segfault", "panic", "core dump"], "the process crashed at native level"),
    (["certificate", "ssl", "tls"], "a certificate/TLS problem"),
    (["replication", "split-brain"], "database replication trouble"),
]

HTTP_PATTERN = (
    r"(?:\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+\S+\s+"
    r'|\bHTTP(?:/\d\.\d)?"?\s+'
    r'|\b(?:status|code|response)\s*[=: ]\s*"?'
    r"|\b(?:failed|error)\s+)"
    r"([1-5]\d{2})\b"
    r"|\b([1-5]\d{2})\s+(?=OK\b|Created\b|Accepted\b|No Content"
    r"|Moved|Found\b|Bad Request|Unauthorized|Forbidden|Not Found"
    r"|Too Many Requests|Internal Server Error|Bad Gateway"
    r"|Service Unavailable|Gateway Time-?out)"
)
NUMBER_PATTERN = r"\b(\d+\.?\d*)\b"
IP_PATTERN = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
PORT_PATTERN = r"(?<!\d):(\d{2,5})(?!\d)"
DURATION_PATTERN = r"\b(\d+\.?\d*)\s*(ms|s|sec|seconds|minutes|min)\b"
MEMORY_PATTERN = r"\b(\d+\.?\d*)\s*(mb|gb|kb|bytes|mib|gib)\b"
MEMORY_UNITS = ["mb", "gb", "kb", "bytes", "mib", "gib"]      # of MEMORY_PATTERN
REPEAT_PATTERN = r"repeated\s+(\d+)\s+times?"

TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9]*|\d+"
TERM_PATTERN = r"\b[a-zA-Z0-9_]{2,}\b"

BASE_SYNONYMS = {
    "db": "database", "conn": "connection", "auth": "authentication",
    "req": "request", "resp": "response", "err": "error", "msg": "message",
    "svc": "service", "k8s": "kubernetes", "cfg": "config",
    "env": "environment", "infra": "infrastructure", "perf": "performance",
    "proc": "process", "mem": "memory", "cpu": "processor", "net": "network",
    "cxn": "connection", "cnx": "connection", "svr": "server", "usr": "user",
    "pwd": "password", "cert": "certificate", "creds": "credentials",
    "oom": "memory", "terminated": "killed", "segfault": "crash",
    "sigkill": "killed", "sigterm": "terminated", "nullpointer": "crash",
    "npe": "crash", "econnrefused": "refused", "econnreset": "reset",
    "etimedout": "timeout", "heap": "memory", "gc": "memory",
    "ioexception": "error", "nullpointerexception": "crash",
    "outofmemoryerror": "memory", "down": "unavailable",
    "unresponsive": "unresponsive", "hung": "unresponsive",
    "stuck": "unresponsive", "overloaded": "overloaded",
}
ERROR_CODES = [
    (r"^ETIMED?OUT$", "timeout"),
    (r"^ENOENT$", "missing"),
    (r"^EPERM$", "denied"),
    (r"^EACCES$", "denied"),
    (r"^ESRCH$", "missing"),
]
# every lower-case word whose normal form holds a feature word has one of these in it
_SIGNS = sorted({*FEATURE_WORDS, "etimeout", "enoent", "eperm", "eacces", "esrch",
                 *(k for k, v in BASE_SYNONYMS.items() if any(w in v for w in FEATURE_WORDS))})
FEATURE_SIGNS = [s for s in _SIGNS if not any(o != s and o in s for o in _SIGNS)]
STOPWORDS = [
    "the", "for", "and", "not", "was", "were", "are", "has", "had", "have",
    "with", "from", "this", "that", "then", "than", "when", "will", "been",
    "being", "after", "before", "into", "over", "under", "while", "where",
    "which", "because", "could", "should", "would", "did", "does", "done",
    "due", "via", "per", "all", "any", "but", "its", "you", "your", "out",
    "off", "our", "their", "them", "they", "these", "those", "there", "here",
    "what", "who", "how", "why", "can", "cannot", "may", "might", "must",
    "shall", "upon", "also", "only", "just", "very", "some", "such", "each",
    "both", "few", "more", "most", "other", "same", "own", "too", "now",
    "get", "got", "set", "yet", "still", "about", "above", "below",
]

# --- scoring constants -----------------------------------------------------

HARD_FLAG_SEVERITY = 1
CHRONIC_SHARE, CHRONIC_MIN_COUNT, CHRONIC_SPREAD, CHRONIC_DAMP = 0.15, 25, 0.50, 0.45
GLOBAL_RARE_SHARE, GLOBAL_RARE_BONUS = 0.005, 0.18
OUTLIER_Z_EXEMPT, OUTLIER_DIST_FLOOR = 4.0, 0.08
SOFTCAP_START, SOFTCAP_TAU = 0.80, 0.60
HISTORY_HEAD, HISTORY_MIN_COUNT, HISTORY_MIN_SPAN, HISTORY_MAX_DAMP = 0.25, 5, 0.40, 0.45
