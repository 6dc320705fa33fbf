"""A deterministic labelled corpus of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FAMILIES = {
    "db_connection": ("ERROR", ["Connection refused by database pool {n}", "Query timeout after {n}ms on replica",
                                "Lost connection to primary database at 10.2.0.{n}", "Could not acquire database lock {n}"]),
    "auth_failure": ("ERROR", ["Login failed for user u{n}", "Token rejected: signature expired {n}s ago",
                               "Access denied for client {n}", "Too many password attempts from 172.16.0.{n}"]),
    "http_500": ("ERROR", ["GET /api/items/{n} 500 internal error", "POST /api/cart failed with status 502 after {n}ms",
                           "Unhandled exception in handler {n}", "Upstream returned 503 Service Unavailable ({n})"]),
    "memory_oom": ("CRITICAL", ["Out of memory: killed worker {n}", "Heap exhausted at {n} MB",
                                "OOM while allocating {n} bytes", "Memory limit reached in container c{n}"]),
    "disk_io": ("WARN", ["Disk usage at {n}%", "Slow write: {n}ms on volume", "I/O wait above limit: {n}%", "Inode table {n}% full"]),
    "network_latency": ("WARN", ["Latency {n}ms above target", "Packet loss {n}% on uplink", "DNS lookup took {n}ms",
                                 "Retransmits rising: {n} per second"]),
}
NORMAL = ["Request {n} completed in {n}ms", "User u{n} logged in", "Cache refreshed with {n} items", "Job {n} finished",
          "Health check passed in {n}ms", "Session {n} closed", "Config reloaded, version {n}", "Batch of {n} rows committed"]
RARE = ["Kernel panic on host h{n}", "Data loss detected in segment {n}", "Split-brain between nodes {n} and peer",
        "Security breach: unknown root login from 203.0.113.{n}", "Filesystem readonly after double fault {n}"]
SERVICES = ["api", "auth", "db", "cart", "worker", "edge"]


def generate_logs(spark: SparkSession, n: int = 5000, cluster_ratio: float = 0.5, anomalies: int = 30, seed: int = 42) -> DataFrame:
    """``idx, cluster, line`` in a seeded order: failure families, normal lines, rare anomalies.

    Every row is a function of its id, so any size is produced in parallel.
    """
    return generate_from(spark.range(n), n, cluster_ratio, anomalies, seed)


def generate_from(ids: DataFrame, n: int, cluster_ratio: float = 0.5, anomalies: int = 30, seed: int = 42) -> DataFrame:
    """The corpus for a column ``id`` of 0 … n−1, wherever it comes from."""
    def pick(salt: int, k: int):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k)).cast("int")

    names = list(FAMILIES)
    clustered = int(n * cluster_ratio)
    kind = F.when(F.col("id") < clustered, F.element_at(F.array(*[F.lit(x) for x in names]), pick(1, len(names)) + 1)) \
        .when(F.col("id") < n - anomalies, "normal").otherwise("anomaly")
    level = F.when(F.col("cluster") == "normal", "INFO").when(F.col("cluster") == "anomaly", "CRITICAL")
    text = (F.when(F.col("cluster") == "normal", F.element_at(F.array(*[F.lit(x) for x in NORMAL]), pick(2, len(NORMAL)) + 1))
            .when(F.col("cluster") == "anomaly", F.element_at(F.array(*[F.lit(x) for x in RARE]), pick(2, len(RARE)) + 1)))
    for name, (lvl, texts) in FAMILIES.items():
        level = level.when(F.col("cluster") == name, lvl)
        text = text.when(F.col("cluster") == name, F.element_at(F.array(*[F.lit(x) for x in texts]), pick(2, len(texts)) + 1))
    rows = ids.select("id").withColumn("cluster", kind).withColumn("level", level).withColumn(
        "message", F.replace(text, F.lit("{n}"), (pick(3, 997) + 1).cast("string")))
    service = F.element_at(F.array(*[F.lit(x) for x in SERVICES]), pick(4, len(SERVICES)) + 1)
    # the seeded order: a bijection of 0 … n−1 keeps positions unique without a sort
    step = next(s for s in range(int(n * 0.618) | 1, 2 * n + 3, 2) if _coprime(s, n))
    idx = F.pmod(F.col("id") * F.lit(step) + F.lit(seed), F.lit(n))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("idx")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumn("idx", idx).select(
        "idx", "cluster", F.concat(stamp, F.lit(" "), F.col("level"), F.lit(" ["), service, F.lit("] "), F.col("message")).alias("line"))


def _coprime(a: int, b: int) -> bool:
    from math import gcd

    return gcd(a, b) == 1
