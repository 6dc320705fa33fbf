"""Literal lines of every format, and the ordered line operators."""

import pytest
from pyspark.sql import functions as F

from siftlog.functions.features import feature_vector
from siftlog.functions.times import parse_timestamp
from siftlog.operators import lines as L
from siftlog.operators.parse import parse_lines, with_format
from siftlog.plans.analyze import parse_logs
from siftlog.sources import readers

CASES = [
    ("2024-03-01T08:00:00Z error [billing] card declined", "STANDARD", "ERROR", "billing"),
    ("2024-03-01T08:00:00Z FATAL [billing] gone", "STANDARD", "FATAL", "billing"),
    ("2024-03-01T08:00:00Z warn billing low stock", "PLAIN_ISO", "WARN", "billing"),
    ('{"timestamp": "t", "level": "warn", "service": "api", "message": "m", "k": 1}', "JSON", "WARN", "api"),
    ('9.8.7.6 - - [01/Mar/2024:08:00:00 +0000] "GET /a HTTP/1.1" 503 12', "NGINX", "CRITICAL", "nginx"),
    ('9.8.7.6 - bob [01/Mar/2024:08:00:00 +0000] "GET /a HTTP/1.1" 404 12', "APACHE", "INFO", "apache"),
    ("2024-03-01 08:00:00,123 FATAL [main] org.x.Y: stop", "APP_LOG", "CRITICAL", "org.x.Y"),
    ("2024-03-01 08:00:00,123 - WARN  [t[1]:Q@9] - slow", "ZK_LOG", "WARN", "zookeeper"),
    ("24/03/01 08:00:00 INFO a.B: ready", "SPARK_LOG", "INFO", "a.B"),
    ("[Fri Mar 01 08:00:00 2024] [error] no child", "APACHE_ERR", "ERROR", "apache"),
    ("2024-03-01 08:00:00, Info   CBS   session 5", "WINCBS", "INFO", "CBS"),
    ("240301 080000 17 ERROR dfs.N$P: lost block", "HDFS", "ERROR", "dfs.N$P"),
    ("KERN 1117838570 2005.06.03 R02-M1 fatal parity", "HPC", "CRITICAL", "R02-M1"),
    ("20240301-8:0:0:17|step|300|failed to read", "HEALTHAPP", "ERROR", "step"),
    ("[03.01 08:00:00] app.exe *64 - open failure", "PROXIFIER", "ERROR", "app.exe *64"),
    ("<11>Mar  1 08:00:00 host sshd[5]: hello", "SYSLOG", "ERROR", "sshd[5]"),
    ("Mar  1 08:00:00 host cron: local0.crit bad", "SYSLOG", "CRITICAL", "cron"),
    ("just words and a warning", "PLAINTEXT", "WARN", "unknown"),
    ('{"eventSource": "s3.amazonaws.com", "eventName": "Get", "errorCode": "Denied"}', "JSON", "ERROR", "s3"),
    ('{"logName": "l", "severity": "alert", "resource": {"type": "vm"}, "textPayload": " x "}', "JSON", "ALERT", "vm"),
    ('{"time": "t", "operationName": "op", "level": "Warning", "category": "net"}', "JSON", "WARN", "net"),
    ('{"level": null}', "JSON", "NONE", "unknown"),
    ("[1, 2]", "JSON", "INFO", "unknown"),
]


def test_formats(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    got = {r["i"]: r for r in parse_lines(with_format(spark.createDataFrame(rows, "i int, value string"))).collect()}
    for i, (line, fmt, level, service) in enumerate(CASES):
        assert (got[i]["format"], got[i]["level"], got[i]["service"]) == (fmt, level, service), line
    assert not got[17]["parsed"] and not got[22]["parsed"]
    assert got[3]["metadata"] == {"k": "1"} and got[12]["metadata"] == {"alert_label": "KERN"}
    assert got[18]["message"] == "Get [Denied]" and got[19]["message"] == "x"


def test_unicode_digits_and_spaces(spark):
    line = "٢٠٢٤-03-01T08:00:00Z ERROR [x] café ٣ down"
    got = with_format(spark.createDataFrame([(line,)], "value string")).first()
    assert got["format"] == "STANDARD"


def test_control_bytes_stay_in_their_field(spark):
    message = "sent 8=FIX.4.4\x019=12\x0135=D\x02\x03 rejected"
    rows = [("2024-03-01T08:00:00Z error [gate] " + message,), ("2024-03-01 08:00:00,123 FATAL [main] a.B: " + message,)]
    for r in parse_lines(with_format(spark.createDataFrame(rows, "value string"))).collect():
        assert r["message"] == message and r["parsed"]


def test_digits_of_other_scripts(spark):
    east = str.maketrans("0123456789", "".join(chr(0x660 + d) for d in range(10)))
    stamp, text = "2024-03-01T08:00:05", "failed after 123 tries, http 503, took 45 ms"
    df = spark.createDataFrame([(stamp, text), (stamp.translate(east), text.translate(east))], "t string, m string")
    plain, other = df.select(parse_timestamp("t", 2024), feature_vector(F.lit("ERROR"), F.lit("s"), F.col("m"))).collect()
    assert plain[0] == 1709280005.0 == other[0] and list(plain[1]) == pytest.approx(list(other[1]))


def test_multiline_cap_and_leading_continuation(spark):
    rows = [("s", 0, "  first is indented")] + [("s", i, f"  at line{i}") for i in range(1, 450)] + [("s", 450, "head"), ("s", 451, "\tat x")]
    df = spark.createDataFrame(rows, "source string, line_no bigint, value string")
    for block in (7, 100, 10_000):
        got = {r["line_no"]: len(r["more"]) for r in L.merge_multiline(df, block).collect()}
        assert got == {0: 200, 201: 200, 402: 47, 450: 1}, block


def test_sticky_blocks_agree(spark):
    body = ['1.1.1.1 - - [t] "GET /a H" 200 1', '1.1.1.1 - u [t] "GET /a H" 200 1', "words", "2024-03-01T08:00:00Z INFO [x] m",
            "2024-03-01T08:00:00Z INFO x m", "240301 080000 17 ERROR dfs: lost", "Mar 1 08:00:00 h s: m", "[1]", '{"a": 1}', "{bad"]
    rows = [("s", i, body[(i * i + i // 3) % len(body)]) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, line_no bigint, value string")
    results = [[tuple(r) for r in L.sticky_format(df, b).orderBy("line_no").select("line_no", "format", "switched").collect()] for b in (1000, 9)]
    assert results[0] == results[1]


def test_facade(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"2024-03-01T08:00:00Z INFO [x] one\n  two\n\n2024-03-01T08:00:01Z ERROR [x] bad \xff byte\n")
    got = parse_logs(readers.read_logs(spark, path=str(tmp_path / "a.log"))).orderBy("entry_id").collect()
    assert [r["message"] for r in got] == ["one | two", "bad � byte"]
    assert got[0]["raw"].endswith("one\n  two") and [r["entry_id"] for r in got] == [0, 1]
    forced = parse_logs(readers.read_logs(spark, lines=["plain"]), fmt="JSON", independent_lines=True).first()
    assert forced["level"] == "INFO" and not forced["parsed"]
    with pytest.raises(ValueError):
        readers.read_logs(spark)
    with pytest.raises(ValueError):
        readers.read_logs(spark, path="x", lines=[])
    with pytest.raises(ValueError):
        readers.read_logs(spark, df=spark.range(1))


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i} {'x' * (i % 90)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = readers.number_lines(readers.scan_text(spark, str(tmp_path)))
        wrong = df.filter(F.split("value", " ")[1].cast("bigint") != F.col("line_no")).count()
        assert df.select("source").distinct().count() == 1 and wrong == 0 and df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_entries_are_parsed_once_and_then_numbered(spark, sf):
    """Numbering reads its rows several times; none of these readings parses a line again."""
    from queries.q_parse import parse_entries

    out = parse_entries(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Generate" not in plan
    ids = sorted(r["entry_id"] for r in out.select("entry_id").collect())
    assert ids == list(range(len(ids))) and len(ids) > 100
