"""Run registered queries in Spark and in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def compare(spark, con, name, query, sql, sf: str = SF) -> str:
    """Empty text when equal, else what differs."""
    df = query(spark, sf)
    got = table([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want = table(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} / {sorted(rel.columns)}"
    types = {c: t for c, t in zip(rel.columns, rel.types)}
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        miss = [r for r in want if r not in set(got)][:2]
        return f"{name}: {len(got)} rows / {len(want)} rows\n  only spark {extra}\n  only duckdb {miss}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{name}: {len(bad)} of {len(got)} rows differ\n  {sorted(df.columns)}\n  spark  {bad[0][0]}\n  duckdb {bad[0][1]}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "HUGEINT": "bigint"}
    notes = [f"{c}:{df.schema[c].dataType.simpleString()}/{types[c]}" for c in df.columns
             if kinds.get(str(types[c]), "") != df.schema[c].dataType.simpleString()]
    if notes:
        print(f"   note {name}: types {notes}")
    if not got:
        print(f"   note {name}: no rows")
    return ""


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    spark, con = session(), connect()
    queries, oracles = E.queries(), E.oracle_sql()
    picked = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    failed = 0
    for n in picked:
        t = time.time()
        try:
            if n in oracles:
                msg = compare(spark, con, n, queries[n], oracles[n])
                status = "ok" if not msg else "DIFF " + msg
            else:
                status = f"rows {queries[n](spark, SF).count()}"
        except Exception as e:
            status = "FAIL " + type(e).__name__ + " " + str(e)[:1500]
        failed += status[:4] in ("DIFF", "FAIL")
        print(f"{n:28s} {time.time() - t:6.1f}s {status}", flush=True)
    print(f"{len(picked)} queries, {failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
