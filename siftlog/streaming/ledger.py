"""What became of each alert at each channel: a table that survives repeated batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import folder_exists, lookup_join, stage

ERROR_CHARS = 500


class Ledger:
    """Outcomes under ``<path>/batch=b``: ``key, channel, sent, tries, error``, one row per offer of a row to a channel.

    A batch that runs again offers only what its ledger does not hold as sent,
    and adds the new outcomes.  A task lost before its outcomes were written
    offers its rows once more: delivery is at least once, and exactly once
    while no task is lost.
    """

    def __init__(self, path: str, key: str = "alert_id"):
        self.path, self.key = path.rstrip("/"), key

    def offer(self, rows: DataFrame, channels: dict[str, Callable], batch_id: int, tries: int = 1) -> None:
        """Give each row (a dict) to each channel, on the executors; an error is noted and stops neither rows nor channels."""
        key, kind = self.key, rows.schema[self.key].dataType.simpleString()
        target = f"{self.path}/batch={batch_id}"
        if folder_exists(rows.sparkSession, target):
            done = rows.sparkSession.read.parquet(target).filter("sent").groupBy(key).agg(F.collect_set("channel").alias("_taken"))
            rows = lookup_join(rows, stage(done), [key], "left")
        else:
            rows = rows.withColumn("_taken", F.lit(None).cast("array<string>"))

        def work(batches):
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    taken = row.pop("_taken")
                    for name, send in channels.items():
                        if taken is None or name not in taken:
                            out.append((row[key], name, *attempt(send, row, tries)))
                yield pd.DataFrame(out, columns=[key, "channel", "sent", "tries", "error"])

        (rows.mapInPandas(work, f"{key} {kind}, channel string, sent boolean, tries int, error string")
         .write.mode("append").parquet(target))

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """All offers, with ``batch``."""
        return spark.read.parquet(self.path)

    def deliveries(self, spark: SparkSession) -> DataFrame:
        """``key, sent, errors``: whether any channel took the row, and the failed offers."""
        return self.outcomes(spark).groupBy(self.key).agg(F.max("sent").alias("sent"), F.count_if(~F.col("sent")).alias("errors"))


def attempt(send: Callable, row: dict, tries: int) -> tuple[bool, int, str | None]:
    """(taken, tries made, last error)."""
    error = None
    for n in range(1, max(tries, 1) + 1):
        try:
            send(row)
            return True, n, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
    return False, max(tries, 1), error
