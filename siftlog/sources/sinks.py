"""Result tables and alert channels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.synonyms import corpus_fingerprint


def write_results(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = "source") -> None:
    """Parquet, partitioned by source, so later reads prune and push down."""
    writer = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def save_synonyms(learned: DataFrame, messages: DataFrame, path: str, version: int = 2) -> None:
    """The learned dictionary with the fingerprint of the corpus it came from."""
    print_ = corpus_fingerprint(messages).scalar()
    (learned.select("word", "replacement").withColumn("corpus", print_).withColumn("version", F.lit(version))
     .write.mode("overwrite").partitionBy("version").parquet(path))


def load_synonyms(messages: DataFrame, path: str, version: int = 2) -> DataFrame:
    """The saved rows that belong to this corpus; empty after the corpus changed."""
    saved = messages.sparkSession.read.parquet(path)
    return (saved.filter((F.col("version") == version) & (F.col("corpus") == corpus_fingerprint(messages).scalar()))
            .select("word", "replacement"))


def deliver(alerts: DataFrame, channels: dict[str, Callable], key: str = "alert_id") -> DataFrame:
    """``key, sent, errors``: each alert is offered to each channel, on the executors.

    A failing channel is counted and does not stop the others; an alert counts
    as sent when one channel took it.  Channels are user functions of one dict.
    """
    kind = alerts.schema[key].dataType.simpleString()

    def work(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                sent, errors = False, 0
                for send in channels.values():
                    try:
                        send(row)
                        sent = True
                    except Exception:
                        errors += 1
                out.append((row[key], sent, errors))
            yield pd.DataFrame(out, columns=[key, "sent", "errors"])

    return alerts.mapInPandas(work, f"{key} {kind}, sent boolean, errors int")
