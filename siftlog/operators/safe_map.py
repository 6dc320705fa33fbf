"""A user function over entries whose failures become rows, not job failures."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def safe_map(df: DataFrame, key: str, fn: Callable, columns: list[str]) -> DataFrame:
    """``key, result, error_type``; ``fn(**row)`` returns text or None (skipped).

    The only per-row Python of the package, because ``fn`` is the user's.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(batches):
        for pdf in batches:
            out = []
            for k, *values in pdf[[key, *columns]].itertuples(index=False):
                try:
                    r = fn(**dict(zip(columns, values)))
                    out.append((k, None if r is None else str(r), None))
                except Exception as e:          # the contract: any error is counted
                    out.append((k, None, type(e).__name__))
            yield pd.DataFrame(out, columns=[key, "result", "error_type"])

    return df.select(key, *columns).mapInPandas(work, f"{key} {kind}, result string, error_type string")


def outcome_counts(mapped: DataFrame) -> DataFrame:
    failed = F.col("error_type").isNotNull()
    return mapped.agg(F.count_if(~failed & F.col("result").isNotNull()).alias("processed"),
                      F.count_if(~failed & F.col("result").isNull()).alias("skipped"), F.count_if(failed).alias("errors"))
