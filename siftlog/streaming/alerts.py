"""Alert gate over a stream, and its delivery."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import COOLDOWN, HOUR, MAX_PER_HOUR, Gate
from .ledger import Ledger

OUT = "app string, key string, ts double, alert_id bigint"
STATE = "stamps array<double>, keys array<string>, times array<double>"


def gate_stream(alerts: DataFrame, cooldown: float = COOLDOWN, max_per_hour: int = MAX_PER_HOUR) -> DataFrame:
    """The alerts (``app, key, ts, alert_id``) that pass cooldown and hourly cap.

    The state of an application is small: the stamps of an hour and the keys
    that still cool down.  Repeats of a key at one moment are dropped before
    the ordered pass, as they never pass.
    """
    def run(key, batches, state: GroupState):
        gate = Gate(cooldown, max_per_hour)
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            stamps, keys, times = state.get
            gate = Gate(cooldown, max_per_hour, list(stamps), dict(zip(keys, times)))
        first = [b.sort_values("alert_id").drop_duplicates(["key", "ts"]) for b in batches]
        rows = pd.concat(first).sort_values(["ts", "alert_id"]).drop_duplicates(["key", "ts"])
        ok = [gate.allow(k, t) for k, t in zip(rows["key"], rows["ts"])]
        if len(rows):
            gate.forget(float(rows["ts"].max()))
        state.update((list(gate.stamps), list(gate.last), list(gate.last.values())))
        state.setTimeoutDuration(int(1000 * max(HOUR, cooldown)))
        yield rows.loc[ok, ["app", "key", "ts", "alert_id"]]

    return alerts.groupBy("app").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def alert_sink(passed: DataFrame, table: str, channels: dict[str, Callable], checkpoint: str, tries: int = 1, **trigger):
    """Write the passed alerts per micro-batch, and what became of them to the ledger ``<table>/delivery``."""
    ledger = Ledger(f"{table}/delivery")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/alerts/batch={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{table}/alerts/batch={batch_id}")
        ledger.offer(stored, channels, batch_id, tries)

    return (passed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())
