"""Joining of multi-line entries in a stream."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fixed import CONTINUATION_PATTERN, MAX_CONTINUATION

OUT = "source string, line_no bigint, value string, more array<string>, more_raw array<string>"
STATE = "line_no bigint, value string, more_raw array<string>"


def merge_stream(lines: DataFrame, idle_ms: int = 10_000) -> DataFrame:
    """``source, line_no, value`` → one row per entry.

    ``line_no`` orders the lines of a source (a message-log offset, say).  The
    open entry of each source waits in the state for its next head line, and is
    released when the source stays silent for ``idle_ms``.  The work of a
    trigger is bounded by the rate limit of the source.
    """
    cont = re.compile(CONTINUATION_PATTERN)

    def row(key, entry):
        no, head, more = entry
        return (key, no, head, [m.strip() for m in more], list(more))

    def run(key, batches, state: GroupState):
        source = key[0]
        columns = ["source", "line_no", "value", "more", "more_raw"]
        if state.hasTimedOut:
            no, head, more = state.get
            state.remove()
            yield pd.DataFrame([row(source, (no, head, list(more)))], columns=columns)
            return
        entry = None
        if state.exists:
            no, head, more = state.get
            entry = (no, head, list(more))
        done = []
        rows = pd.concat(list(batches)).sort_values("line_no")
        for no, text in zip(rows["line_no"], rows["value"]):
            if not text.strip():
                continue
            if entry is not None and len(entry[2]) < MAX_CONTINUATION and cont.match(text):
                entry[2].append(text)
            else:
                if entry is not None:
                    done.append(row(source, entry))
                entry = (int(no), text, [])
        if entry is not None:
            state.update(entry)
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(done, columns=columns)

    return lines.groupBy("source").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
