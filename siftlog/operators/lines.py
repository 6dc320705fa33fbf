"""Order-dependent line operators: multi-line merge, sticky format, numbering.

A source may hold a third of all lines, so no window runs over a whole source.
Lines are cut into blocks of consecutive line numbers; each block is worked on
alone, leaves one summary row, and the summaries (one per block) carry the
state from block to block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed as X
from ..functions.base import is_blank, matches, strip
from ..runtime import BLOCK_ROWS, block_of, evaluate_once, stage
from .parse import FORMATS, detect_format, matching_formats, with_format

RUN = X.MAX_CONTINUATION + 1


def mark_heads(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Non-blank lines with ``is_head`` and ``head_no``, the line that starts their entry.

    Continuations since the last ordinary head are numbered; every 201st one
    starts an entry of its own, as does the first line of a source.
    """
    body = (lines.filter(~is_blank("value"))
            .withColumn("_cont", matches("value", X.CONTINUATION_PATTERN))
            .withColumn("_block", block_of("line_no", block_rows)))
    run = W.partitionBy("source", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    c = F.col("_cont").cast("int")
    body = (body.withColumn("_cum", F.sum(c).over(run))
            .withColumn("_at_head", F.last(F.when(~F.col("_cont"), F.col("_cum")), ignorenulls=True).over(run)))

    ends = body.groupBy("source", "_block").agg(
        F.max(F.struct("line_no", (F.col("_cum") - F.coalesce("_at_head", F.lit(0))).alias("tail"))).getField("tail").alias("_tail"),
        F.max(F.col("_at_head").isNotNull()).alias("_has_head"))
    earlier = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    spans = ends.withColumn("_seg", F.sum(F.col("_has_head").cast("int")).over(
        W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)))
    in_seg = W.partitionBy("source", "_seg").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    spans = spans.withColumn("_through", F.sum("_tail").over(in_seg))
    prev = W.partitionBy("source").orderBy("_block")
    carry = spans.select("source", "_block",
                         F.coalesce(F.lag("_through").over(prev), F.lit(0)).alias("_carry"),
                         F.coalesce(F.max(F.col("_has_head")).over(earlier), F.lit(False)).alias("_after_head"))

    body = body.join(carry, ["source", "_block"])
    since = F.when(F.col("_at_head").isNotNull(), F.col("_cum") - F.col("_at_head")).otherwise(F.col("_cum") + F.col("_carry"))
    headless = F.col("_at_head").isNull() & ~F.col("_after_head")
    body = body.withColumn("is_head", ~F.col("_cont")
                           | F.when(headless, (since - 1) % RUN == 0).otherwise(since % RUN == 0))

    local = F.last(F.when(F.col("is_head"), F.col("line_no")), ignorenulls=True).over(run)
    last_heads = (body.groupBy("source", "_block").agg(F.max(F.when(F.col("is_head"), F.col("line_no"))).alias("_h"))
                  .select("source", "_block", F.last("_h", ignorenulls=True).over(earlier).alias("_prev_head")))
    return (body.withColumn("_local", local).join(last_heads, ["source", "_block"])
            .withColumn("head_no", F.coalesce("_local", "_prev_head"))
            .select(*lines.columns, "is_head", "head_no"))


def merge_multiline(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per entry: head line, stripped continuation lines, joined raw text."""
    marked = mark_heads(lines, block_rows)
    rows = F.array_sort(F.collect_list(F.struct("line_no", "value")))      # at most 201 lines per entry
    grouped = marked.groupBy("source", F.col("head_no").alias("line_no")).agg(rows.alias("_rows"))
    tail = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))
    return grouped.select(
        "source", "line_no", F.get("_rows", F.lit(0)).getField("value").alias("value"),
        F.transform(tail, lambda r: strip(r.getField("value"))).alias("more"),
        F.transform(tail, lambda r: r.getField("value")).alias("more_raw"),
    )


def append_continuations(entries: DataFrame) -> DataFrame:
    """Fold ``more`` / ``more_raw`` of merged lines into message and raw text."""
    return (entries
            .withColumn("message", F.array_join(F.concat(F.array("message"), F.col("more")), " | "))
            .withColumn("raw", F.array_join(F.concat(F.array("raw"), F.col("more_raw")), "\n"))
            .drop("more", "more_raw"))


def _step(state: int, first: int, mask: int) -> int:
    return state if state >= 0 and (mask >> state) & 1 else first


def sticky_format(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Format of each line when the last good format is tried first.

    A line keeps the current format if it satisfies it, otherwise it sets the
    first format it does satisfy; lines without any format inherit.  A block
    is a function from the format before it to the format after it, so blocks
    are reduced alone and composed.  Adds ``detected``, ``format``, ``switched``.
    """
    none = len(FORMATS)
    # a JSON line with a leading bracket is detected, but does not keep the state
    first = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("detected")).cast("int") - 1
    # every line is matched against the patterns here, once; the passes below read plain columns
    base = stage(evaluate_once(with_format(lines, name="detected"), _mask=matching_formats("value"))
                 .withColumn("_first", first).withColumn("_block", block_of("line_no", block_rows)))
    known = base.filter(F.col("_first") >= 0).select("source", "_block", "line_no", "_mask", "_first")
    order = W.partitionBy("source", "_block").orderBy("line_no")
    same = (F.lag("_mask").over(order) == F.col("_mask")) & (F.lag("_first").over(order) == F.col("_first"))
    # after a line its format is the state, so a repeat of the same (mask, first) pair changes nothing
    points = known.withColumn("_same", F.coalesce(same, F.lit(False))).filter(~F.col("_same")).drop("_same")

    def transition(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        ends = list(range(none)) + [-1]
        for f, m in zip(pdf["_first"].to_numpy(), pdf["_mask"].to_numpy()):
            ends = [_step(s, int(f), int(m)) for s in ends]
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "_block": [pdf["_block"].iloc[0]], "ends": [ends]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        starts, state = [], -1
        for ends in pdf["ends"]:
            starts.append(state)
            state = int(ends[state])
        return pd.DataFrame({"source": pdf["source"], "_block": pdf["_block"], "_start": starts})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        state, out = int(pdf["_start"].iloc[0]), []
        for f, m in zip(pdf["_first"].to_numpy(), pdf["_mask"].to_numpy()):
            state = _step(state, int(f), int(m))
            out.append(state)
        return pd.DataFrame({"source": pdf["source"], "line_no": pdf["line_no"], "_state": out})

    source_type = lines.schema["source"].dataType.simpleString()
    blocks = points.groupBy("source", "_block").applyInPandas(
        transition, f"source {source_type}, _block bigint, ends array<int>")
    starts = blocks.groupBy("source").applyInPandas(compose, f"source {source_type}, _block bigint, _start int")
    states = (points.join(starts, ["source", "_block"]).groupBy("source", "_block")
              .applyInPandas(replay, f"source {source_type}, line_no bigint, _state int"))

    names = F.array(*[F.lit(f) for f in FORMATS])
    upto = W.partitionBy("source", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    all_blocks = base.select("source", "_block").distinct().join(blocks, ["source", "_block"], "left")
    carried = all_blocks.join(starts, ["source", "_block"], "left")
    # blocks without any known line take the state after the last block that had one
    after = F.when(F.col("ends").isNotNull(),
                   F.element_at("ends", F.when(F.col("_start") >= 0, F.col("_start") + 1).otherwise(F.lit(none + 1))))
    before = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select("source", "_block",
                             F.coalesce(F.last(after, ignorenulls=True).over(before), F.lit(-1)).alias("_enter"))
    joined = base.join(states, ["source", "line_no"], "left").join(carried, ["source", "_block"])
    now = F.coalesce(F.last("_state", ignorenulls=True).over(upto), F.col("_enter"))
    was = F.lag("_now").over(W.partitionBy("source", "_block").orderBy("line_no"))
    return (joined.withColumn("_now", now)
            .withColumn("_was", F.coalesce(was, F.col("_enter")))
            .withColumn("format", F.when(F.col("_now") >= 0, F.element_at(names, F.col("_now") + 1)).otherwise(F.col("detected")))
            .withColumn("switched", (F.col("_was") >= 0) & (F.col("_now") != F.col("_was")))
            .select(*lines.columns, "detected", "format", "switched"))


def first_line_format(lines: DataFrame) -> DataFrame:
    """Format of the first non-blank line of each source."""
    first = (lines.filter(~is_blank("value")).groupBy("source")
             .agg(F.min_by("value", "line_no").alias("value"), F.min("line_no").alias("line_no")))
    return first.select("source", "line_no", detect_format("value").alias("format"))


def parse_stats(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per source: lines, blanks, continuations, format switches and unparsed entries."""
    from .parse import parse_lines

    counts = lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"),
                                         F.count_if(is_blank("value")).alias("blank"))
    heads = mark_heads(lines, block_rows)
    conts = heads.groupBy("source").agg(F.count_if(~F.col("is_head")).alias("continuations"))
    sticky = sticky_format(heads.filter("is_head").select("source", "line_no", "value"), block_rows)
    parsed = parse_lines(sticky).groupBy("source").agg(
        F.count_if(F.col("switched")).alias("format_switches"), F.count_if(~F.col("parsed")).alias("fallback"))
    return counts.join(conts, "source", "left").join(parsed, "source", "left").na.fill(0)


def number_entries(entries: DataFrame, block_rows: int = BLOCK_ROWS, name: str = "entry_id") -> DataFrame:
    """Contiguous 0-based ``entry_id`` in (source, line_no) order.

    In-block ranks plus the running total of block sizes; per source first,
    then over the sources.
    """
    blocked = entries.withColumn("_block", block_of("line_no", block_rows))
    sizes = blocked.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = sizes.groupBy("source").agg(F.sum("_n").alias("_t"))
    prior = W.orderBy("source").rowsBetween(W.unboundedPreceding, -1)      # one row per source
    totals = totals.select("source", F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_base"))
    starts = (sizes.select("source", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
              .join(totals, "source").select("source", "_block", (F.col("_start") + F.col("_base")).alias("_start")))
    rank = F.row_number().over(W.partitionBy("source", "_block").orderBy("line_no")) - 1
    return (blocked.withColumn("_rank", rank).join(starts, ["source", "_block"])
            .withColumn(name, (F.col("_start") + F.col("_rank")).cast("bigint"))
            .drop("_block", "_rank", "_start"))
