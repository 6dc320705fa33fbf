"""The ensemble score of an entry.

Everything that depends on the template alone is worked out on the template
rows; the entry pass is one lookup join plus row-local expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X
from ..functions.base import lookup
from ..functions.levels import has_catastrophe, has_failure
from ..functions.text import fixed_point
from ..functions.vectors import soft_cap
from ..runtime import lookup_join
from .bursts import Bursts
from .templates import KEY


# fixed values: the defaults decide results
@dataclass(frozen=True)
class Rarity:
    """A cluster is rare up to ``least`` entries or ``share`` of its level; mild entries count ``safe_damp`` of it."""

    share: float = 0.02
    least: int = 3
    safe_damp: float = 0.5


def add_level_and_cluster_sizes(templates: DataFrame) -> DataFrame:
    """Entries per level and per cluster, summed from the template counts."""
    levels = templates.groupBy("lvl").agg(F.sum("cnt").alias("level_total"))
    clusters = templates.groupBy("cluster").agg(F.sum("cnt").alias("cluster_size"))
    return templates.join(levels, "lvl").join(clusters, "cluster")


def template_terms(stats: DataFrame, rarity_of: Rarity = Rarity()) -> DataFrame:
    """Score terms and reason fragments that all entries of a template share.

    Needs: sev, cnt, share, span, head_share, flags, cluster, cluster_size,
    level_total, outlier, outlier_z, outlier_dist.
    """
    sev, cnt, zero = F.col("sev"), F.col("cnt"), F.lit(0.0)
    chronic, outlier = F.col("chronic"), F.col("outlier")
    noise = F.col("cluster") == -1
    hard = sev <= X.HARD_FLAG_SEVERITY

    # base severity and its two damps
    routine = F.least(F.lit(1.0), F.greatest(zero, (F.col("head_share") - X.HISTORY_HEAD) / (1.0 - X.HISTORY_HEAD)))
    has_history = (sev.isin(3, 4) & (cnt >= X.HISTORY_MIN_COUNT) & (F.col("span") >= X.HISTORY_MIN_SPAN) & (routine > 0))
    base = lookup(sev, X.SEVERITY_BASE, 0.15)
    base = F.when(chronic, base * X.CHRONIC_DAMP).otherwise(base)
    base = F.when(has_history, base * (F.lit(1.0) - F.lit(X.HISTORY_MAX_DAMP) * routine)).otherwise(base)
    base = F.when(hard, F.lit(1.0)).otherwise(base)

    # rarity
    rare_cut = F.greatest(F.lit(rarity_of.least), F.floor(F.col("level_total") * F.lit(rarity_of.share))).cast("double")
    rare_cluster = ~noise & (F.col("cluster_size") <= rare_cut)
    rarity = (F.when(noise, F.lit(0.75))
              .when(rare_cluster, F.lit(0.45) + F.lit(0.30) * (F.lit(1.0) - F.col("cluster_size") / (rare_cut + F.lit(1.0))))
              .otherwise(zero))
    from_z = F.least(F.lit(0.35) + F.lit(0.10) * F.greatest(zero, F.col("outlier_z") - 2.0), F.lit(0.75))
    rarity = F.when(outlier, F.greatest(rarity, from_z)).otherwise(rarity)
    rare_template = cnt <= F.greatest(F.lit(2), F.floor(F.lit(0.005) * F.col("level_total")))
    rarity = F.when(rare_template, F.greatest(rarity, F.lit(0.40))).otherwise(rarity)
    extreme = outlier & (F.col("outlier_z") >= X.OUTLIER_Z_EXEMPT) & (F.col("outlier_dist") > X.OUTLIER_DIST_FLOOR)
    damp_safe = (sev >= 5) & ~noise & ~extreme
    rarity = F.when(damp_safe, rarity * F.lit(rarity_of.safe_damp)).otherwise(rarity)
    rarity = F.when(chronic, rarity * F.lit(X.CHRONIC_DAMP)).otherwise(rarity)

    rare_bonus = F.col("global_rare") & (sev <= 4) & ~chronic
    conc = (cnt / (cnt + F.lit(8.0))) * (F.lit(1.0) - F.col("span"))

    stats = stats.withColumn("_base", base).withColumn("_rarity", rarity).withColumn("_conc", conc)
    add = [F.col("_base") + F.col("_rarity"), F.when(rare_bonus, F.lit(X.GLOBAL_RARE_BONUS)).otherwise(zero)]
    after = [F.when(F.col("flood"), F.lit(0.35) + F.lit(0.25) * F.least(F.lit(1.0), F.col("share"))).otherwise(zero),
             F.when(F.col("recurring"), F.lit(0.02) + F.lit(0.25) * F.col("_conc")).otherwise(zero)]
    novelty = F.when(sev <= 4, F.when(F.col("novel"), F.lit(0.35)).when(F.col("surge"), F.lit(0.30))).otherwise(None)

    def when(test: Column, code: str, text: Column) -> Column:
        return F.when(test, F.struct(F.lit(code).alias("code"), text.alias("text")))

    def percent(x: Column, digits: int) -> Column:
        return F.concat(fixed_point(x * 100, digits), F.lit("%"))

    lvl = F.col("lvl")
    before_burst = F.array(
        when(hard, "hard", F.concat(lvl, F.lit(" level is always flagged"))),
        when(~hard & has_history, "history", F.concat(F.lit("routine by own history ("), percent(F.col("head_share"), 0),
                                                      F.lit(" of occurrences in leading window)"))),
        when(~hard & (F.col("_base") > 0), "severity", F.concat(F.lit("severity "), lvl)),
        when(noise, "noise", F.lit("unclustered (semantic noise point)")),
        when(rare_cluster, "rare_cluster", F.concat(
            F.lit("rare pattern ("), F.col("cluster_size").cast("bigint").cast("string"), F.lit(" of "),
            F.col("level_total").cast("string"), F.lit(" "), lvl, F.lit(" entries)"))),
        when(outlier, "outlier", F.concat(F.lit("semantic outlier within "), lvl,
                                          F.lit(" level (z="), fixed_point("outlier_z", 1), F.lit(")"))),
        when(rare_template & ~rare_cluster, "rare_template", F.concat(
            F.lit("template seen only "), cnt.cast("string"), F.lit("x"))),
        when(chronic, "chronic", F.concat(F.lit("chronic pattern ("), cnt.cast("string"),
                                          F.lit("x) — damped as routine noise"))),
        when(rare_bonus, "global_rare", F.concat(F.lit("globally rare ("), percent(F.col("share"), 2), F.lit(" of file)"))),
    )
    after_burst = F.array(
        when(F.col("flood"), "flood", F.concat(F.lit("flood: pattern is "), percent(F.col("share"), 0),
                                               F.lit(" of the whole file"))),
        when(F.col("recurring"), "recurring", F.concat(
            F.lit("recurring "), lvl, F.lit(" pattern ("), cnt.cast("string"),
            F.lit("x, concentration "), fixed_point("_conc", 2), F.lit(")"))),
    )
    last = F.array(
        when((sev <= 4) & F.col("novel"), "novel", F.lit("never seen in baseline")),
        when((sev <= 4) & ~F.col("novel") & F.col("surge"), "surge", F.lit("frequency surge vs baseline (>10x)")))
    return (stats.withColumn("_s0", add[0] + add[1])
            .withColumn("_flood_add", after[0]).withColumn("_recurring_add", after[1])
            .withColumn("_novel_add", F.coalesce(novelty, zero))
            .withColumn("_r0", F.filter(before_burst, lambda r: r.isNotNull()))
            .withColumn("_r1", F.filter(after_burst, lambda r: r.isNotNull()))
            .withColumn("_r2", F.filter(last, lambda r: r.isNotNull())))


def score_entries(prepared: DataFrame, stats: DataFrame, rarity: Rarity = Rarity(), bursts: Bursts = Bursts()) -> DataFrame:
    """Entries with ``template_id, cluster, raw_score, score, reasons, reason_codes``.

    ``prepared`` carries ``burst``; ``stats`` is the output of the template
    steps.  Terms are added in a fixed order, in DOUBLE.
    """
    terms = template_terms(stats, rarity).select(
        *KEY, "template_id", "cluster", "_s0", "_flood_add", "_recurring_add", "_novel_add", "_r0", "_r1", "_r2")
    joined = lookup_join(prepared, terms, KEY)
    severe = F.col("sev") <= 4
    joined = (joined.withColumn("_cat", severe & has_catastrophe("message"))
              .withColumn("_fail", severe & has_failure("message")))
    zero = F.lit(0.0)
    raw = (F.col("_s0") + F.when(F.col("burst"), F.lit(0.50)).otherwise(zero) + F.col("_flood_add")
           + F.col("_recurring_add") + F.when(F.col("_cat"), F.lit(0.20)).otherwise(zero)
           + F.when(F.col("_fail"), F.lit(0.22)).otherwise(zero) + F.col("_novel_add"))

    def one(test: Column, code: str, text: str) -> Column:
        r = F.array(F.struct(F.lit(code).alias("code"), F.lit(text).alias("text")))
        return F.when(test, r).otherwise(F.slice(r, 1, 0))

    burst_text = f"rate burst (> {bursts.factor:g}x baseline in {bursts.width:g}s window)"
    why = F.concat(F.col("_r0"), one(F.col("burst"), "burst", burst_text), F.col("_r1"),
                   one(F.col("_cat"), "catastrophe", "catastrophic keyword"),
                   one(F.col("_fail"), "failure", "failure keyword in severe entry"), F.col("_r2"))
    return (joined.withColumn("raw_score", raw).withColumn("score", soft_cap("raw_score"))
            .withColumn("_why", why)
            .withColumn("reasons", F.col("_why.text")).withColumn("reason_codes", F.col("_why.code"))
            .drop("_s0", "_flood_add", "_recurring_add", "_novel_add", "_r0", "_r1", "_r2", "_cat", "_fail", "_why"))


def flag(scored: DataFrame, threshold: float | Column) -> DataFrame:
    return scored.withColumn("flagged", F.col("score") >= (threshold if isinstance(threshold, Column) else F.lit(threshold)))
