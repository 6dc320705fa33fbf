"""Accuracy and score-distribution tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.base import col


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf1(df: DataFrame, truth, predicted, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall and F1 (0 where undefined)."""
    t, p = col(truth).cast("boolean"), col(predicted).cast("boolean")
    agg = df.groupBy(*(by or [])).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"), F.count_if(t).alias("support_pos"), F.count(F.lit(1)).alias("n"))
    return with_prf(agg)


def with_prf(counts: DataFrame) -> DataFrame:
    out = (counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
           .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn"))))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def false_alarm_rate(df: DataFrame, predicted) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(col(predicted)).alias("false_flags")).withColumn(
        "rate_pct", 100 * F.col("false_flags") / F.greatest("n", F.lit(1)))


def mean_f1(per_task: DataFrame) -> DataFrame:
    return per_task.agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("tasks"))


def threshold_curve(df: DataFrame, score="score", truth="label") -> DataFrame:
    """P, R, F1 and flagged rows at every distinct score rounded to four digits.

    The comparison uses the unrounded score, so a row may fall below its own
    rounded value.  At most 10,001 distinct thresholds in [0, 1]: the rows are
    first reduced to (threshold, above or below) counts and only those are
    put in order.
    """
    th = F.rint(col(score) * 10000) / 10000               # ties to even
    # rows at or above their own rounded value count from that threshold on, others from the next lower one
    cells = df.groupBy(th.alias("th"), (col(score) >= th).alias("_full")).agg(
        F.count_if(col(truth).cast("boolean")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    per = cells.groupBy("th").agg(
        F.sum(F.when(F.col("_full"), F.col("_p")).otherwise(0)).alias("_p_now"),
        F.sum(F.when(F.col("_full"), F.col("_n")).otherwise(0)).alias("_n_now"),
        F.sum(F.when(~F.col("_full"), F.col("_p")).otherwise(0)).alias("_p_next"),
        F.sum(F.when(~F.col("_full"), F.col("_n")).otherwise(0)).alias("_n_next"))
    down = W.orderBy(F.desc("th"))
    upto, before = down.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    acc = per.select(
        "th",
        (F.sum("_p_now").over(upto) + F.coalesce(F.sum("_p_next").over(before), F.lit(0))).alias("tp"),
        (F.sum("_n_now").over(upto) + F.coalesce(F.sum("_n_next").over(before), F.lit(0))).alias("flagged"),
        (F.sum("_p_now").over(everything) + F.sum("_p_next").over(everything)).alias("_pos"))
    p = F.col("tp") / F.greatest("flagged", F.lit(1))
    r = F.col("tp") / F.greatest("_pos", F.lit(1))
    acc = acc.withColumn("precision", p).withColumn("recall", r)
    return acc.withColumn("f1", 2 * F.col("precision") * F.col("recall")
                          / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))).drop("_pos")


def best_thresholds(curve: DataFrame, recall_floor: float = 0.95) -> DataFrame:
    """The F1-best row and the F1-best row that keeps the recall floor (highest threshold on ties)."""
    cols = ["th", "precision", "recall", "f1", "flagged"]
    pick = F.struct(F.col("f1"), F.col("th"))
    best = curve.agg(F.max_by(F.struct(*cols), pick).alias("b"),
                     F.max_by(F.struct(*cols), F.when(F.col("recall") >= recall_floor, pick)).alias("f"))
    rows = best.select(F.explode(F.array(
        F.struct(F.lit("f1_optimal").alias("pick"), F.col("b").alias("r")),
        F.struct(F.lit("recall_floor").alias("pick"), F.col("f").alias("r")))).alias("x"))
    return rows.select("x.pick", *[F.col(f"x.r.{c}").alias(c) for c in cols])


def grid_search(scores: DataFrame, thresholds: list[float], weight="feature_weight", truth="label") -> DataFrame:
    """One row per (weight, threshold): each scored row counts for every threshold at or below its score."""
    marks = F.array(*[F.struct(F.lit(float(t)).alias("flag_threshold"), (F.col("score") >= float(t)).alias("pred"))
                      for t in thresholds])
    cells = scores.select(weight, F.col(truth).alias("_t"), F.explode(marks).alias("m"))
    return prf1(cells.select(weight, "_t", "m.flag_threshold", "m.pred"), "_t", "pred", [weight, "flag_threshold"])


def best_grid_point(grid: DataFrame) -> DataFrame:
    """First grid point, in grid order, with the best F1."""
    return grid.orderBy(F.desc("f1"), "feature_weight", "flag_threshold").limit(1)


def otsu_threshold(df: DataFrame, score="score", lo: float = 0.35, hi: float = 0.95, bins: int = 64) -> DataFrame:
    """Between-class-variance threshold of the scores strictly between 0 and 1.

    One row; NULL with fewer than 20 such scores.  The rows are reduced to 64
    bins before any ordered work.
    """
    s = col(score)
    hist = (df.filter((s > 0) & (s < 1)).groupBy(F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("c")))
    upto, everything = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    centre = (F.col("bin") + 0.5) / bins
    h = (hist.withColumn("n", F.sum("c").over(everything)).withColumn("centre", centre)
         .withColumn("p", F.col("c") / F.col("n"))
         .withColumn("omega_n", F.sum("c").over(upto))
         .withColumn("mu", F.sum(F.col("p") * F.col("centre")).over(upto))
         .withColumn("mu_t", F.sum(F.col("p") * F.col("centre")).over(everything)))
    omega = F.col("omega_n") / F.col("n")
    between = F.when(F.col("omega_n") < F.col("n"),
                     F.pow(F.col("mu_t") * omega - F.col("mu"), F.lit(2.0)) / (omega * (1 - omega))).otherwise(F.lit(0.0))
    h = h.withColumn("sigma", between)
    best = h.agg(F.max("n").alias("n"), F.max_by("centre", F.struct(F.round("sigma", 12), -F.col("bin"))).alias("t"))
    return best.select(F.coalesce("n", F.lit(0)).alias("n"),
                       F.when(F.col("n") >= 20, F.least(F.greatest("t", F.lit(lo)), F.lit(hi))).alias("threshold"))


def score_histogram(df: DataFrame, score="score", bins: int = 20, positive_only: bool = False) -> DataFrame:
    s = col(score)
    if positive_only:
        df = df.filter((s > 0) & (s <= 1))
    b = F.least(F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(0.9999)) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def top_services(flagged: DataFrame, limit: int = 10) -> DataFrame:
    return (flagged.groupBy("service").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), "service").limit(limit))


def anomaly_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("flagged")).alias("anomalies")).withColumn(
        "rate_pct", F.when(F.col("total") > 0, F.col("anomalies") / F.col("total") * 100).otherwise(0.0))


def cluster_separation(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean cosine inside and between labels, over all pairs, without forming pairs.

    With unit vectors, the sum of all pairwise cosines of a set is
    (|Σv|² − n) / 2 and between two sets it is Σu · Σv, so per-label sums of
    the components are enough.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.select(F.col(label).alias("label"), "vec", norm.alias("_n"))
    parts = (unit.select("label", F.posexplode("vec").alias("dim", "x"), "_n")
             .groupBy("label", "dim").agg(F.sum(F.when(F.col("_n") > 0, F.col("x").cast("double") / F.col("_n")).otherwise(0.0)).alias("s")))
    counts = unit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_n") > 0).alias("nz"))
    sq = parts.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("sq")).join(counts, "label")
    total = parts.groupBy("dim").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    row = sq.agg(F.sum((F.col("sq") - F.col("nz")) / 2).alias("intra_sum"), F.sum("sq").alias("sq"),
                 F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("intra_count"),
                 F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    inter_sum = (total.scalar() - F.col("sq")) / 2
    row = row.select(
        F.col("intra_count").cast("bigint").alias("intra_count"),
        ((F.col("n") * F.col("n") - F.col("nn")) / 2).cast("bigint").alias("inter_count"),
        "intra_sum", inter_sum.alias("inter_sum"))
    row = (row.withColumn("intra_mean", _ratio(F.col("intra_sum"), F.col("intra_count")))
           .withColumn("inter_mean", _ratio(F.col("inter_sum"), F.col("inter_count"))))
    return row.withColumn("separation", F.when(F.col("intra_count") > 0, F.col("intra_mean") - F.col("inter_mean")).otherwise(0.0)).drop(
        "intra_sum", "inter_sum")


def isolation(vectors: DataFrame, marked, label: str = "label") -> DataFrame:
    """1 − mean dot product of the marked vectors with the centroids of the other labels."""
    rows = vectors.select(F.col(label).alias("label"), col(marked).alias("_m"), F.posexplode("vec").alias("dim", "x"))
    cents = rows.filter(~F.col("_m")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("c"))
    mean_c = cents.groupBy("dim").agg(F.avg("c").alias("c"))
    mean_a = rows.filter("_m").groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return mean_c.join(mean_a, "dim").agg((1 - F.sum(F.col("a") * F.col("c"))).alias("isolation"))
