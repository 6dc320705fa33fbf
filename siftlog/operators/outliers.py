"""Templates far from the weighted centre of their level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import dot, row_normalize
from .textvec import mean_vector

MIN_TEMPLATES, SIGMAS, MIN_DISTANCE = 4, 2.0, 0.05


def level_outliers(vectors: DataFrame, level: str = "lvl") -> DataFrame:
    """Rows with ``outlier, outlier_z, outlier_dist``; input ``<level>, vec, cnt`` with unit vectors.

    A template is an outlier when its cosine distance from the level's weighted
    centroid exceeds mean + 2σ and 0.05.  Levels with fewer than four templates
    or a zero centroid have none.
    """
    centres = (vectors.groupBy(level).agg(F.count(F.lit(1)).alias("_k"), mean_vector(F.col("vec"), F.col("cnt")).alias("_c"))
               .filter(F.col("_k") >= MIN_TEMPLATES)
               .filter(F.exists("_c", lambda x: x != 0.0))
               .select(level, row_normalize("_c").alias("_c")))
    away = vectors.join(centres, level, "left").withColumn(
        "_d", F.when(F.col("_c").isNotNull(), 1.0 - dot(F.col("vec").cast("array<double>"), "_c"))).drop("_c")
    w = F.col("cnt").cast("double")
    # weighted mean and spread in one pass; distances lie in [0, 2]
    d = F.col("_d")
    moments = away.filter(d.isNotNull()).groupBy(level).agg(
        (F.sum(w * d) / F.sum(w)).alias("_m"), (F.sum(w * d * d) / F.sum(w)).alias("_q"))
    moments = moments.select(level, "_m", F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))).alias("_s"))
    away = away.join(moments, level, "left")
    hit = F.coalesce((F.col("_d") > F.col("_m") + SIGMAS * F.col("_s")) & (F.col("_d") > MIN_DISTANCE), F.lit(False))
    z = F.when(F.col("_s") > 1e-9, (F.col("_d") - F.col("_m")) / F.col("_s")).otherwise(10.0)
    return (away.withColumn("outlier", hit)
            .withColumn("outlier_z", F.when(hit, z).otherwise(0.0))
            .withColumn("outlier_dist", F.when(hit, F.col("_d")).otherwise(0.0)).drop("_d", "_m", "_s"))
