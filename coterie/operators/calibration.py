"""Calibration quality of scores."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calibration_bins(df: DataFrame, n: int = 10, score: str = "predicted_score", label: str = "is_abuse") -> DataFrame:
    """n equal bins over [0, 1], the last closed: count, observed rate, mean score, gap; empty bins stay."""
    edges = [i * (1.0 / n) for i in range(n)] + [1.0]
    p = F.col(score).cast("double")
    # literal edges i/n: floor(p * n) would put some scores that equal an edge one bin off
    index = F.lit(None).cast("int")
    for k in range(n):
        upper = (p <= F.lit(edges[k + 1])) if k == n - 1 else (p < F.lit(edges[k + 1]))
        index = F.when((p >= F.lit(edges[k])) & upper, F.lit(k)).otherwise(index)
    got = df.groupBy(index.alias("bin_index")).agg(
        F.count("*").alias("bin_count"), F.avg(F.col(label).cast("double")).alias("observed_rate"), F.avg(p).alias("mean_predicted_prob"))
    grid = df.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(n)],
                                           "bin_index int, bin_lower double, bin_upper double")
    out = grid.join(F.broadcast(got), "bin_index", "left")
    rate = F.coalesce("observed_rate", F.lit(0.0))
    mean = F.coalesce("mean_predicted_prob", (F.col("bin_lower") + F.col("bin_upper")) / 2)
    return out.select("bin_index", "bin_lower", "bin_upper", F.coalesce("bin_count", F.lit(0)).alias("bin_count"),
                      rate.alias("observed_rate"), mean.alias("mean_predicted_prob"),
                      F.when(F.col("bin_count").isNull(), F.lit(0.0)).otherwise(F.abs(rate - mean)).alias("calibration_gap"))


def ece_mce(bins: DataFrame) -> DataFrame:
    """Expected (count-weighted) and largest gap."""
    n = F.sum("bin_count").cast("double")
    return bins.agg(F.when(n > 0, F.sum(F.col("bin_count") * F.col("calibration_gap")) / n).otherwise(F.lit(0.0)).alias("ece"),
                    F.coalesce(F.max("calibration_gap"), F.lit(0.0)).alias("mce"))


def brier(df: DataFrame, score: str = "predicted_score", label: str = "is_abuse") -> DataFrame:
    d = F.col(score).cast("double") - F.col(label).cast("double")
    return df.agg(F.avg(d * d).alias("brier"))
