"""Distribution shift of feature columns between two frames."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import drift_status
from coterie.operators.ordering import quantiles, running
from coterie.sources.scratch import materialise

FLOOR = 1e-5


def _melt(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def psi(expected: DataFrame, actual: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi).

    Bins lie between the distinct quantiles of ``expected``, open at both ends, with empty shares
    raised to 1e-5.  A column of one or two values is compared value by value instead.
    """
    spark = expected.sparkSession
    e, a = materialise(_melt(expected, cols), "psi-expected"), materialise(_melt(actual, cols), "psi-actual")
    probs = [k / bins for k in range(bins + 1)]
    edges = quantiles(e, "value", probs, by="feature")
    if not edges:
        return spark.createDataFrame([(c, 0.0) for c in cols], "feature string, psi double")
    # "at most two values" needs no distinct count: true when nothing lies strictly between min and max
    lo_hi = {f: (v[0], v[-1]) for f, v in edges.items()}
    limits = spark.createDataFrame([(f, lo, hi, sorted(set(edges[f]))) for f, (lo, hi) in lo_hi.items()],
                                   "feature string, lo double, hi double, edges array<double>")
    limits = F.broadcast(limits)
    few = e.join(limits, "feature").groupBy("feature").agg(
        F.max(((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))).cast("int")).alias("mid"))
    few = F.broadcast(few.select("feature", (F.col("mid") == 0).alias("categorical")))
    rows = e.withColumn("side", F.lit("e")).unionByName(a.withColumn("side", F.lit("a"))).join(limits, "feature").join(few, "feature")
    # interior edges at or below the value = the bin; histogram bins are closed on the left
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    cell = F.when(F.col("categorical"), F.col("value")).otherwise(
        F.size(F.filter(inner, lambda x: x <= F.col("value"))).cast("double"))
    cells = rows.groupBy("feature", "categorical", cell.alias("cell")).agg(
        F.count_if(F.col("side") == "e").alias("ne"), F.count_if(F.col("side") == "a").alias("na"))
    tot = Window.partitionBy("feature")
    share = cells.select("feature", "categorical", "cell",
                         "ne", "na", F.sum("ne").over(tot).cast("double").alias("te"), F.sum("na").over(tot).cast("double").alias("ta"))
    pe, pa = F.col("ne") / F.col("te"), F.col("na") / F.col("ta")
    pe_, pa_ = F.when(pe == 0, F.lit(FLOOR)).otherwise(pe), F.when(pa == 0, F.lit(FLOOR)).otherwise(pa)
    term = F.when(F.col("categorical"), (pa_ - pe_) * F.log((pa_ + F.lit(FLOOR)) / (pe_ + F.lit(FLOOR)))).otherwise(
        (pa_ - pe_) * F.log(pa_ / pe_))
    # histogram bins empty on both sides add (floor - floor) * 0 = 0, so missing cells need no row
    got = share.filter("te > 0 and ta > 0").groupBy("feature").agg(F.sum(term).alias("psi"))
    grid = spark.createDataFrame([(c,) for c in cols], "feature string")
    return grid.join(F.broadcast(got), "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi_by(expected: DataFrame, actual: DataFrame, column: str, by: str, bins: int = 10) -> DataFrame:
    """(by, psi): shift of a continuous column in every group of ``actual`` (a day, a model) against all of ``expected``.

    Bins and floor as in ``psi``. One aggregation counts the bins of all groups; rows without a value take no part, and
    without any expected value the result is empty."""
    v = F.col(column).cast("double")
    edges = quantiles(expected, column, [k / bins for k in range(bins + 1)]).get(None, [])
    inner = sorted(set(edges))[1:-1]
    place = sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    counts = [F.count_if(place == k).cast("double").alias(f"n{k}") for k in range(len(inner) + 1)]
    some = v.isNotNull() & ~F.isnan(v)
    base = expected.filter(some).agg(*counts).first()
    before = [n / sum(base) if n else FLOOR for n in base] if edges else []
    per = actual.filter(some & F.lit(bool(edges))).groupBy(by).agg(*counts, F.count("*").alias("_n"))
    terms = [(p - F.lit(q)) * F.log(p / F.lit(q)) for k, q in enumerate(before) for p in [F.when(F.col(f"n{k}") == 0, FLOOR).otherwise(F.col(f"n{k}") / F.col("_n"))]]
    return per.select(by, sum(terms, F.lit(0.0)).alias("psi"))


def wasserstein_1d(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, wasserstein): area between the two distribution functions."""
    rows = (_melt(a, cols).select("feature", "value", F.lit(1).alias("na"), F.lit(0).alias("nb"))
            .unionByName(_melt(b, cols).select("feature", "value", F.lit(0).alias("na"), F.lit(1).alias("nb"))))
    rows = materialise(rows, "wasserstein")
    steps = running(rows, "value", ["na", "nb"], ["feature"])
    size = F.broadcast(rows.groupBy("feature").agg(F.sum("na").cast("double").alias("ta"), F.sum("nb").cast("double").alias("tb")))
    gap = F.abs(F.col("cum_na") / F.col("ta") - F.col("cum_nb") / F.col("tb")) * (F.col("next_value") - F.col("value"))
    return steps.join(size, "feature").groupBy("feature").agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("wasserstein"))


def drift_report(train: DataFrame, validation: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """(report, skipped names): means, PSI to validation and test, Wasserstein distance, status."""
    have = [c for c in cols if c in train.columns]
    skipped = [c for c in cols if c not in train.columns]
    means = _melt(train, have).groupBy("feature").agg(F.avg("value").alias("train_mean")).join(
        _melt(test, have).groupBy("feature").agg(F.avg("value").alias("test_mean")), "feature", "left")
    out = (means.join(psi(train, validation, have).withColumnRenamed("psi", "psi_train_vs_val"), "feature")
           .join(psi(train, test, have).withColumnRenamed("psi", "psi_train_vs_test"), "feature")
           .join(wasserstein_1d(train, test, have).withColumnRenamed("wasserstein", "wasserstein_train_vs_test"), "feature"))
    return out.select("feature", F.col("feature").contains("subgraph_").alias("is_subgraph"), "train_mean", "test_mean",
                      "psi_train_vs_val", "psi_train_vs_test", "wasserstein_train_vs_test",
                      drift_status("psi_train_vs_test").alias("drift_status")), skipped
