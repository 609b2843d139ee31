"""Splits and event-level evaluation of scored orders.

Scored frames carry ``is_abuse`` (0/1), ``predicted_score`` and, for losses, ``loss_amount``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import beside, guarded_ratio
from coterie.operators.asof import timed
from coterie.operators.ordering import order_statistics, running

# Default review and block costs, and the default threshold grid.
REVIEW_COST, BLOCK_COST = 2.0, 10.0
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)


# ---- splits -------------------------------------------------------------------------------------

def time_cuts(orders: DataFrame, train: float = 0.70, validation: float = 0.15) -> tuple[int, int]:
    """The two cut times in microseconds: event time at sorted index int(n * ratio) - 1."""
    if not 0 < train < 1 or not 0 < validation < 1 or train + validation >= 1:
        raise ValueError("invalid split ratios")

    def at(n: int, share: float) -> int:
        return max(0, int(n * share) - 1)

    # seconds and microseconds apart: each stays exact as a double
    whole = timed(orders).select("t")
    seen: list[int] = []

    def ranks(n: int) -> list[int]:
        seen.append(n)
        return [at(n, train), at(n, train + validation)]

    # microseconds since 1970 stay below 2^53 until the year 2255, so doubles hold them exactly
    stats = order_statistics(whole, "t", ranks)[None]
    n = seen[0]
    return int(stats[at(n, train)]), int(stats[at(n, train + validation)])


def split_by_time(orders: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Add ``split``; orders at a cut time all go to its left, so ties never straddle."""
    a, b = time_cuts(orders, train, validation)
    return split_at(orders, [a, b], ["train", "validation", "test"])


def split_at(orders: DataFrame, cuts_us: list[int], names: list[str], column: str = "split") -> DataFrame:
    """Label orders by given cut times (``<=`` goes left)."""
    t = F.unix_micros(F.col("event_time").cast("timestamp"))
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts_us, names))):
        out = F.when(t <= F.lit(cut), name).otherwise(out)
    return orders.withColumn(column, out)


def split_by_boundaries(orders: DataFrame, train_end: int, validation_end: int, test_end: int) -> DataFrame:
    return split_at(orders, [train_end, validation_end, test_end], ["train", "validation", "previous_test", "holdout"])


def rolling_windows(orders: DataFrame, n: int = 3) -> DataFrame:
    """Add ``window_no`` 1..n: equal row counts in (time, id) order, the last takes the rest."""
    rows = timed(orders)
    total: list[int] = []

    def ranks(size: int) -> list[int]:
        total.append(size)
        return [k * (size // n) for k in range(1, n) if size // n > 0]

    stats = order_statistics(rows, "t", ranks)[None]
    size = total[0] if total else 0
    out, window_no = rows, F.lit(n if size // n > 0 or not size else n)
    cuts = [(k, k * (size // n), int(stats[k * (size // n)])) for k in range(1, n) if size // n > 0]
    if cuts:
        # only the orders of a cut instant need a rank; everything else is decided by its time
        instants = sorted({c[2] for c in cuts})
        tie = rows.filter(F.col("t").isin(*instants)).select(
            "order_id", F.row_number().over(Window.partitionBy("t").orderBy("order_id")).alias("_tie"))
        below = rows.agg(*[F.count_if(F.col("t") < F.lit(i)).alias(f"b{k}") for k, i in enumerate(instants)]).first()
        out = rows.join(tie, "order_id", "left")
        for k, rank, instant in reversed(cuts):
            first_ties = rank - below[instants.index(instant)]
            early = (F.col("t") < F.lit(instant)) | ((F.col("t") == F.lit(instant)) & (F.col("_tie") <= F.lit(first_ties)))
            window_no = F.when(early, F.lit(k)).otherwise(window_no)
    return out.select(*orders.columns, window_no.cast("int").alias("window_no"))


# ---- confusion, thresholds, losses --------------------------------------------------------------

def _flags(threshold: Column | float, score: str, label: str) -> tuple[Column, Column]:
    t = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    return F.col(score) >= t, F.col(label).cast("int") == 1


def confusion_aggs(threshold=0.5, score="predicted_score", label="is_abuse", tag="") -> list[Column]:
    hit, bad = _flags(threshold, score, label)
    return [F.count_if(hit & bad).alias(f"tp{tag}"), F.count_if(hit & ~bad).alias(f"fp{tag}"),
            F.count_if(~hit & bad).alias(f"fn{tag}"), F.count_if(~hit & ~bad).alias(f"tn{tag}")]


def rates(df: DataFrame) -> DataFrame:
    """precision / recall / f1 / error rates from tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select(
        "*", guarded_ratio(tp, tp + fp).alias("precision"), guarded_ratio(tp, tp + fn).alias("recall"),
        guarded_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        guarded_ratio(fp, fp + tn).alias("false_positive_rate"), guarded_ratio(fn, fn + tp).alias("false_negative_rate"))


def confusion_metrics(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None,
                      score: str = "predicted_score", label: str = "is_abuse") -> DataFrame:
    counted = df.groupBy(*(by or [])).agg(*confusion_aggs(threshold, score, label), F.count("*").alias("orders"))
    return rates(counted).withColumn("alerts", F.col("tp") + F.col("fp"))


def threshold_table(df: DataFrame, thresholds=THRESHOLDS, review_cost: float = REVIEW_COST,
                    block_cost: float = BLOCK_COST, by: list[str] | None = None) -> DataFrame:
    """One row per threshold from a single aggregate: a cell per threshold instead of a row copy."""
    aggs: list[Column] = [F.count("*").alias("orders")]
    for k, t in enumerate(thresholds):
        hit, bad = _flags(t, "predicted_score", "is_abuse")
        aggs += confusion_aggs(t, tag=f"_{k}")
        aggs.append(F.coalesce(F.sum(F.when(~hit & bad, F.col("loss_amount"))), F.lit(0.0)).alias(f"missed_{k}"))
    wide = df.groupBy(*(by or [])).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                               *[F.col(f"{m}_{k}").alias(m) for m in ("tp", "fp", "fn", "tn", "missed")])
                      for k, t in enumerate(thresholds)])
    long = rates(wide.select(*(by or []), "orders", F.inline(cells)))
    return long.select(
        *(by or []), "threshold", (F.col("tp") + F.col("fp")).alias("alerts"),
        guarded_ratio(F.col("tp") + F.col("fp"), F.col("orders")).alias("alert_rate"),
        "precision", "recall", "f1",
        (F.col("missed") + F.col("fp") * F.lit(review_cost + block_cost)).alias("expected_loss"),
        "tp", "fp", "fn")


def choose_threshold(table: DataFrame) -> DataFrame:
    """The row with the least expected loss, ties to the lowest threshold."""
    return table.orderBy("expected_loss", "threshold").limit(1).select("threshold", "expected_loss")


def expected_loss(df: DataFrame, threshold: float = 0.5, review_cost: float = REVIEW_COST,
                  block_cost: float = BLOCK_COST, formula: str = "standard") -> DataFrame:
    """``standard``: missed + fp * (review + block); ``bootstrap``: fp * block + missed + tp * review;
    ``friction``: missed amount + 5 % of the amount of false positives."""
    hit, bad = _flags(threshold, "predicted_score", "is_abuse")
    amount = "amount" if formula == "friction" else "loss_amount"
    missed = F.coalesce(F.sum(F.when(~hit & bad, F.col(amount))), F.lit(0.0))
    fp, tp = F.count_if(hit & ~bad).cast("double"), F.count_if(hit & bad).cast("double")
    if formula == "standard":
        loss = missed + fp * F.lit(review_cost + block_cost)
    elif formula == "bootstrap":
        loss = missed + fp * F.lit(block_cost) + tp * F.lit(review_cost)
    elif formula == "friction":
        loss = missed + F.coalesce(F.sum(F.when(hit & ~bad, F.col("amount"))), F.lit(0.0)) * F.lit(0.05)
    else:
        raise ValueError(f"unknown loss formula: {formula}")
    return df.agg(loss.alias("expected_loss"))


def error_audit(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Orders, amount and friction by outcome (TP, FP, FN, TN)."""
    hit, bad = _flags(threshold, "predicted_score", "is_abuse")
    outcome = F.when(hit & bad, "TP").when(hit, "FP").when(bad, "FN").otherwise("TN")
    return df.groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("orders"), F.sum("amount").alias("exposure"),
        F.sum(F.when(hit & ~bad, F.col("amount") * F.lit(0.05)).otherwise(F.lit(0.0))).alias("friction"))


# ---- ranking quality ----------------------------------------------------------------------------

def score_ladder(df: DataFrame, by: list[str] | None = None, score: str = "predicted_score",
                 label: str = "is_abuse", weight: Column | None = None) -> DataFrame:
    """Per distinct score, from the highest: rows, positives and their running sums."""
    w = F.lit(1) if weight is None else weight
    rows = df.select(*(by or []), F.col(score).alias("score"), w.cast("long").alias("n"),
                     (F.col(label).cast("long") * w).cast("long").alias("pos"))
    return running(rows, "score", ["n", "pos"], by, descending=True)


def ranking_metrics(df: DataFrame, by: list[str] | None = None, score: str = "predicted_score",
                    label: str = "is_abuse", weight: Column | None = None, one_class_roc: float | None = None) -> DataFrame:
    """average_precision (step-wise), pr_auc_trapezoid and roc_auc in one pass over the score ladder."""
    steps = score_ladder(df, by, score, label, weight)
    d = {c: F.col(c).cast("double") for c in ("n", "pos", "cum_n", "cum_pos")}
    prec = d["cum_pos"] / d["cum_n"]
    before_n, before_pos = d["cum_n"] - d["n"], d["cum_pos"] - d["pos"]
    prec_before = F.when(before_n > 0, before_pos / before_n).otherwise(F.lit(1.0))
    out = steps.groupBy(*(by or [])).agg(
        F.sum(d["pos"]).alias("_p"), F.sum(d["n"] - d["pos"]).alias("_q"),
        F.sum(d["pos"] * prec).alias("_ap"), F.sum(d["pos"] * (prec + prec_before) / F.lit(2.0)).alias("_tr"),
        F.sum((d["n"] - d["pos"]) * (before_pos + d["pos"] / F.lit(2.0))).alias("_auc"))
    p, q = F.col("_p"), F.col("_q")
    return out.select(
        *(by or []), guarded_ratio(F.col("_ap"), p).alias("average_precision"),
        guarded_ratio(F.col("_tr"), p).alias("pr_auc_trapezoid"),
        F.when((p > 0) & (q > 0), F.col("_auc") / (p * q)).otherwise(
            F.lit(one_class_roc).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranking_metrics(df, by).select(*(by or []), "average_precision")


def pr_auc_trapezoid(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranking_metrics(df, by).select(*(by or []), "pr_auc_trapezoid")


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranking_metrics(df, by).select(*(by or []), "roc_auc")


def evaluate_predictions(df: DataFrame, threshold: float = 0.5, review_cost: float = REVIEW_COST,
                         block_cost: float = BLOCK_COST) -> DataFrame:
    """One row with every event-level metric."""
    return (beside(confusion_metrics(df, threshold), ranking_metrics(df).drop("pr_auc_trapezoid"),
                   expected_loss(df, threshold, review_cost, block_cost))
            .withColumn("threshold", F.lit(float(threshold))))


# ---- composed studies ---------------------------------------------------------------------------

def delayed_label_evaluation(log: DataFrame, labels: DataFrame, orders: DataFrame | None = None,
                             threshold: float = 0.5) -> DataFrame:
    """Scores that later met a label: counts, rates, ranking quality and amounts, with a status."""
    if "order_id" not in log.columns or "calibrated_score" not in log.columns:
        return log.sparkSession.range(1).select(F.lit("INVALID_SHADOW_LOG_FORMAT").alias("evaluation_status"))
    label = "is_abuse" if "is_abuse" in labels.columns else "label"
    met = log.select("order_id", "calibrated_score").join(
        labels.select("order_id", F.col(label).cast("int").alias("is_abuse")), "order_id")
    met = (met.join(orders.select("order_id", F.col("amount").cast("double")), "order_id", "left")
           if orders is not None else met.withColumn("amount", F.lit(None).cast("double")))
    amount = F.coalesce("amount", F.lit(0.0))
    hit, bad = _flags(threshold, "calibrated_score", "is_abuse")

    def money(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, amount)), F.lit(0.0))

    counts = rates(met.agg(
        *confusion_aggs(threshold, "calibrated_score"), F.count("*").alias("matched_orders"),
        money(bad).alias("abuse_exposure"), money(bad & hit).alias("captured_exposure"),
        money(bad & ~hit).alias("missed_exposure"), money(~bad & hit).alias("fp_friction")))
    quality = ranking_metrics(met, score="calibrated_score", one_class_roc=0.5)
    seen = log.agg(F.count("*").alias("_log"))
    status = (F.when(F.col("_log") == 0, "NO_SHADOW_DATA").when(F.col("matched_orders") == 0, "NO_MATCHED_LABELS")
              .otherwise("EVALUATED_WITH_LABELS"))
    return beside(counts, quality, seen).select(
        status.alias("evaluation_status"), "matched_orders", "tp", "fp", "fn", "tn", "precision", "recall", "f1",
        F.col("pr_auc_trapezoid").alias("pr_auc"), "roc_auc", "false_positive_rate", "false_negative_rate",
        "abuse_exposure", "captured_exposure",
        (guarded_ratio(F.col("captured_exposure"), F.col("abuse_exposure")) * 100).alias("captured_exposure_pct"),
        "missed_exposure", "fp_friction")


def cohort_fp_rates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """False positives among legitimate orders, for the orders that share something.

    Cohorts: address, device, IP and payment values with several legitimate customers, and customers
    with several payment values; plus all legitimate orders.
    """
    legit = df.filter(F.col("is_abuse").cast("int") == 0).withColumn(
        "fp", (F.col("predicted_score") >= F.lit(threshold)).cast("long"))
    parts = []
    for cohort, key, other in (
        ("shared_address", "address_id", "customer_id"), ("shared_device", "device_id", "customer_id"),
        ("shared_ip", "ip_id", "customer_id"), ("multi_card", "customer_id", "payment_id"),
        ("shared_card", "payment_id", "customer_id"),
    ):
        # one row per (key, other) first: a hot key is combined before it meets its partners
        cells = legit.groupBy(key, other).agg(F.count("*").alias("orders"), F.sum("fp").alias("fps"))
        per = cells.filter(F.col(key).isNotNull()).groupBy(key).agg(
            F.count(other).alias("sharers"), F.sum("orders").alias("orders"), F.sum("fps").alias("fps"))
        parts.append(per.filter("sharers > 1").agg(F.sum("orders").alias("orders"), F.sum("fps").alias("false_positives"))
                     .withColumn("cohort", F.lit(cohort)))
    parts.append(legit.agg(F.count("*").alias("orders"), F.sum("fp").alias("false_positives"))
                 .withColumn("cohort", F.lit("all_legitimate")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    orders, fps = F.coalesce("orders", F.lit(0)), F.coalesce("false_positives", F.lit(0))
    return out.select("cohort", orders.cast("long").alias("orders"), fps.cast("long").alias("false_positives"),
                      guarded_ratio(fps, orders).alias("fp_rate"))


def model_summary_over_runs(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, least and largest of each metric per model over seeds and splits."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return runs.groupBy("model").agg(F.count("*").alias("runs"), *aggs)
