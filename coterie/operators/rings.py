"""Ring-level and queue-level evaluation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import beside, guarded_ratio
from coterie.operators.graph import consolidate_alerts
from coterie.operators.ordering import order_statistics, quantiles
from coterie.schema import ENTITY_COLUMNS
from coterie.sources.scratch import materialise

# Member coverage that counts as detected (rules B and C), and the queue sizes.
RULE_B, RULE_C = 0.20, 0.50
TOP_K = (5, 10, 20, 50, 100)


def evaluation_frame(orders: DataFrame, labels: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """orders with labels and scores attached after scoring; ``alert`` = score reaches the threshold."""
    return (orders.select("order_id", "customer_id", "event_time", "amount")
            .join(labels.select("order_id", F.col("is_abuse").cast("int").alias("is_abuse"), "ring_id", "abuse_type",
                                F.coalesce(F.col("loss_amount").cast("double"), F.lit(0.0)).alias("loss_amount")), "order_id")
            .join(scores.select("order_id", "predicted_score"), "order_id")
            .withColumn("alert", F.col("predicted_score") >= F.lit(float(threshold))))


def _abuse(scored: DataFrame) -> DataFrame:
    return scored.filter((F.col("is_abuse").cast("int") == 1) & F.col("ring_id").isNotNull())


def per_ring(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per ring with abusive orders: members reached, rules A / B / C, exposure, hours to the first flag."""
    t = F.unix_micros(F.col("event_time").cast("timestamp"))
    rows = _abuse(scored).select("ring_id", "customer_id", "abuse_type", "loss_amount", "order_id", t.alias("t"),
                                 (F.col("predicted_score") >= F.lit(float(threshold))).alias("hit"))
    # (ring, member) cells first, so a huge ring is combined on the map side
    member = rows.groupBy("ring_id", "customer_id").agg(
        F.count("*").alias("orders"), F.count_if("hit").alias("flagged"), F.sum("loss_amount").alias("exposure"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("loss_amount"))), F.lit(0.0)).alias("captured"),
        F.min("t").alias("first_t"), F.min(F.when(F.col("hit"), F.col("t"))).alias("first_hit"),
        F.min(F.struct("t", "order_id", "abuse_type")).alias("lead"))
    ring = member.groupBy("ring_id").agg(
        F.min("lead").getField("abuse_type").alias("ring_type"), F.sum("orders").alias("test_orders"),
        F.sum("flagged").alias("flagged_orders"), F.count("*").alias("test_members"),
        F.count_if(F.col("flagged") > 0).alias("flagged_members"), F.sum("exposure").alias("exposure"),
        F.sum("captured").alias("exposure_captured"), F.min("first_t").alias("first_t"), F.min("first_hit").alias("first_hit"))
    coverage = F.col("flagged_members").cast("double") / F.col("test_members").cast("double")
    return ring.select(
        "ring_id", "ring_type", "test_orders", "flagged_orders", "test_members", "flagged_members",
        coverage.alias("coverage"), (F.col("flagged_members") >= 1).alias("detected_rule_a"),
        (coverage >= F.lit(RULE_B)).alias("detected_rule_b"), (coverage >= F.lit(RULE_C)).alias("detected_rule_c"),
        "exposure", "exposure_captured",
        (guarded_ratio(F.col("exposure_captured"), F.col("exposure")) * 100).alias("exposure_captured_pct"),
        ((F.col("first_hit") - F.col("first_t")).cast("double") / F.lit(3.6e9)).alias("latency_hours"))


def _share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ring_summary(rings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: rule counts and recalls, coverage and latency statistics, exposure."""
    rings = materialise(rings, "rings")
    mid = quantiles(rings, "coverage", [0.5]).get(None, [0.0])[0]
    late = quantiles(rings, "latency_hours", [0.5]).get(None, [None])[0]
    out = rings.agg(
        F.count("*").alias("total_test_rings"), F.coalesce(F.sum("test_orders"), F.lit(0)).alias("total_test_abuse_orders"),
        _zero(F.sum("exposure")).alias("total_test_exposure"),
        *[F.count_if(f"detected_rule_{r}").alias(f"rule_{r}_detected_count") for r in "abc"],
        *[_zero(_share(f"detected_rule_{r}")).alias(f"rule_{r}_recall") for r in "abc"],
        _zero(F.avg("coverage")).alias("mean_member_coverage"),
        _zero(F.stddev_samp("coverage")).alias("std_member_coverage"),
        _zero(F.min("coverage")).alias("min_member_coverage"), _zero(F.max("coverage")).alias("max_member_coverage"),
        _zero(F.sum("exposure_captured")).alias("total_exposure_captured"),
        F.avg("latency_hours").alias("latency_mean_hours"), F.min("latency_hours").alias("latency_min_hours"),
        F.max("latency_hours").alias("latency_max_hours"),
        F.when(F.count("latency_hours") == 1, F.lit(0.0)).otherwise(F.stddev_samp("latency_hours")).alias("latency_std_hours"),
        F.count("latency_hours").alias("latency_count"))
    return out.select(
        F.lit(float(threshold)).alias("threshold"), "*",
        (guarded_ratio(F.col("total_exposure_captured"), F.col("total_test_exposure")) * 100).alias("exposure_captured_pct"),
        F.lit(mid).cast("double").alias("median_member_coverage"), F.lit(late).cast("double").alias("latency_median_hours"))


def by_ring_type(rings: DataFrame) -> DataFrame:
    rings = materialise(rings, "rings")
    medians = quantiles(rings, "coverage", [0.5], by="ring_type")
    med = rings.sparkSession.createDataFrame([(k, v[0]) for k, v in medians.items()],
                                             "ring_type string, median_coverage double")
    out = rings.groupBy("ring_type").agg(
        F.count("*").alias("rings"), *[_share(f"detected_rule_{r}").alias(f"rule_{r}_recall") for r in "abc"],
        F.avg("coverage").alias("mean_coverage"), F.sum("exposure").alias("total_exposure"),
        F.sum("exposure_captured").alias("exposure_captured"))
    return out.join(F.broadcast(med), "ring_type").withColumn(
        "exposure_captured_pct", guarded_ratio(F.col("exposure_captured"), F.col("total_exposure")) * 100)


def _queue_order() -> list[Column]:
    return [F.col("predicted_score").desc(), F.col("event_time").asc(), F.col("order_id").asc()]


def top_k(scored: DataFrame, ks=TOP_K) -> DataFrame:
    """Queue quality at the first k alerts; ring rules and mean coverage run over all active rings."""
    limit = max(ks)
    # at most max(ks) rows survive the distributed top-k, so the ranking window is bounded
    head = (scored.orderBy(*_queue_order()).limit(limit)
            .withColumn("rank", F.row_number().over(Window.orderBy(*_queue_order()))))
    abuse = _abuse(scored)
    members = (abuse.select("ring_id", "customer_id").distinct().groupBy("ring_id").agg(F.count("*").alias("members")))
    loss = abuse.agg(F.coalesce(F.sum("loss_amount"), F.lit(0.0)).alias("total_loss"))
    active = members.agg(F.count("*").alias("rings"))
    cut = head.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    bad = F.col("is_abuse").cast("int") == 1
    queue = cut.groupBy("k").agg(
        F.count("*").alias("taken"), F.count_if(bad).alias("tp_count"), F.count_if(~bad).alias("fp_count"),
        F.coalesce(F.sum(F.when(bad, F.col("loss_amount"))), F.lit(0.0)).alias("exposure_captured"))
    reached = (cut.filter(bad & F.col("ring_id").isNotNull()).groupBy("k", "ring_id")
               .agg(F.count_distinct("customer_id").alias("flagged")))
    # the touched rings are at most max(ks); untouched ones add zero coverage
    cov = F.col("flagged").cast("double") / F.col("members").cast("double")
    touched = members.join(F.broadcast(reached), "ring_id").groupBy("k").agg(
        F.count("*").alias("rings_touched"), F.count_if(cov >= RULE_B).alias("rule_b_detected"),
        F.count_if(cov >= RULE_C).alias("rule_c_detected"), F.sum(cov).alias("coverage_sum"))
    grid = scored.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    out = beside(grid.join(queue, "k", "left").join(touched, "k", "left"), loss, active).fillna(0).fillna(0.0)
    rings = F.col("rings")
    return out.select(
        "k", guarded_ratio(F.col("tp_count"), F.col("taken")).alias("precision"), "tp_count", "fp_count", "rings_touched",
        F.col("rings_touched").alias("rule_a_detected"), guarded_ratio(F.col("rings_touched"), rings).alias("rule_a_recall"),
        "rule_b_detected", guarded_ratio(F.col("rule_b_detected"), rings).alias("rule_b_recall"),
        "rule_c_detected", guarded_ratio(F.col("rule_c_detected"), rings).alias("rule_c_recall"),
        guarded_ratio(F.col("coverage_sum"), rings).alias("mean_coverage"), "exposure_captured",
        (guarded_ratio(F.col("exposure_captured"), F.col("total_loss")) * 100).alias("exposure_captured_pct"))


def first_in_queue(scored: DataFrame, k: int) -> DataFrame:
    """The first k rows of the queue for a k that grows with the table: cut by rank, not by a sort in one task."""
    if k <= 0:
        return scored.limit(0)
    rows = scored.withColumn("_s", -F.col("predicted_score")).withColumn(
        "_t", F.unix_micros(F.col("event_time").cast("timestamp")))
    s = order_statistics(rows, "_s", lambda n: [min(k, n) - 1])[None]
    if not s:
        return scored.limit(0)
    s_cut = next(iter(s.values()))
    ahead = rows.agg(F.count_if(F.col("_s") < F.lit(s_cut))).first()[0]
    tied = rows.filter(F.col("_s") == F.lit(s_cut))
    t_cut = next(iter(order_statistics(tied, "_t", lambda n: [min(k - ahead, n) - 1])[None].values()))
    early = tied.agg(F.count_if(F.col("_t") < F.lit(t_cut))).first()[0]
    last = tied.filter(F.col("_t") == F.lit(t_cut)).orderBy("order_id").limit(k - ahead - early)
    sure = rows.filter((F.col("_s") < F.lit(s_cut)) | ((F.col("_s") == F.lit(s_cut)) & (F.col("_t") < F.lit(t_cut))))
    return sure.unionByName(last).drop("_s", "_t")


def top_fraction(scored: DataFrame, fractions=(0.01, 0.05)) -> DataFrame:
    """Queue quality for budgets given as a share of all orders."""
    n = scored.count()
    out = None
    for f in fractions:
        k = int(n * f)
        bad = F.col("is_abuse").cast("int") == 1
        row = first_in_queue(scored, k).agg(
            F.count("*").alias("taken"), F.count_if(bad).alias("tp_count"),
            F.coalesce(F.sum(F.when(bad, F.col("loss_amount"))), F.lit(0.0)).alias("exposure_captured"),
            F.count_distinct(F.when(bad, F.col("ring_id"))).alias("rings_touched"))
        row = row.select(F.lit(float(f)).alias("fraction"), "taken", "tp_count",
                         guarded_ratio(F.col("tp_count"), F.col("taken")).alias("precision"), "rings_touched", "exposure_captured")
        out = row if out is None else out.unionByName(row)
    return out


def queue_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Orders in the first k of both queues."""
    return (a.orderBy(*_queue_order()).limit(k).select("order_id")
            .join(b.orderBy(*_queue_order()).limit(k).select("order_id"), "order_id", "left_semi"))


# Row labels of the comparison table with their source column and format.
_COMPARISON = (
    ("Event Precision", "precision", 3), ("Event Recall", "recall", 3), ("Event F1", "f1", 3),
    ("PR-AUC", "average_precision", 3), ("ROC-AUC", "roc_auc", 3),
)
_RULES = (("Any-member Ring Recall (Rule A)", "a"), ("20% Coverage Ring Recall (Rule B)", "b"),
          ("50% Coverage Ring Recall (Rule C)", "c"))


def comparison_rows(model: str, event: DataFrame, summary: DataFrame, queue: DataFrame) -> DataFrame:
    """The 19 formatted metrics of one model, as (position, metric, model, value)."""
    def f(c: Column, d: int = 3) -> Column:
        return F.format_string(f"%.{d}f", c)

    def inr(amount: Column, pct: Column | None = None) -> Column:
        # the sum's last bits depend on the order of the rows: drop them before two places are cut
        money = F.concat(F.lit("INR "), F.format_number(F.round(amount, 6), 2))
        return money if pct is None else F.concat(money, F.lit(" ("), f(pct, 1), F.lit("%)"))

    ev = [F.struct(F.lit(k).alias("position"), F.lit(label).alias("metric"), f(F.col(c), d).alias("value"))
          for k, (label, c, d) in enumerate(_COMPARISON)]
    ev.append(F.struct(F.lit(11).alias("position"), F.lit("Expected Financial Loss").alias("metric"),
                       inr(F.col("expected_loss")).alias("value")))
    sm = [F.struct(F.lit(5 + k).alias("position"), F.lit(label).alias("metric"),
                   F.concat(f(F.col(f"rule_{r}_recall")), F.lit(" ("), F.col(f"rule_{r}_detected_count"), F.lit("/"),
                            F.col("total_test_rings"), F.lit(")")).alias("value"))
          for k, (label, r) in enumerate(_RULES)]
    for pos, label, value in (
        (8, "Mean Member Coverage", f(F.col("mean_member_coverage"))),
        (9, "Median Member Coverage", f(F.col("median_member_coverage"))),
        (10, "Exposure Captured at Threshold", inr(F.col("total_exposure_captured"), F.col("exposure_captured_pct"))),
        (17, "Mean Detection Latency (hours)", F.coalesce(f(F.col("latency_mean_hours"), 1), F.lit("N/A"))),
        (18, "Median Detection Latency (hours)", F.coalesce(f(F.col("latency_median_hours"), 1), F.lit("N/A"))),
    ):
        sm.append(F.struct(F.lit(pos).alias("position"), F.lit(label).alias("metric"), value.alias("value")))
    tk = queue.filter(F.col("k").isin(*TOP_K)).select(
        (F.lit(12) + F.array_position(F.array(*[F.lit(k) for k in TOP_K]), F.col("k")).cast("int") - 1).alias("position"),
        F.concat(F.lit("Top-"), F.col("k"), F.lit(" Exposure Captured")).alias("metric"),
        inr(F.col("exposure_captured"), F.col("exposure_captured_pct")).alias("value"))
    return (event.select(F.inline(F.array(*ev))).unionByName(summary.select(F.inline(F.array(*sm)))).unionByName(tk)
            .withColumn("model", F.lit(model)))


def compare_models(parts: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """metric x model table; ``parts[model]`` = (event metrics row, ring summary row, top-k table)."""
    long = None
    for model, (event, summary, queue) in parts.items():
        rows = comparison_rows(model, event, summary, queue)
        long = rows if long is None else long.unionByName(rows)
    return long.groupBy("position", "metric").pivot("model", list(parts)).agg(F.first("value"))


def ring_type_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ``by_ring_type`` tables side by side with lifts of b over a."""
    pick = ("rings", "total_exposure", "rule_a_recall", "rule_b_recall", "rule_c_recall", "mean_coverage",
            "exposure_captured_pct")
    left = a.select("ring_type", *[F.col(c).alias(f"a_{c}") for c in pick])
    right = b.select("ring_type", *[F.col(c).alias(f"b_{c}") for c in pick])
    j = left.join(right, "ring_type", "full_outer")

    def z(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    lift = z("b_rule_c_recall") - z("a_rule_c_recall")
    return j.select(
        "ring_type", F.coalesce("b_rings", F.lit(0)).alias("active_rings"), z("b_total_exposure").alias("total_exposure"),
        *[z(f"{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c in pick[2:]], lift.alias("rule_c_lift"),
        (z("b_mean_coverage") - z("a_mean_coverage")).alias("coverage_lift"),
        F.when(lift > 0, "LIFT").when(lift == 0, "PARITY").otherwise("REGRESSION").alias("regression_status"))


def daily_workload(scored: DataFrame, threshold: float = 0.5, typed: bool = True) -> DataFrame:
    """Per day: orders, alerts, consolidated cases of that day, false positives, exposure."""
    day = F.to_date(F.col("event_time").cast("timestamp")).cast("string").alias("date")
    rows = scored.select("*", day)
    bad, hit = F.col("is_abuse").cast("int") == 1, F.col("predicted_score") >= F.lit(float(threshold))
    per_day = rows.groupBy("date").agg(
        F.count("*").alias("total_orders"), F.count_if(hit).alias("raw_alerts"),
        F.count_if(hit & ~bad).alias("false_positives"),
        F.coalesce(F.sum(F.when(hit & bad, F.col("loss_amount"))), F.lit(0.0)).alias("exposure_captured"))
    cases = (consolidate_alerts(rows.filter(hit), typed=typed, per="date").groupBy("date")
             .agg(F.count_distinct("case_id").alias("consolidated_cases")))
    out = per_day.join(cases, "date", "left").withColumn("consolidated_cases", F.coalesce("consolidated_cases", F.lit(0)))
    n, c = F.col("raw_alerts").cast("double"), F.col("consolidated_cases").cast("double")
    return out.select(
        "date", "total_orders", "raw_alerts", "consolidated_cases", "false_positives", "exposure_captured",
        (F.col("exposure_captured") / F.greatest(F.lit(1.0), c)).alias("exposure_per_case"),
        F.when(n > 0, (F.lit(1.0) - c / n) * 100).otherwise(F.lit(0.0)).alias("workload_reduction_pct"))


def workload_summary(daily: DataFrame) -> DataFrame:
    a, c = F.sum("raw_alerts").cast("double"), F.sum("consolidated_cases").cast("double")
    mean_c = F.avg("consolidated_cases")
    return daily.agg(
        F.count("*").alias("evaluation_days"), F.sum("raw_alerts").alias("total_raw_alerts"),
        F.sum("consolidated_cases").alias("total_consolidated_cases"),
        F.when(a > 0, (F.lit(1.0) - c / a) * 100).alias("overall_workload_reduction_pct"),
        F.avg("raw_alerts").alias("mean_daily_raw_alerts"), mean_c.alias("mean_daily_consolidated_cases"),
        F.max("raw_alerts").alias("peak_day_raw_alerts"), F.max("consolidated_cases").alias("peak_day_consolidated_cases"),
        (F.max("consolidated_cases").cast("double") / F.greatest(F.lit(0.1), mean_c)).alias("peak_to_mean_ratio"),
        F.avg("exposure_captured").alias("mean_daily_exposure_captured"),
        F.when(c > 0, F.sum("exposure_captured") / c).alias("overall_exposure_per_case"))


def _alert_ends(scored: DataFrame) -> DataFrame:
    """Fewer rows with the same cases at every threshold: one per customer and value with the best score, in place of the orders.

    An order joins its customer with each of its values, so the customer may do that for all its orders. Orders without a
    customer stand for themselves, equal ones once. ``order_id`` is a number of the row.
    """
    names = list(ENTITY_COLUMNS.values())
    alone = F.array(F.struct(*[F.col(c).cast("string").alias(c) for c in names]))
    one = [F.struct(*[(F.col(c) if c == k else F.lit(None)).cast("string").alias(c) for c in names]) for k in names]
    rows = scored.select("customer_id", "predicted_score", F.inline(F.when(F.col("customer_id").isNull(), alone).otherwise(F.array(*one))))
    return rows.groupBy("customer_id", *names).agg(F.max("predicted_score").alias("predicted_score")).withColumn(
        "order_id", F.monotonically_increasing_id())


def threshold_sensitivity(scored: DataFrame, grid=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), days: float = 27.0,
                          typed: bool = True) -> DataFrame:
    """Event metrics, ring recalls, daily alerts and consolidated cases at every threshold of the grid.

    Cases of all thresholds come from one component run, keyed by threshold, over what customers used (``_alert_ends``).
    """
    from coterie.operators.events import threshold_table
    table = threshold_table(scored, grid)
    levels = F.array(*[F.lit(float(t)) for t in grid])
    ends = materialise(_alert_ends(scored), "alert-ends")
    flagged = ends.withColumn("threshold", F.explode(F.filter(levels, lambda t: t <= F.col("predicted_score"))))
    cases = (consolidate_alerts(flagged, typed=typed, per="threshold").groupBy("threshold")
             .agg(F.count_distinct("case_id").alias("consolidated_cases")))
    cells = _abuse(scored).select("ring_id", "customer_id", "loss_amount", "predicted_score")
    # a member is reached at every threshold up to its best score: one row per member carries all thresholds
    member = cells.groupBy("ring_id", "customer_id").agg(F.max("predicted_score").alias("best"))
    ring = member.groupBy("ring_id").agg(
        F.count("*").alias("members"), *[F.count_if(F.col("best") >= F.lit(float(t))).alias(f"m{k}") for k, t in enumerate(grid)])
    recall = ring.agg(F.count("*").alias("rings"), *[
        F.count_if(F.col(f"m{k}") >= 1).alias(f"a{k}") for k in range(len(grid))], *[
        F.count_if(F.col(f"m{k}").cast("double") / F.col("members") >= RULE_C).alias(f"c{k}") for k in range(len(grid))])
    money = cells.agg(F.coalesce(F.sum("loss_amount"), F.lit(0.0)).alias("total"), *[
        F.coalesce(F.sum(F.when(F.col("predicted_score") >= F.lit(float(t)), F.col("loss_amount"))), F.lit(0.0)).alias(f"e{k}")
        for k, t in enumerate(grid)])
    per_t = beside(recall, money).select("rings", "total", F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{k}").alias("rule_a"), F.col(f"c{k}").alias("rule_c"),
                 F.col(f"e{k}").alias("exposure_captured")) for k, t in enumerate(grid)])))
    out = table.join(per_t, "threshold").join(cases, "threshold", "left")
    n = F.coalesce("consolidated_cases", F.lit(0)).cast("long")
    return out.select(
        "threshold", (F.col("threshold") == F.lit(0.5)).alias("is_operating_point"), "precision", "recall", "f1",
        F.col("fp").alias("false_positives"), F.col("tp").alias("true_positives"), "expected_loss",
        F.col("alerts").alias("total_alerts"), (F.col("alerts") / F.lit(float(days))).alias("daily_alerts"),
        n.alias("consolidated_cases"), (n / F.lit(float(days))).alias("daily_cases"), "exposure_captured",
        (guarded_ratio(F.col("exposure_captured"), F.col("total")) * 100).alias("exposure_captured_pct"),
        (F.col("exposure_captured") / F.greatest(F.lit(1.0), n.cast("double"))).alias("exposure_per_case"),
        guarded_ratio(F.col("rule_a"), F.col("rings")).alias("rule_a_recall"),
        guarded_ratio(F.col("rule_c"), F.col("rings")).alias("rule_c_recall"))


def rolling_window_metrics(scored: DataFrame, thresholds: dict[str, float], n: int = 3) -> DataFrame:
    """Event and ring metrics per chronological window and model; ``scored`` holds a ``model`` column."""
    from coterie.operators.events import confusion_aggs, ranking_metrics, rates, rolling_windows
    one = next(iter(thresholds))
    win = rolling_windows(scored.filter(F.col("model") == one), n).select("order_id", "window_no")
    tau = F.lit(0.5)
    for m, t in thresholds.items():
        tau = F.when(F.col("model") == m, F.lit(float(t))).otherwise(tau)
    rows = scored.join(win, "order_id").withColumn("_tau", tau)
    by = ["window_no", "model"]
    counts = rates(rows.groupBy(*by).agg(*confusion_aggs(F.col("_tau")), F.count("*").alias("orders")))
    quality = ranking_metrics(rows, by).drop("pr_auc_trapezoid", "roc_auc")
    member = _abuse(rows).groupBy(*by, "ring_id", "customer_id").agg(
        F.max((F.col("predicted_score") >= F.col("_tau")).cast("int")).alias("hit"))
    ring = member.groupBy(*by, "ring_id").agg(F.avg(F.col("hit").cast("double")).alias("cov"))
    rules = ring.groupBy(*by).agg(F.avg((F.col("cov") > 0).cast("double")).alias("rule_a_recall"),
                                  F.avg((F.col("cov") >= RULE_C).cast("double")).alias("rule_c_recall"))
    return (counts.join(quality, by).join(rules, by, "left").select(
        *by, "orders", (F.col("tp") + F.col("fn")).alias("abuse_events"), "average_precision", "precision", "recall", "f1",
        F.col("fp").alias("false_positives"), F.coalesce("rule_a_recall", F.lit(0.0)).alias("rule_a_recall"),
        F.coalesce("rule_c_recall", F.lit(0.0)).alias("rule_c_recall")))


def rolling_deltas(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Per window: precision and false positives of ``other`` minus ``base``."""
    pick = metrics.groupBy("window_no").pivot("model", [base, other]).agg(
        F.first("precision").alias("p"), F.first("false_positives").alias("fp"))
    return pick.select("window_no", (F.col(f"{other}_p") - F.col(f"{base}_p")).alias("delta_precision"),
                       (F.col(f"{other}_fp") - F.col(f"{base}_fp")).alias("delta_fp"))


def ring_timeline(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per event of a ring, in order, with the action and the ring's totals.

    A ring may hold any number of events, so the timeline stays a table; totals come from a
    combined aggregate.
    """
    hit = F.col("predicted_score") >= F.lit(float(threshold))
    rows = scored.filter(F.col("ring_id").isNotNull())
    totals = rows.groupBy("ring_id").agg(
        F.sum("amount").alias("total_exposure"), F.count("*").alias("total_orders"), F.count_if(hit).alias("flagged_orders"))
    events = rows.select("ring_id", "order_id", "customer_id", "event_time", "amount", "predicted_score",
                         F.when(hit, "FLAG_FOR_REVIEW").otherwise("AUTO_APPROVE").alias("action"))
    return events.join(totals, "ring_id").select(
        F.concat(F.lit("DOSSIER-RING-"), F.col("ring_id")).alias("dossier_id"), "*",
        F.when(F.col("flagged_orders") > 0, "CRITICAL_SUSPECTED_RING").otherwise("LOW_RISK").alias("risk_assessment"),
        F.when(F.col("flagged_orders") > 0, "FREEZE_RING_ENTITIES").otherwise("MONITOR").alias("recommended_action"))
