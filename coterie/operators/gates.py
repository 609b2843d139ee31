"""Service metrics and safety gates over scoring logs and daily observations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import beside, guarded_ratio, health_band
from coterie.operators.ordering import quantiles

# Card number shapes, words, and limits the gates test.
CARD_PATTERN = (r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b")
SECRET_WORDS = ("password", "secret")
P95_TARGET, P99_TARGET, P95_LIMIT, FALLBACK_WARN, DAILY_RATE = 25.0, 50.0, 300.0, 0.005, 0.001
LATENCY_POINTS = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
FEATURE_COUNT = 137
STATUS_NOT_STARTED = "NOT STARTED — LIVE TRAFFIC NOT ATTACHED"
STATUS_NO_GO = "NO-GO — SHADOW GATE FAILED"
STATUS_GO = "GO — ELIGIBLE FOR 5% CANARY"
STATUS_IN_PROGRESS = "IN PROGRESS — LIVE SHADOW OBSERVATION"


def service_metrics(log: DataFrame) -> DataFrame:
    """One row: totals, duplicates, fallbacks, failures, alert rate and latency quantiles.

    ``log``: order_id, latency_ms, fallback_applied, alert and optionally scoring_failed.
    """
    failed = F.col("scoring_failed") if "scoring_failed" in log.columns else F.lit(False)
    per = log.groupBy("order_id").agg(
        F.count("*").alias("n"), F.count_if("fallback_applied").alias("fb"), F.count_if("alert").alias("al"),
        F.count_if(failed).alias("fail"), F.sum("latency_ms").alias("lat"), F.count("latency_ms").alias("nlat"))
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_processed"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("fb"), F.lit(0)).alias("fallbacks"),
        F.coalesce(F.sum("fail"), F.lit(0)).alias("failures"), F.coalesce(F.sum("al"), F.lit(0)).alias("alerts"),
        guarded_ratio(F.coalesce(F.sum("al"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("alert_rate"),
        F.coalesce(F.sum("lat") / F.sum("nlat"), F.lit(0.0)).alias("latency_mean"))
    q = quantiles(log, "latency_ms", list(LATENCY_POINTS.values())).get(None) or [0.0] * len(LATENCY_POINTS)
    return out.select("*", *[F.lit(v).alias(f"latency_{k}") for k, v in zip(LATENCY_POINTS, q)])


def _gate(name: str, df: DataFrame, passed: Column, status: Column) -> DataFrame:
    return df.select(F.lit(name).alias("gate"), passed.alias("passed"), status.alias("status"))


def _pass_fail(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def gate_contract(features: DataFrame, expected: list[str]) -> DataFrame:
    """The scored columns are exactly the contract, in order."""
    ok = [c for c in features.columns if c != "order_id"] == list(expected)
    one = features.sparkSession.range(1)
    return _gate("feature_contract", one, F.lit(ok), _pass_fail(F.lit(ok)))


def gate_non_enforcement(log: DataFrame) -> DataFrame:
    """No row may say BLOCK unless decisions are enforced."""
    enforced = F.coalesce(F.col("enforce_decisions"), F.lit(False)) if "enforce_decisions" in log.columns else F.lit(False)
    n = log.agg(F.count_if((F.upper(F.coalesce("action", F.lit(""))) == "BLOCK") & ~enforced).alias("blocked"))
    return _gate("non_enforcement", n, F.col("blocked") == 0, _pass_fail(F.col("blocked") == 0))


def gate_error_rates(metrics: DataFrame, strict: bool = False) -> DataFrame:
    """0/0 passes, few fallbacks warn, else fail.

    The warning looks at fallbacks alone, so many failures with few fallbacks still pass; ``strict``
    holds failures to the same limit.
    """
    fb = guarded_ratio(F.col("fallbacks"), F.col("total_processed"))
    fl = guarded_ratio(F.col("failures"), F.col("total_processed"))
    mild = (fb < FALLBACK_WARN) & ((fl < FALLBACK_WARN) if strict else F.lit(True))
    clean = (fb == 0) & (fl == 0)
    return _gate("error_rates", metrics, clean | mild, F.when(clean, "PASS").when(mild, "WARN").otherwise("FAIL"))


def pii_hits(log: DataFrame, columns: list[str] | None = None) -> Column:
    """0, 1 or 2 per row: a card number, and a password / secret word, in its string columns."""
    names = columns or [c for c, t in log.dtypes if t == "string"]
    text = F.concat_ws(" ", *names)
    low = F.lower(text)
    word = low.contains(SECRET_WORDS[0]) | low.contains(SECRET_WORDS[1])
    return text.rlike(CARD_PATTERN).cast("int") + word.cast("int")


def gate_pii(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    n = log.agg(F.coalesce(F.sum(pii_hits(log, columns)), F.lit(0)).alias("leaks"))
    return _gate("pii_masking", n, F.col("leaks") == 0, _pass_fail(F.col("leaks") == 0))


def gate_latency(metrics: DataFrame) -> DataFrame:
    p95, p99 = F.col("latency_p95"), F.col("latency_p99")
    good, mild = (p95 <= P95_TARGET) & (p99 <= P99_TARGET), p95 <= P95_LIMIT
    return _gate("latency", metrics, good | mild, F.when(good, "PASS").when(mild, "WARN").otherwise("FAIL"))


def gate_matrix(*gates: DataFrame) -> DataFrame:
    """All gates, each with the overall status: FAIL if one fails, WARN if one warns, else PASS."""
    rows = gates[0]
    for g in gates[1:]:
        rows = rows.unionByName(g)
    overall = rows.agg(F.bool_and("passed").alias("_all"), F.bool_or(F.col("status") == "WARN").alias("_warn")).select(
        F.when(~F.col("_all"), "FAIL").when(F.col("_warn"), "WARN").otherwise("PASS").alias("overall_status"))
    return beside(rows, overall)


def daily_observations(log: DataFrame) -> DataFrame:
    """Scoring log folded to one row per UTC day (see ``daily_threshold_flags``)."""
    rows = log.withColumn("date_str", F.to_date(F.col("event_time").cast("timestamp")).cast("string"))
    failed = F.col("scoring_failed") if "scoring_failed" in log.columns else F.lit(False)
    out = rows.groupBy("date_str").agg(
        F.count("*").alias("total_transactions"), F.count_if(failed).alias("error_count"),
        F.count_if("fallback_applied").alias("fallback_count"),
        F.count_if(F.upper(F.coalesce("action", F.lit(""))) == "BLOCK").alias("blocked_transactions"))
    p95 = quantiles(rows, "latency_ms", [0.95], by="date_str")
    q = log.sparkSession.createDataFrame([(k, v[0]) for k, v in p95.items()], "date_str string, p95_latency_ms double")
    return out.join(F.broadcast(q), "date_str", "left")


def daily_threshold_flags(days: DataFrame, checksum: str | None = None) -> DataFrame:
    """Add ``passes``: nothing blocked, no PII, contract kept, error and fallback at most 0.1 %, p95 at most 300 ms, traffic.

    A day that doesn't say its checksum, feature count or PII count fails, and so does one without a checksum to compare
    with (``target_checksum`` of the day, else ``checksum``)."""
    n = F.col("total_transactions")
    ok = ((F.col("blocked_transactions") == 0) & (n > 0)
          & (guarded_ratio(F.col("error_count"), n) <= DAILY_RATE) & (guarded_ratio(F.col("fallback_count"), n) <= DAILY_RATE)
          & (F.col("p95_latency_ms") <= P95_LIMIT))
    said = {c: F.col(c) if c in days.columns else F.lit(None) for c in ("pii_violations", "feature_count", "model_checksum", "target_checksum")}
    ok = ok & (said["pii_violations"] == 0) & (said["feature_count"] == FEATURE_COUNT)
    found = said["model_checksum"].cast("string")
    ok = ok & (F.length(found) == 64) & (found == F.coalesce(said["target_checksum"].cast("string"), F.lit(checksum)))
    return days.withColumn("passes", F.coalesce(ok, F.lit(False)))


def qualifying_streak(days: DataFrame) -> DataFrame:
    """One row: verdict and the run of good live days at the end.

    Days are few (one row each), so the ordering window is over a bounded table.
    """
    live = F.col("data_source") == "REAL_LIVE_PRODUCTION"
    good = live & F.col("passes")
    last_bad = days.agg(F.max(F.when(~good, F.col("date_str"))).alias("_reset"))
    out = beside(days, last_bad).agg(
        F.count_if(live).alias("live_days"), F.count("*").alias("days_inspected"), F.count_if(live & ~F.col("passes")).alias("failed_days"),
        F.count_if(F.col("_reset").isNull() | (F.col("date_str") > F.col("_reset"))).alias("streak"))
    status = (F.when(F.col("live_days") == 0, STATUS_NOT_STARTED).when(F.col("failed_days") > 0, STATUS_NO_GO)
              .when(F.col("streak") >= 7, STATUS_GO).otherwise(STATUS_IN_PROGRESS))
    return out.select(status.alias("status"), F.when(F.col("live_days") == 0, 0).otherwise(F.col("streak")).cast("long")
                      .alias("qualifying_days"), "days_inspected", (status == STATUS_GO).alias("canary_eligible"))


def rejected_days(days: DataFrame) -> DataFrame:
    """(date_str, reason) of the days that reset the streak."""
    live = F.col("data_source") == "REAL_LIVE_PRODUCTION"
    return days.filter(~(live & F.col("passes"))).select(
        "date_str", F.when(~live, F.concat(F.lit("source "), F.col("data_source"))).otherwise("safety thresholds").alias("reason"))


def health_bands(daily: DataFrame) -> DataFrame:
    """Add a band per measure that is present: mean score, alert rate, lagged precision, failure rate, cases per day, PSI."""
    limits = (("mean_score", 0.06, 0.10, True), ("alert_rate", 0.03, 0.05, True), ("lagged_precision", 0.85, 0.75, False),
              ("failure_rate", 0.0001, 0.001, True), ("case_rate", 5.0, 10.0, True), ("psi", 0.10, 0.25, True))
    out = daily
    for c, green, critical, worse in limits:
        if c in daily.columns:
            out = out.withColumn(f"{c}_band", health_band(c, green, critical, worse))
    return out


def replay_summary(log: DataFrame) -> DataFrame:
    """One row over a scoring log: period, events, alerts, fallbacks, latency."""
    t = F.unix_micros(F.col("event_time").cast("timestamp"))
    q = quantiles(log, "latency_ms", [0.95, 0.99]).get(None) or [0.0, 0.0]
    return log.agg(
        F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.count("*").alias("events"), F.count_if("alert").alias("alerts"),
        (guarded_ratio(F.count_if("alert"), F.count("*")) * 100).alias("alert_rate_pct"),
        F.count_if("fallback_applied").alias("fallbacks"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("latency_mean")
    ).select("*", F.lit(q[0]).alias("latency_p95"), F.lit(q[1]).alias("latency_p99"))
