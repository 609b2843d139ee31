"""Alerts, evidence, investigation cases and their workflow, as tables.

Members of a case are rows of a table keyed by case, never an array: a case may grow without limit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import case_severity, mask_identifier, stable_id
from coterie.operators.asof import SkewPlan, find_skew, first_use, nearest_in_time, sweep, timed
from coterie.schema import DAY, ENTITY_COLUMNS
from coterie.sources.scratch import materialise

REVIEW_THRESHOLD = 0.50
# The workflow (current status -> statuses it may move to).
TRANSITIONS = {
    "NEW": ("IN_REVIEW", "CLOSED"),
    "IN_REVIEW": ("ESCALATED", "CONFIRMED_ABUSE", "LEGITIMATE", "CLOSED"),
    "ESCALATED": ("CONFIRMED_ABUSE", "LEGITIMATE", "CLOSED"),
    "CONFIRMED_ABUSE": ("CLOSED",),
    "LEGITIMATE": ("CLOSED",),
    "CLOSED": (),
}
DISPOSITIONS = ("CONFIRMED_ABUSE", "LEGITIMATE")


def _given(c: str) -> Column:
    s = F.col(c).cast("string")
    return F.when(s != "", s)


def create_alerts(scored: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """One alert per order whose calibrated score reaches the threshold and is no fallback."""
    fallback = F.col("fallback_applied") if "fallback_applied" in scored.columns else F.lit(False)
    rows = timed(scored.filter((F.col("calibrated_score") >= F.lit(threshold)) & ~F.coalesce(fallback, F.lit(False))))
    keys = [F.when(_given(c).isNotNull(), F.struct(F.lit(c).alias("etype"), _given(c).alias("value")))
            for c in ENTITY_COLUMNS.values()]
    cols = ["order_id", "customer_id", "t", "amount", F.col("calibrated_score").alias("risk_score")]
    first = (rows.select(stable_id("ALERT", "order_id").alias("alert_id"), *cols,
                         F.array_compact(F.array(*keys)).alias("entity_keys"))
             .groupBy("order_id").agg(F.min_by(F.struct("alert_id", "customer_id", "t", "amount", "risk_score", "entity_keys"),
                                               F.struct("t", "alert_id")).alias("a")))
    return first.select("a.alert_id", "order_id", "a.customer_id", "a.t", "a.amount", "a.risk_score", "a.entity_keys",
                        F.size("a.entity_keys").alias("modalities"))


def alert_evidence(alerts: DataFrame, history: DataFrame, window_days: int | None = None,
                   threshold: float = REVIEW_THRESHOLD, skew: SkewPlan | None = None) -> DataFrame:
    """Evidence rows per alert: the score, and one per shared entity with other customers before it.

    Peers are a running distinct count on the value less the customer's own earlier use, so a popular
    value costs its rows, not its pairs.
    """
    skew = skew or find_skew(history)
    hot = "hot_value" if skew.values is not None else None
    pairs = F.array(*[F.struct(F.lit(e).alias("etype"), _given(c).alias("value")) for e, c in ENTITY_COLUMNS.items()])
    rows = timed(history).select("order_id", "customer_id", "t", F.inline(pairs)).filter(F.col("value").isNotNull())
    if hot:
        rows = skew.mark_values(rows)
    rows = nearest_in_time(rows, ["etype", "value", "customer_id"], hot, skew.slice_us)
    w = None if window_days is None else window_days * DAY
    mine = F.col("prev_t").isNotNull() if w is None else F.coalesce(F.col("prev_t") > F.col("t") - F.lit(w), F.lit(False))
    rows = rows.withColumn("mine", mine.cast("long"))
    counted = sweep(rows, ["etype", "value"], [first_use("people", w)], "sequence", hot, skew.slice_us).select(
        "order_id", "etype", (F.col("people") - F.col("mine")).alias("peers")).filter("peers > 0")
    shared = alerts.select("alert_id", "order_id").join(counted, "order_id").select(
        "alert_id", "order_id", F.lit("shared_entity").alias("evidence_type"),
        F.concat(F.col("etype"), F.lit("_id")).alias("entity_type"), F.col("peers").cast("double").alias("value"))
    score = alerts.select("alert_id", "order_id", F.lit("score_threshold").alias("evidence_type"),
                          F.lit("").alias("entity_type"), F.round("risk_score", 6).alias("value"))
    key = F.concat(F.col("order_id").cast("string"), F.when(F.col("evidence_type") == "score_threshold", ":threshold")
                   .otherwise(F.col("entity_type")))
    window = "30d" if window_days is None else f"{window_days}d"
    return score.unionByName(shared).select(
        stable_id("EVID", key).alias("evidence_id"), "*",
        F.when(F.col("evidence_type") == "score_threshold", F.lit(f">= {threshold:.2f}"))
        .otherwise("prior observable events").alias("comparison"),
        F.when(F.col("evidence_type") == "score_threshold", "event").otherwise(F.lit(window)).alias("window"))


def _links(alerts: DataFrame) -> DataFrame:
    """(alert_id, t, order_id, v): the customer and the entity values of each alert."""
    keys = F.transform("entity_keys", lambda x: F.concat_ws(":", x["etype"], x["value"]))
    return alerts.select("alert_id", "t", "order_id", F.explode(
        F.concat(F.array(F.concat(F.lit("customer:"), F.col("customer_id").cast("string"))), keys)).alias("v")).filter("v is not null")


def _numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, ``name``_no) of the distinct values, numbered in their order."""
    return materialise(df.select(key).distinct().sort(key).withColumn(f"{name}_no", F.monotonically_increasing_id()), f"{name}-numbers")


def _earlier_cases(links: DataFrame, state: DataFrame, sliced: bool, moved: DataFrame | None) -> DataFrame:
    """(alert_no, low): the smallest case among all earlier alerts on the alert's values, of values with a ``moved`` alert if given.

    A running minimum on a value; on a hot one inside a day, and one over the days' smallest cases."""
    if moved is not None:
        links = links.join(links.join(moved, "alert_no").select("v_no").distinct(), "v_no", "left_semi")
    rows = links.join(state.select("alert_no", "case_no"), "alert_no")
    part = ["v_no", "slice"] if sliced else ["v_no"]
    inside = Window.partitionBy(*part).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    low = F.min("case_no").over(inside)
    if not sliced:
        return rows.select("alert_no", low.alias("low")).groupBy("alert_no").agg(F.min("low").alias("low"))
    days = rows.filter("slice <> -1").groupBy("v_no", "slice").agg(F.min("case_no").alias("_day"))
    upto = Window.partitionBy("v_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("v_no", "slice", F.min("_day").over(upto).alias("_carry"))
    return (rows.withColumn("_in", low).join(days, ["v_no", "slice"], "left")
            .groupBy("alert_no").agg(F.min(F.least("_in", "_carry")).alias("low")))


def _followed(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` after every alert followed its most promising predecessors to their end, pointers doubled."""
    seen = edges.join(state.select(F.col("alert_no").alias("pred"), F.col("case_no").alias("theirs")), "pred")
    choice = seen.groupBy("alert_no").agg(F.min(F.struct(F.col("theirs").isNull().alias("none"), "theirs", "pred")).alias("c"))
    walk = materialise(state.join(choice, "alert_no", "left").select("alert_no", "case_no", F.col("c.pred").alias("to")), "case-walk")
    while not walk.filter("to is not null").isEmpty():
        ahead = walk.select(F.col("alert_no").alias("to"), F.col("case_no").alias("_case"), F.col("to").alias("_to"))
        walk = materialise(walk.join(ahead, "to", "left").select(
            "alert_no", F.least("case_no", "_case").alias("case_no"), F.col("_to").alias("to")), "case-walk")
    return walk.select("alert_no", "case_no")


SWEEPS = 24


def assign_cases(alerts: DataFrame, known: DataFrame | None = None, sweeps: int = SWEEPS,
                 hot_rows: int = 100_000) -> DataFrame:
    """(order_id, alert_id, customer_id, t, amount, risk_score, modalities, case_id).

    In arrival order an alert joins the smallest case id among the cases that hold its customer or
    one of its entity values, or opens a case; cases never merge.  An alert's case is at most that of
    any earlier alert on its values, so along one value the smallest case so far is that of the
    alert just before, and

        case(i) = min over values v of i of case(alert just before i on v),

    with the own id where there is none.  That is the smallest opener an alert leads back to.  Every round
    carries cases along whole values by a running minimum; paths that change values more than ``sweeps`` times then follow
    pointers to the most promising predecessors, doubled with the minimum carried along, so a chain of n alerts takes
    log n rounds.  This goes on until nothing changes.  The dependence runs backward in time only, so what
    does not change is the one solution; there is no cap.  Alerts, values and cases are numbers in all rounds.

    ``known`` holds alerts that already have a case (same columns).  They came before all others,
    whatever their own times: on a value they count as one alert with the smallest of their cases.
    """
    keep = ["order_id", "alert_id", "customer_id", "t", "amount", "risk_score", "modalities"]
    fresh = alerts.select(*keep, "entity_keys")
    # the alert just before on each value: by a window, on hot values inside a day, and across days from the days' last alerts
    every = materialise(_links(fresh), "alert-links")
    # an alert without a time gets no case and stands before all others of its values, which then open none
    timeless = every.filter("t is null").select("v").distinct()
    named = every.filter("t is not null")
    hot = materialise(named.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("v"), "alert-hot")
    sliced = not hot.isEmpty()
    alert_no, v_no = _numbered(named, "alert_id", "alert"), _numbered(named, "v", "v")
    day = F.floor(F.col("t") / F.lit(DAY))
    named = (named.join(hot.withColumn("_hot", F.lit(True)), "v", "left").withColumn("slice", F.when(F.col("_hot"), day).otherwise(F.lit(-1)))
             if sliced else named.withColumn("slice", F.lit(-1).cast("long")))
    part = ["v", "slice"] if sliced else ["v"]
    placed = named.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("t", "order_id", "alert_id")))
    links = materialise(placed.join(alert_no, "alert_id").join(v_no, "v").select("alert_no", "v_no", "slice", "place"), "alert-links")
    here = Window.partitionBy(*(["v_no", "slice"] if sliced else ["v_no"])).orderBy("place")
    before = links.withColumn("_in", F.lag("alert_no").over(here))
    if sliced:
        days = links.filter("slice <> -1").groupBy("v_no", "slice").agg(F.max(F.struct("place", "alert_no")).alias("_last")).select(
            "v_no", "slice", F.lag("_last.alert_no").over(Window.partitionBy("v_no").orderBy("slice")).alias("_carry"))
        before = before.join(days, ["v_no", "slice"], "left").withColumn("_in", F.coalesce("_in", "_carry"))
    late = F.when(F.col("_late"), F.lit(-1).cast("long"))
    before = before.join(timeless.join(v_no, "v").select("v_no", F.lit(True).alias("_late")), "v_no", "left")
    before = materialise(before.select("alert_no", "v_no", F.coalesce("_in", late).alias("pred")), "alert-preds")
    opened = before.groupBy("alert_no").agg(F.count("pred").alias("preds")).join(alert_no, "alert_no")
    if known is not None:
        held = _links(known.select("alert_id", "t", "order_id", "customer_id", "entity_keys")).join(
            known.select("alert_id", "case_id"), "alert_id").groupBy("v").agg(F.min("case_id").alias("held")).join(v_no, "v")
        old = before.filter("pred is null").join(held, "v_no").groupBy("alert_no").agg(F.min("held").alias("held"))
        opened = opened.join(old, "alert_no", "left")
    else:
        opened = opened.withColumn("held", F.lit(None).cast("string"))
    own = F.when(F.col("preds") == 0, stable_id("CASE", "alert_id"))
    opened = materialise(opened.select("alert_no", F.coalesce("held", own).alias("case_id")), "case-openers")
    case_no = _numbered(opened.filter("case_id is not null"), "case_id", "case")
    state = materialise(opened.join(case_no, "case_id", "left").select("alert_no", "case_no"), "case-state")
    edges, turn, size, moved = None, 0, state.count(), None
    while True:
        turn += 1
        new = materialise(state.join(_earlier_cases(links, state, sliced, moved), "alert_no", "left").select(
            "alert_no", F.least("case_no", "low").alias("case_no"),
            F.coalesce((F.col("low") < F.col("case_no")) | (F.col("case_no").isNull() & F.col("low").isNotNull()), F.lit(False)).alias("moved")), "case-state")
        state = new.select("alert_no", "case_no")
        changed = new.filter("moved").count()
        if not changed:
            break
        # few alerts moved: only values that they are on can move others
        moved = new.filter("moved").select("alert_no") if 8 * changed < size else None
        if turn % sweeps == 0:
            if edges is None:
                edges = materialise(before.filter("pred is not null").select("alert_no", "pred").distinct(), "alert-edges")
            state, moved = _followed(edges, state), None
    cases = state.join(case_no, "case_no", "left").join(alert_no, "alert_no").select("alert_id", "case_id")
    return fresh.select(*keep).join(cases, "alert_id").select(*keep, "case_id")


def case_rollup(assigned: DataFrame, burst: DataFrame | None = None) -> DataFrame:
    """One row per case; severity follows the case totals and the latest alert's number of entities."""
    when = F.struct("t", "order_id")
    member = assigned.groupBy("case_id", "customer_id").agg(
        F.count("*").alias("n"), F.max("risk_score").alias("risk"), F.sum("amount").alias("amount"),
        F.min(when).alias("first"), F.max(F.struct("t", "order_id", "modalities")).alias("last"))
    out = member.groupBy("case_id").agg(
        F.count("*").alias("customers"), F.sum("n").alias("alert_count"), F.max("risk").alias("risk_score"),
        F.round(F.sum("amount"), 2).alias("estimated_exposure"), F.min_by("customer_id", "first").alias("primary_customer"),
        F.min("first.t").alias("created_t"), F.max("last.t").alias("updated_t"), F.max("last").getField("modalities").alias("modalities"))
    if burst is not None:
        out = out.join(burst.select("case_id", "burst"), "case_id", "left")
    return out.withColumn("severity", case_severity(
        "risk_score", "alert_count", "customers", "modalities", F.coalesce("burst", F.lit(0)) if burst is not None else None))


def case_graph(assigned: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every case with masked identifiers, distinct."""
    rows = assigned.select("case_id", "order_id", "customer_id", "risk_score").join(
        alerts.select("order_id", "entity_keys"), "order_id").select(
        mask_identifier("case_id").alias("case_id"), mask_identifier("customer_id").alias("customer"),
        mask_identifier("order_id").alias("order"), "risk_score", "entity_keys")
    ent = rows.select("case_id", "customer", F.inline("entity_keys")).select(
        "case_id", "customer", "etype", mask_identifier(F.concat_ws(":", "etype", "value")).alias("entity"))
    nodes = (rows.select("case_id", F.col("customer").alias("node"), F.lit("customer").alias("type"))
             .unionByName(rows.select("case_id", F.col("order").alias("node"), F.lit("order").alias("type")))
             .unionByName(ent.select("case_id", F.col("entity").alias("node"), F.col("etype").alias("type")))).distinct()
    edges = (rows.select("case_id", F.col("customer").alias("source"), F.col("order").alias("target"),
                         F.lit("customer-placed-order").alias("relationship"))
             .unionByName(ent.select("case_id", F.col("customer").alias("source"), F.col("entity").alias("target"),
                                     F.concat(F.lit("customer-used-"), F.regexp_replace("etype", "_id$", "")).alias("relationship")))
             ).distinct()
    return nodes, edges


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("case_id").agg(F.count("*").alias("nodes"),
                                     F.count_if(F.col("type").isin(*ENTITY_COLUMNS.values())).alias("shared_entities"))
    return n.join(edges.groupBy("case_id").agg(F.count("*").alias("edges")), "case_id", "left").select(
        "case_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "shared_entities")


def case_status_fold(events: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, cases with status and disposition) from status requests.

    ``events``: case_id, ts, event_id, status, actor, reason, in any order.  A request is applied when
    the current status allows it and rejected otherwise.  The workflow has no cycle, so a case takes
    at most four steps: each round picks the earliest allowed later request of every case, and its outcome is a stored table,
    so no task holds the sorted requests of several rounds.
    """
    steps = 4
    state = materialise(cases.select("case_id").distinct().select(
        "case_id", F.lit("NEW").alias("current"), F.lit(None).cast("struct<ts:timestamp,event_id:string>").alias("at")), "status-state")
    ts = F.col("ts").cast("timestamp")
    ev = events.select("case_id", F.struct(ts.alias("ts"), F.col("event_id").cast("string").alias("event_id")).alias("pos"),
                       F.coalesce(F.unix_micros(ts), F.lit(-1 << 63)).alias("micros"), "status", "actor", "reason")
    ok = F.lit(False)
    for src, dst in TRANSITIONS.items():
        if dst:
            ok = ok | ((F.col("current") == src) & F.col("status").isin(*dst))
    open_to = ok & (F.col("at").isNull() | (F.col("pos") > F.col("at")))
    history = None
    for _ in range(steps):
        # the earliest instant is a number, kept in a hash table: only the requests of that instant are compared as rows
        first = ev.join(state, "case_id").filter(open_to).groupBy("case_id").agg(F.min("micros").alias("micros"))
        there = materialise(state.join(first, "case_id"), "status-first")
        pick = materialise(ev.join(there, ["case_id", "micros"]).filter(open_to).groupBy("case_id", "current")
                           .agg(F.min(F.struct("pos", "status", "actor", "reason")).alias("e")), "status-pick")
        took = pick.select("case_id", F.col("e.pos.event_id").alias("event_id"), F.col("e.pos.ts").alias("ts"),
                           F.col("current").alias("previous"), F.col("e.status").alias("new"),
                           mask_identifier(F.col("e.actor")).alias("actor"), F.col("e.reason").alias("reason"))
        history = took if history is None else history.unionByName(took)
        state = materialise(state.join(pick.select("case_id", F.col("e").alias("e")), "case_id", "left").select(
            "case_id", F.coalesce("e.status", "current").alias("current"), F.coalesce("e.pos", "at").alias("at")), "status-state")
    final = history.filter(F.col("new").isin(*DISPOSITIONS)).select(
        "case_id", F.col("new").alias("disposition"), F.col("actor").alias("disposed_by"))
    closed = state.join(final, "case_id", "left").select("case_id", F.col("current").alias("status"), "disposition", "disposed_by")
    return history, closed


def append_notes(notes: DataFrame) -> DataFrame:
    """Note rows with line breaks removed and the actor masked, numbered per case."""
    order = Window.partitionBy("case_id").orderBy("ts", "note_id")
    return notes.select("case_id", "note_id", "ts", F.regexp_replace("note", "\n", " ").alias("note"),
                        mask_identifier("actor").alias("actor"), F.lit("note_added").alias("action"),
                        F.row_number().over(order).alias("note_no"))


def case_aggregates(cases: DataFrame) -> DataFrame:
    """One row of totals."""
    return cases.agg(
        F.count_if(F.col("status") != "CLOSED").alias("open"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.coalesce(F.round(F.sum("estimated_exposure"), 2), F.lit(0.0)).alias("exposure"),
        F.coalesce(F.round(F.avg("risk_score"), 4), F.lit(0.0)).alias("avg_risk"))


def case_breakdown(cases: DataFrame) -> DataFrame:
    """(dimension, name, cases) by severity and by status."""
    pair = F.array(F.struct(F.lit("severity").alias("dimension"), F.coalesce("severity", F.lit("UNKNOWN")).alias("name")),
                   F.struct(F.lit("status").alias("dimension"), F.coalesce("status", F.lit("UNKNOWN")).alias("name")))
    return cases.select(F.inline(pair)).groupBy("dimension", "name").agg(F.count("*").alias("cases"))


def case_timeline(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events of each case in (ts, event_id) order, the first ``limit`` when given."""
    out = events.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "event_id")))
    return out if limit is None else out.filter(F.col("position") <= limit)


def pick_active_case(cases: DataFrame, assigned: DataFrame, run_orders: DataFrame) -> DataFrame:
    """The highest-risk case touching the given orders, open ones first."""
    touched = assigned.join(run_orders.select("order_id"), "order_id", "left_semi").select("case_id").distinct()
    return (cases.join(touched, "case_id", "left_semi")
            .orderBy((F.col("status") == "CLOSED").asc(), F.col("risk_score").desc(), "case_id").limit(1))


def filter_cases(cases: DataFrame, status: str | None = None, severity: str | None = None,
                 min_risk: float | None = None, text: str = "") -> DataFrame:
    out = cases
    if status and status != "ALL":
        out = out.filter(F.col("status") == status)
    if severity and severity != "ALL":
        out = out.filter(F.col("severity") == severity)
    if min_risk is not None:
        out = out.filter(F.col("risk_score") >= F.lit(float(min_risk)))
    needle = text.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cases.columns]))
        out = out.filter(hay.contains(needle))
    return out.orderBy(F.col("risk_score").desc(), F.col("created_t").desc())


def case_next_actions(cases: DataFrame, counts: DataFrame, shared_evidence: DataFrame | None = None) -> DataFrame:
    """``actions``: ordered array of (priority, title, action, detail, allowed) for each case.

    A step without an action is advice and always allowed; one with a status is listed where the workflow allows it.

    ``counts``: case_id, devices, payments (distinct nodes); ``shared_evidence``: cases that have any.
    """
    rows = cases.join(counts, "case_id", "left")
    if shared_evidence is not None:
        rows = rows.join(shared_evidence.select("case_id", F.lit(True).alias("_ev")).distinct(), "case_id", "left")
        gap = F.col("_ev").isNull()
    else:
        gap = F.lit(False)

    def allowed(target: str) -> Column:
        return F.col("status").isin(*[s for s, to in TRANSITIONS.items() if target in to])

    def step(when: Column, priority: int, title: str, action: str, detail: Column | str) -> Column:
        may = allowed(action) if action in TRANSITIONS else F.lit(True)
        text = F.lit(detail) if isinstance(detail, str) else detail
        return F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(title).alias("title"), F.lit(action).alias("action"),
                                     text.alias("detail"), may.alias("allowed")))

    urgent = (F.col("severity") == "CRITICAL") | ((F.col("severity") == "HIGH") & (F.col("risk_score") >= F.lit(0.9)))
    many = (F.coalesce("devices", F.lit(0)) <= 2) & (F.col("customers") >= 3) & F.col("devices").isNotNull()
    items = [
        step(allowed("ESCALATED") & urgent, 1, "Escalate to risk operations", "ESCALATED",
             F.format_string("%s severity at risk %.2f over %d alerts", "severity", "risk_score", "alert_count")),
        step(F.col("estimated_exposure") >= F.lit(1000.0), 1, "Prioritize for exposure review", "",
             F.format_string("Exposure of %.2f is at or above 1000", F.col("estimated_exposure").cast("double"))),
        step(many, 2, "Trace the shared device cluster", "", F.format_string("%d customers on %d devices", "customers", F.coalesce("devices", F.lit(0)))),
        step(F.coalesce("payments", F.lit(0)) > 0, 3, "Correlate payment instruments", "",
             F.format_string("%d payment instruments in the case", F.coalesce("payments", F.lit(0)))),
        step(gap, 3, "Request shared-entity evidence", "", "No shared entity is on record"),
        step(allowed("IN_REVIEW"), 2, "Open the review", "IN_REVIEW", F.format_string("Nobody has looked at %d alerts yet", "alert_count")),
        step(allowed("CONFIRMED_ABUSE"), 3, "Confirm coordinated abuse", "CONFIRMED_ABUSE", "Records the finding"),
        step(allowed("LEGITIMATE"), 3, "Mark legitimate and release", "LEGITIMATE", "Records that nothing was found"),
        step(allowed("CLOSED"), 4, "Close the case", "CLOSED", "Ends the work on it"),
        step(F.lit(True), 5, "Add an analyst note", "note", "Keeps what was seen"),
    ]
    return rows.select("case_id", F.array_sort(F.array_compact(F.array(*items))).alias("actions"))
