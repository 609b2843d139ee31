"""What the jobs over orders send between tasks, and how it grows."""
import datetime as dt
import hashlib
import re
import threading

import pytest
from pyspark.sql import functions as F

from coterie.llm import near
from coterie.operators import behaviour, cases, components, models, neighbourhood
from coterie.operators.asof import SkewPlan
from coterie.plans import queries
from coterie.plans.matrix import columns_of, feature_matrix

COLUMNS = ("order_id string, customer_id string, event_time timestamp, amount double, device_id string, ip_id string, address_id string, "
           "payment_id string, merchant_category string, retry_count double")


def orders(spark, n=40):
    t0 = dt.datetime(2025, 2, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(f"O{k:03d}", f"C{k % 5}", t0 + dt.timedelta(hours=k), 10.0, f"D{k % 3}", f"I{k % 2}", f"A{k % 7}", f"P{k}", "a", 0.0)
                                  for k in range(n)], COLUMNS)


def test_touched_values_and_people_are_not_shuffled_by_order(spark):
    """F1 to F4: an order's values and people are joined and grouped where the customer's reach lies."""
    hood = neighbourhood.Neighbourhood.build(orders(spark))
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = neighbourhood.neighbourhood_people(hood)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not [x for x in dealt if "order_id" in x]


def test_what_a_customer_reaches_is_sent_once(spark):
    """F2 to F5: values and people are counted from one exchange of the spells, which holds the runs of the shortest window alone."""
    timeless = [(f"N{k}", f"C{k % 5}", None, 10.0, f"D{k % 3}", f"I{k % 2}", f"A{k % 7}", f"P{k}", "a", 0.0) for k in range(8)]
    hood = neighbourhood.Neighbourhood.build(orders(spark).unionByName(spark.createDataFrame(timeless, COLUMNS)))
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = neighbourhood.neighbourhood_people(hood)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert [x for x in plan.splitlines() if "ReusedExchange" in x and "use#" in x]
    runs = {w: {(r["far"], r["customer_id"]): r["runs"] for r in hood.spell.filter(F.col("w") == w).withColumn(
        "runs", neighbourhood.longer(F.col("runs"), w, neighbourhood.W7)).collect()} for w in (neighbourhood.W24, neighbourhood.W7)}
    assert runs[neighbourhood.W24] == runs[neighbourhood.W7] and len(runs[neighbourhood.W7]) > 20


def test_a_matrix_reads_each_table_once(spark):
    """F20 to F24: one customer table, one table of values, which carries what they reach, and one pivot; ids that come again as before."""
    o = orders(spark)
    o = o.unionByName(o.filter("order_id < 'O010'").withColumn("device_id", F.lit(" D1")))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        made = feature_matrix(o, "extended", skew=SkewPlan())
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id#\d+, \d+\)", plan)) == 2  # orders with amounts, orders with values
    assert len([x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if x.startswith("etype")]) <= 3  # values, and a join of their users
    parts = behaviour.baseline_features(o, skew=SkewPlan()).join(neighbourhood.graph_features(o, skew=SkewPlan()), "order_id").join(
        behaviour.temporal_velocity_features(o, skew=SkewPlan()), "order_id").join(behaviour.customer_relative_features(o, skew=SkewPlan()), "order_id")
    want = sorted(tuple(r) for r in parts.select("order_id", *columns_of("full")).distinct().collect())
    assert sorted(tuple(r) for r in made.select("order_id", *columns_of("full")).distinct().collect()) == want
    assert made.filter("order_id = 'O003'").count() == 4 and made.filter("order_id = 'O020'").count() == 1


def test_cases_run_along_a_value_in_few_rounds(spark, monkeypatch):
    """F13 to F15: no pointer walks where a running minimum settles the cases; sliced and pointer rounds give the same."""
    t0 = dt.datetime(2025, 2, 1, tzinfo=dt.timezone.utc)
    rows = [(f"O{k:03d}", f"C{k}" if k % 2 else f"C{k - 1}", t0 + dt.timedelta(hours=7 * k), 10.0, f"D{k // 6}", f"I{(k + 3) // 6}", f"A{k % 3}-{k // 9}", None, "a", 0.0, 0.9)
            for k in range(60)]
    alerts = cases.create_alerts(spark.createDataFrame(rows, COLUMNS + ", calibrated_score double"))
    tables, keep = [], cases.materialise
    monkeypatch.setattr(cases, "materialise", lambda df, name: (tables.append(name), keep(df, name))[1])

    def found(**how):
        return {r["order_id"]: r["case_id"] for r in cases.assign_cases(alerts, **how).collect()}

    plain = found()
    assert len(plain) == 60 and "case-walk" not in tables
    assert found(sweeps=1) == plain and "case-walk" in tables
    assert found(hot_rows=1) == plain
    ids = {r["order_id"]: r for r in alerts.collect()}
    want, held = {}, {}
    for o in sorted(ids):
        keys = [("customer", ids[o]["customer_id"]), *map(tuple, ids[o]["entity_keys"])]
        mine = [held[k] for k in keys if k in held]
        want[o] = min(mine) if mine else "CASE-" + hashlib.sha256(ids[o]["alert_id"].encode()).hexdigest()[:16].upper()
        for k in keys:
            held[k] = min(held.get(k, want[o]), want[o])
    assert {o: c.lower() for o, c in plain.items()} == {o: c.lower() for o, c in want.items()}


def test_feature_sets_are_fitted_side_by_side(spark, monkeypatch):
    """each fit waits for another one."""
    meet = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(models, "columns_of", lambda name: ["x"])
    monkeypatch.setattr(models, "fit_model", lambda *_: meet.wait())
    monkeypatch.setattr(models, "predict_scores", lambda _, df: df.withColumn("predicted_score", F.col("x") / 10))
    rows = [(k, 10.0 * k, 1 + k % 5 / 2, ("train", "validation", "test")[k % 3]) for k in range(30)]
    frame = spark.createDataFrame(rows, "order_id long, amount double, x double, split string").withColumn("event_time", F.lit("2025-02-01").cast("timestamp"))
    labels = frame.select("order_id", (F.col("order_id") % 2).alias("is_abuse"), F.lit("R").alias("ring_id"), F.lit("mixed").alias("abuse_type"), F.lit(1.0).alias("loss_amount"))
    table, scored = models.ablation(frame, labels, sets=["baseline", "combined"])
    assert [r["feature_set"] for r in table.collect()] == list(scored) == ["baseline", "combined"]


def test_small_tables_of_near_duplicates_are_few_files(spark, monkeypatch):
    """op10: in as many files as there are shuffle partitions, the tables of all rounds took more disk than the input."""
    parts, keep = {}, near.materialise

    def counted(df, name):
        parts.setdefault(name, []).append(df.rdd.getNumPartitions())
        return keep(df, name)

    monkeypatch.setattr(near, "materialise", counted)
    monkeypatch.setattr(components, "materialise", counted)
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    try:
        base = [f"w{i}" for i in range(60)]
        rows = [(k, " ".join([*base, f"x{k}"])) for k in range(12)]
        got = near.near_duplicates(spark.createDataFrame(rows, "case_id long, narrative string"), 3, 85).collect()
    finally:
        spark.conf.unset(key)
    assert {r["component_id"] for r in got} == {0}
    assert {n for name in ("classes", "members", "open", "centres", "pairs", "parents", "groups", "named") for n in parts[name]} == {1}


def test_parity_makes_the_batch_matrix_while_the_stream_runs(monkeypatch):
    """the stream is waited for after the matrix, and stopped if that fails."""
    log = []

    class Running:
        def awaitTermination(self):
            log.append("waited")

        def stop(self):
            log.append("stopped")

    def matrix(*_):
        log.append("matrix")
        raise RuntimeError("enough")

    monkeypatch.setattr(queries.jobs, "stream_features", lambda *_: Running())
    monkeypatch.setattr(queries, "_arrive", lambda *_: None)
    monkeypatch.setattr(queries, "scratch_path", lambda *_: "nowhere")
    monkeypatch.setattr(queries, "_matrix", matrix)
    with pytest.raises(RuntimeError, match="enough"):
        queries.REGISTRY["q7_parity"][0](None, "nowhere")
    assert log == ["matrix", "stopped"]
