"""Streams give what the batch builders give."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from coterie.operators.cases import assign_cases, create_alerts
from coterie.plans.matrix import feature_matrix
from coterie.streaming import history, jobs
from test_features_model import make_rows, to_df


def parts(spark, df, folder, n):
    """Write df as n files in event-time order, one per micro-batch."""
    rows = df.orderBy("event_time", "order_id").collect()
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size:(k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/p")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p")


@pytest.fixture(scope="module")
def orders(spark):
    return to_df(spark, make_rows(90, seed=3)).cache()


def test_stream_features_equal_batch(spark, orders, tmp_path):
    stream = parts(spark, orders, str(tmp_path), 2)
    q = jobs.stream_features(stream, f"{tmp_path}/hist", f"{tmp_path}/out", f"{tmp_path}/cp", "subgraph_extended")
    q.awaitTermination()
    got = {r["order_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").drop("batch_id").collect()}
    want = {r["order_id"]: r for r in feature_matrix(orders, ties="strict").collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in w.asDict():
            if c != "order_id":
                assert abs(got[k][c] - w[c]) < 1e-5, (k, c)


def test_compacted_history_is_enough(spark):
    orders = to_df(spark, make_rows(700, seed=5)).cache()
    at = orders.agg(F.max("event_time")).first()[0] + dt.timedelta(days=3)
    newer = spark.createDataFrame([("N1", "C3", at, 50.0, "D1", "I2", "A3", "P1", "a", 0.0)], orders.schema)
    kept = history.needed_history(orders, int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))
    assert kept.count() < orders.count()
    full = feature_matrix(orders.unionByName(newer), "combined", ties="strict", targets=newer).first()
    small = feature_matrix(kept.unionByName(newer), "combined", ties="strict", targets=newer).first()
    assert full == small


def spread_rows(batches, seed=11):
    """A list of orders per batch, each of twelve days, from few customers and values."""
    rng = random.Random(seed)
    out = []
    for b in range(batches):
        days = sorted(rng.uniform(12 * b, 12 * b + 12) for _ in range(30))
        out.append([(f"O{b}-{k}", f"C{rng.randrange(9)}", dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=round(day * 86_400)),
                     float(rng.randrange(1, 99)), rng.choice(["D1", "D2", " D2", "", "0", "C3"]), f"I{rng.randrange(6)}", f"A{rng.randrange(9)}",
                     rng.choice(["P1", "P2", None]), rng.choice("abc"), 0.0) for k, day in enumerate(days)])
    return out


COLUMNS = ("order_id string, customer_id string, event_time timestamp, amount double, device_id string, ip_id string, "
           "address_id string, payment_id string, merchant_category string, retry_count double")


def same(got, want, columns):
    assert set(got) == set(want)
    for k, w in want.items():
        for c in columns:
            assert abs(got[k][c] - w[c]) < 1e-5, (k, c, got[k][c], w[c])


def test_twelve_batches_read_a_bounded_history(spark, tmp_path):
    """144 days, features of 30: what a batch reads stops growing, late and repeated orders come right."""
    batches = spread_rows(12)
    for k in range(1, 12):  # two orders of each batch come one batch late, one is repeated
        batches[k] += [batches[k - 1].pop(3), batches[k - 1].pop(3), batches[k - 1][5]]
    store = history.HistoryStore(f"{tmp_path}/hist", buckets=4, late_days=13, compact_every=3)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (4, 11):  # the second run has a new checkpoint and meets everything again
            stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1 if k == 4 else 7).parquet(f"{tmp_path}/in")
            jobs.stream_features(stream, store, f"{tmp_path}/out", f"{tmp_path}/cp{k}", "baseline").awaitTermination()
    got = {r["order_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    everything = spark.createDataFrame([r for rows in batches for r in rows], COLUMNS).dropDuplicates(["order_id"])
    want = {r["order_id"]: r for r in feature_matrix(everything, "baseline", ties="strict").collect()}
    # an order whose customer's late order came after it was scored without that one
    late = {(r[1], r[2]) for k in range(1, 12) for r in batches[k][-3:-1]}
    blind = {r[0] for k, rows in enumerate(batches) for r in rows
             if any(c == r[1] and t < r[2] and (r[2] - t).days < 31 for c, t in late)}
    assert len(blind) < len(want) and set(got) == set(want)
    same({k: v for k, v in got.items() if k not in blind}, {k: v for k, v in want.items() if k not in blind}, [c for c in want["O0-0"].asDict() if c != "order_id"])
    assert store.rows(spark).count() < everything.count()


def test_history_serves_what_a_batch_can_reach(spark, tmp_path):
    """All 137 columns of a new order from the stored, compacted rows within reach, against all rows."""
    batches = spread_rows(9, seed=3)
    store = history.HistoryStore(f"{tmp_path}/hist", buckets=4, compact_every=3)
    reads = []
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, COLUMNS)
        reach = store.near(batch)
        reads.append(reach[0].count() if reach else 0)
        store.append(batch, "q", k, reads[-1])
        assert store.committed(spark, "q", k) and not store.committed(spark, "q", k + 1) and not store.committed(spark, "other", 0)
    assert store.state(spark)["read"] == reads
    assert max(reads[6:]) < 2 * max(reads[3:6])
    at = batches[-1][-1][2] + dt.timedelta(hours=5)
    far = [("X1", "Z1", at, 1.0, "Z2", "Z3", "Z4", "Z5", "a", 0.0)]
    assert store.near(spark.createDataFrame(far, COLUMNS))[0].count() == 0
    new = spark.createDataFrame([("N1", "C3", at, 50.0, "D1", "I2", "A3", "P1", "a", 0.0), ("O8-3", "C1", at, 1.0, "D2", "I1", "A1", "P2", "a", 0.0)], COLUMNS)
    past, again = store.near(new)
    assert [r[0] for r in again.collect()] == ["O8-3"]
    every = spark.createDataFrame([r for rows in batches for r in rows], COLUMNS)
    one = new.where("order_id = 'N1'")
    full = feature_matrix(every.unionByName(one), ties="strict", targets=one.select("order_id")).first()
    small = feature_matrix(past.unionByName(one), ties="strict", targets=one.select("order_id")).first()
    assert full == small


def test_a_batch_that_dies_before_its_commit_runs_again(spark, tmp_path):
    rows = [r for part in spread_rows(2) for r in part]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in")
    store = history.HistoryStore(f"{tmp_path}/hist", buckets=2)
    said = []

    def dies_once(batch, feats, name):
        said.append(name)
        if len(said) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.stream_features(stream, store, f"{tmp_path}/out", f"{tmp_path}/cp", "baseline", then=dies_once).awaitTermination()
    assert store.rows(spark) is None
    for _ in range(2):
        jobs.stream_features(stream, store, f"{tmp_path}/out", f"{tmp_path}/cp", "baseline", then=dies_once).awaitTermination()
    assert said[0] == said[1] and len(said) == 2
    assert store.rows(spark).count() == spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_stream_dedup(spark, orders, tmp_path):
    twice = orders.unionByName(orders)
    stream = parts(spark, twice, str(tmp_path), 3)
    q = jobs.stream_dedup(stream).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == orders.select("order_id").distinct().count()


def test_stream_cases_equal_batch(spark, orders, tmp_path):
    scored = orders.withColumn("calibrated_score", (F.pmod(F.xxhash64("order_id"), F.lit(100)) / 100.0))
    alerts = create_alerts(scored)
    rows = alerts.orderBy("t", "order_id").collect()
    for k in range(3):
        spark.createDataFrame(rows[k * 20:(k + 1) * 20 if k < 2 else None],
                              alerts.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/a")
    jobs.stream_cases(stream, f"{tmp_path}/c").awaitTermination()
    got = {r["order_id"]: r["case_id"] for r in spark.read.parquet(f"{tmp_path}/c/cases").collect()}
    want = {r["order_id"]: r["case_id"] for r in assign_cases(alerts).collect()}
    assert got == want


def test_daily_metrics_and_label_join(spark, orders, tmp_path):
    log = orders.select("order_id", "event_time", F.col("amount").alias("latency_ms"), F.lit(False).alias("fallback_applied"),
                        (F.col("amount") > 50).alias("alert"))
    stream = parts(spark, log, str(tmp_path), 2)
    q = jobs.stream_daily_metrics(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {str(r["d"]): r["count"] for r in log.groupBy(F.to_date("event_time").alias("d")).count().collect()}
    assert {r["date"]: r["requests"] for r in spark.table("daily").collect()} == want
    labels = orders.select("order_id", (F.col("event_time") + F.expr("interval 5 days")).alias("ground_truth_label_timestamp"),
                           F.lit(1).alias("is_abuse"))
    preds = orders.select("order_id", F.col("event_time").alias("prediction_timestamp"), F.lit(0.7).alias("calibrated_score"))
    a = parts(spark, preds.withColumnRenamed("prediction_timestamp", "event_time"), f"{tmp_path}/x", 1).withColumnRenamed("event_time", "prediction_timestamp")
    b = parts(spark, labels.withColumnRenamed("ground_truth_label_timestamp", "event_time"), f"{tmp_path}/y", 1).withColumnRenamed(
        "event_time", "ground_truth_label_timestamp")
    q = jobs.stream_label_join(a, b).writeStream.format("memory").queryName("joined").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("joined").count() == orders.count()


def test_customer_state_equals_batch(spark, orders, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = parts(spark, orders, str(tmp_path), 2)
        q = jobs.stream_customer_state(stream).writeStream.format("memory").queryName("state").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r["order_id"]: r for r in spark.table("state").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r["order_id"]: r for r in feature_matrix(orders, "extended", ties="strict").collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("prior_order_count", "prior_spend", "customer_order_count_1h", "customer_order_count_24h",
                  "customer_order_count_7d", "customer_order_count_30d", "prior_category_count"):
            assert abs(got[k][c] - w[c]) < 1e-6, (k, c, got[k][c], w[c])


def test_customer_state_with_late_orders(spark, orders, tmp_path):
    """The second batch lies before the first one: categories count by their first use."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = orders.orderBy(F.col("event_time").desc()).collect()
        half = len(rows) // 2
        for k in range(2):
            spark.createDataFrame(rows[k * half:(k + 1) * half if k == 0 else None], orders.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/late")
        jobs.stream_customer_state(stream).writeStream.format("memory").queryName("late").trigger(availableNow=True).start().awaitTermination()
        got = {r["order_id"]: r["prior_category_count"] for r in spark.table("late").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r["order_id"]: r["prior_category_count"] for r in feature_matrix(orders, "baseline", ties="strict").collect()}
    old = {r["order_id"] for r in rows[half:]}  # what came second is complete only with itself: no later row may count
    assert {k: v for k, v in got.items() if k in old} == {k: v for k, v in want.items() if k in old}
