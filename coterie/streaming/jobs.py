"""Streams of transactions: dedup, features, alerts, metrics, label joins, cases, history.

Feature and case streams run the batch builders on each micro-batch over stored history.  Outputs
are written under the names of their query and batch, so a batch that runs again replaces itself.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from coterie.operators.asof import SkewPlan, timed
from coterie.operators.cases import assign_cases, create_alerts
from coterie.operators.models import StoredModel
from coterie.plans.matrix import feature_matrix
from coterie.schema import DAY, HOUR
from coterie.sources.scratch import materialise
from coterie.streaming.history import HistoryStore, folders, read_query_id


def stream_dedup(stream: DataFrame, memory: str = "30 days", time: str = "event_time") -> DataFrame:
    """The first claim of an order id wins, remembered for ``memory`` of event time."""
    return (stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, memory)
            .dropDuplicatesWithinWatermark(["order_id"]))


# ---- history ------------------------------------------------------------------------------------

def _stored(spark: SparkSession, path: str, running: str | None = None) -> DataFrame | None:
    """A batch-partitioned table without the batch ``running``; None when there is none yet."""
    if not any(n.startswith("batch_id=") for n in folders(spark, path)):
        return None
    df = spark.read.parquet(path)
    return df if running is None else df.filter(F.col("batch_id").cast("string") != running)


def _put(df: DataFrame, path: str, batch: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def _named(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Name of a batch: batches of another checkpoint have other names and stay."""
    return f"{read_query_id(spark, checkpoint)}-{batch_id}"


# ---- features and alerts ------------------------------------------------------------------------

def stream_features(stream: DataFrame, history: str | HistoryStore, out: str, checkpoint: str, name: str = "subgraph_extended",
                    skew: SkewPlan | None = None,
                    then: Callable[[DataFrame, DataFrame, str], None] | None = None, once: bool = True) -> StreamingQuery:
    """As-of features of every arriving order, with strict time order (t_j < t_i).

    Each batch is scored over itself and what it can reach of the stored history (a ``HistoryStore``, or the path of one
    with its defaults) at its own event times, and stored after; ``then(batch, features, name of the batch)`` runs in between. Orders
    of one batch see each other by event time, not by arrival. An order id that is stored is not scored again. The
    commit of the history is a batch's last act: a batch that runs again before it replaces its output, after it
    does nothing. Another stream, or one with a new checkpoint, goes on with the history that is there.
    """
    store = HistoryStore(history) if isinstance(history, str) else history

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = read_query_id(spark, checkpoint)
        if store.committed(spark, query, batch_id):
            return
        batch = materialise(batch.dropDuplicates(["order_id"]), "arrived")
        rows, read = batch, 0
        reach = store.near(batch)
        if reach is not None:
            past, again = reach
            read = past.count()
            batch = batch.join(again.select(F.col("order_id").cast(batch.schema["order_id"].dataType)), "order_id", "left_anti")
            if batch.isEmpty():
                store.append(batch, query, batch_id, read)
                return
            rows = past.unionByName(batch)
        feats = feature_matrix(rows, name, ties="strict", skew=skew, targets=batch.select("order_id"))
        _put(feats, out, f"{query}-{batch_id}")
        if then is not None:
            then(batch, spark.read.parquet(f"{out}/batch_id={query}-{batch_id}"), f"{query}-{batch_id}")
        store.append(batch, query, batch_id, read)

    w = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def alert_step(model: str | Callable[[], str], alerts: str, audit: str) -> Callable[[DataFrame, DataFrame, str], None]:
    """A ``then`` for ``stream_features``: score by the stored model at the path ``model``, write alerts and the audit lines of the batch.

    The model is loaded once a stream, when the first batch has its features; ``model`` may be a function that waits for
    the path until then. Features that differ from its column contract end the batch.
    """
    loaded: list[StoredModel] = []

    def work(batch: DataFrame, feats: DataFrame, batch_id: str) -> None:
        if not loaded:
            loaded.append(StoredModel.load(model() if callable(model) else model))
        scores = loaded[0].score(feats.drop("batch_id")).select("order_id", "predicted_score", "calibrated_score", "alert")
        scored = materialise(batch.drop("predicted_score", "calibrated_score", "alert").join(scores, "order_id").withColumn(
            "fallback_applied", F.lit(False)), "scored")
        _put(create_alerts(scored, loaded[0].threshold), alerts, batch_id)
        line = scored.select(
            F.col("order_id").cast("string"), F.col("predicted_score").alias("risk_score"), "calibrated_score",
            "alert", F.lit(loaded[0].threshold).alias("threshold"), "fallback_applied",
            F.col("event_time").cast("timestamp").cast("string").alias("timestamp"), F.lit(True).alias("shadow_mode"),
            F.lit(False).alias("enforcement_applied"))
        line.write.mode("overwrite").json(f"{audit}/batch_id={batch_id}")

    return work


def stream_alerts(stream: DataFrame, model: str | Callable[[], str], folder: str, name: str = "subgraph_extended", once: bool = True,
                  history: HistoryStore | None = None) -> StreamingQuery:
    """Features, scores of the stored model at the path ``model`` (see ``alert_step``), alerts and audit lines under ``folder``."""
    return stream_features(stream, history or f"{folder}/history", f"{folder}/features", f"{folder}/checkpoint", name,
                           then=alert_step(model, f"{folder}/alerts", f"{folder}/audit"), once=once)


# ---- keyed state --------------------------------------------------------------------------------

STATE_OUT = ("order_id string, customer_id string, prior_order_count double, prior_spend double, "
             "customer_order_count_1h double, customer_order_count_24h double, customer_order_count_7d double, "
             "customer_order_count_30d double, prior_category_count double")


class CustomerWindow(StatefulProcessor):
    """Keeps the customer's orders of the last 30 days, and of each category ever used its first use.

    Both stay with the customer: the window is cut when the customer orders again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "t long, amount double")
        self.categories = handle.getMapState("categories", "category string", "first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "order_id"], kind="stable")
        past = list(self.recent.get())
        t = np.array([r[0] for r in past], dtype="int64")
        amount = np.array([r[1] for r in past], dtype="float64")
        t = np.concatenate([t, batch["t"].to_numpy("int64")])
        amount = np.concatenate([amount, batch["amount"].to_numpy("float64")])
        order = np.argsort(t, kind="stable")
        t, amount = t[order], amount[order]
        spent = np.concatenate([[0.0], np.cumsum(amount)])
        now = batch["t"].to_numpy("int64")
        upto = np.searchsorted(t, now, "left")

        def since(w: int) -> np.ndarray:
            return np.searchsorted(t, now - w, "right")

        first = {k[0]: v[0] for k, v in self.categories.iterator()}
        changed = {c: int(at) for c, at in batch.groupby("merchant_category")["t"].min().items() if c not in first or at < first[c]}
        first |= changed
        born = np.sort(np.fromiter(first.values(), "int64", len(first)))
        out = pd.DataFrame({
            "order_id": batch["order_id"].astype(str), "customer_id": str(key[0]),
            "prior_order_count": (upto - since(30 * DAY)).astype(float),
            "prior_spend": spent[upto] - spent[since(30 * DAY)],
            "customer_order_count_1h": (upto - since(HOUR)).astype(float),
            "customer_order_count_24h": (upto - since(DAY)).astype(float),
            "customer_order_count_7d": (upto - since(7 * DAY)).astype(float),
            "customer_order_count_30d": (upto - since(30 * DAY)).astype(float),
            "prior_category_count": np.searchsorted(born, now, "left").astype(float)})
        keep = t > t.max() - 30 * DAY
        self.recent.put([(int(a), float(b)) for a, b in zip(t[keep], amount[keep])])
        for c, at in changed.items():
            self.categories.updateValue((c,), (at,))
        yield out

    def close(self) -> None:
        pass


def stream_customer_state(stream: DataFrame) -> DataFrame:
    """Per-customer windows from keyed state (needs the RocksDB state store).

    A late order counts what came before it in its own time, categories by their first use; one older than the
    state's 30 days no longer finds its window.
    """
    rows = timed(stream).select(F.col("order_id").cast("string"), F.col("customer_id").cast("string"), "t",
                                F.col("amount").cast("double"), "merchant_category")
    return rows.groupBy("customer_id").transformWithStateInPandas(
        statefulProcessor=CustomerWindow(), outputStructType=STATE_OUT, outputMode="Append", timeMode="None")


# ---- metrics, labels, cases ---------------------------------------------------------------------

def stream_daily_metrics(log: DataFrame, time: str = "event_time", late: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """Per UTC day: requests, fallbacks, alerts, latency quantiles."""
    rows = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, "1 day")).agg(
        F.count("*").alias("requests"), F.count_if("fallback_applied").alias("fallbacks"), F.count_if("alert").alias("alerts"),
        F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy).alias("q"))
    return out.select(F.to_date("window.start").cast("string").alias("date"), "requests", "fallbacks",
                      (F.col("fallbacks") / F.col("requests")).alias("fallback_rate"), "alerts",
                      *[F.col("q")[k].alias(f"latency_{n}") for k, n in enumerate(("p50", "p95", "p99"))])


def stream_label_join(predictions: DataFrame, labels: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """Predictions with the labels that arrive within ``days`` after them.

    predictions: order_id, prediction_timestamp, calibrated_score; labels: order_id,
    ground_truth_label_timestamp, is_abuse.
    """
    p = predictions.withWatermark("prediction_timestamp", late)
    q = labels.withColumnRenamed("order_id", "label_order_id").withWatermark("ground_truth_label_timestamp", late)
    cond = F.expr(f"order_id = label_order_id AND ground_truth_label_timestamp >= prediction_timestamp AND "
                  f"ground_truth_label_timestamp <= prediction_timestamp + INTERVAL {int(days)} DAYS")
    return p.join(q, cond).drop("label_order_id")


def stream_cases(alerts: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Incremental case assignment of a stream of alerts (see ``assign_cases``).

    Only stored alerts that share a customer or value with the batch are read back into the step.
    """
    def link(df: DataFrame) -> DataFrame:
        return df.select("alert_id", F.explode(F.concat(
            F.array(F.concat(F.lit("customer:"), F.col("customer_id").cast("string"))),
            F.transform("entity_keys", lambda x: F.concat_ws(":", x["etype"], x["value"])))).alias("v"))

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        running = _named(spark, f"{folder}/checkpoint", batch_id)
        batch = batch.dropDuplicates(["alert_id"])
        known = _stored(spark, f"{folder}/cases", running)
        if known is not None:
            batch = batch.join(known.select("alert_id"), "alert_id", "left_anti")
            near = link(known).join(link(batch).select("v").distinct(), "v", "left_semi").select("alert_id").distinct()
            known = known.join(near, "alert_id", "left_semi")
        done = assign_cases(batch, known).select("alert_id", "case_id")
        _put(batch.join(done, "alert_id"), f"{folder}/cases", running)

    w = alerts.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/checkpoint")
    return (w.trigger(availableNow=True) if once else w).start()
