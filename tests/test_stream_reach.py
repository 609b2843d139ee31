"""What a stream walks from, and what it waits for."""
import concurrent.futures
import datetime as dt

import pytest

from coterie.plans import queries
from coterie.streaming import history
from test_streaming import COLUMNS, spread_rows


def test_stored_orders_are_not_walked_from_again(spark, tmp_path, monkeypatch):
    """a batch of orders that are stored already read all they reach before it was dropped."""
    batches = spread_rows(3, seed=3)
    store = history.HistoryStore(f"{tmp_path}/hist", buckets=4)
    for k, rows in enumerate(batches):
        store.append(spark.createDataFrame(rows, COLUMNS), "q", k)
    tables, keep = [], history.materialise
    monkeypatch.setattr(history, "materialise", lambda df, name: tables.append(name) or keep(df, name))
    past, again = store.near(spark.createDataFrame(batches[1], COLUMNS))
    assert past.count() == 0 and past.columns == list(spark.createDataFrame(batches[1], COLUMNS).columns)
    assert {r[0] for r in again.collect()} == {r[0] for r in batches[1]}
    assert "near" not in tables and tables.count("users") == 1
    new = ("N1", "C3", batches[-1][-1][2] + dt.timedelta(hours=5), 50.0, "D1", "I2", "A3", "P1", "a", 0.0)
    alone = {r[0] for r in store.near(spark.createDataFrame([new], COLUMNS))[0].collect()}
    assert alone and {r[0] for r in store.near(spark.createDataFrame([new, *batches[1]], COLUMNS))[0].collect()} == alone


def test_alerts_wait_for_a_model_that_is_being_fitted(monkeypatch):
    """the stream is started before the model is fitted, and stopped if that fails."""
    log = []

    class Running:
        def awaitTermination(self):
            log.append("waited")

        def stop(self):
            log.append("stopped")

    def started(stream, model, *_, **__):
        log.append("started")
        waits.append(model)
        return Running()

    def fitted(*_):
        log.append("fitted")
        raise RuntimeError("enough")

    waits = []
    monkeypatch.setattr(queries.jobs, "stream_alerts", started)
    monkeypatch.setattr(queries, "_arrive", lambda *_: None)
    monkeypatch.setattr(queries, "scratch_path", lambda *_: "nowhere")
    monkeypatch.setattr(queries, "_model_path", fitted)
    with pytest.raises(RuntimeError, match="enough"):
        queries.REGISTRY["st4_stream_alerts"][0](None, "nowhere")
    assert log == ["started", "fitted", "stopped"]
    with pytest.raises(concurrent.futures.CancelledError):
        waits[0]()
