"""All 137 columns against the sequential model, on data full of ties, blanks and colliding strings."""
import datetime as dt
import random

import pytest

from coterie.operators.asof import find_skew
from coterie.plans.matrix import feature_matrix
from coterie.schema import FEATURE_CONTRACT
from sequential_model import DAY, HOUR, model

T0 = dt.datetime(2025, 2, 1, tzinfo=dt.timezone.utc)
EPOCH = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp()


def make_rows(n, seed, hot=0.0):
    rng = random.Random(seed)
    rows = []
    steps = [0, 0, 0, 60, 1800, HOUR, 5 * HOUR, DAY, DAY, 2 * DAY]
    t = T0.timestamp()
    pool = {e: [f"{e[0].upper()}{k}" for k in range(9)] + ["", " NaN ", "0", "null", "X1", "X1 ", "C3"]
            for e in ("device", "ip", "address", "payment")}
    for k in range(n):
        t += rng.choice(steps) * (0.35 if rng.random() < .7 else 1)
        t = round(t)
        big = rng.random() < hot
        rows.append({"order_id": f"O{rng.randrange(10**6):06d}-{k}", "customer_id": "C0" if big and rng.random() < .6 else f"C{rng.randrange(14)}",
                     "t": t, "amount": rng.choice([10.0, 20.5, 99.99, 1234.56]), "category": rng.choice("abc"),
                     "retry": float(rng.randrange(3)),
                     **{e: ("HOT" if big and e == "ip" else rng.choice(v)) for e, v in pool.items()}})
    return rows


def to_df(spark, rows):
    data = [(r["order_id"], r["customer_id"], dt.datetime.fromtimestamp(r["t"], dt.timezone.utc), r["amount"],
             r["device"], r["ip"], r["address"], r["payment"], r["category"], r["retry"]) for r in rows]
    return spark.createDataFrame(data, "order_id string, customer_id string, event_time timestamp, amount double, "
                                       "device_id string, ip_id string, address_id string, payment_id string, "
                                       "merchant_category string, retry_count double")


@pytest.mark.parametrize("ties,hot", [("sequence", False), ("strict", False), ("sequence", True), ("strict", True)])
def test_matrix_equals_model(spark, ties, hot):
    rows = make_rows(260, seed=7 if ties == "sequence" else 8, hot=0.4 if hot else 0.0)
    orders = to_df(spark, rows)
    skew = find_skew(orders, max_rows=40) if hot else None
    if hot:
        assert skew.customers is not None and skew.values is not None
    got = {r["order_id"]: r for r in feature_matrix(orders, ties=ties, skew=skew, crowd=3 if hot else 256, heavy=4 if hot else 1_000).collect()}
    want = model(rows, ties=ties, epoch=EPOCH)
    assert set(got) == set(want)
    wrong = {}
    for oid, w in want.items():
        assert set(w) == set(FEATURE_CONTRACT)
        for c in FEATURE_CONTRACT:
            if abs(got[oid][c] - w[c]) > 1e-6 * max(1.0, abs(w[c])):
                wrong.setdefault(c, []).append((oid, got[oid][c], w[c]))
    assert not wrong, {c: (len(v), v[:2]) for c, v in wrong.items()}
