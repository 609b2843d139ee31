"""Isotonic regression against its min-max formula, cut into one range and into many; shift per group."""
import random

import numpy as np
import pytest

from coterie.operators.drift import psi, psi_by
from coterie.operators.isotonic import IsotonicCurve, isotonic_blocks

SCHEMA = "predicted_score double, is_abuse int"


def min_max(rows):
    """{score: max over starts of the min over ends of the mean between them}."""
    xs = sorted({x for x, _ in rows})
    at = {x: i for i, x in enumerate(xs)}
    n, bad = np.zeros(len(xs)), np.zeros(len(xs))
    for x, y in rows:
        n[at[x]] += 1
        bad[at[x]] += y
    cn, cb = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], bad.cumsum()])
    out = {}
    for i, x in enumerate(xs):
        ends = np.arange(i + 1, len(xs) + 1)
        out[x] = max(((cb[ends] - cb[a]) / (cn[ends] - cn[a])).min() for a in range(i + 1))
    return out


def noisy(n, levels):
    r = random.Random(7)
    return [(x, int(r.random() < x)) for x in (round(r.random(), levels) for _ in range(n))]


# rates rise on either side, yet all of the left lies above all of the right: everything is one block
SWALLOWED = [(i / 100, int(j < 50 + i)) for i in range(40) for j in range(90)] + [(0.5 + i / 100, int(j < i)) for i in range(40) for j in range(90)]
RISING = [(i / 50, int(j < i)) for i in range(50) for j in range(50)]


@pytest.mark.parametrize("rows", [noisy(400, 6), noisy(600, 2), SWALLOWED, RISING, [(0.5, 1)]], ids=["noisy", "ties", "swallowed", "rising", "one"])
@pytest.mark.parametrize("size", [8, 100_000])
def test_fit_equals_the_min_max_formula(spark, rows, size):
    frame = spark.createDataFrame(rows, SCHEMA)
    blocks = sorted(tuple(b) for b in isotonic_blocks(frame, rows=size).collect())
    assert all(a[1] < b[0] and a[2] * b[3] < b[2] * a[3] for a, b in zip(blocks, blocks[1:], strict=False))
    assert sum(b[3] for b in blocks) == len(rows)
    for x, want in min_max(rows).items():
        got = [b[2] / b[3] for b in blocks if b[0] <= x <= b[1]]
        assert got == [pytest.approx(want, abs=1e-12)]


@pytest.mark.parametrize("held", [250_000, 5])
def test_rates_between_beyond_and_without_scores(spark, held):
    rows = noisy(300, 2)
    curve = IsotonicCurve.fit(spark.createDataFrame(rows, SCHEMA))
    knots = sorted((r.x, r.rate) for r in curve.knots.collect())
    asked = [-1.0, 0.0, 0.123, 0.5, 0.5, 0.505, 0.77, 2.0, float("inf"), None, float("nan")] + [x for x, _ in knots]
    frame = spark.createDataFrame(list(enumerate(asked)), "order_id int, predicted_score double")
    got = {r.order_id: r.calibrated_score for r in curve.apply(frame, held=held).collect()}
    assert len(got) == len(asked)
    for i, x in enumerate(asked):
        if x is None or x != x:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(np.interp(x, *zip(*knots, strict=True)), abs=1e-12)


def test_rows_without_score_or_label_and_empty_tables(spark, tmp_path):
    rows = [(0.1, 0), (0.2, 1), (None, 1), (float("nan"), 1), (0.3, None)]
    assert sorted(tuple(b) for b in isotonic_blocks(spark.createDataFrame(rows, SCHEMA)).collect()) == [(0.1, 0.1, 0, 1), (0.2, 0.2, 1, 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert isotonic_blocks(empty).count() == 0
    with pytest.raises(ValueError, match="no row"):
        IsotonicCurve.fit(empty)
    curve = IsotonicCurve.fit(spark.createDataFrame(rows, SCHEMA))
    curve.save(f"{tmp_path}/steps")
    assert sorted(IsotonicCurve.load(f"{tmp_path}/steps").knots.collect()) == sorted(curve.knots.collect())
    assert curve.apply(empty).count() == 0


def test_shift_per_group_equals_the_shift_of_each_group_alone(spark):
    r = random.Random(3)
    rows = [(d, r.gauss(d, 1.0)) for d in range(3) for _ in range(200)] + [(1, None), (2, float("nan"))]
    frame = spark.createDataFrame(rows, "day int, v double")
    base = frame.filter("day = 0")
    got = {x.day: x.psi for x in psi_by(base, frame, "v", "day").collect()}
    for day in range(3):
        assert got[day] == pytest.approx(psi(base, frame.filter(f"day = {day}"), ["v"]).first().psi, abs=1e-12)
    assert psi_by(frame.limit(0), frame, "v", "day").count() == 0
    assert psi_by(base, frame.limit(0), "v", "day").count() == 0
