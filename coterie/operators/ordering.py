"""Order statistics and running sums over one global order, without a one-task window.

* ``quantiles`` narrows a value range with bounded histograms until the wanted ranks are isolated:
  a few column-pruned passes, exact results, only histograms reach the driver.
* ``running`` sums along a sorted value: rows are first grouped by value, cut at sketched quantiles
  so that no piece holds more than a small share of the values, summed inside each piece, and the
  piece totals are summed and joined back.  The number of pieces follows the number of values.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.sources.scratch import materialise

PIECE_ROWS = 50_000
BUCKETS = 512
GATHER = 5_000


def order_statistics(df: DataFrame, value: str, ranks, by: str | None = None) -> dict:
    """{group: {rank: value}} for 0-based ranks; ``ranks`` maps a group's row count to the ranks wanted.

    Groups must be few (feature names, days); the ungrouped call uses the group None.  Infinite
    values take the first and last ranks by their number; only finite ones are narrowed down.
    """
    spark = df.sparkSession
    v = F.col(value).cast("double")
    rows = df.select((F.col(by) if by else F.lit(0)).alias("_g"), v.alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    todo: list[list] = []  # group, rank, lo, hi, rows below lo, rows inside
    found: dict = {}
    finite = F.abs("_v") < float("inf")
    for g, n, low, inside, lo, hi in rows.groupBy("_g").agg(
            F.count("*"), F.count_if(F.col("_v") == float("-inf")), F.count_if(finite),
            F.min(F.when(finite, F.col("_v"))), F.max(F.when(finite, F.col("_v")))).collect():
        found[g] = {}
        for r in sorted(set(ranks(n))):
            if low <= r < low + inside:
                todo.append([g, r, lo, hi, low, inside])
            else:
                found[g][r] = float("-inf") if r < low else float("inf")
    rows = rows.filter(finite)
    while todo:
        for t in [t for t in todo if t[2] == t[3]]:
            found[t[0]][t[1]] = t[2]
            todo.remove(t)
        if not todo:
            break
        spans = sorted({(t[0], t[2], t[3], t[5] <= GATHER) for t in todo}, key=str)
        ids = {s: k for k, s in enumerate(spans)}
        span_df = F.broadcast(spark.createDataFrame(
            [(k, s[0], s[1], s[2], s[2] / BUCKETS - s[1] / BUCKETS, s[3]) for s, k in ids.items()],
            ["_k", "_g", "_lo", "_hi", "_step", "_all"]).withColumn("_g", F.col("_g").cast(rows.schema["_g"].dataType)))
        inside = rows.join(span_df, "_g").filter("_v >= _lo and _v <= _hi")
        # few rows left: one bucket per value; else equal steps
        b = F.when(F.col("_all"), F.col("_v")).otherwise(
            F.least(F.floor(F.try_divide("_v", "_step") - F.try_divide("_lo", "_step")).cast("double"), F.lit(float(BUCKETS - 1))))
        hist: dict = {}
        for k, _, n, lo, hi in (inside.groupBy("_k", b.alias("_b"))
                                .agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()):
            hist.setdefault(k, []).append((lo, hi, n))
        for k in hist:
            hist[k].sort()
        for t in todo:
            base = t[4]
            for lo, hi, n in hist[ids[(t[0], t[2], t[3], t[5] <= GATHER)]]:
                if base + n > t[1]:
                    if (lo, hi) == (t[2], t[3]) and lo != hi:
                        raise ValueError(f"values of {value} between {lo} and {hi} are too close to be told apart")
                    t[2], t[3], t[4], t[5] = lo, hi, base, n
                    break
                base += n
    return found if by else {None: next(iter(found.values()), {})}


def quantiles(df: DataFrame, value: str, probs: list[float], by: str | None = None) -> dict:
    """{group: [quantile, ...]} with linear interpolation between neighbours, exact."""
    sizes: dict = {}

    def wanted(n: int) -> list[int]:
        out = []
        for p in probs:
            h = (n - 1) * p
            out += [math.floor(h), min(math.floor(h) + 1, n - 1)]
        return out

    def note(n: int) -> list[int]:
        return wanted(n)

    v = F.col(value).cast("double")
    counted = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy((F.col(by) if by else F.lit(0)).alias("_g")).count().collect()
    for g, n in counted:
        sizes[g if by else None] = n
    stats = order_statistics(df, value, note, by)
    out = {}
    for g, n in sizes.items():
        row = []
        for p in probs:
            h = (n - 1) * p
            lo = math.floor(h)
            a, b = stats[g][lo], stats[g][min(lo + 1, n - 1)]
            row.append(a if a == b or h == lo else a + (b - a) * (h - lo))
        out[g] = row
    return out


def running(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None,
            descending: bool = False) -> DataFrame:
    """One row per (by, value): the sums of the value, their totals up to and including it (``cum_*``)
    and the next value in the order (``next_value``)."""
    by = by or []
    keys = by or ["_one"]
    src = df if by else df.withColumn("_one", F.lit(1))
    src = src.select(*keys, F.col(value).cast("double").alias("value"), *sums)
    cells = materialise(src.groupBy(*keys, "value").agg(*[F.sum(s).alias(s) for s in sums]), "cells")
    pieces = max(2, min(cells.count() // PIECE_ROWS, 2_000))
    cuts = F.percentile_approx("value", [k / pieces for k in range(1, pieces)], 5 * pieces)
    # one row per group, and groups are few
    edges = F.broadcast(cells.groupBy(*keys).agg(cuts.alias("_edges")))
    cells = cells.join(edges, keys).withColumn(
        "_piece", F.size(F.filter("_edges", lambda e: e <= F.col("value")))).drop("_edges")
    sort = F.col("value").desc() if descending else F.col("value").asc()
    inside = Window.partitionBy(*keys, "_piece").orderBy(sort)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = cells.select("*", *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums],
                         F.lead("value").over(inside).alias("next_value"))
    piece = cells.groupBy(*keys, "_piece").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums],
                                               (F.max("value") if descending else F.min("value")).alias("_first"))
    porder = Window.partitionBy(*keys).orderBy(F.col("_piece").desc() if descending else F.col("_piece").asc())
    ahead = piece.select(*keys, "_piece", F.lead("_first").over(porder).alias("_after"),
                         *[F.coalesce(F.sum(f"_t_{s}").over(porder.rowsBetween(Window.unboundedPreceding, -1)),
                                      F.lit(0)).alias(f"_b_{s}") for s in sums])
    return local.join(ahead, [*keys, "_piece"]).select(
        *by, "value", *sums, *[(F.col(f"cum_{s}") + F.col(f"_b_{s}")).alias(f"cum_{s}") for s in sums],
        F.coalesce("next_value", "_after").alias("next_value"))
