"""Isotonic regression over any number of scores: pooled inside ranges, then across their borders.

The fit is unique, so it does not matter where ranges are cut. Each task pools the neighbours of one range of scores and
leaves its blocks (lowest and highest score, rows, abusive rows). With 0/1 labels the rates of blocks are rising fractions, so
far fewer blocks than scores are left; they are cut anew at other places and pooled again until no border holds a violation or
one range holds them all. No task holds more than about ``rows`` blocks; blocks stay tables.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.sources.scratch import materialise

RANGE_ROWS = 100_000
#: Knots that are sent along with a task (two doubles each); larger curves are joined by score.
HELD_KNOTS = 250_000


def pool_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (lo, hi, bad, n) in the order of ``lo``: neighbours become one while the rate does not rise.

    Rates are compared as products of whole numbers, which is exact, so equal rates always meet in one block."""
    blocks: list[tuple[float, float, int, int]] = []
    for batch in batches:
        for lo, hi, bad, n in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "bad", "n")), strict=True):
            while blocks and blocks[-1][2] * n >= bad * blocks[-1][3]:
                lo, _, before, rows = blocks.pop()
                bad, n = bad + before, n + rows
            blocks.append((lo, hi, bad, n))
    if blocks:
        lo, hi, bad, n = (list(c) for c in zip(*blocks, strict=True))
        part = pa.array(np.full(len(blocks), TaskContext.get().partitionId(), np.int32))
        for batch in pa.table([pa.array(lo), pa.array(hi), pa.array(bad, pa.int64()), pa.array(n, pa.int64()), part],
                              names=["lo", "hi", "bad", "n", "part"]).to_batches(10_000):
            yield batch


def _violations(blocks: DataFrame) -> int:
    """Borders between ranges where the rate does not rise (one row a range)."""
    ends = blocks.groupBy("part").agg(F.min("lo").alias("lo"), F.min_by(F.struct("bad", "n"), "lo").alias("first"),
                                      F.max_by(F.struct("bad", "n"), "lo").alias("last"))
    after = F.lead("first").over(Window.orderBy("lo"))
    rate = [F.col(c).cast("decimal(19,0)") for c in ("last.bad", "after.n", "after.bad", "last.n")]
    return ends.withColumn("after", after).filter(rate[0] * rate[1] >= rate[2] * rate[3]).count()


def isotonic_blocks(df: DataFrame, score: str = "predicted_score", label: str = "is_abuse", rows: int = RANGE_ROWS) -> DataFrame:
    """(lo, hi, bad, n): the blocks of the least-squares rising fit of a 0/1 label on a score.

    Equal scores are one point. Rows without a score (null, NaN) or label take no part; without any row the result is empty."""
    x, y = F.col(score).cast("double"), F.col(label).cast("int")
    points = df.select(x.alias("lo"), y.alias("y")).filter(F.col("lo").isNotNull() & ~F.isnan("lo") & F.col("y").isNotNull())
    blocks = materialise(points.groupBy("lo").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count("*").alias("n"))
                         .select("lo", F.col("lo").alias("hi"), "bad", "n"), "points")
    left, turn, most = blocks.count(), 0, math.inf
    while left:
        ranges = min(math.ceil(left / rows), most)
        # one range more in every other round: the borders of the last round lie inside ranges
        cut = blocks.coalesce(1) if ranges <= 1 else blocks.repartitionByRange(int(ranges) + turn % 2, "lo")
        pooled = materialise(cut.sortWithinPartitions("lo").mapInArrow(pool_neighbours, "lo double, hi double, bad long, n long, part int"), "blocks")
        if ranges <= 1 or not _violations(pooled):
            return pooled.drop("part")
        blocks, before, turn = pooled.drop("part"), left, turn + 1
        left = blocks.count()
        if left == before:
            most = ranges - 1  # the same borders were drawn again: fewer of them
    return blocks


@dataclass
class IsotonicCurve:
    """Rising line through ``knots`` (x, rate): both ends of every block, straight between them, level beyond the outermost."""

    knots: DataFrame
    size: int

    @classmethod
    def fit(cls, df: DataFrame, score: str = "predicted_score", label: str = "is_abuse", rows: int = RANGE_ROWS) -> IsotonicCurve:
        """``ValueError`` where no row has both a score and a label."""
        ends = isotonic_blocks(df, score, label, rows).select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), (F.col("bad") / F.col("n")).alias("rate"))
        return cls._of(materialise(ends, "knots"))

    @classmethod
    def _of(cls, knots: DataFrame) -> IsotonicCurve:
        size = knots.count()
        if not size:
            raise ValueError("no row with a score and a label to fit")
        return cls(knots, size)

    def save(self, path: str) -> None:
        self.knots.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> IsotonicCurve:
        return cls._of(SparkSession.active().read.parquet(path))

    def apply(self, df: DataFrame, score: str = "predicted_score", out: str = "calibrated_score", held: int = HELD_KNOTS) -> DataFrame:
        """``df`` with the rate at each score; null for a null or NaN score."""
        if self.size > held:
            return self._joined(df, score, out, held)
        x, y = (np.array(c) for c in zip(*sorted((r.x, r.rate) for r in self.knots.collect()), strict=True))

        @F.pandas_udf("double")
        def rate(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s.to_numpy(dtype="float64", na_value=np.nan), x, y)).where(s.notna().to_numpy())

        return df.withColumn(out, rate(F.col(score).cast("double")))

    def _joined(self, df: DataFrame, score: str, out: str, held: int) -> DataFrame:
        """Every distinct score meets the knots below and above it in a range whose borders are knots; rows then join their score."""
        pieces = math.ceil(self.size / held)
        borders = sorted(set(self.knots.agg(F.percentile_approx("x", [k / pieces for k in range(1, pieces)], 10 * pieces)).first()[0]))
        place = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= F.col("x")))
        knots = self.knots.select("x", "rate", place.alias("piece"))
        knots = knots.unionByName(knots.filter(F.col("x").isin(borders)).withColumn("piece", F.col("piece") - 1))
        asked = df.select(F.col(score).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x")).distinct()
        knot = F.when(F.col("rate").isNotNull(), F.struct("x", "rate"))
        both = asked.select("x", F.lit(None).cast("double").alias("rate"), place.alias("piece")).unionByName(knots).withColumn("knot", knot)
        near = [F.last("knot", ignorenulls=True).over(Window.partitionBy("piece").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
                for order in (F.asc("x"), F.desc("x"))]
        found = both.withColumns({"below": near[0], "above": near[1]}).filter(F.col("rate").isNull())
        step = (F.col("x") - F.col("below.x")) * (F.col("above.rate") - F.col("below.rate")) / (F.col("above.x") - F.col("below.x"))
        value = F.when(F.col("below").isNull(), F.col("above.rate")).when(
            F.col("above").isNull() | (F.col("above.x") == F.col("below.x")), F.col("below.rate")).otherwise(F.col("below.rate") + step)
        rates = found.select(F.col("x").alias("_x"), value.alias("_rate"))
        key = F.col(score).cast("double")
        return df.withColumn("_k", key).join(rates, F.col("_k") == F.col("_x"), "left").withColumn(out, F.col("_rate")).drop("_k", "_x", "_rate")
