"""As-of building blocks.

For an order i let prec(i) be the orders before it in (event time, order id) order and
W(i, w) those of them with t > t_i - w.  Every feature is an aggregate over one of the two.

``sweep`` turns such an aggregate into a running sum: an order adds its contribution when it
happens and gives it back when it leaves the window, at t + w.  The cost is linear in the rows
however dense a key is; a RANGE frame would re-read the whole window for every row.  Distinct
counts work the same way: a row counts while it is the newest row of its item in the window.

Skew: a key may hold a third of all rows, so one window partition per key is not enough.  The
keys found to be hot are cut into fixed time slices, each its own partition; what earlier slices
left behind (one small row per slice) is summed up and joined back.  Cold keys keep one slice.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import clean_entity, raw_entity
from coterie.schema import DAY, ENTITIES, ENTITY_COLUMNS, HOUR

ONE_SLICE = -1


@dataclass(frozen=True)
class Measure:
    """``name`` = sum of ``add`` over W(i, window), or over prec(i) when window is None.

    ``drop`` is what leaves at t + window; by default all that came in.
    """

    name: str
    add: Column
    window: int | None = None
    drop: Column | None = None
    dtype: str = "long"


@dataclass(frozen=True)
class SkewPlan:
    """Which keys are hot.  ``None`` tables mean: no such key, no slicing in the plan.

    ``parts`` is the number of shuffle partitions that keeps one task's share of the orders bounded; None leaves it
    to the session, whose fixed number lets a task grow with the table.
    """

    customers: DataFrame | None = None
    values: DataFrame | None = None
    slice_us: int = HOUR
    parts: int | None = None

    def deal(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(*keys) if self.parts is None else rows.repartition(self.parts, *keys)

    def mark(self, rows: DataFrame) -> DataFrame:
        """Add the hot-key flags the rows can carry."""
        if self.customers is not None:
            rows = rows.join(F.broadcast(self.customers), "customer_id", "left").withColumn(
                "hot_customer", F.coalesce("hot_customer", F.lit(False)))
        else:
            rows = rows.withColumn("hot_customer", F.lit(False))
        return rows

    def mark_values(self, rows: DataFrame) -> DataFrame:
        if self.values is not None:
            rows = rows.join(F.broadcast(self.values), ["etype", "value"], "left").withColumn(
                "hot_value", F.coalesce("hot_value", F.lit(False)))
        else:
            rows = rows.withColumn("hot_value", F.lit(False))
        return rows


ORDERS_A_TASK = 50_000


def find_skew(orders: DataFrame, max_rows: int = 100_000, max_keys: int = 50_000,
              slice_us: int = HOUR) -> SkewPlan:
    """Look for customers and entity values with more than ``max_rows`` orders.

    One map-side combined count per key kind.  With more than ``max_rows * max_keys`` orders the limit
    grows to their ``max_keys``-th part, so there are never more than ``max_keys`` hot keys of a kind (times
    the kinds and spellings) and all of them are listed: the list is safe to broadcast at any size. A key below the
    limit is one window partition, sorted by one task, so the limit bounds a task's memory as well.
    """
    spark = orders.sparkSession
    size = orders.select("customer_id").count()
    max_rows = max(max_rows, size // max_keys)
    parts = size // ORDERS_A_TASK if size // ORDERS_A_TASK > spark.sparkContext.defaultParallelism else None

    def heavy(rows: DataFrame, keys: list[str], flag: str) -> DataFrame | None:
        top = rows.groupBy(*keys).count().filter(F.col("count") > max_rows).select(*keys)
        found = top.collect()
        return spark.createDataFrame(found, top.schema).withColumn(flag, F.lit(True)) if found else None

    customers = heavy(orders.select("customer_id"), ["customer_id"], "hot_customer")
    spellings = F.array(*[
        F.struct(F.lit(e).alias("etype"),
                 F.array_distinct(F.array(raw_entity(c), clean_entity(c))).alias("spelling"))
        for e, c in ENTITY_COLUMNS.items()
    ])
    used = (orders.select(F.inline(spellings)).select("etype", F.explode("spelling").alias("value"))
            .filter(F.col("value").isNotNull()))
    values = heavy(used, ["etype", "value"], "hot_value")
    return SkewPlan(customers, values, slice_us, parts)


def timed(orders: DataFrame) -> DataFrame:
    """Order rows with ``t``, the event time in microseconds."""
    return orders.withColumn("t", F.unix_micros(F.col("event_time").cast("timestamp")))


def unpivot_entities(orders: DataFrame, rule: str = "clean", keep: list[str] | None = None,
                     drop_missing: bool = True) -> DataFrame:
    """One row per (order, entity type, value).

    ``rule`` chooses how missing values are told: "clean" (null-like tokens, trimmed) or "raw".
    """
    keep = ["order_id", "customer_id", "t"] if keep is None else keep
    fn = clean_entity if rule == "clean" else raw_entity
    pairs = F.array(*[
        F.struct(F.lit(e).alias("etype"), fn(ENTITY_COLUMNS[e]).alias("value")) for e in ENTITIES
    ])
    rows = orders.select(*keep, F.inline(pairs))
    return rows.filter(F.col("value").isNotNull()) if drop_missing else rows


def _slice(hot: str | None, slice_us: int) -> Column:
    if hot is None:
        return F.lit(ONE_SLICE).cast("long")
    return F.when(F.col(hot), F.floor(F.col("_at") / F.lit(slice_us))).otherwise(F.lit(ONE_SLICE)).cast("long")


def sweep(rows: DataFrame, keys: list[str], measures: list[Measure], ties: str = "sequence",
          hot: str | None = None, slice_us: int = HOUR, leaves: Column | None = None,
          then_by: list[str] | None = None) -> DataFrame:
    """Add the running value of every measure, read just before each row.

    ``rows`` needs ``t`` and ``order_id`` besides the keys.  ``ties="sequence"`` lets rows with
    the same time and a smaller order id count; ``"strict"`` counts only t_j < t_i.
    ``hot`` names a boolean column of keys to slice; ``leaves`` tells which rows ever leave a
    window (by default all).  ``then_by`` orders rows of one order id: readers before contributors.
    """
    payload = [c for c in rows.columns if c not in keys]
    windows = sorted({m.window for m in measures if m.window is not None})
    marks = [F.struct(F.lit(1).alias("_ph"), F.col("t").alias("_at"), F.lit(0).cast("long").alias("_w"))] + [
        F.struct(F.lit(0).alias("_ph"), (F.col("t") + F.lit(w)).alias("_at"), F.lit(w).cast("long").alias("_w"))
        for w in windows
    ]

    def delta(m: Measure) -> Column:
        out = F.when(F.col("_ph") == 1, m.add)
        if m.window is not None:
            out = out.when(F.col("_w") == m.window, -(m.add if m.drop is None else m.drop))
        return F.coalesce(out, F.lit(0)).cast(m.dtype).alias(f"_d_{m.name}")

    here = F.col("_ph") == 1
    moves = F.array(*marks) if leaves is None else F.when(leaves, F.array(*marks)).otherwise(F.array(marks[0]))
    events = rows.select("*", F.inline(moves)) if windows else rows.select(
        "*", F.lit(1).alias("_ph"), F.col("t").alias("_at"), F.lit(0).cast("long").alias("_w"))
    slim = payload if not windows else [
        F.when(here, F.col(c)).alias(c) if c != hot else F.col(c) for c in payload]
    events = events.select(*keys, *slim, "_ph", "_at", *[delta(m) for m in measures],
                           _slice(hot, slice_us).alias("_slice"))
    part = [*keys, "_slice"] if hot is not None else list(keys)
    if ties == "sequence":
        frame = (Window.partitionBy(*part).orderBy("_at", "_ph", "order_id", *(then_by or []))
                 .rowsBetween(Window.unboundedPreceding, -1))
    else:
        # expiry sits at 2t, arrival at 2t + 1: an arrival sees everything up to 2t
        frame = (Window.partitionBy(*part).orderBy(F.col("_at") * 2 + F.col("_ph"))
                 .rangeBetween(Window.unboundedPreceding, -1))
    swept = events.select(
        *keys, *payload, "_ph", "_slice",
        *[F.coalesce(F.sum(f"_d_{m.name}").over(frame), F.lit(0)).alias(m.name) for m in measures],
    ).filter(here)
    if hot is not None:
        totals = (events.filter(F.col(hot)).groupBy(*part)
                  .agg(*[F.sum(f"_d_{m.name}").alias(f"_c_{m.name}") for m in measures]))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *part, *[F.sum(f"_c_{m.name}").over(before).alias(f"_c_{m.name}") for m in measures])
        swept = swept.join(carried, part, "left").select(
            *keys, *payload,
            *[(F.col(m.name) + F.coalesce(F.col(f"_c_{m.name}"), F.lit(0))).alias(m.name) for m in measures])
    return swept.select(*keys, *payload, *[F.col(m.name).cast(m.dtype).alias(m.name) for m in measures])


def nearest_in_time(rows: DataFrame, keys: list[str], hot: str | None = None,
                    slice_us: int = HOUR, strict: bool = False) -> DataFrame:
    """Add ``prev_t`` and ``next_t``: the times of the row before and after with the same key.

    With ``strict`` only rows of another instant count.
    """
    rows = rows.withColumn("_at", F.col("t")).withColumn("_slice", _slice(hot, slice_us))
    part = [*keys, "_slice"] if hot is not None else list(keys)
    if strict:
        w = Window.partitionBy(*part).orderBy("t")
        prev_t = F.max("t").over(w.rangeBetween(Window.unboundedPreceding, -1))
        next_t = F.min("t").over(w.rangeBetween(1, Window.unboundedFollowing))
    else:
        w = Window.partitionBy(*part).orderBy("t", "order_id")
        prev_t, next_t = F.lag("t").over(w), F.lead("t").over(w)
    out = rows.select("*", prev_t.alias("prev_t"), next_t.alias("next_t"))
    if hot is None:
        return out.drop("_at", "_slice")
    ends = rows.filter(F.col(hot)).groupBy(*part).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    ends = ends.select(*part, F.lag("_hi").over(order).alias("_before"), F.lead("_lo").over(order).alias("_after"))
    return (out.join(ends, part, "left")
            .withColumn("prev_t", F.coalesce("prev_t", "_before"))
            .withColumn("next_t", F.coalesce("next_t", "_after"))
            .drop("_at", "_slice", "_before", "_after"))


def first_use(name: str, window: int | None = None) -> Measure:
    """Distinct items as a running sum: needs ``prev_t``/``next_t`` of the item from ``nearest_in_time``."""
    if window is None:
        return Measure(name, F.col("prev_t").isNull().cast("long"))
    starts = F.col("prev_t").isNull() | (F.col("prev_t") <= F.col("t") - F.lit(window))
    ends = F.col("next_t").isNull() | (F.col("next_t") >= F.col("t") + F.lit(window))
    return Measure(name, starts.cast("long"), window, ends.cast("long"))


def count_at(events: DataFrame, probes: DataFrame, key: str, windows: dict[str, int],
             ties: str = "sequence", hot: str | None = None, slice_us: int = HOUR) -> DataFrame:
    """How many events of ``key`` lie in W(probe, w), for probe rows that are not events themselves.

    Events and probes travel in one sorted pass per key, so the cost is their sum, not a join.
    """
    extra = [c for c in probes.columns if c not in (key, "t", "order_id", hot)]
    flag = [] if hot is None else [hot]
    ev = events.select(key, "t", "order_id", *flag, F.lit(1).cast("long").alias("_n"),
                       *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    pr = probes.select(key, "t", "order_id", *flag, F.lit(0).cast("long").alias("_n"), *extra)
    measures = [Measure(name, F.col("_n"), w) for name, w in windows.items()]
    swept = sweep(ev.unionByName(pr), [key], measures, ties, hot, slice_us, leaves=F.col("_n") == 1)
    return swept.filter(F.col("_n") == 0).drop("_n")


def before(t: str, oid: str, t_i: str, oid_i: str, ties: str) -> Column:
    """(t, oid) precedes the order (t_i, oid_i)."""
    if ties == "strict":
        return F.col(t) < F.col(t_i)
    return (F.col(t) < F.col(t_i)) | ((F.col(t) == F.col(t_i)) & (F.col(oid) < F.col(oid_i)))
