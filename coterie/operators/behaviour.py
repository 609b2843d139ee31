"""Families a single key reaches: baseline, temporal velocity, customer-relative.

Three intermediate tables carry them (and the one-key part of the graph families):

* customer level  - one row per order, keyed by customer
* own-entity level - one row per (order, type), keyed by (customer, type, value)
* entity level    - one row per (order, type), keyed by (type, value)

The two per-type tables meet in one pivot on order_id.
"""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import clean_entity, raw_entity
from coterie.operators.asof import (
    Measure, SkewPlan, find_skew, first_use, nearest_in_time, sweep, timed, unpivot_entities,
)
from coterie.schema import (
    BASELINE_COLUMNS, CUSTOMER_RELATIVE_COLUMNS, DAY, ENTITIES, HOUR, TEMPORAL_COLUMNS,
)

MONEY = "decimal(38,6)"
SQUARE = "decimal(38,6)"


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _at_least_one(c: Column) -> Column:
    return F.greatest(F.lit(1.0), c)


def customer_level(orders: DataFrame, history_days: int = 30, ties: str = "sequence",
                   skew: SkewPlan | None = None, counts: bool = True) -> DataFrame:
    """Window counts and sums of the customer's own orders, plus first use of a category.

    Without ``counts`` the 1 h / 24 h / 7 d / 30 d counts (and the rows that expire them) are left out.
    """
    skew = skew or SkewPlan()
    hot = "hot_customer" if skew.customers is not None else None
    horizon = history_days * DAY
    rows = timed(orders).select(
        "order_id", "customer_id", "t", _d("amount").alias("amount"),
        F.coalesce(_d("retry_count"), F.lit(0.0)).alias("retry_count"), "merchant_category")
    rows = skew.mark(rows)
    if hot is None:
        rows = skew.deal(rows, "customer_id")
    # money is summed as an exact decimal: what was added is given back to the last digit (amounts below 1e16)
    cents = F.col("amount").cast("decimal(22,6)")
    rows = nearest_in_time(rows, ["customer_id"], hot, skew.slice_us, strict=ties == "strict")
    rows = rows.withColumnRenamed("prev_t", "last_t").drop("next_t")
    rows = nearest_in_time(rows, ["customer_id", "merchant_category"], hot, skew.slice_us)
    spans = {"n_1h": HOUR, "n_24h": DAY, "n_7d": 7 * DAY, "n_30d": 30 * DAY} if counts else {}
    measures = [
        *[Measure(name, F.lit(1), w) for name, w in spans.items()], Measure("n_hist", F.lit(1), horizon),
        Measure("spend", cents, horizon, dtype=MONEY),
        Measure("spend_sq", (cents * cents).cast(SQUARE), horizon, dtype=SQUARE),
        first_use("categories"),
    ]
    out = sweep(rows, ["customer_id"], measures, ties, hot, skew.slice_us)
    n = _d("n_hist")
    mean = F.when(n > 0, _d("spend") / n).otherwise(F.lit(0.0))
    # n * sum(x^2) - sum(x)^2 in decimals (exact for amounts of up to three places); doubles if they overflow
    exact = F.try_subtract(F.try_multiply(F.col("n_hist"), F.col("spend_sq")),
                           F.try_multiply(F.col("spend"), F.col("spend")))
    spread = F.coalesce(_d(exact), n * _d("spend_sq") - _d("spend") * _d("spend"))
    std = F.when(F.col("n_hist") > 1, F.sqrt(F.greatest(spread, F.lit(0.0))) / n).otherwise(F.lit(0.0))
    seen = F.col("last_t").isNotNull() & (F.col("last_t") > F.col("t") - F.lit(horizon))
    return out.select(
        "order_id", "customer_id", "t", "amount", "retry_count",
        *[_d(c).alias(c) for c in (*spans, "n_hist", "categories")],
        _d("spend").alias("spend"), mean.alias("mean"), std.alias("std"),
        F.when(seen, _d(F.col("t") - F.col("last_t")) / F.lit(3.6e9)).otherwise(F.lit(9999.0)).alias("idle_hours"),
    )


def own_entity_level(orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None,
                     firsts: bool = True, uses: bool = True) -> DataFrame:
    """Per (order, type): the customer's own use of the value (``raw`` rule counts, ``clean`` rule firsts)."""
    skew = skew or SkewPlan()
    hot = "hot_customer" if skew.customers is not None else None
    flag = [] if hot is None else [hot]
    rows = skew.mark(timed(orders).select("order_id", "customer_id", "t", "device_id", "ip_id", "address_id",
                                          "payment_id"))
    if hot is None:
        # every window below refines customer_id, so this is the only shuffle: of orders, not of their values
        rows = skew.deal(rows, "customer_id")
    pairs = F.array(*[F.struct(F.lit(e).alias("etype"), raw_entity(f"{e}_id").alias("raw"),
                               clean_entity(f"{e}_id").alias("value")) for e in ENTITIES])
    rows = rows.select("order_id", "customer_id", "t", *flag, F.inline(pairs))
    if firsts:
        rows = nearest_in_time(rows, ["customer_id", "etype", "value"], hot, skew.slice_us, strict=ties == "strict")
        rows = rows.withColumn("is_new", (F.col("value").isNotNull() & F.col("prev_t").isNull()).cast("long"))
        if ties == "strict":
            # several rows of one instant are all new, but the value is counted once
            one = Window.partitionBy("customer_id", "etype", "value", "t").orderBy("order_id")
            rows = rows.withColumn("first", (F.row_number().over(one) == 1).cast("long") * F.col("is_new"))
        else:
            rows = rows.withColumn("first", F.col("is_new"))
        rows = rows.drop("prev_t", "next_t")
        rows = sweep(rows, ["customer_id", "etype"], [Measure("used", F.col("first"))], ties, hot, skew.slice_us)
    if uses:
        spans = {"own_1h": HOUR, "own_24h": DAY, "own_7d": 7 * DAY}
        rows = sweep(rows, ["customer_id", "etype", "raw"], [Measure(n, F.lit(1), w) for n, w in spans.items()], ties, hot, skew.slice_us)
    present = F.col("raw").isNotNull()
    return rows.select(
        "order_id", "etype", *([_d(c).alias(c) for c in ("used", "is_new")] if firsts else []),
        *([F.when(present, _d(c)).otherwise(F.lit(0.0)).alias(c) for c in ("own_1h", "own_24h", "own_7d")] if uses else []))


BURSTS = ("orders_1h", "orders_24h", "people_1h", "people_24h")


def _with_gains(rows: DataFrame, gains: DataFrame | None) -> DataFrame:
    """Entity rows and, told by ``_gain``, those that add ``_in`` to what a value reaches (``neighbourhood.Lifetime``)."""
    if gains is None:
        return rows.withColumn("_in", F.lit(0)).withColumn("_gain", F.lit(False))
    more = gains.select("etype", "value", F.col("at.from_t").alias("t"), F.col("at.from_id").alias("order_id"), "_in", F.lit(True).alias("_gain"))
    return rows.withColumn("_in", F.lit(0)).withColumn("_gain", F.lit(False)).unionByName(more, allowMissingColumns=True)


def _of_orders(m: Measure) -> Measure:
    """The measure over orders alone."""
    def zero(c: Column | None) -> Column | None:
        return None if c is None else F.when(~F.col("_gain"), c).otherwise(F.lit(0))

    return replace(m, add=zero(m.add), drop=zero(m.drop))


def _dealt(rows: DataFrame, skew: SkewPlan) -> tuple[DataFrame, str | None]:
    """Entity rows at their value, or marked where values are hot, and the name of the mark."""
    return (skew.deal(rows, "etype", "value"), None) if skew.values is None else (skew.mark_values(rows), "hot_value")


def _bursts(rows: DataFrame, keys: list[str], ties: str, hot: str | None, skew: SkewPlan) -> DataFrame:
    """Add ``BURSTS``: orders and distinct customers on the value in the last hour and day."""
    rows = nearest_in_time(rows, [*keys, "customer_id", "_gain"], hot, skew.slice_us)
    measures = [
        Measure("orders_1h", F.lit(1), HOUR), Measure("orders_24h", F.lit(1), DAY),
        first_use("people_1h", HOUR), first_use("people_24h", DAY),
    ]
    return sweep(rows, keys, [_of_orders(m) for m in measures], ties, hot, skew.slice_us, leaves=~F.col("_gain")).drop("prev_t", "next_t")


def _sharing(rows: DataFrame, keys: list[str], ties: str, hot: str | None, skew: SkewPlan, peers: bool = True) -> DataFrame:
    """Add ``people_ever``, ``far`` and, with ``peers``, ``peers_7d``; rows that are gains go."""
    mine = [*keys, "customer_id", "_gain"]
    if ties == "strict":
        rows = nearest_in_time(rows, mine, hot, skew.slice_us, strict=True)
        rows = rows.withColumnRenamed("prev_t", "mine_t").drop("next_t")
        rows = nearest_in_time(rows, mine, hot, skew.slice_us)
    else:
        rows = nearest_in_time(rows, mine, hot, skew.slice_us)
        rows = rows.withColumn("mine_t", F.col("prev_t"))
    rows = rows.withColumn("mine", F.coalesce(F.col("mine_t") > F.col("t") - F.lit(7 * DAY), F.lit(False)).cast("long"))
    measures = [first_use("people_ever"), *([first_use("people_7d", 7 * DAY)] if peers else [])]
    out = sweep(rows, keys, [*map(_of_orders, measures), Measure("far", F.col("_in"))], ties, hot, skew.slice_us,
                leaves=~F.col("_gain"), then_by=["_gain"]).filter(~F.col("_gain"))
    return out.withColumn("peers_7d", F.col("people_7d") - F.col("mine")) if peers else out


def entity_level(orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None) -> DataFrame:
    """Per (order, type): orders and distinct customers on the value in the last hour and day."""
    skew = skew or find_skew(orders)
    rows, hot = _dealt(_with_gains(unpivot_entities(timed(orders), rule="raw"), None), skew)
    return _bursts(rows, ["etype", "value"], ties, hot, skew).select("order_id", "etype", *[_d(c).alias(c) for c in BURSTS])


def _shared(peers: bool, gains: DataFrame | None) -> list[str]:
    return ["people_ever", *(["peers_7d"] if peers else []), *(["far"] if gains is not None else [])]


def shared_level(orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None, peers: bool = True,
                 gains: DataFrame | None = None) -> DataFrame:
    """Per (order, type), clean rule: distinct customers on the value, ever (self included) and others in 7 d; with ``gains`` what
    the value reaches (``far``)."""
    skew = skew or find_skew(orders)
    rows, hot = _dealt(_with_gains(unpivot_entities(timed(orders), rule="clean"), gains), skew)
    out = _sharing(rows, ["etype", "value"], ties, hot, skew, peers)
    return out.select("order_id", "etype", *[_d(c).alias(c) for c in _shared(peers, gains)])


def value_level(orders: DataFrame, ties: str, skew: SkewPlan, peers: bool = True, gains: DataFrame | None = None) -> DataFrame:
    """``entity_level`` and ``shared_level`` in one table, over one shuffle.

    Rows lie at the clean value, which is the same for all spellings of it; a raw one is told by it and ``other``, the spelling where
    it differs. A value that only the clean rule takes as missing stands for itself and is not shared."""
    pairs = F.array(*[F.struct(F.lit(e).alias("etype"), raw_entity(f"{e}_id").alias("raw"), clean_entity(f"{e}_id").alias("clean")) for e in ENTITIES])
    rows = timed(orders).select("order_id", "customer_id", "t", F.inline(pairs)).filter("raw is not null")
    value = F.coalesce("clean", "raw")
    rows = rows.select("order_id", "customer_id", "t", "etype", value.alias("value"), F.when(F.col("raw") != value, F.col("raw")).otherwise("").alias("other"),
                       F.col("clean").isNull().alias("missing"))
    # keys of gains are told as those of a clean value: joins of hot slices take no nulls
    rows = _with_gains(rows, gains).withColumn("missing", F.coalesce("missing", F.lit(False))).withColumn("other", F.coalesce("other", F.lit("")))
    rows, hot = _dealt(rows, skew)
    rows = _bursts(rows, ["etype", "value", "other"], ties, hot, skew)
    rows = _sharing(rows, ["etype", "value", "missing"], ties, hot, skew, peers)
    return rows.select("order_id", "etype", *[_d(c).alias(c) for c in BURSTS], *[F.when(~F.col("missing"), _d(c)).alias(c) for c in _shared(peers, gains)])


def pivot_levels(*levels: DataFrame) -> DataFrame:
    """All per-type columns of an order on one row, named ``{type}__{column}``; missing types read 0. What is reached is
    summed where an order id comes again."""
    cols = [c for lv in levels for c in lv.columns if c not in ("order_id", "etype")]
    stacked = None
    for lv in levels:
        have = set(lv.columns)
        part = lv.select("order_id", "etype", *[F.col(c) if c in have else F.lit(None).cast("double").alias(c)
                                                for c in cols])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("order_id").agg(*[
        F.coalesce((F.sum if c == "far" else F.max)(F.when(F.col("etype") == e, F.col(c))), F.lit(0.0)).alias(f"{e}__{c}")
        for e in ENTITIES for c in cols
    ])


def with_levels(base: DataFrame, pivot: DataFrame) -> DataFrame:
    """Left join of the pivot; an order without any entity value reads zeros."""
    joined = base.join(pivot, "order_id", "left")
    return joined.fillna(0.0, subset=[c for c in pivot.columns if c != "order_id"])


def baseline_columns(history_days: int, epoch: str = "2025-01-01") -> list[Column]:
    age = (F.col("t") - F.unix_micros(F.lit(epoch).cast("timestamp"))) / F.lit(float(DAY))
    usual = F.when(F.col("n_hist") > 0, F.col("mean")).otherwise(F.col("amount"))
    named = {
        "prior_order_count": F.col("n_hist"), "prior_spend": F.col("spend"), "prior_avg_amount": F.col("mean"),
        "prior_amount_std": F.col("std"), "velocity_per_day": F.col("n_hist") / F.lit(float(max(history_days, 1))),
        "hours_since_prior": F.col("idle_hours"), "amount": F.col("amount"),
        "amount_vs_prior_avg": F.col("amount") / F.greatest(usual, F.lit(1.0)),
        "account_age_days": F.greatest(F.lit(0.0), age), "prior_category_count": F.col("categories"),
        "retry_count": F.col("retry_count"),
    }
    for e in ENTITIES:
        named[f"prior_{e}count"] = F.col(f"{e}__used")
        named[f"{e}_is_new"] = F.col(f"{e}__is_new")
    return [named[c].alias(c) for c in BASELINE_COLUMNS]


def temporal_columns() -> list[Column]:
    named: dict[str, Column] = {}
    burst = {e: F.col(f"{e}__orders_1h") / _at_least_one(F.col(f"{e}__orders_24h") / F.lit(24.0)) for e in ENTITIES}
    for e in ENTITIES:
        named[f"{e}_distinct_customers_1h"] = F.col(f"{e}__people_1h")
        named[f"{e}_distinct_customers_24h"] = F.col(f"{e}__people_24h")
        named[f"{e}_order_count_1h"] = F.col(f"{e}__orders_1h")
        named[f"{e}_order_count_24h"] = F.col(f"{e}__orders_24h")
        named[f"{e}_new_customers_1h"] = F.col(f"{e}__people_1h")
        named[f"{e}_burst_ratio_1h_24h"] = burst[e]

    def top(c: str) -> Column:
        return F.greatest(*[F.col(f"{e}__{c}") for e in ENTITIES])

    named["max_entity_distinct_customers_1h"] = top("people_1h")
    named["max_entity_distinct_customers_24h"] = top("people_24h")
    named["max_entity_order_count_1h"] = top("orders_1h")
    named["max_entity_order_count_24h"] = top("orders_24h")
    named["max_entity_burst_ratio"] = F.greatest(*burst.values())
    named["total_entity_burst_events_1h"] = sum(
        (F.col(f"{e}__people_1h") >= 2).cast("double") for e in ENTITIES)
    return [named[c].alias(c) for c in TEMPORAL_COLUMNS]


def customer_relative_columns() -> list[Column]:
    n1, n24, n7, n30 = (F.col(c) for c in ("n_1h", "n_24h", "n_7d", "n_30d"))
    named = {
        "customer_order_count_1h": n1, "customer_order_count_24h": n24, "customer_order_count_7d": n7,
        "customer_order_count_30d": n30,
        "customer_orders_1h_vs_24h_rate": n1 / _at_least_one(n24 / F.lit(24.0)),
        "customer_orders_24h_vs_7d_rate": n24 / _at_least_one(n7 / F.lit(7.0)),
        "customer_activity_burst_score": n24 / F.greatest(F.lit(0.1), n30 / F.lit(30.0)),
    }
    pace = {e: F.col(f"{e}__own_24h") / _at_least_one(F.col(f"{e}__own_7d") / F.lit(7.0)) for e in ENTITIES}
    for e in ENTITIES:
        for w in ("1h", "24h", "7d"):
            named[f"customer_{e}_orders_{w}"] = F.col(f"{e}__own_{w}")
        named[f"customer_{e}_velocity_ratio"] = pace[e]
        named[f"customer_{e}_share_of_activity_24h"] = F.col(f"{e}__own_24h") / _at_least_one(n24)
    named["max_customer_entity_orders_1h"] = F.greatest(*[F.col(f"{e}__own_1h") for e in ENTITIES])
    named["max_customer_entity_orders_24h"] = F.greatest(*[F.col(f"{e}__own_24h") for e in ENTITIES])
    named["max_customer_entity_velocity_ratio"] = F.greatest(*pace.values())
    return [named[c].alias(c) for c in CUSTOMER_RELATIVE_COLUMNS]


def baseline_features(orders: DataFrame, history_days: int = 30, ties: str = "sequence",
                      epoch: str = "2025-01-01", skew: SkewPlan | None = None) -> DataFrame:
    skew = skew or find_skew(orders)
    base = customer_level(orders, history_days, ties, skew, counts=False)
    own = own_entity_level(orders, ties, skew, uses=False)
    return with_levels(base, pivot_levels(own)).select("order_id", *baseline_columns(history_days, epoch))


def temporal_velocity_features(orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None) -> DataFrame:
    pivot = pivot_levels(entity_level(orders, ties, skew or find_skew(orders)))
    return with_levels(orders.select("order_id"), pivot).select("order_id", *temporal_columns())


def customer_relative_features(orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None) -> DataFrame:
    skew = skew or find_skew(orders)
    base = customer_level(orders, 30, ties, skew)
    own = own_entity_level(orders, ties, skew, firsts=False)
    return with_levels(base, pivot_levels(own)).select("order_id", *customer_relative_columns())
