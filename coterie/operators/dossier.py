"""Dossiers: what is known about the surroundings of a set of target orders, before each of them.

Bounds differ from the features: history is [T - days, T), closed below and strict above.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import clean_entity, risk_tier
from coterie.operators.asof import timed
from coterie.schema import DAY, ENTITIES, ENTITY_COLUMNS, HOUR
from coterie.sources.scratch import materialise


@dataclass
class Dossier:
    """``summary`` has one row per target; the members, values and (whole) paths are tables keyed by target."""

    summary: DataFrame
    members: DataFrame
    values: DataFrame
    paths: DataFrame


def _long(rows: DataFrame, keep: list[str], clean: bool) -> DataFrame:
    v = clean_entity if clean else (lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")))
    pairs = F.array(*[F.struct(F.lit(e).alias("etype"), v(c).alias("value")) for e, c in ENTITY_COLUMNS.items()])
    return rows.select(*keep, F.inline(pairs)).filter(F.col("value").isNotNull())


def dossiers(targets: DataFrame, orders: DataFrame, scores: DataFrame | None = None, losses: DataFrame | None = None,
             history_days: int = 30, clean: bool = True, listed: int = 25) -> Dossier:
    """``targets`` holds the order ids; all of them are worked at once by joins on value and time block.

    The summary lists the first ``listed`` paths of a target; the table of paths holds all of them.
    """
    span = history_days * DAY
    hist = timed(orders)
    tgt = hist.join(targets.select("order_id").distinct(), "order_id", "left_semi")
    tgt = tgt.select(F.col("order_id").alias("target"), F.col("customer_id").alias("me"), F.col("t").alias("at"), "amount",
                     *ENTITY_COLUMNS.values()).withColumn("block", F.floor(F.col("at") / F.lit(span)))
    now = materialise(_long(tgt, ["target", "me", "at", "block"], clean), "dossier-now")

    def blocks(rows: DataFrame) -> DataFrame:
        b = F.floor(F.col("t") / F.lit(span))
        return rows.withColumn("block", F.explode(F.array(b, b + 1)))

    in_span = (F.col("t") < F.col("at")) & (F.col("t") >= F.col("at") - F.lit(span))
    uses = materialise(blocks(_long(hist, ["customer_id", "t"], clean).distinct()), "dossier-uses")
    one = now.join(uses, ["etype", "value", "block"]).filter(in_span & (F.col("customer_id") != F.col("me"))).select(
        "target", "me", "at", "block", "etype", "value", F.col("customer_id").alias("peer")).distinct()
    one = materialise(one, "dossier-one")
    peers = one.select("target", "me", "at", "block", "peer").distinct()
    by_customer = uses.withColumnRenamed("customer_id", "peer")
    mine = now.select("target", "etype", F.col("value").alias("cur"))
    far = (peers.join(by_customer, ["peer", "block"]).filter(in_span)
           .select("target", "me", "at", "block", "peer", "etype", "value").distinct()
           .join(mine, ["target", "etype"], "left")
           .filter(F.col("cur").isNull() | (F.col("cur") != F.col("value"))).drop("cur"))
    far = materialise(far, "dossier-far")
    two = (far.join(uses.withColumnRenamed("customer_id", "other"), ["etype", "value", "block"]).filter(
        in_span & (F.col("other") != F.col("me")) & (F.col("other") != F.col("peer")))
        .select("target", "me", "peer", "etype", "value", "other").distinct())
    two = materialise(two, "dossier-two")

    members = (tgt.select("target", F.col("me").alias("customer_id"), F.lit(0).alias("hop"))
               .unionByName(peers.select("target", F.col("peer").alias("customer_id"), F.lit(1).alias("hop")))
               .unionByName(two.select("target", F.col("other").alias("customer_id"), F.lit(2).alias("hop")))
               ).groupBy("target", "customer_id").agg(F.min("hop").alias("hop"), F.max(F.col("hop") == 2).alias("via_two_hop"))
    members = materialise(members, "dossier-members")
    values = (now.select("target", "etype", "value").unionByName(far.select("target", "etype", "value"))).distinct()
    steps = (one.select("target", F.lit("1-hop").alias("path_type"), "etype", F.col("peer").cast("string").alias("via"),
                        F.col("peer").cast("string").alias("to"), "value")
             .unionByName(two.select("target", F.lit("2-hop").alias("path_type"), "etype", F.col("peer").cast("string").alias("via"),
                                     F.col("other").cast("string").alias("to"), "value")))
    order = Window.partitionBy("target").orderBy("path_type", "etype", "via", "to", "value")
    # the ranked limit keeps the first few of a target in each task, so the array below is bounded
    first = steps.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= listed)

    # activity of the whole cluster
    loss = F.col("amount")
    acts = hist.select("customer_id", "t", "order_id", F.col("amount").cast("double"))
    if losses is not None:
        acts = acts.join(losses.select("order_id", F.col("loss_amount").alias("_loss")), "order_id", "left")
        loss = F.coalesce("_loss", "amount")
    acts = blocks(acts.select("customer_id", "t", loss.alias("loss")))
    span_members = members.join(tgt.select("target", "at", "block"), "target")
    active = span_members.join(acts, ["customer_id", "block"]).filter(in_span).groupBy("target").agg(
        F.count("*").alias("orders_30d"), F.count_if(F.col("t") >= F.col("at") - F.lit(7 * DAY)).alias("orders_7d"),
        F.count_if(F.col("t") >= F.col("at") - F.lit(DAY)).alias("orders_24h"),
        F.count_if(F.col("t") >= F.col("at") - F.lit(HOUR)).alias("orders_1h"),
        F.sum("loss").alias("cluster_loss"), F.min("t").alias("first_t"))
    m = members.groupBy("target").agg(F.count("*").alias("total_customers"), F.count_if(F.col("hop") == 1).alias("one_hop"),
                                      F.count_if("via_two_hop").alias("two_hop"))
    v = values.groupBy("target").agg(F.count("*").alias("total_entities"),
                                     *[F.count_if(F.col("etype") == e).alias(f"{e}_values") for e in ENTITIES])
    kinds = one.groupBy("target").agg(*[F.max(F.col("etype") == e).alias(f"by_{e}") for e in ENTITIES])
    n_paths = steps.groupBy("target").agg(F.count("*").alias("path_count"))
    shown = first.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("position", "path_type", "etype", "value", "via", "to"))).alias("paths"))
    out = tgt.select("target", F.col("me").alias("target_customer"), "at", F.col("amount").cast("double").alias("amount"))
    if scores is not None:
        out = out.join(scores.select(F.col("order_id").alias("target"), F.col("predicted_score").alias("model_score")), "target", "left")
    else:
        out = out.withColumn("model_score", F.lit(0.0))
    if losses is not None:
        out = out.join(losses.select(F.col("order_id").alias("target"), F.col("loss_amount").alias("_own")), "target", "left")
        own = F.coalesce("_own", "amount")
    else:
        own = F.col("amount")
    for part in (m, v, kinds, n_paths, active, shown):
        out = out.join(part, "target", "left")
    out = out.withColumn("model_score", F.coalesce("model_score", F.lit(0.0))).withColumn("own_loss", own)
    out = out.fillna(0, [c for c in ("total_entities", "path_count", "orders_30d", "orders_7d", "orders_24h", "orders_1h",
                                     *[f"{e}_values" for e in ENTITIES])])
    d = lambda c: F.col(c).cast("double")
    nodes = d("total_customers") + d("total_entities")
    velocity = d("orders_24h") / F.greatest(F.lit(1.0), d("orders_7d") / F.lit(7.0))
    exposure = F.coalesce("cluster_loss", F.lit(0.0)) + F.col("own_loss")
    life = (F.col("at") - F.coalesce("first_t", "at")).cast("double") / F.lit(float(DAY))
    shared = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(f"by_{e}", F.lit(False)), f"{e}_id")
                                                     for e in ("device", "address", "ip", "payment")])), ", ")
    tier = risk_tier("model_score")
    summary = out.select(
        F.concat(F.lit("DOSSIER-"), F.col("target").cast("string")).alias("dossier_id"), F.col("target").alias("order_id"),
        "target_customer", "model_score", tier.alias("risk_tier"), "total_customers", "one_hop", "two_hop", "total_entities",
        *[f"{e}_values" for e in ENTITIES], "path_count", "paths", F.col("orders_7d").alias("peer_orders_7d"),
        F.col("orders_30d").alias("peer_orders_30d"), velocity.alias("peer_velocity_ratio_24h_vs_7d"),
        exposure.alias("total_cluster_exposure"), F.coalesce("first_t", "at").alias("first_activity_t"),
        F.col("at").alias("last_activity_t"), life.alias("cluster_lifespan_days"),
        (d("orders_24h") + d("one_hop")).alias("dossier_node_count_24h"), (d("one_hop") + 1).alias("dossier_customer_count_24h"),
        F.lit(4.0).alias("dossier_entity_count_24h"),
        F.when(nodes > 1, d("path_count") * 2 / (nodes * (nodes - 1))).otherwise(F.lit(0.0)).alias("dossier_edge_density"),
        sum((F.col(f"{e}_values") > 0).cast("double") for e in ENTITIES).alias("dossier_shared_modality_count"),
        d("one_hop").alias("dossier_conspirator_count"), d("orders_1h").alias("dossier_order_burst_1h"),
        F.format_string(
            "Order %s of customer %s scored %.4f (%s). Its cluster has %d customers and %d values: %d linked directly "
            "through %s and %d reached over a second hop. The cluster placed %d orders in 7 days, %d of them in the last "
            "24 hours (ratio %.2f). Exposure INR %s over %.1f days.",
            F.col("target").cast("string"), F.col("target_customer").cast("string"), F.col("model_score"), tier,
            F.col("total_customers"), F.col("total_entities"), F.col("one_hop"),
            F.when(shared == "", "nothing").otherwise(shared), F.col("two_hop"), F.col("orders_7d"), F.col("orders_24h"),
            velocity, F.format_number(exposure, 2), life).alias("narrative"))
    return Dossier(summary, members, values, steps)
