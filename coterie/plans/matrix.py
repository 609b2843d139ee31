"""The feature matrix: families built once over shared intermediate tables, then joined by order."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import guarded_ratio
from coterie.operators import behaviour, neighbourhood
from coterie.operators.asof import SkewPlan, find_skew
from coterie.schema import ENTITIES, FEATURE_CONTRACT, FEATURE_FAMILIES

# The ladder of feature sets, by the families each one holds.
FEATURE_SETS = {
    "baseline": ("baseline",),
    "combined": ("baseline", "graph"),
    "full": ("baseline", "graph", "temporal"),
    "extended": ("baseline", "graph", "temporal", "customer_relative"),
    "two_hop_extended": ("baseline", "graph", "temporal", "customer_relative", "two_hop"),
    "subgraph_extended": ("baseline", "graph", "temporal", "customer_relative", "two_hop", "subgraph"),
}


def columns_of(name: str) -> list[str]:
    return [c for family in FEATURE_SETS[name] for c in FEATURE_FAMILIES[family]]


def feature_matrix(orders: DataFrame, name: str = "subgraph_extended", labels: DataFrame | None = None,
                   history_days: int = 30, ties: str = "sequence", epoch: str = "2025-01-01",
                   skew: SkewPlan | None = None, targets: DataFrame | None = None, crowd: int = 256, heavy: int = 1_000) -> DataFrame:
    """(order_id, features in contract order[, y]) for one of ``FEATURE_SETS``.

    All families share one customer table and one pivot of the per-type tables, so adding
    a family adds columns, not another pass over the orders.  ``targets`` limits the output (and the
    neighbourhood joins) to some order ids; history stays all orders.  Hot keys are looked for unless
    ``skew`` says what they are (``SkewPlan()``: none).
    """
    families = FEATURE_SETS[name]
    skew = skew or find_skew(orders)
    counts = "customer_relative" in families
    base = behaviour.customer_level(orders, history_days, ties, skew, counts)
    levels = [behaviour.own_entity_level(orders, ties, skew, uses=counts)]
    graph, hops = "graph" in families, "two_hop" in families
    life = neighbourhood.lifetime(orders, heavy) if graph else None
    gains = life and life.gains
    if "temporal" in families and (graph or hops):
        levels.append(behaviour.value_level(orders, ties, skew, hops, gains))
    elif "temporal" in families:
        levels.append(behaviour.entity_level(orders, ties, skew))
    elif graph or hops:
        levels.append(behaviour.shared_level(orders, ties, skew, hops, gains))
    if graph:
        # an order id that comes n times has n rows of either family, and n * n here
        again = F.collect_list("n_hist").over(Window.partitionBy("order_id"))
        base = base.filter("order_id is not null").withColumn("_hists", again).withColumn("graph_hist", F.explode("_hists")).drop("_hists")
    wide = behaviour.with_levels(base, behaviour.pivot_levels(*levels))
    cols = list(behaviour.baseline_columns(history_days, epoch))
    if "temporal" in families:
        cols += behaviour.temporal_columns()
    if "customer_relative" in families:
        cols += behaviour.customer_relative_columns()
    if hops:
        cols += [x.alias(c) for c, x in neighbourhood.shared_columns().items()]
    if graph:
        cols += ["graph_hist", *[f"{e}__{c}" for e in ENTITIES for c in ("people_ever", "far")]]
    out = neighbourhood.focus_rows(wide.select("order_id", *cols), targets)
    if graph:
        out = neighbourhood.with_graph(out, orders, life, ties, skew, targets, crowd)
        out = out.select(*[c for c in out.columns if c in FEATURE_CONTRACT or c == "order_id"], *neighbourhood.graph_columns(history_days, "graph_hist"))
    if hops:
        windows = (neighbourhood.W7, neighbourhood.W24) if "subgraph" in families else (neighbourhood.W7,)
        hood = neighbourhood.Neighbourhood.build(orders, ties, skew, windows, targets)
        out = out.join(neighbourhood.two_hop_features(orders, ties, skew, hood, shared=False), "order_id")
        if "subgraph" in families:
            out = out.join(neighbourhood.subgraph_features(orders, ties, skew, hood), "order_id")
    out = out.select("order_id", *columns_of(name))
    return out if labels is None else attach_labels(out, labels)


def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``y`` by order id; an order without a label gets null."""
    return features.join(labels.select("order_id", F.col("is_abuse").cast("int").alias("y")), "order_id", "left")


def feature_manifest(name: str, spark) -> DataFrame:
    """(feature, source, as_of_rule, target_independent) of a feature set."""
    rows = [(c, family, "strictly earlier events only", True)
            for family in FEATURE_SETS[name] for c in FEATURE_FAMILIES[family]]
    return spark.createDataFrame(rows, "feature string, source string, as_of_rule string, target_independent boolean")


def matrix_profile(matrix: DataFrame, name: str) -> DataFrame:
    """The manifest of a set over its built matrix: each feature with its share of nulls, least and greatest value.

    All columns are summed in one pass; the result has one row per feature."""
    names = columns_of(name)
    stats = matrix.agg(F.count("*").alias("_n"), *[x for c in names for x in (
        F.count(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))])
    per = stats.select("_n", F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("greatest")) for c in names])).alias("x"))
    out = per.select("x.feature", guarded_ratio(F.col("_n") - F.col("x.n"), F.col("_n")).alias("null_share"), "x.least", "x.greatest")
    return feature_manifest(name, matrix.sparkSession).join(F.broadcast(out), "feature")


def project_contract(df: DataFrame, names: list[str] | None = None, missing: str = "error") -> DataFrame:
    """Exactly the contract columns, in order; missing ones raise or read 0."""
    names = names or FEATURE_CONTRACT
    absent = [c for c in names if c not in df.columns]
    if absent and missing == "error":
        raise ValueError(f"missing feature columns: {absent}")
    return df.select("order_id", *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in names])
