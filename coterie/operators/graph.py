"""Bipartite customer-entity graph: snapshot, components, communities, consolidation of alerts."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import beside, clean_entity
from coterie.operators.asof import timed
from coterie.operators.components import union_groups
from coterie.schema import ENTITIES, ENTITY_COLUMNS
from coterie.sources.scratch import materialise


def _node(kind: str, c) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), c.cast("string"))


def graph_snapshot(orders: DataFrame, as_of, clean: bool = True) -> DataFrame:
    """(customer, etype, entity, event_time, amount): typed edges strictly before ``as_of``.

    A repeated edge keeps the attributes of its last order.  ``clean=False`` keeps null-like values
    as nodes.
    """
    rows = timed(orders).filter(F.col("event_time").cast("timestamp") < F.lit(as_of).cast("timestamp"))
    value = (lambda e: clean_entity(ENTITY_COLUMNS[e])) if clean else (
        lambda e: F.coalesce(F.col(ENTITY_COLUMNS[e]).cast("string"), F.lit("None")))
    pairs = F.array(*[F.struct(F.lit(ENTITY_COLUMNS[e]).alias("etype"), value(e).alias("v")) for e in ENTITIES])
    long = rows.select(_node("customer", F.col("customer_id")).alias("customer"), "t", "order_id", "event_time", "amount",
                       F.inline(pairs)).filter(F.col("v").isNotNull())
    return long.groupBy("customer", "etype", F.concat_ws(":", "etype", "v").alias("entity")).agg(
        F.max(F.struct("t", "order_id", "event_time", "amount")).alias("last")).select(
        "customer", "etype", "entity", F.col("last.event_time").alias("event_time"), F.col("last.amount").alias("amount"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for an edge table (src, dst); the component is named by its smallest node."""
    pairs = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return nodes.join(union_groups(pairs), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) of a bipartite graph (src, dst): label propagation, ties to the smallest label.

    The sides take turns: all nodes of one side at once take the label most of their neighbours
    have.  A turn never lowers the number of edges inside communities, and where it keeps the number labels
    only get smaller, so the propagation settles; it runs until both sides have kept their labels.
    """
    e = materialise(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
                    .filter("src != dst").distinct(), "edges")
    if not e.select("src").join(e.select(F.col("dst").alias("src")), "src", "left_semi").isEmpty():
        raise ValueError("a node is on both sides")
    near = {True: e.select(F.col("src").alias("node"), F.col("dst").alias("other")), False: e.select(F.col("dst").alias("node"), F.col("src").alias("other"))}
    labels = {k: materialise(near[k].select("node").distinct().withColumn("label", F.col("node")), "labels") for k in near}
    kept, side = 0, True
    while kept < 2:
        votes = (near[side].join(labels[not side].withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.count("*").alias("n")))
        new = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("node", F.col("best.label").alias("label"))
        new = materialise(new.join(labels[side].withColumnRenamed("label", "old"), "node").select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        kept = kept + 1 if new.filter("moved").isEmpty() else 0
        labels[side] = new.select("node", "label")
        side = not side
    return labels[True].unionByName(labels[False]).withColumnRenamed("label", "community")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman modularity of a labelling of an undirected simple graph, one row."""
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    lab = labels.select("node", F.col("community").alias("c"))
    tagged = (e.join(lab.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src")
              .join(lab.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst"))
    inside = tagged.agg(F.count("*").alias("m"), F.count_if(F.col("cs") == F.col("cd")).alias("within"))
    ends = tagged.select(F.explode(F.array("cs", "cd")).alias("c")).groupBy("c").agg(F.count("*").alias("degree"))
    sq = ends.agg(F.sum(F.col("degree").cast("double") * F.col("degree").cast("double")).alias("d2"))
    m = F.col("m").cast("double")
    return beside(inside, sq).select((F.col("within") / m - F.col("d2") / (F.lit(4.0) * m * m)).alias("modularity"))


def graph_summary(snapshot: DataFrame, community: DataFrame | None = None) -> DataFrame:
    """(node, kind, degree, component, component_size[, community])."""
    edges = snapshot.select(F.col("customer").alias("src"), F.col("entity").alias("dst"))
    degree = (snapshot.select(F.inline(F.array(
        F.struct(F.col("customer").alias("node"), F.lit("customer").alias("kind")),
        F.struct(F.col("entity").alias("node"), F.col("etype").alias("kind")))))
        .groupBy("node", "kind").agg(F.count("*").alias("degree")))
    comp = materialise(connected_components(edges), "components")
    size = comp.groupBy("component").agg(F.count("*").alias("component_size"))
    out = degree.join(comp, "node").join(size, "component").select("node", "kind", "degree", "component", "component_size")
    return out if community is None else out.join(community, "node", "left").withColumn(
        "community", F.coalesce("community", F.lit("")))


def alert_links(flagged: DataFrame, typed: bool = True, blanks: bool = False, per: str | None = None) -> DataFrame:
    """(src, dst): order node - value node, for the customer and the four entities of each alert.

    ``typed=False`` lets equal strings of different types link; ``blanks=True`` lets missing values link.
    """
    scope = F.concat(F.col(per).cast("string"), F.lit("|")) if per else F.lit("")
    vals = []
    for kind, c in [("customer", "customer_id"), *ENTITY_COLUMNS.items()]:
        s = F.col(c).cast("string")
        v = F.coalesce(s, F.lit("nan")) if blanks else (s if kind == "customer" else clean_entity(c))
        vals.append(F.when(v.isNotNull(), F.concat(F.lit(f"{kind}:" if typed else ""), v)))
    order = F.concat(F.lit("o#"), scope, F.col("order_id").cast("string"))
    return flagged.select(order.alias("src"), F.explode(F.array_compact(F.array(*vals))).alias("v"),
                          scope.alias("scope")).select("src", F.concat(F.lit("v#"), F.col("scope"), F.col("v")).alias("dst"))


def consolidate_alerts(flagged: DataFrame, typed: bool = True, blanks: bool = False, per: str | None = None) -> DataFrame:
    """(order_id[, per], case_id): single linkage over the customer and the four entities.

    The linking values are nodes of their own, so an alert adds five edges however many alerts share
    a value.
    """
    comp = connected_components(alert_links(flagged, typed, blanks, per))
    scope = F.concat(F.col(per).cast("string"), F.lit("|")) if per else F.lit("")
    keyed = flagged.select("order_id", *([per] if per else []),
                           F.concat(F.lit("o#"), scope, F.col("order_id").cast("string")).alias("node"))
    return keyed.join(comp, "node").select("order_id", *([per] if per else []), F.col("component").alias("case_id"))


def consolidation_stats(cases: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: alerts, cases, alerts per case, exposure kept."""
    j = cases.join(flagged.select("order_id", "loss_amount"), "order_id")
    per = j.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("loss_amount").alias("exposure"))
    return per.agg(F.sum("n").alias("alerts"), F.count("*").alias("cases"), F.avg("n").alias("alerts_per_case"),
                   F.max("n").alias("largest_case"), F.sum("exposure").alias("exposure"))
