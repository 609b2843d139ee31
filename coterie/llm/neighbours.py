"""Exact top-k search over order features by two cover trees that are walked together.

Orders are dealt to cells around pivots; each cell is cut into blocks of bounded size. A block of queries and a block of
orders each get a cover tree inside the task that compares them. A pair of nodes is skipped when no inner product across
their covering radii can reach the worst k-th score of the query node's queries. What a query's own cell yields first
gives every query block a threshold that skips whole blocks before any task reads them.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.sources.scratch import materialise


@dataclass
class CoverTree:
    """Nodes in preorder: centre (a row), radius over all its points, children, and the points of a leaf."""

    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    children: list[list[int]]
    rows: list[np.ndarray]


def cover_tree(points: np.ndarray, base: float = 1.6, leaf: int = 32) -> CoverTree:
    """A cover tree of ``points``: the children of a node of radius r are centres more than r / ``base`` apart that cover its
    points within r / ``base``. Nodes of up to ``leaf`` points, or of equal points only, are leaves."""
    centres: list[int] = []
    radii: list[float] = []
    children: list[list[int]] = []
    rows: list[np.ndarray] = []

    def add(centre: int, own: np.ndarray, distance: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        centres.append(centre)
        radii.append(float(distance.max()) if len(distance) else 0.0)
        children.append([])
        rows.append(np.zeros(0, np.int64))
        return len(centres) - 1, own, distance

    everything = np.arange(len(points))
    todo = [add(0, everything, np.sqrt(((points - points[0]) ** 2).sum(1)))] if len(points) else []
    while todo:
        node, own, distance = todo.pop()
        if len(own) <= leaf or radii[node] == 0:
            rows[node] = own
            continue
        reach = radii[node] / base
        # farthest-first centres until all points are within reach; each point belongs to its nearest one
        nearest, owner, chosen = distance.copy(), np.zeros(len(own), np.int64), [centres[node]]
        while nearest.max() > reach and len(chosen) < 64:
            far = int(nearest.argmax())
            d = np.sqrt(((points[own] - points[own[far]]) ** 2).sum(1))
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(chosen)
            chosen.append(int(own[far]))
        for c, row in enumerate(chosen):
            part = owner == c
            if part.any():
                child = add(row, own[part], nearest[part])
                children[node].append(child[0])
                todo.append(child)
    radius = np.array(radii) * (1 + 1e-9) + 1e-9
    centre = np.array(centres, np.int64)
    norm = np.sqrt((points[centre] ** 2).sum(1)) if len(centre) else np.zeros(0)
    return CoverTree(points, centre, radius, norm, children, rows)


def dual_search(queries: CoverTree, q_ids: np.ndarray, orders: CoverTree, o_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (query x k) of the best orders of each query, ties to the smaller id.

    ``floor`` is what a query's k-th score is known to reach; only scores at least as high are of use, and only those are
    promised. A query never meets an order with its own id."""
    n = len(queries.points)
    best = np.full((n, k), -np.inf)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    worst = floor.astype(float).copy()
    if not n or not len(orders.points):
        return best, ids
    across = queries.points[queries.centre] @ orders.points[orders.centre].T
    # q.x <= c.p + |c| R_p + R_c |p| + R_c R_p for q within R_c of c and x within R_p of p
    bound = across + queries.norm[:, None] * orders.radius[None] + queries.radius[:, None] * (orders.norm + orders.radius)[None]
    bound += np.abs(bound) * 1e-12
    members = _below(queries)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        if bound[a, b] < worst[members[a]].min():
            continue
        if not queries.children[a] and not orders.children[b]:
            own, theirs = queries.rows[a], orders.rows[b]
            _offer(own, queries.points[own] @ orders.points[theirs].T, q_ids, o_ids[theirs], best, ids, worst, k)
        elif not queries.children[a] or (orders.children[b] and orders.radius[b] >= queries.radius[a]):
            kids = orders.children[b]
            todo += [(a, kids[i]) for i in np.argsort(bound[a, kids])]  # the most promising comes off first
        else:
            kids = queries.children[a]
            todo += [(kids[i], b) for i in np.argsort(bound[kids, b])]
    return best, ids


def _below(tree: CoverTree) -> list[np.ndarray]:
    """All points under each node; children come after their parent."""
    out = list(tree.rows)
    for node in range(len(out) - 1, -1, -1):
        if tree.children[node]:
            out[node] = np.concatenate([out[c] for c in tree.children[node]])
    return out


def _offer(own: np.ndarray, scores: np.ndarray, q_ids: np.ndarray, o_ids: np.ndarray, best: np.ndarray, ids: np.ndarray, worst: np.ndarray, k: int) -> None:
    """Merge a block of scores into the best lists of the queries ``own``."""
    scores = np.where(q_ids[own][:, None] == o_ids[None], -np.inf, scores)
    for i in np.flatnonzero(scores.max(1) >= worst[own]):
        q, use = own[i], np.flatnonzero(scores[i] >= worst[own[i]])
        s, x = np.concatenate([best[q], scores[i, use]]), np.concatenate([ids[q], o_ids[use]])
        order = np.lexsort((x, -s))[:k]
        best[q], ids[q] = s[order], x[order]
        worst[q] = max(worst[q], best[q, -1])


def _blocks(frame: DataFrame, pivots: np.ndarray, size: int, rows: int) -> DataFrame:
    """``frame(order_id, x)`` with a ``block``: its nearest pivot, and a hash where the cell holds more than ``size`` rows."""
    half = (pivots ** 2).sum(1) / 2

    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.asarray(batch.flatten(), float).reshape(len(batch), -1)
            yield pa.array((x @ pivots.T - half).argmax(1), pa.int64()) if len(x) else pa.array([], pa.int64())

    nearest.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    celled = frame.withColumn("cell", F.arrow_udf(nearest, "long")("x"))
    spread = max(1, -(-rows // size))
    fine = celled.withColumn("shard", F.pmod(F.xxhash64("order_id"), F.lit(spread)))
    # shards of a cell are joined again up to the block size, from counts only
    counts = fine.groupBy("cell", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cell").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    named = counts.withColumn("part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size))
    named = materialise(named.select("cell", "shard", F.xxhash64("cell", "part").alias("block")), "cells")
    return fine.join(named, ["cell", "shard"]).select("cell", "block", "order_id", "x")


def _summary(blocks: DataFrame) -> DataFrame:
    """``cell, block, centre, radius, norm``: a ball around the rows of each block, which is of bounded size."""
    def ball(key: tuple, table: pa.Table) -> pa.Table:
        x = np.asarray(table["x"].combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        centre = x.mean(0)
        return pa.table({"cell": [key[0].as_py()], "block": [key[1].as_py()], "centre": [centre.tolist()],
                         "radius": [float(np.sqrt(((x - centre) ** 2).sum(1)).max()) * (1 + 1e-9)], "norm": [float(np.sqrt((centre ** 2).sum()))]})

    return blocks.groupBy("cell", "block").applyInArrow(ball, "cell long, block long, centre array<double>, radius double, norm double")


def _reach(balls: DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that hold rows, and for each the radius around its pivot that covers its blocks: one number a pivot."""
    at = F.element_at(F.array(*[F.array(*map(F.lit, p.tolist())) for p in pivots]), (F.col("cell") + 1).cast("int"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    rows = balls.groupBy("cell").agg(F.max(away + F.col("radius")).alias("r")).orderBy("cell").collect()
    return np.array([r["cell"] for r in rows], np.int64), np.array([r["r"] for r in rows]) * (1 + 1e-9) + 1e-9


def _cells_of(q_balls: DataFrame, pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray) -> DataFrame:
    """``q, qc, qr, qn, cell, cell_up, cell_near``: each query block with every cell, what a product across both balls can reach
    and the product of their centres. Cells are at most as many as pivots, so this grows with the query blocks alone."""
    centres = pivots[cells]
    norms = np.sqrt((centres ** 2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch["qc"].flatten(), float).reshape(n, -1)
            qr, qn = batch["qr"].to_numpy()[:, None], batch["qn"].to_numpy()[:, None]
            near = x @ centres.T
            up = near + qn * radii + qr * (norms + radii)
            up += np.abs(up) * 1e-9 + 1e-6
            again = pa.array(np.repeat(np.arange(n), len(cells)))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c].take(again) for c in ("q", "qc", "qr", "qn")], pa.array(np.tile(cells, n)), pa.array(up.ravel()), pa.array(near.ravel())],
                names=["q", "qc", "qr", "qn", "cell", "cell_up", "cell_near"])

    grid = q_balls.select(F.col("block").alias("q"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.col("norm").alias("qn"))
    return grid.mapInArrow(run, "q long, qc array<double>, qr double, qn double, cell long, cell_up double, cell_near double")


SCHEMA = "query_id long, order_id long, score double"
_OUT = pa.schema([("query_id", pa.int64()), ("order_id", pa.int64()), ("score", pa.float64())])


def _compare(tasks: DataFrame, k: int) -> DataFrame:
    """Best orders of each query of ``tasks(task, side, row_id, x, floor)``: in each task queries (side 0) against orders (side 1)."""
    def run(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["row_id"].to_numpy()
        x = np.asarray(table["x"].combine_chunks().flatten(), float).reshape(len(ids), -1)
        floor = table["floor"].to_numpy()
        q, o = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        best, found = dual_search(cover_tree(x[q], leaf=32), ids[q], cover_tree(x[o], leaf=128), ids[o], k, floor[q])
        ok = np.isfinite(best)
        return pa.Table.from_arrays([pa.array(np.repeat(ids[q], k).reshape(ok.shape)[ok]), pa.array(found[ok]), pa.array(best[ok])], schema=_OUT)

    return tasks.groupBy("task").applyInArrow(run, SCHEMA)


def nearest_orders(orders: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 2_048, most_pivots: int = 256) -> DataFrame:
    """The ``k`` orders with the highest inner product of features for every query, exactly.

    ``orders(order_id, features)`` and ``queries(order_id, features)`` hold arrays of doubles of one common length, whole numbers
    if ties are to be exact, with products summing below 2^53. Rows whose array is null, holds a null or a number that isn't
    finite, or has another length than most, or whose id is null, take no part. A query skips orders with its
    own id; repeated rows of one id are one order (the one with the greatest features). Fewer than ``k`` others give fewer rows,
    no queries none. Output: ``query_id, rank`` (from 1), ``order_id, score``; ties go to the smaller id. Other
    columns are not read.

    Pivots, at most ``most_pivots`` rows chosen by a hash, only deal rows out; every row is indexed. Cells are cut into
    blocks of about ``block_rows`` rows, so a vector that a third of all orders share fills many blocks. A query block is held
    against the balls of the cells (one a pivot), then against those of the blocks in cells that can still reach its
    threshold; only pairs of blocks that can are compared.
    """
    def usable(frame: DataFrame) -> DataFrame:
        x = F.col("features").cast("array<double>")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        out = frame.select(F.col("order_id").cast("long").alias("order_id"), x.alias("x")).where(F.col("order_id").isNotNull() & F.col("x").isNotNull())
        return out.where(fine & (F.size("x") > 0)).groupBy("order_id").agg(F.max("x").alias("x"))

    everything = materialise(usable(orders), "vectors")
    asked = materialise(usable(queries), "queries")
    length = everything.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    result = "query_id long, rank int, order_id long, score double"
    spark = orders.sparkSession
    if not length:
        return spark.createDataFrame([], result)
    d, total = length[0]["d"], everything.count()
    everything, asked = everything.where(F.size("x") == d), asked.where(F.size("x") == d)
    some = everything.orderBy(F.xxhash64("order_id")).limit(max(1, min(most_pivots, total // block_rows + 1))).collect()
    pivots = np.array([r["x"] for r in some], float)
    data = materialise(_blocks(everything, pivots, block_rows, total), "order-blocks")
    n_asked = asked.count()
    # as many pivots as the queries fill blocks, so that no block of orders is read for a handful of queries
    ask = materialise(_blocks(asked, pivots[:n_asked // block_rows + 1], block_rows, n_asked), "query-blocks")
    balls, q_balls = materialise(_summary(data), "order-balls"), materialise(_summary(ask), "query-balls")
    # two levels of balls: query blocks meet cells first, and only the blocks of cells that can still matter
    cells, radii = _reach(balls, pivots)
    crossed = materialise(_cells_of(q_balls, pivots, cells, radii), "block-cells")
    dot = F.aggregate(F.zip_with("qc", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    bound = dot + F.col("qn") * F.col("radius") + F.col("qr") * (F.col("norm") + F.col("radius"))
    best = crossed.groupBy("q").agg(F.max_by(F.struct("qc", "cell"), F.struct("cell_near", "cell")).alias("s")).select("q", "s.*")
    first = materialise(best.join(balls, "cell").groupBy("q").agg(F.max_by("block", F.struct(dot, "block")).alias("block")), "first-blocks")

    def tasks(chosen: DataFrame, floors: DataFrame | None) -> DataFrame:
        chosen = chosen.select("q", "block", F.xxhash64("q", "block").alias("task"))
        left = ask.drop("cell").withColumnRenamed("block", "q")
        left = left.join(floors, left.order_id == floors.query_id, "left").drop("query_id") if floors is not None else left.withColumn("floor", F.lit(None).cast("double"))
        asked_rows = chosen.join(left, "q").select("task", F.lit(0).alias("side"), F.col("order_id").alias("row_id"), "x", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        order_rows = chosen.join(data.drop("cell"), "block").select("task", F.lit(1).alias("side"), F.col("order_id").alias("row_id"), "x", F.lit(0.0).alias("floor"))
        return asked_rows.unionByName(order_rows)

    seen = materialise(_compare(tasks(first, None), k), "first-best")
    found = seen.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("query_id", "floor")
    floors = ask.join(found, ask.order_id == found.query_id, "left").groupBy("block").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("least"))
    open_cells = crossed.join(floors.withColumnRenamed("block", "q"), "q").where("cell_up >= least")
    rest = (open_cells.join(balls, "cell").where(bound + F.abs(bound) * 1e-9 + 1e-6 >= F.col("least"))
            .join(first, ["q", "block"], "left_anti"))
    more = _compare(tasks(materialise(rest.select("q", "block"), "open-pairs"), found), k)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "order_id")
    return (seen.unionByName(more).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "order_id", "score"))
