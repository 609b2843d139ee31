"""Boosted trees fitted on all rows: the method of Spark ML's ``GBTClassifier`` with far fewer and shorter jobs.

Every feature is cut at quantiles of the whole table; features of few bins share a code (``Layout``), so one pass over
the codes fills the histograms of several features. A level of a tree asks for the histograms of the smaller child of each
split, the other one is what is left of its parent. Codes stay stored in the partitions, a row's state is its score.
Gradients lie on a grid on which their sums are exact, so the trees depend neither on the partitions nor on their order.
A table of up to ``ONE_TASK`` rows is fitted inside one task: a job a level would take longer than its work.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``fit_trees`` takes, with the values of ``GBTClassifier``.
PARAMS = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "maxBins": 32, "minInstancesPerNode": 1, "minInfoGain": 0.0}
ONE_TASK = 400_000
ROWS_A_TASK = 500_000
#: Values that stand for a column of a partition, and rows that are put together at once.
POINTS, BUFFERED = 1024, 100_000
#: Values of a shared code, at most, and rows whose codes are counted at once: both stay in a core's cache.
CODES, CHUNK = 1024, 32_768
#: Rounds after which scores are made from all trees again, so that no chain of stored scores gets longer.
CHAIN = 20
NOISE = 1e-12


@dataclass
class Layout:
    """Cuts of every feature (bin k holds what is above cut k - 1 and not above cut k) and the features of each code."""

    cuts: list[np.ndarray]
    groups: list[list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.bins = np.array([len(c) + 1 for c in self.cuts], dtype=np.int64)
        self.groups, size = [], CODES + 1
        for f in sorted(range(len(self.cuts)), key=lambda f: -self.bins[f]):
            if self.bins[f] == 1:
                continue
            if size * self.bins[f] > CODES:
                self.groups.append([])
                size = 1
            self.groups[-1].append(f)
            size *= int(self.bins[f])
        self.sizes = [math.prod(int(self.bins[f]) for f in g) for g in self.groups]
        self.place = {f: (k, math.prod(int(self.bins[e]) for e in g[:i])) for k, g in enumerate(self.groups) for i, f in enumerate(g)}
        self.features = sorted(self.place)
        most = max([int(self.bins[f]) for f in self.features], default=1)
        self.start = dict(zip(self.features, np.cumsum([0, *[int(self.bins[f]) for f in self.features]]), strict=False))
        self.width = sum(int(self.bins[f]) for f in self.features)
        # a table has a cell a bin, then the node's total; cell (feature, bin) that a feature lacks reads the zero put after that
        self.cells = np.array([[self.start[f] + b if b < self.bins[f] else self.width + 1 for b in range(most)] for f in self.features],
                              dtype=np.int64).reshape(-1, most)

    def codes(self, columns: list[np.ndarray], rows: int) -> np.ndarray:
        out = np.zeros((len(self.groups), rows), dtype=np.uint16)
        for f, (k, stride) in self.place.items():
            out[k] += (np.searchsorted(self.cuts[f], columns[f], side="left") * stride).astype(np.uint16)
        return out

    def above(self, feature: int, cut: int) -> tuple[int, np.ndarray]:
        """The code that holds a feature, and which of its values lie above a cut."""
        k, stride = self.place[feature]
        return k, (np.arange(self.sizes[k]) // stride) % self.bins[feature] > cut

    def single(self, joint: list[np.ndarray], total: float) -> np.ndarray:
        """Sums by code as sums by feature and bin, one after the other, and the total."""
        out = np.full(self.width + 1, float(total))
        for g, counts in zip(self.groups, joint, strict=True):
            table = counts.reshape([int(self.bins[f]) for f in reversed(g)])
            for i, f in enumerate(g):
                axis = len(g) - 1 - i
                out[self.start[f]:self.start[f] + int(self.bins[f])] = table.sum(axis=tuple(a for a in range(len(g)) if a != axis))
        return out


@dataclass
class Tree:
    """Nodes as in a heap: the children of h are 2 h and 2 h + 1; a node without a split is a leaf."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)  # feature, cut, gain
    sums: dict[int, tuple[float, float]] = field(default_factory=dict)  # rows, sum of targets

    def value(self, h: int) -> float:
        n, s = self.sums[h]
        return s / n


def _summary(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their rows; if more than ``most``, the least one and those at evenly spaced ranks, each with the rows since the one before."""
    values, at = np.unique(values, return_inverse=True)
    seen = np.cumsum(np.bincount(at, weights=weights, minlength=len(values)))
    if len(values) > most:
        kept = np.unique(np.append(0, np.searchsorted(seen, seen[-1] * (np.arange(most - 1) + 1) / (most - 1))))
        values, seen = values[kept], seen[kept]
    return values, np.diff(seen, prepend=0.0)


def _summaries(columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(column, values, rows) of a partition, at most POINTS values a column."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0)) for _ in columns]
    buffered: list[list[np.ndarray]] = [[] for _ in columns]

    def settle() -> None:
        for k, new in enumerate(buffered):
            (values, weights), more = held[k], np.concatenate([np.zeros(0), *new])
            held[k] = _summary(np.append(values, more), np.append(weights, np.ones(len(more))), POINTS)
            new.clear()

    rows = 0
    for batch in batches:
        for k, c in enumerate(columns):
            x = batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isnan(x).any():
                raise ValueError(f"missing values in {c}")
            buffered[k].append(x)
        rows += batch.num_rows
        if rows >= BUFFERED:
            settle()
            rows = 0
    settle()
    yield pa.record_batch([pa.array(range(len(columns)), pa.int32()), *[pa.array([x[i].tobytes() for x in held], pa.binary()) for i in (0, 1)]],
                          names=["k", "v", "n"])


def _quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(column, rows, values to cut at): summaries of the partitions put together; all values, or those of 257 quantiles that differ."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            parts.setdefault(r["k"], []).append((np.frombuffer(r["v"]), np.frombuffer(r["n"])))
    for k, some in parts.items():
        # in the order of their content, not of their arrival
        some.sort(key=lambda x: (x[0].tobytes(), x[1].tobytes()))
        values, rows = _summary(np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]), 1 << 40)
        seen = np.cumsum(rows)
        if len(values) > 256:
            values = values[np.unique(np.searchsorted(seen, seen[-1] * np.arange(257) / 256))]
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([int(rows.sum())]), pa.array([values.tobytes()], pa.binary())], names=["k", "n", "v"])


def find_cuts(numbers: DataFrame, columns: list[str], bins: int) -> tuple[int, Layout]:
    """Rows, and cuts at values of the whole table, evenly picked if there are too many. A missing value raises."""
    names = numbers.columns
    found = numbers.mapInArrow(lambda it: _summaries(names, it), "k int, v binary, n binary").repartition("k").mapInArrow(
        _quantiles, "k int, n long, v binary").collect()
    cuts = [np.zeros(0)] * len(columns)
    for r in found:
        if r["k"] < len(columns):
            values = np.frombuffer(r["v"])[:-1]
            if len(values) > bins - 1:
                values = values[np.unique(np.linspace(0, len(values) - 1, bins - 1).round().astype(int))]
            cuts[r["k"]] = values
    return max((r["n"] for r in found), default=0), Layout(cuts)


def _coded(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            y = np.where(cells[-1] > 0, 1, -1).astype(np.int8)
            yield pa.record_batch([pa.array([layout.codes(cells, len(y)).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["codes", "y"])
    return work


class Rows:
    """The rows of one partition: codes, label (-1, 1) and score."""

    def __init__(self, layout: Layout, codes: np.ndarray, y: np.ndarray, score: np.ndarray | None, bits: int):
        self.layout, self.codes, self.y, self.bits = layout, codes, y, bits
        self.score = np.zeros(len(y)) if score is None else score

    def leaves(self, tree: Tree) -> dict[int, np.ndarray]:
        """The rows in every node that is not split."""
        out = {1: np.arange(len(self.y))}
        for h in sorted(tree.splits):
            k, above = self.layout.above(*tree.splits[h][:2])
            rows = out.pop(h)
            right = above[self.codes[k].take(rows)]
            out[2 * h], out[2 * h + 1] = rows[~right], rows[right]
        return out

    def add(self, tree: Tree, weight: float) -> None:
        for h, rows in self.leaves(tree).items():
            self.score[rows] += weight * tree.value(h)

    def targets(self, first: bool) -> np.ndarray:
        """What the next tree is fitted on: the label, then the negative gradient of 2 log(1 + exp(-2 y score))."""
        if first:
            return self.y.astype(np.float64)
        with np.errstate(over="ignore"):
            g = 4.0 * self.y / (1.0 + np.exp(2.0 * self.y * self.score))
        return np.rint(g * 2.0 ** self.bits) * 2.0 ** -self.bits

    def histograms(self, tree: Tree, wanted: list[int], first: bool, counts: bool) -> np.ndarray:
        """(wanted node, counts and sums, cell); without ``counts`` only sums are right."""
        out = np.zeros((len(wanted), 2, self.layout.width + 1))
        target, nodes, sizes = self.targets(first), self.leaves(tree), self.layout.sizes
        for i, h in enumerate(wanted):
            n, s = [np.zeros(size) for size in sizes], [np.zeros(size) for size in sizes]
            for at in range(0, len(nodes[h]), CHUNK):
                rows = nodes[h][at:at + CHUNK]
                g = target.take(rows)
                for k, size in enumerate(sizes):
                    code = (self.codes[k, at:at + CHUNK] if h == 1 else self.codes[k].take(rows)).astype(np.intp)
                    s[k] += np.bincount(code, weights=g, minlength=size)
                    if counts:
                        n[k] += np.bincount(code, minlength=size)
            out[i] = self.layout.single(n, len(nodes[h])), self.layout.single(s, target.take(nodes[h]).sum())
        return out


def best_split(layout: Layout, table: np.ndarray, total: tuple[float, float], least: int, gain: float) -> tuple[int, int, float, float, float] | None:
    """(feature, cut, gain, rows and sum on the left) of the split that lowers the variance most; None if none does."""
    if not layout.features:
        return None
    n, s = total
    left, sums = np.cumsum(np.append(table, np.zeros((2, 1)), axis=1)[:, layout.cells], axis=2)
    right = n - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = (sums * sums / left + (s - sums) ** 2 / right - s * s / n) / n
    gains = np.where((left >= least) & (right >= least), gains, -1.0)
    at = int(np.argmax(gains))
    f, cut = divmod(at, gains.shape[1])
    found = float(gains[f, cut])
    if found <= max(gain, NOISE):
        return None
    return layout.features[f], cut, found, float(left[f, cut]), float(sums[f, cut])


def boost(layout: Layout, p: dict, ask: Callable[[Tree, list[int], bool, bool], np.ndarray],
          add: Callable[[Tree, float], None]) -> list[Tree]:
    """The trees; ``ask`` gives histograms of nodes over all rows, ``add`` adds a finished tree to the scores."""
    trees, counts = [], None
    for k in range(p["maxIter"]):
        tree, tables = Tree(), {}
        level = [1]
        for depth in range(p["maxDepth"]):
            wanted = [h for h in level if h == 1 or tree.sums[h][0] < tree.sums[h ^ 1][0] or (tree.sums[h][0] == tree.sums[h ^ 1][0] and h % 2 == 0)]
            got = dict(zip(wanted, ask(tree, wanted, k == 0, depth > 0 or counts is None), strict=True))
            if depth == 0:
                counts = got[1][0] if counts is None else counts
                got[1][0] = counts
                tree.sums[1] = (float(counts[-1]), float(got[1][1, -1]))
            now = {h: got[h] if h in got else tables[h // 2] - got[h ^ 1] for h in level}
            tables, level = now, []
            for h, table in now.items():
                found = best_split(layout, table, tree.sums[h], p["minInstancesPerNode"], p["minInfoGain"])
                if found:
                    f, cut, gain, n, s = found
                    tree.splits[h] = (f, cut, gain)
                    tree.sums[2 * h], tree.sums[2 * h + 1] = (n, s), (tree.sums[h][0] - n, tree.sums[h][1] - s)
                    level += [2 * h, 2 * h + 1]
            if not level:
                break
        trees.append(tree)
        add(tree, 1.0 if k == 0 else p["stepSize"])
    return trees


def fit_trees(train: DataFrame, columns: list[str], params: dict, one_task: int = ONE_TASK, rows_a_task: int = ROWS_A_TASK) -> tuple[list[Tree], Layout]:
    """Trees for the label ``y`` (0/1) on all rows of ``train``, which is read twice. A missing value raises."""
    p = PARAMS | params
    numbers = train.select(*[F.col(c).cast("double") for c in columns], F.col("y").cast("double"))
    n, layout = find_cuts(numbers, columns, p["maxBins"])
    if not n:
        raise ValueError("no rows to fit on")
    bits, slots = 50 - math.ceil(math.log2(max(n, 2))), max(1, train.sparkSession.sparkContext.defaultParallelism)
    parts = 1 if n <= one_task else slots * -(-n // (slots * rows_a_task))
    blocks = numbers.mapInArrow(_coded(layout), "codes binary, y binary").repartition(parts).rdd
    width = len(layout.groups)

    def joined(it: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        got = [(np.frombuffer(r["codes"], np.uint16).reshape(width, len(r["y"])), np.frombuffer(r["y"], np.int8)) for r in it]
        y = np.concatenate([np.zeros(0, np.int8), *[b for _, b in got]])
        yield np.concatenate([a for a, _ in got], axis=1) if width and got else np.zeros((width, len(y)), np.uint16), y

    if parts == 1:
        def whole(it: Iterator) -> Iterator[list[Tree]]:
            rows = Rows(layout, *next(joined(it)), None, bits)
            yield boost(layout, p, rows.histograms, rows.add)

        return blocks.mapPartitions(whole).collect()[0], layout
    # one record a partition, in batches of one: the two sides of a zip fit without being written anew
    plain = BatchedSerializer(CPickleSerializer(), 1)
    codes = blocks.mapPartitions(joined)._reserialize(plain).persist(StorageLevel.MEMORY_AND_DISK)
    scores, done = [codes.map(lambda x: np.zeros(len(x[1])))._reserialize(plain).persist(StorageLevel.MEMORY_AND_DISK)], []

    def ask(tree: Tree, wanted: list[int], first: bool, counts: bool) -> np.ndarray:
        out = 0.0
        for table in codes.zip(scores[-1]).map(lambda x: Rows(layout, *x[0], x[1], bits).histograms(tree, wanted, first, counts)).collect():
            out = out + table
        while len(scores) > 1:  # the last ones have just been stored
            scores.pop(0).unpersist()
        return out

    def add(tree: Tree, weight: float) -> None:
        done.append((tree, weight))
        anew, todo = len(done) % CHAIN == 0, list(done)

        def added(x) -> np.ndarray:
            (code, y), score = x
            rows = Rows(layout, code, y, None if anew else score.copy(), bits)
            for t, w in todo if anew else todo[-1:]:
                rows.add(t, w)
            return rows.score

        before = codes.map(lambda x: (x, None)) if anew else codes.zip(scores[-1])
        scores.append(before.map(added)._reserialize(plain).persist(StorageLevel.MEMORY_AND_DISK))

    try:
        return boost(layout, p, ask, add), layout
    finally:
        for stored in (codes, *scores):
            stored.unpersist()


def classifier(spark: SparkSession, trees: list[Tree], columns: list[str], layout: Layout, step: float) -> GBTClassificationModel:
    """The trees as Spark ML's model, which scores, is stored and loaded as one it has fitted (impurities of nodes are not kept)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml, mllib = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib
    # each dot asks the JVM what it means
    kind, leaf, inner, at = ml.regression.DecisionTreeRegressionModel, ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    stats, parse = mllib.tree.impurity.VarianceCalculator, mllib.linalg.Vectors.parse

    def node(tree: Tree, h: int):
        n, s = tree.sums[h]
        known = stats(parse(f"[{n!r},{s!r},{s * s / n!r}]").toArray(), int(n))
        if h not in tree.splits:
            return leaf(s / n, 0.0, known)
        f, cut, gain = tree.splits[h]
        return inner(s / n, 0.0, gain, node(tree, 2 * h), node(tree, 2 * h + 1), at(f, float(layout.cuts[f][cut])), known)

    made = gateway.new_array(kind, len(trees))
    for k, tree in enumerate(trees):
        made[k] = kind(f"dtr_{k}", node(tree, 1), len(columns))
    weights = parse(str([1.0, *[float(step)] * (len(trees) - 1)])).toArray()
    return GBTClassificationModel(ml.classification.GBTClassificationModel(f"gbtc_{uuid.uuid4().hex[:12]}", made, weights, len(columns), 2))
