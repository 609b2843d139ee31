"""Quality of case narratives by a generalised additive model with pairwise interactions.

Each feature has a table of scores over its bins, and so has each chosen pair. Tables grow by cyclic boosting:
in turn every feature gets a shallow tree fitted to what is still unexplained, scaled by a small rate.
A score is a sum of looked-up bins, so whole batches are scored by array additions.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_words", "bytes_per_word", "upper", "digit", "plain_stop", "marks", "pipes", "exclaims", "high_bytes", "newlines_per_word",
    "words_per_line", "new_words", "new_pairs", "new_lines", "byte_entropy", "longest_word", "title_words", "stops_per_word",
    "brackets", "half_repeat",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:?'-"), _class(b"#$%&*@^~=+_\\/"), _class(b"|"), _class(b"!"),
    _class(bytes(range(128, 256))), _class(b"\n"), _class(b"."), _class(b"<>(){}[]"),
], axis=1)


def narrative_features(column: pa.Array) -> np.ndarray:
    """``FEATURES`` of each text of a string array; null counts as empty."""
    texts = [bytes(x.as_buffer()) for x in pc.fill_null(column, "").cast(pa.binary())]
    counts = np.zeros((len(texts), 256))
    other = np.zeros((len(texts), 10))
    for i, text in enumerate(texts):
        counts[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), text.split(b"\n")
        n = len(words)
        if n:
            half = n // 2
            title = sum(map(bytes.istitle, words[:2_000])) if n <= 2_000 else sum(map(bytes.istitle, words))
            pairs = set(zip(words, words[1:]))
            tail = set(words[half:])
            other[i] = (
                n, len(set(words)) / n, len(pairs) / max(n - 1, 1), len(lines), len(set(lines)) / len(lines), max(map(len, words)),
                title / n, len(set(words[:half]) & tail) / len(tail), len(text), 0)
    size = np.maximum(counts.sum(1), 1)
    share = counts @ _CLASSES / size[:, None]
    p = counts / size[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    n = np.maximum(other[:, 0], 1)
    return np.column_stack([
        np.log1p(other[:, 0]), size / n, share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6],
        share[:, 7] * size / n, other[:, 0] / np.maximum(other[:, 3], 1), other[:, 1], other[:, 2], other[:, 4], entropy, other[:, 5],
        other[:, 6], share[:, 8] * size / n, share[:, 9], other[:, 7],
    ])


@dataclass
class AdditiveModel:
    """Bin edges and score tables: one per feature, one per pair of features (on coarser edges)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good narrative for rows of features."""
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Best greedy split of ordered bins into at most ``leaves`` runs; each bin gets its run's step."""
    runs, cg, ch = [(0, len(g))], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(runs) < leaves:
        best = None
        for r, (lo, hi) in enumerate(runs):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            won = (_gain(cg[at] - cg[lo], ch[at] - ch[lo]) + _gain(cg[hi] - cg[at], ch[hi] - ch[at])
                   - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo]))
            i = int(won.argmax())
            if won[i] > 1e-9 and (best is None or won[i] > best[0]):
                best = (won[i], r, int(at[i]))
        if best is None:
            break
        lo, hi = runs[best[1]]
        runs[best[1]:best[1] + 1] = [(lo, best[2]), (best[2], hi)]
    step = np.zeros(len(g))
    for lo, hi in runs:
        step[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return step


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over two features: one split by rows, then each side by columns."""
    cg, ch = g.cumsum(0), h.cumsum(0)
    best, where = -1.0, None
    for r in range(g.shape[0] - 1):
        parts = []
        won = 0.0
        for gg, hh in ((cg[r], ch[r]), (cg[-1] - cg[r], ch[-1] - ch[r])):
            a, b = gg.cumsum(), hh.cumsum()
            w = _gain(a[:-1], b[:-1]) + _gain(a[-1] - a[:-1], b[-1] - b[:-1])
            c = int(w.argmax()) if len(w) else -1
            parts.append((c, a, b))
            won += w[c] if len(w) else _gain(a[-1], b[-1])
        if won > best:
            best, where = won, (r, parts)
    step = np.zeros_like(g)
    if where is None:
        return step
    r, parts = where
    for rows, (c, a, b) in zip((slice(0, r + 1), slice(r + 1, None)), parts, strict=True):
        if c >= 0:
            step[rows, :c + 1] = a[c] / (b[c] + 1.0)
            step[rows, c + 1:] = (a[-1] - a[c]) / (b[-1] - b[c] + 1.0)
        else:
            step[rows] = a[-1] / (b[-1] + 1.0)
    return step


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.08,
          bins: int = 48, coarse: int = 8, leaves: int = 3) -> AdditiveModel:
    """Cyclic boosting of logistic loss. Pairs are the ones whose joint table explains most of what single
    features leave over."""
    m = x.shape[1]
    edges, rough = [_edges(x[:, j], bins) for j in range(m)], [_edges(x[:, j], coarse) for j in range(m)]
    at = [np.searchsorted(edges[j], x[:, j], "right") for j in range(m)]
    at2 = [np.searchsorted(rough[j], x[:, j], "right") for j in range(m)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z0 = float(np.log(p0 / (1 - p0)))
    z = np.full(len(y), z0)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(m):
            g, h = slopes()
            n = len(tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), leaves)
            tables[j] += step
            z += step[at[j]]
    g, h = slopes()
    shape = lambda a, b: (len(rough[a]) + 1, len(rough[b]) + 1)
    grid = lambda a, b, w: np.bincount(at2[a] * shape(a, b)[1] + at2[b], w, shape(a, b)[0] * shape(a, b)[1]).reshape(shape(a, b))
    ranked = sorted(((-float(_gain(grid(a, b, g), grid(a, b, h)).sum()), a, b) for a in range(m) for b in range(a + 1, m)))
    chosen = [(a, b) for _, a, b in ranked[:pairs]]
    pair_tables = [np.zeros(shape(a, b)) for a, b in chosen]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(chosen):
            g, h = slopes()
            step = rate * _tree2(grid(a, b, g), grid(a, b, h))
            pair_tables[k] += step
            z += step[at2[a], at2[b]]
    return AdditiveModel(z0, edges, tables, chosen, rough, pair_tables)


def fit_quality(labelled: DataFrame, train_rows: int = 20_000) -> AdditiveModel:
    """Fit on ``labelled(case_id, narrative, good)``, ``good`` 0 or 1; rows with a null label are left out.

    At most about ``train_rows`` rows, chosen by a hash of ``case_id`` (the documented bound), have their features read
    in Spark and the tables fitted on the driver. Without rows, or with one label only, the score is the
    share of good rows (0.5 without any).
    """
    rows = labelled.select("case_id", "narrative", "good").where("good is not null")
    n = rows.select("good").count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("case_id"), F.lit(1_000_003)) < int(1_000_003 * train_rows / n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = narrative_features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "good"])

    got = rows.select("narrative", F.col("good").cast("double").alias("good")).mapInArrow(read, "x array<double>, good double").toPandas()
    y = got["good"].to_numpy()
    if len(y) == 0 or len(np.unique(y)) < 2:
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return AdditiveModel(float(np.log(p / (1 - p))), [], [], [], [], [])
    return boost(np.stack(got["x"].to_numpy()), y)


def quality_of(model: AdditiveModel, narrative: Column) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts have the score of an empty text."""
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.score(narrative_features(batch.slice(at, 1_000))) for at in range(0, len(batch), 1_000)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(narrative)


def score_quality(narratives: DataFrame, model: AdditiveModel) -> DataFrame:
    """``case_id, score`` of every whole narrative, one row per row, in one pass without a shuffle."""
    return narratives.select("case_id", quality_of(model, F.col("narrative")).alias("score"))
