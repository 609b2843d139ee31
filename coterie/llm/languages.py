"""Languages of case narratives: script ranges, per-word scores and a Viterbi pass with a switching penalty."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First code point of each run of one script, from the Unicode block list; 0 is no script of its own.
SCRIPT_STARTS = (
    (0x0000, 1), (0x0250, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0),
    (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 0),
    (0x0E00, 15), (0x0E80, 0), (0x10A0, 16), (0x1100, 17), (0x1200, 18), (0x1400, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 19), (0x3100, 0), (0x3130, 17), (0x3190, 0), (0x3400, 20), (0xA000, 0), (0xAC00, 17), (0xD7B0, 0), (0xF900, 20),
    (0xFB00, 0), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0x20000, 20), (0x30000, 0),
)
_STARTS = np.array([s for s, _ in SCRIPT_STARTS], np.uint32)
_SCRIPTS = np.array([k for _, k in SCRIPT_STARTS], np.int64)
_LETTER: list[np.ndarray] = []
GRAMS = (1, 2, 3, 4)
# Words of one window of a text, whose mean is compared with windows of the labelled rows.
WINDOW = 16
# A window fits down to this many times the distance from the median to the lower quartile of the labelled windows, and at least LEAST.
SLACK, LEAST = 4.0, 0.1


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased words, each between two blanks; the start of each word; the word of each point."""
    joined = " " + "  ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return points, starts, np.repeat(np.arange(len(words)), sizes)


def _gram_buckets(words: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, bucket, whether it has letters and word ends only) of each character n-gram, for every length in ``GRAMS``; a blank
    marks a word's ends."""
    points, _, word = _code_points(words)
    others = np.concatenate([[0], np.cumsum(~_letters()[points] & (points != 32))])
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if n > len(points):
            return
        h = (h[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[n - 1:].astype(np.uint64) + np.uint64(n))
        if n in GRAMS:
            inside = word[:len(h)] == word[n - 1:]
            g = h[inside]
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield word[:len(h)][inside], ((g >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), (others[n:] == others[:-n])[inside]


def _windows(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each word (``doc`` is its text, in order) and words of each window: runs of ``WINDOW`` words, the rest with the last."""
    sizes = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]
    many = np.maximum(sizes // WINDOW, 1)
    window = (np.cumsum(many) - many)[doc] + np.minimum(place // WINDOW, many[doc] - 1)
    return window, np.bincount(window, minlength=int(many.sum()))


@dataclass
class LanguageModel:
    """Log probabilities of n-gram buckets by language, and the scripts each language is written in.

    ``usual`` and ``slack`` say by language what mean log probability a window of words has in the labelled rows, and how far
    below a window may lie that still fits."""

    languages: list[str]
    log_p: np.ndarray  # language x bucket
    scripts: np.ndarray  # language, bits
    penalty: float
    kept: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None
    most: int = 300_000
    most_points: int = 1 << 24
    kept_points: int = 0
    usual: np.ndarray | None = None
    slack: np.ndarray | None = None
    means: np.ndarray | None = None
    known: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "kept": {}, "kept_points": 0, "scores": None, "letters": None, "means": None, "known": None}

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores (word x language) and letter counts; a language whose scripts a word lacks can't win it. Then the mean log
        probability of a word's n-grams without punctuation (word x language) and its letters in each language's scripts."""
        lower = [w.lower() for w in words]
        points, starts, _ = _code_points(lower)
        is_letter = _letters()[points]
        n = np.add.reduceat(is_letter, starts, dtype=np.int64)
        bits = np.where(is_letter, 1 << _SCRIPTS[np.searchsorted(_STARTS, points, "right") - 1], 0)
        used = np.bitwise_or.reduceat(bits, starts)
        known = np.stack([np.add.reduceat((bits & b) != 0, starts, dtype=np.int64) for b in self.scripts], 1)
        score = np.zeros((len(words), len(self.languages)))
        plain_score, grams = np.zeros_like(score), np.zeros(len(words))
        for word, bucket, plain in _gram_buckets(lower, self.log_p.shape[1]):
            grams += np.bincount(word, plain, len(words))
            for k in range(len(self.languages)):
                log_p = self.log_p[k, bucket]
                score[:, k] += np.bincount(word, log_p, len(words))
                plain_score[:, k] += np.bincount(word, log_p * plain, len(words))
        means = (plain_score / np.maximum(grams, 1)[:, None]).astype(np.float32)
        can = (used[:, None] & self.scripts[None, :]) != 0
        can |= ~can.any(1, keepdims=True)
        score -= score.max(1, keepdims=True)
        score = np.where(can, score, score.min(1, keepdims=True) - 20)
        score -= score.max(1, keepdims=True)
        score[n == 0] = 0
        return score.astype(np.float32), n, means, known

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row of every word in the kept scores, and the number of words of each text."""
        split = [t.split() for t in texts]
        if len(self.kept) > self.most or self.kept_points > self.most_points:
            self.kept.clear()
            self.kept_points = 0
            self.scores = self.letters = self.means = self.known = None
        kept = self.kept
        new = list({w for words in split for w in words}.difference(kept))
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            made = self._score(some)
            self.kept_points += sum(map(len, some))
            kept.update(zip(some, range(len(kept), len(kept) + len(some)), strict=True))
            held = (self.scores, self.letters, self.means, self.known)
            self.scores, self.letters, self.means, self.known = made if held[0] is None else map(np.concatenate, zip(held, made, strict=True))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter((kept[w] for words in split for w in words), np.int64, int(sizes.sum()))
        return rows, sizes

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language of every word on the best path, words of each text, letters of each word.

        All texts of the batch advance together, longest first, one word a step: stay, or come from the best
        language for ``penalty``."""
        rows, sizes = self._look_up(texts)
        return self._path(rows, sizes), sizes, self.letters[rows] if len(rows) else np.zeros(0, np.int64)

    def _path(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        k, total = len(self.languages), len(rows)
        labels = np.zeros(total, np.int16)
        if total == 0:
            return labels
        order = np.argsort(-sizes, kind="stable")
        first = np.cumsum(sizes) - sizes
        begin = first[order]
        active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
        back = np.empty((total, k), np.int16)
        value = np.zeros((len(sizes), k), np.float32)
        lanes = np.arange(k, dtype=np.int16)
        for t, m in enumerate(active):
            at = begin[:m] + t
            v = value[:m]
            best = v.argmax(1)
            top = v[np.arange(m), best] - self.penalty
            back[at] = np.where(v >= top[:, None], lanes, best[:, None])
            value[:m] = np.maximum(v, top[:, None]) + self.scores[rows[at]]
            if t % 512 == 511:
                value[:m] -= value[:m].max(1, keepdims=True)
        now = value.argmax(1).astype(np.int16)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = begin[:m] + t
            labels[at] = now[:m]
            now[:m] = back[at, now[:m]]
        return labels

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, pa.Array]:
        """Main language of each text, its share of all letters, and the spans."""
        return self.predict_with_fit(texts)[:3]

    def _fit(self, rows: np.ndarray, labels: np.ndarray, letters: np.ndarray, doc: np.ndarray, n_docs: int, total: np.ndarray) -> np.ndarray:
        """Largest share of a text's letters that one language has in its own scripts and in windows that read like its labelled rows."""
        k = len(self.languages)
        known = self.known[rows, labels]
        # numbers say nothing, and words of other scripts are no part of a language
        at = np.flatnonzero((known > 0) & (2 * known >= letters))
        if not len(at):
            return np.zeros(n_docs)
        window, sizes = _windows(doc[at], n_docs)
        own, n = labels[at], len(sizes)
        below = np.bincount(window, self.means[rows[at], own] - self.usual[own], n)
        room = np.bincount(window, self.slack[own], n) * np.sqrt(WINDOW / np.maximum(sizes, 1))
        weight = np.bincount(doc[at] * k + own, known[at] * (below >= -room)[window], n_docs * k).reshape(-1, k)
        return np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)

    def predict_with_fit(self, texts: list[str]) -> tuple[list[str], np.ndarray, pa.Array, np.ndarray]:
        """What ``predict`` returns, and the share of letters that fits one language (see ``_fit``)."""
        rows, sizes = self._look_up(texts)
        labels = self._path(rows, sizes)
        letters = self.letters[rows] if len(rows) else np.zeros(0, np.int64)
        k = len(self.languages)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.bincount(doc * k + labels, letters, len(sizes) * k).reshape(-1, k)
        total = weight.sum(1)
        best = weight.argmax(1)
        score = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
        names = [self.languages[b] if t else "und" for b, t in zip(best, total, strict=True)]
        change = np.ones(len(labels), bool)
        change[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(labels))
        offset = np.cumsum(sizes) - sizes
        spans = pa.StructArray.from_arrays(
            [pa.array(starts - offset[doc[starts]], pa.int64()), pa.array(ends - offset[doc[starts]], pa.int64()),
             pa.array([self.languages[i] for i in labels[starts]], pa.string())], names=["start", "end", "language"])
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[starts], minlength=len(sizes)))])
        fit = self._fit(rows, labels, letters, doc, len(sizes), total) if len(labels) else np.zeros(len(sizes))
        return names, score, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans), fit


def fit_languages(labelled: DataFrame, train_rows: int = 20_000, buckets: int = 1 << 16, penalty: float = 12.0,
                  bound_rows: int = 4_000) -> LanguageModel | None:
    """Fit on ``labelled(case_id, narrative, language)``, rows with a null in either of the last two left out.

    About ``train_rows`` rows chosen by a hash of ``case_id`` are counted (all, if fewer): the documented
    bound. n-grams are counted inside the tasks; the driver gets one row per language and bucket. Without labelled
    rows there is no model (None): everything is ``und``. What fits a language is set by windows of about ``bound_rows`` of
    these rows (a second documented bound), each scored without the counts of its own row.
    """
    rows = labelled.select("case_id", "narrative", "language").where("narrative is not null and language is not null")
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("case_id"), F.lit(1_000_003)) < int(1_000_003 * train_rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.lower().split())
            for lang, c in words.items():
                out = np.zeros(buckets + len(SCRIPT_STARTS))
                names, times = list(c), np.fromiter(c.values(), np.float64, len(c))
                for at in range(0, len(names), 50_000):
                    some, weight = names[at:at + 50_000], times[at:at + 50_000]
                    for word, bucket, _ in _gram_buckets(some, buckets):
                        out[:buckets] += np.bincount(bucket, weight[word], buckets)
                    points, _, word = _code_points(some)
                    script = _SCRIPTS[np.searchsorted(_STARTS, points, "right") - 1]
                    out[buckets:] += np.bincount(script, weight[word] * _letters()[points], len(SCRIPT_STARTS))
                at = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(out[at])], names=["language", "bucket", "n"])

    counts = (rows.select("narrative", F.col("language").cast("string").alias("language"))
              .mapInArrow(count, "language string, bucket long, n double").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(counts["language"].unique())
    if not names:
        return None
    table = np.zeros((len(names), buckets + len(SCRIPT_STARTS)))
    table[counts["language"].map({x: i for i, x in enumerate(names)}), counts["bucket"]] = counts["n"]
    grams, scripts = table[:, :buckets] + 0.05, table[:, buckets:]
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    bits = ((share >= 0.01) * (1 << np.arange(len(SCRIPT_STARTS)))).sum(1)
    usual, slack = _bounds(rows, min(n, train_rows), bound_rows, names, table[:, :buckets])
    return LanguageModel(names, np.log(grams / grams.sum(1, keepdims=True)), bits, penalty, usual=usual, slack=slack)


def _weighted(value: np.ndarray, weight: np.ndarray, q: float) -> float:
    order = np.argsort(value)
    cum = np.cumsum(weight[order])
    return float(value[order][np.searchsorted(cum, q * cum[-1])])


def _bounds(rows: DataFrame, n: int, bound_rows: int, names: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Usual mean log probability of a window by language, and how far below it a window of ``WINDOW`` words still fits.

    Median and lower quartile stand for the clean windows: passages and junk in less than a quarter of them move neither much.
    The driver gets windows counted by language, size and rounded mean."""
    buckets = table.shape[1]
    # another salt than the one that chose the rows
    chosen = rows if n <= bound_rows else rows.where(F.pmod(F.xxhash64("case_id", F.lit(1)), F.lit(1_000_003)) < int(1_000_003 * bound_rows / n))
    sums = table.sum(1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Counter = Counter()
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                words = [w for w in text.lower().split() if any(map(str.isalpha, w))]
                if not words:
                    continue
                k = names.index(lang)
                word, bucket, plain = (np.concatenate(x) for x in zip(*_gram_buckets(words, buckets), strict=True))
                some, back, times = np.unique(bucket, return_inverse=True, return_counts=True)
                left = np.maximum(table[k, some] - times, 0) + 0.05
                log_p = np.log(left / max(sums[k] - len(bucket) + 0.05 * buckets, 1))[back]
                means = np.bincount(word, log_p * plain, len(words)) / np.maximum(np.bincount(word, plain, len(words)), 1)
                window, sizes = _windows(np.zeros(len(words), np.int64), 1)
                out.update(zip([lang] * len(sizes), sizes.tolist(), np.round(np.bincount(window, means) / sizes, 2).tolist(), strict=True))
            got = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.float64()),
                 pa.array(list(out.values()), pa.int64())], names=["language", "size", "mean", "n"])

    got = (chosen.select("narrative", F.col("language").cast("string").alias("language")).mapInArrow(read, "language string, size long, mean double, n long")
           .groupBy("language", "size", "mean").agg(F.sum("n").alias("n")).toPandas())
    usual, slack = np.zeros(len(names)), np.full(len(names), np.inf)  # a language without any such window bounds nothing
    for k, name in enumerate(names):
        own = got[got["language"] == name]
        if len(own):
            size, mean, times = (own[c].to_numpy(float) for c in ("size", "mean", "n"))
            usual[k] = _weighted(mean, times * size, 0.5)
            slack[k] = max(-SLACK * _weighted((mean - usual[k]) * np.sqrt(size / WINDOW), times * size, 0.25), LEAST)
    return usual, slack


def language_of(model: LanguageModel | None, narrative: Column) -> Column:
    """``struct<language, score, spans array<struct<start, end, language>>, fit>`` of a text column.

    Spans count white-space separated words, end exclusive. ``language`` is the one with most letters (of equals the
    first by name), ``und`` with score 0 if the text is null, empty or without a letter. ``score`` is its share of all letters, whether
    they read like that language or not. ``fit`` says how much does: the largest share of all letters that one language has in its own
    scripts and in windows whose mean n-gram log probability is not below what labelled rows have.
    """
    kind = pa.struct([("language", pa.string()), ("score", pa.float64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("language", pa.string())]))), ("fit", pa.float64())])

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [pa.array([], kind)]
            for at in range(0, len(batch), 2_000):
                texts = pc.fill_null(batch.slice(at, 2_000), "").to_pylist()
                if model is None:
                    done.append(pa.array([{"language": "und", "score": 0.0, "spans": [], "fit": 0.0}] * len(texts), kind))
                    continue
                names, score, spans, fit = model.predict_with_fit(texts)
                done.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), spans.cast(kind[2].type), pa.array(fit, pa.float64())],
                                                       fields=[kind[i] for i in range(4)]))
            yield pa.concat_arrays(done)

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(predict, "language string, score double, spans array<struct<start:long,end:long,language:string>>, fit double")(narrative)


def identify_languages(narratives: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``case_id, language, score, spans, fit`` of every whole narrative, one row per row and in one pass."""
    return narratives.select("case_id", language_of(model, F.col("narrative")).alias("x")).select("case_id", "x.language", "x.score", "x.spans", "x.fit")
