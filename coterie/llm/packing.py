"""Case narratives packed into sequences of tokens by patterns whose repeat counts a least-squares fit gives.

Only the histogram of piece lengths reaches the driver: at most one row per length up to the capacity. The plan
it makes is as bounded. Pieces find their place by their rank among pieces of equal length.
"""
from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from coterie.sources.scratch import materialise

PIECES = "piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of texts whose tokenizer never joins characters over ASCII white space: words are encoded once and kept."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism; threads of each would spin
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most = most
        self.kept: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = text.split() if not _CONTROL.search(text) else _BLANK.split(text)
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, words))
        except KeyError:
            pass
        if len(kept) > self.most or self.held > 1 << 25:
            kept.clear()
            self.held = 0
        self._learn(set(words).difference(kept))
        return b"".join(map(kept.__getitem__, words))

    def _learn(self, new: set[str]) -> None:
        """Keep the ids of words: of letters in small print, and of a last mark, apart, as they are shared."""
        kept, parts, ask = self.kept, [], []
        for word in new:
            core, mark = (word[:-1], word[-1]) if word[-1:] in _MARKS else (word, "")
            small = core.lower()
            if small.isalpha() and (core.isascii() or "\u03a3" not in core and is_normalized("NFC", core) and is_normalized("NFC", small)):
                # letters only (a capital sigma's small form hangs on its place): nothing else to normalise or to cut
                core = small
                if core not in kept:
                    plain = core if core.isascii() else core.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
                    kept[core] = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
                    self.held += len(core)
            else:
                core, mark = word, ""
                ask.append(core)
            parts.append((word, core, mark))
            if mark and mark not in kept:
                ask.append(mark)
        ask = list(set(ask))
        for word, e in zip(ask, self.tokenizer.encode_batch_fast(ask, add_special_tokens=False), strict=True):
            kept[word] = array("I", e.ids).tobytes()
            self.held += len(word)
        for word, core, mark in parts:
            if word not in kept:
                kept[word] = kept[core] + kept[mark] if mark else kept[core]
                self.held += len(word)


#: Python splits at these, the tokenizer does not; all other white space separates words for both.
_CONTROL = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[ \t\n\v\f\r]+")
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes bytes that aren't printable Latin-1 as the letters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(narratives: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``case_id, piece, start, length, ids_crc32`` (and ``ids``) of ``narratives(case_id, narrative)``.

    A narrative's ids, then ``end_id``, cut every ``capacity`` ids. A null narrative is an empty one and has
    ``end_id`` alone. ``tokenizer`` is a file all executors can read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, piece, start, length, crc, out = [], [], [], [], [], []
                for i, text in enumerate(pc.fill_null(part.column(1), "").to_pylist()):
                    ids = enc.encode(text) + end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo:lo + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            out.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["case_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = narratives.schema["case_id"].dataType.simpleString()
    return narratives.select("case_id", "narrative").mapInArrow(
        read, f"case_id {kind}, {PIECES}" + (", ids array<int>" if with_ids else ""))


def length_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int = 40_000) -> np.ndarray:
    """Up to ``most`` patterns of one to three present lengths that fill a sequence exactly, the ones with most
    pieces first; rows of positions in ``lengths``, -1 where a pattern is shorter."""
    where = np.full(capacity + 1, -1)
    where[lengths] = np.arange(len(lengths))
    a, b = np.triu_indices(len(lengths))
    rest = capacity - lengths[a] - lengths[b]
    pairs = np.flatnonzero(rest == 0)
    ok = np.flatnonzero(rest > 0)
    c = where[rest[ok]]
    ok, c = ok[c >= b[ok]], c[c >= b[ok]]
    found = np.concatenate([np.column_stack([a[pairs], b[pairs], np.full(len(pairs), -1)]), np.column_stack([a[ok], b[ok], c])])
    weight = np.append(counts, np.iinfo(np.int64).max)[found].min(1)
    return found[np.argsort(-weight, kind="stable")[:most]]


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats of each pattern whose pieces come closest to ``counts``.

    Accelerated projected gradient; a step is one gather and one scatter over the patterns."""
    if not len(patterns):
        return np.zeros(0)
    n, index = len(counts), np.where(patterns < 0, len(counts), patterns)
    flat = index.ravel()
    width = np.bincount(flat, minlength=n + 1)[:n].max()
    rate = 1.0 / (patterns.shape[1] * width)
    x = y = np.zeros(len(patterns))
    target = np.append(counts, 0).astype(float)
    t = 1.0
    for _ in range(steps):
        miss = np.bincount(flat, np.repeat(y, patterns.shape[1]), n + 1) - target
        miss[n] = 0
        new = np.maximum(y - rate * miss[index].sum(1), 0)
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / ahead * (new - x)
        x, t = new, ahead
    return x


def _best_fit(lengths: list[int], left: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on a histogram: (length, times) of a sequence, and how many sequences look so."""
    free: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in sorted(lengths, reverse=True):
        n = left[length]
        for space in sorted(s for s in free if s >= length):
            while n and free.get(space):
                made, many = free[space].pop()
                fit = space // length
                # the emptied place of a sequence takes further pieces before a roomier one does
                full = min(many, n // fit)
                if full:
                    free.setdefault(space - fit * length, []).append((made + [(length, fit)], full))
                    n -= full * fit
                    many -= full
                if many and 0 < n < fit:
                    free.setdefault(space - n * length, []).append((made + [(length, n)], 1))
                    n, many = 0, many - 1
                if many:
                    free[space].append((made, many))
                    break
            if not n:
                break
        fit = capacity // length
        if n >= fit:
            free.setdefault(capacity - fit * length, []).append(([(length, fit)], n // fit))
        if n % fit:
            free.setdefault(capacity - n % fit * length, []).append(([(length, n % fit)], 1))
    return [x for group in free.values() for x in group]


def pack_plan(histogram: dict[int, int], capacity: int = 4096) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go: rows (length, first rank, end rank, first sequence, offset), and the
    number of sequences.

    Repeats of exact patterns are fitted and rounded down to what the histogram still holds; the rest is packed
    best-fit decreasing."""
    left = {n: c for n, c in histogram.items() if n < capacity and c > 0}
    groups: list[tuple[list[tuple[int, int]], int]] = []
    if histogram.get(capacity):
        groups.append(([(capacity, 1)], histogram[capacity]))
    if left:
        lengths = np.array(sorted(left, reverse=True))
        counts = np.array([left[int(n)] for n in lengths])
        patterns = length_patterns(lengths, counts, capacity)
        repeats = np.floor(fit_repeats(patterns, counts) + 1e-6).astype(int)
        for p in np.argsort(-repeats, kind="stable"):
            if not repeats[p]:
                break
            made: dict[int, int] = {}
            for i in patterns[p]:
                if i >= 0:
                    made[int(lengths[i])] = made.get(int(lengths[i]), 0) + 1
            many = min(int(repeats[p]), *(left[n] // k for n, k in made.items()))
            if many:
                groups.append((list(made.items()), many))
                for n, k in made.items():
                    left[n] -= k * many
        groups += _best_fit([n for n, c in left.items() if c], left, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for made, many in groups:
        offset = 0
        for length, times in made:
            for _ in range(times):
                rank = used.get(length, 0)
                rows.append((length, rank, rank + many, sequence, offset))
                used[length] = rank + many
                offset += length
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def pack_narratives(narratives: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of ``narratives(case_id, narrative)`` and their place in sequences of at most ``capacity`` ids.

    Output, one row per piece: ``case_id, piece, start, length, ids_crc32`` (and ``ids``), ``sequence_id, offset``. Only
    narratives longer than ``capacity`` are cut; sequences have no gaps. Repeated rows, and equal lengths, are
    pieces of their own with a place each. No rows give no rows. Other columns are not read.

    Ranks among equal lengths come from counts per (length, hash of the piece) and a window inside each, so a
    length that holds a third of all rows is spread like any other.
    """
    pieces = materialise(token_pieces(narratives, tokenizer, capacity, end_id, with_ids), "pieces")
    salts = max(1, pieces.count() // 1_000)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("case_id", "piece", "ids_crc32"), F.lit(salts)))
    cells = materialise(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = pack_plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "length-ranks")
    inside = Window.partitionBy("length", "salt").orderBy("case_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(inside) - 1).join(base, ["length", "salt"])
    keys = plan[:, 0] << 40 | plan[:, 1]

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, n.astype(np.int64) << 40 | r.astype(np.int64), "right") - 1
        return pa.StructArray.from_arrays([pa.array(plan[at, 3] + r - plan[at, 1]), pa.array(plan[at, 4])], names=["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    where = F.arrow_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("r") + F.col("base"))
    ids = ["ids"] if with_ids else []
    return ranked.withColumn("p", where).select("case_id", "piece", "start", "length", "ids_crc32", *ids, "p.sequence_id", "p.offset")
