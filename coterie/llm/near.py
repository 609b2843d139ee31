"""Near-duplicate case narratives: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.operators.components import union_groups
from coterie.sources.scratch import few, materialise

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_FAR = np.uint64(1 << 63)

LONGEST_KEPT = 64  # bytes of a word that is remembered, so that what a task remembers is bounded in bytes


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of the distinct word shingles of texts. Words are hashed once and kept."""

    def __init__(self, words: int, most: int = 300_000) -> None:
        self.words, self.most = words, most
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        kept = self.kept
        try:
            h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(kept) > self.most:
                kept.clear()
            new = {w: xxhash.xxh3_64_intdigest(w) for w in set(words).difference(kept)}
            kept.update((w, x) for w, x in new.items() if len(w) <= LONGEST_KEPT)
            h = np.fromiter((new[w] if len(w) > LONGEST_KEPT else kept[w] for w in words), np.uint64, len(words))
        n = min(self.words, len(words))
        if not n:
            return np.zeros(0, np.uint64)
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * _STEP + h[i:len(words) - n + 1 + i])
        return np.unique(out)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (set x m) of sets of distinct 64-bit hashes.

    Each element has a random permutation of the m places; in step j it offers j plus a fraction to its j-th place, so
    its ranks differ and the variance is below that of independent hashes. A set stops at the first j that
    no place could still take. All sets of the call go step by step together; an offer is j in the high bits and
    the fraction below."""
    k = len(sets)
    out = np.full(k * m, _FAR, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, k)
    element = np.concatenate(sets) if k else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(k), sizes)
    taken: np.ndarray | None = None
    for j in range(m):
        if not len(element):
            break
        draw = _mix(element + np.uint64((2 * j + 1) * int(_STEP) % (1 << 64)))
        swap = (j + (_mix(draw) >> np.uint64(11)) % np.uint64(m - j)).astype(np.int64)
        if taken is None:
            place = swap
        else:
            lane = np.arange(len(element))
            place = taken[lane, swap].astype(np.int64)
            taken[lane, swap] = taken[:, j]
        offer = (np.uint64(j) << np.uint64(48)) | (draw >> np.uint64(16))
        np.minimum.at(out, owner * m + place, offer)
        worst = out.reshape(k, m).max(1) >> np.uint64(48)
        going = worst[owner] > j
        if taken is None:
            element, owner, first = element[going], owner[going], swap[going]
            taken = np.tile(np.arange(m, dtype=np.int16), (len(element), 1))
            taken[np.arange(len(element)), first] = 0  # place 0 went where the first draw came from
        elif not going.all():
            element, owner, taken = element[going], owner[going], taken[going]
    return out.reshape(k, m)


def band_rows(percent: int, places: int = 120, miss: float = 1e-6) -> int:
    """Most rows a band can have so that a pair at the threshold shares no band with probability ``miss`` at most."""
    fits = [r for r in range(1, 13) if places % r == 0 and (1 - (percent / 100) ** r) ** (places // r) <= miss]
    return max(fits)


def _slices(sets: list[np.ndarray], most: int = 40_000) -> Iterator[slice]:
    lo = size = 0
    for i, s in enumerate(sets):
        if size and size + len(s) > most:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(s)
    if lo < len(sets):
        yield slice(lo, len(sets))


def narrative_signatures(narratives: DataFrame, words: int, percent: int, places: int = 120) -> DataFrame:
    """``case_id, n_shingles, set_key, bands``: a 128-bit digest of the full set, and a hash per band of its signature."""
    rows = band_rows(percent, places)
    n_bands = places // rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(bytes(x.as_buffer())) for x in pc.fill_null(part.column(1), "").cast(pa.binary())]
                bands = np.zeros((len(sets), n_bands), np.uint64)
                for some in _slices(sets):
                    signature = super_minhash(sets[some], places).reshape(-1, n_bands, rows)
                    h = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(signature), 1))
                    for r in range(rows):
                        h = _mix(h * _STEP + signature[:, :, r])
                    bands[some] = h
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * n_bands, pa.int32()), pa.array(bands.view(np.int64).ravel()))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), lists],
                    names=["case_id", "n_shingles", "set_key", "bands"])

    kind = narratives.schema["case_id"].dataType.simpleString()
    return narratives.select("case_id", "narrative").mapInArrow(
        read, f"case_id {kind}, n_shingles long, set_key binary, bands array<long>")


def _sets(narratives: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``rep, shingles`` (sorted hashes as bytes) of the classes ``wanted(rep, least, set_key)``: read from a row with the class's
    smallest id, or without an id, whose text has the class's set."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            sets = [shingles(bytes(x.as_buffer())).tobytes() for x in pc.fill_null(batch.column(0), "").cast(pa.binary())]
            keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(keys, pa.binary())], names=["shingles", "set_key"])

    rows = narratives.join(wanted.select(F.col("least").alias("case_id")), "case_id", "left_semi").select("narrative")
    if not wanted.where("least is null").isEmpty():
        rows = rows.unionByName(narratives.where("case_id is null").select("narrative"))
    return rows.mapInArrow(read, "shingles binary, set_key binary").join(wanted.select("rep", "set_key"), "set_key").select(
        "rep", "shingles").dropDuplicates(["rep"])


CELLS = 1 << 18


def _token_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of each of ``CELLS`` hash cells occur in the sets: common shingles stand out."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(46)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    got = sets.select("shingles").mapInArrow(read, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[got["cell"]] = got["n"]
    return out


def _prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """``rep, n, lead, place, bucket`` for each shingle of the sets' prefixes.

    In one order of all shingles, common ones last, two linked sets share a shingle among the first
    n - ceil(n percent / 100) + 1 of each. ``place`` is its place in the set: of two sets that meet there first, no more
    can be common than what follows in both. ``lead`` is small for sets whose prefix is common: the middle of a group."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, n, lead, place, tokens = [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                often = counts[(own >> np.uint64(46)).astype(np.int64)]
                size = len(own) + (-percent * len(own) // 100) + 1
                first = np.lexsort((own, often))[:size]
                reps.append(np.full(size, i))
                n.append(np.full(size, len(own)))
                lead.append(np.full(size, -float(np.median(often[first]))))
                place.append(np.arange(size))
                tokens.append(own[first].view(np.int64))
            if reps:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(reps), pa.int64())), pa.array(np.concatenate(n), pa.int64()),
                     pa.array(np.concatenate(lead)), pa.array(np.concatenate(place), pa.int64()), pa.array(np.concatenate(tokens))],
                    names=["rep", "n", "lead", "place", "bucket"])

    kind = sets.schema["rep"].dataType.simpleString()
    return sets.select("rep", "shingles").mapInArrow(read, f"rep {kind}, n long, lead double, place long, bucket long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; both sides are joined plainly, so hot ids are split."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                ok.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b"))
    return both.select("a", "b", "sa", "sb").mapInArrow(read, f"a {kind}, b {kind}")


def _roots(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` with the current root of their representative."""
    return (members.drop("root").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("root", F.coalesce("root", "rep")))


def _grouped(sets: DataFrame, percent: int) -> DataFrame | None:
    """``node, root`` of all ``sets(rep, shingles)`` that are linked with another; None if there is no link."""
    every = materialise(_prefixes(sets, _token_counts(sets), percent), "prefixes")
    left = every.count()
    shared = materialise(few(every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), left), "shared")
    spot = (F.xxhash64(F.col("rep"), F.lit(7)).bitwiseAND((1 << 52) - 1)).cast("double") / float(1 << 52)
    members = materialise(few(every.join(shared, "bucket").withColumn("root", F.col("rep")), left), "members")
    links: DataFrame | None = None
    groups: DataFrame | None = None
    tried = 0
    while True:
        left = members.count()
        state = materialise(few(members.groupBy("bucket").agg(
            F.min(F.struct("lead", "rep")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
            .where("low < high").select("bucket", F.col("first.rep").alias("first")), left), "open")
        members = materialise(few(members.join(state, "bucket"), left), "members")
        left = members.count()
        if not left:
            return groups
        chosen = (F.col("rep") == F.col("first")) | (spot * F.col("size") < tried)
        centre = materialise(few(members.where(chosen).select("bucket", F.col("rep").alias("c"), F.col("n").alias("cn"), F.col("root").alias("cr"), F.col("place").alias("cp")), left), "centres")
        # of two centres the one with the larger id meets the other
        meets = (~chosen | (F.col("rep") > F.col("c"))) & (F.col("root") != F.col("cr"))
        # what a link needs in common, against what can be common from this shingle on; an earlier shared one has its own bucket
        fits = F.least(F.col("n") - F.col("place"), F.col("cn") - F.col("cp")) * (100 + percent) >= (F.col("n") + F.col("cn")) * percent
        pairs = materialise(few(members.join(centre, "bucket").where(fits & meets).select(
            F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct(), left * (tried + 1)), "pairs")
        members = members.where(~chosen).drop("first")
        compared = pairs.count()
        if compared:
            # few parts only where a task has few sets to compare
            found = materialise(few(_linked(pairs, sets, percent), 10 * compared), "links")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                groups = materialise(union_groups(links), "groups")
                links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
                members = _roots(members, groups)
        members = materialise(few(members, left), "members")
        tried = 2 * tried + 1


def near_duplicates(narratives: DataFrame, words: int = 5, percent: int = 80, places: int = 120) -> DataFrame:
    """Groups of ``narratives(case_id, narrative)`` linked by word shingles.

    Words are what ASCII white space leaves between it, A-Z lower-cased; a set holds the distinct shingles of
    ``words`` words, of a shorter narrative its whole sequence of words. Two narratives are linked when
    100 * intersection >= ``percent`` * union. Output, one row per input row: ``case_id, n_shingles, component_id,
    kept``; ``component_id`` is the smallest id reachable over links, and its row is kept. A null or blank narrative
    has an empty set, is linked with nothing and kept. Rows with equal sets, also repeated rows, are linked. A null
    id counts as the largest (if all of a group are null, its component is null and they are kept). Rows that share an id but not
    a set are linked by their sets only. No rows give no rows; other columns are not read.

    Equal sets become one node before banding, so copies cost nothing further. Bands are as long as a
    miss of 1e-6 at the threshold allows. Sets that share a band with another are candidates; whatever links two of them
    shows in the rare shingles they start with, which are the buckets compared. A bucket never lists all its pairs:
    in every round some of its members (the one nearest to the middle of a group, then 1, 3, 7, ... by chance) are compared with
    those that aren't grouped with them yet, links are confirmed on full sets, groups are united, and buckets that hold
    one group only leave. A bucket of n near copies costs about n comparisons; every pair in a bucket ends compared or
    grouped.
    """
    signed = materialise(narrative_signatures(narratives, words, percent, places), "signatures")
    # a class of equal sets is a node, whatever ids its rows have; numbers are given once, where the table is written
    rows = signed.count()
    classes = materialise(few(
        signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("case_id").alias("least"), F.first("bands").alias("bands"))
        , rows).withColumn("rep", F.monotonically_increasing_id()), "classes")
    every = classes.select("rep", F.explode("bands").alias("bucket"))
    crowded = materialise(few(every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket"), rows), "crowded")
    wanted = materialise(few(classes.select("rep", "least", "set_key").join(every.join(crowded, "bucket").select("rep").distinct(), "rep"), rows), "candidates")
    named = classes.select("set_key", "rep", "least")
    groups = None if wanted.isEmpty() else _grouped(materialise(_sets(narratives, wanted, words), "sets"), percent)
    if groups is None:
        named = named.select("set_key", F.col("least").alias("component_id"))
    else:
        linked = materialise(few(groups.join(named.select(F.col("rep").alias("node"), "least"), "node"), rows), "linked")
        lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
        found = linked.join(lowest, "root").select(F.col("node").alias("rep"), "lowest")
        named = named.join(found, "rep", "left").select("set_key", F.coalesce("lowest", "least").alias("component_id"))
    named = materialise(few(named, rows), "named")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("case_id"))
    return (signed.select("case_id", "n_shingles", "set_key").join(named, "set_key", "left").select("case_id", "n_shingles", own.alias("component_id"))
            .withColumn("kept", F.col("case_id").eqNullSafe(F.col("component_id"))))
