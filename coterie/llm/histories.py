"""Prefix trie of case histories: which courses of action cases share, in a node table behind a minimal perfect hash.

A prefix of a history is named by two 64-bit lanes: the exclusive or of hashes of its (position, step). Tasks
build a table of the distinct prefixes of their shard: a minimal perfect hash gives each a slot, the lanes kept in the slot
tell foreign prefixes, counts are scattered into flat arrays and summed up through the slots of the parents, deepest first.
What shards say about one prefix is added by Spark.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.sources.scratch import materialise

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# ---- positions -------------------------------------------------------------------------------------

def number_steps(steps: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``steps`` and the 1-based ``position`` of each within its ``case_id`` (a long), in the order of the columns ``order`` (nulls first).

    Rows are cut into ranges of (case_id, order), so a history of any length spreads over tasks; a case that crosses
    ranges is told by the last case of each range, one row a range. Rows that tie in all of ``order`` get any order; rows
    with a null case_id are left out; a column that is already called ``position`` is replaced.
    """
    # a row's place in its input part ends ties and lets equal rows spread over ranges
    sort = [f"_{i}" for i in range(len(order))]
    tied = steps.where("case_id is not null").select(
        F.struct(*[c for c in steps.columns if c != "position"]).alias("row"), "case_id",
        *[F.col(c).alias(s) for c, s in zip(order, sort, strict=True)], F.monotonically_increasing_id().alias("tie"))
    keys = ["case_id", *sort, "tie"]
    ranged = (tied.repartitionByRange(parts, *keys) if parts else tied.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ranged = ranged.select("row", "case_id", F.spark_partition_id().alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, first = 0, None, True  # rows of the case so far; its id; whether it is the first case of the range
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            run = np.diff(np.r_[starts, ids.size])
            local = np.arange(ids.size) - np.repeat(starts, run) + 1
            if here == ids[0]:
                local[:run[0]] += at
            elif here is not None:
                first = False
            in_first = np.zeros(ids.size, bool)
            if first:
                in_first[:run[0]] = True
            first = first and len(starts) == 1
            at, here = int(local[-1]), ids[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(in_first)], names=["row", "case_id", "part", "local", "first"])

    kind = ranged.schema["row"].dataType.simpleString()
    local = materialise(ranged.mapInArrow(count, f"row {kind}, case_id long, part int, local long, first boolean"), "steps")
    tails = local.groupBy("part").agg(F.max_by(F.struct("case_id", "local", "first"), F.struct("case_id", "local")).alias("last"))
    known, ahead = [], (None, 0)  # the last case before a range, and how many rows it has there
    for part, last in sorted(tails.collect()):  # one row a range
        known.append((part, *ahead))
        goes_on = last["first"] and last["case_id"] == ahead[0]
        ahead = (last["case_id"], last["local"] + (ahead[1] if goes_on else 0))
    before = F.broadcast(steps.sparkSession.createDataFrame(known, "part int, ahead long, before long"))  # one row a range
    goes_on = F.col("first") & (F.col("case_id") == F.col("ahead"))
    return local.join(before, "part").select("row.*", (F.col("local") + F.when(goes_on, F.col("before")).otherwise(0)).alias("position"))


# ---- the node table of a shard -----------------------------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class NodeTable:
    """Slots 0..n-1 of the distinct (a, b, depth) given, by a minimal perfect hash.

    Level by level, keys that are alone in their cell get it and the others go on to the next level; a key's slot is the
    number of taken cells before its own. The key is stored in the slot, so a foreign one is told from it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> None:
        order = np.lexsort((depth, b, a))
        a, b, depth = a[order], b[order], depth[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (depth[1:] != depth[:-1])][:a.size]
        a, b, depth = a[new], b[new], depth[new]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # taken cells, and the slots before each
        todo, slots, used = np.arange(a.size), np.empty(a.size, np.int64), 0
        while todo.size:
            cell = self._cell(a[todo], b[todo], depth[todo], len(self.levels), 2 * todo.size + 1)
            taken = np.bincount(cell, minlength=2 * todo.size + 1) == 1
            rank = used + np.cumsum(taken) - taken
            self.levels.append((taken, rank))
            alone = taken[cell]
            slots[todo[alone]] = rank[cell[alone]]
            used += int(taken.sum())
            todo = todo[~alone]
        self.a, self.b, self.depth = np.empty_like(a), np.empty_like(b), np.empty_like(depth)
        self.a[slots], self.b[slots], self.depth[slots] = a, b, depth

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, depth: np.ndarray, level: int, size: int) -> np.ndarray:
        h = _mix(a ^ _mix(b, 3 * level + 1) ^ _mix(depth.astype(np.uint64), 3 * level + 2), 3 * level)
        return (h % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return self.a.size

    def slots(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 for keys that aren't in the table."""
        out, todo = np.full(a.size, -1), np.arange(a.size)
        for level, (taken, rank) in enumerate(self.levels):
            cell = self._cell(a[todo], b[todo], depth[todo], level, taken.size)
            hit = taken[cell]
            at, slot = todo[hit], rank[cell[hit]]
            same = (self.a[slot] == a[at]) & (self.b[slot] == b[at]) & (self.depth[slot] == depth[at])
            out[at[same]] = slot[same]
            todo = todo[~hit]
        return out


NODE = ["a", "b", "depth"]


def _lanes(batch: pa.RecordBatch, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(a).to_numpy().view(np.uint64), batch.column(b).to_numpy().view(np.uint64)


def _shards(batches: Iterator[pa.RecordBatch], rows: int, together: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Batches put together to shards of about ``rows`` rows; neighbours that agree in ``together`` share one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            shard = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            stop = shard.num_rows
            if together:
                keys = [shard.column(c).to_numpy() for c in together]
                change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
                stop = int(change[-1]) + 1 if change.size else 0
            held = [shard.slice(stop)] if stop < shard.num_rows else []
            if stop:
                yield shard.slice(0, stop)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _first_in_slot(slot: np.ndarray, n: int) -> np.ndarray:
    at = np.full(n, slot.size)
    np.minimum.at(at, slot, np.arange(slot.size))
    return at


def _count_members(path: DataFrame, rows: int) -> DataFrame:
    """Per shard and prefix: members, smallest member, histories that end there, and what to verify."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches, rows):
            a, b = _lanes(batch, "a", "b")
            depth = batch.column("depth").to_numpy()
            table = NodeTable(a, b, depth)
            slot, n = table.slots(a, b, depth), len(table)
            case = batch.column("case_id").to_numpy()
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, slot, case)
            one = pa.array(_first_in_slot(slot, n))
            last = batch.column("last").to_numpy(zero_copy_only=False)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            told = batch.column("step_check").to_numpy()
            np.minimum.at(low, slot, told)
            np.maximum.at(high, slot, told)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table.a.view(np.int64)), pa.array(table.b.view(np.int64)), pa.array(table.depth),
                 batch.column("pa").take(one), batch.column("pb").take(one), batch.column("words").take(one),
                 pa.array(np.bincount(slot, minlength=n)), pa.array(least), pa.array(np.bincount(slot[last], minlength=n)), pa.array(low), pa.array(high)],
                names=["a", "b", "depth", "pa", "pb", "words", "n", "least", "ends", "low", "high"])

    return path.select(*NODE, "pa", "pb", "case_id", "words", "last", "step_check").mapInArrow(
        count, "a long, b long, depth long, pa long, pb long, words long, n long, least long, ends long, low long, high long")


def _sum_up(values: DataFrame, rows: int, segment: int) -> DataFrame:
    """Per shard and prefix: what its subtree is worth, of the values in the shard. Sums stop at segment borders."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches, rows, ("case_id", "segment")):
            a, b = _lanes(batch, "a", "b")
            up_a, up_b = _lanes(batch, "pa", "pb")
            depth = batch.column("depth").to_numpy()
            table = NodeTable(a, b, depth)
            slot, n = table.slots(a, b, depth), len(table)
            worth = {}
            for name in ("saved", "leaves"):
                worth[name] = np.zeros(n, np.int64)
                np.add.at(worth[name], slot, batch.column(name).to_numpy())
            one = _first_in_slot(slot, n)
            parent = table.slots(up_a[one], up_b[one], depth[one] - 1)
            parent[(table.depth - 1) % segment == 0] = -1  # what lies below a border comes as a value at the border
            deepest = np.argsort(-table.depth, kind="stable")
            for level in np.split(deepest, np.flatnonzero(np.diff(table.depth[deepest])) + 1):
                level = level[parent[level] >= 0]
                for w in worth.values():
                    np.add.at(w, parent[level], w[level])
            yield pa.RecordBatch.from_arrays(
                [pa.array(table.a.view(np.int64)), pa.array(table.b.view(np.int64)), pa.array(table.depth), pa.array(worth["saved"]), pa.array(worth["leaves"])],
                names=["a", "b", "depth", "saved", "leaves"])

    sorted_runs = values.repartition("case_id", "segment").sortWithinPartitions("case_id", "segment")
    return sorted_runs.select(*NODE, "pa", "pb", "saved", "leaves", "case_id", "segment").mapInArrow(add, "a long, b long, depth long, saved long, leaves long")


# ---- lists of the cases that end at a prefix -----------------------------------------------------------

def _end_digests(ends: DataFrame, piece: int = 4096) -> DataFrame:
    """SHA-256 of the comma-joined ids of the cases (``case_id``) of each (a, b, depth), ascending.

    Ids are joined to bounded pieces where ranges of (prefix, id) lie sorted; a prefix's digest then reads its pieces in order, one
    at a time."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in NODE]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            new |= np.arange(new.size) % piece == 0
            starts = np.flatnonzero(new)
            ids = batch.column("case_id").to_pylist()
            stops = [*starts[1:].tolist(), len(ids)]
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in [*NODE, "case_id"]],
                 pa.array([",".join(map(str, ids[s:e])) for s, e in zip(starts.tolist(), stops, strict=True)], pa.string())],
                names=[*NODE, "case_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if key != here:
                    if here is not None:
                        done.append((*here, state.hexdigest()))
                    here, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield rows(done)
                done = []
        if here is not None:
            done.append((*here, state.hexdigest()))
        yield rows(done)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    order = [*NODE, "case_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        join, "a long, b long, depth long, case_id long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(digest, "a long, b long, depth long, ends_sha256 string")


# ---- the trie --------------------------------------------------------------------------------------------

def step_digest(actor: Column, reason: Column) -> Column:
    """SHA-256 of a step; null is empty."""
    a, r = F.coalesce(actor, F.lit("")), F.coalesce(reason, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(a).cast("string"), F.lit(":"), a, r).cast("binary"), 256))


def step_words(reason: Column) -> Column:
    """Number of words between blanks (space and the five controls from tab on)."""
    return F.regexp_count(F.coalesce(reason, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def history_trie(steps: DataFrame, shard_rows: int = 200_000, segment: int = 4096) -> DataFrame:
    """Trie of case histories: which beginnings cases share, and what is saved by keeping a shared step once.

    ``steps(case_id, position, step, words)``: the step at each 1-based position of a case (positions without gaps, as
    ``number_steps`` gives them), ``step`` a digest as of ``step_digest``, ``words`` the words of the step's reason. ``case_id`` is a long. A
    case without any step has one row whose position is null or 0. Every distinct sequence of first steps of a case
    is a node, from the empty root on; a case is a member of the nodes of all its beginnings.

    Output, one row per node: ``case_id`` (smallest member), ``depth``, ``parent_case_id`` (the parent's; null for the root),
    ``n_cases`` (members), ``n_children``, ``n_leaves`` (nodes without children in the subtree, itself included), ``saved_tokens``
    (summed over the subtree: words of the last step times members but one), ``ends_sha256`` (SHA-256 of
    the comma-joined ids, ascending, of the members that end there; of nothing if none does). (case_id, depth) names a node.

    Rows with a null case_id are left out; no cases, no nodes. The rows given count as they are: a (case_id, position) may occur
    once. Other columns are not read. Prefixes are the same if 128 bits of hash agree; steps that then differ end the job
    (``verify``) instead of merging. Histories are worked on in segments of ``segment`` steps, shards are of bounded size, what many
    cases share is counted in its shard before it is shuffled.
    """
    given = steps.where("case_id is not null").select("case_id", F.coalesce("position", F.lit(0)).cast("long").alias("depth"), "step", "words")
    taken = materialise(
        given.where("depth > 0").select("case_id", "depth", F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.xxhash64("step").alias("step_check"),
                                        F.xxhash64("depth", "step").alias("ha"), F.xxhash64("step", "depth").alias("hb"),
                                        F.floor((F.col("depth") - 1) / segment).cast("long").alias("segment")), "taken")
    run = Window.partitionBy("case_id", "segment").orderBy("depth")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    whole = taken.groupBy("case_id", "segment").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    past = Window.partitionBy("case_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = (whole.withColumn("ca", F.bit_xor("xa").over(past)).withColumn("cb", F.bit_xor("xb").over(past))
             .where("segment > 0").select("case_id", "segment", "ca", "cb"))
    ends_at = F.max("depth").over(Window.partitionBy("case_id", "segment"))
    later = carry.select("case_id", (F.col("segment") - 1).alias("segment"), F.lit(True).alias("goes_on"))
    none = F.lit(0).cast("long")
    path = materialise(
        taken.withColumn("a", F.bit_xor("ha").over(upto)).withColumn("b", F.bit_xor("hb").over(upto)).withColumn("end", ends_at)
        .join(carry, ["case_id", "segment"], "left").join(later, ["case_id", "segment"], "left")
        .withColumn("a", F.col("a").bitwiseXOR(F.coalesce("ca", none))).withColumn("b", F.col("b").bitwiseXOR(F.coalesce("cb", none)))
        .select("case_id", "segment", *NODE, F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"),
                "words", "step_check", (F.col("goes_on").isNull() & (F.col("depth") == F.col("end"))).alias("last")), "paths")

    counted = _count_members(path, shard_rows).groupBy(*NODE).agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("words").alias("words"), F.sum("n").alias("n"),
        F.min("least").alias("least"), F.sum("ends").alias("ends"), F.min("low").alias("low"), F.max("high").alias("high"))
    nodes = materialise(counted.select(
        *NODE, "pa", "pb", "words", "n", "least", "ends",
        F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two prefixes share a digest")).cast("long")).alias("verify")), "nodes")

    # a node's value lies with its smallest member, whose own nodes are the end of its path
    own = nodes.select(F.col("least").alias("case_id"), *NODE, "pa", "pb", ((F.col("n") - 1) * F.col("words")).alias("saved"),
                       (F.col("n") == F.col("ends")).cast("long").alias("leaves"))
    since = own.groupBy("case_id").agg(F.min("depth").alias("since"))
    shared = path.join(since, "case_id").where("depth < since").select(
        "case_id", *NODE, "pa", "pb", none.alias("saved"), none.alias("leaves"))
    # below a segment's last step lies what later segments of the case hold
    totals = own.groupBy("case_id", F.floor((F.col("depth") - 1) / segment).cast("long").alias("segment")).agg(
        F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    following = Window.partitionBy("case_id").orderBy(F.col("segment").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = (totals.withColumn("s", F.sum("s").over(following)).withColumn("l", F.sum("l").over(following)).where("segment > 0")
             .select("case_id", (F.col("segment") - 1).alias("segment"), "s", "l"))
    # earlier segments without own nodes get what the first one with own nodes passes on
    first = below.groupBy("case_id").agg(F.min_by(F.struct("segment", "s", "l"), "segment").alias("f"))
    filled = below.unionByName(first.where("f.segment > 0").select(
        "case_id", F.explode(F.expr("sequence(0L, f.segment - 1)")).alias("segment"), F.col("f.s").alias("s"), F.col("f.l").alias("l")))
    borders = path.where(F.col("depth") % segment == 0).join(filled, ["case_id", "segment"]).select(
        "case_id", *NODE, "pa", "pb", F.col("s").alias("saved"), F.col("l").alias("leaves"))
    values = own.unionByName(shared).unionByName(borders).withColumn("segment", F.floor((F.col("depth") - 1) / segment).cast("long"))
    summed = _sum_up(values, shard_rows, segment).groupBy(*NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    children = nodes.where("depth > 1").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    ends = _end_digests(path.where("last"))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_case_id"))

    # the root: every case, also those without steps; four one-row sums put together
    empty = given.where("depth = 0").select("case_id")
    sums = [
        nodes.where("depth = 1").agg(F.min("least").alias("case_id"), F.count("*").alias("n_children")),
        own.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")),
        path.where("last").agg(F.count("*").alias("n_cases")),
        empty.agg(F.count("*").alias("n_cases"), F.min("case_id").alias("case_id")),
        _end_digests(empty.select(*[none.alias(c) for c in NODE], "case_id")).select("ends_sha256")]
    together = sums[0]
    for s in sums[1:]:
        together = together.unionByName(s, allowMissingColumns=True)
    root = materialise(together.agg(
        F.min("case_id").alias("case_id"), none.alias("depth"), F.lit(None).cast("long").alias("parent_case_id"), F.sum("n_cases").alias("n_cases"),
        F.max("n_children").alias("n_children"), F.greatest(F.coalesce(F.max("leaves"), none), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.max("saved"), none).alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    ).where("n_cases > 0"), "root")
    smallest = root.head()

    out = nodes.where("verify is null").join(summed, NODE).join(children, NODE, "left").join(ends, NODE, "left").join(
        above, ["pa", "pb", "depth"], "left")
    return out.select(
        F.col("least").alias("case_id"), "depth",
        F.coalesce("parent_case_id", F.lit(smallest["case_id"] if smallest else None).cast("long")).alias("parent_case_id"), F.col("n").alias("n_cases"),
        F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")).unionByName(root)
