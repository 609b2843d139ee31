"""Exact duplicates of case narratives, found by content-defined chunk recipes.

A narrative loses its white space, is cut where a rolling hash of its bytes says so, and becomes the ordered
list of its chunk identifiers: its recipe. Chunks travel once to have their identifiers verified against
their bytes; narratives are compared by recipe, so long ones never move again.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.sources.scratch import materialise

SPACE = b" \t\n\v\f\r"
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes, least: int = 512, mask: int = 0x7FF, most: int = 8192) -> list[int]:
    """Ends of the chunks of ``data``: where the gear hash of the last 32 bytes has zeros under ``mask``,
    not before ``least`` bytes and at ``most`` at the latest. Empty data has no chunk."""
    if len(data) <= least:
        return [len(data)] if data else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after this step h covers 2 k bytes
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    marks = np.flatnonzero((h >> np.uint32(8)) & np.uint32(mask) == 0) + 1
    ends, at, n = [], 0, len(data)
    while at < n:
        i = int(np.searchsorted(marks, at + least))
        end = int(marks[i]) if i < len(marks) else n
        end = min(end, at + most, n)
        ends.append(end)
        at = end
    return ends


def _chunks(text: bytes) -> Iterator[bytes]:
    at = 0
    for end in cut_points(text):
        yield text[at:end]
        at = end


def _key(chunk: bytes, key_bytes: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=key_bytes).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in pc.fill_null(column, "").cast(pa.binary()):
        yield bytes(x.as_buffer()).translate(None, SPACE)


def text_digest(narrative: Column) -> Column:
    """``text_sha256`` of ``exact_duplicates``, of a text column."""
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([hashlib.sha256(text).hexdigest() for text in _texts(batch)], pa.string())

    digest.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(digest, "string")(narrative)


def narrative_recipes(narratives: DataFrame, key_bytes: int = 16) -> DataFrame:
    """``case_id, n_points, text_sha256, recipe`` of ``narratives(case_id, narrative)``: code points of the
    original text, SHA-256 of the text without white space, and its chunk identifiers in order."""
    schema = pa.schema([("n_points", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.list_(pa.binary()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sha, recipe = [], []
            for text in _texts(column):
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append([_key(c, key_bytes) for c in _chunks(text)])
            points = pc.fill_null(pc.utf8_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), points, pa.array(sha, pa.string()), pa.array(recipe, schema.field(2).type)],
                names=["case_id", *schema.names])

    kind = narratives.schema["case_id"].dataType.simpleString()
    return narratives.select("case_id", "narrative").mapInArrow(
        read, f"case_id {kind}, n_points long, text_sha256 string, recipe array<binary>")


def _chunk_rows(narratives: DataFrame, key_bytes: int, remembered: int) -> DataFrame:
    """(key, chunk), each once for as long as its task remembers it (up to ``remembered`` bytes of chunks)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = 0
        for batch in batches:
            chunks, size = [], 0
            for text in _texts(batch.column(0)):
                for c in _chunks(text):
                    if c in seen:
                        continue
                    if held > remembered:
                        seen.clear()
                        held = 0
                    seen.add(c)
                    held += len(c)
                    chunks.append(c)
                    size += len(c)
                    if size > 1 << 21:
                        yield rows(chunks)
                        chunks, size = [], 0
            yield rows(chunks)

    def rows(chunks: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([_key(c, key_bytes) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())], names=["key", "chunk"])

    return narratives.select("narrative").mapInArrow(read, "key binary, chunk binary")


def colliding_chunks(narratives: DataFrame, key_bytes: int = 16, remembered: int = 1 << 24) -> DataFrame:
    """``key, chunk, variant`` of identifiers that stand for several different chunks (normally none).

    Each chunk is sent once per task that holds it and compared byte by byte with all of its identifier."""
    rows = _chunk_rows(narratives, key_bytes, remembered)
    clash = materialise(
        rows.groupBy("key").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("key"), "chunk-clash")
    if clash.isEmpty():
        return clash.select("key", F.lit(b"").alias("chunk"), F.lit(0).alias("variant"))
    bodies = rows.join(clash, "key", "left_semi").distinct()
    ranked = bodies.groupBy("key").agg(F.sort_array(F.collect_set("chunk")).alias("all"))
    return materialise(ranked.select("key", F.posexplode("all").alias("variant", "chunk")).select("key", "chunk", "variant"), "chunk-variants")


def _verified(recipes: DataFrame, narratives: DataFrame, clash: DataFrame, key_bytes: int) -> DataFrame:
    """Recipes with a list of variants for colliding identifiers, by position."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                sha = hashlib.sha256(text).hexdigest()
                out += [{"case_id": k, "text_sha256": sha, "pos": i, "key": _key(c, key_bytes), "chunk": c}
                        for i, c in enumerate(_chunks(text))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                batch.schema.field(0), ("text_sha256", pa.string()), ("pos", pa.int32()), ("key", pa.binary()), ("chunk", pa.binary())]))

    kind = narratives.schema["case_id"].dataType.simpleString()
    at = narratives.select("case_id", "narrative").mapInArrow(
        read, f"case_id {kind}, text_sha256 string, pos int, key binary, chunk binary")
    told = (at.join(clash, ["key", "chunk"]).select("case_id", "text_sha256", F.struct("pos", "variant").alias("v")).distinct()
            .groupBy("case_id", "text_sha256").agg(F.sort_array(F.collect_list("v")).alias("told")))
    same = (recipes.case_id.eqNullSafe(told.case_id)) & (recipes.text_sha256 == told.text_sha256)
    return recipes.join(told, same, "left").select(
        recipes.case_id, "n_points", recipes.text_sha256, "recipe", F.coalesce("told", F.array().cast("array<struct<pos:int,variant:int>>")).alias("variants"))


def exact_duplicates(narratives: DataFrame, key_bytes: int = 16) -> DataFrame:
    """Groups of ``narratives(case_id, narrative)`` that are equal after deleting white space.

    Output, one row per input row: ``case_id, keep_id, group_size, kept, text_sha256``. Of equal narratives
    the one with the most code points in its original text stays, then the smallest ``case_id`` (a null id
    comes last). A null narrative is an empty one; all empty ones are equal. If rows repeat the id that stays,
    each of them is kept. Other columns are not read; no rows give no rows.

    Chunks are combined inside each task and sent once for verification; the comparison moves identifiers
    only. The largest group is combined before it is shuffled, and joined back as a plain join of two stored
    tables, which adaptive execution splits. ``key_bytes`` is the identifier's size; a short one is
    still exact because colliding identifiers get variants.
    """
    recipes = narrative_recipes(narratives, key_bytes)
    clash = colliding_chunks(narratives, key_bytes)
    if clash.isEmpty():
        recipes = recipes.withColumn("variants", F.array().cast("array<struct<pos:int,variant:int>>"))
    else:
        recipes = _verified(recipes, narratives, clash, key_bytes)
    recipes = materialise(recipes, "recipes")
    order = F.struct((-F.col("n_points")).alias("n"), F.col("case_id").isNull().alias("none"), "case_id")
    groups = materialise(
        recipes.groupBy("recipe", "variants").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        .select("recipe", "variants", F.col("first.case_id").alias("keep_id"), "group_size"), "recipe-groups")
    return recipes.join(groups, ["recipe", "variants"]).select(
        "case_id", "keep_id", "group_size", F.col("case_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
