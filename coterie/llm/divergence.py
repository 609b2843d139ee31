"""How differently the merchant categories of a language write: an audit of word shares by cube partitioning.

Word shares are whole billionths, so sums are exact in any order. Comparing all categories of a language over all its words is a
cube: category x category x word. A cell takes a block of each; the slices (category block, word block) are
copied to the cells that need them, a cell sums its part of each divergence over its words, and the parts are added along
the word axis.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.sources.scratch import materialise

BILLION = 1_000_000_000
#: Every byte but ASCII letters and parts of other characters ends a word; A-Z become a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _word_counts(narratives: DataFrame, most: int) -> DataFrame:
    """language, merchant_category, word, n, cases: counted inside each task, sent whenever a task holds about ``most`` bytes."""
    schema = pa.schema([("language", pa.string()), ("merchant_category", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("cases", pa.int64())])

    def rows(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (language, category), (n, cases) in counts.items():
            words = list(n)
            for at in range(0, len(words), 50_000):
                part = words[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(language), len(part)), pa.repeat(pa.scalar(category), len(part)),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array(map(n.__getitem__, part), pa.int64()),
                     pa.array(map(cases.__getitem__, part), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, *group in zip(part.column(0).cast(pa.binary()).to_pylist(), *(part.column(i).to_pylist() for i in (1, 2)), strict=True):
                    words = text.translate(WORDS).split()
                    n, cases = counts.setdefault(tuple(group), (Counter(), Counter()))
                    before = len(n)
                    n.update(words)
                    cases.update(set(words))
                    held += (len(n) - before) * 200 + len(text)
                    if held > most:
                        yield from rows(counts)
                        counts.clear()
                        held = 0
        yield from rows(counts)

    return narratives.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("narrative", "language", "merchant_category")]).mapInArrow(
        count, "language string, merchant_category string, word string, n long, cases long")


def _share(n: Column, of: Column) -> Column:
    """1 + floor(10^9 (n + 1) / of), beyond 64 bits on the way."""
    exact = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)"), of.cast("decimal(20,0)"))
    return F.lit(1) + exact


def _numpy_shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``_share`` in 64 bits, three digits at a time: exact while ``of`` is below 9 * 10^15."""
    rest, out = n + 1, np.zeros(np.broadcast_shapes(n.shape, of.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _cell(table: pa.Table) -> pa.Table:
    """Parts of all divergences between the two category blocks of a cell, over the words of its word block.

    Rows: category, word, n, of (the category's share denominator), first and second (whether the category is in the
    first or second block). Rows without a word name the categories. Words that no category of either block
    has are only counted by the caller: ``covered`` says how many were summed here."""
    names = table.column("merchant_category").combine_chunks().dictionary_encode()
    who, categories = names.indices.to_numpy(), names.dictionary.to_pylist()
    words = table.column("word").combine_chunks().dictionary_encode()
    has = pc.is_valid(words.indices).to_numpy(zero_copy_only=False)
    what = words.indices.fill_null(0).to_numpy()
    of = np.ones(len(categories), np.int64)
    of[who] = table.column("of").to_numpy()
    n = np.zeros((len(categories), len(words.dictionary)), np.int64)
    n[who[has], what[has]] = table.column("n").to_numpy()[has]
    share = _numpy_shares(n, of[:, None])
    side = {}
    for name in ("first", "second"):
        side[name] = np.unique(who[table.column(name).to_numpy(zero_copy_only=False)])
    a, b = side["first"], side["second"]
    same = a.size == b.size and bool((a == b).all())
    left, right, parts = [], [], []
    for mine, others in ((a, b),) if same else ((a, b), (b, a)):
        q = share[others]
        for g in mine:
            gap = share[g] - q
            left.append(np.full(others.size, g))
            right.append(others)
            parts.append((gap * gap // q).sum(axis=1))
    left, right, parts = np.concatenate(left), np.concatenate(right), np.concatenate(parts)
    keep = left != right
    language = table.column("language")[0]
    count = int(keep.sum())
    return pa.table({
        "language": pa.repeat(language, count), "merchant_category": names.dictionary.take(pa.array(left[keep])),
        "item": names.dictionary.take(pa.array(right[keep])), "part_value": pa.array(parts[keep], pa.int64()),
        "covered": pa.repeat(pa.scalar(share.shape[1], pa.int64()), count)})


def category_divergence(narratives: DataFrame, top: int = 200, least_cases: int = 3, block: int = 64, block_words: int = 8192,
                        most: int = 128 << 20) -> DataFrame:
    """How the words of each merchant category differ from those of the others of its language and of the language itself.

    ``narratives(case_id, narrative, language, merchant_category)``; null narratives, languages and categories count as ''. A word is
    a run of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the words of at least ``least_cases``
    narratives. The share of a kept word in a category, or in the language, is 1 + floor(10^9 (n + 1) / (N + V)): n its
    occurrences there, N those of all kept words, V the number of kept words. A share p differs from a share q by floor((p - q)^2 / q).

    Output ``language, merchant_category, part, item, value, rank``:

    * part ``pair``: item is each other category of the language, q its shares, value the sum over all kept words (0
      without kept words); all ranks.
    * part ``term``: item is a kept word that the category has, more than the language does (p > q, q the language's
      share), value its term; the first ``top``.

    Ranks start at 1 per category and part, by value descending, then item in UTF-8 order. Categories without words take part
    with n = 0. Repeated rows count each time; other columns are not read; no rows give no rows.

    Cells are bounded: ``block`` categories of each side by about ``block_words`` words. A category or word with a third of all rows is counted inside
    the tasks first and spreads over word blocks. Counts are sent when a task holds ``most`` bytes of them. Sums of
    one language must stay below 9 * 10^15 occurrences and below 2^63 in value.
    """
    place = ["language", "merchant_category"]
    counted = _word_counts(narratives, most).repartition("language", "word").groupBy("language", "word", "merchant_category").agg(
        F.sum("n").alias("n"), F.sum("cases").alias("cases"))
    word = Window.partitionBy("language", "word")
    kept = materialise(
        counted.withColumn("in_cases", F.sum("cases").over(word)).withColumn("in_language", F.sum("n").over(word))
        .withColumn("one", F.row_number().over(word.orderBy("merchant_category")) == 1)
        .where(F.col("in_cases") >= least_cases).drop("cases", "in_cases"), "kept-words")
    sizes = kept.groupBy(*place).agg(F.sum("n").alias("size"), F.count_if("one").alias("words"), F.count("*").alias("entries"))
    groups = narratives.select(*[F.coalesce(c, F.lit("")).alias(c) for c in place]).distinct().join(sizes, place, "left").na.fill(0)
    totals = groups.groupBy("language").agg(
        F.sum("size").alias("language_size"), F.sum("words").alias("v"), F.sum("entries").alias("entries"), F.count("*").alias("categories"))
    groups = materialise(
        groups.drop("words", "entries").join(totals, "language").select(
            *place, "v", (F.col("size") + F.col("v")).alias("of"), (F.col("language_size") + F.col("v")).alias("language_of"),
            F.ceil(F.col("categories") / block).cast("int").alias("blocks"),
            F.greatest(F.ceil(F.col("v") / block_words), F.lit(1)).cast("int").alias("word_blocks"))
        .withColumn("mine", F.pmod(F.xxhash64("merchant_category"), F.col("blocks")).cast("int")), "categories")
    known = kept.join(groups, place)

    p, q = _share(F.col("n"), F.col("of")), _share(F.col("in_language"), F.col("language_of"))
    by_rank = Window.partitionBy(*place).orderBy(F.col("value").desc(), "item")
    terms = (known.select(*place, F.col("word").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
             .select(*place, F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
             .withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top))

    entries = known.select(*place, "word", "n", "of", "mine", "blocks", F.pmod(F.xxhash64("word"), F.col("word_blocks")).cast("int").alias("word_block"))
    named = groups.select(*place, F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n"), "of", "mine", "blocks",
                          F.explode(F.expr("sequence(0, word_blocks - 1)")).alias("word_block"))
    cells = (entries.unionByName(named).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select(*place, "word", "n", "of", "word_block", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
                     (F.col("mine") <= F.col("other")).alias("first"), (F.col("mine") >= F.col("other")).alias("second")))
    parts = cells.groupBy("language", "a", "b", "word_block").applyInArrow(
        _cell, "language string, merchant_category string, item string, part_value long, covered long")
    summed = parts.groupBy(*place, "item").agg(F.sum("part_value").alias("value"), F.sum("covered").alias("covered"))
    # words that neither side has differ by the same amount each
    other = groups.select("language", F.col("merchant_category").alias("item"), F.col("of").alias("item_of"))
    zero = F.lit(0).cast("long")
    pairs = (summed.join(groups.select(*place, "v", "of"), place).join(other, ["language", "item"])
             .withColumn("p", F.when(F.col("v") > 0, _share(zero, F.col("of"))).otherwise(1))
             .withColumn("q", F.when(F.col("v") > 0, _share(zero, F.col("item_of"))).otherwise(1))
             .select(*place, F.lit("pair").alias("part"), "item",
                     (F.col("value") + (F.col("v") - F.col("covered")) * F.expr("(p - q) * (p - q) div q")).alias("value"))
             .withColumn("rank", F.row_number().over(by_rank)))
    return pairs.unionByName(terms)
