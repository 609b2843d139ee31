"""Corpus pipeline: quality, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with all columns of its input, but for the last one,
which returns packed pieces. ``run`` writes each stage as Parquet into the shared folder and reads it again.

Rows are documents. ``doc_id`` is their key, but it may be null or repeated: what stays is decided for each row by its id and
text. Of rows that repeat an id with a text that is a copy, one stays; rows that share an id (or have none) with other
texts are other documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm import languages, near, packing, quality, recipes
from coterie.llm.queries import language_model, quality_model
from coterie.sources.scratch import materialise

MIN_QUALITY = 0.3
MIN_LANGUAGE = 0.3

# No stage is expressible in SQL as a whole: trained models, shingle links and packing; tests/llm compares with brute force.
ORACLE_SQL = None


def _narratives(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("case_id"), F.col("text").alias("narrative"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored at least ``MIN_QUALITY`` by the model of the labelled rows. A null text scores like an empty one."""
    model = quality_model(spark, sf_dir, docs)
    return docs.where(quality.quality_of(model, F.col("text")) >= MIN_QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a main language that the labels know; texts without letters go, and those without a language of
    at least ``MIN_LANGUAGE`` of their letters, where letters count that are of its scripts and read like its labelled rows.
    Foreign passages in a text are no reason to drop it."""
    said = languages.language_of(language_model(docs), F.col("text"))
    return docs.where(said["fit"] >= MIN_LANGUAGE)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    groups = materialise(recipes.exact_duplicates(_narratives(docs)), "exact-groups")
    stays = groups.where("kept").groupBy(F.col("case_id").alias("__id"), F.col("text_sha256").alias("__text")).agg(F.count("*").alias("n"))
    stays = materialise(stays, "exact-kept")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (recipes.text_digest(F.col("text")) == F.col("__text"))
    again = stays.where("n > 1").drop("n")
    if again.isEmpty():
        return docs.join(stays, same, "left_semi")
    # an id that stays is on several rows of its group: the row with most code points, as among other ids
    one = docs.join(again, same).groupBy("__id", "__text").agg(
        F.max_by(F.struct(*docs.columns), F.struct(F.coalesce(F.length("text"), F.lit(-1)), "text")).alias("row")).select("row.*")
    return docs.join(stays.where("n = 1"), same, "left_semi").unionByName(one)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more: the one with the smallest id, a null id being the
    largest. Of rows with one id and other texts, each is a node of its own."""
    unclear = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null"), "near-unclear")
    if unclear.isEmpty():
        groups = near.near_duplicates(_narratives(docs), words=5, percent=80)
        return docs.join(groups.where("kept").select(F.col("case_id").alias("__id")), F.col("doc_id") == F.col("__id"), "left_semi")
    # ids alone don't tell rows apart here: the text's digest is part of the key
    keyed = materialise(docs.select("*", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                                                  F.sha2(F.coalesce("text", F.lit("")), 256).alias("text")).alias("__key")), "near-keys")
    groups = near.near_duplicates(keyed.select(F.col("__key").alias("case_id"), F.col("text").alias("narrative")), words=5, percent=80)
    kept = groups.where("kept").select(F.to_json("case_id").alias("__kept"))
    return keyed.join(kept, F.to_json("__key") == F.col("__kept"), "left_semi").drop("__key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of at most 4096 tokens."""
    return packing.pack_narratives(_narratives(docs), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("case_id", "doc_id")


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
