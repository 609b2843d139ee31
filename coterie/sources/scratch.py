"""Intermediate tables in the shared folder the cluster names."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="coterie-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back: later uses neither recompute it nor
    lose it with an executor, and the lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_A_FILE = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most about ``rows`` rows, in no more parts than these need: a small table in as many files as
    there are shuffle partitions costs their least size on disk, and each later shuffle as many map outputs."""
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
