"""Sources and sinks: tables, logs and result artefacts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from coterie.schema import SCORING_LOG, TABLE_SCHEMAS, TRANSACTION


def read_tables(spark: SparkSession, folder: str, fmt: str = "csv", names: list[str] | None = None) -> dict[str, DataFrame]:
    """The seven tables under ``folder`` with their declared schemas (gzip CSV or parquet)."""
    out = {}
    for name in names or list(TABLE_SCHEMAS):
        reader = spark.read.schema(TABLE_SCHEMAS[name])
        if fmt == "csv":
            out[name] = reader.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(f"{folder}/{name}.csv.gz")
        else:
            out[name] = reader.parquet(f"{folder}/{name}")
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv", metadata: dict | None = None) -> None:
    """Each table in its own folder, gzip CSV or parquet; metadata as one JSON row."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).option("compression", "gzip").option(
                "timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{folder}/{name}.csv.gz")
        else:
            w.parquet(f"{folder}/{name}")
    if metadata:
        spark = next(iter(tables.values())).sparkSession
        write_json(spark.createDataFrame([{k: str(v) for k, v in metadata.items()}]), f"{folder}/metadata.json")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jsonl_log(spark: SparkSession, path: str, schema: str = SCORING_LOG) -> DataFrame:
    """Log lines; blank and broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def audit_sink(df: DataFrame, path: str, checkpoint: str | None = None) -> DataStreamWriter | None:
    """Append one JSON line per scored order; for a stream, the writer to start."""
    if df.isStreaming:
        return df.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    df.write.mode("append").json(path)
    return None


def write_eval_artifacts(results: dict[str, dict[str, DataFrame]], folder: str, comparison: DataFrame | None = None) -> None:
    """Per-model tables stacked with a ``model`` column, one folder per table, partitioned by model."""
    names = {n for parts in results.values() for n in parts}
    for name in sorted(names):
        stacked = None
        for model, parts in results.items():
            if name in parts:
                df = parts[name].withColumn("model", F.lit(model))
                stacked = df if stacked is None else stacked.unionByName(df)
        stacked.write.mode("overwrite").partitionBy("model").parquet(f"{folder}/{name}")
    if comparison is not None:
        comparison.write.mode("overwrite").option("header", True).csv(f"{folder}/ring_summary")


def quality_artifacts(summary: DataFrame, ring_types: DataFrame, statistics: DataFrame, folder: str) -> None:
    summary.write.mode("overwrite").option("header", True).csv(f"{folder}/split_summary")
    ring_types.write.mode("overwrite").option("header", True).csv(f"{folder}/rings_by_type")
    write_json(statistics, f"{folder}/ring_statistics")


def read_transactions(spark: SparkSession, path: str, fmt: str = "json", per_trigger: int | None = None, **options) -> DataFrame:
    """Arriving transactions as a stream: a folder of files, or any streaming source by its name."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt in ("json", "csv", "parquet", "orc"):
        reader = reader.schema(TRANSACTION)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path) if path else reader.load()
