"""The driver's tables seen as the transaction tables of this library."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transactions(table(spark, sf_dir, "events"))


def as_transactions(events: DataFrame) -> DataFrame:
    """``events`` as orders with labels and a deterministic score.

    Customers share devices in pairs, addresses in threes, payments in fives and IPs in eights,
    so the degree of a value does not grow with the table.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    u = F.col("user_id")

    def block(n: int):
        return F.floor(u / n).cast("bigint")

    abusive = (block(8) % 5 == 0) & (F.col("k") % 3 != 0)
    return (
        events.withColumn("k", k).select(
            F.col("event_id").alias("order_id"), u.alias("customer_id"),
            F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("amount"),
            F.col("event_type").alias("merchant_category"), (F.col("k") % 4 == 0).cast("int").alias("retry_count"),
            F.concat(F.lit("D"), block(2) * 3 + F.col("k") % 3).alias("device_id"),
            F.concat(F.lit("IP"), block(8) * 4 + F.col("k") % 4).alias("ip_id"),
            F.concat(F.lit("A"), block(3) * 2 + F.col("k") % 2).alias("address_id"),
            F.when(F.col("k") % 10 == 0, F.concat(F.lit("P"), block(5)))
            .otherwise(F.concat(F.lit("Q"), u * 2 + F.col("k") % 2)).alias("payment_id"),
            F.when(abusive, 1).otherwise(0).alias("is_abuse"),
            F.when(abusive, F.concat(F.lit("R"), block(8))).alias("ring_id"),
            F.when(block(8) % 4 == 0, "shared_device").when(block(8) % 4 == 1, "shared_address")
            .when(block(8) % 4 == 2, "behavioral").otherwise("mixed").alias("abuse_type"),
            F.when(abusive, F.col("value") * F.lit(0.5)).otherwise(F.lit(0.0)).alias("loss_amount"),
            (((F.col("event_id") * 7919) % 1009).cast("double") / F.lit(1009.0) * F.lit(0.6)
             + F.when(abusive, F.lit(0.35)).otherwise(F.lit(0.0))).alias("predicted_score"),
        )
    )


def tied_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as day-granular transactions: many orders share one instant."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("order_id"), (c % 200).alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("merchant_category"), F.lit(0).alias("retry_count"),
        F.concat(F.lit("D"), c % 97).alias("device_id"), F.concat(F.lit("IP"), k % 31).alias("ip_id"),
        F.concat(F.lit("A"), c % 61).alias("address_id"), F.concat(F.lit("P"), k % 113).alias("payment_id"),
    )
