"""Transaction checks, normalisation, explanations and feed rows."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions import beside, mask_tail, monitor_status
from coterie.operators.asof import timed
from coterie.schema import ENTITY_COLUMNS
from coterie.sources.scratch import materialise

# Messages of the checks, and names an explanation never shows (matched as substrings).
ERRORS = (
    "order_id must be a non-empty string", "customer_id must be a non-empty string",
    "amount must be a non-negative number", "event_time must be a valid ISO-8601 timestamp",
)
HIDDEN_NAMES = re.compile("id|customer|address|device|payment|ip", re.IGNORECASE)
LABEL_NAMES = ("is_abuse", "ring_id")


def validate_transactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``errors``)."""
    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c).cast("string") == "")

    amount = F.col("amount").try_cast("double")
    at = F.col("event_time").cast("string").try_cast("timestamp")
    checks = [blank("order_id"), blank("customer_id"), amount.isNull() | (amount < 0), at.isNull()]
    marked = df.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in zip(checks, ERRORS)])))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def normalise_transactions(df: DataFrame) -> DataFrame:
    """Typed rows with defaults; an offset in the time is turned into UTC by a session in UTC."""
    out = {
        "order_id": F.col("order_id").cast("string"), "customer_id": F.col("customer_id").cast("string"),
        "event_time": F.col("event_time").cast("string").try_cast("timestamp"), "amount": F.col("amount").try_cast("double"),
    }
    have = set(df.columns)

    def or_default(c: str, default: Column, dtype: str) -> Column:
        return F.coalesce(F.col(c).cast(dtype), default) if c in have else default

    out["currency"] = or_default("currency", F.lit("INR"), "string")
    for c in ENTITY_COLUMNS.values():
        out[c] = or_default(c, F.lit(""), "string")
    out["merchant_category"] = or_default("merchant_category", F.lit("general"), "string")
    out["retry_count"] = or_default("retry_count", F.lit(0.0), "double")
    return df.select(*[c.alias(k) for k, c in out.items()])


def explain_top_signals(features: DataFrame, k: int = 6, columns: list[str] | None = None) -> DataFrame:
    """(order_id, rank, feature, value): the k largest values by size, ties by name.

    The ranking is an array sort inside the row: no shuffle.
    """
    names = [c for c in (columns or features.columns) if c != "order_id" and c not in LABEL_NAMES and not HIDDEN_NAMES.search(c)]
    cells = F.array(*[F.struct((-F.abs(F.col(c).cast("double"))).alias("size"), F.lit(c).alias("feature"),
                               F.col(c).cast("double").alias("value")) for c in names])
    best = F.slice(F.array_sort(F.filter(cells, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]))), 1, k)
    return features.select("order_id", F.posexplode(best).alias("pos", "s")).select(
        "order_id", (F.col("pos") + 1).alias("rank"), F.col("s.feature").alias("feature"), F.col("s.value").alias("value"))


def feed_rows(scored: DataFrame) -> DataFrame:
    """Masked feed rows: status, what the order shares with earlier ones, and one observation."""
    rows = timed(scored)
    me = F.struct("t", "order_id")
    first = rows.agg(F.min(me).alias("_first"))
    out = rows
    labels = {"device": "device", "address": "address", "ip": "IP", "payment": "payment"}
    for e in labels:
        c = ENTITY_COLUMNS[e]
        # stored, so that the join is a plain one whose hot values adaptive execution splits; orders without a value are spread
        born = materialise(rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_key")).agg(F.min(me).alias(f"_born_{e}")), f"born-{e}")
        key = F.coalesce(F.col(c).cast("string"), F.concat(F.lit("\0"), F.xxhash64("order_id").cast("string")))
        out = out.withColumn("_key", key).join(born, "_key", "left").drop("_key")
    out = beside(out, first)
    shared = F.array_compact(F.array(*[F.when(F.col(f"_born_{e}") < me, F.lit(v)) for e, v in labels.items()]))
    out = out.withColumn("shared", shared)
    risk, fallback = F.col("calibrated_score"), F.coalesce(F.col("fallback_applied"), F.lit(False))
    note = (F.when(fallback, "Scored on the fallback path")
            .when(F.col("alert"), "Risk crossed review threshold")
            .when(F.col("_first") == me, "First event, limited history")
            .when(F.size("shared") >= 2, "Network connectivity increasing")
            .when(F.size("shared") == 1, F.concat(F.lit("Shared "), F.col("shared")[0], F.lit(" relationship observed")))
            .when(risk >= F.lit(0.30), "Elevated score, below review threshold").otherwise("Scored"))
    return out.select("order_id", F.date_format(F.col("event_time").cast("timestamp"), "HH:mm:ss").alias("time"),
                      mask_tail("customer_id").alias("customer"), F.col("amount").cast("double").alias("amount"), risk.alias("risk"),
                      monitor_status(risk, fallback).alias("status"), F.concat_ws(",", "shared").alias("shared"),
                      note.alias("observation"))
