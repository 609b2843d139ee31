"""Scalar column functions, all built-in expressions (no UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that mean "no value".
NULL_TOKENS = ("", "nan", "none", "null", "<na>", "0", "0.0")
RAW_NULL_TOKENS = ("", "nan", "None")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_entity(c: Column | str) -> Column:
    """Trimmed identifier, null when it is one of the null-like tokens (any case)."""
    s = F.trim(_col(c).cast("string"), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(~F.lower(s).isin(*NULL_TOKENS), s)


def raw_entity(c: Column | str) -> Column:
    """Identifier as given; only the empty string, "nan" and "None" are missing."""
    s = _col(c).cast("string")
    return F.when(~s.isin(*RAW_NULL_TOKENS), s)


def mask_identifier(c: Column | str) -> Column:
    return F.concat(F.lit("id_"), F.substring(F.sha2(_col(c).cast("string"), 256), 1, 10))


def stable_id(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(_col(c).cast("string"), 256), 1, 16))


def mask_tail(c: Column | str) -> Column:
    """Feed display name: only the last two characters stay readable."""
    return F.concat(F.lit("Customer ••"), F.right(_col(c).cast("string"), F.lit(2)))


def risk_tier(score: Column | str) -> Column:
    s = _col(score)
    return (F.when(s >= F.lit(0.80), "CRITICAL_RISK").when(s >= F.lit(0.50), "HIGH_RISK")
            .when(s >= F.lit(0.30), "MEDIUM_RISK").otherwise("LOW_RISK"))


def case_severity(score, alerts, customers, modalities, burst=None) -> Column:
    """Severity of a case; ``alerts`` is accepted for the call shape and does not enter the rules."""
    s, c, m = _col(score), _col(customers), _col(modalities)
    b = F.lit(0) if burst is None else _col(burst)
    critical = (s >= F.lit(0.90)) | ((c >= 3) & (m >= 2) & (b >= 3))
    high = (s >= F.lit(0.75)) | ((s >= F.lit(0.50)) & ((c >= 2) | (m >= 2) | (b >= 3)))
    return (F.when(critical, "CRITICAL").when(high, "HIGH")
            .when(s >= F.lit(0.50), "MEDIUM").otherwise("LOW"))


def monitor_status(score: Column | str, fallback: Column | str) -> Column:
    s = _col(score)
    return (F.when(_col(fallback), "FALLBACK").when(s < F.lit(0.30), "NORMAL")
            .when(s < F.lit(0.50), "WATCHING").otherwise("ALERT"))


def drift_status(psi: Column | str) -> Column:
    p = _col(psi)
    return (F.when(p < F.lit(0.10), "Minimal Drift (PSI < 0.10)")
            .when(p <= F.lit(0.25), "Moderate Drift (0.10 <= PSI <= 0.25)")
            .otherwise("Significant Drift (PSI > 0.25)"))


def health_band(value: Column | str, green: float, critical: float, higher_is_worse: bool = True) -> Column:
    """green / warning / critical by two limits; null stays null."""
    v = _col(value)
    if higher_is_worse:
        return F.when(v < F.lit(green), "green").when(v <= F.lit(critical), "warning").when(v.isNotNull(), "critical")
    return F.when(v >= F.lit(green), "green").when(v >= F.lit(critical), "warning").when(v.isNotNull(), "critical")


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))
