"""DataFrame helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(left: DataFrame, *one_row: DataFrame) -> DataFrame:
    """``left`` with the columns of one-row frames, as scalar subqueries: more than one row is an error."""
    out = left
    for k, row in enumerate(one_row):
        cols = [c for c in row.columns]
        name = f"_row{k}"
        out = out.withColumn(name, row.select(F.struct(*cols).alias(name)).scalar())
        out = out.select(*[c for c in out.columns if c != name], *[F.col(name)[c].alias(c) for c in cols])
    return out
