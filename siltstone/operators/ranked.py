"""Ranks within queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, k: int | None = None, *, by: str = "score", id_col: str = "doc_id") -> DataFrame:
    """``rank`` within each query by falling score, ties by id; the first ``k`` if given."""
    order = Window.partitionBy("query_id").orderBy(F.col(by).desc(), F.col(id_col))
    out = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if k is None else out.filter(F.col("rank") <= k)
