"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_record(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per non-null ``key``: repeated rows are one record.

    If rows under one key differ, which repeated rows never do, the greatest in column
    order is kept, so that the result does not depend on the order of arrival.
    """
    kept = df.filter(F.col(key).isNotNull()).select(key, F.struct(*columns).alias("_r"))
    return kept.groupBy(key).agg(F.max("_r").alias("_r")).select(key, "_r.*")
