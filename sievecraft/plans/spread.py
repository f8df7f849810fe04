"""Partitions in proportion to the input, so that what one task holds doesn't grow with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partitions_for(rows: DataFrame, per: int, size: Column | None = None) -> int:
    """As many partitions as hold ``per`` each of the rows, or of their ``size``; the session's number at least. One number reaches the driver."""
    total = rows.agg(F.count(F.lit(1)) if size is None else F.sum(size)).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per))


def spread(rows: DataFrame, keys: list[str], per: int, size: Column | None = None) -> DataFrame:
    """The rows, those of equal keys together, in ``partitions_for`` partitions: groupings and windows over these keys deal them no more."""
    return rows.repartition(partitions_for(rows, per, size), *keys)
