"""Keyed upsert: the row that counts for a key is the one delivered last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST = -(2**63)


def latest_rows(df: DataFrame, columns: list[str], key: str = "occ_id", order: str = "load_seq") -> DataFrame:
    """One row for each key with the columns of its row of highest ``order``.

    Rows that tie are taken as equal and the largest is kept. A null order counts as lowest, rows without a key
    are left out, an empty input gives an empty result. One shuffle, of the named columns only.
    """
    other = [c for c in columns if c != key]
    row = F.struct(F.coalesce(F.col(order), F.lit(LOWEST)).alias("seq"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(other)])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("row"))
    return best.select(key, *[F.col(f"row.v{i}").alias(c) for i, c in enumerate(other)])


def upsert_last_wins(df: DataFrame, key: Column | str, order: str, value: str) -> DataFrame:
    """Value of the highest order for each key; equal orders give the largest value."""
    named = df.select((F.col(key) if isinstance(key, str) else key).alias("key"), order, value)
    return named.groupBy("key").agg(F.max(F.struct(order, value)).alias("row")).select("key", f"row.{value}")
