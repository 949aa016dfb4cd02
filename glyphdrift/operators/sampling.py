"""Exact deduplication, bounded strata and the figures that describe a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UNKNOWN = "unknown"


def source_title(title: Column) -> Column:
    """Missing source titles form one stratum."""
    return F.coalesce(title, F.lit(UNKNOWN))


def first_of_equal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each distinct key, the first in order. Rows lie in hash partitions of the whole key."""
    names = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    best = df.groupBy(*keys).agg(F.min(ordered).alias("row"))
    return best.select(*keys, *[F.col(f"row.v{i}").alias(c) for i, c in enumerate(names)])


def sampling_key(ident: str, seed: int = 42) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))


def capped_strata(df: DataFrame, keys: list[str], ident: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each stratum, uniformly chosen by the seeded key order.

    The rank filter lets Spark cut each map task's rows of a stratum to ``cap`` before the shuffle, so a stratum
    that holds most rows sends no more than cap rows for each task.
    """
    place = W.partitionBy(*keys).orderBy(sampling_key(ident, seed), ident)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap).drop("place")


def head_per_group(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """The first rows of each group."""
    place = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= count).drop("place")


def sample_ratios(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each stratum before and after sampling, and their ratio."""
    a = before.groupBy(*keys).agg(F.count("*").alias("original"))
    b = after.groupBy(*keys).agg(F.count("*").alias("sampled"))
    joined = a.join(b, keys, "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    return joined.withColumn("ratio", F.when(F.col("original") > 0, F.col("sampled") / F.col("original")).otherwise(0.0))


def diversity(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Sources, rows and Shannon entropy in bits of the source distribution of each group.

    Entropy is log2 N - sum(n log2 n) / N, two mergeable sums over the counts per source; no group is collected.
    """
    counts = df.groupBy(*keys, source).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*keys).agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(*keys, "n_sources", "n_rows", (F.log2("n_rows") - F.col("s") / F.col("n_rows")).alias("entropy"))


def top_sources(df: DataFrame, keys: list[str], source: str, count: int = 10) -> DataFrame:
    """The largest sources of each group with their share in percent; ties to the smaller name."""
    counts = df.groupBy(*keys, source).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(*keys))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), source))
    return counts.withColumn("percentage", share).withColumn("place", place).where(F.col("place") <= count)
