"""Limit what each contributor supplies: rank by quality within the contributor, keep the ranks up to a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.functions.titles import with_work
from glyphdrift.operators.latest import latest_rows
from glyphdrift.session import materialise, small, written

INDEX_BITS = 33  # monotonically_increasing_id: partition number above, row number within the partition below


def ranked_within(df: DataFrame, keys: list[str], quality: str, ident: str) -> DataFrame:
    """Add ``rank`` (from 1) within ``keys``: highest quality first, null and NaN last, ties to the smaller ident.

    Salted pre-ranking. The salt is the slice of a range partitioning by (keys, quality, ident): it cuts a
    dominant key, or one with a single quality value, into slices of even size. Rows are ranked within their
    slice where they lie; the rank over the whole key is that plus the sizes of the key's earlier slices. Those
    offsets are one row for each key and slice it touches, at most slices + keys rows, and keys are restricted by
    the caller to the few that exceed their cap. Null keys form a key of their own, null idents come first.
    Columns named ``rank``, ``order_quality`` or ``row_index`` are replaced. Sorted slices are checkpointed, as
    two reads of a sampled range partitioning need not cut alike.
    """
    clean = F.when(F.isnan(quality), None).otherwise(F.col(quality))
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("order_quality").desc_nulls_last(), F.col(ident).asc_nulls_first()]
    slices = (
        df.withColumn("order_quality", clean)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("row_index", F.monotonically_increasing_id())
    )
    slices = materialise(slices)
    salted = slices.withColumn("slice", F.shiftright("row_index", INDEX_BITS))
    sizes = salted.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys], F.col("slice").alias("in_slice")).agg(
        F.count("*").alias("size"), F.min("row_index").alias("first_index")
    )
    before = W.partitionBy(*[f"key_{k}" for k in keys]).orderBy("in_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    same = F.col("slice") == F.col("in_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"key_{k}"))
    return (
        salted.join(offsets, same)
        .withColumn("rank", F.col("offset") + F.col("row_index") - F.col("first_index") + 1)
        .drop("order_quality", "row_index", "slice", "in_slice", "size", "first_index", "offset", *[f"key_{k}" for k in keys])
    )


def beyond_cap(
    df: DataFrame, keys: list[str], quality: str, ident: str, share: float | None = None, count: int | None = None
) -> DataFrame:
    """Rows to leave out when each contributor keeps at most ``count`` rows or floor(``share`` of all rows).

    With both limits the lower one holds. Sizes come from one aggregate with map-side combine; only contributors
    above the cap, fewer than 1 / share, are ranked at all. Nothing for an empty input. Quality null or NaN ranks last.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("contributor_rows"))
    limits = []
    if share is not None:
        limits.append(F.floor(F.lit(share) * F.sum("contributor_rows")))
    if count is not None:
        limits.append(F.lit(count))
    total = sizes.agg(F.least(*limits, F.lit(2**62)).alias("cap"))
    large = sizes.join(F.broadcast(total), F.col("contributor_rows") > F.col("cap")).select(
        *[F.col(k).alias(f"large_{k}") for k in keys], "cap"
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"large_{k}"))
    hot = df.join(small(large), same).drop(*[f"large_{k}" for k in keys])
    return ranked_within(hot, keys, quality, ident).where(F.col("rank") > F.col("cap"))


def records_with_work(occurrences: DataFrame, metadata: DataFrame, dim: DataFrame) -> DataFrame:
    """Latest record ids with their work and quality, written once as sizes, ranks and slices all read them."""
    last = latest_rows(occurrences, ["toptitle", "dynasty", "dynasty_category", "reference_id", "quality"])
    return written(with_work(last, metadata, dim, spread="occ_id").select("occ_id", "work_category", "work_title", "quality"))


def over_represented(occurrences: DataFrame, metadata: DataFrame, dim: DataFrame, share: float = 0.02) -> DataFrame:
    """Ids of the records to leave out when every work keeps at most floor(share * N) records (problem 1)."""
    records = records_with_work(occurrences, metadata, dim)
    return beyond_cap(records, ["work_category", "work_title"], "quality", "occ_id", share=share).select("occ_id")
