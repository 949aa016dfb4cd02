"""Figures per key when a few keys hold most rows: aggregate both inputs first, join compact states, roll up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphdrift.functions.titles import metadata_categories, period_categories, period_key, plain_title, urn_number
from glyphdrift.operators.latest import latest_rows

WORK_COLUMNS = ["toptitle", "dynasty", "dynasty_category", "reference_id"]


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: list[str], keys: list[str], sums: list[str], right_sums: list[str]) -> DataFrame:
    """Counts and sums of the inner join of two inputs, per ``keys``, without ever making the joined rows.

    Each side is aggregated by the join key (the left one also by ``keys``), so a key that holds a third of the
    rows becomes one state for each map task before any shuffle. In the join of the states counts multiply, a sum
    of one side is multiplied by the count of the other; the roll-up then adds the products.

    Result: keys, ``n_pairs``, and ``sum_x`` for each column x of ``sums`` and ``right_sums`` (null values are
    left out of sums; a sum without values is null). Null join keys match nothing. Columns of the right input
    that clash with the left one's are not read.
    """
    a = left.groupBy(*dict.fromkeys([*on, *keys])).agg(F.count("*").alias("left_n"), *[F.sum(c).alias(f"l_{c}") for c in sums])
    b = right.groupBy(*on).agg(F.count("*").alias("right_n"), *[F.sum(c).alias(f"r_{c}") for c in right_sums])
    both = a.join(b, on)
    return both.groupBy(*keys).agg(
        F.sum(F.col("left_n") * F.col("right_n")).alias("n_pairs"),
        *[F.sum(F.col(f"l_{c}") * F.col("right_n")).alias(f"sum_{c}") for c in sums],
        *[F.sum(F.col(f"r_{c}") * F.col("left_n")).alias(f"sum_{c}") for c in right_sums],
    )


def work_states(occurrences: DataFrame, metadata: DataFrame, dim: DataFrame) -> DataFrame:
    """Per work (category, plain title): ``n`` records, ``n_quality`` and ``sum_quality`` of the known qualities.

    Latest rows are aggregated by their raw values first (raw title, period, category, reference), on the map side,
    so each hot work is a few states of each task when titles are normalised and categories looked up, and the
    metadata join sees states instead of records. A last sum rolls the states up to works. Null and NaN qualities
    count as unknown. Title and category rules: ``functions.titles``; a category found nowhere is null.
    """
    last = latest_rows(occurrences, [*WORK_COLUMNS, "quality"])
    known = F.when(F.isnan("quality"), None).otherwise(F.col("quality"))
    raw = last.groupBy(*WORK_COLUMNS).agg(
        F.count("*").alias("n"), F.count(known).alias("n_quality"), F.sum(known).alias("sum_quality")
    )
    keyed = raw.join(
        F.broadcast(period_categories(dim)), period_key(F.col("dynasty")) == F.col("period_key"), "left"
    ).select(
        plain_title(F.col("toptitle")).alias("work_title"),
        F.coalesce(F.nullif(F.trim("dynasty_category"), F.lit("")), "dim_category").alias("own_category"),
        urn_number(F.col("reference_id")).alias("urn_number"),
        "n",
        "n_quality",
        "sum_quality",
    )
    state = keyed.groupBy("work_title", "own_category", F.when(F.col("own_category").isNull(), F.col("urn_number")).alias("urn_number")).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_quality", "sum_quality")]
    )
    return (
        state.join(metadata_categories(metadata, dim), "urn_number", "left")
        .groupBy(F.coalesce("own_category", "meta_category").alias("work_category"), "work_title")
        .agg(*[F.sum(c).alias(c) for c in ("n", "n_quality", "sum_quality")])
    )


def dominant_works(occurrences: DataFrame, metadata: DataFrame, dim: DataFrame, share: float = 0.02) -> DataFrame:
    """Works that hold at least ``share`` of all records, with their counts; at most 1 / share rows.

    The total comes from the same states by one small second aggregate. Nothing for an empty input.
    """
    works = work_states(occurrences, metadata, dim)
    total = works.agg(F.sum("n").alias("total"))
    return works.join(F.broadcast(total), F.col("n") >= F.lit(share) * F.col("total"))
