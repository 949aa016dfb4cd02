"""Vector expressions on array columns, and batched vectors for tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str, size: int) -> Column:
    """Whether a vector has ``size`` finite numbers that are not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null when one is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector and size of each group, by a mergeable aggregate: one partial state for each task and group."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    means = rows.groupBy(*keys).agg(F.count("*").alias("size"), Summarizer.mean(F.col("v")).alias("m"))
    return means.select(*keys, "size", vector_to_array("m").alias("centroid"))


def as_matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of equally long vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
