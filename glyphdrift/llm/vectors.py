"""Compact codes of vector directions, and the latest usable vector of each record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE_SCALE = 32767.0


def usable_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list column: row numbers of the usable vectors (right length, all finite, not all zero) and the vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy()
    lengths = np.diff(starts)
    rows = np.flatnonzero((lengths == size) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = values[starts[rows][:, None] + np.arange(size)] if len(rows) else np.empty((0, size))
    with np.errstate(all="ignore"):
        good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    return rows[good], vectors[good]


def encode(vectors: np.ndarray) -> np.ndarray:
    """Directions as 16-bit codes; the cosine of two decoded codes is within about 1e-5 of the true one."""
    with np.errstate(all="ignore"):
        unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    return np.rint(unit / np.abs(unit).max(1, keepdims=True) * CODE_SCALE).astype("<i2")


def decode(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of a binary column of codes without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.empty((0, size), np.float32)
    codes = np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, size).astype(np.float32)
    return codes / np.linalg.norm(codes, axis=1, keepdims=True)


def _encoder(position: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = usable_rows(batch.column(position), size)
            out = np.full(batch.num_rows, None, object)
            for row, code in zip(rows.tolist(), encode(vectors)):
                out[row] = code.tobytes()
            rest = [batch.column(i) for i in range(batch.num_columns) if i != position]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary())], names=[f"c{i}" for i in range(len(rest) + 1)])

    return run


def coded(df: DataFrame, columns: list[str], vector: str, size: int) -> DataFrame:
    """The named columns and ``code``, null where the vector is unusable."""
    chosen = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(vector).alias("vector"))
    schema = ", ".join(f"c{i} {chosen.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(columns)))
    out = chosen.mapInArrow(_encoder(len(columns), size), f"{schema}, c{len(columns)} binary")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col(f"c{len(columns)}").alias("code"))


def latest_codes(df: DataFrame, columns: list[str], vector: str, size: int, key: str = "occ_id", order: str = "load_seq") -> DataFrame:
    """Key, the named columns and the code of each key's latest row, where that row's vector is usable.

    Vectors are coded before the shuffle, at half their size. Keys that are null are left out; a null order is lowest.
    """
    rows = coded(df.where(F.col(key).isNotNull()), [key, order, *columns], vector, size)
    row = F.struct(F.coalesce(F.col(order), F.lit(-(2**63))).alias("seq"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)], "code")
    best = rows.groupBy(key).agg(F.max(row).alias("row")).where(F.col("row.code").isNotNull())
    return best.select(key, *[F.col(f"row.v{i}").alias(c) for i, c in enumerate(columns)], F.col("row.code").alias("code"))


def sample_vectors(df: DataFrame, vector: str, size: int, key: str, rows: int, total: int) -> np.ndarray:
    """Unit vectors of about ``rows`` records chosen by a hash of their key; distinct ones only."""
    step = max(1, -(-total // rows))
    part = df.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0)
    codes = [bytes(r[0]) for r in coded(part, [key], vector, size).select("code").where("code IS NOT NULL").collect()]
    codes = sorted(set(codes))
    return decode(pa.array(codes, pa.binary()), size)
