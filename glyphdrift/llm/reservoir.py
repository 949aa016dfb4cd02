"""A uniform sample of fixed size from rows of unknown number: skip-based reservoirs, merged hypergeometrically."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphdrift.operators.latest import latest_rows

FAN = 64  # reservoirs merged at once
LEVELS = 6  # FAN ** LEVELS is more than any number of partitions


class Reservoir:
    """Algorithm L: after the first k rows only accepted rows are looked at; the skips between them are drawn."""

    def __init__(self, size: int, rng: np.random.Generator) -> None:
        self.size, self.rng, self.seen, self.rows, self.weight = size, rng, 0, [], 1.0
        self.next = size
        self._skip(first=True)

    def _skip(self, first: bool = False) -> None:
        self.weight *= math.exp(math.log(1.0 - self.rng.random()) / self.size)
        self.next += math.floor(math.log(1.0 - self.rng.random()) / math.log1p(-min(self.weight, 1 - 1e-16))) + (0 if first else 1)

    def add(self, batch: pa.RecordBatch) -> None:
        """Take what is due from a batch; the rest of it is only counted."""
        begin, end = self.seen, self.seen + batch.num_rows
        if begin < self.size:
            self.rows += batch.slice(0, self.size - begin).to_pylist()
        while self.next < end:
            self.rows[int(self.rng.integers(self.size))] = batch.slice(self.next - begin, 1).to_pylist()[0]
            self._skip()
        self.seen = end


def _fill(size: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept, schema = Reservoir(size, np.random.default_rng([seed, part])), None
        for batch in batches:
            schema = batch.schema
            kept.add(batch)
        if kept.rows:
            rows = pa.RecordBatch.from_pylist(kept.rows, schema)
            number = pa.array(np.full(len(kept.rows), part, np.int64))
            yield pa.RecordBatch.from_arrays([number, pa.array(np.full(len(kept.rows), kept.seen, np.int64)), *rows.columns], names=["part", "population", *schema.names])

    return run


def draw(populations: list[int], size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``size`` rows come from each population when rows are drawn without replacement: exact urn draws."""
    left = np.array(populations, np.int64)
    taken = np.zeros(len(left), np.int64)
    for _ in range(min(size, int(left.sum()))):
        urn = int(np.searchsorted(np.cumsum(left), rng.integers(left.sum()), side="right"))
        left[urn] -= 1
        taken[urn] += 1
    return taken


def _merge(size: int, seed: int, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        parts, population = rows["part"].to_numpy(), rows["population"].to_numpy()
        numbers, firsts = np.unique(parts, return_index=True)
        group = int(numbers[0]) // FAN
        rng = np.random.default_rng([seed, 1000 + level, group])
        whole = [int(population[f]) for f in firsts]
        chosen = [rng.choice(np.flatnonzero(parts == n), int(t), replace=False) for n, t in zip(numbers, draw(whole, size, rng)) if t]
        out = rows.take(pa.array(np.sort(np.concatenate(chosen))))
        out = out.set_column(out.schema.get_field_index("part"), "part", pa.array(np.full(out.num_rows, group, np.int64)))
        return out.set_column(out.schema.get_field_index("population"), "population", pa.array(np.full(out.num_rows, sum(whole), np.int64)))

    return run


def uniform_sample(df: DataFrame, columns: list[str], size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of ``df``, every set of that many rows equally likely, and ``population``, the number of all rows.

    The number of rows need not be known. Each partition keeps a reservoir and counts its rows, in one pass that
    looks only at accepted rows; reservoirs of up to ``FAN`` partitions are merged at a time, and how many rows each
    gives is drawn hypergeometrically from the populations they stand for. A task sees at most ``FAN`` reservoirs.
    Repeated rows count as often as they occur, null values are values, fewer rows than ``size`` are all kept, and
    an empty table gives no rows. The seed fixes the draw for a given partitioning. ``columns`` name what is kept.
    """
    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    schema = "part bigint, population bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    merged = rows.mapInArrow(_fill(size, seed), schema)
    for level in range(LEVELS):
        merged = merged.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_merge(size, seed, level), schema)
    return merged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "population")


def sampled_records(occurrences: DataFrame, size: int = 10_000, seed: int = 42) -> DataFrame:
    """``size`` latest records, all equally likely, whatever the pieces they arrived in (problem 4)."""
    return uniform_sample(latest_rows(occurrences, ["toptitle", "sentence"]), ["occ_id", "toptitle", "sentence"], size, seed)
