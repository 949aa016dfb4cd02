"""Many clusterings of the same rows at once: vectors are held once, in blocks, and every pass over them serves all clusterings.

A clustering is its centroids, so labels are taken again from the vectors wherever they are needed and never stored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphdrift.functions.vectors import as_matrix
from glyphdrift.operators import cluster
from glyphdrift.operators.cluster import Key, _grouped, lloyd, nearest_scores
from glyphdrift.session import ensure_checkpoint_dir, materialise, written

BLOCK_ROWS, HELD_ROWS = 4_096, 65_536  # rows of a block, and rows that a task holds while it forms blocks
DRAWS = 1_000_000  # steps of the hash by which rows are drawn for the starts
SAFE = 1e15  # vectors beyond it are taken in double precision, as their squares overflow
Config = tuple[int, float, float]
Batches = Iterator[pa.RecordBatch]


PLACE = ("file", "start", "n", "is_wide")  # of the vectors of a block


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    path = re.sub(r"^file:/*", "/", folder)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(folder)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """The usable ones of ``rows`` (grp, id, vec), as ``is_usable`` has it, as blocks of one group.

    A block has its ids, the draw and the first digits of the md5 of each id, and the place of its vectors, which are written
    to files in the shared folder: rounds read those alone, without a copy where the folder is a local one.
    """
    system, folder = _files(f"{ensure_checkpoint_dir(rows.sparkSession)}/blocks-{uuid.uuid4().hex}")
    system.create_dir(folder)

    def usable(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        at = batch.schema.get_field_index("vec")
        batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(at)), size), False))
        vectors = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, size)  # a missing number is NaN
        keep = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
        return batch.filter(pa.array(keep)).select(["grp", "id", "draw", "pick"]), vectors[keep]

    def blocks(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> Batches:
        part, vectors = pa.Table.from_batches([b for b, _ in held]).combine_chunks(), np.concatenate([v for _, v in held])
        if not len(vectors):
            return
        keys, every = part["grp"].combine_chunks().dictionary_encode(), part["id"].combine_chunks()
        codes = keys.indices.to_numpy(zero_copy_only=False)
        draws, picks = part["draw"].to_numpy().astype("<i4"), part["pick"].to_numpy().astype("<i8")
        path, start = f"{folder}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(path) as out:
            for i, key in enumerate(keys.dictionary.to_pylist()):
                own = np.flatnonzero(codes == i)
                for lo in range(0, len(own), BLOCK_ROWS):
                    at = own[lo : lo + BLOCK_ROWS]
                    points = vectors[at]
                    out.write(points.tobytes())
                    ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), every.take(pa.array(at)))
                    body = [pa.array([x[at].tobytes()], pa.binary()) for x in (draws, picks)]
                    place = [pa.array([path]), pa.array([start], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([bool(np.abs(points).max() >= SAFE)])]
                    yield pa.RecordBatch.from_arrays([pa.array([key]), *place, ids, *body], names=["grp", *PLACE, "ids", "draws", "picks"])
                    start += points.nbytes

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            held.append(usable(batch))
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    kind = rows.schema["id"].dataType.simpleString()
    draw = F.pmod(F.xxhash64("id"), F.lit(DRAWS)).cast("int").alias("draw")
    pick = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint").alias("pick")
    return rows.select("grp", "id", F.col("vec").cast("array<float>").alias("vec"), draw, pick).mapInArrow(run, f"grp string, file string, start bigint, n int, is_wide boolean, ids array<{kind}>, draws binary, picks binary")


def _reader(size: int) -> Callable[[Iterable[tuple]], Iterator[tuple[Key, np.ndarray]]]:
    """Group and vectors of each block of which the group and the place are given; a file is opened once in a task."""
    held: dict[str, tuple] = {}

    def read(places: Iterable[tuple]) -> Iterator[tuple[Key, np.ndarray]]:
        for grp, file, start, many, is_wide in places:
            if file not in held:
                system, path = _files(file)
                held[file] = (None, pa.memory_map(path).read_buffer()) if isinstance(system, fs.LocalFileSystem) else (system.open_input_file(path), None)
            remote, whole = held[file]
            points = np.frombuffer(remote.read_at(many * size * 4, start), "<f4") if remote else np.frombuffer(whole, "<f4", many * size, start)
            points = points.reshape(many, size)
            yield grp, points.astype(np.float64) if is_wide else points

    return read


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _places(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(_column(batch, c).to_pylist() for c in ("grp", *PLACE))))


@dataclass
class Fit:
    """k-means of one group's rows, or of those in some first clusters of it, which are projected then."""

    grp: Key
    base: int  # number of first clusters that the group's rows were given, or are given here
    parts: int
    members: tuple[int, ...] = ()
    rows: int = 0
    space: np.ndarray | None = None
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    still: float = 0.0

    @property
    def key(self) -> str:
        return f"{self.base}|{'.'.join(map(str, self.members))}|{self.parts}|{self.grp}"

    @property
    def first(self) -> str:
        """Key of the over-clustering whose first clusters the members are."""
        return replace(self, members=(), parts=self.base).key

    def bare(self) -> Fit:
        """Without what only the driver needs."""
        return replace(self, space=None, centres=None)

    def plane(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and offsets so that offset - 2 * weights @ vector is the squared distance but for a term of the vector alone."""
        square = (self.centres**2).sum(1)
        if self.space is None:
            return self.centres, square
        weights = self.centres @ self.space[1:]
        return weights, square + 2 * weights @ self.space[0]

    def reduced(self, points: np.ndarray) -> np.ndarray:
        return points if self.space is None else (points - self.space[0].astype(points.dtype)) @ self.space[1:].T.astype(points.dtype)


class Labeller:
    """The nearest centroid of vectors under each of several fits."""

    def __init__(self, fits: Iterable[Fit]):
        self.planes = {f.key: tuple(x.astype(np.float32) if np.abs(x).max(initial=0) < SAFE else x for x in f.plane()) for f in fits}

    def own(self, key: str, points: np.ndarray) -> np.ndarray:
        """For each centroid whether it is the nearest of each vector."""
        weights, offset = self.planes[key]
        return nearest_scores(offset[:, None] - (2 * weights) @ points.T)

    def labels(self, key: str, points: np.ndarray) -> np.ndarray:
        return self.own(key, points).argmax(0)


def _held(labels: np.ndarray, fit: Fit) -> np.ndarray:
    """Whether each row is in the first clusters that are clustered again."""
    inside = np.zeros(fit.base, bool)
    inside[list(fit.members)] = True
    return inside[labels]


def _by_group(fits: Iterable[Fit]) -> dict[Key, list[Fit]]:
    found = defaultdict(list)
    for f in fits:
        found[f.grp].append(f)
    return dict(found)


def _selections(fits: list[Fit], first: Labeller, points: np.ndarray) -> Iterator[tuple[Fit, np.ndarray | None]]:
    """Each fit of a group with the places of its rows in a block, None for all."""
    labels: dict[str, np.ndarray] = {}
    for f in fits:
        if not f.members:
            yield f, None
            continue
        if f.first not in labels:
            labels[f.first] = first.labels(f.first, points)
        yield f, np.flatnonzero(_held(labels[f.first], f))


def _firsts(fits: list[Fit], over: dict[tuple[Key, int], Fit]) -> Labeller:
    """Labels of the over-clusterings that the fits' rows are told by."""
    return Labeller({f.first: over[f.grp, f.base] for f in fits if f.members}.values())


def _passed(blocks: DataFrame, places: list[tuple], fits: list[Fit], over: dict[tuple[Key, int], Fit], measure: Callable[[Fit, np.ndarray], np.ndarray], size: int) -> dict[str, np.ndarray]:
    """``measure`` of the rows of every fit, summed over all blocks, in one pass over those of the fits' groups.

    ``places`` are sorted by group and dealt to the tasks in runs, so a task has few groups and the driver gets little more than a state for each fit.
    """
    groups, first = _by_group(f.bare() for f in fits), _firsts(fits, over)
    mine = [p for p in places if p[0] in groups]
    if not mine:
        return {}
    spark = blocks.sparkSession
    upto = np.cumsum([p[3] for p in mine])
    tasks = min(len(mine), 2 * spark.sparkContext.defaultParallelism)
    bounds = np.searchsorted(upto, np.linspace(0, upto[-1], tasks + 1)[1:-1], "right").tolist()
    dealt = [mine[a:b] for a, b in zip([0, *bounds], [*bounds, len(mine)])]

    def partial(batches: Batches) -> Batches:
        sums: dict[str, np.ndarray] = {}
        read = _reader(size)
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for key, points in read(dealt[task]):
                    for f, at in _selections(groups[key], first, points):
                        part = measure(f, points if at is None else points[at]).astype(np.float64)
                        if f.key in sums:
                            sums[f.key] += part
                        else:
                            sums[f.key] = part
        for key, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([value.tobytes()], pa.binary())], names=["key", "sums"])

    total: dict[str, np.ndarray] = {}
    for key, part in spark.range(0, tasks, 1, tasks).mapInArrow(partial, "key string, sums binary").collect():
        value = np.frombuffer(bytes(part), "<f8")
        total[key] = total[key] + value if key in total else value
    return total


def _sums(fits: list[Fit]) -> Callable[[Fit, np.ndarray], np.ndarray]:
    """Number and sum of the vectors nearest to each centroid."""
    now = Labeller(fits)

    def run(fit: Fit, points: np.ndarray) -> np.ndarray:
        own = now.own(fit.key, points)
        return np.column_stack([np.count_nonzero(own, 1), own.astype(points.dtype) @ points]).ravel()

    return run


def _started(blocks: DataFrame, fits: list[Fit], over: dict[tuple[Key, int], Fit], size: int, seed: int) -> None:
    """Centroids of every fit on about ``START_ROWS`` of its rows: the best of several starts, settled on them.

    Fits of a group that are dealt to one task share the rows drawn for them.
    """
    groups = _by_group(fits)
    hands = max(1, -(-2 * blocks.sparkSession.sparkContext.defaultParallelism // max(1, len(groups))))
    tasks = {f"{n}|{grp}": own[n::hands] for grp, own in groups.items() for n in range(min(hands, len(own)))}
    place = {key: n for n, key in enumerate(tasks)}
    first = _firsts(fits, over)
    limit = {f.key: DRAWS * cluster.START_ROWS / f.rows if f.rows > cluster.START_ROWS else DRAWS for f in fits}
    of_group = defaultdict(list)
    for key in tasks:
        of_group[key.split("|", 1)[1]].append(key)

    def drawn(batches: Batches) -> Batches:
        read = _reader(size)
        for batch in batches:
            ids, draws = _column(batch, "ids"), _column(batch, "draws")
            for n, (grp, points) in enumerate(read(_places(batch))):
                draw = np.frombuffer(draws[n].as_buffer(), "<i4")
                chosen = {f.key: at for f, at in _selections(groups[grp], first, points)}
                for key in of_group[grp]:
                    wanted = np.zeros(len(points), bool)
                    for f in tasks[key]:
                        at = chosen[f.key]
                        wanted[slice(None) if at is None else at] |= (draw if at is None else draw[at]) < limit[f.key]
                    at = np.flatnonzero(wanted)
                    if len(at):
                        some = ids[n].values.take(pa.array(at))
                        body = [pa.array([x.tobytes()], pa.binary()) for x in (draw[at], points[at].astype("<f4"))]
                        yield pa.RecordBatch.from_arrays([pa.array([place[key]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), some), *body], names=["task", "ids", "draws", "vecs"])

    names = list(tasks)

    def begin(batches: Batches) -> Batches:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        ids = np.concatenate([np.asarray(x.values.to_numpy(zero_copy_only=False)).astype(str) for chunk in rows["ids"].chunks for x in chunk])
        order = np.argsort(ids, kind="stable")
        draw = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for chunk in rows["draws"].chunks for x in chunk])[order]
        points = np.concatenate([np.frombuffer(x.as_buffer(), "<f4").reshape(-1, size) for chunk in rows["vecs"].chunks for x in chunk])[order]
        points = points if np.abs(points).max() < SAFE else points.astype(np.float64)
        own = tasks[names[rows["task"][0].as_py()]]
        for f, at in _selections(own, first, points):
            at = np.flatnonzero(draw < limit[f.key]) if at is None else at[draw[at] < limit[f.key]]
            some = f.reduced(points[at])
            body = np.concatenate([[some.var(0, dtype=np.float64).mean()], lloyd(some, f.parts, seed).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([f.key]), pa.array([body.astype("<f8").tobytes()], pa.binary())], names=["key", "body"])

    if not fits:
        return
    kind = blocks.schema["ids"].dataType.simpleString()
    some = blocks.where(F.col("grp").isin(list(groups))).select("grp", *PLACE, "ids", "draws").mapInArrow(drawn, f"task int, ids {kind}, draws binary, vecs binary")
    named = {f.key: f for f in fits}
    for key, body in some.repartitionById(len(tasks), F.col("task")).mapInArrow(begin, "key string, body binary").collect():
        values = np.frombuffer(bytes(body), "<f8")
        f = named[key]
        f.still, f.centres = cluster.TOLERANCE * values[0], values[1:].reshape(-1, size if f.space is None else len(f.space) - 1)


def fitted(blocks: DataFrame, places: list[tuple], fits: list[Fit], over: dict[tuple[Key, int], Fit], size: int, seed: int = 42) -> None:
    """k-means of every fit, all in the same passes: starts on drawn rows, then rounds over all rows until the centroids stand still, as in ``cluster.grouped_kmeans``."""
    _started(blocks, fits, over, size, seed)
    moving = [f for f in fits if f.rows > cluster.START_ROWS]
    for _ in range(cluster.ROUNDS):
        if not moving:
            return
        sums, left = _passed(blocks, places, moving, over, _sums(moving), size), []
        for f in moving:
            s = sums[f.key].reshape(len(f.centres), -1)
            moved = np.where(s[:, :1] > 0, f.reduced(s[:, 1:] / np.maximum(s[:, :1], 1)), f.centres)
            if ((moved - f.centres) ** 2).sum() > f.still:
                left.append(f)
            f.centres = moved
        moving = left


@dataclass
class Swept:
    """Of one group and configuration: the new number of each first cluster, and the fit and first number of each that is split."""

    numbers: np.ndarray
    whole: dict[int, int]
    split: dict[int, tuple[str, int]]


def _chosen(blocks: DataFrame, counts: dict[Key, int], size: int, sample: int) -> DataFrame:
    """What ``cluster.sampled_rows`` takes of all rows. Only rows whose md5 begins low are read in full; more if those are too few."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    limits = {key: min(1.0, 1.2 * sample / n) * 2**32 for key, n in counts.items()}
    while True:

        def low(batches: Batches, limits: dict[Key, float] = limits) -> Batches:
            read = _reader(size)
            for batch in batches:
                ids, picks = _column(batch, "ids"), _column(batch, "picks")
                for n, (grp, points) in enumerate(read(_places(batch))):
                    at = np.flatnonzero(np.frombuffer(picks[n].as_buffer(), "<i8") < limits[grp])
                    flat = points[at].astype("<f4").ravel()
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(at), pa.string()), ids[n].values.take(pa.array(at)), vec], names=["grp", "id", "vec"])

        some = blocks.where(F.col("grp").isin(list(counts))).select("grp", *PLACE, "ids", "picks").mapInArrow(low, f"grp string, id {kind}, vec array<float>")
        found = materialise(cluster.sampled_rows(some, sample))
        held = {r.grp: r["count"] for r in found.groupBy("grp").count().collect()}
        short = [key for key, n in counts.items() if held.get(key, 0) < min(sample, n)]
        if not short:
            return found
        limits = limits | {key: 2.0**32 for key in short}


def swept(rows: DataFrame, size: int, wanted: list[Config], parts: int | None, least_rows: int = 10, sample: int = 5_000) -> DataFrame:
    """Silhouette, final clusters and rows of each group of ``rows`` (grp, id, vec; only those with usable vectors) by ``run``, the number of each configuration (k, merge_ratio, split_ratio).

    Every configuration gives what ``cluster.over_clustered`` and ``cluster.refined`` give it, in single precision within a block.
    """
    spark = rows.sparkSession
    blocks = written(packed(rows, size))
    places = sorted(tuple(r) for r in blocks.select("grp", *PLACE).collect())  # a few thousand for a GB
    total: dict[Key, int] = defaultdict(int)
    for grp, _, _, n, _ in places:
        total[grp] += n
    counts = {grp: n for grp, n in total.items() if n >= least_rows}
    if len(counts) > cluster.MOST_GROUPS:
        raise ValueError(f"{len(counts)} groups; cluster at most {cluster.MOST_GROUPS} in one call")
    pooled = parts is not None
    first = {k: {grp: k if pooled else cluster.adaptive_k(n, k) for grp, n in counts.items()} for k in sorted({c[0] for c in wanted})}
    over = {(grp, k): Fit(grp, k, k, rows=counts[grp]) for own in first.values() for grp, k in own.items()}
    fitted(blocks, places, list(over.values()), {}, size)
    found = {}
    sums = _passed(blocks, places, list(over.values()), {}, _sums(list(over.values())), size)
    for at, f in over.items():
        s = sums[f.key].reshape(len(f.centres), -1)
        found[at] = s[:, 0], np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), 0)
    again: dict[str, Fit] = {}
    runs: dict[tuple[int, Key], Swept] = {}
    for run, (k, merge, split) in enumerate(wanted):
        for grp, own_k in first[k].items():
            n, means = found[grp, own_k]
            numbers, _ = cluster.merge_alike(n, means, merge)
            kept = np.bincount(numbers[numbers >= 0], weights=n[numbers >= 0]).astype(int)
            limit = cluster.split_threshold(counts[grp], split, 200 if pooled else 100)
            large = [i for i, s in enumerate(kept) if s > limit]
            whole = {i: place for place, i in enumerate(i for i in range(len(kept)) if i not in large)}
            place, cut = len(whole), {}
            for i in large:
                f = Fit(grp, own_k, parts or cluster.parts_of(int(kept[i])), tuple(np.flatnonzero(numbers == i).tolist()), int(kept[i]))
                again.setdefault(f.key, f)
                cut[i] = f.key, place
                place += f.parts
            runs[run, grp] = Swept(numbers, whole, cut)
    fits = list(again.values())
    moments = _passed(blocks, places, fits, over, lambda f, v: (lambda v: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]))(v.astype(np.float64)), size)
    for f in fits:
        m = moments[f.key]
        f.rows = int(m[0])
        f.space = cluster.principal_axes(m[0], m[1 : 1 + size], m[1 + size :].reshape(size, size), min(50, f.rows, size))
    fitted(blocks, places, fits, over, size)
    now = Labeller(fits)
    filled = _passed(blocks, places, fits, over, lambda f, v: np.count_nonzero(now.own(f.key, v), 1), size)
    figures = [(run, grp, len(s.whole) + sum(int((filled[key] > 0).sum()) for key, _ in s.split.values()), counts[grp]) for (run, grp), s in runs.items()]

    base, part, keys = Labeller(over.values()), Labeller(fits), {(grp, k): over[grp, own[grp]].key for k, own in first.items() for grp in own}

    def labelled(batches: Batches) -> Batches:
        for batch in batches:
            vectors = as_matrix(batch.column(2), size).astype(np.float32)
            vectors = vectors if np.abs(vectors).max(initial=0) < SAFE else vectors.astype(np.float64)
            for grp, at in _grouped(batch):
                points = vectors[at]
                labels = {k: base.labels(keys[grp, k], points) for k in first}
                for run, (k, _, _) in enumerate(wanted):
                    s = runs[run, grp]
                    merged = s.numbers[labels[k]]
                    final = np.array([s.whole.get(i, -1) for i in range(merged.max(initial=0) + 1)], np.int32)[merged]
                    for i, (key, start) in s.split.items():
                        here = np.flatnonzero(merged == i)
                        if len(here):
                            final[here] = start + part.labels(key, points[here])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(final, pa.int32()), pa.array(np.full(len(at), run, np.int32))], names=["grp", "id", "cluster", "run"])

    chosen = _chosen(blocks, counts, size, sample)
    kind = chosen.schema["id"].dataType.simpleString()
    placed = materialise(chosen.select("grp", "id", "vec").mapInArrow(labelled, f"grp string, id {kind}, cluster int, run int"))
    scores = cluster.shared_silhouettes(chosen, [placed.where(F.col("run") == run).drop("run") for run in range(len(wanted))])
    sizes = spark.createDataFrame(figures, "run int, grp string, k_final bigint, n_samples bigint")
    return scores.drop("n").join(sizes, ["grp", "run"])
