"""Vector clustering of many groups at once: over-cluster, merge like centroids, split large clusters, represent."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.functions.vectors import as_matrix, distance
from glyphdrift.session import materialise, small

START_ROWS = 30_000  # rows of a group on which the best of several starts is found; larger groups go on over all their rows
TRIAL_ROWS = 3_000  # rows on which the starts are compared
STARTS, ROUNDS, TOLERANCE = 10, 300, 1e-4  # starts, rounds at most, and the squared shift (in variances) below which centroids stand still
SLICE_ROWS = 4_096  # rows whose distances to all centroids stay in a core's cache
MOST_GROUPS = 5_000  # centroids of so many groups fit on the driver and in a task; more need several calls
Batches = Iterator[pa.RecordBatch]
Key = str


def adaptive_k(n: int, base: int = 20) -> int:
    """Initial number of clusters for a group of ``n`` rows."""
    if n < 800:
        return max(5, base // 3)
    if n < 2000:
        return max(8, base // 2)
    return max(12, int(0.7 * base)) if n < 5000 else base


def split_threshold(n: int, ratio: float, least: int) -> int:
    """A cluster above this size is split: at least 100 rows for single groups, 200 for pooled ones."""
    return max(int(n * ratio), least)


def sub_k(size: Column) -> Column:
    """Number of parts of a large cluster by its size."""
    return F.when(size >= 20000, 6).when(size >= 10000, 5).when(size >= 5000, 4).when(size >= 2000, 3).otherwise(2)


def parts_of(size: int) -> int:
    """``sub_k`` of one size."""
    return next((k for least, k in ((20000, 6), (10000, 5), (5000, 4), (2000, 3)) if size >= least), 2)


def _grouped(batch: pa.RecordBatch) -> list[tuple[Key, np.ndarray]]:
    keys = batch.column(0).dictionary_encode()
    codes = keys.indices.to_numpy(zero_copy_only=False)
    return [(k, np.flatnonzero(codes == i)) for i, k in enumerate(keys.dictionary.to_pylist())]


def grouped_sums(rows: DataFrame, measure: Callable[[Key, np.ndarray], np.ndarray], size: int) -> dict[Key, np.ndarray]:
    """``measure`` of each group's vectors summed over all tasks.

    A task adds up its own rows first, so a dominant group is spread over tasks and sends one state from each. The
    states are added in two steps; the driver gets one state for each group.
    """

    def partial(batches: Batches) -> Batches:
        sums: dict[Key, np.ndarray] = {}
        for batch in batches:
            vectors = as_matrix(batch.column(1), size)
            for key, at in _grouped(batch):
                part = measure(key, vectors[at])
                sums[key] = sums[key] + part if key in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.astype("<f8").tobytes() for s in sums.values()], pa.binary())], names=["grp", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, "<f8") for b in rows["sums"].to_pylist()], 0)
        return pa.table({"grp": rows["grp"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "grp string, sums binary"
    some = rows.select("grp", "vec").mapInArrow(partial, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = some.groupBy("grp", "part").applyInArrow(add, schema)
    return {k: np.frombuffer(bytes(s), "<f8") for k, s in once.groupBy("grp").applyInArrow(add, schema).collect()}


def _start(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    far = np.full(len(points), np.inf)
    while len(centres) < min(k, len(points)):
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1, dtype=np.float64))
        if far.sum() <= 0:
            break
        centres.append(points[rng.choice(len(points), p=far / far.sum())])
    return np.array(centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - points @ (2 * centres).T).argmin(1)


def nearest_scores(scores: np.ndarray) -> np.ndarray:
    """Of each column the row of its smallest score, as a matrix of ones; ties go to the first row."""
    own = scores == scores.min(0)
    return own if np.count_nonzero(own) == own.shape[1] else np.arange(len(scores))[:, None] == scores.argmin(0)


def settled(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centroids moved until they stand still; one without rows stays where it is."""
    still = TOLERANCE * points.var(0, dtype=np.float64).mean()
    for _ in range(ROUNDS):
        total, size = np.zeros(centres.shape), np.zeros((len(centres), 1))
        for lo in range(0, len(points), SLICE_ROWS):
            some = points[lo : lo + SLICE_ROWS]
            now = centres.astype(points.dtype)
            own = nearest_scores((now**2).sum(1)[:, None] - (2 * now) @ some.T)
            total += own.astype(points.dtype) @ some
            size += np.count_nonzero(own, 1)[:, None]
        moved = np.where(size > 0, total / np.maximum(size, 1), centres)
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= still:
            break
    return centres


def lloyd(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of k-means: the best by inertia of ``STARTS`` starts on at most about ``TRIAL_ROWS`` rows, settled on all."""
    some = points[:: max(1, len(points) // TRIAL_ROWS)]
    tries = [settled(some, _start(some, k, seed + n)) for n in range(STARTS)]
    return settled(points, min(tries, key=lambda c: ((some - c[nearest(some, c)]) ** 2).sum()))


def grouped_kmeans(rows: DataFrame, k: dict[Key, int], counts: dict[Key, int], size: int, seed: int = 42, spaces: dict[Key, np.ndarray] | None = None) -> dict[Key, np.ndarray]:
    """Centroids of each group of ``rows`` (grp, id, vec), all groups fitted in the same passes over the rows.

    ``counts`` has the rows of each group. The best of several starts is found on about ``START_ROWS`` rows of a group, in
    a task for each; groups with more rows go on from there, each round over all their rows, until they stand still.
    ``spaces`` maps a group's vectors into fewer dimensions first (a matrix whose first row is the mean to subtract).
    """
    spaces = spaces or {}
    reduce = lambda key, v: (v - spaces[key][0]) @ spaces[key][1:].T if key in spaces else v

    def begin(part: pa.Table) -> pa.Table:
        key = part["grp"][0].as_py()
        order = np.argsort(part["id"].to_numpy().astype(str), kind="stable")
        points = reduce(key, as_matrix(part["vec"].combine_chunks(), size)[order])
        body = np.concatenate([[points.var(0).mean()], lloyd(points, k[key], seed).ravel()])
        return pa.table({"grp": part["grp"][:1], "body": pa.array([body.astype("<f8").tobytes()], pa.binary())})

    if not counts:
        return {}
    shares = rows.sparkSession.createDataFrame([(key, float(min(1.0, START_ROWS / n))) for key, n in counts.items() if key in k], "grp string, share double")
    some = rows.select("grp", "id", "vec").join(F.broadcast(shares), "grp").where((F.col("share") == 1) | (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000))
    centres, still = {}, {}
    for key, body in some.drop("share").groupBy("grp").applyInArrow(begin, "grp string, body binary").collect():
        values = np.frombuffer(bytes(body), "<f8")
        still[key] = TOLERANCE * values[0]
        centres[key] = values[1:].reshape(-1, len(spaces[key]) - 1 if key in spaces else size)
    moving = {key: centres[key] for key in centres if counts[key] > START_ROWS}
    for _ in range(ROUNDS):
        if not moving:
            break
        sums = grouped_sums(rows.where(F.col("grp").isin(list(moving))), _step(dict(moving), reduce), size)  # those that stand still aren't read again
        for key, own in list(moving.items()):
            s = sums[key].reshape(len(own), -1)
            centres[key] = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), own)
            moving[key] = centres[key]
            if ((centres[key] - own) ** 2).sum() <= still[key]:
                del moving[key]
    return centres


def _step(centres: dict[Key, np.ndarray], reduce: Callable[[Key, np.ndarray], np.ndarray]) -> Callable[[Key, np.ndarray], np.ndarray]:
    """Number and sum of the vectors nearest to each centroid."""

    def run(key: Key, vectors: np.ndarray) -> np.ndarray:
        if key not in centres:
            return np.zeros(1)
        points, own = reduce(key, vectors), centres[key]
        label = nearest(points, own)
        mine = (label == np.arange(len(own))[:, None]).astype(points.dtype)
        return np.column_stack([np.bincount(label, minlength=len(own)), mine @ points]).ravel()

    return run


def assigned(rows: DataFrame, centres: dict[Key, np.ndarray], size: int, spaces: dict[Key, np.ndarray] | None = None) -> DataFrame:
    """grp, id, vec and ``cluster``, the nearest centroid of the row's group; rows of groups without centroids are left out."""
    spaces = spaces or {}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            vectors, cluster = as_matrix(batch.column(1), size), np.full(batch.num_rows, -1, np.int32)
            for key, at in _grouped(batch):
                if key in centres:
                    v = vectors[at]
                    cluster[at] = nearest((v - spaces[key][0]) @ spaces[key][1:].T if key in spaces else v, centres[key])
            keep = pa.array(np.flatnonzero(cluster >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(2).take(keep), batch.column(1).take(keep), pa.array(cluster).take(keep)], names=["grp", "id", "vec", "cluster"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("grp", "vec", "id").mapInArrow(run, f"grp string, id {kind}, vec array<float>, cluster int")


@dataclass
class Merge:
    """One step of merging: cluster ``source`` joins ``target``."""

    step: int
    source: int
    target: int
    similarity: float
    source_size: int
    target_size: int


def merge_alike(sizes: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, list[Merge]]:
    """Join the two clusters of most similar centroids while their cosine exceeds ``threshold``.

    Centroids of joined clusters are size-weighted means, which equals recomputing them from the rows, so no row is
    read again. Ties go to the lowest pair. Returns the dense new number of each cluster and the steps.
    """
    alive = [i for i in range(len(sizes)) if sizes[i] > 0]
    size, centre = sizes.astype(np.float64).copy(), centres.astype(np.float64).copy()
    target, steps = np.arange(len(sizes)), []
    while len(alive) > 1:
        own = centre[alive]
        unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        similar = unit @ unit.T
        np.fill_diagonal(similar, -1)
        i, j = np.unravel_index(similar.argmax(), similar.shape)
        if similar[i, j] <= threshold:
            break
        a, b = sorted((alive[i], alive[j]))
        steps.append(Merge(len(steps) + 1, b, a, round(float(similar[i, j]), 6), int(size[b]), int(size[a])))
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size[b]
        target[target == b] = a
        alive.remove(b)
    dense = {old: new for new, old in enumerate(sorted(alive))}
    return np.array([dense.get(int(t), -1) for t in target]), steps


def principal_axes(n: float, total: np.ndarray, square: np.ndarray, count: int) -> np.ndarray:
    """Mean (first row) and principal axes from moments; each axis has its largest loading positive."""
    mean = total / n
    values, axes = np.linalg.eigh(square / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:count]].T
    strongest = np.abs(axes).argmax(1)
    return np.vstack([mean, axes * np.where(axes[np.arange(len(axes)), strongest] < 0, -1, 1)[:, None]])


def moments(rows: DataFrame, size: int) -> dict[Key, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of each group's vectors."""
    sums = grouped_sums(rows, lambda key, v: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]), size)
    return {k: (s[0], s[1 : 1 + size], s[1 + size :].reshape(size, size)) for k, s in sums.items()}


def renumbered(rows: DataFrame, label: Column, numbers: dict[str, int]) -> DataFrame:
    """grp, id, vec and the new ``cluster`` of each row by its label; the numbers are a row for each cluster of each group."""
    table = rows.sparkSession.createDataFrame(sorted(numbers.items()), "label string, new int")
    return rows.withColumn("label", label).join(F.broadcast(table), "label").select("grp", "id", "vec", F.col("new").alias("cluster"))


def rows_of_labels(rows: DataFrame, labels: dict[str, int]) -> DataFrame:
    """The labels as a table: at most a few for each of ``MOST_GROUPS`` groups, so it is broadcast."""
    return F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in sorted(labels)], "label string"))


@dataclass
class Clustering:
    """Rows with their cluster (grp, id, vec, cluster), the merge steps and split clusters of each group."""

    rows: DataFrame
    merges: dict[Key, list[Merge]]
    splits: dict[Key, dict[int, list[int]]]


@dataclass
class Overclustering:
    """Rows with their first cluster, rows of each group, and size and mean of each group's first clusters."""

    rows: DataFrame
    size: int
    pooled: bool
    counts: dict[Key, int]
    sizes: dict[Key, np.ndarray]
    means: dict[Key, np.ndarray]


def cluster_label() -> Column:
    """Cluster and group of a row as one key."""
    return F.concat_ws("|", "cluster", "grp")


def over_clustered(rows: DataFrame, size: int, base_k: int = 20, pooled: bool = False, least_rows: int = 10) -> Overclustering:
    """k-means of every group of ``rows`` (grp, id, vec) with more clusters than wanted; groups below ``least_rows`` are left out.

    Pooled groups use the full ``base_k``, single periods fewer clusters when they are small.
    """
    rows = materialise(rows.select("grp", "id", "vec"))
    counts = {key: int(n[0]) for key, n in grouped_sums(rows, lambda key, v: np.array([float(len(v))]), size).items() if n[0] >= least_rows}
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"{len(counts)} groups; cluster at most {MOST_GROUPS} in one call")
    first = grouped_kmeans(rows, {key: base_k if pooled else adaptive_k(n, base_k) for key, n in counts.items()}, counts, size)
    over = materialise(assigned(rows, first, size))
    sums = grouped_sums(over.withColumn("grp", cluster_label()), lambda key, v: np.concatenate([[len(v)], v.sum(0)]), size)
    found = {key: [sums.get(f"{i}|{key}") for i in range(len(centres))] for key, centres in first.items()}
    return Overclustering(
        over, size, pooled, counts,
        {key: np.array([0 if s is None else s[0] for s in parts]) for key, parts in found.items()},
        {key: np.array([np.zeros(size) if s is None else s[1:] / s[0] for s in parts]) for key, parts in found.items()},
    )


def refined(over: Overclustering, merge_ratio: float = 0.95, split_ratio: float = 0.3, fixed_parts: int | None = None, split: bool = True) -> Clustering:
    """Merge like clusters, split large ones, number densely.

    With ``fixed_parts`` every large cluster is split into so many, else by its size; pooled groups split above at
    least 200 rows, others above 100. Splitting clusters a part's rows in at most 50 principal dimensions.
    """
    merges, numbers, kept = {}, {}, {}
    for key, n in over.sizes.items():
        numbers[key], merges[key] = merge_alike(n, over.means[key], merge_ratio)
        kept[key] = np.bincount(numbers[key][numbers[key] >= 0], weights=n[numbers[key] >= 0]).astype(int)
    merged = renumbered(over.rows, cluster_label(), {f"{i}|{key}": int(c) for key, new in numbers.items() for i, c in enumerate(new.tolist())})
    large: dict[Key, int] = {}
    if split:
        for key, n in kept.items():
            limit = split_threshold(over.counts[key], split_ratio, 200 if over.pooled else 100)
            large |= {f"{i}|{key}": fixed_parts or parts_of(int(s)) for i, s in enumerate(n) if s > limit}
    splits: dict[Key, dict[int, list[int]]] = {key: {} for key in numbers}
    if not large:
        return Clustering(merged, merges, splits)
    merged = materialise(merged)
    labelled = merged.withColumn("label", cluster_label())
    parts = rows_of_labels(labelled, large)
    part = labelled.join(parts, "label", "left_semi").select(F.col("label").alias("grp"), "id", "vec")
    found = moments(part, over.size)
    spaces = {key: principal_axes(*m, min(50, int(m[0]), over.size)) for key, m in found.items()}
    within = assigned(part, grouped_kmeans(part, large, {key: int(m[0]) for key, m in found.items()}, over.size, spaces=spaces), over.size, spaces)
    final: dict[str, int] = {}
    for key, n in kept.items():
        whole = [i for i in range(len(n)) if f"{i}|{key}" not in large]
        final |= {f"{i}|{key}|": number for number, i in enumerate(whole)}
        number = len(whole)
        for i in sorted(set(range(len(n))) - set(whole)):
            splits[key][i] = list(range(number, number + large[f"{i}|{key}"]))
            final |= {f"{i}|{key}|{p}": c for p, c in enumerate(splits[key][i])}
            number += large[f"{i}|{key}"]
    same = labelled.join(parts, "label", "left_anti").withColumn("old", F.concat("label", F.lit("|")))
    cut = within.withColumn("old", F.concat_ws("|", "grp", F.col("cluster").cast("string"))).withColumn("grp", F.regexp_replace("grp", r"^\d+\|", ""))
    both = same.select("grp", "id", "vec", "old").unionByName(cut.select("grp", "id", "vec", "old"))
    return Clustering(renumbered(both, F.col("old"), final), merges, splits)


def sense_clusters(
    rows: DataFrame, size: int, base_k: int = 20, merge_ratio: float = 0.95, split_ratio: float = 0.3, fixed_parts: int | None = None, least_rows: int = 10, split: bool = True
) -> Clustering:
    """Cluster every group of ``rows`` (grp, id, vec): over-cluster, merge, split large clusters, number densely.

    ``fixed_parts`` says that the groups are pooled ones. Null vectors and groups must be filtered before.
    """
    over = over_clustered(rows, size, base_k, fixed_parts is not None, least_rows)
    return refined(over, merge_ratio, split_ratio, fixed_parts, split)


def dense_relabel(df: DataFrame, keys: list[str], cluster: str, name: str = "new_cluster") -> DataFrame:
    """Number the clusters of each group from 0 in the order of their old numbers, over the distinct ones only."""
    old = df.select(*keys, cluster).distinct()
    new = old.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(cluster)) - 1)
    return df.join(new, [*keys, cluster])


def representatives(df: DataFrame, centres: DataFrame, keys: list[str], vector: str, ident: str, core: int = 8, boundary: int = 3) -> DataFrame:
    """The ``core`` rows nearest to their cluster's centroid and the ``boundary`` farthest ones, with kind and place.

    Both by rising distance, ties by ident. A cluster of at most core + boundary rows has no boundary. ``centres``
    has the keys, size and centroid of each cluster; it is computed once and its rows are counted before it is broadcast,
    so vectors are not shuffled by few keys. Rank filters bound what each task sends for a cluster.
    """
    measured = df.join(small(centres), keys).withColumn("dist", distance(F.col(vector), F.col("centroid")))
    rows = measured.select(*keys, ident, "dist", "size")
    near = rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("dist", ident))).where(F.col("place") <= core)
    far = rows.where(F.col("size") > core + boundary)
    far = far.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("dist"), F.desc(ident)))).where(F.col("place") <= boundary)
    shown = [*keys, ident, "dist"]
    return near.select(*shown, F.lit("core").alias("kind"), "place").unionByName(
        far.select(*shown, F.lit("boundary").alias("kind"), (F.lit(boundary + 1) - F.col("place")).alias("place"))
    )


def centroid_pairs(centres: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Pairs of clusters of a group (low number first) with both centroids; a group has a few dozen clusters at most."""
    a = centres.select(*keys, F.col(cluster).alias("low"), F.col("centroid").alias("low_centroid"), F.col("size").alias("low_size"))
    b = centres.select(*keys, F.col(cluster).alias("high"), F.col("centroid").alias("high_centroid"), F.col("size").alias("high_size"))
    return a.join(b, keys).where("low < high")


def projected(rows: DataFrame, axes: np.ndarray, size: int) -> DataFrame:
    """grp, id and the first two principal coordinates PC1, PC2 on shared axes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            flat = (as_matrix(batch.column(1), size) - axes[0]) @ axes[1:3].T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["grp", "id", "PC1", "PC2"])

    return rows.select("grp", "vec", "id").mapInArrow(run, f"grp string, id {rows.schema['id'].dataType.simpleString()}, PC1 double, PC2 double")


def silhouettes(rows: DataFrame, sample: int = 5_000) -> DataFrame:
    """Mean Euclidean silhouette of each group on at most ``sample`` of its rows, chosen by a hash; null below two clusters.

    The sample size bounds the task of a group: what is compared pairwise never grows with the group.
    """
    place = W.partitionBy("grp").orderBy(F.md5(F.col("id").cast("string")), "id")
    chosen = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample).select("grp", "vec", "cluster")

    def score(part: pa.Table) -> pa.Table:
        labels = part["cluster"].to_numpy()
        first = len(part["vec"][0])
        points = as_matrix(part["vec"], first)
        kinds, inverse, counts = np.unique(labels, return_inverse=True, return_counts=True)
        value = None
        if 2 <= len(kinds) < len(labels):
            total = 0.0
            squares = (points**2).sum(1)
            member = np.eye(len(kinds))[inverse]
            for lo in range(0, len(points), 500):
                d = np.sqrt(np.maximum(squares[lo : lo + 500, None] + squares - 2 * points[lo : lo + 500] @ points.T, 0))
                sums = d @ member
                own = inverse[lo : lo + 500]
                at = np.arange(len(own))
                inner = sums[at, own] / np.maximum(counts[own] - 1, 1)
                means = sums / counts
                means[at, own] = np.inf
                outer = means.min(1)
                s = np.where(counts[own] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-12), 0.0)
                total += s.sum()
            value = total / len(points)
        return pa.table({"grp": part["grp"][:1], "n": pa.array([len(labels)], pa.int64()), "silhouette": pa.array([value], pa.float64())})

    return chosen.groupBy("grp").applyInArrow(score, "grp string, n bigint, silhouette double")


def sampled_rows(rows: DataFrame, sample: int = 5_000) -> DataFrame:
    """grp, id and vec of at most ``sample`` rows of each group, chosen by a hash."""
    place = W.partitionBy("grp").orderBy(F.md5(F.col("id").cast("string")), "id")
    return rows.select("grp", "id", "vec").withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample).drop("place")


def shared_silhouettes(chosen: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """Silhouette of each group of the ``chosen`` rows (grp, id, vec) under each of several clusterings of them, by ``run``, its number.

    Distances are the same whatever the clusters, so they are taken once for all runs. Ids are those of one row each.
    """
    labels = reduce(DataFrame.unionByName, [r.select("grp", "id", "cluster", F.lit(n).alias("run")) for n, r in enumerate(runs)])
    held = labels.join(chosen.select("grp", "id"), ["grp", "id"], "left_semi").groupBy("grp", "id").agg(F.array_sort(F.collect_list(F.struct("run", "cluster"))).alias("own"))
    facts = chosen.join(held, ["grp", "id"]).select("grp", "vec", F.col("own.run").alias("run"), F.col("own.cluster").alias("cluster"))

    def score(part: pa.Table) -> pa.Table:
        points = as_matrix(part["vec"].combine_chunks(), len(part["vec"][0]))
        sizes = part["run"].combine_chunks().value_lengths().to_numpy()
        at, run, label = np.repeat(np.arange(len(points)), sizes), *(part[c].combine_chunks().flatten().to_numpy() for c in ("run", "cluster"))
        kinds, inverse, counts = np.unique(run.astype(np.int64) << 32 | label, return_inverse=True, return_counts=True)
        numbers, first = np.unique(kinds >> 32, return_index=True)
        bounds = np.append(first, len(kinds))
        member = np.zeros((len(points), len(kinds)))
        member[at, inverse] = 1
        own = np.full((len(points), len(numbers)), -1)
        own[at, np.searchsorted(numbers, run)] = inverse
        total, held = np.zeros(len(numbers)), np.array([int((own[:, n] >= 0).sum()) for n in range(len(numbers))])
        squares = (points**2).sum(1)
        for lo in range(0, len(points), 500):
            d = np.sqrt(np.maximum(squares[lo : lo + 500, None] + squares - 2 * points[lo : lo + 500] @ points.T, 0))
            all_sums = d @ member
            for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                rows = np.flatnonzero(own[lo : lo + 500, n] >= 0)
                sums, mine = all_sums[rows, a:b], own[lo : lo + 500, n][rows] - a
                many, at_own = counts[a:b], np.arange(len(rows))
                inner = sums[at_own, mine] / np.maximum(many[mine] - 1, 1)
                means = sums / many
                means[at_own, mine] = np.inf
                outer = means.min(1)
                total[n] += np.where(many[mine] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-12), 0.0).sum()
        values = [float(t / m) if 2 <= b - a < m else None for t, m, a, b in zip(total, held, bounds, bounds[1:])]
        key = pa.array([part["grp"][0].as_py()] * len(numbers), pa.string())
        return pa.table({"grp": key, "run": pa.array(numbers.astype(np.int32)), "n": pa.array(held, pa.int64()), "silhouette": pa.array(values, pa.float64())})

    return facts.groupBy("grp").applyInArrow(score, "grp string, run int, n bigint, silhouette double")
