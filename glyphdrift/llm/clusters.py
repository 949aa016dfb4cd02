"""Similarity clusters of vectors: Gaussian mixtures fitted by expectation-maximisation over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.llm.vectors import decode, latest_codes
from glyphdrift.session import materialise

DIMENSIONS = 12  # reduced features
LARGEST = 12  # components tried at first: 1 to this; where most are best, up to twice as many, and so on
RIDGE = 0.05  # added to the diagonal of every covariance, in standardised units
SEED_ROWS = 4_000  # rows of each key on which starting values are found; all rows take part in the fit
GAIN = 1e-4  # log likelihood of a row: a mixture whose last round gained less has converged
ROUNDS = 100  # rounds over all rows at most, far beyond what convergence takes
HOPE = 10  # a mixture is given up when its criterion is worse than the best by more than so many times what the last round gained
LEAST_ROWS = 10  # keys with fewer usable vectors get no clusters
COHERENCE = 0.5  # least mean cosine of a cluster's members to its direction
MERGE = 0.8  # components whose directions are as similar are one cluster
KEYS_AT_ONCE = 500  # keys whose models are held on the driver and in the tasks at a time
MEMBER = 0.45  # least cosine of a member to its cluster's direction


@dataclass
class Mixture:
    """A mixture in reduced features; component 0 is a broad background that takes what lies in no group."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    factors: list[np.ndarray] = field(default_factory=list)
    constants: np.ndarray = field(default_factory=lambda: np.empty(0))

    def prepare(self) -> Mixture:
        d = self.means.shape[1]
        self.factors = [np.linalg.inv(np.linalg.cholesky(c)) for c in self.covariances]
        logdet = np.array([np.log(np.diag(f)).sum() for f in self.factors])
        self.constants = np.log(np.maximum(self.weights, 1e-12)) + logdet - 0.5 * d * np.log(2 * np.pi)
        return self

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each component."""
        return np.stack([c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for c, m, f in zip(self.constants, self.means, self.factors)], 1)

    def statistics(self, x: np.ndarray, directions: np.ndarray) -> np.ndarray:
        """Of each component: mass, sum, sum of squares, sum of directions; the last row holds the log likelihood."""
        joint = self.joint(x)
        top = joint.max(1, keepdims=True)
        mass = np.exp(joint - top)
        total = mass.sum(1, keepdims=True)
        mass /= total
        d = x.shape[1]
        out = np.zeros((len(self.means) + 1, 1 + d + d * d + directions.shape[1]))
        out[:-1, 0] = mass.sum(0)
        out[:-1, 1 : 1 + d] = mass.T @ x
        for j in range(len(self.means)):
            out[j, 1 + d : 1 + d + d * d] = ((x * mass[:, j : j + 1]).T @ x).ravel()
        out[:-1, 1 + d + d * d :] = mass.T @ directions
        out[-1, 0] = (np.log(total) + top).sum()
        return out

    def updated(self, stats: np.ndarray) -> Mixture:
        d = self.means.shape[1]
        mass = np.maximum(stats[:-1, 0], 1e-9)
        means = stats[:-1, 1 : 1 + d] / mass[:, None]
        second = stats[:-1, 1 + d : 1 + d + d * d].reshape(-1, d, d) / mass[:, None, None]
        covariances = second - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
        means[0], covariances[0] = self.means[0], self.covariances[0]
        poor = mass < d + 2
        covariances[poor] = np.eye(d)
        covariances[0] = self.covariances[0]
        return Mixture(mass / mass.sum(), means, covariances).prepare()


def start(x: np.ndarray, k: int, seed: int) -> Mixture:
    """k-means++ starting values on a sample, then a few rounds on it."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        tries = x[rng.choice(len(x), 4, p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x), size=4)]
        centres.append(min(tries, key=lambda t: np.minimum(far, ((x - t) ** 2).sum(1)).sum()))
    centres = np.array(centres)
    for _ in range(8):
        nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        centres = np.array([x[nearest == j].mean(0) if (nearest == j).any() else centres[j] for j in range(k)])
    d = x.shape[1]
    spread = np.mean([x[nearest == j].var(0).mean() for j in range(k) if (nearest == j).any()]) + RIDGE
    mixture = Mixture(np.array([0.02, *([0.98 / k] * k)]), np.vstack([np.zeros(d), centres]), np.array([np.eye(d), *([spread * np.eye(d)] * k)])).prepare()
    nothing, last = np.empty((len(x), 0)), -np.inf
    for _ in range(ROUNDS):
        stats = mixture.statistics(x, nothing)
        if stats[-1, 0] - last < GAIN * len(x):
            break
        last, mixture = stats[-1, 0], mixture.updated(stats)
    return mixture


@dataclass
class Space:
    """Standardisation and reduction of a key's directions."""

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    spread: np.ndarray

    def reduce(self, directions: np.ndarray) -> np.ndarray:
        return ((directions - self.mean) / self.scale) @ self.axes / self.spread


def space_of(n: float, total: np.ndarray, square: np.ndarray) -> Space:
    """From the moments of all rows: unit variance for each coordinate, then the principal axes, scaled alike."""
    mean = total / n
    covariance = square / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
    values, axes = np.linalg.eigh(covariance / np.outer(scale, scale))
    keep = np.argsort(-values)[:DIMENSIONS]
    axes = axes[:, keep] * np.where(axes[np.abs(axes[:, keep]).argmax(0), keep] < 0, -1, 1)
    return Space(mean, scale, axes, np.full(len(keep), np.sqrt(max(values[keep].max(), 1e-9))))


Batches = Iterator[pa.RecordBatch]


def _by_key(batch: pa.RecordBatch, position: int) -> list[tuple[str, np.ndarray]]:
    keys = batch.column(position).dictionary_encode()
    codes = keys.indices.to_numpy(zero_copy_only=False)
    return [(k, np.flatnonzero(codes == i)) for i, k in enumerate(keys.dictionary.to_pylist())]


def _partial(measure: Callable[[str, np.ndarray], dict[int, np.ndarray]], size: int) -> Callable[[Batches], Batches]:
    """Sums of ``measure`` over a partition: one row for each key and model."""

    def run(batches: Batches) -> Batches:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            directions = decode(batch.column(1), size).astype(np.float64)
            for key, rows in _by_key(batch, 0):
                for model, part in measure(key, directions[rows]).items():
                    sums[key, model] = sums[key, model] + part if (key, model) in sums else part
        if sums:
            keys, values = list(sums), [v.astype("<f8").tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([m for _, m in keys], pa.int32()), pa.array(values, pa.binary())], names=["key", "model", "sums"]
            )

    return run


def _add(batches: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, "<f8") for b in batches["sums"].to_pylist()], 0)
    return pa.table({"key": batches["key"][:1], "model": batches["model"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def summed(rows: DataFrame, measure: Callable[[str, np.ndarray], dict[int, np.ndarray]], size: int) -> dict[str, dict[int, np.ndarray]]:
    """``measure`` summed over all rows of each key: in the tasks, then over tasks in two steps, then sent to the driver.

    What arrives is a fixed number of sums for each key and model, whatever the number of rows.
    """
    parts = rows.select("key", "code").mapInArrow(_partial(measure, size), "key string, model int, sums binary")
    some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("key", "model", "part").applyInArrow(_add, "key string, model int, sums binary")
    out: dict[str, dict[int, np.ndarray]] = {}
    for key, model, sums in some.groupBy("key", "model").applyInArrow(_add, "key string, model int, sums binary").collect():
        out.setdefault(key, {})[model] = np.frombuffer(bytes(sums), "<f8")
    return out


@dataclass
class Clusters:
    """The fitted model of one key: mixture, cluster number of each component (-1 none), cluster directions."""

    space: Space
    mixture: Mixture
    cluster: np.ndarray
    directions: np.ndarray

    def assign(self, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster (-1 none), log density and cosine to the cluster's direction of each row."""
        joint = self.mixture.joint(self.space.reduce(directions))
        component = joint.argmax(1)
        cluster = self.cluster[component]
        cosine = (directions * self.directions[np.maximum(cluster, 0)]).sum(1) if len(self.directions) else np.zeros(len(directions))
        density = joint[np.arange(len(joint)), component]
        return np.where(cosine >= MEMBER, cluster, -1), density, cosine


def criterion(k: int, likelihood: float, n: float, d: int) -> float:
    """BIC of a mixture with k components beside the background."""
    return -2 * likelihood + k * (1 + d + d * (d + 1) / 2) * np.log(n)


def choose(space: Space, mixture: Mixture, stats: np.ndarray, size: int) -> Clusters:
    """The mixture's coherent components; those of one direction are one cluster."""
    mass, sums = stats[:-1, 0], stats[:-1, -size:]
    resultant = np.linalg.norm(sums, axis=1) / np.maximum(mass, 1e-9)
    groups: list[np.ndarray] = []
    cluster = np.full(len(mass), -1)
    for j in np.argsort(-mass[1:]) + 1:
        if mass[j] < 2 or resultant[j] < COHERENCE:
            continue
        own = sums[j] / np.linalg.norm(sums[j])
        near = [i for i, g in enumerate(groups) if own @ (g / np.linalg.norm(g)) >= MERGE]
        if near:
            groups[near[0]] = groups[near[0]] + sums[j]
            cluster[j] = near[0]
        else:
            cluster[j] = len(groups)
            groups.append(sums[j].copy())
    return Clusters(space, mixture, cluster, np.array([g / np.linalg.norm(g) for g in groups]).reshape(-1, size))


def _starts(spaces: dict[str, Space], least: dict[str, int], size: int) -> Callable[[pa.Table], pa.Table]:
    """Starting mixtures of one key from its sampled rows: of ``least`` to twice as many components (1 to ``LARGEST`` at first)."""

    def run(rows: pa.Table) -> pa.Table:
        key = rows["key"][0].as_py()
        x = spaces[key].reduce(decode(pa.array(sorted(rows["code"].to_pylist()), pa.binary()), size).astype(np.float64))
        first = least[key]
        last = max(first, min(LARGEST if first == 1 else 2 * first - 1, len(x) // LEAST_ROWS))
        found = {k: start(x, k, 7) for k in range(first, last + 1)}
        bodies = [np.concatenate([m.weights, m.means.ravel(), m.covariances.ravel()]).astype("<f8").tobytes() for m in found.values()]
        return pa.table({"key": pa.array([key] * len(found), pa.string()), "k": pa.array(list(found), pa.int32()), "body": pa.array(bodies, pa.binary())})

    return run


def _mixture(body: bytes, k: int) -> Mixture:
    values = np.frombuffer(body, "<f8")
    d = round((-1 + np.sqrt(1 + 4 * (len(values) / (k + 1) - 1))) / 2)
    cut = [k + 1, (k + 1) * (1 + d)]
    return Mixture(values[: cut[0]], values[cut[0] : cut[1]].reshape(k + 1, d).copy(), values[cut[1] :].reshape(k + 1, d, d).copy()).prepare()


def fit(rows: DataFrame, size: int) -> dict[str, Clusters]:
    """Models of all keys of ``rows`` (key, code).

    Each pass over the rows computes the sums of the expectation step inside the tasks, for every mixture that is still
    in question, so a dominant key is spread over all tasks. Starting values come from a bounded sample, fitted to
    convergence in a task for each key. A mixture has converged when a round over all rows gains less than ``GAIN`` a
    row; one whose BIC can't become the best any more is given up before. Where the largest number of components
    is best, larger ones are tried.
    """
    moments = summed(rows, lambda key, u: {0: np.concatenate([[len(u)], u.sum(0), (u.T @ u).ravel()])}, size)
    counts = {k: m[0][0] for k, m in moments.items() if m[0][0] >= LEAST_ROWS}
    spaces = {k: space_of(moments[k][0][0], moments[k][0][1 : 1 + size], moments[k][0][1 + size :].reshape(size, size)) for k in counts}
    found: dict[str, tuple[float, Mixture, np.ndarray]] = {}
    least = dict.fromkeys(counts, 1)
    spark = rows.sparkSession
    while least:
        shares = spark.createDataFrame([(k, float(min(1.0, SEED_ROWS / counts[k]))) for k in least], "key string, share double")
        some = rows.join(F.broadcast(shares), "key").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("key", "code")
        begun = some.groupBy("key").applyInArrow(_starts(spaces, least, size), "key string, k int, body binary").collect()
        tried: dict[str, dict[int, Mixture]] = {}
        for key, k, body in begun:
            tried.setdefault(key, {})[k] = _mixture(bytes(body), k)
        best = converged(rows.join(F.broadcast(shares.drop("share")), "key") if len(least) < len(counts) else rows, spaces, tried, counts, size)
        at_top = {}
        for key, (value, mixture, stats) in best.items():
            if key not in found or value < found[key][0]:
                found[key] = (value, mixture, stats)
                top = max(tried[key])
                if len(mixture.means) - 1 == top >= LARGEST and counts[key] >= 2 * (top + 1) * LEAST_ROWS:
                    at_top[key] = top + 1
        least = at_top
    return {key: choose(spaces[key], mixture, stats, size) for key, (_, mixture, stats) in found.items()}


def converged(rows: DataFrame, spaces: dict[str, Space], tried: dict[str, dict[int, Mixture]], counts: dict[str, float], size: int) -> dict[str, tuple[float, Mixture, np.ndarray]]:
    """Of each key the mixture of least BIC among those tried, with its criterion and sums, fitted to convergence."""
    best: dict[str, tuple[float, Mixture, np.ndarray]] = {}
    open_ones = {key: dict(by_k) for key, by_k in tried.items()}
    last: dict[tuple[str, int], float] = {}
    for _ in range(ROUNDS):

        def expect(key: str, u: np.ndarray, models: dict[str, dict[int, Mixture]] = open_ones) -> dict[int, np.ndarray]:
            if key not in models:
                return {}
            x = spaces[key].reduce(u)
            return {k: m.statistics(x, u).ravel() for k, m in models[key].items()}

        after: dict[str, dict[int, Mixture]] = {}
        for key, by_k in summed(rows, expect, size).items():
            d, n = spaces[key].axes.shape[1], counts[key]
            values = {k: criterion(k, s.reshape(k + 2, -1)[-1, 0], n, d) for k, s in by_k.items()}
            gains = {k: last.get((key, k), np.inf) - v for k, v in values.items()}
            for k, v in values.items():
                last[key, k] = v
                if key not in best or v < best[key][0]:
                    best[key] = (v, open_ones[key][k], by_k[k].reshape(k + 2, -1))
            for k, v in values.items():
                if gains[k] > 2 * GAIN * n and v - HOPE * gains[k] < best[key][0] + GAIN * n:
                    after.setdefault(key, {})[k] = open_ones[key][k].updated(by_k[k].reshape(k + 2, -1))
        open_ones = after
        if not open_ones:
            break
    return best


def _assign(models: dict[str, Clusters], size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            directions = decode(batch.column(1), size).astype(np.float64)
            cluster, density, cosine = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for key, rows in _by_key(batch, 0):
                if key in models:
                    cluster[rows], density[rows], cosine[rows] = models[key].assign(directions[rows])
            keep = np.flatnonzero(cluster >= 0)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(at), batch.column(0).take(at), pa.array(cluster[keep].astype(np.int32)), pa.array(density[keep]), pa.array(cosine[keep])],
                names=["id", "key", "cluster", "density", "cosine"],
            )

    return run


def similarity_clusters(df: DataFrame, ident: str, key: str, vector: str, order: str, size: int = 64) -> DataFrame:
    """Members of clusters: id, key, cluster_key (smallest id of the cluster), density, cosine.

    For each key a Gaussian mixture with full, ridge-regularised covariances is fitted to the standardised and
    reduced directions of all latest usable vectors; the number of components, up to ``LARGEST``, minimises BIC.
    A broad background component takes rows that lie in no group. Components whose members don't point the same
    way are no cluster, components of one direction are one cluster, and a member's cosine to its cluster's
    direction must reach ``MEMBER``; rows of no cluster are left out, as are null keys, rows without usable
    vector and keys of fewer than ``LEAST_ROWS`` such rows. Length plays no part. Nothing for an empty table.
    """
    rows = materialise(latest_codes(df, [key], vector, size, ident, order).select(F.col(ident).alias("id"), F.col(key).cast("string").alias("key"), "code").where("key IS NOT NULL"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, key string, cluster int, density double, cosine double"
    ranges = max(1, -(-rows.select("key").distinct().count() // KEYS_AT_ONCE))
    members = None
    for n in range(ranges):
        own = rows if ranges == 1 else rows.where(F.pmod(F.xxhash64("key"), F.lit(ranges)) == n)
        some = own.select("key", "code", "id").mapInArrow(_assign(fit(own, size), size), kind)
        members = some if members is None else members.unionByName(some)
    members = materialise(members)
    least = members.groupBy("key", "cluster").agg(F.min("id").alias("cluster_key"))
    # a few rows for each key, so the size is checked where there are many keys
    return members.join(F.broadcast(least) if ranges == 1 else least, ["key", "cluster"]).select("id", "key", "cluster_key", "density", "cosine")


def typical_members(members: DataFrame, count: int = 8) -> DataFrame:
    """Size of each cluster and its members of highest density, ties to the smaller id: one row for each of them."""
    place = W.partitionBy("key", "cluster_key").orderBy(F.desc("density"), "id")
    sizes = members.groupBy("key", "cluster_key").agg(F.count("*").alias("size"))
    best = members.withColumn("place", F.row_number().over(place)).where(F.col("place") <= count)
    return best.join(sizes, ["key", "cluster_key"])


def sense_groups(occurrences: DataFrame) -> DataFrame:
    """Record and group key of problem 7."""
    members = similarity_clusters(occurrences, "occ_id", "word", "vector", "load_seq")
    return members.select(F.col("id").alias("occ_id"), "cluster_key")
