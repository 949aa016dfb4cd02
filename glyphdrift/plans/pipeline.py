"""The stages from raw records to labelled clusters as one lazy plan, and the runner that writes what is reused."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphdrift.functions.vectors import is_usable
from glyphdrift.operators import analytics, blocks, cluster, labels, quality, reports, sampling, sweep
from glyphdrift.session import materialise
from glyphdrift.sources import tables

# The stages in order.
STAGES = ("extract", "clean1", "sample", "clean2", "local", "global", "label_template", "global_plot", "local_annotate")
ALIASES = {"postprocess": "global_plot"}  # an older name of a stage


@dataclass(frozen=True)
class Settings:
    """Parameters of a run."""

    mode: str = "conservative"
    level: str = "normal"
    cap: int = 200
    seed: int = 42
    size: int = 64
    base_k: int = 20
    merge_ratio: float = 0.95
    local_split: float = 0.3
    global_split: float = 0.1
    global_parts: int = 6


def stage_range(start: str, end: str) -> tuple[str, ...]:
    """The stages from start to end; older names are understood."""
    a, b = (STAGES.index(ALIASES.get(s, s)) for s in (start, end))
    return STAGES[a : b + 1]


def cleaned_sample(records: DataFrame, settings: Settings) -> DataFrame:
    """clean1, exact deduplication, strata cap and clean2 in this order, as one plan.

    The order matters: the cap falls between the two filters. Vectors are not needed here and should not be selected.
    """
    first = records.where(quality.removal_reason(F.col("sentence"), settings.mode).isNull())
    titled = first.withColumn("toptitle", sampling.source_title(F.col("toptitle")))
    unique = sampling.first_of_equal(titled, ["dynasty_category", "word", "sentence"], ["occ_id"])
    capped = sampling.capped_strata(unique, ["dynasty_category", "word", "toptitle"], "occ_id", settings.cap, settings.seed)
    return capped.where(F.size(quality.failed_checks(F.col("sentence"), settings.level)) == 0)


def with_vectors(sample: DataFrame, records: DataFrame, size: int) -> DataFrame:
    """The sample's rows with usable vectors."""
    vectors = records.where(is_usable("vector", size)).select("occ_id", "vector")
    return sample.join(vectors, "occ_id")


def local_clusters(rows: DataFrame, settings: Settings) -> cluster.Clustering:
    """Clusters of each word and period."""
    keyed = rows.where("word IS NOT NULL AND dynasty_category IS NOT NULL").select(F.concat_ws("/", "word", "dynasty_category").alias("grp"), F.col("occ_id").alias("id"), F.col("vector").alias("vec"))
    return cluster.sense_clusters(keyed, settings.size, settings.base_k, settings.merge_ratio, settings.local_split)


def global_clusters(rows: DataFrame, settings: Settings) -> cluster.Clustering:
    """Clusters of each word over all periods."""
    keyed = rows.where("word IS NOT NULL").select(F.col("word").alias("grp"), F.col("occ_id").alias("id"), F.col("vector").alias("vec"))
    return cluster.sense_clusters(keyed, settings.size, settings.base_k, settings.merge_ratio, settings.global_split, settings.global_parts)


def sweep_results(rows: DataFrame, configs: DataFrame, size: int, parts: int | None = 6) -> DataFrame:
    """Silhouette, clusters and rows of each group for every unique configuration (k, merge_ratio, split_ratio).

    ``rows`` has grp, id and vec. All configurations share their passes over the rows and the distances of the silhouettes. With ``parts`` groups count as pooled
    and large clusters are split into so many; with None they are single periods, with numbers of clusters and parts by size.
    """
    wanted = sorted(tuple(r) for r in sweep.unique_configs(configs).collect())
    named = rows.sparkSession.createDataFrame([(n, *c) for n, c in enumerate(wanted)], "run int, k int, merge_ratio double, split_ratio double")
    return blocks.swept(rows, size, wanted, parts).join(F.broadcast(named), "run").drop("run")


def annotated(rows: DataFrame, local: DataFrame, pooled: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes of the local clusters and the rows with their inherited labels.

    ``local`` has occ_id and local_cluster, ``pooled`` occ_id and global_cluster. Rows meet by period and sentence.
    """
    known = rows.select("occ_id", "word", F.col("dynasty_category").alias("dynasty"), "sentence")
    left, right = known.join(local, "occ_id"), known.join(pooled, "occ_id")
    matched = labels.matched_clusters(left, right, ["word", "dynasty", "sentence"], "occ_id")
    votes = labels.majority_vote(matched, mapping)
    return votes, labels.apply_local_labels(matched, votes, mapping)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole table was written there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


@dataclass
class Run:
    """Runs named stages in order and keeps what happened; the first failure ends the run."""

    folder: str
    stages: dict[str, Callable[[], DataFrame | None]]
    log: list[dict] = field(default_factory=list)

    def execute(self, start: str = STAGES[0], end: str = STAGES[-1], skip_existing: bool = False) -> list[dict]:
        """Write each stage's table to its folder; the manifest is written after every stage.

        With ``skip_existing`` a stage whose table is there is not built at all.
        """
        spark = SparkSession.getActiveSession()
        for name in stage_range(start, end):
            if name not in self.stages:
                continue
            began, path = time.time(), f"{self.folder}/{name}"
            entry: dict = {"stage": name, "success": True, "message": ""}
            try:
                if skip_existing and exists(spark, path):
                    entry["message"] = "skipped"
                else:
                    table = self.stages[name]()
                    if table is not None:
                        table.write.mode("overwrite").parquet(path)
            except Exception as error:  # noqa: BLE001
                entry |= {"success": False, "message": str(error)[:500]}
            self.log.append(entry | {"elapsed_sec": round(time.time() - began, 3)})
            tables.write_manifest(f"{self.folder}/summary.json", stages=self.log)
            if not entry["success"]:
                raise RuntimeError(f"stage {name} failed: {entry['message']}")
        return self.log


def clustered(found: cluster.Clustering, rows: DataFrame, name: str) -> DataFrame:
    """The rows with their cluster under that name."""
    return rows.join(found.rows.select(F.col("id").alias("occ_id"), F.col("cluster").alias(name)), "occ_id")


def full_run(records: DataFrame, mapping: DataFrame, folder: str, settings: Settings = Settings()) -> Run:  # noqa: B008
    """All nine stages over ``records`` (the columns of an occurrence, latest rows), each reading what earlier ones wrote.

    extract: the records; clean1, sample, clean2: the filters and the cap; local, global: clusters of rows with usable
    vectors by word and period, and by word; label_template: a section for each pooled cluster; global_plot: labelled
    centres and ranges of the principal plane; local_annotate: rows with the labels that local clusters inherit.
    """
    spark = records.sparkSession
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    plain = ["occ_id", "word", "dynasty_category", "toptitle", "sentence"]

    def sampled() -> DataFrame:
        titled = read("clean1").withColumn("toptitle", sampling.source_title(F.col("toptitle")))
        unique = sampling.first_of_equal(titled, ["dynasty_category", "word", "sentence"], ["occ_id"])
        return sampling.capped_strata(unique, ["dynasty_category", "word", "toptitle"], "occ_id", settings.cap, settings.seed)

    def vectors() -> DataFrame:
        return with_vectors(read("clean2").drop("vector"), read("extract"), settings.size)

    def plotted() -> DataFrame:
        rows = read("global")
        keyed = rows.select(F.lit("all").alias("grp"), F.col("occ_id").alias("id"), F.col("vector").alias("vec"))
        found = cluster.moments(keyed, settings.size)
        axes = cluster.principal_axes(*found["all"], 2)
        placed = rows.join(cluster.projected(keyed, axes, settings.size).select(F.col("id").alias("occ_id"), "PC1", "PC2"), "occ_id")
        return analytics.label_centres(labels.apply_global_labels(placed, "global_cluster", mapping), ["word", "global_cluster", "Macro_Category", "Sub_Category"])

    def inherited() -> DataFrame:
        votes, rows = annotated(read("extract").select(*plain), read("local").select("occ_id", "local_cluster"), read("global").select("occ_id", "global_cluster"), mapping)
        return rows

    return Run(
        folder,
        {
            "extract": lambda: records.select(*plain, "vector"),
            "clean1": lambda: read("extract").drop("vector").where(quality.removal_reason(F.col("sentence"), settings.mode).isNull()),
            "sample": sampled,
            "clean2": lambda: read("sample").where(F.size(quality.failed_checks(F.col("sentence"), settings.level)) == 0),
            "local": lambda: clustered(local_clusters(vectors(), settings), vectors(), "local_cluster"),
            "global": lambda: clustered(global_clusters(vectors(), settings), vectors(), "global_cluster"),
            "label_template": lambda: reports.label_sections(read("global").fillna("unknown", ["dynasty_category"]), ["word"], "global_cluster", "dynasty_category", "sentence", "occ_id"),
            "global_plot": plotted,
            "local_annotate": inherited,
        },
    )
