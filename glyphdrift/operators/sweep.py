"""One-factor parameter sweeps: configurations, weighted metrics, best run against baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CONFIG_SCHEMA = "grp string, value double, k int, merge_ratio double, split_ratio double"


def one_factor_configs(spark: SparkSession, baseline: tuple[int, float, float], ks: Sequence[int], merges: Sequence[float], splits: Sequence[float]) -> DataFrame:
    """Configurations that change one factor of the baseline at a time, with the factor's name and value."""
    k, merge, split = baseline
    rows = [("k", float(x), x, merge, split) for x in ks]
    rows += [("merge_ratio", x, k, x, split) for x in merges]
    rows += [("split_ratio", x, k, merge, x) for x in splits]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def unique_configs(configs: DataFrame) -> DataFrame:
    """Each configuration once, whatever the number of groups it stands in."""
    return configs.select("k", "merge_ratio", "split_ratio").distinct()


def run_id(prefix: str) -> Column:
    """Name of a run by its parameters."""
    return F.translate(F.format_string(prefix + "_k%d_m%.2f_s%.2f", "k", "merge_ratio", "split_ratio"), ".", "p")


def with_results(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the unique runs for every row of every group."""
    return configs.join(results, ["k", "merge_ratio", "split_ratio"])


def weighted_metrics(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Silhouette and number of clusters weighted by rows; rows that miss any of the three are left out."""
    whole = stats.where("n_samples IS NOT NULL AND silhouette IS NOT NULL AND k_final IS NOT NULL AND n_samples > 0")
    weight = F.sum("n_samples")
    return whole.groupBy(*keys).agg(
        (F.sum(F.col("silhouette") * F.col("n_samples")) / weight).alias("silhouette"),
        (F.sum(F.col("k_final") * F.col("n_samples")) / weight).alias("k_final"),
        weight.alias("n_samples"),
    )


def best_run(runs: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """The run of highest silhouette, then fewest clusters, then smallest name; runs without silhouette don't count."""
    order = F.struct(F.col("silhouette"), (-F.col("k_final")).alias("less"))
    ranked = runs.where(F.col("silhouette").isNotNull()).groupBy(*keys).agg(F.max(order).alias("best"))
    rows = runs.join(ranked, keys).where((F.col("silhouette") == F.col("best.silhouette")) & (F.col("k_final") == -F.col("best.less")))
    return rows.groupBy(*keys).agg(F.min(F.struct(ident, "silhouette", "k_final")).alias("row")).select(*keys, "row.*")


def top_runs(runs: DataFrame, keys: list[str], ident: str, count: int = 10) -> DataFrame:
    """The ``count`` runs of highest silhouette with their place, ties to fewer clusters, then to the smaller name."""
    order = [F.desc("silhouette"), F.col("k_final").asc_nulls_last(), F.col(ident)]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return runs.where(F.col("silhouette").isNotNull()).withColumn("place", place).where(F.col("place") <= count)


def baseline_run(runs: DataFrame, baseline: tuple[int, float, float]) -> DataFrame:
    """Runs whose parameters are the baseline's within 1e-9."""
    k, merge, split = baseline
    near = lambda c, x: F.abs(F.col(c) - F.lit(x)) < 1e-9
    return runs.where(near("k", k) & near("merge_ratio", merge) & near("split_ratio", split))


def deltas(best: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """What the best run gains over the baseline."""
    base = baseline.select(*keys, F.col("silhouette").alias("base_silhouette"), F.col("k_final").alias("base_k_final"))
    return best.join(base, keys, "left").withColumns(
        {"delta_silhouette": F.round(F.col("silhouette") - F.col("base_silhouette"), 6), "delta_k_final": F.col("k_final") - F.col("base_k_final")}
    )
