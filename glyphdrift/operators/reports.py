"""Documents and reports made of clustered rows: statistics, label templates, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.functions.vectors import centroids
from glyphdrift.operators.cluster import representatives


def statistics_documents(rows: DataFrame, keys: list[str], cluster: str, ident: str, vector: str, shown: list[str], core: int = 8, boundary: int = 3) -> DataFrame:
    """One nested document for each of the ``keys``: n_samples, k_final and ``cluster_sentences``.

    That maps each cluster to its count and its core and boundary members (``shown`` columns and distance, by rising
    distance). A cluster gives core + boundary members at most and a group has a few dozen clusters, so a document is
    small however many rows it stands for. Empty tables give none.
    """
    own = [*keys, cluster]
    centres = centroids(rows, own, vector)
    best = representatives(rows, centres, own, vector, ident, core, boundary).join(rows.select(ident, *shown), ident)
    member = F.struct("place", F.struct(*shown, F.round("dist", 4).alias("dist")).alias("m"))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, member))), lambda x: x["m"])
    parts = best.groupBy(*own).agg(of("core").alias("core"), of("boundary").alias("boundary"))
    sized = parts.join(centres.select(*own, F.col("size").alias("count")), own)
    entry = F.struct(F.col(cluster).cast("string").alias("key"), F.struct("core", "boundary", "count").alias("value"))
    return sized.groupBy(*keys).agg(F.sum("count").alias("n_samples"), F.count("*").cast("int").alias("k_final"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cluster_sentences"))


def label_sections(rows: DataFrame, keys: list[str], cluster: str, period: str, sentence: str, ident: str, samples: int = 5) -> DataFrame:
    """A Markdown section for each cluster of a label template: size, rows by period, first sentences by ``ident``.

    Sentences come from a ranked filter and periods from an aggregate, so no cluster is gathered as a whole.
    """
    own = [*keys, cluster]
    by_period = rows.groupBy(*own, period).agg(F.count("*").alias("n"))
    periods = by_period.groupBy(*own).agg(
        F.sum("n").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(period, "n"))), lambda p: F.concat(p[period], F.lit(": "), p["n"].cast("string"))), ", ").alias("periods")
    )
    first = rows.withColumn("place", F.row_number().over(W.partitionBy(*own).orderBy(ident))).where(F.col("place") <= samples)
    listed = first.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.col(sentence), F.lit("")).alias("s")))), lambda p: F.concat(F.lit("- "), p["s"])), "\n").alias("samples"))
    head = F.concat(F.lit("## "), F.concat_ws(" / ", *keys), F.lit(" C"), F.col(cluster).cast("string"), F.lit(" ("), F.col("size").cast("string"), F.lit(")"))
    return periods.join(listed, own).select(*own, "size", F.concat_ws("\n", head, F.col("periods"), F.col("samples")).alias("section"))


def reason_rates(df: DataFrame, keys: list[str], reasons: str) -> DataFrame:
    """Rows for each reason and their share, in percent, of the rows that have any reason."""
    some = df.where(F.size(reasons) > 0)
    whole = some.groupBy(*keys).agg(F.count("*").alias("filtered"))
    each = some.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return each.join(whole, keys).select(*keys, "reason", "n", "filtered", (F.col("n") * 100.0 / F.col("filtered")).alias("pct"))


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """A table as Markdown lines in order (``line``), written by Spark and never cut: two for the head, one for each row."""
    spark = df.sparkSession
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\n]", " "), F.lit("")) for c in df.columns]
    rows = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = spark.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "line string").coalesce(1)
    return head.unionByName(rows)
