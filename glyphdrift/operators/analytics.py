"""Figures over labelled clusters: distributions over periods, composition, centres, trajectories, proportions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NOISE = "NOISE"
# The periods in order, display names, and colours for labels without one.
PERIODS = ("pre-qin", "qinhan", "weijin", "suitang", "songyuan", "ming", "qing", "republican")
PERIOD_NAMES = ("Pre-Qin", "Qin-Han", "Wei-Jin", "Sui-Tang", "Song-Yuan", "Ming", "Qing", "Republican")
PINYIN = {"手": "shǒu", "道": "dào", "水": "shuǐ", "天": "tiān", "地": "dì", "人": "rén"}
COLOURS = (
    "#e6ab02", "#66a61e", "#a6761d", "#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66c2a5",
    "#fc8d62", "#8da0cb", "#17becf", "#984ea3", "#4daf4a", "#e41a1c", "#ff7f00",
)


def period_name(period: str) -> F.Column:
    """English name of a period; an unknown one is its own name."""
    names = F.create_map(*[F.lit(x) for pair in zip(PERIODS, PERIOD_NAMES) for x in pair])
    return F.coalesce(F.element_at(names, F.col(period)), F.col(period))


def character_name(word: str) -> F.Column:
    """Transcription and character, or the character alone."""
    names = F.create_map(*[F.lit(x) for pair in PINYIN.items() for x in pair])
    sound = F.element_at(names, F.col(word))
    return F.when(sound.isNull(), F.col(word)).otherwise(F.concat(F.lit("'"), sound, F.lit("' "), F.col(word)))


def period_distribution(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Rows of each cluster in each period."""
    return df.groupBy(*keys, period).agg(F.count("*").alias("n"))


def composition(df: DataFrame, keys: list[str], period: str, periods: Sequence[str] = PERIODS) -> DataFrame:
    """Share of each period in each cluster in percent, one column for each of the fixed periods, 0 where none."""
    counts = df.groupBy(*keys).pivot(period, list(periods)).agg(F.count(F.lit(1)))
    whole = sum((F.coalesce(F.col(f"`{p}`"), F.lit(0)) for p in periods), F.lit(0))
    return counts.select(*keys, *[F.when(whole > 0, F.coalesce(F.col(f"`{p}`"), F.lit(0)) * 100.0 / whole).otherwise(0.0).alias(p.replace("-", "_")) for p in periods])


def label_centres(df: DataFrame, keys: list[str], x: str = "PC1", y: str = "PC2") -> DataFrame:
    """Mean position of each labelled cluster, noise left out."""
    return df.where(F.col("Macro_Category") != NOISE).groupBy(*keys).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def trajectory(df: DataFrame, keys: list[str], order: str, x: str = "PC1", y: str = "PC2") -> DataFrame:
    """Mean position of each period and the step from the period before, in order of time."""
    means = df.groupBy(*keys, order).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    before = W.partitionBy(*keys).orderBy(order)
    return means.withColumns({"dx": F.col("x") - F.lag("x").over(before), "dy": F.col("y") - F.lag("y").over(before)})


def proportions(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows and share in percent of each label."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(*keys)))


def plot_ranges(df: DataFrame, keys: list[str], x: str = "PC1", y: str = "PC2", pad: float = 0.05) -> DataFrame:
    """Extent of the positions with a margin."""
    span = df.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    dx, dy = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    return span.select(*keys, (F.col("x0") - dx).alias("x_min"), (F.col("x1") + dx).alias("x_max"), (F.col("y0") - dy).alias("y_min"), (F.col("y1") + dy).alias("y_max"))


def label_colours(labels: DataFrame, label: str) -> DataFrame:
    """A colour of the fixed list for each label in name order, starting again after the last."""
    names = labels.select(label).distinct()
    place = (F.row_number().over(W.orderBy(label)) - 1) % len(COLOURS)
    return names.withColumn("colour", F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (place + 1).cast("int")))


def visible_centres(centres: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The centres whose keys occur in a part of the rows."""
    return centres.join(rows.select(*keys).distinct(), keys, "left_semi")
