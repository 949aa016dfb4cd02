"""From texts and metadata to occurrence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphdrift.functions.text import contains_any, is_punctuated, occurrence_positions, reference_id, sentences, text_id, urn
from glyphdrift.functions.titles import period_categories, period_key


def chapters(metadata: DataFrame, dim: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """Metadata rows of known periods with their category, urn, reference and text id; unknown periods are left out."""
    known = period_categories(dim)
    if periods is not None:
        known = known.where(F.col("dim_category").isin(periods))
    rows = metadata.withColumn("period_key", period_key(F.col("from_dynasty_name"))).join(F.broadcast(known), "period_key")
    return rows.select(
        "title", "toptitle", F.col("from_dynasty_name").alias("dynasty"), F.col("dim_category").alias("dynasty_category"), "topurn",
        urn("topurn").alias("urn"), reference_id("topurn").alias("reference_id"), text_id("topurn", "title").alias("text_id"),
    )


def chapter_status(rows: DataFrame, texts: DataFrame, done: DataFrame) -> DataFrame:
    """Each chapter with its text and ``status``: checkpoint, not_found, no_punctuation or processed, in that order."""
    seen = done.select("text_id").distinct().withColumn("is_done", F.lit(True))
    joined = rows.join(seen, "text_id", "left").join(texts.select("urn", "text"), "urn", "left")
    status = (
        F.when(F.col("is_done"), "checkpoint").when(F.col("text").isNull(), "not_found").when(~is_punctuated("text"), "no_punctuation").otherwise("processed")
    )
    return joined.withColumn("status", status).drop("is_done")


def segmented(df: DataFrame, text: str) -> DataFrame:
    """One row for each sentence with ``sentence_index`` from 0 over all of the text's sentences."""
    return df.select("*", F.posexplode(sentences(text)).alias("sentence_index", "sentence"))


def occurrences(df: DataFrame, targets: list[str], text: str = "sentence") -> DataFrame:
    """One row for each occurrence of a target character: word and char_pos. Sentences without one are passed over."""
    found = df.where(contains_any(text, targets)).withColumn("word", F.explode(F.array(*[F.lit(t) for t in targets])))
    return found.select("*", F.explode(occurrence_positions(text, F.col("word"))).alias("char_pos"))


def status_counts(df: DataFrame) -> DataFrame:
    """Chapters by status."""
    return df.groupBy("status").agg(F.count("*").alias("n"))


def limited(column: Column, words: list[str]) -> Column:
    """Whether a record's word is wanted."""
    return column.isin(words)
