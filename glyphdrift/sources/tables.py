"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "title string, toptitle string, fromDynastyName string, topurn string"
OCCURRENCE = "word string, reference_id string, dynasty string, dynasty_category string, toptitle string, media string, sentence string, sentence_index int, char_pos int, occ_id string, vector array<float>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata CSV by header; other columns are not read."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = ("title", "toptitle", "fromDynastyName", "topurn")
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in names])


def read_json_lines(spark: SparkSession, path: str, schema: str = OCCURRENCE, first: int | None = None) -> DataFrame:
    """Records of JSON lines; malformed lines are left out. ``first`` keeps so many physical lines, bad ones counted."""
    if first is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lines = spark.read.text(path).limit(first)
    return lines.select(F.from_json("value", schema).alias("r"), "value").where("value IS NOT NULL AND try_parse_json(value) IS NOT NULL").select("r.*")


def read_bundle(spark: SparkSession, path: str, word: str | None = None) -> DataFrame:
    """Sampled or cleaned records by word and period; a given word reads its folder only. A missing folder is empty."""
    try:
        rows = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], OCCURRENCE)
    return rows if word is None else rows.where(F.col("word") == word)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Assignment CSV as text; a sentence that reads ``NA`` stays a sentence."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that spans lines."""
    return spark.read.option("multiLine", True).json(path)


def write_records(df: DataFrame, path: str, resume: bool = False, form: str = "json") -> None:
    """Records in folders by period and word; ``resume`` adds to what is there."""
    df.write.mode("append" if resume else "overwrite").partitionBy("dynasty_category", "word").format(form).save(path)


def write_filtered(df: DataFrame, keep: str, path: str, dry_run: bool = False) -> DataFrame:
    """Write the rows that stay, unchanged; give kept and removed counts. A dry run only counts."""
    if not dry_run:
        df.where(keep).write.mode("overwrite").parquet(path)
    return df.agg(F.count("*").alias("total"), F.count_if(F.expr(keep)).alias("kept"))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV in order with a header; null is empty."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str, limit: int = 100_000) -> None:
    """A small table as one CSV file with a byte-order mark, for spreadsheets. More than ``limit`` rows are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them with write_csv")
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        writer.writerows([["" if v is None else v for v in r] for r in rows])


def write_stats(df: DataFrame, path: str) -> None:
    """Statistics as JSON lines."""
    df.write.mode("overwrite").json(path)


def append_processed(df: DataFrame, path: str) -> None:
    """Add text ids to the table of processed texts."""
    df.select("text_id").write.mode("append").parquet(path)


def processed(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the texts processed so far; none if the table is missing."""
    try:
        return spark.read.parquet(path).select("text_id").distinct()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "text_id string")


def write_manifest(path: str, **values: object) -> None:
    """A run's parameters or results as a JSON file, on any file system that Spark knows."""
    text = json.dumps(values, ensure_ascii=False, indent=2, default=str)
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def markdown_table(df: DataFrame, limit: int = 500) -> str:
    """A small table as Markdown. More than ``limit`` rows are refused; ``reports.markdown`` writes tables of any size."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them with reports.markdown")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows)])
