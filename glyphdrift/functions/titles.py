"""Plain work titles, normalised period names and the work (category, title) of an occurrence record.

Everything is a Column expression, so the whole normalisation stays inside code generation.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_TITLE = "unknown"

#: Blocks whose members have a one-character compatibility form: compatibility ideographs, radicals, full width.
COMPAT_BLOCKS = ((0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFF01, 0xFF5E), (0x2F800, 0x2FA1F))

INVISIBLE = r"[\p{Cf}\p{Cc}\p{Z}\s]+"
EDITION_NOTE = r"[(〔\[【（][^)〕\]】）]*[本版刻鈔抄刊印][)〕\]】）]$"
BRACKETS = r"[《》〈〉【】「」『』〔〕〖〗\[\]()（）“”\"]+"
NUMERAL = "[〇零一二三四五六七八九十百千廿卅0-9]+"
VOLUME_NOTE = f"(第{NUMERAL}[卷冊册集篇輯部回章]|{NUMERAL}[卷冊册]|卷之?{NUMERAL}|卷[上中下首末])$"


@cache
def compat_table() -> tuple[str, str]:
    """From and to strings for ``translate``, made from the Unicode database."""
    pairs = [
        (chr(code), form)
        for low, high in COMPAT_BLOCKS
        for code in range(low, high + 1)
        if len(form := unicodedata.normalize("NFKC", chr(code))) == 1 and form != chr(code)
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_compat(text: Column) -> Column:
    """Replace compatibility forms of single characters by the ordinary character."""
    return F.translate(text, *compat_table())


def plain_title(title: Column) -> Column:
    """The title without spelling variants; null, blank or N/A gives ``unknown``."""
    bare = F.regexp_replace(fold_compat(title), INVISIBLE, "")
    noted = F.regexp_replace(bare, EDITION_NOTE, "")
    inner = F.regexp_replace(noted, BRACKETS, "")
    short = F.regexp_replace(inner, VOLUME_NOTE, "")
    plain = F.when(short == "", inner).otherwise(short)
    return F.when(plain.isNull() | (plain == "") | (F.upper(plain) == "N/A"), UNKNOWN_TITLE).otherwise(plain)


def period_key(name: Column) -> Column:
    """A raw period name without case and spacing differences; blank gives null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(fold_compat(name), INVISIBLE, " "))), F.lit(""))


def urn_number(urn: Column) -> Column:
    """The first run of digits, null when there is none."""
    return F.nullif(F.regexp_extract(urn, r"\p{Nd}+", 0), F.lit(""))


def period_categories(dim: DataFrame) -> DataFrame:
    """Fixed small dimension: normalised period name to category."""
    return dim.groupBy(period_key(F.col("dynasty_name")).alias("period_key")).agg(
        F.min("dynasty_category").alias("dim_category")
    )


def metadata_categories(metadata: DataFrame, dim: DataFrame) -> DataFrame:
    """One category for each reference number: the most frequent of its metadata rows, ties to the smallest.

    Both inputs are aggregated before they are joined, so a reference with many chapter rows costs one row.
    """
    rows = metadata.groupBy(
        urn_number(F.col("topurn")).alias("urn_number"), period_key(F.col("from_dynasty_name")).alias("period_key")
    ).agg(F.count("*").alias("n"))
    named = rows.join(F.broadcast(period_categories(dim)), "period_key").groupBy("urn_number", "dim_category")
    return (
        named.agg(F.sum("n").alias("n"))
        .where(F.col("urn_number").isNotNull() & F.col("dim_category").isNotNull())
        .groupBy("urn_number")
        .agg(F.min(F.struct((-F.col("n")).alias("less"), "dim_category")).alias("best"))
        .select("urn_number", F.col("best.dim_category").alias("meta_category"))
    )


def with_work(rows: DataFrame, metadata: DataFrame, dim: DataFrame, spread: str | None = None) -> DataFrame:
    """Add ``work_category`` and ``work_title``; both names replace columns of the same name.

    The category is the row's own, else that of its period name, else that of its reference number in the
    metadata, else null. ``spread`` names a column by whose hash the rows that need no metadata are spread over
    the tasks of the metadata join, so that they don't meet at one null key.
    """
    named = rows.withColumn("work_title", plain_title(F.col("toptitle"))).withColumn(
        "period_key", period_key(F.col("dynasty"))
    )
    named = named.join(F.broadcast(period_categories(dim)), "period_key", "left").withColumn(
        "own_category", F.coalesce(F.nullif(F.trim("dynasty_category"), F.lit("")), "dim_category")
    )
    other = F.lit("-") if spread is None else F.concat(F.lit("-"), F.pmod(F.hash(spread), F.lit(997)))
    keyed = named.withColumn(
        "urn_number",
        F.when(F.col("own_category").isNull(), F.coalesce(urn_number(F.col("reference_id")), other)).otherwise(other),
    )
    joined = keyed.join(metadata_categories(metadata, dim), "urn_number", "left")
    return joined.withColumn("work_category", F.coalesce("own_category", "meta_category")).drop(
        "period_key", "dim_category", "own_category", "urn_number", "meta_category"
    )
