"""Rule-based sentence filters: damage detection in three modes, and six checks at four levels, with their reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.functions.text import count_of, distinct_ratio, full_segments, longest_run

# Fixed values of the detectors and checks.
MARKERS = "□〇○●◎◇◆※☆★■▪▲△▽"
ALLOWED = "，。、；：！？「」『』（）〈〉《》【】…—·"
PUNCTUATION = "[。，、；：？！「」『』（）《》〈〉【】〔〕…—·]"
INVALID = "[�□▪■●○◎★☆◇◆△▲▽▼]"
DIGITS = "[0-9０-９一二三四五六七八九十百千萬億兆壹貳參肆伍陸柒捌玖拾佰仟]"
RARE = r"[\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]"
COMMON = (
    "的一是不了人我有他這為之大來以個中上們到說國和地也子時道出而要於就下得可你年生自會那後能對著事其裡所去行過家十用發天如然作方成者"
    "多日都三小軍二無同麼經法當起與好看學進種將還分此心前面又定見只主沒公從"
)
SAME_FIVE = r"([^\n])\1{4,}"
SHORT, LONG = 5, 500
ERROR_TYPES = ("ocr_markers", "suspicious_patterns", "unusual_chars", "length_anomaly")
CHECKS = ("length", "uniqueness", "repeat", "invalid_chars", "digits", "patterns")


@dataclass(frozen=True)
class Level:
    """Limits of one cleaning level."""

    min_length: int
    max_length: int
    min_distinct: float
    max_run: int
    max_digits: float
    min_punctuation: float


# Fixed values of the levels; the punctuation limit is not applied unless asked for.
LEVELS = {
    "mild": Level(3, 300, 0.30, 7, 0.25, 0.010),
    "normal": Level(4, 200, 0.35, 5, 0.20, 0.015),
    "aggressive": Level(5, 150, 0.40, 4, 0.15, 0.020),
    "ultra": Level(5, 120, 0.45, 3, 0.10, 0.025),
}


def markers_found(s: Column) -> Column:
    """The damage markers of a sentence in order, with repeats."""
    return F.regexp_extract_all(s, F.lit(f"([{MARKERS}])"), F.lit(1))


def unusual_found(s: Column) -> Column:
    """Characters that are neither ordinary ideographs, allowed punctuation, digits nor white space."""
    return F.regexp_extract_all(s, F.lit(rf"(?U)([^\x{{4E00}}-\x{{9FFF}}{ALLOWED}\p{{Nd}}²³¹⁰-⁹₀-₉①-⑨\s])"), F.lit(1))


def is_suspicious(s: Column) -> Column:
    """Five equal characters in a row, two Latin letters or six digits."""
    return s.rlike(SAME_FIVE) | s.rlike("[A-Za-z]{2,}") | s.rlike(r"\p{Nd}{6,}")


def errors(s: Column) -> Column:
    """Detected error types of a sentence in their fixed order. Null counts as empty."""
    s = F.coalesce(s, F.lit(""))
    hits = (F.size(markers_found(s)) > 0, is_suspicious(s), F.size(unusual_found(s)) > 0, ~F.length(s).between(SHORT, LONG))
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, name in zip(hits, ERROR_TYPES)]))


def removal_reason(s: Column, mode: str, long_limit: int = LONG) -> Column:
    """Why ``conservative``, ``aggressive`` or ``custom`` cleaning removes a sentence; null when it stays.

    ``long_limit`` is what the length detector lets through (500); the documented 300 and 200 can be passed instead.
    """
    s = F.coalesce(s, F.lit(""))
    marked, too_long = s.rlike(f"[{MARKERS}]"), F.length(s) > long_limit
    if mode == "aggressive":
        return F.try_element_at(errors(s), F.lit(1))
    if mode == "conservative":
        return F.when(marked, "ocr_markers").when(too_long, "too_long").when(s.rlike(SAME_FIVE), "excessive_repetition")
    if mode == "custom":
        return F.when(marked, "ocr_markers").when(F.length(s) < SHORT, "too_short").when(too_long, "too_long").when(is_suspicious(s), "suspicious_patterns")
    raise ValueError(f"unknown mode {mode}")


def abnormal_pattern(s: Column, intended_punctuation: bool = False) -> Column:
    """The first abnormal pattern of a sentence, null if none.

    The all-punctuation test follows the established behaviour (one mark, then closing brackets only);
    ``intended_punctuation`` tests for sentences of marks alone.
    """
    n = F.length(s)
    only_marks = f"^{PUNCTUATION}+$" if intended_punctuation else f"^[\\[{PUNCTUATION[1:-1]}]\\]+$"
    segments = full_segments(s)
    poor = F.size(F.filter(segments, lambda seg: count_of(seg, f"[{COMMON}]") == 0))
    return (
        F.when(s.rlike(only_marks), "all_punctuation")
        .when(count_of(s, " ") > n * 0.1, "excessive_whitespace")
        .when(count_of(s, r"([^\n])\1{2,}") >= 3, "abnormal_repeat_pattern")
        .when((n > 150) & ~s.rlike(PUNCTUATION), "overlong_no_punctuation")
        .when((n >= 10) & (poor > F.size(segments) * 0.8), "low_common_chars")
        .when((n > 0) & (count_of(s, RARE) / n > 0.3), "excessive_rare_chars")
    )


def failed_checks(s: Column, level: str | Level, punctuation: bool = False) -> Column:
    """Names of the failed checks in order. Null counts as empty; ``punctuation`` adds the optional density check."""
    limits = LEVELS[level] if isinstance(level, str) else level
    s = F.coalesce(s, F.lit(""))
    n = F.length(s)
    failed = {
        "length": ~n.between(limits.min_length, limits.max_length),
        "uniqueness": F.coalesce(distinct_ratio(s) < limits.min_distinct, F.lit(True)),
        "repeat": longest_run(s) > limits.max_run,
        "invalid_chars": s.rlike(INVALID),
        "digits": (n == 0) | (count_of(s, DIGITS) / n > limits.max_digits),
        "patterns": abnormal_pattern(s).isNotNull(),
    }
    if punctuation:
        failed["punctuation"] = (n == 0) | (count_of(s, PUNCTUATION) / n < limits.min_punctuation)
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in failed.items()]))


def quality_score(failed: Column, checks: int = len(CHECKS)) -> Column:
    """Share of passed checks; a sentence is kept only at 1."""
    return (F.lit(checks) - F.size(failed)) / F.lit(checks)


def removal_totals(df: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Rows, kept and removed rows per key and overall (null keys), by one rollup."""
    return df.rollup(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col(reason).isNull()).alias("kept"), F.count(reason).alias("removed")
    )


def reason_counts(df: DataFrame, keys: list[str], reasons: str) -> DataFrame:
    """How often each reason of an array column occurs per key; a row counts once for each of its reasons."""
    return df.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def first_examples(df: DataFrame, reason: str, order: list[str], count: int = 10) -> DataFrame:
    """The first ``count`` rows of each reason in the given order."""
    place = W.partitionBy(reason).orderBy(*order)
    return df.where(F.col(reason).isNotNull()).withColumn("place", F.row_number().over(place)).where(F.col("place") <= count)
