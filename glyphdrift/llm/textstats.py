"""Per-document text statistics, their distribution from mergeable sketches, and flags for junk."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from glyphdrift.operators.latest import latest_rows
from glyphdrift.session import materialise

#: Punctuation of running Chinese text, and marks that stand for one lost character.
PROSE_MARKS = "。，、；：？！「」『』（）《》〈〉…—·﹑"
LOST_MARKS = "□〇○●◎◇◆※☆★■▪▲△▽�"

WORD = rf"[\p{{L}}\p{{M}}\p{{N}}{LOST_MARKS}]"


#: The end of a list entry that is a number with a measure.
COUNTED = rf"[〇零一二三四五六七八九十百千0-9][卷冊册篇本部種斗升石斤兩文匹](?!{WORD})"

#: A character beside Han letters and marks of prose: texts without one need no count of markup, cells, rare, foreign, lost or other characters.
ODD = rf"[^\x{{4E00}}-\x{{9FEF}}{PROSE_MARKS.replace('·', '')}]"

#: Statistics that junk raises, and what one event (a character, word, gap between words, tag, cell) adds to each: one by the named count.
RAISED = {
    "n_markup": None, "n_cells": None, "longest_run": None, "rare_share": "n_body", "latin1_share": "n_chars", "ascii_share": "n_chars",
    "lost_share": "n_chars", "symbol_share": "n_chars", "list_share": "n_gaps", "counted_share": "n_words",
}
Z_CUT = 3.5  # robust z-scores beyond are tails
KLL_SIZE = 400


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def frequent_characters(common: DataFrame, column: str = "ch") -> str:
    """The fixed list of frequent characters as one string, each once, fit for a character class. A list of characters is bounded by the character set."""
    rows = common.select(column).where(F.length(column) == 1).distinct().collect()
    return "".join(sorted(re.escape(r[0]) for r in rows))


def tail_statistics(text: Column) -> Column:
    """The struct of the statistics in ``RAISED`` with their counts; null text counts as empty.

    A "word" is a run of letters and digits, which for Chinese is a clause or a list entry.
    """
    s = F.coalesce(text, F.lit(""))
    n = F.length(s)
    body = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]+", ""))
    words = _count(s, f"{WORD}+")
    run = F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"(?s)((.)\2{3,})"), F.lit(1)), lambda r: F.length(r)))
    is_odd = s.rlike(ODD)
    odd = lambda pattern: F.when(is_odd, _count(s, pattern)).otherwise(F.lit(0))
    return F.struct(
        words.alias("n_words"),
        F.greatest(words - 1, F.lit(0)).alias("n_gaps"),
        n.alias("n_chars"),
        body.alias("n_body"),
        odd(r"</?[A-Za-z][^<>]*>|&#?\w+;|<!--").alias("n_markup"),
        odd(r"[\t|｜]|[\x{3000} ]{2,}").alias("n_cells"),
        _share(odd(r"[\x{3400}-\x{4DBF}\x{20000}-\x{3FFFF}\x{E000}-\x{F8FF}]"), body).alias("rare_share"),
        _share(odd(r"[\x{80}-\x{24F}]"), n).alias("latin1_share"),
        _share(odd(r"[A-Za-z0-9]"), n).alias("ascii_share"),
        _share(odd(f"[{LOST_MARKS}]"), n).alias("lost_share"),
        _share(odd(rf"[^\p{{L}}\p{{N}}\s\p{{Z}}{PROSE_MARKS}]"), n).alias("symbol_share"),
        F.when(s.rlike(r"(?s)(.)\1{3,}"), run).otherwise(F.lit(0)).alias("longest_run"),
        F.when(body < 3.8 * words, 1 - _count(s, f"{WORD}{{5,}}") / words).otherwise(F.lit(0.0)).alias("list_share"),
        _share(_count(s, COUNTED), words).alias("counted_share"),
    )


def with_statistics(df: DataFrame, text: str, common: DataFrame | None = None) -> DataFrame:
    """Add ``stats``, a struct of text statistics by built-in functions over the whole text.

    Besides those of ``tail_statistics``: mean and longest word length, lines, shares of lines that end in punctuation, of
    enumeration commas, of distinct and of common characters (from the fixed list ``common``). Null text gives the statistics of empty text: counts and shares 0. ``stats`` replaces a column of that name.
    """
    frequent = "" if common is None else frequent_characters(common)
    s = F.coalesce(F.col(text), F.lit(""))
    n, body, words, lines = F.length(s), _count(s, r"[\p{L}\p{N}]"), _count(s, f"{WORD}+"), _count(s, r"[^\n]*\S[^\n]*")
    longest = F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"({WORD}+)"), F.lit(1)), lambda w: F.length(w)))
    more = {
        "mean_word_length": _share(body, words),
        "longest_word": F.coalesce(longest, F.lit(0)),
        "distinct_share": _share(F.size(F.array_distinct(F.split(s, ""))), n),
        "common_share": _share(_count(s, f"[{frequent}]") if frequent else F.lit(0), body),
        "n_lines": lines,
        "lines_punct_share": _share(_count(s, r"(?m)\p{P}\s*$"), lines),
        "comma_list_share": _share(_count(s, "、"), _count(s, f"[{PROSE_MARKS}]")),
    }
    rest = df.withColumn("stats", tail_statistics(F.col(text)))
    return rest.withColumn("stats", F.struct("stats.*", *[c.alias(k) for k, c in more.items()]))


def distribution(stats: DataFrame, names: list[str], group: str | None = None) -> DataFrame:
    """Median and robust scale (interquartile range / 1.349) of each statistic per group, from KLL sketches.

    Sketches are built on the map side and merged, so a group that holds most rows costs no more than others.
    One row for each group with ``q_<name>`` structs (low, median, high, scale); null values are left out.
    """
    sketches = [F.kll_sketch_agg_double(F.col(f"stats.{n}").cast("double"), F.lit(KLL_SIZE)).alias(f"s_{n}") for n in names]
    rows = stats.groupBy(F.lit("all").alias("group") if group is None else F.col(group).alias("group")).agg(*sketches)
    at = lambda n, q: F.kll_sketch_get_quantile_double(F.col(f"s_{n}"), F.lit(q))
    return rows.select(
        "group",
        *[F.col(f"s_{n}") for n in names],
        *[
            F.struct(
                at(n, 0.25).alias("low"), at(n, 0.5).alias("median"), at(n, 0.75).alias("high"), ((at(n, 0.75) - at(n, 0.25)) / 1.349).alias("scale")
            ).alias(f"q_{n}")
            for n in names
        ],
    )


MOST_LANGUAGES = 10_000  # rows of centres and scales that are broadcast; more are joined by a shuffle


def centres(stats: DataFrame, language: str | None = None) -> DataFrame:
    """(language, centres): median, robust scale and upper quartile of each tail statistic and unit per language, as a struct of structs (m, s, h)."""
    names = [*RAISED, *dict.fromkeys(u for u in RAISED.values() if u)]
    rows = distribution(stats, names, language)
    return rows.select(F.col("group").alias("language"), F.struct(*[F.struct(F.col(f"q_{n}.median").alias("m"), F.col(f"q_{n}.scale").alias("s"), F.col(f"q_{n}.high").alias("h")).alias(n) for n in names]).alias("centres"))


def tails_hit(stats: str, centre: Callable[[str, str], Column]) -> Column:
    """Names of the statistics in whose tails a text lies; ``centre`` gives the median ("m"), scale ("s") and upper quartile ("h") of each.

    The scale of a statistic is that of its distribution, but no less than what one event adds in this text, or in one
    of twice the upper quartile of lengths if this is longer: where most texts have none, a single damaged character or list entry is no
    tail, four of them are.
    """

    def z(name: str, unit: str | None) -> Column:
        one = F.lit(1.0) if unit is None else 1 / F.greatest(F.least(F.col(f"{stats}.{unit}"), 2 * centre(unit, "h")), F.lit(1.0))
        return (F.col(f"{stats}.{name}") - centre(name, "m")) / F.greatest(centre(name, "s"), one)

    return F.array_compact(F.array(*[F.when(z(n, u) > Z_CUT, F.lit(n)) for n, u in RAISED.items()]))


def junk_cuts(stats: DataFrame) -> Row | None:
    """The one row of ``centres`` over all of ``stats``; None without rows."""
    return centres(stats).first()


def _of_row(row: Row) -> Callable[[str, str], Column]:
    return lambda name, part: F.lit(float(row["centres"][name][part]))


def with_tail_flags(df: DataFrame, text: str, language: str | None = None) -> DataFrame:
    """Add ``stats`` and ``tails`` (names of the statistics in whose tails a text lies, empty for natural text); both replace like-named columns.

    Each language has its own sketches, null being one of them; without ``language`` all texts are of one. Statistics
    are checkpointed between the sketch and its use, so each text is read once. Null or empty text is in no tail.
    """
    rows = materialise(df.withColumn("stats", tail_statistics(F.col(text))))
    if language is None:
        row = junk_cuts(rows)
        return rows.withColumn("tails", F.array().cast("array<string>") if row is None else tails_hit("stats", _of_row(row)))
    table = materialise(centres(rows, language).withColumnRenamed("language", "__language"))
    joined = rows.join(F.broadcast(table) if table.count() <= MOST_LANGUAGES else table, F.col(language).eqNullSafe(F.col("__language")))
    return joined.withColumn("tails", tails_hit("stats", lambda name, part: F.col(f"centres.{name}.{part}"))).drop("__language", "centres")


def no_junk(df: DataFrame, stats: str) -> DataFrame:
    """The rows whose statistics lie in no tail of their distribution over all rows."""
    row = junk_cuts(df)
    return df if row is None else df.where(F.size(tails_hit(stats, _of_row(row))) == 0)


def percentiles(stats: DataFrame, names: list[str], group: str) -> DataFrame:
    """Per group and statistic its 1, 5, 25, 50, 75, 95 and 99 % quantiles from the sketches: group, statistic, quantiles."""
    points = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    rows = distribution(stats, names, group)
    at = lambda n: F.array(*[F.kll_sketch_get_quantile_double(F.col(f"s_{n}"), F.lit(q)) for q in points])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), at(n).alias("quantiles")) for n in names])).alias("row")
    return rows.select("group", each).select("group", "row.statistic", "row.quantiles")


def junk_sentences(occurrences: DataFrame) -> DataFrame:
    """Ids of the records whose sentence is a list, a table or debris (problem 3). All sentences are one language."""
    rows = latest_rows(occurrences, ["sentence"]).select("occ_id", "sentence")
    return with_tail_flags(rows, "sentence").where(F.size("tails") > 0).select("occ_id")
