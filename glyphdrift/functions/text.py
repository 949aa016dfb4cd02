"""Text functions as Column expressions: normalising, segmenting, counting. No Python runs for any row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed before segmenting, sentence ends, and the marks that make a text punctuated.
DROPPED = "{}　●"
SENTENCE_ENDS = "。！？；"
GATE_MARKS = "。，、；：？！「」『』"
SPACE = r"(?U)^\s+|\s+$"

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(text), SPACE, "")


def normalised(text: Text, dropped: str = DROPPED) -> Column:
    """Without the characters that carry no text."""
    return F.translate(_col(text), dropped, "")


def sentences(text: Text, ends: str = SENTENCE_ENDS) -> Column:
    """Non-empty stripped sentences in order; null text gives null."""
    parts = F.split(normalised(text), rf"\n\n|[{ends}]")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_punctuated(text: Text, marks: str = GATE_MARKS) -> Column:
    """Whether any of the marks occurs."""
    return _col(text).rlike(f"[{marks}]")


def contains_any(text: Text, targets: Sequence[str]) -> Column:
    """Whether any target character occurs."""
    return _col(text).rlike("[" + "".join(targets) + "]")


def occurrence_positions(text: Text, target: Text) -> Column:
    """0-based code-point positions of a one-character target."""
    characters = F.split(_col(text), "")
    return F.filter(
        F.transform(characters, lambda c, i: F.when(c == _col(target), i)), lambda i: i.isNotNull()
    )


def overlap_length(a0: Text, a1: Text, b0: Text, b1: Text) -> Column:
    """Length shared by two half-open spans."""
    return F.greatest(F.lit(0), F.least(_col(a1), _col(b1)) - F.greatest(_col(a0), _col(b0)))


def urn(path: Text) -> Column:
    """The identifier after the last colon, without one leading ``wb``."""
    return F.regexp_replace(F.element_at(F.split(_col(path), ":"), -1), "^wb", "")


def member_urn(name: Text) -> Column:
    """The third underscore-separated part of an archive member's base name, without ``.json`` and leading ``wb``; else null."""
    base = F.regexp_replace(F.element_at(F.split(_col(name), "/"), -1), r"\.json$", "")
    return F.regexp_replace(F.try_element_at(F.split(base, "_"), F.lit(3)), "^wb", "")


def reference_id(path: Text) -> Column:
    """``ctext_`` and the first digit run of the path, else its identifier."""
    digits = F.regexp_extract(_col(path), r"\p{Nd}+", 0)
    return F.when(digits != "", F.concat(F.lit("ctext_"), digits)).otherwise(urn(path))


def text_id(path: Text, title: Text) -> Column:
    """Path and title as one key."""
    return F.concat_ws("_", _col(path), F.coalesce(_col(title), F.lit("")))


def distinct_ratio(text: Text) -> Column:
    """Distinct characters divided by characters; null for empty text."""
    return F.when(F.length(_col(text)) > 0, F.size(F.array_distinct(F.split(_col(text), ""))) / F.length(_col(text)))


def longest_run(text: Text) -> Column:
    """Length of the longest run of one character; 0 when no character is repeated."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"(?s)((.)\2+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def count_of(text: Text, character_class: str) -> Column:
    """How often a character of the class occurs."""
    return F.regexp_count(_col(text), F.lit(character_class))


def density(text: Text, character_class: str) -> Column:
    """Share of the characters that are of the class; null for empty text."""
    return F.when(F.length(_col(text)) > 0, count_of(text, character_class) / F.length(_col(text)))


def full_segments(text: Text, width: int = 10) -> Column:
    """Consecutive segments of ``width`` characters; the rest is left out."""
    n = F.length(_col(text))
    starts = F.sequence(F.lit(0), n - width, F.lit(width))
    return F.when(n >= width, F.transform(starts, lambda i: F.substring(_col(text), i + 1, F.lit(width)))).otherwise(
        F.array().cast("array<string>")
    )


def entropy(counts: Text) -> Column:
    """Shannon entropy in bits of an array of counts; 0 without counts."""
    total = F.aggregate(_col(counts), F.lit(0.0), lambda a, c: a + c)
    terms = F.aggregate(
        _col(counts), F.lit(0.0), lambda a, c: a - F.when(c > 0, c / total * F.log2(c / total)).otherwise(F.lit(0.0))
    )
    return F.when(total > 0, terms).otherwise(F.lit(0.0))
