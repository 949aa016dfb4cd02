"""Text functions and filters on sentences whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from glyphdrift.functions import text as T
from glyphdrift.functions.titles import fold_compat, period_key, plain_title
from glyphdrift.operators import quality

LONG = "".join(chr(0x4E00 + 7 * i) for i in range(501))


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("r")).first()["r"]


def test_segmenting(spark):
    assert one(spark, "天{地}。\n\n　人●；；道！", T.sentences("s")) == ["天地", "人", "道"]
    assert one(spark, "", T.sentences("s")) == []
    assert one(spark, None, T.sentences("s")) is None


def test_keys(spark):
    assert one(spark, "ctext:wb1001", T.urn("s")) == "1001"
    assert one(spark, "ctext:wb1001", T.reference_id("s")) == "ctext_1001"
    assert one(spark, "ctext:abc", T.reference_id("s")) == "abc"
    assert one(spark, "x/a_b_wb77.json", T.member_urn("s")) == "77"
    assert one(spark, "a_b.json", T.member_urn("s")) is None


def test_measures(spark):
    assert one(spark, "aab", T.distinct_ratio("s")) == pytest.approx(2 / 3)
    assert one(spark, "abc", T.longest_run("s")) == 0
    assert one(spark, "abbbc", T.longest_run("s")) == 3
    assert one(spark, "0123456789012345678901", T.full_segments("s")) == ["0123456789", "0123456789"]
    assert one(spark, "手足手", T.occurrence_positions("s", F.lit("手"))) == [0, 2]
    assert one(spark, "x", T.entropy(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1.0)
    assert one(spark, "x", T.overlap_length(F.lit(0), F.lit(4), F.lit(3), F.lit(9))) == 1


@pytest.mark.parametrize(
    ("title", "plain"),
    [
        ("《樂城類覽》", "樂城類覽"), ("樂城 類覽​", "樂城類覽"), ("樂城類覽 第二十卷", "樂城類覽"), ("樂城類覽（舊刻本）", "樂城類覽"),
        ("樂城類覽卷之七", "樂城類覽"), ("樂城類覽", "樂城類覽"), (None, "unknown"), ("　", "unknown"), ("N/A", "unknown"), ("卷一", "卷一"),
    ],
)
def test_plain_title(spark, title, plain):
    assert one(spark, title, plain_title(F.col("s"))) == plain


def test_period_key(spark):
    assert one(spark, " Southern  SONG", period_key(F.col("s"))) == "southern song"
    assert one(spark, " ", period_key(F.col("s"))) is None
    assert one(spark, "ＡＢ", fold_compat(F.col("s"))) == "AB"


CASES = [
    ("", "length_anomaly", None, "length_anomaly", "too_short"),
    ("手□足", "ocr_markers,unusual_chars,length_anomaly", "ocr_markers", "ocr_markers", "ocr_markers"),
    ("水水水水水清", "suspicious_patterns", "excessive_repetition", "suspicious_patterns", "suspicious_patterns"),
    ("水水水水清流", "", None, None, None),
    ("卷一第abc頁", "suspicious_patterns,unusual_chars", None, "suspicious_patterns", "suspicious_patterns"),
    ("123456年間事", "suspicious_patterns", None, "suspicious_patterns", "suspicious_patterns"),
    ("㐀天地玄黃", "unusual_chars", None, "unusual_chars", None),
    (LONG[:400], "", None, None, None),
    (LONG, "length_anomaly", "too_long", "length_anomaly", "too_long"),
]


@pytest.mark.parametrize(("s", "found", "conservative", "aggressive", "custom"), CASES)
def test_first_cleaning(spark, s, found, conservative, aggressive, custom):
    assert one(spark, s, F.array_join(quality.errors(F.col("s")), ",")) == found
    for mode, reason in (("conservative", conservative), ("aggressive", aggressive), ("custom", custom)):
        assert one(spark, s, quality.removal_reason(F.col("s"), mode)) == reason


@pytest.mark.parametrize(
    ("s", "failed"),
    [
        ("", "length,uniqueness,digits"), ("一二三四", "digits"), ("手手手手手手足", "uniqueness,repeat"), ("手足□相連", "invalid_chars"),
        ("。，。", "length"), ("。]", "length,patterns"), (None, "length,uniqueness,digits"),
    ],
)
def test_second_cleaning(spark, s, failed):
    assert one(spark, s, F.array_join(quality.failed_checks(F.col("s"), "normal"), ",")) == failed


def test_unknown_mode():
    with pytest.raises(ValueError):
        quality.removal_reason(F.lit("x"), "other")
