"""Text, code, date and brand functions on literal rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from noticeengine.functions import brands, codes, dates, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("token,stem", [("냉장고는", "냉장고"), ("세탁기에서는", "세탁기"), ("가는", "가는"), ("V8100", "V8100"), ("노트북으로", "노트북"), ("", "")])
def test_strip_particle(spark, token, stem):
    assert one(spark, text.strip_particle(F.col("t")), t=token) == stem


def test_tokens_come_with_their_stems(spark):
    assert one(spark, text.tokenize(F.col("t")), t="냉장고는 A 좋은 TV") == ["냉장고는", "냉장고", "좋은", "tv"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []


def test_question_keywords(spark):
    assert one(spark, text.question_keywords(F.col("q")), q="냉장고는 언제까지 할인 하나요 냉장고 판촉을 알려줘") == ["냉장고", "할인", "판촉"]


def test_expand_keywords(spark):
    assert one(spark, text.expand_keywords(F.array(F.lit("냉장고는"), F.lit("LG"), F.lit("lg")))) == ["냉장고는", "냉장고", "LG"]


def test_title(spark):
    assert one(spark, text.normalize_title(F.col("t")), t="[공지]  여름  판촉 (필독)") == "여름 판촉"
    assert one(spark, text.title_anchors(F.col("t")), t="[긴급] 여름 판촉 안내") == ["여름"]


@pytest.mark.parametrize(
    "t,expected",
    [
        ("PLX-MCK02PDB and CBT-LFF32W", ["PLX-MCK02PDB", "CBT-LFF32W"]),
        ("INS-FAN(STAND), CT-OPTION-MOLD", ["INS-FAN(STAND)", "CT-OPTION", "CT-OPTION-MOLD"]),
        ("guide BD-N310P.PNG", ["BD-N310P"]),
        ("nothing", []),
        (None, []),
    ],
)
def test_product_codes(spark, t, expected):
    assert one(spark, codes.product_codes(F.lit(t).cast("string"))) == expected


def test_skus(spark):
    assert one(spark, codes.model_skus(F.col("t")), t="v8100_bk (J)ABC_12 v8100_BK") == ["V8100_BK", "ABC_12"]


@pytest.mark.parametrize(
    "t,start,end",
    [
        ("2026.06.01~2026.06.30", date(2026, 6, 1), date(2026, 6, 30)),
        ("6/1~6/30", date(2026, 6, 1), date(2026, 6, 30)),
        ("6/5~8", date(2026, 6, 5), date(2026, 6, 8)),
        ("2/30~2/31 2026-03-01", date(2026, 3, 1), None),
        ("none", None, None),
    ],
)
def test_validity(spark, t, start, end):
    got = one(spark, dates.validity_range(F.col("t"), F.lit(2026)), t=t)
    assert (got["from"], got["to"]) == (start, end) if got else start is None


def test_two_windows(spark):
    got = one(spark, dates.all_validity_ranges(F.col("t"), F.lit(2026)), t="6/5~8, 6/12~15")
    assert [(w["from"].day, w["to"].day) for w in got] == [(5, 8), (12, 15)]


@pytest.mark.parametrize("t,day", [("6월 12일부터 변경", date(2026, 6, 12)), ("시행일: 2026.07.01", date(2026, 7, 1)), ("6월 3일 행사", None), ("6월 3일 적용", date(2026, 6, 3)), ("13월 40일부터", None)])
def test_effective(spark, t, day):
    assert one(spark, dates.effective_date(F.col("t"), F.lit(2026)), t=t) == day


def test_table_windows(spark):
    columns = F.array(F.lit("품목"), F.lit("행사 기간"))
    rows = F.array(F.array(F.lit("a"), F.lit("6/20~22")), F.array(F.lit("b"), F.lit("6/5~8")), F.array(F.lit("c"), F.lit("-")))
    got = one(spark, dates.table_windows(columns, rows, F.lit(2026)))
    assert [w["from"].day for w in got] == [5, 20]
    assert one(spark, dates.table_windows(F.array(F.lit("x")), rows, F.lit(2026))) == []


def test_brands(spark):
    tags = brands.card_brands(F.col("t"))
    assert one(spark, brands.requested_brands(F.col("t")), t="플럭스 냉장고") == ["PLUX"]
    assert one(spark, tags, t="LG/삼성 행사") == ["삼성", "LG"]
    assert one(spark, tags, t="PLX-100") == ["PLUX"]
    assert one(spark, tags, t="etc") == ["미분류"]
    assert one(spark, brands.compatible(tags, F.array(F.lit("삼성"))), t="PLX-100") is False
    assert one(spark, brands.compatible(tags, F.array(F.lit("삼성"))), t="LG/삼성") is True
    assert one(spark, brands.display_title(F.lit("일반"), F.lit("여름 판촉"))) == "여름 판촉"
