"""Card building on literal rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from noticeengine.operators import cards



def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,filename,want",
    [
        ("표\n● 여름 행사\n둘째", "a.xlsx", "여름 행사"),
        ("### 시트: 재고확인\n첫째", "a.xlsx", "기본"),
        ("### 시트: 가격표\n| a |", "a.xlsx", "가격표"),
        ("\n| a |\nNo.\ncol_1 x\n첫 줄", "a.xlsx", "첫 줄"),
        ("", "안내.pptx", "안내"),
        (None, None, "기본"),
    ],
)
def test_headline(spark, text, filename, want):
    assert value(spark, cards.headline(F.lit(text).cast("string"), F.lit("기본"), F.lit(filename).cast("string"))) == want


def test_text_roles(spark):
    roster = F.array(*(F.lit(r) for r in ("생활주방", "IT", "공통")))
    assert value(spark, cards.text_roles(F.lit("[IT] 선풍기 광고"), roster)) == ["생활주방", "공통", "IT"]
    assert value(spark, cards.text_roles(F.lit(None).cast("string"), roster)) == []


def test_gates(spark):
    assert value(spark, cards.usable(F.lit("가" * 80))) is True
    assert value(spark, cards.usable(F.lit("가" * 80 + "프롬프트"))) is False
    assert value(spark, cards.usable(F.lit(None).cast("string"))) is False
    assert value(spark, cards.noisy(F.lit("| col_1 | col_2 |\n| 1 | 2 |"), F.lit("r"), F.lit("f"))) is True
    assert value(spark, cards.noisy(F.lit("| 모델명 | col_2 |"), F.lit("r"), F.lit("f"))) is False


def test_body_cards(spark):
    body = "에어컨 설치 안내입니다. " * 8
    posts = spark.createDataFrame([(1, "6월 12일부터 변경 안내", body, date(2026, 6, 1)), (2, "짧음", "짧은 글", date(2026, 6, 1)), (3, "덮임", body, date(2026, 6, 1))], "post_id long, title string, body string, posted_date date")
    lookup = spark.createDataFrame([("NO-CODE1", "IT", 0)], "code string, role string, ord int")
    roster = F.array(F.lit("대형가전1"), F.lit("대형가전2"))
    got = cards.body_cards(posts, lookup, roster, spark.createDataFrame([(3,)], "post_id long")).orderBy("role").collect()
    assert [(r["post_id"], r["role"], r["source_ref"]) for r in got] == [(1, "대형가전1", "1#body"), (1, "대형가전2", "1#body")]
    assert got[0]["temporal"]["notice_kind"] == "정책" and got[0]["temporal"]["effective_date"] == date(2026, 6, 12)
    assert len({r["id"] for r in got}) == 2


def test_summary_of_tables(spark):
    table = F.struct(F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(*(F.array(F.lit(str(i)), F.lit("x")) for i in range(9))).alias("rows"))
    got = value(spark, cards.tables_summary(F.array(table, table, table)))
    assert got.split("\n") == ["a | b", *(f"{i} | x" for i in range(5))] * 2


def test_samples_repeat(spark):
    rows = spark.range(50)
    a, b, c = (sorted(r["id"] for r in cards.sample_snippet(rows, s, 5).collect()) for s in (1, 1, 2))
    assert a == b != c
