"""Brand recognition in questions and cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alias and label, in the order in which labels are reported.
ALIASES = [
    ("삼성전자", "삼성"), ("삼성", "삼성"), ("엘지", "LG"), ("lg", "LG"), ("위니아딤채", "위니아"), ("위니아", "위니아"), ("쿠쿠", "쿠쿠"),
    ("하이얼", "하이얼"), ("대우", "대우"), ("tcl", "TCL"), ("샤프", "샤프"), ("미닉스", "미닉스"), ("필립스", "필립스"), ("다이슨", "다이슨"),
    ("샤크", "샤크"), ("드리미", "드리미"), ("보스", "BOSE"), ("bose", "BOSE"), ("애플", "애플"), ("apple", "애플"), ("마이디어", "마이디어"),
    ("플럭스", "PLUX"), ("plux", "PLUX"), ("하이마트 pb", "PLUX"), ("pb", "PLUX"),
]
# Marks of the own brand, headlines that say nothing, and the tag of unknown brands.
OWN_MARKS = ["plux", "플럭스", "plx-", "하이마트 pb", "[pb]"]
GENERIC_HEADLINES = ["일반", "벽걸이", "값정리", "sheet1", "구독내역조회", "벽걸이형"]
OWN, UNKNOWN = "PLUX", "미분류"
NO_TITLE = "(제목 없음)"


def _found(text: Column, aliases: list[tuple[str, str]]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(a)), F.lit(label)) for a, label in aliases))))


def requested_brands(question: Column) -> Column:
    """Labels of the aliases in a question."""
    return _found(F.lower(F.coalesce(question, F.lit(""))), ALIASES)


def card_brands(*parts: Column) -> Column:
    """Brand tags of a card's texts: the own brand first, UNKNOWN when there is none."""
    text = F.lower(F.array_join(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), " "))
    own = F.when(text.rlike("|".join(m.replace("[", r"\[").replace("]", r"\]") for m in OWN_MARKS)), F.lit(OWN))
    makers = _found(text, [(a, label) for a, label in ALIASES if label != OWN])
    tags = F.array_distinct(F.concat(F.array_compact(F.array(own)), makers))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(UNKNOWN)))


def compatible(tags: Column, requested: Column) -> Column:
    """Whether a card answers for the requested brands: own-brand questions take own-brand cards only, others leave out cards of the own brand alone."""
    known = F.array_except(tags, F.array(F.lit(UNKNOWN)))
    only_own = F.array(F.lit(OWN))
    meets = F.arrays_overlap(known, requested)
    return (
        F.when(F.size(requested) == 0, True)
        .when(F.size(known) == 0, False)
        .when(requested == only_own, F.array_contains(known, OWN))
        .when(F.array_contains(requested, OWN), meets)
        .when(known == only_own, False)
        .otherwise(meets)
    )


def display_title(headline: Column, post_title: Column) -> Column:
    """The post's title, with the headline unless that is generic, short or part of it."""
    h, t = F.trim(F.coalesce(headline, F.lit(""))), F.trim(F.coalesce(post_title, F.lit("")))
    return F.when(t == "", F.when(h == "", NO_TITLE).otherwise(h)).when((h == "") | h.isin(*GENERIC_HEADLINES) | (F.length(h) <= 4) | F.contains(t, h), t).otherwise(F.concat(t, F.lit(" / "), h))
