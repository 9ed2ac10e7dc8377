"""Text functions: Korean particle stripping, tokens, keywords, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

# Particles, longest first.
PARTICLES = [
    "에서는", "에서도", "으로는", "으로도", "까지는", "까지도", "부터는",
    "에서", "에게", "께서", "부터", "까지", "으로", "이나", "이랑", "이며",
    "조차", "처럼", "마다", "밖에", "보다", "하고", "에는", "에도", "로는",
    "와의", "과의", "이라", "인지",
    "은", "는", "이", "가", "을", "를", "의", "에", "도", "만", "로",
    "와", "과", "랑", "나", "요",
]

# Question words and fillers.
QUESTION_STOPWORDS = [
    "언제", "언제야", "언제까지", "언제부터", "어디", "어디서", "어디에",
    "어떻게", "어떡해", "무엇", "무엇을", "뭐", "뭐야", "뭔가요", "뭐예요",
    "뭐에요", "무슨", "어떤", "어느", "왜", "누가", "누구", "몇",
    "알려줘", "알려줘요", "알려주세요", "알려주실", "해주세요", "해줘",
    "주세요", "궁금합니다", "궁금해요", "궁금", "설명해줘", "설명",
    "있나요", "있어요", "있는지", "있습니까", "인가요", "인가", "일까요",
    "하나요", "합니까", "되나요", "됐나요", "됩니까", "되는지",
    "관련", "관련해서", "관련된", "대해", "대해서", "대한", "내용",
    "정보", "문의", "질문", "확인", "부탁", "좀", "그리고", "혹시",
    "어떻게되나요", "얼마", "얼마나", "얼마야", "얼마인가요",
]

# Words that say nothing about a title's subject.
TITLE_STOPWORDS = ["안내", "공지", "가이드", "운영", "이벤트", "판촉", "필수", "전점", "매장"]
KEYWORD_STOPWORDS = [*TITLE_STOPWORDS, "isp", "pb"]

TOKEN = r"[\p{L}\p{N}_]+"
HANGUL_WORD = "[가-힣]{2,}"
LATIN_WORD = "[A-Za-z]{3,}"
#: The lazy stem leaves the longest particle to the second group.
PARTICLE_END = "^(.{2,}?)(?:" + "|".join(PARTICLES) + ")$"
BRACKETED = r"[\[\(（][^\]\)）]*[\]\)）]"


def words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def distinct_in_order(a: Column) -> Column:
    return F.array_distinct(a)


def strip_particle(token: Column) -> Column:
    """Token without a trailing particle, if at least two characters stay."""
    return F.when(F.substring(token, -1, 1).between("가", "힣"), F.regexp_replace(token, PARTICLE_END, "$1")).otherwise(token)


def tokenize(text: Column) -> Column:
    """Lower-cased tokens of two characters or more, each followed by its stripped form when that differs; repeats stay."""
    body = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)

    def both(t: Column) -> Column:
        return let(strip_particle(t), lambda stem: F.when((stem != t) & (F.length(stem) >= 2), F.array(t, stem)).otherwise(F.array(t)))

    return F.when(body.rlike("[가-힣]"), F.flatten(F.transform(found, both))).otherwise(found)


def keyword_variants(keyword: Column) -> Column:
    """[keyword], or [keyword, stem] when stripping changes it; empty for a blank one."""
    k = F.trim(F.coalesce(keyword, F.lit("")))
    stem = strip_particle(k)
    return F.when(k == "", F.array().cast("array<string>")).when(stem != k, F.array(k, stem)).otherwise(F.array(k))


def expand_keywords(keywords: Column) -> Column:
    """All variants, distinct by lower case, in order."""
    every = F.flatten(F.transform(keywords, keyword_variants))
    return _distinct_by(every, F.lower)


def _distinct_by(a: Column, key) -> Column:
    """First element of each key, in order."""
    zero = F.array().cast("array<string>")

    def add(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: key(y) == key(x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(a, zero, add)


def is_question_stopword(token: Column) -> Column:
    t = F.lower(F.trim(token))
    stop = words(QUESTION_STOPWORDS)
    return F.array_contains(stop, t) | F.array_contains(stop, strip_particle(t))


def question_keywords(question: Column, limit: int = 8) -> Column:
    """Stems of a question's tokens without fillers, distinct by lower case, the first limit of them."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) >= 2) & ~is_question_stopword(t))
    stems = F.filter(F.transform(kept, strip_particle), lambda s: (F.length(s) >= 2) & ~is_question_stopword(s))
    return F.slice(_distinct_by(stems, F.lower), 1, limit)


def normalize_title(title: Column) -> Column:
    """Without bracketed parts, white space squeezed, lower case."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), BRACKETED, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def title_anchors(title: Column) -> Column:
    found = F.regexp_extract_all(normalize_title(title), F.lit(HANGUL_WORD), F.lit(0))
    return F.filter(found, lambda w: ~F.array_contains(words(TITLE_STOPWORDS), w))


def keyword_set(text: Column, codes: Column | None = None) -> Column:
    """Codes, Hangul words and lower-cased Latin words of a text, without the stop words."""
    t = F.coalesce(text, F.lit(""))
    parts = [F.regexp_extract_all(t, F.lit(HANGUL_WORD), F.lit(0)), F.transform(F.regexp_extract_all(t, F.lit(LATIN_WORD), F.lit(0)), F.lower)]
    every = F.concat(*([codes] if codes is not None else []), *parts)
    return F.array_except(every, words(KEYWORD_STOPWORDS))


def truncate(text: Column, limit: int, suffix: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def normalized(text: Column) -> Column:
    """Lower case with white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def attachment_stem(filename: Column) -> Column:
    """File name without extension, version suffix and 6 to 8 digit dates, trimmed and lower-cased."""
    s = F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]+$", "")
    s = F.regexp_replace(s, r"(?i)[_\s]*(v\d+|ver\d+)$", "")
    s = F.regexp_replace(s, r"\d{6,8}", "")
    return F.lower(F.btrim(s, F.lit("_ ")))
