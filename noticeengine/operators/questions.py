"""Understanding of a question, and the staged retrieval that answers it.

The rules run on the driver for one question: they give literals for the plans. Model calls are an
optional callable; without one the deterministic rules decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import retrieval

# Signal words and roles.
MARKETING = ["광고", "콘텐츠", "계정", "브랜드", "마케팅", "sns", "플친", "카카오", "검수"]
MARKETING_SIGNALS = [*MARKETING, "연출", "pop"]
INVENTORY = ["진열소진", "소진현황", "재고확인", "재고현황", "지사지점재고확인"]
PRODUCT_SIGNALS = ["냉장고", "김치냉장고", "세탁기", "건조기", "에어컨", "tv", "티비", "선풍기", "제습기", "정수기", "오클린", "칫솔", "노트북", "pc", "조립pc", "모니터", "세트", "plux", "plx-", "삼성", "lg"]
PRODUCT_ROLES = ["대형가전1", "대형가전2", "생활주방", "생활리빙", "IT", "KBB", "주방", "스마트가전", "스마트폰", "모바일", "PC솔루션", "Hobby", "애플"]
NAMED_ROLES = ["대형가전1", "대형가전2", "생활주방", "생활리빙", "IT", "KBB", "주방", "스마트가전", "케어서비스", "지원"]
ROLE_RULES = [
    (["서비스", "SCM", "조립 서비스", "조립서비스", "설치"], ["케어서비스"]),
    (["선풍기", "냉풍기", "계절가전"], ["생활주방", "생활리빙"]),
    (["오클린", "구강", "전동칫솔", "칫솔"], ["생활리빙"]),
    (["노트북", "조립pc", "조립 pc", "조립PC"], ["PC솔루션", "IT"]),
]
ROLE_ALIASES = {
    "대형가전": ["대형가전1", "대형가전2"],
    "대형": ["대형가전1", "대형가전2"],
    "생활가전": ["생활주방", "생활리빙", "주방"],
    "계절가전": ["생활주방", "생활리빙"],
    "선풍기": ["생활주방", "생활리빙"],
    "구강": ["생활리빙"],
    "오클린": ["생활리빙"],
    "칫솔": ["생활리빙"],
    "서비스": ["케어서비스"],
    "scm": ["케어서비스"],
    "케어": ["케어서비스"],
    "브랜드마케팅": ["공통"],
    "브랜드 마케팅": ["공통"],
    "지점관리": ["공통"],
}
CODE = re.compile(r"\b[A-Z]{2,4}-[A-Z0-9]{4,}\b")


@dataclass
class Intent:
    keywords: list[str]
    role_hints: list[str] = field(default_factory=list)
    product_codes: list[str] = field(default_factory=list)
    notice_kinds: list[str] = field(default_factory=list)
    time_mode: str = "none"
    query_date: str | None = None


def _has(text: str, words: list[str]) -> bool:
    return any(w in text for w in words)


def _stem(token: str) -> str:
    return next((token[: -len(p)] for p in tx.PARTICLES if token.endswith(p) and len(token) - len(p) >= 2), token)


def question_keywords(question: str, limit: int = 8) -> list[str]:
    """The rules of functions.text.question_keywords for one question."""
    out: dict[str, str] = {}
    stop = set(tx.QUESTION_STOPWORDS)
    for token in re.findall(r"\w+", question or ""):
        stem = _stem(token)
        if len(token) >= 2 and len(stem) >= 2 and not ({token.lower(), stem.lower(), _stem(stem)} & stop):
            out.setdefault(stem.lower(), stem)
    return list(out.values())[:limit]


def understand(question: str, query_date: str | None = None, raw: dict | None = None) -> Intent:
    """A question's intent from what a model said of it (raw, may be empty) and the rules."""
    raw = raw or {}
    keywords = list(raw.get("keywords") or []) or question_keywords(question) or [w for w in question.split() if len(w) >= 2][:8]
    marketing = _has(question.lower(), MARKETING)
    hints = [h for h in raw.get("damdang_hints") or [] if not marketing or h in question or h in ("지원", "케어서비스")]
    hints += [h for h in NAMED_ROLES if h in question and h not in hints]
    if marketing:
        hints = [h for h in hints if h not in PRODUCT_ROLES or h in question]
    for words, roles in ROLE_RULES:
        if _has(question, words):
            hints += [r for r in roles if r not in hints]
    codes = list(dict.fromkeys([*(raw.get("product_codes") or []), *CODE.findall(question.upper())]))
    kinds = list(raw.get("notice_kinds") or [])
    if not kinds and _has(question, ["판촉", "행사", "할인"]):
        kinds = ["판촉"]
    if not kinds and _has(question, ["서비스", "조립", "설치", "정책", "시행", "코드 안내", "유의사항"]):
        kinds = ["정책", "공지"]
    if not kinds and marketing:
        kinds = ["공지", "정책"]
    if _has(question, INVENTORY):
        kinds = []
    mode = raw.get("time_mode") or "none"
    if mode == "none" and _has(question, ["판촉", "행사", "중순", "초순", "말"]):
        mode = "active_on"
    day = raw.get("query_date") or (query_date if mode in ("active_on", "observable_on") else None)
    return Intent(keywords, hints, codes, kinds, mode, day)


def confidence(question: str, intent: Intent, roster: list[str], anchored: bool = False, override: str | None = None) -> str:
    """high, medium or low: how far a question narrows the roles."""
    if override or anchored or intent.product_codes or any(h in roster and h in question for h in intent.role_hints):
        return "high"
    q = question.lower()
    if _has(q, ["노트북", "조립pc", "조립 pc"]) and {"PC솔루션", "IT"} & set(intent.role_hints):
        return "high"
    return "medium" if _has(q, PRODUCT_SIGNALS) and intent.role_hints else "low"


def role_scope(question: str, intent: Intent, roster: list[str], how_sure: str, override: str | None = None) -> list[str]:
    """Roles whose cards are boosted; all of them where the question says too little."""
    if override:
        return [override]
    out: list[str] = []
    for hint in intent.role_hints:
        names = [hint] if hint in roster else [r for key, roles in ROLE_ALIASES.items() if key in hint or hint in key for r in roles if r in roster]
        out += [n for n in names if n not in out]
    literal = any(h in question for h in intent.role_hints if h in roster)
    unsure = how_sure == "low" and intent.role_hints and not literal
    if unsure and (_has(question, MARKETING_SIGNALS) or not _has(question.lower(), PRODUCT_SIGNALS)):
        return list(roster)
    return out or list(roster)


@dataclass
class Answer:
    hits: DataFrame
    stages: list[str]
    intent: Intent
    roles: list[str]


def ask(cards: DataFrame, question: str, roster: list[str], query_date: str | None = None, refine: Callable[[str, list[str]], list[str]] | None = None, corpus: DataFrame | None = None, limit: int = 8) -> Answer:
    """Staged retrieval: as asked; without the narrowing of roles when the best card hardly matches or hits are weak; without kinds; with a model's extra keywords.

    A later stage replaces hits only if its best score is not lower. Each stage is one small job.
    """
    intent = understand(question, query_date)
    sure = confidence(question, intent, roster)
    roles = role_scope(question, intent, roster, sure)
    base = retrieval.Query(intent.keywords, intent.product_codes, roles, intent.notice_kinds, intent.time_mode, intent.query_date or query_date, limit=limit)
    stages: list[str] = []

    def run(stage: str, q: retrieval.Query) -> tuple[DataFrame, dict]:
        stages.append(stage)
        found = retrieval.retrieve(cards, q, corpus)
        return found, retrieval.weak(found, q.keywords).first().asDict()

    def better(new, old):
        return new if not old[1]["n"] or (new[1]["n"] and new[1]["top"] >= old[1]["top"]) else old

    now = run("initial", base)
    narrowed = 0 < len(roles) < len(roster)
    if now[1]["n"] and narrowed and sure != "high" and not _has(question, INVENTORY):
        top = now[0].withColumn("overlap", retrieval.keyword_overlap(base.keywords)).select("overlap").first()
        if top["overlap"] < 2:
            base, narrowed = replace(base, roles=list(roster)), False
            now = run("early_broaden", base)
    if now[1]["weak"] and narrowed:
        now = better(run("broaden_roles", replace(base, roles=list(roster))), now)
    if now[1]["weak"] and base.notice_kinds:
        now = better(run("drop_kinds", replace(base, roles=list(roster), notice_kinds=[])), now)
    if now[1]["weak"] and refine:
        if extra := refine(question, base.keywords):
            now = better(run("refine", replace(base, keywords=[*base.keywords, *extra], roles=list(roster), notice_kinds=[])), now)
    return Answer(now[0], stages, intent, roles)


def compose(answer: Answer, answerer: Callable[[str, list[dict]], str] | None = None, question: str = "") -> tuple[str, list[dict]]:
    """An answer and its citations (the first five hits). By default the best hit's text is the answer."""
    rows = [r.asDict() for r in answer.hits.select("id", "post_id", "post_title", "headline", "attachment_name", "source_ref", F.substring("body", 1, 1500).alias("excerpt")).limit(5).collect()]
    if not rows:
        return "관련 공지를 찾지 못했습니다.", []
    return (answerer(question, rows) if answerer else rows[0]["excerpt"]), rows
