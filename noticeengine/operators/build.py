"""Building cards and events: posts to events by rules, enrichment of parsed records, and the whole card table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as cd
from ..functions import dates, ids
from ..functions import text as tx
from . import cards as cs
from . import grid, routing, temporal

# Categories and the words that lead to them, words of event types, and limits.
CATEGORY_WORDS = [
    ("대형가전", ["대형가전", "냉장고", "세탁기", "건조기", "에어컨", "원바디"]),
    ("주방", ["주방", "커피머신", "정수기", "음식물", "취사", "레인지", "밥솥"]),
    ("TV·영상", ["TV", "티비", "영상", "OLED"]),
    ("모바일·IT", ["IT", "PC", "노트북", "키보드", "태블릿", "스마트폰"]),
    ("계절가전", ["선풍기", "에어컨", "겨울", "여름", "계절"]),
    ("생활가전", ["생활", "청소기", "공기청정", "생활주방", "NON-POG"]),
    ("KBB", ["KBB", "비데", "욕실"]),
    ("Hobby", ["Hobby", "취미"]),
    ("스마트홈", ["스마트", "ISP", "POG", "연출"]),
    ("케어·헬스", ["케어", "헬스", "안마"]),
]
TYPE_WORDS = [("정책", ["정책", "개정", "시행", "변경 안내"]), ("판촉", ["판촉", "특가", "할인", "행사"]), ("가격_재고", ["재고", "소진", "입고", "품절"]), ("이벤트", ["이벤트", "시연", "페스티벌"])]
OTHER, NOTICE, GENERAL_THEME, EVERYWHERE = "기타", "공지", "운영 공지", "전점"
SUMMARY_LIMIT, EXCERPT_LIMIT = 220, 500
NOT_KEYWORDS = ["", "sheet", "table", "슬라이드", "페이지"]
MAX_KEYWORDS = 40
TEAM = r"(?:^|\n)\s*\[([^\]\n]{2,20})\]"
PAGE_KINDS = ("pptx_slide", "pdf_page", "pdf_section")


def categories(text: Column) -> Column:
    """Categories that a text's words lead to, in their fixed order; OTHER without any."""
    found = F.array_compact(F.array(*(F.when(text.rlike("|".join(w.replace("-", r"\-") for w in words)), F.lit(c)) for c, words in CATEGORY_WORDS)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER)))


def event_type(text: Column, has_end: Column) -> Column:
    out = None
    for kind, words in TYPE_WORDS:
        hit = text.rlike("|".join(words))
        hit = hit | has_end if kind == "판촉" else hit
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(NOTICE)


def summary(body: Column, title: Column, limit: int = SUMMARY_LIMIT) -> Column:
    """The first telling sentence of a body, else its head, else the title."""
    text = F.btrim(F.replace(F.coalesce(body, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(" \t\r\n"))
    parts = F.transform(F.split(text, r"。|\. "), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    telling = F.get(F.filter(parts, lambda p: (F.length(p) > 20) & ~F.contains(p, F.lit("프롬프트")) & ~F.contains(p, F.lit("【"))), F.lit(0))
    short = lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)
    return F.when(text == "", title).otherwise(short(F.coalesce(telling, text)))


def posts_to_events(posts: DataFrame) -> DataFrame:
    """Events of posts (post_id, title, body, posted_date) by their words and dates."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    rows = posts.select("*", text.alias("__t")).select("*", categories(F.col("__t")).alias("categories"), dates.validity_range(F.col("__t"), F.year("posted_date")).alias("__w"))
    rows = rows.withColumn("type", event_type(F.col("__t"), F.coalesce(F.col("__w.to").isNotNull(), F.lit(False))))
    first = F.get("categories", F.lit(0))
    return rows.select(
        ids.event_id(F.col("post_id").cast("string"), F.col("title")).alias("id"),
        "type",
        "title",
        summary(F.col("body"), F.col("title")).alias("summary"),
        F.when(first != OTHER, first).otherwise(GENERAL_THEME).alias("theme"),
        "categories",
        F.array(F.lit(EVERYWHERE)).alias("branches"),
        F.col("__w.from").alias("valid_from"),
        F.col("__w.to").alias("valid_to"),
        F.when(F.col("type") == "정책", F.col("posted_date")).alias("effective_date"),
        "post_id",
        F.substring(F.coalesce("body", F.lit("")), 1, EXCERPT_LIMIT).alias("excerpt"),
        F.col("posted_date").alias("first_seen"),
        F.col("posted_date").alias("last_updated"),
    )


def record_keywords(*texts: Column, limit: int = MAX_KEYWORDS) -> Column:
    """Keywords and title words of texts, the longest first, ties by code point."""
    every = F.array_distinct(F.concat(*(F.concat(tx.keyword_set(t), tx.title_anchors(t)) for t in texts)))
    kept = F.filter(every, lambda k: ~k.isin(*NOT_KEYWORDS))
    by_length = F.array_sort(kept, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.slice(by_length, 1, limit)


def review_flag(given: Column, extraction: Column, roles: Column, text: Column) -> Column:
    doubtful = extraction.isin("fallback", "ocr")
    return F.coalesce(given, F.when(doubtful, F.concat(extraction, F.lit("_content"))).when(F.size(roles) == 0, "no_damdang").when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 20, "short_body"))


def enrich_records(records: DataFrame, lookup: DataFrame, roster: Column) -> DataFrame:
    """Records with codes, category, roles, keywords, temporal facts and review flag; those that no role fits are dropped.

    records: id, kind, post_id, post_title, posted_date, filename, source_ref, title, body, note, category,
    given_roles, given_keywords, given_codes, extraction, review_flag; lookup: code, role, ord. A page's text may
    come from a note about its picture.
    """
    text = F.coalesce(F.nullif(cs.strip(F.col("body")), F.lit("")), F.col("note"), F.lit(""))
    none = F.array().cast("array<string>")
    rows = records.withColumn("text", text)
    own = F.coalesce("given_codes", none)
    found = cd.product_codes(F.concat_ws("\n", "text", F.coalesce("note", F.lit(""))))
    rows = rows.withColumn("product_codes", F.when(F.size(own) > 0, own).when(F.size(found) > 0, found).otherwise(cd.model_skus(F.col("text"))))
    team = F.nullif(F.trim(F.regexp_extract("text", TEAM, 1)), F.lit(""))
    rows = rows.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.when(F.col("kind").isin(*PAGE_KINDS), team)))
    by_code = routing.roles_by_codes(rows.select("id", "product_codes"), lookup).withColumnRenamed("roles", "__by_code")
    rows = rows.join(by_code, "id", "left")
    blob = F.concat_ws("\n", "post_title", "filename", "text")
    roles = routing.record_roles(F.col("category"), F.col("given_roles"), F.col("filename"), F.col("post_title"), F.col("text"), F.coalesce("__by_code", none), cs.text_roles(blob, roster), F.size("product_codes"), roster)
    rows = rows.withColumn("roles", roles).drop("__by_code").filter(F.size("roles") > 0)
    head = F.coalesce(F.nullif("title", F.lit("")), F.col("post_title"))
    words = F.when(F.size(F.coalesce("given_keywords", none)) > 0, F.col("given_keywords")).otherwise(record_keywords(F.col("post_title"), F.coalesce("filename", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    meta = dates.temporal_meta(head, F.col("filename"), F.col("text"), F.col("posted_date"), F.get("roles", F.lit(0)))
    return rows.withColumn("headline", F.substring(head, 1, 120)).withColumn("keywords", words).withColumn("temporal", meta).withColumn("review_flag", review_flag(F.col("review_flag"), F.col("extraction"), F.col("roles"), F.col("text")))


def slices_of(records: DataFrame) -> DataFrame:
    """Texts of records (id, post_id, filename, kind, text) cut at their markers, without noise: what no profile, slide or page reader made records of."""
    parts = records.select(F.col("id").alias("record_id"), "post_id", "filename", "kind", F.explode(grid.sections(F.col("text"))).alias("s"))
    rows = parts.select("record_id", "post_id", "filename", "kind", F.concat("record_id", F.lit("#"), "s.ref").alias("source_ref"), F.col("s.text").alias("body"))
    promo = routing.is_promo_sheet(F.col("kind"), F.col("filename"), F.col("body"))
    return rows.filter((F.trim("body") != "") & (~cs.noisy(F.col("body"), F.col("source_ref"), F.col("filename")) | promo))


def build_cards(records: DataFrame, posts: DataFrame, lookup: DataFrame, roster: Column, role_scoped: bool = True) -> DataFrame:
    """The whole card table: cards of enriched records and of the bodies of posts, with keywords, versions and ids.

    records as enrich_records takes them (parsed records and slices alike); posts: post_id, title, body,
    posted_date. Each record gives a card a role with that role's codes.
    """
    rich = enrich_records(records, lookup, roster)
    fanned = cs.record_cards(rich.select("id", "roles", "product_codes"), lookup)
    texts = rich.select("id", "post_id", "post_title", "posted_date", "source_ref", F.col("filename").alias("attachment_name"), "headline", cs.shortened(F.col("text")).alias("body"), "keywords", F.col("temporal.notice_kind").alias("notice_kind"), F.col("temporal.valid_from").alias("valid_from"), F.col("temporal.valid_to").alias("valid_to"), F.col("temporal.effective_date").alias("effective_date"), "review_flag")
    from_records = fanned.join(texts, "id").drop("id")
    bodies = cs.body_cards(posts, lookup, roster)
    none = F.lit(None).cast("string")
    from_bodies = bodies.select("role", "product_codes", "post_id", F.col("title").alias("post_title"), "posted_date", "source_ref", "attachment_name", "headline", "body", record_keywords(F.col("title"), F.col("body")).alias("keywords"), *(F.col(f"temporal.{c}").alias(c) for c in ("notice_kind", "valid_from", "valid_to", "effective_date")), none.alias("review_flag"))
    every = from_records.unionByName(from_bodies)
    key = dates.topic_key(F.col("role"), F.col("attachment_name"), F.col("headline"), F.col("notice_kind"))
    every = every.withColumn("topic_key", key).withColumn("id", ids.card_id(F.col("source_ref"), F.col("role")))
    every = every.withColumn("ord", F.struct("posted_date", "source_ref", "role"))
    return temporal.link_card_versions(every.withColumn("version_of", F.lit(None).cast("string")), role_scoped)


def build_stats(cards: DataFrame, records: DataFrame, posts: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row: posts and records scanned, cards written and of bodies, distinct codes and those that the look-up knows."""
    said = cards.select(F.explode("product_codes").alias("code")).distinct()
    known = said.join(lookup.select("code").distinct().withColumn("known", F.lit(1)), "code", "left").agg(F.count(F.lit(1)).alias("unique_codes"), F.count("known").alias("codes_resolved"))
    counts = cards.agg(F.count(F.lit(1)).alias("cards_written"), F.count_if(F.col("attachment_name") == cs.BODY_NAME).alias("post_body_cards"))
    scans = counts.select("*", posts.agg(F.count(F.lit(1)).alias("n")).scalar().alias("posts_scanned"), records.agg(F.count(F.lit(1)).alias("n")).scalar().alias("records_scanned"))
    return scans.select("*", *(known.select(c).scalar().alias(c) for c in ("unique_codes", "codes_resolved")))
