"""Full-text retrieval of cards: BM25 over postings, a hybrid score, relaxing filters, top-k and topic dedup.

Questions are literals of the plan (keywords, codes, roles), the corpus is only scanned. Filters that
may relax are decided by one aggregate row beside the scan, without a round trip to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from . import temporal

K1, B = 1.5, 0.75
GOOD_SCORE, STRONG_SCORE = 4.0, 8.0
RECENT_DAYS = 90
# Patterns of special questions and cards.
INVENTORY = "(?i)진열소진|소진현황|재고확인|재고현황|지사지점재고확인"
PC_ASSEMBLY = r"(?i)조립\s*pc|조립pc"
SERVICE_WORDS = ["서비스", "설치", "scm", "케어", "선풍기", "냉풍기"]
CODE_IN_TEXT = r"(?U)\b[A-Z]{2,4}-[A-Z0-9]{4,}\b"


@dataclass
class Query:
    keywords: list[str]
    product_codes: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    notice_kinds: list[str] = field(default_factory=list)
    time_mode: str = "none"
    query_date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    anchor_post_id: object = None
    anchor_source_ref: str | None = None
    limit: int = 8


def search_text() -> Column:
    return F.concat_ws(" ", F.coalesce("post_title", F.lit("")), F.coalesce("headline", F.lit("")), F.coalesce("body", F.lit("")))


def index_text() -> Column:
    """What the card index holds: the search text, attachment name, keywords and codes."""
    return F.concat_ws(" ", search_text(), F.coalesce("attachment_name", F.lit("")), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("product_codes", F.array().cast("array<string>")), " "))


def postings(docs: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(key, term, tf, dl): how often each token of a text occurs, and how many tokens the text has."""
    tokens = docs.select(key, tx.tokenize(text).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return tokens.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: n texts and their mean token count."""
    return docs.select(F.size(tx.tokenize(text)).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_batch(docs: DataFrame, text: Column, questions: DataFrame, key: str = "id") -> DataFrame:
    """(question_id, key, score) of every text that shares a term with a question (question_id, question).

    Texts are tokenised once, into a written table of the postings of asked terms and one row a text
    for its other tokens, which the statistics are read from too.
    """
    asked = questions.select("question_id", F.explode(tx.tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("term", F.col("term").alias("known")).distinct()
    tokens = docs.select(key, tx.tokenize(text).alias("t")).select(key, F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    every = tokens.join(wanted, "term", "left").groupBy(key, "dl", F.col("known").alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    every = materialize(every, "postings")
    stats = every.filter("term IS NULL").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    n, avgdl = stats.select("n").scalar(), stats.select("avgdl").scalar()
    posted = every.filter("term IS NOT NULL")
    weighed = posted.join(document_frequency(posted), "term").withColumn("n", n).withColumn("avgdl", avgdl)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))))
    return weighed.withColumn("part", part).join(asked, "term").groupBy("question_id", key).agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "question_id", *ties: Column) -> DataFrame:
    """The k best rows of each question with their rank."""
    order = W.partitionBy(by).orderBy(F.round("score", 6).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(pool: DataFrame, keywords: list[str], corpus: DataFrame | None = None) -> DataFrame:
    """(id, bm25) of the pool's matching cards; statistics over corpus, by default over the pool itself."""
    spark = pool.sparkSession
    question = spark.range(1).select(F.lit(0).alias("question_id"), F.lit(" ".join(keywords)).alias("question"))
    over = pool if corpus is None else corpus
    return bm25_batch(over, search_text(), question).select("id", F.col("score").alias("bm25"))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _variants(keyword: str) -> list[str]:
    """A keyword and its stem, lower-cased; the particles are tried longest first."""
    k = keyword.lower().strip()
    if any("가" <= c <= "힣" for c in k):
        for p in tx.PARTICLES:
            if k.endswith(p) and len(k) - len(p) >= 2:
                return [k, k[: -len(p)]]
    return [k] if k else []


def keyword_overlap(keywords: list[str]) -> Column:
    """How many keywords the card is tagged with, else how many stand in its text."""
    sets = [v for v in (_variants(k) for k in dict.fromkeys(k.lower().strip() for k in keywords)) if v]
    tags = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    text = F.lower(search_text())
    tagged = [F.arrays_overlap(tags, tx.words(v)) for v in sets]
    zero = F.lit(0)
    by_tag = sum((F.when(t, 1).otherwise(0) for t in tagged), zero)
    by_text = sum((F.when(~t & _any(text, v), 1).otherwise(0) for t, v in zip(tagged, sets)), zero)
    return F.when(by_tag > 0, by_tag).otherwise(by_text)


def hybrid_score(q: Query) -> Column:
    """Score of a card row (with bm25 and keywords columns) for a query."""
    title, headline, body = (F.lower(F.coalesce(c, F.lit(""))) for c in ("post_title", "headline", "body"))
    text = F.concat_ws(" ", title, headline, body)
    attachment = F.lower(F.coalesce("attachment_name", F.lit("")))
    score = F.coalesce("bm25", F.lit(0.0)) * 1.5
    if q.anchor_post_id is not None:
        score = score + F.when(F.col("post_id") == q.anchor_post_id, 35.0).otherwise(0.0)
    if q.anchor_source_ref:
        score = score + F.when(F.col("source_ref") == q.anchor_source_ref, 45.0).when(F.contains("source_ref", F.lit(q.anchor_source_ref)), 12.0).otherwise(0.0)
    sets = [v for v in map(_variants, q.keywords) if v]
    hits = []
    for v in sets:
        place = F.when(_any(title, v), 5.0).when(_any(headline, v), 3.0).when(_any(body, v), 2.0).otherwise(0.0)
        score = score + place
        hits.append(F.when(place > 0, 1).otherwise(0))
    matched = sum(hits, F.lit(0))
    score = score + F.when(matched >= 2, 3.0 * (matched - 1)).otherwise(0.0)
    own = list(dict.fromkeys(k.lower().strip() for k in q.keywords if k.strip()))
    expanded = list(dict.fromkeys(v for s in map(_variants, own) for v in s))
    if own:
        tags = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
        both = F.size(F.array_intersect(tx.words(expanded), tags))
        score = score + F.least(both, F.lit(len(own))) / len(own) * 8.0
    score = score + F.when(_any(attachment, expanded), 3.0).otherwise(0.0)
    asked = " ".join(q.keywords).lower()
    if any(w in asked for w in INVENTORY.removeprefix("(?i)").split("|")):
        score = score + F.when(attachment.rlike(INVENTORY), 10.0).otherwise(0.0)
        score = score + F.when(F.contains(body, F.lit("지사지점재고확인")) | F.contains(headline, F.lit("지사지점재고확인")), 8.0).otherwise(0.0)
        score = score + F.when(F.contains(attachment, F.lit("진열소진현황")), 6.0).otherwise(0.0)
    if "조립" in asked and any(w in asked for w in SERVICE_WORDS):
        fan = F.contains(text, F.lit("선풍기"))
        score = score + F.when(text.rlike(PC_ASSEMBLY) & ~fan, -4.0).otherwise(0.0) + F.when(fan & F.contains(text, F.lit("조립")), 4.0).otherwise(0.0)
    codes = F.transform("product_codes", F.upper)
    for c in q.product_codes:
        score = score + F.when(F.array_contains(codes, c.upper()), 5.0).otherwise(0.0)
    said = F.regexp_extract_all(F.upper(text), F.lit(CODE_IN_TEXT), F.lit(0))
    score = score + F.size(F.filter(said, lambda c: F.array_contains(codes, c))).cast("double")
    if q.roles:
        score = score + F.when(F.col("role").isin(*q.roles), 12.0).otherwise(-2.0)
    if q.query_date:
        days = F.datediff(F.lit(q.query_date).cast("date"), "posted_date")
        score = score + F.when(days.between(0, RECENT_DAYS), F.greatest(F.lit(0.0), 8.0 - days / 12.0)).otherwise(0.0)
    return score


def relaxing(pool: DataFrame, *conditions: tuple[str, Column]) -> tuple[DataFrame, Column]:
    """Rows of the first condition that any row meets, else all; and the name of the condition that held (a scalar).

    One pass finds which conditions can be met; its single row is a scalar subquery of the filter.
    """
    met = pool.agg(*(F.max(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(conditions)))
    chosen, name = F.lit(True), F.lit("none")
    for i, (label, c) in reversed(list(enumerate(conditions))):
        holds = F.coalesce(met.select(f"c{i}").scalar(), F.lit(False))
        chosen, name = F.when(holds, F.coalesce(c, F.lit(False))).otherwise(chosen), F.when(holds, label).otherwise(name)
    return pool.filter(chosen), name


def time_conditions(q: Query) -> list[tuple[str, Column]]:
    """What a time mode asks for, and what it falls back to."""
    windows = F.col("event_windows")
    if q.time_mode == "active_on" and q.query_date:
        return [("active_on", temporal.active_condition(q.query_date, windows)), ("observable_on", temporal.observable_condition(q.query_date, windows))]
    if q.time_mode == "observable_on" and q.query_date:
        return [("observable_on", temporal.observable_condition(q.query_date, windows))]
    if q.time_mode == "posted_between":
        if q.date_from and q.date_to:
            return [("posted_between", F.col("posted_date").between(F.lit(q.date_from).cast("date"), F.lit(q.date_to).cast("date")))]
        if q.query_date:
            return [("posted_between", F.col("posted_date").between(F.date_sub(F.lit(q.query_date).cast("date"), 45), F.lit(q.query_date).cast("date")))]
    return []


def pool_for(cards: DataFrame, q: Query, use_kinds: bool = True) -> DataFrame:
    """Cards that pass the kind, code and time filters, each dropped where it would leave none."""
    pool = cards if "event_windows" in cards.columns else cards.withColumn("event_windows", F.array().cast("array<struct<from:date,to:date>>"))
    if q.notice_kinds and use_kinds:
        pool, _ = relaxing(pool, ("kinds", F.col("notice_kind").isin(*q.notice_kinds)))
    if q.product_codes:
        pool, _ = relaxing(pool, ("codes", F.arrays_overlap(F.transform("product_codes", F.upper), tx.words([c.upper() for c in q.product_codes]))))
    if q.time_mode == "version_diff":
        pair = pool.filter("version_of IS NOT NULL")
        ids = pair.select("id").unionByName(pair.select(F.col("version_of").alias("id"))).distinct().withColumn("paired", F.lit(True))
        pool, _ = relaxing(pool.join(ids, "id", "left"), ("paired", F.col("paired")))
        return pool.drop("paired")
    if conditions := time_conditions(q):
        pool, _ = relaxing(pool, *conditions)
    return pool


def scored(pool: DataFrame, q: Query, corpus: DataFrame | None = None) -> DataFrame:
    pool = pool if "keywords" in pool.columns else pool.withColumn("keywords", F.array().cast("array<string>"))
    found = bm25(pool, q.keywords, corpus) if " ".join(q.keywords).strip() else None
    rows = pool.join(found, "id", "left") if found is not None else pool.withColumn("bm25", F.lit(0.0))
    return rows.withColumn("score", F.round(hybrid_score(q), 6))


def hits(pool: DataFrame, q: Query, corpus: DataFrame | None = None, product_filtered: bool = False) -> DataFrame:
    """The best cards: by score, then posting date, then ord; without those that don't score when there are keywords."""
    best = scored(pool, q, corpus).orderBy(F.col("score").desc(), F.col("posted_date").desc(), "ord").limit(q.limit)
    return best if not q.keywords or product_filtered else best.filter("score > 0")


def dedup_topics(found: DataFrame) -> DataFrame:
    """One hit a topic, the latest posted, then the best; hits without a topic stay."""
    order = W.partitionBy("topic_key").orderBy(F.col("posted_date").desc(), F.col("score").desc(), "ord")
    kept = found.withColumn("__n", F.row_number().over(order)).filter(F.col("topic_key").isNull() | (F.col("__n") == 1)).drop("__n")
    return kept.orderBy(F.col("score").desc(), F.col("posted_date").asc(), "ord")


def retrieve(cards: DataFrame, q: Query, corpus: DataFrame | None = None) -> DataFrame:
    """All of it for one query; a second pass without the kinds and an anchored one are separate small jobs, run only if needed."""
    if q.anchor_post_id is not None:
        extra = [r["role"] for r in cards.filter(F.col("post_id") == q.anchor_post_id).select("role").distinct().collect()]
        q = Query(**{**q.__dict__, "roles": list(dict.fromkeys([*q.roles, *sorted(extra)]))})
    skip = q.time_mode == "version_diff"

    def run(use_kinds: bool) -> DataFrame:
        found = hits(pool_for(cards, q, use_kinds), q, corpus, bool(q.product_codes))
        return found if skip else dedup_topics(found)

    found = run(True)
    if q.notice_kinds and found.isEmpty():
        found = run(False)
    if q.anchor_post_id is not None:
        top = found.agg(F.max("score")).first()[0]
        if top is None or top < 5:
            found = hits(cards.filter(F.col("post_id") == q.anchor_post_id), q, corpus, True)
    return found


def weak(found: DataFrame, keywords: list[str]) -> DataFrame:
    """One row: top score, number of hits, and whether they are too weak to answer from."""
    covered = sum((F.when(_any(F.lower(search_text()), v), 1).otherwise(0) for v in map(_variants, dict.fromkeys(keywords)) if v), F.lit(0))
    best = found.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.max_by(covered, F.struct("score", "posted_date", -F.col("ord"))).alias("covered"))
    bad = (F.col("n") == 0) | ((F.col("covered") == 0) if keywords else F.lit(False)) | ((F.col("top") < STRONG_SCORE) & ((F.col("n") < 2) | (F.col("top") < GOOD_SCORE)))
    return best.select("n", F.round("top", 6).alias("top"), F.coalesce(bad, F.lit(True)).alias("weak"))


def attachments(found: DataFrame, order: str = "rank") -> DataFrame:
    """Distinct attachments of hits, first seen first."""
    return found.groupBy("post_id", "attachment_name").agg(F.min(order).alias(order)).orderBy(order)
