"""Queries of retrieval, filters that relax, and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import questions, retrieval, vectors
from ..sources import driver_tables as T
from .entities import CARD_DAY

QUERIES, ORACLES = {}, {}
CA = T.CARDS_SQL


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _tok(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '{tx.TOKEN}'), lambda x: length(x) >= 2)"


_SEARCH = "post_title || ' ' || headline || ' ' || body"
_DOCS = f"tk AS (SELECT doc_id AS id, {_tok('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), po AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk), tf AS (SELECT id, dl, term, count(*) AS tf FROM po GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"
_PART = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"

_add(
    "bm25_stats",
    lambda s, d: retrieval.document_frequency(retrieval.postings(T.read(s, d, "documents").withColumnRenamed("doc_id", "id"), F.col("text"))),
    f"WITH {_DOCS} SELECT term, df FROM df",
)


def bm25_topk(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = retrieval.bm25_batch(docs, F.col("text"), T.questions(spark, d))
    return retrieval.top_k(found, 10, "question_id", F.col("id")).select("question_id", "id", "rank", F.round("score", 6).alias("score"))


_add(
    "bm25_topk",
    bm25_topk,
    f"""WITH {_DOCS}, q AS (SELECT item_id AS question_id, term, count(*) AS times FROM (SELECT item_id, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT question_id, id, round(sum(times * {_PART}), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc) SELECT question_id, id, rank, score FROM r WHERE rank <= 10""",
)
WORDS = ["the", "ention", "of", "guide"]
QUERY = retrieval.Query(WORDS, ["PLX-0007"], ["src1", "src2"], query_date="2024-04-15", limit=10)
_CARD_TK = f"tk AS (SELECT id, {_tok(_SEARCH)} AS t FROM {{pool}}), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), po AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk), tf AS (SELECT id, dl, term, count(*) AS tf FROM po WHERE list_contains([{', '.join(repr(w) for w in WORDS)}], term) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), bm AS (SELECT id, sum({_PART}) AS bm25 FROM tf JOIN df USING (term), st GROUP BY 1)"
_HIT = [f"CASE WHEN contains(lower(post_title), '{w}') THEN 5.0 WHEN contains(lower(headline), '{w}') THEN 3.0 WHEN contains(lower(body), '{w}') THEN 2.0 ELSE 0.0 END" for w in WORDS]
_MATCHED = "(" + " + ".join(f"CAST({h} > 0 AS INTEGER)" for h in _HIT) + ")"
_SCORE = f"""round(coalesce(bm25, 0.0) * 1.5 + {' + '.join(_HIT)} + CASE WHEN {_MATCHED} >= 2 THEN 3.0 * ({_MATCHED} - 1) ELSE 0.0 END + 3.0 + CASE WHEN list_contains(keywords, 'guide') THEN 2.0 ELSE 0.0 END
 + CASE WHEN list_contains(product_codes, 'PLX-0007') THEN 5.0 ELSE 0.0 END + CASE WHEN role IN ('src1', 'src2') THEN 12.0 ELSE -2.0 END
 + CASE WHEN DATE '2024-04-15' - posted_date BETWEEN 0 AND 90 THEN greatest(0.0, 8.0 - (DATE '2024-04-15' - posted_date) / 12.0) ELSE 0.0 END
 + len(list_filter(regexp_extract_all(upper(concat_ws(' ', post_title, headline, body)), '\\b[A-Z]{{2,4}}-[A-Z0-9]{{4,}}\\b'), lambda c: list_contains(product_codes, c))), 6)"""
_SCORED = f"sc AS (SELECT p.*, {_SCORE} AS score FROM {{pool}} p LEFT JOIN bm USING (id))"


def _pool(name: str) -> str:
    return f"{_CARD_TK}, {_SCORED}".replace("{pool}", name)


_add("hybrid_score", lambda s, d: retrieval.scored(T.cards(s, d), QUERY).select("id", "score"), f"WITH {CA}, {_pool('ca')} SELECT id, score FROM sc")
_add(
    "bm25_pool_local",
    lambda s, d: retrieval.bm25(T.cards(s, d).filter("notice_kind = '정책'"), WORDS).select("id", F.round("bm25", 6).alias("bm25")),
    f"WITH {CA}, pl AS (SELECT * FROM ca WHERE notice_kind = '정책'), {_CARD_TK.replace('{pool}', 'pl')} SELECT id, round(bm25, 6) AS bm25 FROM bm",
)
_TOP = "hit AS (SELECT * FROM sc ORDER BY score DESC, posted_date DESC, ord LIMIT 10), hs AS (SELECT * FROM hit WHERE score > 0)"
_DEDUP = "dd AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY posted_date DESC, score DESC, ord) AS tn FROM hs)"
_ACTIVE = f"(valid_from IS NULL OR valid_from <= DATE '{CARD_DAY}') AND (valid_to IS NULL OR valid_to >= DATE '{CARD_DAY}')"
_FULL = retrieval.Query(WORDS, ["PLX-0007"], ["src1", "src2"], ["정책", "공지"], "active_on", CARD_DAY, limit=10)
_add("search_topk", lambda s, d: retrieval.hits(T.cards(s, d), QUERY).select("id", "score"), f"WITH {CA}, {_pool('ca')}, {_TOP} SELECT id, score FROM hs")
_add("topic_dedup", lambda s, d: retrieval.dedup_topics(retrieval.hits(T.cards(s, d), QUERY)).select("id", "score"), f"WITH {CA}, {_pool('ca')}, {_TOP}, {_DEDUP} SELECT id, score FROM dd WHERE topic_key IS NULL OR tn = 1")


def _relaxed(spark, d):
    """Filters on kinds and codes, of which the last can't be met, and a day."""
    q = retrieval.Query([], ["NO-SUCH-CODE"], [], ["정책", "공지"], "active_on", CARD_DAY)
    return retrieval.pool_for(T.cards(spark, d), q).select("id", "notice_kind")


_add("relax_filter", _relaxed, f"WITH {CA} SELECT id, notice_kind FROM ca WHERE notice_kind IN ('정책', '공지') AND {_ACTIVE}")
_add(
    "relax_filter_fallback",
    lambda s, d: retrieval.pool_for(T.cards(s, d), retrieval.Query([], [], [], ["없음"], "active_on", "2031-01-01")).select("id"),
    f"WITH {CA}, a AS (SELECT *, (valid_from IS NULL OR valid_from <= DATE '2031-01-01') AND (valid_to IS NULL OR valid_to >= DATE '2031-01-01') AS on1 FROM ca) SELECT id FROM a WHERE on1 OR NOT (SELECT bool_or(on1) FROM a)",
)
_add("weak_retrieval", lambda s, d: retrieval.weak(retrieval.hits(T.cards(s, d), QUERY), WORDS), f"WITH {CA}, {_pool('ca')}, {_TOP} SELECT count(*) AS n, max(score) AS top, count(*) = 0 OR max(score) < 8 AND (count(*) < 2 OR max(score) < 4) AS weak FROM hs")
_add("attachment_dedup", lambda s, d: retrieval.attachments(T.cards(s, d), "ord"), f"WITH {CA} SELECT post_id, attachment_name, min(ord) AS ord FROM ca GROUP BY 1, 2")


def staged_retrieval(spark, d):
    """The whole question path for one question; its stages depend on what is found."""
    answer = questions.ask(T.cards(spark, d), "the ention of 판촉 행사", [f"src{i}" for i in range(20)], query_date="2024-04-15")
    return answer.hits.select("id", "score", F.lit(",".join(answer.stages)).alias("stages"))


_add("staged_retrieval", staged_retrieval, None)


def vector_topk(spark, d):
    rows = T.read(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_top_k(rows, rows.filter("vec_id % 50 = 0"), 5)


_add(
    "vector_topk",
    vector_topk,
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS cosine FROM e JOIN e q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""",
)


# Every term of the score: anchors, inventory and assembly words, over cards that have them.
FULL_WORDS = ["guide", "조립", "선풍기", "재고확인"]
FULL = retrieval.Query(FULL_WORDS, ["PLX-0007"], ["src1"], query_date="2024-04-15", anchor_post_id=45, anchor_source_ref="3_guide_3_v0.xlsx#row3", limit=10)


def _all_terms(spark, d):
    i = F.col("id")
    cards = T.cards(spark, d)
    cards = cards.withColumn("attachment_name", F.when(i % 5 == 0, F.concat(F.lit("진열소진현황_"), "attachment_name")).otherwise(F.col("attachment_name")))
    cards = cards.withColumn("body", F.concat("body", F.when(i % 4 == 0, " 지사지점재고확인").when(i % 4 == 1, " 조립PC 안내").when(i % 4 == 2, " 선풍기 조립 PLX-0007").otherwise("")))
    return retrieval.scored(cards, FULL).select("id", "score")


_LOW = "lower(post_title || ' ' || headline || ' ' || body)"
_FULL_HIT = [f"CASE WHEN contains(lower(post_title), '{w}') THEN 5.0 WHEN contains(lower(headline), '{w}') THEN 3.0 WHEN contains(lower(body), '{w}') THEN 2.0 ELSE 0.0 END" for w in FULL_WORDS]
_FULL_MATCHED = "(" + " + ".join(f"CAST({h} > 0 AS INTEGER)" for h in _FULL_HIT) + ")"
_FULL_SCORE = f"""round(coalesce(bm25, 0.0) * 1.5 + CASE WHEN post_id = 45 THEN 35.0 ELSE 0.0 END + CASE WHEN source_ref = '3_guide_3_v0.xlsx#row3' THEN 45.0 WHEN contains(source_ref, '3_guide_3_v0.xlsx#row3') THEN 12.0 ELSE 0.0 END
 + {' + '.join(_FULL_HIT)} + CASE WHEN {_FULL_MATCHED} >= 2 THEN 3.0 * ({_FULL_MATCHED} - 1) ELSE 0.0 END + CASE WHEN list_contains(keywords, 'guide') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(attachment_name), 'guide') THEN 3.0 ELSE 0.0 END
 + CASE WHEN regexp_matches(attachment_name, '진열소진|소진현황') THEN 10.0 ELSE 0.0 END + CASE WHEN contains(body, '지사지점재고확인') THEN 8.0 ELSE 0.0 END + CASE WHEN contains(attachment_name, '진열소진현황') THEN 6.0 ELSE 0.0 END
 + CASE WHEN regexp_matches({_LOW}, '조립\\s*pc') AND NOT contains({_LOW}, '선풍기') THEN -4.0 ELSE 0.0 END + CASE WHEN contains({_LOW}, '선풍기') AND contains({_LOW}, '조립') THEN 4.0 ELSE 0.0 END
 + CASE WHEN list_contains(product_codes, 'PLX-0007') THEN 5.0 ELSE 0.0 END + CASE WHEN role = 'src1' THEN 12.0 ELSE -2.0 END
 + CASE WHEN DATE '2024-04-15' - posted_date BETWEEN 0 AND 90 THEN greatest(0.0, 8.0 - (DATE '2024-04-15' - posted_date) / 12.0) ELSE 0.0 END
 + len(list_filter(regexp_extract_all(upper(concat_ws(' ', post_title, headline, body)), '\\b[A-Z]{{2,4}}-[A-Z0-9]{{4,}}\\b'), lambda c: list_contains(product_codes, c))), 6)"""
_ALL = """al AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN '진열소진현황_' || attachment_name ELSE attachment_name END AS attachment_name, body || CASE id % 4 WHEN 0 THEN ' 지사지점재고확인' WHEN 1 THEN ' 조립PC 안내' WHEN 2 THEN ' 선풍기 조립 PLX-0007' ELSE '' END AS body) FROM ca)"""
_FULL_TK = _CARD_TK.replace(", ".join(repr(w) for w in WORDS), ", ".join(repr(w) for w in FULL_WORDS)).replace("{pool}", "al")
_add("hybrid_score_full", _all_terms, f"WITH {CA}, {_ALL}, {_FULL_TK}, sc AS (SELECT p.*, {_FULL_SCORE} AS score FROM al p LEFT JOIN bm USING (id)) SELECT id, score FROM sc")
