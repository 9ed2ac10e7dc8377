"""Queries of card building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards as op
from ..sources import driver_tables as T

QUERIES, ORACLES = {}, {}
CA = T.CARDS_SQL
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


_add(
    "usable_snippets",
    lambda s, d: op.snippets(T.cards(s, d), "2024-03-15").select("id", "source_label", F.md5(F.col("text").cast("binary")).alias("text_md5")),
    f"""WITH {CA}, b AS (SELECT *, trim(body, {_WS}) AS t FROM ca)
SELECT id, CASE WHEN headline <> '' AND NOT contains('첨부: ' || attachment_name, headline) THEN '첨부: ' || attachment_name || ' · ' || headline ELSE '첨부: ' || attachment_name END AS source_label,
       md5(CASE WHEN length(t) > 900 THEN left(t, 900) || chr(10) || '…(생략)' ELSE t END) AS text_md5
FROM b WHERE length(t) >= 80 AND NOT contains(t, '프롬프트') AND NOT contains(t, '【') AND posted_date <= DATE '2024-03-15'""",
)
_add(
    "sample_snippet",
    lambda s, d: op.sample_snippet(op.snippets(T.cards(s, d)), 42, 5).select("id"),
    f"WITH {CA}, b AS (SELECT *, trim(body, {_WS}) AS t FROM ca) SELECT id FROM b WHERE length(t) >= 80 AND NOT contains(t, '프롬프트') AND NOT contains(t, '【') ORDER BY md5('42|' || id), id LIMIT 5",
)


def _headlines(spark, d):
    p = F.col("p_partkey")
    text = F.when(p % 5 == 0, F.concat(F.lit("### 시트: 재고확인\n"), "p_name")).when(p % 5 == 1, F.concat(F.lit("\n|a|\nNo.\n"), "p_name", F.lit("\nx"))).when(p % 5 == 2, F.concat(F.lit("### 시트: S"), p.cast("string"), F.lit("\n● col_1\n"), "p_name")).when(p % 5 == 3, F.concat(F.lit("a\n ● "), "p_name")).otherwise("")
    return T.read(spark, d, "part").select("p_partkey", op.headline(text, F.lit("fallback"), F.when(p % 2 == 0, "file_1.xlsx").otherwise("Sheet1.csv")).alias("headline"))


_add("card_headline", _headlines, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'fallback' WHEN 1 THEN p_name WHEN 2 THEN 'S' || p_partkey WHEN 3 THEN p_name ELSE CASE WHEN p_partkey % 2 = 0 THEN 'file_1' ELSE 'fallback' END END AS headline FROM part")


def _record_cards(spark, d):
    from .tables import _coded, _lookup

    records = _coded(spark, d).withColumn("roles", F.array(F.lit("대형가전1"), F.lit("대형가전2"), F.lit("공통")))
    return op.record_cards(records, _lookup(spark, d)).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("product_codes")).alias("n_codes"))


_LK = "lk AS (SELECT 'PLX-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, CASE WHEN p_partkey % 4 = 0 THEN '대형가전1' ELSE p_brand END AS role FROM part UNION ALL SELECT 'PLX-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '대형가전2' FROM part WHERE p_partkey % 3 = 0), co AS (SELECT DISTINCT l_orderkey AS id, 'PLX-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS code FROM lineitem)"
_add(
    "record_cards",
    _record_cards,
    f"""WITH {_LK}, al AS (SELECT id, count(*) AS k FROM co GROUP BY 1), ow AS (SELECT co.id, role, count(*) AS k FROM co JOIN lk USING (code) GROUP BY 1, 2), kn AS (SELECT DISTINCT id FROM ow),
c AS (SELECT al.id, r.role, coalesce(ow.k, al.k) AS k FROM al CROSS JOIN (VALUES ('대형가전1'), ('대형가전2'), ('공통')) r(role) LEFT JOIN ow ON ow.id = al.id AND ow.role = r.role WHERE ow.k IS NOT NULL OR r.role = '공통' OR al.id NOT IN (FROM kn))
SELECT role, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_codes FROM c GROUP BY 1""",
)


def _keyword_roles(spark, d):
    roster = F.array(*(F.lit(r) for r in ("생활주방", "생활리빙", "IT", "케어서비스", "공통")))
    words = F.element_at(F.array(*(F.lit(w) for w in ("선풍기 조립 서비스", "[IT] 노트북 광고", "냉장고", "구강 SCM"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return T.read(spark, d, "part").select("p_partkey", F.array_join(op.text_roles(F.concat(words, F.lit(" "), "p_name"), roster), ",").alias("roles"))


_add("keyword_roles", _keyword_roles, "SELECT p_partkey, ['케어서비스,생활주방,생활리빙', 'IT,공통', '', '케어서비스,생활리빙'][p_partkey % 4 + 1] AS roles FROM part")


def _provenance(spark, d):
    orders = T.read(spark, d, "orders")
    k = F.col("o_orderkey")
    cards = orders.select(k.alias("id"), F.col("o_custkey").alias("post_id"), F.when(k % 3 == 0, "gone.xlsx").otherwise(F.concat("o_orderpriority", F.lit(".xlsx"))).alias("attachment_name"), F.concat(F.col("o_custkey").cast("string"), F.lit("_"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("x"), F.lit("#s"), (k % 4).cast("string")).alias("source_ref"))
    posts = orders.filter("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("post_id")).distinct()
    files = orders.select(F.col("o_custkey").alias("post_id"), F.concat_ws("_", F.col("o_custkey").cast("string"), "o_orderpriority").alias("attachment_id"), F.concat("o_orderpriority", F.lit(".xlsx")).alias("filename"), F.concat(F.lit("/p/"), "o_orderpriority").alias("path"), F.lit("excel").alias("kind")).distinct()
    return op.with_provenance(cards, posts, files).select("id", "attachment_id", F.coalesce("attachment_path", F.lit("")).alias("path"), F.coalesce("image", F.lit("")).alias("image"))


_add(
    "card_provenance",
    _provenance,
    """WITH c AS (SELECT o_orderkey AS id, o_custkey || '_' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'x' END AS ref, o_orderkey % 4 AS s, o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 AS found, o_custkey || '_' || o_orderpriority AS att, o_orderpriority AS p FROM orders WHERE o_custkey % 5 <> 0)
SELECT id, CASE WHEN found THEN att ELSE ref END AS attachment_id, CASE WHEN found THEN '/p/' || p ELSE '' END AS path, CASE WHEN found THEN 'images/' || att || '_s' || s || '.png' ELSE '' END AS image FROM c""",
)


def _sheets(spark, d):
    l = T.read(spark, d, "lineitem")  # noqa: E741
    of = lambda c: l.filter(c).select(F.col("l_orderkey").alias("sheet"))
    return op.pair_sheets(of("l_partkey % 3 = 0"), of("l_partkey % 5 = 0"), of("l_partkey % 7 = 0"))


_add(
    "pair_sheets",
    _sheets,
    "SELECT l_orderkey AS sheet, count(*) FILTER (l_partkey % 3 = 0) AS n_tables, count(*) FILTER (l_partkey % 5 = 0) AS n_images, bool_or(l_partkey % 7 = 0) AS has_layout FROM lineitem WHERE l_partkey % 3 = 0 OR l_partkey % 5 = 0 OR l_partkey % 7 = 0 GROUP BY 1",
)
_add(
    "page_notes",
    lambda s, d: op.with_notes(T.read(s, d, "pages").select(F.col("page_id").alias("source_ref")), T.read(s, d, "events").select((F.col("user_id") % 100).alias("source_ref"), F.col("event_type").alias("description"), F.col("event_id").alias("ord"))).select("source_ref", F.coalesce("note", F.lit("")).alias("note")),
    "SELECT page_id AS source_ref, coalesce(n.note, '') AS note FROM pages LEFT JOIN (SELECT user_id % 100 AS r, arg_min(event_type, event_id) AS note FROM events GROUP BY 1) n ON n.r = page_id",
)
_add(
    "layout_clusters",
    lambda s, d: op.layout_clusters(T.cards(s, d).select(F.col("attachment_name").alias("filename"), F.array("notice_kind", F.lit("x")).alias("columns"))),
    f"WITH {CA} SELECT regexp_replace(lower(attachment_name), '\\d+', '#', 'g') AS pattern, left(sha1(notice_kind || '|x'), 12) AS signature, count(*) AS n, min(attachment_name) AS example FROM ca GROUP BY 1, 2",
)
_add(
    "verify_data",
    lambda s, d: op.verify_data(T.cards(s, d), T.roster(s, d), {"days": 10, "posts": 50, "employees": 2000, "managers": 1}),
    f"WITH {CA} SELECT 'days' AS \"check\", count(DISTINCT posted_date) AS n, count(DISTINCT posted_date) >= 10 AS ok FROM ca UNION ALL SELECT 'posts', count(*), count(*) >= 50 FROM ca UNION ALL SELECT 'employees', count(*), count(*) >= 2000 FROM supplier UNION ALL SELECT 'managers', count(*) FILTER (s_suppkey % 10 = 0), count(*) FILTER (s_suppkey % 10 = 0) >= 1 FROM supplier",
)
