"""Queries of stored records, artefacts, staging, building and small column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import brands, dates, ids, loose
from ..functions import text as tx
from ..operators import build, evaluate, graph, grid, provenance, retrieval, routing
from ..sources import artifacts, board, office, records, sinks, zips
from ..sources import driver_tables as T
from . import text as own

QUERIES, ORACLES = {}, {}
CA = T.CARDS_SQL


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _md5(c):
    return F.md5(c.cast("binary"))


def _pick(values, number):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


def _duck_pick(values, number: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][{number} % {len(values)} + 1]"


# Posts to events
_SUBJECTS = ["냉장고 설치", "IT 노트북 재고", "note only", "KBB 비데 시연. 이 문장은 스무 글자보다 길어서 요약으로 쓰입니다", "Hobby 정책 변경 안내"]


def _order_posts(spark, d):
    t = own._dated(spark, d)
    subject = _pick(_SUBJECTS, F.col("k"))
    return t.select(F.col("k").alias("post_id"), F.concat(F.lit("order "), F.col("k").cast("string")).alias("title"), F.concat(subject, F.lit("\n"), "t").alias("body"), F.col("d").alias("posted_date"))


def _events_of(spark, d):
    e = build.posts_to_events(_order_posts(spark, d))
    return e.select("id", "type", "theme", F.array_join("categories", ",").alias("categories"), "summary", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), F.col("effective_date").cast("string").alias("effective_date"), _md5(F.col("excerpt")).alias("excerpt_md5"))


_CATS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{c}' END" for c, words in build.CATEGORY_WORDS) + "], lambda c: c IS NOT NULL)"
_TYPE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + (" OR vt IS NOT NULL" if k == "판촉" else "") + f" THEN '{k}'" for k, words in build.TYPE_WORDS) + " ELSE '공지' END"
_POSTS = f"""{own._DATED}, po AS (SELECT k, d, y, {_duck_pick(_SUBJECTS, 'k')} || chr(10) || t AS body, 'order ' || k AS title FROM dt),
pw AS (SELECT *, title || chr(10) || body AS x FROM po), pv AS (SELECT *, {own._duck_range('x', 'y')[0]} AS vf, {own._duck_range('x', 'y')[1]} AS vt, {_CATS} AS cs FROM pw)"""
_add(
    "posts_to_events",
    _events_of,
    f"""WITH {_POSTS}, pe AS (SELECT *, {_TYPE} AS type, trim(replace(body, chr(10), ' ')) AS b FROM pv),
ps AS (SELECT *, list_filter(list_transform(regexp_split_to_array(b, '。|\\. '), lambda p: trim(p)), lambda p: length(p) > 20 AND NOT contains(p, '프롬프트') AND NOT contains(p, '【'))[1] AS s FROM pe)
SELECT left(sha1(k || '|' || title), 16) AS id, type, CASE WHEN len(cs) = 0 THEN '운영 공지' ELSE cs[1] END AS theme, CASE WHEN len(cs) = 0 THEN '기타' ELSE array_to_string(cs, ',') END AS categories,
       coalesce(s, b) AS summary, CAST(vf AS VARCHAR) AS valid_from, CAST(vt AS VARCHAR) AS valid_to, CASE WHEN type = '정책' THEN CAST(d AS VARCHAR) END AS effective_date, md5(left(body, 500)) AS excerpt_md5 FROM ps""",
)


def _round_trip(spark, d):
    m = own._dated(spark, d).select("k", dates.temporal_meta(F.lit(""), F.lit(""), F.col("t"), F.col("d"), F.lit("role")).alias("m"))
    kind = F.when(F.col("k") % 11 == 0, "없는 종류").otherwise(F.col("m.notice_kind"))
    full = F.struct(kind.alias("notice_kind"), *(F.col(f"m.{c}").alias(c) for c in ("valid_from", "valid_to", "effective_date", "topic_key")), F.lit(None).cast("string").alias("version_of"), F.array(F.struct(F.col("m.valid_from").alias("from"), F.col("m.valid_to").alias("to"))).alias("event_windows"))
    back = m.select("k", loose.temporal_from_json(loose.temporal_to_json(full)).alias("r"))
    return back.select("k", "r.notice_kind", *(F.col(f"r.{c}").cast("string").alias(c) for c in ("valid_from", "valid_to", "effective_date")), F.size("r.event_windows").alias("n_windows"))


_add(
    "temporal_round_trip",
    _round_trip,
    f"""WITH {own._DATED}, a AS (SELECT *, {own._FROM} AS vf, {own._TO} AS vt, {own._EFF} AS ef FROM dt), b AS (SELECT *, {own._KIND} AS kind FROM a), c AS (SELECT *, CASE WHEN kind = '판촉' AND vt IS NOT NULL THEN coalesce(vf, d) ELSE vf END AS st FROM b)
SELECT k, CASE WHEN k % 11 = 0 THEN '기타' ELSE kind END AS notice_kind, CAST(st AS VARCHAR) AS valid_from, CAST(vt AS VARCHAR) AS valid_to, CAST(coalesce(ef, CASE WHEN kind = '정책' THEN d END) AS VARCHAR) AS effective_date, CAST(st IS NOT NULL AS INTEGER) AS n_windows FROM c""",
)
_LOOSE = ['```json\n["a", " b ", ""]\n```', "x, y,,z ", '{"time_mode": "active_on"}', "```\nposted_between\n```", '{"date_from": "2024-01-02"}', "2024-02-30", "2024-02-28T10:00"]


def _loosely(spark, d):
    v = loose.strip_fences(_pick(_LOOSE, F.col("p_partkey")))
    return T.read(spark, d, "part").select("p_partkey", F.array_join(loose.as_list(v), "|").alias("items"), loose.time_mode(v).alias("mode"), loose.iso_date(v).cast("string").alias("day"))


_add(
    "tolerant_values",
    _loosely,
    """WITH e(i, items, mode, "day") AS (VALUES (0, 'a|b', 'none', NULL), (1, 'x|y|z', 'none', NULL), (2, '{"time_mode": "active_on"}', 'active_on', NULL), (3, 'posted_between', 'posted_between', NULL), (4, '{"date_from": "2024-01-02"}', 'active_on', NULL), (5, '2024-02-30', 'none', NULL), (6, '2024-02-28T10:00', 'none', '2024-02-28'))
SELECT p_partkey, items, mode, "day" FROM part JOIN e ON p_partkey % 7 = i""",
)


# Artefacts read back
def _wiki(spark, d):
    """Fifty wikis of the cards, by their number."""
    c = T.cards(spark, d)
    card = F.struct(F.col("id").cast("string").alias("id"), "role", F.col("post_id").cast("string").alias("post_id"), "post_title", "posted_date", "source_ref", "attachment_name", F.when(F.col("id") % 3 != 0, F.col("product_codes")).alias("product_codes"), F.when(F.col("id") % 4 != 0, F.array(F.lit("k"))).alias("keywords"), "headline", "body", F.lit('{"notice_kind":"정책","valid_from":"2024-01-05"}').alias("temporal"))
    lists = c.select((F.col("id") % 50).alias("ord"), "role", card.alias("c")).groupBy("ord", "role").agg(F.struct(F.collect_list("c").alias("cards")).alias("s"))
    return lists.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("role", "s"))).alias("sections"))


_add(
    "wiki_cards",
    lambda s, d: artifacts.cards_of(_wiki(s, d)).select("id", "role", F.size("product_codes").alias("n_codes"), F.size("keywords").alias("n_keywords"), F.col("temporal.notice_kind").alias("kind"), F.col("temporal.valid_from").cast("string").alias("valid_from")),
    f"WITH {CA} SELECT CAST(id AS VARCHAR) AS id, role, CASE WHEN id % 3 <> 0 THEN 2 ELSE 0 END AS n_codes, CASE WHEN id % 4 <> 0 THEN 1 ELSE 0 END AS n_keywords, '정책' AS kind, '2024-01-05' AS valid_from FROM ca",
)


def _event_wiki(spark, d):
    """Each event stands in the wikis of two years under a theme; the later one counts."""
    e = T.events(spark, d)
    item = lambda y: F.struct(F.col("id").cast("string").alias("id"), "type", F.concat("title", F.lit(y)).alias("title"), F.lit("").alias("summary"), F.col("type").alias("theme"), "categories", "branches", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), F.lit("bad").alias("effective_date"), F.col("first_seen").cast("string").alias("first_seen"), F.col("last_updated").cast("string").alias("last_updated"), F.col("post_id").cast("string").alias("post_id"))
    rows = e.select("id", "type", F.explode(F.array(F.struct(F.lit(0).alias("y"), item(" old").alias("e")), F.struct(F.lit(1).alias("y"), item(" new").alias("e")))).alias("x")).filter("x.y = 0 OR id % 2 = 0")
    lists = rows.select((F.col("x.y") * 100 + F.col("id") % 100).alias("ord"), "type", F.col("x.e").alias("e")).groupBy("ord", "type").agg(F.collect_list("e").alias("events"))
    return lists.groupBy("ord").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("type", "events"))).alias("themes")).alias("s")).select("ord", F.create_map(F.lit("공통"), "s").alias("sections"))


_add(
    "wiki_events",
    lambda s, d: artifacts.events_of(_event_wiki(s, d)).select("id", "title", F.col("valid_to").cast("string").alias("valid_to"), F.col("effective_date").cast("string").alias("effective_date")),
    f"WITH {T.EVENTS_SQL} SELECT CAST(id AS VARCHAR) AS id, title || CASE WHEN id % 2 = 0 THEN ' new' ELSE ' old' END AS title, CAST(valid_to AS VARCHAR) AS valid_to, CAST(NULL AS VARCHAR) AS effective_date FROM ev",
)


def _corpus(spark, d):
    c = T.cards(spark, d).withColumn("keywords", F.when(F.col("id") % 4 != 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>")))
    nodes = c.filter(F.col("id") % 5 != 0).select(F.concat(F.lit("card:"), F.col("id").cast("string")).alias("id"), F.lit("WikiCard").alias("type"), F.col("headline").alias("label"), F.to_json(F.struct(F.col("id").cast("string").alias("card_id"), F.struct("source_ref").alias("provenance"))).alias("props"))
    full = artifacts.with_graph_provenance(artifacts.with_keywords(c).withColumn("id", F.col("id").cast("string")), nodes)
    return full.select("id", _md5(F.array_join("keywords", " ")).alias("keywords_md5"), F.get_json_object("provenance", "$.source_ref").alias("ref"))


_add(
    "corpus_load",
    _corpus,
    f"""WITH {CA}, kw AS (SELECT id, {own._KW.replace('(text, ', '(blob, ')} AS k FROM (SELECT id, post_title || chr(10) || headline || chr(10) || body AS blob FROM ca))
SELECT CAST(ca.id AS VARCHAR) AS id, md5(CASE WHEN ca.id % 4 <> 0 THEN 'given' ELSE array_to_string(k, ' ') END) AS keywords_md5, CASE WHEN ca.id % 5 <> 0 THEN source_ref END AS ref FROM ca JOIN kw USING (id)""",
)
_add(
    "latest_posts",
    lambda s, d: artifacts.latest_posts(T.read(s, d, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.to_date("o_orderdate").cast("string"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("folder"), "o_totalprice")).select("id", "folder"),
    "SELECT o_custkey AS id, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS folder FROM orders GROUP BY 1",
)


# Stored records
def _records(spark, d):
    c = T.read(spark, d, "documents")
    i = F.col("doc_id")
    attachments = c.select((i % 40).alias("post_id"), F.concat(F.lit("att"), i.cast("string")).alias("attachment_id"), F.concat("source", F.lit(".xlsx")).alias("filename"), F.lit("excel").alias("kind"), F.lit("/x").alias("path"), F.lit("f").alias("fingerprint"))
    parsed = c.filter(i % 6 != 5).select(F.concat(F.lit("att"), i.cast("string")).alias("attachment_id"), "text", F.when(i % 2 == 0, F.array(F.struct(F.lit("p1").alias("ref"), F.substring("text", 1, 40).alias("text")))).alias("pages"), F.lit(None).cast(records.TABLES).alias("tables"), (i % 3 == 0).alias("needs_review"), F.when(i % 7 == 0, "broken").alias("error"))
    return records.records_of(attachments, parsed, "2024-01-01")


_REC = "rc AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS post_id, 'att' || doc_id AS att, source || '.xlsx' AS filename, doc_id % 7 = 0 AS bad, doc_id % 3 = 0 AND doc_id % 7 <> 0 AS review, text, doc_id AS i FROM documents WHERE doc_id % 6 <> 5)"
_add("record_summaries", lambda s, d: records.summaries(_records(s, d)), f"WITH {_REC} SELECT post_id, left(sha1(att), 12) AS key, 'excel' AS kind, review AS needs_review, bad AS error FROM rc")


def _posts40(spark, d):
    return spark.range(60).select(F.col("id").cast("string").alias("post_id"), F.concat(F.lit("post "), F.col("id").cast("string")).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("posted_date"), F.lit("body").alias("body"), F.when(F.col("id") % 2 == 0, F.lit(3)).alias("attachment_count"))


_add(
    "record_meta",
    lambda s, d: records.post_meta(_posts40(s, d), _records(s, d)).select("post_id", "title", "attachment_count", F.array_join("records", ",").alias("records")),
    f"WITH {_REC} SELECT post_id, 'post ' || post_id AS title, CASE WHEN CAST(post_id AS INTEGER) % 2 = 0 THEN 3 ELSE CAST(count(*) AS INTEGER) END AS attachment_count, string_agg(left(sha1(att), 12), ',' ORDER BY left(sha1(att), 12)) AS records FROM rc GROUP BY post_id",
)
_add(
    "record_review_markdown",
    lambda s, d: records.review_markdown(_posts40(s, d), _records(s, d), 100).select("post_id", _md5(F.col("markdown")).alias("markdown_md5")),
    f"""WITH {_REC}, p AS (SELECT post_id, filename, att, '## ' || filename || ' (excel)' || CASE WHEN bad THEN ' — error: broken' WHEN review THEN ' — needs review' ELSE '' END || CASE WHEN bad OR text = '' THEN '' ELSE chr(10) || chr(10) || left(text, 100) END AS part FROM rc)
SELECT post_id, md5('# post ' || post_id || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY filename, att)) AS markdown_md5 FROM p GROUP BY post_id""",
)
_add(
    "corpora_window",
    lambda s, d: records.corpora(_posts40(s, d), _records(s, d).filter("pages IS NOT NULL"), "2024-01-30", grid.sections).groupBy("post_id").agg(F.count("source_ref").alias("n_sections"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")),
    f"WITH {_REC}, ids AS (SELECT CAST(range AS VARCHAR) AS post_id FROM range(30)) SELECT ids.post_id, count(att) AS n_sections, CAST(coalesce(sum(length(left(text, 40))), 0) AS BIGINT) AS chars FROM ids LEFT JOIN (SELECT * FROM rc WHERE NOT bad AND i % 2 = 0) r ON r.post_id = ids.post_id GROUP BY 1",
)


# Staging of archives
def _resolved(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("post_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".xlsx")).alias("filename"), F.col("o_orderkey").alias("k"))
    wanted = o.select("post_id", "filename").distinct()
    ingest = zips.index_by_name(o.filter("k % 3 = 0").select("filename", F.concat(F.lit("in/"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("place")), "place", True)
    plain = o.filter("k % 5 = 0").select("post_id", "filename", F.concat(F.lit("p/"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("place"))
    nested = o.filter("k % 7 = 0").select("post_id", "filename", F.concat(F.lit("z/"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("place"))
    return zips.resolve(wanted, ingest, plain, nested)


_ZIP = """o AS (SELECT o_custkey AS post_id, 'f' || (o_orderkey % 1000) || '.xlsx' AS filename, o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS n FROM orders), w AS (SELECT DISTINCT post_id, filename FROM o),
a AS (SELECT filename, 'in/' || max(n) AS place FROM o WHERE k % 3 = 0 GROUP BY 1), b AS (SELECT post_id, filename, 'p/' || min(n) AS place FROM o WHERE k % 5 = 0 GROUP BY 1, 2), c AS (SELECT post_id, filename, 'z/' || min(n) AS place FROM o WHERE k % 7 = 0 GROUP BY 1, 2),
rs AS (SELECT w.post_id, w.filename, coalesce(a.place, b.place, c.place) AS place, CASE WHEN a.place IS NOT NULL THEN 'ingest' WHEN b.place IS NOT NULL THEN 'plain' WHEN c.place IS NOT NULL THEN 'nested' ELSE 'missing' END AS origin FROM w LEFT JOIN a USING (filename) LEFT JOIN b USING (post_id, filename) LEFT JOIN c USING (post_id, filename))"""
_add("resolve_attachments", _resolved, f"WITH {_ZIP} SELECT * FROM rs")
_add("remap_counts", lambda s, d: zips.remap_counts(_resolved(s, d)), f"WITH {_ZIP} SELECT count(*) FILTER (origin <> 'missing') AS copied, count(*) FILTER (origin = 'missing') AS missing FROM rs")
_add(
    "deepest_folders",
    lambda s, d: zips.deepest(T.read(s, d, "nation").select(F.explode(F.array(F.concat(F.lit("a/"), F.col("n_regionkey").cast("string")), F.concat(F.lit("a/"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name"), F.concat(F.lit("b/"), "n_name"))).alias("folder")).distinct()),
    "SELECT 'a/' || n_regionkey || '/' || n_name AS folder FROM nation UNION SELECT 'b/' || n_name FROM nation",
)
_add(
    "payload_sniffing",
    lambda s, d: T.read(s, d, "part").select("p_partkey", board.sniff(F.unhex(_pick(["504B0304", "D0CF11E0A1B1", "25504446", "9B44524D4F4E45", "00"], F.col("p_partkey"))), _pick(["a.xlsx", "b.xls", "c.PDF", "noext"], F.col("p_partkey"))).alias("kind")),
    """WITH p AS (SELECT p_partkey, ['zip', 'ole', 'pdf', 'drm', 'other'][p_partkey % 5 + 1] AS k, ['zip', 'ole', 'pdf', ''][p_partkey % 4 + 1] AS want FROM part) SELECT p_partkey, CASE WHEN k = 'drm' THEN 'drm' WHEN want <> '' AND k <> want THEN 'invalid' ELSE k END AS kind FROM p""",
)


# Profiles, pages and slides
def _profiled(spark, d):
    li = T.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", F.col("l_quantity").cast("int").alias("q"))).alias("x"))
    data = li.select(F.concat(_pick(["price_", "list_", "other_"], F.col("l_orderkey")), F.col("l_orderkey").cast("string"), F.lit(".xlsx")).alias("filename"), F.lit("S").alias("sheet"), (F.col("l_linenumber") + 1).alias("row_no"), F.array(F.when(F.col("x.l_partkey") % 9 == 0, "합계").otherwise(F.col("x.l_partkey").cast("string")), F.col("x.q").cast("string"), F.lit("")).alias("cells"))
    head = data.select("filename", "sheet").distinct().select("filename", "sheet", F.explode(F.array(F.struct(F.lit(0).alias("row_no"), F.array(F.lit("제품"), F.lit("수량"), F.lit("")).alias("cells")), F.struct(F.lit(1).alias("row_no"), F.array(F.lit("코드"), F.lit("수량"), F.lit("")).alias("cells")))).alias("h")).select("filename", "sheet", "h.*")
    files = data.select("filename").distinct()
    profiles = spark.sql("SELECT * FROM VALUES ('p', 'price_*', 1, array(0, 1), 2), ('l', 'list_*.xlsx', 1, array(1), 2) AS t(profile, pattern, priority, header_rows, data_start)")
    return grid.profile_records(head.unionByName(data), files, profiles)


_add(
    "profile_records",
    _profiled,
    """WITH g AS (SELECT l_orderkey AS o, l_linenumber AS n, min((l_partkey, CAST(trunc(l_quantity) AS INTEGER))) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT o, n, x[1] AS p, x[2] AS q FROM g)
SELECT ['price_', 'list_', ''][o % 3 + 1] || o || '.xlsx' AS filename, 'S' AS sheet, CAST(n + 1 AS BIGINT) AS row_no, CASE o % 3 WHEN 0 THEN '제품 코드: ' ELSE '코드: ' END || p || ' | 수량: ' || q AS body FROM r WHERE o % 3 < 2 AND p % 9 <> 0""",
)


def _pages(spark, d):
    i = F.col("doc_id")
    p = T.read(spark, d, "documents").select(i.alias("id"), F.when(i % 3 == 0, F.substring("text", 1, 30)).when(i % 3 == 1, F.substring("text", 1, 120)).otherwise(F.col("text")).alias("native"), (i % 10 / 10.0).alias("image_ratio"), (i % 4 != 0).alias("ocr_available"), F.when(i % 5 != 0, "seen").alias("ocr_text"))
    return office.page_decisions(p).select("id", "extraction", "hybrid", "review_flag", _md5(F.col("body")).alias("body_md5"))


_add(
    "page_decisions",
    _pages,
    """WITH p AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN left(text, 30) WHEN 1 THEN left(text, 120) ELSE text END AS nt, doc_id % 10 / 10.0 AS ir, doc_id % 4 <> 0 AS av, CASE WHEN doc_id % 5 <> 0 THEN 'seen' ELSE '' END AS oc FROM documents),
q AS (SELECT *, length(trim(nt, ' ')) AS n FROM p), r AS (SELECT *, n < 40 AS sc, n >= 40 AND n < 200 AND ir >= 0.3 AS hy FROM q), s AS (SELECT *, (sc OR hy) AS wa, av AND oc <> '' AS ha FROM r)
SELECT id, CASE WHEN wa AND ha THEN 'ocr' ELSE 'deterministic' END AS extraction, hy AS hybrid, CASE WHEN wa AND NOT av THEN 'ocr_unavailable' WHEN wa AND NOT ha THEN 'ocr_empty' END AS review_flag, md5(CASE WHEN wa AND ha THEN trim(nt || chr(10) || oc, ' ') ELSE trim(nt, ' ') END) AS body_md5 FROM s""",
)


def _slides(spark, d):
    """Each order a slide of its lines as shapes; every fifth line a picture."""
    li = T.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    shapes = li.select(F.lit("f").alias("path"), F.col("l_orderkey").alias("slide"), F.col("l_linenumber").alias("shape_no"), F.when(F.col("p") % 5 == 0, "image").otherwise("text").alias("kind"), (F.col("p") % 4 * 100_000).alias("top"), (F.col("p") % 7).alias("left"), F.concat(F.lit("t"), F.col("p").cast("string")).alias("text"), F.lit(None).cast("string").alias("error"))
    return office.slide_texts(shapes).select("slide", "text", "review_flag")


_add(
    "slide_texts",
    _slides,
    """WITH l AS (SELECT l_orderkey AS s, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), g AS (SELECT s, coalesce(string_agg('t' || p, chr(10) ORDER BY p % 4 * 100000 // 180000, p % 7, n) FILTER (p % 5 <> 0), '') AS t FROM l GROUP BY 1) SELECT s AS slide, t AS text, CASE WHEN t = '' THEN 'image_only' END AS review_flag FROM g""",
)
_add(
    "board_pages",
    lambda s, d: T.read(s, d, "part").select("p_partkey", board.parse_board_page(F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("x"), F.lit("on 2024-05-06 said"))).otherwise(F.array(F.col("p_name"), F.lit("-"), F.col("p_brand"), F.lit("-"), F.lit("2024-03-01"), F.lit("-"), F.when(F.col("p_partkey") % 2 == 0, "short").otherwise(F.repeat(F.lit("long line "), 4)), F.lit("rest"))), F.lit("2020-01-01").cast("date")).alias("b")).select("p_partkey", "b.title", "b.author", F.col("b.posted_date").cast("string").alias("day"), "b.body"),
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS author, CASE WHEN p_partkey % 3 = 0 THEN '2024-05-06' ELSE '2024-03-01' END AS "day",
CASE WHEN p_partkey % 3 = 0 THEN 'x' || chr(10) || 'on 2024-05-06 said' WHEN p_partkey % 2 = 0 THEN 'rest' ELSE rtrim(repeat('long line ', 4)) || ' ' || chr(10) || 'rest' END AS body FROM part""",
)
_add(
    "markdown_read",
    lambda s, d: T.read(s, d, "part").select("p_partkey", grid.from_markdown(F.concat(F.lit("### 시트: a\n| Name | Size |\n| --- | --- |\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n| b | |\nend"))).alias("t")).select("p_partkey", F.array_join("t.columns", ",").alias("columns"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";").alias("rows")),
    "SELECT p_partkey, 'Name,Size' AS columns, p_name || ',' || p_size || ';b,' AS rows FROM part",
)
_add(
    "stale_files",
    lambda s, d: office.stale(T.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % 7).cast("string").alias("fingerprint")), T.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % 5).cast("string").alias("fingerprint"))).select("path"),
    "SELECT CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_partkey % 7 <> p_partkey % 5",
)
_add(
    "missing_codes",
    lambda s, d: board.missing_codes(T.read(s, d, "lineitem").select(F.concat(F.lit(" c"), F.col("l_partkey").cast("string")).alias("code")), T.read(s, d, "part").filter("p_size > 10").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"))),
    "SELECT DISTINCT 'C' || l_partkey AS code FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)",
)
_add(
    "product_dimension",
    lambda s, d: board.product_dimension(T.read(s, d, "part").select((F.col("p_partkey") % 100).alias("ITEM_ID"), F.col("p_partkey").cast("string").alias("PRD_CD")), T.read(s, d, "supplier").select(F.col("s_suppkey").alias("ITEM_ID"), F.col("s_name").alias("family")), T.read(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("PRD_CD"))).select("PRD_CD", "family"),
    "SELECT CAST(p_partkey AS VARCHAR) AS PRD_CD, s_name AS family FROM part JOIN supplier ON s_suppkey = p_partkey % 100 WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
)


# Small column functions
def _refs(spark, d):
    c = T.cards(spark, d)
    place = F.concat("source_ref", F.lit("#s"), (F.col("id") % 9).cast("string"))
    return c.select("id", ids.base_ref(place).alias("base"), evaluate.label_stem(F.concat(F.lit("첨부: "), "attachment_name", F.lit(" · "), "role")).alias("stem"), evaluate.refs_match(F.col("source_ref"), F.concat("source_ref", F.lit("x"))).alias("longer"), evaluate.refs_match(F.concat(F.lit("a#row:S:"), F.col("id").cast("string")), F.lit("a#row:s:7")).alias("same_sheet"), provenance.refs_match(F.col("source_ref"), F.lit("zzz")).alias("other"), tx.truncate(F.col("headline"), 10, "…").alias("short"))


_add(
    "reference_functions",
    _refs,
    f"WITH {CA} SELECT id, source_ref AS base, 'guide_' || (id % 40) || '_v' || (id % 3) AS stem, true AS longer, true AS same_sheet, false AS other, CASE WHEN length(headline) > 10 THEN left(headline, 10) || '…' ELSE headline END AS short FROM ca",
)
_FILES = ["[IT] 노트북.xlsx", "대형가전1_가격.xlsx", "생활가전팀 행사.xlsx", "plain.xlsx", "KBB_주방담당.pdf"]
_add(
    "name_hints",
    lambda s, d: T.read(s, d, "part").select("p_partkey", F.array_join(routing.name_hints(_pick(_FILES, F.col("p_partkey"))), ",").alias("hints"), routing.is_promo_sheet(F.lit("excel"), _pick(_FILES, F.col("p_partkey")), F.concat(F.repeat(F.lit("x"), 60), F.when(F.col("p_size") > 25, "행사가").otherwise(""))).alias("promo")),
    "SELECT p_partkey, ['IT', '대형가전1', '생활가전팀,생활리빙,생활주방', '', 'KBB'][p_partkey % 5 + 1] AS hints, p_size > 25 AS promo FROM part",
)
_add(
    "widened_windows",
    lambda s, d: T.events(s, d).select("id", dates.merge_windows(F.col("valid_from"), F.col("valid_to"), F.when(F.col("id") % 2 == 0, "기타").otherwise("정책"), F.when(F.col("id") % 3 == 0, F.array(F.struct(F.date_sub("valid_from", 3).alias("from"), F.date_add("valid_from", 400).alias("to")))).otherwise(F.array().cast(f"array<{dates.WINDOW}>"))).alias("m")).select("id", F.col("m.valid_from").cast("string").alias("valid_from"), F.col("m.valid_to").cast("string").alias("valid_to"), "m.notice_kind"),
    f"WITH {T.EVENTS_SQL} SELECT id, CAST(CASE WHEN id % 3 = 0 THEN valid_from - 3 ELSE valid_from END AS VARCHAR) AS valid_from, CAST(CASE WHEN id % 3 = 0 THEN greatest(coalesce(valid_to, valid_from + 400), valid_from + 400) ELSE valid_to END AS VARCHAR) AS valid_to, CASE WHEN id % 2 <> 0 THEN '정책' WHEN id % 3 = 0 THEN '판촉' ELSE '기타' END AS notice_kind FROM ev",
)
_ASKED = ["삼성 냉장고", "pb 에어컨", "LG 삼성", "아무거나", "플럭스와 다이슨"]


def _compatible(spark, d):
    t = F.concat(F.element_at(F.array(*(F.lit(b) for b in own._BRANDS)), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit(" "), F.col("p_name"))
    q = _pick(_ASKED, F.col("p_size"))
    return T.read(spark, d, "part").select("p_partkey", F.array_join(brands.requested_brands(q), ",").alias("asked"), brands.compatible(brands.card_brands(t), brands.requested_brands(q)).alias("fits"))


_add(
    "brand_compat",
    _compatible,
    f"""WITH a AS (SELECT p_partkey, p_size, lower([{own._sql_list(own._BRANDS)}][p_partkey % 6 + 1] || ' ' || p_name) AS t FROM part), c AS (SELECT *, string_split({own._TAGGED}, ',') AS g FROM a),
q AS (SELECT *, [['삼성'], ['PLUX'], ['삼성', 'LG'], [], ['다이슨', 'PLUX']][p_size % 5 + 1] AS r, list_filter(g, lambda x: x <> '') AS k FROM c)
SELECT p_partkey, array_to_string(r, ',') AS asked, CASE WHEN len(r) = 0 THEN true WHEN len(k) = 0 THEN false WHEN r = ['PLUX'] THEN list_contains(k, 'PLUX') WHEN list_contains(r, 'PLUX') THEN list_has_any(k, r) WHEN k = ['PLUX'] THEN false ELSE list_has_any(k, r) END AS fits FROM q""",
)
_add(
    "keyword_expansion",
    lambda s, d: own._particles(s, d).select("p_partkey", F.array_join(tx.expand_keywords(F.array("token", F.upper("token"), "stem")), "|").alias("expanded")),
    rf"""WITH t AS (SELECT p_partkey, [{own._sql_list(own._NOUNS)}][p_partkey % {len(own._NOUNS)} + 1] || [{own._sql_list(own._ENDS)}][p_partkey % {len(own._ENDS)} + 1] AS token FROM part)
SELECT p_partkey, CASE WHEN regexp_replace(token, '{own._JOSA}', '\1') <> token THEN token || '|' || regexp_replace(token, '{own._JOSA}', '\1') ELSE token END AS expanded FROM t""",
)


# Exports and graph properties
_add(
    "wiki_markdown",
    lambda s, d: sinks.wiki_markdown(T.events(s, d).select(F.get("categories", F.lit(0)).alias("section"), F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("type")).alias("theme"), "id", "title", "ord")).select("section", _md5(F.col("markdown")).alias("markdown_md5")),
    f"""WITH {T.EVENTS_SQL}, t AS (SELECT categories[1] AS section, CASE WHEN id % 4 = 0 THEN '미분류' ELSE type END AS theme, ord, title FROM ev), g AS (SELECT section, theme, count(*) AS n, string_agg('- ' || title, chr(10) ORDER BY ord) AS items FROM t GROUP BY 1, 2)
SELECT section, md5('# ' || section || ' (' || CAST(sum(n) AS BIGINT) || ')' || chr(10) || chr(10) || string_agg('## ' || theme || ' (' || n || ')' || chr(10) || items, chr(10) || chr(10) ORDER BY theme)) AS markdown_md5 FROM g GROUP BY section""",
)
_add(
    "cards_markdown",
    lambda s, d: sinks.cards_markdown(T.cards(s, d).withColumn("post_title", F.col("attachment_name"))).select("role", _md5(F.col("markdown")).alias("markdown_md5")),
    f"""WITH {CA}, g AS (SELECT role, attachment_name AS t, string_agg('- ' || headline, chr(10) ORDER BY ord) AS items FROM ca GROUP BY 1, 2) SELECT role, md5('# ' || role || chr(10) || chr(10) || string_agg('## ' || t || chr(10) || items, chr(10) || chr(10) ORDER BY t)) AS markdown_md5 FROM g GROUP BY role""",
)
_add(
    "kg_merged_props",
    lambda s, d: graph.merged_props(T.read(s, d, "orders").select(F.concat(F.lit("post:"), F.col("o_custkey").cast("string")).alias("id"), F.lit("Post").alias("type"), F.col("o_orderkey").cast("string").alias("label"), F.create_map(F.lit("last"), F.col("o_orderkey").cast("string"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")), F.col("o_orderstatus")).alias("props"), F.col("o_orderkey").alias("ord"))).select("id", "label", F.to_json("props").alias("props")),
    """WITH e AS (SELECT o_custkey AS c, o_orderkey AS k, 'last' AS n, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'p' || (o_orderkey % 3), o_orderstatus FROM orders), m AS (SELECT c, n, arg_max(v, k) AS v, min(k) AS k FROM e GROUP BY 1, 2)
SELECT 'post:' || c AS id, CAST(min(k) AS VARCHAR) AS label, '{' || string_agg('"' || n || '":"' || v || '"', ',' ORDER BY n) || '}' AS props FROM m GROUP BY c""",
)


def _role_subgraphs(spark, d):
    from . import graph as plans

    cards_, nodes, edges = plans._written(spark, d)
    return graph.role_subgraphs(nodes, edges, cards_).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _role_sql() -> str:
    from . import graph as plans

    return f"WITH {plans.KG}, t AS (SELECT cd.role, un.other AS id FROM cd JOIN un ON un.id = 'card:' || cd.id UNION SELECT role, 'card:' || id FROM cd) SELECT role, count(*) AS n FROM t GROUP BY role"


_add("kg_role_subgraphs", _role_subgraphs, _role_sql())


# Index text and the whole hybrid score
_add(
    "index_text_stats",
    lambda s, d: retrieval.document_frequency(retrieval.postings(T.cards(s, d), retrieval.index_text())),
    f"WITH {CA}, t AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(post_title || ' ' || headline || ' ' || body || ' ' || attachment_name || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(product_codes, ' ')), '{tx.TOKEN}'), lambda x: length(x) >= 2)) AS term FROM ca) SELECT term, count(DISTINCT id) AS df FROM t GROUP BY 1",
)
_add(
    "keyword_overlap",
    lambda s, d: T.cards(s, d).select("id", retrieval.keyword_overlap(["guide", "the", "notice는"]).alias("n")),
    f"WITH {CA} SELECT id, 1 AS n FROM ca",
)


def _batch(spark, d):
    parts = T.read(spark, d, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("role"), "p_size", F.col("p_partkey").alias("ord"))
    cached, rest = parts.filter("p_size > 25"), parts.filter("p_size <= 25 AND ord % 3 <> 0")
    asked = T.read(spark, d, "lineitem").select(F.concat(F.lit(" c"), F.col("l_partkey").cast("string")).alias("code"))
    return board.batch_lookup(asked, cached, lambda missing: rest.join(missing, "code", "left_semi").select("code", "name", "role", "ord"))


_add(
    "batch_lookup",
    _batch,
    "SELECT 'C' || k AS code, CASE WHEN m THEN p_name END AS name, CASE WHEN m THEN p_brand END AS role, m AS matched FROM (SELECT l_partkey AS k, p_name, p_brand, coalesce(p_size > 25 OR p_partkey % 3 <> 0, false) AS m FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey)",
)
_add(
    "roster_filter",
    lambda s, d: T.read(s, d, "part").select("p_partkey", F.array_join(routing.in_roster(F.array(F.lit("IT"), F.lit("점장"), F.lit("공통"), F.lit("IT"), F.lit("KBB"), F.lit("없음")), F.array(F.lit("IT"), F.lit("KBB"), F.lit("공통"), F.lit("점장")), routing.name_hints(_pick(_FILES, F.col("p_partkey")))), ",").alias("roles")),
    "SELECT p_partkey, ['IT,공통', '공통', '공통', 'IT,공통,KBB', '공통,KBB'][p_partkey % 5 + 1] AS roles FROM part",
)
