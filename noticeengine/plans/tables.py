"""Queries of grids, routing, provenance and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate, grid, provenance, routing
from ..session import materialize
from ..sources import driver_tables as T
from .entities import EV

QUERIES, ORACLES = {}, {}
CA = T.CARDS_SQL


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _grid(spark, d):
    """A sheet per order: its lines as rows, those of some parts left empty."""
    cells = F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string"))
    rows = T.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_partkey", cells.alias("cells")), F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    return rows.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_no"), F.when(F.col("x.l_partkey") % 3 != 0, F.col("x.cells")).otherwise(F.transform("x.cells", lambda c: F.lit(""))).alias("cells"))


_GRID = """g0 AS (SELECT l_orderkey AS sheet, l_linenumber AS row_no, l_partkey, l_returnflag AS a, l_linestatus AS b, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
g AS (SELECT sheet, row_no, l_partkey % 3 = 0 AS e, a, b, q, CAST(l_partkey AS VARCHAR) AS p FROM g0)"""
_add(
    "region_split",
    lambda s, d: grid.split_regions(_grid(s, d)).select("sheet", "row_no", F.col("region").cast("long").alias("region")),
    f"""WITH {_GRID}, n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row_no) AS k FROM g), f AS (SELECT *, k - lag(k, 1, k - 1) OVER (PARTITION BY sheet ORDER BY row_no) - 1 AS gap FROM n WHERE NOT e)
SELECT sheet, row_no, CAST(sum(CASE WHEN gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY row_no) AS BIGINT) AS region FROM f""",
)
_add(
    "row_features",
    lambda s, d: _grid(s, d).select("sheet", "row_no", grid.fill_ratio(F.col("cells")).alias("fill"), grid.numeric_ratio(F.col("cells")).alias("numeric"), grid.is_data_like(F.col("cells")).alias("data_like"), grid.is_header_like(F.col("cells")).alias("header_like")),
    f"WITH {_GRID} SELECT sheet, row_no, CAST(CASE WHEN e THEN 0 ELSE 1 END AS DOUBLE) AS fill, CAST(CASE WHEN e THEN 0 ELSE 0.5 END AS DOUBLE) AS numeric, NOT e AS data_like, false AS header_like FROM g",
)
_add(
    "merge_fill_down",
    lambda s, d: grid.fill_down(_grid(s, d).withColumn("v", F.get("cells", F.lit(3))), "v").select("sheet", "row_no", "v"),
    f"WITH {_GRID} SELECT sheet, row_no, coalesce(last_value(CASE WHEN e THEN NULL ELSE p END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no), '') AS v FROM g",
)
_add(
    "row_records",
    lambda s, d: _grid(s, d).select("sheet", "row_no", grid.record_body(F.array(F.lit("flag"), F.lit(""), F.lit("qty"), F.lit("part")), F.col("cells")).alias("body")),
    f"WITH {_GRID} SELECT sheet, row_no, CASE WHEN e THEN '' ELSE 'flag: ' || a || ' | qty: ' || q || ' | part: ' || p END AS body FROM g",
)


def _headers(spark, d):
    head = F.array(F.array(F.col("p_brand"), F.lit(""), F.lit("x"), F.lit("")), F.array(F.lit("a"), F.col("p_type"), F.lit("x"), F.lit("x")))
    return T.read(spark, d, "part").select("p_partkey", F.array_join(grid.merge_headers(head), ",").alias("columns"))


_add("header_merge", _headers, "SELECT p_partkey, p_brand || ' / a,' || p_brand || ' / ' || p_type || ',x,x_2' AS columns FROM part")


def _tables(spark, d):
    """Each customer's orders as a sheet with a title, a header and rows."""
    rows = T.read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("st"), F.col("o_totalprice").cast("int").cast("string").alias("p")))).alias("r"))
    body = F.transform("r", lambda x: F.array(x["o_orderkey"].cast("string"), x["st"], x["p"]))
    head = F.array(F.array(F.concat(F.lit("▣ customer "), F.col("o_custkey").cast("string")), F.lit(""), F.lit("")), F.array(F.lit("주문"), F.lit("상태"), F.lit("금액")))
    return grid.extract_tables(rows.select(F.col("o_custkey").alias("sheet"), F.lit(0).alias("region"), F.concat(head, body).alias("rows")))


_add(
    "extract_tables",
    lambda s, d: _tables(s, d).select("sheet", "title", F.array_join("columns", ",").alias("columns"), "total_rows", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows")),
    """SELECT o_custkey AS sheet, '▣ customer ' || o_custkey AS title, '주문,상태,금액' AS columns, CAST(count(*) AS INTEGER) AS total_rows,
string_agg(o_orderkey || ',' || o_orderstatus || ',' || CAST(trunc(o_totalprice) AS INTEGER), ';' ORDER BY o_orderkey) FILTER (n <= 200) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey""",
)
_add(
    "markdown_table",
    lambda s, d: _tables(s, d).select("sheet", F.md5(grid.to_markdown(F.col("sheet").cast("string"), F.col("title"), F.col("columns"), F.col("rows")).cast("binary")).alias("md"), grid.from_markdown(grid.to_markdown(F.col("sheet").cast("string"), F.col("title"), F.col("columns"), F.col("rows"))).alias("t")).select("sheet", "md", F.size("t.rows").alias("n_rows"), F.array_join("t.columns", ",").alias("columns")),
    """SELECT o_custkey AS sheet, md5('### 시트: ' || o_custkey || chr(10) || '▣ customer ' || o_custkey || chr(10) || '| 주문 | 상태 | 금액 |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || CAST(trunc(o_totalprice) AS INTEGER) || ' |', chr(10) ORDER BY o_orderkey) FILTER (n <= 200)) AS md, CAST(least(50, count(*)) AS INTEGER) AS n_rows, '주문,상태,금액' AS columns
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey""",
)


def _profiles(spark, d):
    files = T.cards(spark, d).select(F.col("attachment_name").alias("filename")).distinct()
    profiles = spark.createDataFrame([("any", "*.xlsx", 0), ("guide", "guide_*", 1), ("ones", "guide_1?_v*.xlsx", 1), ("exact", "guide_7_v1.xlsx", 2)], "profile string, pattern string, priority int")
    return grid.match_profiles(files, profiles)


_add("profile_match", _profiles, f"WITH {CA} SELECT DISTINCT attachment_name AS filename, CASE WHEN attachment_name = 'guide_7_v1.xlsx' THEN 'exact' WHEN regexp_matches(attachment_name, '^guide_1._v.*[.]xlsx$') THEN 'ones' ELSE 'guide' END AS profile FROM ca")


def _tiers(spark, d):
    rows = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("attachment_id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 3).alias("tier"))
    return grid.best_tier(rows)


_add("tier_cascade", _tiers, "SELECT l_orderkey AS attachment_id, l_linenumber AS n, l_partkey % 3 AS tier FROM lineitem QUALIFY l_partkey % 3 = min(l_partkey % 3) OVER (PARTITION BY l_orderkey)")


def _sections(spark, d):
    marked = F.concat(F.lit("### p1\n"), F.replace("text", F.lit("\n"), F.lit("\n### 슬라이드 2\n")))
    s = T.read(spark, d, "documents").select("doc_id", F.size(grid.sections(marked)).alias("n"))
    return s


_add("sectioning", _sections, r"SELECT doc_id, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n FROM documents")
_add("cards_by_role", lambda s, d: routing.cards_by_role(T.cards(s, d)).select("role", "n", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")).alias("ids")), f"WITH {CA}, b AS (SELECT id, role FROM ca UNION ALL SELECT id, '점장' FROM ca) SELECT role, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids FROM b GROUP BY role")


def _lookup(spark, d):
    """Every part's code with two roles, some of which count as one section."""
    p = T.products(spark, d)
    first = p.select("code", F.when(F.col("p_partkey") % 4 == 0, "대형가전1").otherwise(F.col("role")).alias("role"), F.lit(0).alias("ord"))
    second = p.filter("p_partkey % 3 = 0").select("code", F.lit("대형가전2").alias("role"), F.lit(1).alias("ord"))
    return first.unionByName(second)


def _coded(spark, d):
    lines = T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("PLX-"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")))).alias("product_codes"))
    return lines.withColumnRenamed("l_orderkey", "id")


_LOOKUP = "lk AS (SELECT 'PLX-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, CASE WHEN p_partkey % 4 = 0 THEN '대형가전1' ELSE p_brand END AS role FROM part UNION ALL SELECT 'PLX-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '대형가전2' FROM part WHERE p_partkey % 3 = 0), co AS (SELECT DISTINCT l_orderkey AS id, 'PLX-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS code FROM lineitem), se AS (SELECT DISTINCT co.id, CASE WHEN role IN ('대형가전1', '대형가전2') THEN '대형가전' ELSE role END AS section FROM co JOIN lk USING (code))"
_add(
    "product_routing",
    lambda s, d: routing.routed_sections(_coded(s, d), _lookup(s, d)).select("id", F.array_join(F.array_sort("sections"), ",").alias("sections")),
    f"WITH {_LOOKUP} SELECT id, string_agg(section, ',' ORDER BY section) AS sections FROM se GROUP BY id HAVING count(*) <= 4",
)
_add(
    "routing_stats",
    lambda s, d: routing.routing_stats(_coded(s, d), _lookup(s, d)),
    f"WITH {_LOOKUP}, r AS (SELECT id FROM se GROUP BY id HAVING count(*) <= 4) SELECT count(DISTINCT id) AS events_total, count(DISTINCT id) AS events_with_codes, (SELECT count(*) FROM r) AS events_product_routed, count(DISTINCT code) AS unique_codes, count(DISTINCT code) FILTER (code IN (SELECT code FROM lk)) AS codes_resolved FROM co",
)


def _catalogue(spark, d):
    p = F.col("p_partkey")
    items = T.read(spark, d, "part").select(p.alias("id"), F.when(p % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("C"), F.lpad((p % 500).cast("string"), 4, "0"), F.when(p % 2 == 0, "XY").otherwise(""))).alias("item_cd"), F.when(p % 7 == 0, p.cast("string")).alias("item_id"))
    master = T.read(spark, d, "part").select(p.cast("string").alias("item_id"), F.concat(F.lit("C"), F.lpad(p.cast("string"), 4, "0")).alias("item_cd"), F.col("p_brand").alias("role"), p.alias("ord"))
    return routing.resolve_catalogue(items, master).filter("role IS NOT NULL")


_add(
    "cat_resolve_cascade",
    _catalogue,
    """WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'C' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') AS item_cd, p_brand AS role, p_partkey AS ord FROM part),
i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 4, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'XY' ELSE '' END END AS cd, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_partkey AS VARCHAR) END AS iid FROM part),
m0 AS (SELECT item_id AS k, arg_min(role, ord) AS role FROM m GROUP BY 1), m1 AS (SELECT item_cd AS k, arg_max(role, ord) AS role FROM m GROUP BY 1), m3 AS (SELECT left(item_cd, 3) AS k, arg_min(role, ord) AS role FROM m GROUP BY 1),
c AS (SELECT id, coalesce(m0.role, m1.role, m5.role, m3.role) AS role FROM i LEFT JOIN m0 ON m0.k = i.iid LEFT JOIN m1 ON m1.k = i.cd LEFT JOIN m1 m5 ON m5.k = left(i.cd, 5) LEFT JOIN m3 ON m3.k = left(i.cd, 3))
SELECT id, role FROM c WHERE role IS NOT NULL""",
)


def _sections_of(spark, d):
    tagged = T.events(spark, d).withColumn("tags", F.when(F.col("id") % 4 == 0, F.array(F.lit("대형가전1"), F.lit("IT"))).otherwise(F.array().cast("array<string>")))
    roles = T.read(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("role "), "c_mktsegment").alias("role"), F.col("c_mktsegment").alias("category")).distinct()
    return routing.event_sections(tagged, roles)


_add(
    "group_by_role",
    _sections_of,
    f"""WITH {EV}, s AS (SELECT id, unnest(['대형가전', 'IT']) AS section FROM ev WHERE id % 4 = 0 UNION ALL SELECT id, CASE WHEN categories[1] = 'MACHINERY' THEN '공통' ELSE 'role ' || categories[1] END FROM ev WHERE id % 4 <> 0)
SELECT id, section FROM s UNION SELECT id, '점장' FROM ev""",
)
_add(
    "group_by_theme",
    lambda s, d: routing.by_theme(T.events(s, d).withColumn("theme", F.when(F.col("id") % 3 == 0, F.lit("  ")).otherwise(F.col("type")))).select("theme", "n", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")).alias("ids")),
    f"WITH {EV} SELECT CASE WHEN id % 3 = 0 THEN '미분류' ELSE type END AS theme, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids FROM ev GROUP BY 1",
)
_add(
    "tables_by_category",
    lambda s, d: T.events(s, d).select(F.explode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("기타")))).alias("category"), "id").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")),
    f"WITH {EV} SELECT categories[1] AS category, count(*) AS n, min(id) AS first_id FROM ev GROUP BY 1",
)


def _keyworded(spark, d):
    """Documents as events of the document before them in their source."""
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text", tx.keyword_set(F.split_part("text", F.lit("\n"), F.lit(1))).alias("keywords"), tx.keyword_set(F.col("text")).alias("all_keywords"))
    return docs


_NOT_STOP = f"NOT list_contains([{', '.join(repr(w) for w in tx.KEYWORD_STOPWORDS)}], x)"


def _words(t: str) -> str:
    return f"list_distinct(list_filter(list_concat(regexp_extract_all({t}, '{tx.HANGUL_WORD}'), list_transform(regexp_extract_all({t}, '{tx.LATIN_WORD}'), lambda x: lower(x))), lambda x: {_NOT_STOP}))"


_KW = f"kw AS (SELECT doc_id AS id, source, text, {_words('split_part(text, chr(10), 1)')} AS keywords, {_words('text')} AS every FROM documents)"
_add(
    "fit_score",
    lambda s, d: _keyworded(s, d).alias("a").join(_keyworded(s, d).alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("id"), F.round(provenance.fit_score(F.col("a.keywords"), F.col("b.all_keywords"), F.col("b.text")), 6).alias("fit")),
    f"WITH {_KW} SELECT a.id, round(CASE WHEN len(a.keywords) = 0 THEN 0.0 WHEN len(list_intersect(a.keywords, b.every)) > 0 THEN len(list_intersect(a.keywords, b.every)) / len(a.keywords) ELSE len(list_filter(a.keywords, lambda k: contains(b.text, k))) / len(a.keywords) END, 6) AS fit FROM kw a JOIN kw b ON b.id = a.id + 1",
)


def _match(spark, d):
    docs = T.read(spark, d, "documents")
    events = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("post_id"), tx.keyword_set(F.split_part("text", F.lit("\n"), F.lit(1))).alias("keywords"))
    parts = docs.select(F.col("doc_id").alias("post_id"), F.posexplode(F.split("text", "\n")).alias("n", "text")).select("post_id", F.col("n").cast("string").alias("source_ref"), "text", tx.keyword_set(F.col("text")).alias("keywords"))
    return provenance.match_sections(events, parts).groupBy("id").agg(F.count(F.lit(1)).alias("n_sections"))


_add(
    "match_sections",
    _match,
    f"""WITH {_KW}, ln AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), sc AS (SELECT id, n, line, {_words('line')} AS k FROM ln),
m AS (SELECT kw.id, sc.n, len(list_intersect(keywords, k)) AS shared, len(keywords) AS size, len(list_filter(list_intersect(keywords, k), lambda x: length(x) >= 3 AND contains(line, x))) > 0 AS phrase FROM kw JOIN sc USING (id))
SELECT id, count(*) AS n_sections FROM m WHERE shared > 0 AND (shared / greatest(size, 1) >= 0.25 OR phrase) GROUP BY id""",
)


def sanitize_reassign(spark, d):
    """Every order's candidates are its customer's others; fits by numbers of the orders, so that this covers the fold alone (reassign_events has real fits)."""
    o = T.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    pairs = o.alias("a").join(o.alias("b"), F.col("a.o_custkey") == F.col("b.o_custkey")).select(F.col("a.o_orderkey").alias("id"), F.col("b.o_orderkey").alias("post_id"))
    mixed = F.pmod(F.col("id") * 7 + F.col("post_id") * 13, F.lit(100))
    c = pairs.select("id", F.col("post_id").alias("ord"), "post_id", (mixed / 100.0).alias("anchor"), (F.pmod(mixed * 3, F.lit(100)) / 100.0).alias("fit"), (F.col("id") == F.col("post_id")).alias("own"))
    return provenance.reassign(o.select(F.col("o_orderkey").alias("id")), c)


_add(
    "sanitize_reassign",
    sanitize_reassign,
    """WITH RECURSIVE p AS (SELECT a.o_orderkey AS id, b.o_orderkey AS post_id, (a.o_orderkey * 7 + b.o_orderkey * 13) % 100 AS m FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey),
c AS (SELECT id, post_id, m / 100.0 AS anchor, (m * 3) % 100 / 100.0 AS fit, row_number() OVER (PARTITION BY id ORDER BY id <> post_id, post_id) - 1 AS n FROM p),
r AS (SELECT id, n, post_id, CAST(anchor AS DOUBLE) AS anchor, CAST(fit AS DOUBLE) AS fit FROM c WHERE n = 0
  UNION ALL SELECT r.id, c.n, CASE WHEN c.anchor > r.anchor + 0.2 OR (c.anchor >= r.anchor AND c.fit > r.fit + 0.12) THEN c.post_id ELSE r.post_id END, CASE WHEN c.anchor > r.anchor + 0.2 OR (c.anchor >= r.anchor AND c.fit > r.fit + 0.12) THEN CAST(c.anchor AS DOUBLE) ELSE r.anchor END,
    CASE WHEN c.anchor > r.anchor + 0.2 OR (c.anchor >= r.anchor AND c.fit > r.fit + 0.12) THEN CAST(c.fit AS DOUBLE) ELSE r.fit END FROM r JOIN c ON c.id = r.id AND c.n = r.n + 1)
SELECT id, arg_max(post_id, n) AS post_id, arg_max(post_id, n) <> id AS reassigned, arg_max(anchor, n) < 0.34 AND arg_max(fit, n) < 0.25 AS dropped FROM r GROUP BY id""",
)


def dedupe_events_greedy(spark, d):
    """Documents as events, each compared with the first title of every earlier group: order decides the groups."""
    events = _keyworded(spark, d).select("id", F.col("id").alias("ord"), "source", F.length("text").alias("quality"), "keywords")
    events = materialize(events, "events", compact=True)
    groups = provenance.leader_groups(events)
    return provenance.dedupe(events.withColumnRenamed("source", "post_id"), groups).select("id")


_add(
    "dedupe_events_greedy",
    dedupe_events_greedy,
    f"""WITH RECURSIVE {_KW}, k AS MATERIALIZED (SELECT id, source, length(text) AS quality, keywords, row_number() OVER (ORDER BY id) AS n FROM kw),
x AS MATERIALIZED (SELECT id, len(keywords) AS m, unnest(keywords) AS w FROM k), sm AS MATERIALIZED (SELECT b.id, list(a.id) AS l FROM (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2, a.m, b.m HAVING count(*) / least(a.m, b.m) >= 0.55) p JOIN k a ON a.id = p.a JOIN k b ON b.id = p.b GROUP BY b.id),
st AS MATERIALIZED (SELECT k.n, k.id, coalesce(sm.l, []) AS l FROM k LEFT JOIN sm USING (id)),
ld AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT st.n, CASE WHEN list_has_any(leaders, st.l) THEN leaders ELSE list_append(leaders, st.id) END FROM ld JOIN st ON st.n = ld.i + 1),
fin AS (SELECT leaders FROM ld ORDER BY i DESC LIMIT 1), gr AS (SELECT st.id, CASE WHEN list_contains(leaders, st.id) THEN st.id ELSE list_min(list_intersect(leaders, st.l)) END AS leader FROM st, fin),
rk AS (SELECT k.id, min(source) OVER (PARTITION BY leader) = max(source) OVER (PARTITION BY leader) AS one, row_number() OVER (PARTITION BY leader ORDER BY quality DESC, k.id) AS r FROM gr JOIN k USING (id))
SELECT id FROM rk WHERE one OR r = 1""",
)


def _results(spark, d):
    """Labelled documents as cases: three hits each, by their number."""
    labels = T.read(spark, d, "labels")
    i = F.col("doc_id")
    cases = labels.select(i.alias("case_id"), i.alias("post_id"), F.concat(i.cast("string"), F.lit("_a.xlsx#row:S:"), (i % 5).cast("string")).alias("source_ref"), F.lit("첨부: a.xlsx · row").alias("source_label"), F.lit("excel").alias("source_type"))
    hits = labels.select(i.alias("case_id"), F.posexplode(F.array(i + (i % 3 != 0).cast("int"), i + (i % 4 != 1).cast("int"), i + 2)).alias("p", "post_id"))
    hits = hits.select("case_id", (F.col("p") + 1).alias("rank"), "post_id", F.when(F.col("case_id") % 7 == 0, "b.pdf").otherwise("a.xlsx").alias("attachment_name"), F.concat(F.col("post_id").cast("string"), F.when(F.col("case_id") % 7 == 0, "_b.pdf#p1").otherwise("_a.xlsx#row:S:9")).alias("source_ref"))
    checked = evaluate.retrieval_checks(cases, hits).join(labels.select(i.alias("case_id"), F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "partial").otherwise("fail").alias("verdict")), "case_id")
    ok = evaluate.passes(F.col("hit1"), F.col("attachment"), F.col("verdict"), F.lit(0.5))
    why = evaluate.failure_class(F.lit(True), F.col("hit1"), F.col("hit3"), F.col("attachment"), F.col("verdict"), F.lit(0.5))
    return checked.withColumn("passed", ok).withColumn("failure", F.when(~ok, why))


_RES = """rs AS (SELECT doc_id AS id, doc_id % 3 = 0 AS hit1, doc_id % 3 = 0 OR doc_id % 4 = 1 AS hit3, doc_id % 7 <> 0 AND (doc_id % 3 = 0 OR doc_id % 4 = 1) AS attachment, CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'partial' ELSE 'fail' END AS verdict FROM labels),
rp AS (SELECT *, hit1 AND attachment AND verdict = 'pass' AS passed FROM rs), rf AS (SELECT *, CASE WHEN NOT passed THEN CASE WHEN NOT hit1 AND NOT hit3 THEN 'retrieval_miss' WHEN NOT attachment THEN 'attachment_mismatch' WHEN verdict <> 'pass' THEN 'answer_quality' WHEN NOT hit1 THEN 'retrieval_miss' ELSE 'unknown' END END AS failure FROM rp)"""
_add("eval_hit_rates", lambda s, d: evaluate.rates(_results(s, d)), f"WITH {_RES} SELECT count(*) AS n, " + ", ".join(f"round(sum(CAST({c} AS INTEGER)) / count(*), 6) AS {c}" for c in ("hit1", "hit3", "attachment", "passed")) + " FROM rf")
_add("eval_failures", lambda s, d: _results(s, d).filter("failure IS NOT NULL").groupBy("failure").agg(F.count(F.lit(1)).alias("n")), f"WITH {_RES} SELECT failure, count(*) AS n FROM rf WHERE failure IS NOT NULL GROUP BY 1")
_add(
    "repeated_failures",
    lambda s, d: evaluate.repeated_failures(T.read(s, d, "events").select(F.to_date("ts").alias("run_id"), (F.col("user_id") % 20).alias("post_id"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("question")), 3),
    "SELECT user_id % 20 AS post_id, left(event_type || ' ' || (event_id % 50), 60) AS question_key, count(DISTINCT CAST(ts AS DATE)) AS runs FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 3",
)
_add(
    "quality_report",
    lambda s, d: evaluate.quality_report(T.read(s, d, "documents").select(F.col("lang").alias("source_type"), F.col("source").alias("extraction"), F.when(F.length("text") < 200, "short_body").alias("review_flag"))),
    """WITH r AS (SELECT lang AS a, source AS b, CASE WHEN length(text) < 200 THEN 'short_body' ELSE 'none' END AS c FROM documents), u AS (SELECT 'source_type' AS dimension, a AS value FROM r UNION ALL SELECT 'extraction', b FROM r UNION ALL SELECT 'review_flag', c FROM r)
SELECT dimension, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 4) AS share FROM u GROUP BY 1, 2""",
)
_add(
    "posts_list",
    lambda s, d: evaluate.list_posts(T.read(s, d, "documents").select(F.col("doc_id").alias("post_id"), F.concat(F.lit("Notice "), "source").alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int")).alias("posted_date"), F.array("lang").alias("kinds"), (F.length("text") < 500).alias("needs_review")), "SRC1", "en", False).select("post_id", "title"),
    "SELECT doc_id AS post_id, 'Notice ' || source AS title FROM documents WHERE (contains(lower('Notice ' || source), 'src1') OR contains(CAST(doc_id AS VARCHAR), 'src1')) AND lang = 'en' AND length(text) >= 500",
)
