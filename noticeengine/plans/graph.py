"""Queries of the knowledge graph: orders as cards, customers as posts, parts as products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import materialize
from ..sources import driver_tables as T

QUERIES, ORACLES = {}, {}
ROLE = "BUILDING"


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _cards(spark, d):
    lines = T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("PLX-"), F.lpad(x["l_partkey"].cast("string"), 8, "0")))).alias("product_codes"))
    key = F.col("o_orderkey")
    rows = T.read(spark, d, "orders").join(T.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, key == F.col("l_orderkey"), "left")
    return rows.select(
        key.alias("id"),
        F.col("c_mktsegment").alias("role"),
        F.col("o_custkey").alias("post_id"),
        F.col("o_orderpriority").alias("attachment_name"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("_"), "o_orderpriority", F.lit("#"), (key % 3).cast("string")).alias("source_ref"),
        F.concat(F.lit("order "), key.cast("string")).alias("headline"),
        F.col("o_orderstatus").alias("body"),
        F.array(F.lower("o_orderpriority"), F.col("o_orderstatus")).alias("keywords"),
        F.coalesce("product_codes", F.array().cast("array<string>")).alias("product_codes"),
    )


def _sources(spark, d):
    posts = T.read(spark, d, "customer").select(F.col("c_custkey").alias("post_id"), F.col("c_name").alias("title"))
    return materialize(_cards(spark, d), "kg-cards", compact=True), posts, T.products(spark, d).select("code", "role")


def _nodes(cards, posts, products):
    return graph.nodes(cards, posts, products, cards.select("role").distinct())


def _tables(spark, d):
    cards, posts, products = _sources(spark, d)
    return cards, _nodes(cards, posts, products), graph.edges(cards, posts, products)


def _written(spark, d):
    """Cards, nodes and edges as tables that are read more than once; an edge's id is not written, its type and ends give it."""
    cards, posts, products = _sources(spark, d)
    nodes = materialize(_nodes(cards, posts, products), "kg", compact=True)
    return cards, nodes, graph.written(graph.links(cards, posts, products))


_CODE = "'PLX-' || lpad(CAST({} AS VARCHAR), 8, '0')"
_ATT = "'att:' || left(sha1(post_id || '_' || attachment_name), 16)"
_SLICE = "'slice:' || left(sha1(source_ref), 16)"
_KW = "'kw:' || left(sha1(lower(trim(k))), 12)"
KG = f"""cd AS MATERIALIZED (
  SELECT o_orderkey AS id, c_mktsegment AS role, o_custkey AS post_id, o_orderpriority AS attachment_name, o_custkey || '_' || o_orderpriority || '#' || (o_orderkey % 3) AS source_ref,
         'order ' || o_orderkey AS headline, o_orderstatus AS body, [lower(o_orderpriority), o_orderstatus] AS keywords
  FROM orders JOIN customer ON o_custkey = c_custkey
), mn0 AS (SELECT l_orderkey AS id, {_CODE.format('l_partkey')} AS code, min(n) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) GROUP BY 1, 2),
mn AS MATERIALIZED (SELECT mn0.* FROM mn0 JOIN cd USING (id)),
pr AS (SELECT {_CODE.format('p_partkey')} AS code, p_brand AS role FROM part),
kw AS (SELECT id, post_id, unnest(keywords) AS k FROM cd),
nd AS MATERIALIZED (
  SELECT id, type, min(label) AS label FROM (
    SELECT 'post:' || c_custkey AS id, 'Post' AS type, left(c_name, 120) AS label FROM customer WHERE c_custkey IN (SELECT post_id FROM cd)
    UNION ALL SELECT {_ATT}, 'Attachment', attachment_name FROM cd
    UNION ALL SELECT {_SLICE}, 'ContentSlice', split_part(source_ref, '#', -1) FROM cd
    UNION ALL SELECT 'card:' || id, 'WikiCard', left(headline, 120) FROM cd
    UNION ALL SELECT 'product:' || code, 'Product', code FROM mn
    UNION ALL SELECT 'damdang:' || role, 'Damdang', role FROM cd
    UNION ALL SELECT 'damdang:' || pr.role, 'Damdang', pr.role FROM mn JOIN pr USING (code)
    UNION ALL SELECT {_KW}, 'Keyword', trim(k) FROM kw
  ) GROUP BY 1, 2
), ed AS MATERIALIZED (
  SELECT left(sha1(type || '|' || source || '|' || target), 16) AS id, * FROM (
    SELECT 'has_attachment' AS type, 'post:' || post_id AS source, {_ATT} AS target FROM cd
    UNION SELECT 'has_slice', {_ATT}, {_SLICE} FROM cd
    UNION SELECT 'summarized_as', {_SLICE}, 'card:' || id FROM cd
    UNION SELECT 'from_post', 'card:' || id, 'post:' || post_id FROM cd
    UNION SELECT 'cites_attachment', 'card:' || id, {_ATT} FROM cd
    UNION SELECT 'relevant_to', 'card:' || id, 'damdang:' || role FROM cd
    UNION SELECT 'tagged_with', 'card:' || id, {_KW} FROM kw
    UNION SELECT 'keyword_in_post', 'post:' || post_id, {_KW} FROM kw
    UNION SELECT 'mentions', 'card:' || id, 'product:' || code FROM mn
    UNION SELECT 'routed_to', 'product:' || code, 'damdang:' || pr.role FROM mn JOIN pr USING (code)
    UNION SELECT 'co_occurs', 'product:' || a.code, 'product:' || b.code FROM mn a JOIN mn b ON a.id = b.id AND a.pos < b.pos
  )
), un AS MATERIALIZED (SELECT source AS id, target AS other FROM ed UNION ALL SELECT target, source FROM ed)"""


def _node_label():
    return ("id", "type", "label")


_add("kg_nodes", lambda s, d: _nodes(*_sources(s, d)).select(*_node_label()), f"WITH {KG} SELECT id, type, label FROM nd")
_add("kg_edges", lambda s, d: _tables(s, d)[2], f"WITH {KG} SELECT id, type, source, target FROM ed")
_add("kg_co_occurs", lambda s, d: graph.co_occurrence(_cards(s, d)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")), f"WITH {KG} SELECT 'product:' || a.code AS source, 'product:' || b.code AS target, count(*) AS n FROM mn a JOIN mn b ON a.id = b.id AND a.pos < b.pos GROUP BY 1, 2")
_add("kg_stats", lambda s, d: graph.stats(*_tables(s, d)[1:]), f"WITH {KG} SELECT 'node' AS what, type, count(*) AS n FROM nd GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM ed GROUP BY 2")


def _subgraph(spark, d):
    cards, nodes, edges = _written(spark, d)
    return graph.induced_ids(graph.subgraph(nodes, edges, cards, ROLE)[0], edges)


def _view(spark, d):
    cards, nodes, edges = _written(spark, d)
    return graph.view(nodes, edges, cards, role=ROLE, include_products=True)[0].select("id", "type")


_SEED = f"SELECT 'card:' || id AS id FROM cd WHERE role = '{ROLE}'"
_add("kg_subgraph", _subgraph, f"WITH {KG}, se AS ({_SEED}), ns AS MATERIALIZED (SELECT id FROM se UNION SELECT other FROM un WHERE id IN (FROM se)) SELECT id, type FROM ed WHERE source IN (FROM ns) AND target IN (FROM ns)")
_add(
    "kg_viz_3hop",
    _view,
    f"""WITH {KG}, h0 AS MATERIALIZED ({_SEED} UNION SELECT 'damdang:{ROLE}'), h1 AS MATERIALIZED (FROM h0 UNION SELECT other FROM un WHERE id IN (FROM h0)), h2 AS MATERIALIZED (FROM h1 UNION SELECT other FROM un WHERE id IN (FROM h1)), h3 AS MATERIALIZED (FROM h2 UNION SELECT other FROM un WHERE id IN (FROM h2))
SELECT id, type FROM nd WHERE id IN (FROM h3) AND type <> 'Keyword'""",
)


def _cards_by_product(spark, d):
    _, _, edges = _tables(spark, d)
    return graph.cards_by_product(edges, "PLX-00000007")


_add("cards_by_product", _cards_by_product, f"WITH {KG} SELECT DISTINCT source AS id FROM ed WHERE type = 'mentions' AND target = 'product:PLX-00000007'")


def _validate(spark, d):
    """The graph of sound cards, judged on damaged ones."""
    cards, nodes, edges = _written(spark, d)
    i = F.col("id")
    bad = (
        cards.withColumn("role", F.when(i % 101 == 0, "").when(i % 103 == 0, "GHOST").otherwise(F.col("role")))
        .withColumn("headline", F.when(i % 107 == 0, "").otherwise(F.col("headline")))
        .withColumn("body", F.when(i % 107 == 0, " ").otherwise(F.col("body")))
        .withColumn("keywords", F.when(i % 109 == 0, F.array().cast("array<string>")).otherwise(F.col("keywords")))
    )
    cut = edges.filter(~((F.col("type") == "relevant_to") & (F.substring("id", 1, 1) == "a")))
    kept = nodes.filter(~((F.col("type") == "Product") & F.col("label").endswith("7")))
    index = cards.filter(i % 113 != 0).select("id")
    return graph.validate(kept, cut, bad, index).select("check", "n")


_add(
    "kg_validate",
    _validate,
    f"""WITH {KG}, bd AS (SELECT id, CASE WHEN id % 101 = 0 THEN '' WHEN id % 103 = 0 THEN 'GHOST' ELSE role END AS role FROM cd), e2 AS (SELECT * FROM ed WHERE NOT (type = 'relevant_to' AND left(id, 1) = 'a')), n2 AS (SELECT * FROM nd WHERE NOT (type = 'Product' AND label LIKE '%7'))
SELECT 'cards_missing_damdang' AS "check", count(*) AS n FROM bd WHERE role = ''
UNION ALL SELECT 'cards_unknown_damdang', count(*) FROM bd WHERE role = 'GHOST'
UNION ALL SELECT 'cards_no_text', count(*) FROM cd WHERE id % 107 = 0
UNION ALL SELECT 'cards_missing_keywords', count(*) FROM cd WHERE id % 109 = 0
UNION ALL SELECT 'cards_no_post_edge', 0 UNION ALL SELECT 'cards_no_attachment_edge', 0
UNION ALL SELECT 'cards_no_damdang_edge', count(*) FROM cd WHERE 'card:' || id NOT IN (SELECT source FROM e2 WHERE type = 'relevant_to')
UNION ALL SELECT 'dangling_edges', count(*) FROM e2 WHERE source NOT IN (SELECT id FROM n2) OR target NOT IN (SELECT id FROM n2)
UNION ALL SELECT 'duplicate_slice_cards', count(*) FROM (SELECT source FROM e2 WHERE type = 'summarized_as' GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'card_index_missing_nodes', 0
UNION ALL SELECT 'card_nodes_missing_index', count(*) FROM cd WHERE id % 113 = 0""",
)
