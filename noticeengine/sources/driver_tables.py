"""The driver's tables read as the engine's entities: events, roster, cards, questions and products.

Each reader is a plain projection, so filters and column pruning reach the scans. Every entity has an
`ord` column: row order is part of many operators' meaning and is never left to partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates

ALL_BRANCHES = "전점"
EVENT_TYPES = ["정책", "판촉", "공지", "이벤트", "가격_재고"]
CARD_KINDS = ["정책", "판촉", "공지", "이벤트", "기타"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: branch and category of the customer, valid until the last shipment, a version of the customer's order before."""
    orders, customers, lines = (read(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    shipped = lines.groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("valid_to"))
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    kind = _pick(EVENT_TYPES, key % 5)
    rows = orders.withColumn("version_of", before).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(shipped, key == F.col("l_orderkey"), "left")
    return rows.select(
        key.alias("id"),
        kind.alias("type"),
        F.concat(F.lit("order "), key.cast("string")).alias("title"),
        F.col("o_custkey").alias("post_id"),
        F.array("c_mktsegment").alias("categories"),
        F.array(F.when(key % 10 == 0, ALL_BRANCHES).otherwise(F.col("c_nationkey").cast("string"))).alias("branches"),
        day.alias("valid_from"),
        "valid_to",
        F.when(kind == "정책", F.date_add(day, (key % 7).cast("int"))).alias("effective_date"),
        "version_of",
        day.alias("first_seen"),
        F.date_add(day, (key % 10).cast("int")).alias("last_updated"),
        key.alias("ord"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as employees; every tenth is a store manager."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        s.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("branch"), (s % 10 == 0).alias("is_store_manager"), F.array(_pick(SEGMENTS, s % 5)).alias("categories"), s.alias("ord")
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: role by source, kind and dates by id."""
    d = F.col("doc_id")
    posted = F.date_add(F.lit("2024-01-01").cast("date"), (d % 120).cast("int"))
    kind = _pick(CARD_KINDS, d % 5)
    attachment = F.concat(F.lit("guide_"), (d % 40).cast("string"), F.lit("_v"), (d % 3).cast("string"), F.lit(".xlsx"))
    headline = F.split_part("text", F.lit("\n"), F.lit(1))
    start = F.when(d % 7 != 0, F.date_add(posted, (d % 10).cast("int")))
    end = F.when(d % 11 != 0, F.date_add(posted, (d % 10 + d % 30).cast("int")))
    return read(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.col("source").alias("role"),
        d.alias("post_id"),
        F.concat(F.lit("notice "), d.cast("string"), F.lit(" "), "lang").alias("post_title"),
        posted.alias("posted_date"),
        F.concat(d.cast("string"), F.lit("_"), attachment, F.lit("#row"), (d % 13).cast("string")).alias("source_ref"),
        attachment.alias("attachment_name"),
        F.array(F.concat(F.lit("PLX-"), F.lpad((d % 97).cast("string"), 4, "0")), F.concat(F.lit("BD-N"), F.lpad((d % 31).cast("string"), 4, "0"))).alias("product_codes"),
        F.array(F.when(d % 3 == 0, "guide").otherwise("notice"), F.col("lang")).alias("keywords"),
        headline.alias("headline"),
        F.col("text").alias("body"),
        kind.alias("notice_kind"),
        start.alias("valid_from"),
        end.alias("valid_to"),
        F.when(d % 3 != 0, F.date_add(posted, (d % 15 - 5).cast("int"))).alias("effective_date"),
        dates.topic_key(F.col("source"), attachment, headline, kind).alias("topic_key"),
        F.lit(None).cast("long").alias("version_of"),
        d.alias("ord"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products with one code and one role."""
    return read(spark, sf_dir, "part").select(F.concat(F.lit("PLX-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("code"), F.col("p_brand").alias("role"), "p_partkey", "p_name", "p_type")


#: DuckDB forms of the readers above.
EVENTS_SQL = """ev AS (
  SELECT o.o_orderkey AS id, ['정책','판촉','공지','이벤트','가격_재고'][o.o_orderkey % 5 + 1] AS type, 'order ' || o.o_orderkey AS title, o.o_custkey AS post_id,
         [c.c_mktsegment] AS categories, [CASE WHEN o.o_orderkey % 10 = 0 THEN '전점' ELSE CAST(c.c_nationkey AS VARCHAR) END] AS branches,
         CAST(o.o_orderdate AS DATE) AS valid_from, l.valid_to,
         CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 7 AS INTEGER) END AS effective_date,
         o.version_of, CAST(o.o_orderdate AS DATE) AS first_seen, CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 10 AS INTEGER) AS last_updated, o.o_orderkey AS ord
  FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_of FROM orders) o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS valid_to FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
)"""
ROSTER_SQL = """ro AS (
  SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS branch, s_suppkey % 10 = 0 AS is_store_manager,
         ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][s_suppkey % 5 + 1] AS category
  FROM supplier
)"""
CARDS_SQL = r"""ca0 AS (
  SELECT doc_id AS id, source AS role, doc_id AS post_id, 'notice ' || doc_id || ' ' || lang AS post_title, DATE '2024-01-01' + CAST(doc_id % 120 AS INTEGER) AS posted_date,
         'guide_' || (doc_id % 40) || '_v' || (doc_id % 3) || '.xlsx' AS attachment_name,
         ['PLX-' || lpad(CAST(doc_id % 97 AS VARCHAR), 4, '0'), 'BD-N' || lpad(CAST(doc_id % 31 AS VARCHAR), 4, '0')] AS product_codes,
         [CASE WHEN doc_id % 3 = 0 THEN 'guide' ELSE 'notice' END, lang] AS keywords, split_part(text, chr(10), 1) AS headline, text AS body, ['정책','판촉','공지','이벤트','기타'][doc_id % 5 + 1] AS notice_kind
  FROM documents
), ca AS (
  SELECT *, id || '_' || attachment_name || '#row' || (id % 13) AS source_ref, CASE WHEN id % 7 <> 0 THEN posted_date + CAST(id % 10 AS INTEGER) END AS valid_from,
         CASE WHEN id % 11 <> 0 THEN posted_date + CAST(id % 10 + id % 30 AS INTEGER) END AS valid_to,
         CASE WHEN id % 3 <> 0 THEN posted_date + CAST(id % 15 - 5 AS INTEGER) END AS effective_date,
         CASE WHEN notice_kind IN ('정책', '공지', '판촉') THEN left(sha1(role || '|' || notice_kind || '|guide_' || (id % 40)), 16) END AS topic_key, id AS ord
  FROM ca0
)"""
