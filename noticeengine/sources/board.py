"""Board posts in day folders, rosters, category masters and product dimensions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import attachment_kind
from ..session import folders

# Lines that end a printed post's body, and the mark of its attachments.
PAGE_FOOTER = r"^\d+/\d+$|^26\.\s*\d|^\d{2}\.\s*\d{1,2}\.\s*\d{1,2}\.|^(인쇄|닫기|게시물 출력|주요공지)$"
ATTACHMENT_HINT = r"※\s*첨부파일\s*[:：]\s*(.+)"
POST_SCHEMA = "id STRING, title STRING, body STRING, posted_date DATE, attachments ARRAY<STRUCT<id: STRING, filename: STRING, path: STRING>>"


def read_day(spark: SparkSession, raw_dir: str, as_of: str) -> DataFrame:
    """Posts of one day's folder, which alone is read; an absent folder gives no rows."""
    return _first_and_last(_read_days(spark, raw_dir, [as_of] if as_of in folders(spark, raw_dir) else []))


def read_backfill(spark: SparkSession, raw_dir: str, as_of: str) -> DataFrame:
    """Posts of all day folders up to as_of. A post in several folders has the text of the last and the place of the first.

    Only folders whose name is a date up to as_of are listed and read.
    """
    days = [d for d in folders(spark, raw_dir) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) and d <= as_of]
    return _first_and_last(_read_days(spark, raw_dir, days))


def _read_days(spark: SparkSession, raw_dir: str, days: list[str]) -> DataFrame:
    if not days:
        return spark.createDataFrame([], POST_SCHEMA).withColumns({"day": F.lit(None).cast("date"), "ord": F.lit(None).cast("long")})
    rows = spark.read.schema(POST_SCHEMA).option("multiLine", True).option("pathGlobFilter", "posts.json").json([f"{raw_dir}/{d}" for d in days])
    return rows.withColumn("day", F.try_to_date(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1), "yyyy-MM-dd")).withColumn("ord", F.monotonically_increasing_id()).filter("day IS NOT NULL")


def _first_and_last(rows: DataFrame) -> DataFrame:
    same = W.partitionBy("id")
    first = F.min(F.struct("day", "ord")).over(same)
    last = F.row_number().over(same.orderBy(F.col("day").desc(), F.col("ord").desc()))
    return rows.withColumn("first", first).withColumn("__n", last).filter("__n = 1").drop("__n", "ord").withColumn("ord", F.struct("first.day", "first.ord")).drop("first")


def attachments(posts: DataFrame) -> DataFrame:
    """(post_id, attachment_id, filename, path, kind) of all posts' attachments."""
    a = posts.select(F.col("id").alias("post_id"), F.explode("attachments").alias("a"))
    return a.select("post_id", F.coalesce("a.id", F.concat_ws("_", "post_id", "a.filename")).alias("attachment_id"), "a.filename", "a.path", attachment_kind(F.col("a.filename")).alias("kind"))


def read_roster(spark: SparkSession, path: str, managers: list[str], role_map: DataFrame | None = None) -> DataFrame:
    """Tab-separated roster: two header lines after blank ones are dropped, columns 3 to 7, role in the last; rows without a role or branch are skipped.

    role_map (role, categories) gives a role's categories; a role without an entry is its own.
    """
    lines = spark.read.text(path, wholetext=False).withColumn("ord", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    kept = lines.withColumn("n", F.row_number().over(W.orderBy("ord"))).filter("n > 2").select("ord", F.split("value", "\t").alias("c")).filter(F.size("c") >= 8)
    rows = kept.select("ord", *(F.trim(F.get("c", F.lit(i))).alias(n) for i, n in ((3, "branch"), (4, "branch_code"), (5, "id"), (6, "name"), (7, "role")))).filter("role <> '' AND branch <> ''")
    rows = rows.withColumn("is_store_manager", F.col("role").isin(*managers))
    if role_map is not None:
        rows = rows.join(role_map, "role", "left")
    else:
        rows = rows.withColumn("categories", F.lit(None).cast("array<string>"))
    return rows.withColumn("categories", F.coalesce("categories", F.array("role")))


def read_roster_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated roster: id, name, branch, is_store_manager, categories joined by bars."""
    rows = spark.read.csv(path, header=True)
    return rows.select("id", "name", "branch", F.lower("is_store_manager").isin("1", "true", "y").alias("is_store_manager"), F.filter(F.split(F.coalesce("categories", F.lit("")), r"\|"), lambda c: c != "").alias("categories"))


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Category master: the last row of an ITEM_CD counts; roles are joined by bars."""
    rows = spark.read.csv(path, sep="\t", header=True).withColumn("ord", F.monotonically_increasing_id())
    last = F.row_number().over(W.partitionBy("ITEM_CD").orderBy(F.col("ord").desc()))
    return rows.withColumn("__n", last).filter("__n = 1").drop("__n")


def product_dimension(items: DataFrame, families: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Products with their family (joined on ITEM_ID), of the asked codes (PRD_CD) if given."""
    out = items.join(families, "ITEM_ID")
    return out if codes is None else out.join(codes.select("PRD_CD").distinct(), "PRD_CD", "left_semi")


def missing_codes(asked: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct upper-cased codes that the cache lacks: what a batch look-up has to fetch."""
    return asked.select(F.upper(F.trim("code")).alias("code")).filter("code <> ''").distinct().join(cached.select("code"), "code", "left_anti")


def batch_lookup(asked: DataFrame, cached: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(code, name, role, matched) of all distinct asked codes: from the cache, else from fetch, a function of the missing codes (code) that gives code, name, role, ord; the first row of a code counts."""
    codes = asked.select(F.upper(F.trim("code")).alias("code")).filter("code <> ''").distinct()
    found = fetch(missing_codes(asked, cached)).groupBy("code").agg(F.min_by(F.struct("name", "role"), "ord").alias("x")).select("code", "x.*")
    known = cached.select("code", "name", "role").unionByName(found).withColumn("matched", F.lit(True))
    return codes.join(known, "code", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def sniff(content: Column, filename: Column) -> Column:
    """drm, zip, ole, pdf, invalid or other: what a payload is by its first bytes, and whether that fits its extension."""
    head = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    kind = F.when(F.substring(head, 1, 14) == "9B44524D4F4E45", "drm").when(head.startswith("504B"), "zip").when(head.startswith("D0CF11E0"), "ole").when(head.startswith("25504446"), "pdf").otherwise("other")
    fits = F.when(ext.isin("xlsx", "pptx", "docx", "xlsb"), kind == "zip").when(ext.isin("xls", "ppt", "doc"), kind == "ole").when(ext == "pdf", kind == "pdf").otherwise(True)
    return F.when(kind == "drm", "drm").when(~fits, "invalid").otherwise(kind)


def resolve_files(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """wanted (filename, ...) with the path of the first source (filename, path) that has the file; NULL where none has."""
    out = wanted
    for i, s in enumerate(sources):
        out = out.join(s.groupBy("filename").agg(F.min("path").alias(f"__p{i}")), "filename", "left")
    found = [F.col(f"__p{i}") for i in range(len(sources))]
    return out.withColumn("path", F.coalesce(*found)).drop(*(f"__p{i}" for i in range(len(sources))))


def attachment_hints(text: Column) -> Column:
    """Distinct names after the mark of attachments."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ATTACHMENT_HINT), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def parse_board_page(lines: Column, fallback: Column) -> Column:
    """struct(title, author, posted_date, body) of a printed post's lines.

    The first line that is an ISO date is the anchor: the title stands four lines above it, the author
    two; the body starts two lines below, without a short first line, and ends at the print's footer.
    """
    at = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(r"^20\d{2}-\d{2}-\d{2}$")), F.lit(True)).cast("int") - 1
    line = lambda i: F.when(i >= 0, F.trim(F.get(lines, i)))
    start = at + 2
    start = start + F.when(F.length(F.trim(F.coalesce(F.get(lines, start), F.lit("")))) < 20, 1).otherwise(0)
    rest = F.slice(lines, start + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: F.trim(x).rlike(PAGE_FOOTER)), F.lit(True)).cast("int")
    body = F.array_join(F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(rest), "\n")
    any_day = F.regexp_extract(F.array_join(lines, "\n"), r"(20\d{2}-\d{2}-\d{2})", 1)
    return F.when(at >= 0, F.struct(line(at - 4).alias("title"), line(at - 2).alias("author"), F.try_to_date(F.trim(F.get(lines, at)), "yyyy-MM-dd").alias("posted_date"), F.trim(body).alias("body"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"), F.coalesce(F.try_to_date(any_day, "yyyy-MM-dd"), fallback).alias("posted_date"), F.trim(F.array_join(lines, "\n")).alias("body"))
    )
