"""The store of parsed attachments: one record per attachment, partitioned by post, with errors as records.

Records: post_id, attachment_id, filename, kind, source_path, fingerprint, parsed_at, text, pages
(array of ref, text), tables (array of columns, rows), needs_review, error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import digest_id
from ..session import materialize, release
from .sinks import write_partitions

PAGES = "array<struct<ref:string,text:string>>"
TABLES = "array<struct<columns:array<string>,rows:array<array<string>>>>"
SCHEMA = f"attachment_id string, filename string, kind string, source_path string, fingerprint string, parsed_at timestamp, text string, pages {PAGES}, tables {TABLES}, needs_review boolean, error string, post_id string"


def record_key(attachment_id) -> F.Column:
    """Name of an attachment's record."""
    return digest_id(12, attachment_id)


def records_of(attachments: DataFrame, parsed: DataFrame, parsed_at: str) -> DataFrame:
    """A record for each attachment (post_id, attachment_id, filename, kind, path, fingerprint) that parsed (attachment_id, text, pages, tables, needs_review, error) covers; failures keep only their error."""
    rows = attachments.join(parsed, "attachment_id")
    good = F.col("error").isNull()
    keep = lambda c: F.when(good, F.col(c)).alias(c)
    return rows.select("attachment_id", "filename", "kind", F.col("path").alias("source_path"), "fingerprint", F.lit(parsed_at).cast("timestamp").alias("parsed_at"), keep("text"), keep("pages"), keep("tables"), F.coalesce(good & F.col("needs_review"), F.lit(False)).alias("needs_review"), "error", F.col("post_id").cast("string").alias("post_id"))


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """All records; folders that start with an underscore are none of posts."""
    return spark.read.schema(SCHEMA).parquet(root)


def save_records(records: DataFrame, root: str, old: DataFrame | None = None) -> None:
    """Replace the records of the given attachments; other attachments of their posts stay, other posts are not touched."""
    out = records
    if old is not None:
        touched = old.join(records.select("post_id").distinct(), "post_id", "left_semi")
        out = records.unionByName(touched.join(records.select("post_id", "attachment_id"), ["post_id", "attachment_id"], "left_anti"))
    written = materialize(out, "records")  # what is overwritten is read first
    write_partitions(written, root, "post_id")
    release(written)


def parsed_attachments(records: DataFrame) -> DataFrame:
    """Records that were parsed."""
    return records.filter("error IS NULL")


def summaries(records: DataFrame) -> DataFrame:
    """(post_id, key, kind, needs_review, error): only these columns are scanned."""
    failed = F.col("error").isNotNull()
    return records.select("post_id", record_key(F.col("attachment_id")).alias("key"), "kind", (~failed & F.coalesce("needs_review", F.lit(False))).alias("needs_review"), failed.alias("error"))


def post_meta(posts: DataFrame, records: DataFrame) -> DataFrame:
    """(post_id, title, posted_date, attachment_count, records): what each post with records has, keys in order."""
    keys = records.groupBy("post_id").agg(F.sort_array(F.collect_set(record_key(F.col("attachment_id")))).alias("records"), F.max("parsed_at").alias("parsed_at"))
    rows = posts.join(keys, "post_id")
    return rows.select("post_id", "title", "posted_date", F.coalesce(F.col("attachment_count"), F.size("records")).alias("attachment_count"), "parsed_at", "records")


def review_markdown(posts: DataFrame, records: DataFrame, limit: int = 2000) -> DataFrame:
    """(post_id, markdown): each post's records with kind, flags and the head of their text."""
    flag = F.when(F.col("error").isNotNull(), F.concat(F.lit(" — error: "), "error")).when(F.col("needs_review"), " — needs review").otherwise("")
    head = F.substring(F.coalesce("text", F.lit("")), 1, limit)
    part = F.concat(F.lit("## "), "filename", F.lit(" ("), "kind", F.lit(")"), flag, F.when(head != "", F.concat(F.lit("\n\n"), head)).otherwise(""))
    parts = records.select("post_id", F.struct("filename", "attachment_id", part.alias("part")).alias("p")).groupBy("post_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("body"))
    return posts.select("post_id", "title").join(parts, "post_id").select("post_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("markdown"))


def sections_of(records: DataFrame, by_marker) -> DataFrame:
    """(post_id, source_ref, text): the pages of parsed records, else their texts cut by by_marker (a function from text to array of ref, text)."""
    paged = F.size(F.coalesce("pages", F.array().cast(PAGES))) > 0
    cut = F.transform(by_marker(F.col("text")), lambda s: F.struct(F.concat(F.col("attachment_id"), F.lit("#"), s["ref"]).alias("ref"), s["text"].alias("text")))
    rows = parsed_attachments(records).select("post_id", F.explode(F.when(paged, F.col("pages")).otherwise(cut)).alias("s"))
    return rows.select("post_id", F.col("s.ref").alias("source_ref"), F.coalesce("s.text", F.lit("")).alias("text"))


def corpora(posts: DataFrame, records: DataFrame, as_of: str, by_marker) -> DataFrame:
    """(post_id, title, body, source_ref, text): sections of the posts up to as_of; a post without any has one row without a section."""
    own = posts.filter(F.col("posted_date") <= F.lit(as_of).cast("date")).select("post_id", "title", "body")
    return own.join(sections_of(records, by_marker), "post_id", "left")
