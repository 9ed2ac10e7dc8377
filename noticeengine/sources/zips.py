"""Board exports as zip files: members, resolution of attachments, and staging by day."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .board import sniff

# Extensions of attachments, and the file that marks a post's folder.
ATTACHMENTS = ["xlsx", "xls", "xlsb", "csv", "pptx", "ppt", "pdf", "docx", "doc", "png", "jpg", "jpeg", "zip"]
MEMBER = "archive string, member string, filename string, content binary"


def read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        if not info.is_dir():
                            yield pa.RecordBatch.from_pydict({"archive": [path], "member": [info.filename], "filename": [info.filename.rsplit("/", 1)[-1]], "content": [z.read(info)]})
            except zipfile.BadZipFile:  # no archive: it has no members
                continue


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, filename, content) of all zip files under a path, one batch a member."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(read_members, MEMBER)


def valid(rows: DataFrame) -> DataFrame:
    """Files with an attachment's extension whose first bytes fit it."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return rows.filter(ext.isin(*ATTACHMENTS) & ~sniff(F.col("content"), F.col("filename")).isin("drm", "invalid"))


def index_by_name(rows: DataFrame, place: str, last: bool) -> DataFrame:
    """One file a name: the last in the order of place (archives) or the first (folders)."""
    order = F.col(place).desc() if last else F.col(place).asc()
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("filename").orderBy(order))).filter("__n = 1").drop("__n")


def deepest(folders: DataFrame) -> DataFrame:
    """Folders (folder) that hold no other of them."""
    parents = folders.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda i: F.array_join(F.slice(F.split("folder", "/"), F.lit(1), i - 1), "/"))).alias("folder")).filter("folder <> ''").distinct()
    return folders.join(parents, "folder", "left_anti")


def post_folders(rows: DataFrame, is_board: Column) -> DataFrame:
    """Deepest folders of members with a board page among their files."""
    return deepest(rows.filter(is_board).select(F.regexp_replace("member", "/[^/]*$", "").alias("folder")).distinct())


def resolve(wanted: DataFrame, ingested: DataFrame, plain: DataFrame, nested: DataFrame) -> DataFrame:
    """wanted (post_id, filename) with place and origin: the ingested copy, else the plain file of the post, else one in its nested archive; missing where none has it.

    ingested: filename, place; plain and nested: post_id, filename, place.
    """
    one = lambda df, *by: df.groupBy(*by).agg(F.min("place").alias("place"))
    rows = wanted.join(one(ingested, "filename").withColumnRenamed("place", "a"), "filename", "left")
    rows = rows.join(one(plain, "post_id", "filename").withColumnRenamed("place", "b"), ["post_id", "filename"], "left").join(one(nested, "post_id", "filename").withColumnRenamed("place", "c"), ["post_id", "filename"], "left")
    origin = F.when(F.col("a").isNotNull(), "ingest").when(F.col("b").isNotNull(), "plain").when(F.col("c").isNotNull(), "nested").otherwise("missing")
    return rows.select("post_id", "filename", F.coalesce("a", "b", "c").alias("place"), origin.alias("origin"))


def remap_counts(resolved: DataFrame) -> DataFrame:
    """One row: attachments copied and missing."""
    return resolved.agg(F.count_if(F.col("origin") != "missing").alias("copied"), F.count_if(F.col("origin") == "missing").alias("missing"))


def stage_posts(posts: DataFrame, resolved: DataFrame, path: str) -> None:
    """Posts with their resolved attachments as JSON lines by day."""
    own = resolved.filter("origin <> 'missing'").groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("filename", F.col("place").alias("path")))).alias("attachments"))
    rows = posts.join(own, "post_id", "left").withColumn("attachments", F.coalesce("attachments", F.array().cast("array<struct<filename:string,path:string>>")))
    rows.write.mode("overwrite").partitionBy("posted_date").json(path)
