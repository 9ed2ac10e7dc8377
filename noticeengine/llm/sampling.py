"""Bounded samples of rows for fitting, picked by the smallest hash of the id, and the contracts' hold-out remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A class's sample is drawn from so many hash parts, so that no class is ranked in one task.
PARTS = 128


def remainder(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo of; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def sample_ids(rows: DataFrame, by: str, each: int) -> DataFrame:
    """(doc_id, by) of at most each rows of every class, those with the smallest hashes in each of PARTS parts."""
    h = F.xxhash64(F.lit("sample"), "doc_id")
    part = rows.select("doc_id", by, h.alias("h"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(PARTS)).alias("part"))
    order = W.partitionBy(by, "part").orderBy("h", "doc_id")
    picked = part.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(1, each // PARTS))
    return picked.select("doc_id", by)
