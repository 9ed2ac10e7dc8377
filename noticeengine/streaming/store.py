"""Streaming forms of the daily store: first sightings, sliding counts, and snapshot upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store


def first_seen(stream: DataFrame, key: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def sliding_counts(stream: DataFrame, key: str, time: str = "ts", span: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows of each key in trailing windows."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, span, step), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def upsert_batches(path: str, key_columns: Callable[[DataFrame], DataFrame], as_of: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each micro-batch into a snapshot.

    Snapshots are versioned by batch id: a batch that is run again writes the same version from the
    same predecessor, so the result is as if it had run once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = key_columns(batch)
        day = as_of(number)
        if number:
            merged = store.upsert(spark.read.parquet(f"{path}/v={number - 1}"), rows, day)
        else:
            merged = rows.withColumn("first_seen", F.lit(day).cast("date")).withColumn("last_updated", F.lit(day).cast("date"))
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return run
