"""A stream run to its end over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


def stream_first_seen(spark, d):
    """First time of each user and event type, by a streaming aggregation over the files that exist."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    source = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"first_seen_{uuid.uuid4().hex}"
    query = source.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


def _is_folder(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


QUERIES["stream_first_seen"] = stream_first_seen
ORACLES["stream_first_seen"] = "SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM events GROUP BY 1, 2"
