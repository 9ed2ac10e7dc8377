"""Mixing sources to target weights.

Every document gets a hash-random key (MD5 of seed and id). Within its source documents are ordered
by that key: a fixed number of key ranges splits each source, so that a source with a third of all
rows is spread over all ranges; running word totals are sums within a range plus the prefix sum of
the earlier ranges' totals. A source's budget is cut exactly: whole epochs first, then documents in
key order until the rest of the budget is used, the last one in part. Only ids, keys and sizes are
shuffled, never texts.

Defined cases: a null text has size 0 and nothing is taken from it; null sources form one source,
ordered last; repeated rows each count, ties of the key go by id, then size; an empty table gives
an empty result; a source of size 0 has target 0. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import word_count

SEED = "mix-1"
#: Hex digits of the key that name its range: 16**3 ranges per source.
RANGE_DIGITS = 3
MAX_REPEAT = 3
WEIGHT_CYCLE = 3


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and can be joined on."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source))


def targets(per_source: DataFrame, cycle: int = WEIGHT_CYCLE, repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, source_size) to (src, source_size, target): weights 1..cycle by rank share all sizes, none above repeat times its own.

    One row per source. Sources that are full are those with the smallest repeat * size / weight:
    sorted that way the first k are full when the level that the others share lies above the k-th ratio.
    """
    ranked = per_source.withColumn("weight", (F.row_number().over(W.orderBy("src")) - 1) % cycle + 1)
    limit = F.col("source_size") * repeat
    order = W.orderBy(limit / F.col("weight"), "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("shared"),
    )
    fits = F.col("left") * F.col("weight") <= limit * F.col("shared")
    first = level.withColumn("fits", fits).withColumn("open", F.max("fits").over(order.rowsBetween(W.unboundedPreceding, 0)))
    at = first.select("*", F.max(F.when(F.col("fits") & ~F.coalesce(F.lag("open").over(order), F.lit(False)), F.struct("left", "shared"))).over(everything).alias("level"))
    target = F.when(F.col("open"), F.col("level.left").cast("double") * F.col("weight").cast("double") / F.col("level.shared").cast("double")).otherwise(limit.cast("double"))
    return at.select("src", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs and rest for every row of docs (doc_id, text, source).

    taken = epochs * size + rest: the mix holds the document epochs times whole, then its first rest words.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = docs.select("doc_id", "source", source_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), key.alias("key"))
    keyed = keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("src", "range").agg(F.sum("size").alias("range_size"))
    running = W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select("src", "range", F.coalesce(F.sum("range_size").over(running), F.lit(0)).alias("offset"))
    aims = targets(ranges.groupBy("src").agg(F.sum("range_size").alias("source_size")))
    placed = keyed.join(offsets.join(aims, "src"), ["src", "range"])
    inside = W.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    out = placed.withColumn("start", start).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - F.col("start")))
    out = out.withColumn("rest", rest)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "epochs", "rest")
