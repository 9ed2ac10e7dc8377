"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the edges alone; nothing but two numbers reaches the
driver. A node with many links is pre-aggregated before its minimum is shuffled. Tables between
rounds are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs to (node, root): the smallest node of its component, for every node that has a link to another."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        release(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component label (its smallest member) of each of n items joined by the pairs i, j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label[i] == label[j]).all() and (label[label] == label).all():
            break
    return label
