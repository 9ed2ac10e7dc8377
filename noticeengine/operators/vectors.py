"""Exact nearest vectors for a stated set of queries, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

#: Queries that one pass over the vectors answers; so many are sent to the tasks at once.
BLOCK = 16_384
#: Queries and vectors that are multiplied at once.
ASKED, ROWS = 512, 4096
#: Below every cosine: stands for none, where a vector is null, zero or of another length.
NONE = -2.0


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=str)


def _units(column: pa.Array, size: int) -> np.ndarray:
    """Rows of norm 1; NaN where a vector has none or not this size."""
    out = np.full((len(column), max(size, 1)), np.nan)
    if not size:
        return out
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    own = column.filter(ok).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    norm = np.sqrt((own * own).sum(axis=1, keepdims=True))
    out[ok.to_numpy(zero_copy_only=False)] = own / np.where(norm > 0, norm, np.nan)
    return out


class _Best:
    """The k best (cosine, then smaller id) of each of some queries, over chunks of vectors."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int):
        self.ids, self.units, self.k = ids, units, k
        self.least = np.full(len(ids), -np.inf)
        self.found: list[np.ndarray] | None = None

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        cosine = np.nan_to_num(self.units @ units.T, nan=NONE)
        least = self.least
        if self.found is None and len(ids) > self.k + 1:
            least = np.partition(cosine, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]  # one more than k: the query may be among them
        q, v = np.nonzero(cosine >= least[:, None] - 1e-6)
        other = self.ids[q] != ids[v]
        q, v = q[other], v[other]
        new = [q, ids[v], np.round(cosine[q, v], 6) + 0.0]
        q, vec, cosine = new if self.found is None else [np.concatenate(x) for x in zip(self.found, new)]
        order = np.lexsort((vec, -cosine, q))
        q, vec, cosine = q[order], vec[order], cosine[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = cosine[last]
        kept = place < self.k
        self.found = [q[kept], vec[kept], cosine[kept]]


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, rank, cosine): the k nearest of vectors (vec_id, embedding) to each of queries, itself left out.

    Each block of queries goes to all tasks: its size is fixed by block. A task multiplies its vectors with
    it as matrices and keeps k a query, so the vectors are scanned once a block and never shuffled but for
    each task's best k. Cosines are rounded to six digits before they are ranked; pairs without one come last.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, asked = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL"), queries.select("vec_id", "embedding").filter("vec_id IS NOT NULL")
    blocks = max(1, -(-queries.count() // block))
    kind = dict(vectors.dtypes)["vec_id"]

    def one(n: int) -> DataFrame:
        table = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n)).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            sizes = pc.fill_null(pc.list_value_length(own["embedding"].combine_chunks()), 0)
            best = []
            for size in pc.unique(sizes).to_pylist():
                part = own.filter(pc.equal(sizes, size))
                column, ids = part["embedding"].combine_chunks(), _ids(part["vec_id"].combine_chunks())
                units = _units(column, size)
                best.append((size, [_Best(ids[i : i + ASKED], units[i : i + ASKED], k) for i in range(0, len(ids), ASKED)]))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    piece = batch.slice(at, ROWS)
                    ids = _ids(piece.column(0))
                    for size, parts in best:
                        units = _units(piece.column(1), size)
                        for b in parts:
                            b.add(ids, units)
            for b in (b for _, parts in best for b in parts if b.found is not None):
                q, vec, cosine = b.found
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(vec), pa.array(cosine, mask=cosine == NONE)], ["query_id", "vec_id", "cosine"])

        return rows.mapInArrow(run, f"query_id {kind}, vec_id {kind}, cosine double")

    near = reduce(DataFrame.unionByName, [one(n) for n in range(blocks)])
    order = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "cosine", "rank")
