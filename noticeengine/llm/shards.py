"""Sorted arrays in the shared folder, written by tasks and memory-mapped by others.

A table is range-partitioned on its key and sorted; each task writes its rows' columns as raw arrays
into one file under a new name and reports the file. Only these reports (one per partition) reach the
driver. A task that runs twice writes two files, of which the successful attempt's is reported.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import scratch_path


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """One new file with all arrays; its path and (name, dtype, offset, length) of each."""
    system, base = _filesystem(folder)
    system.create_dir(base, recursive=True)
    name, layout, at = uuid.uuid4().hex, [], 0
    with system.open_output_stream(f"{base}/{name}") as out:
        for key, x in arrays.items():
            body = np.ascontiguousarray(x).tobytes()
            pad = -len(body) % 8
            out.write(body + b"\0" * pad)
            layout.append((key, x.dtype.str, at, len(x)))
            at += len(body) + pad
    return f"{folder}/{name}", layout


def map_arrays(path: str, layout: list[tuple[str, str, int, int]]) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped in a shared file system, read into memory from a remote store (a shard has a bounded size)."""
    system, base = _filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        with open(base, "rb") as handle:
            size = os.fstat(handle.fileno()).st_size
            data = mmap.mmap(handle.fileno(), size, access=mmap.ACCESS_READ) if size else b""
    else:
        with system.open_input_stream(base) as source:
            data = source.read()
    return {key: np.frombuffer(data, dtype, n, at) if n else np.zeros(0, dtype) for key, dtype, at, n in layout}


_REPORT = pa.schema([("first", pa.string()), ("last", pa.string()), ("rows", pa.int64()), ("path", pa.string()), ("layout", pa.list_(pa.struct([("name", pa.string()), ("dtype", pa.string()), ("at", pa.int64()), ("n", pa.int64())])))])


@dataclass
class Shard:
    first: int
    last: int
    rows: int
    path: str
    layout: list[tuple[str, str, int, int]]


#: Shards of a table that a process keeps open.
OPEN = 256


class Sorted:
    """All shards of a table in key order; opened lazily in each process."""

    def __init__(self, shards: list[Shard]):
        self.shards = sorted((s for s in shards if s.rows), key=lambda s: s.first)
        self.offsets = np.concatenate([[0], np.cumsum([s.rows for s in self.shards])]).astype(np.int64)
        self._open: dict[int, dict[str, np.ndarray]] = {}

    def __getstate__(self):
        return {"shards": self.shards, "offsets": self.offsets, "_open": {}}

    @property
    def rows(self) -> int:
        return int(self.offsets[-1])

    def arrays(self, n: int) -> dict[str, np.ndarray]:
        if n not in self._open:
            if len(self._open) >= OPEN:
                self._open.pop(next(iter(self._open)))
            self._open[n] = map_arrays(self.shards[n].path, self.shards[n].layout)
        return self._open[n]

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """For sorted unsigned keys, the shard and the slice of keys that it may hold."""
        for n, s in enumerate(self.shards):
            lo = int(np.searchsorted(keys, np.uint64(s.first), "left"))
            hi = int(np.searchsorted(keys, np.uint64(s.last), "right"))
            if hi > lo:
                yield n, slice(lo, hi)

    def find(self, keys: np.ndarray, column: str = "key") -> np.ndarray:
        """Global row number of each sorted unsigned key, -1 where it is missing."""
        out = np.full(len(keys), -1, np.int64)
        for n, part in self.parts(keys):
            own, x = self.arrays(n)[column], keys[part]
            at = np.minimum(np.searchsorted(own, x), len(own) - 1)
            out[part] = np.where(own[at] == x, at + self.offsets[n], out[part])
        return out

    def find_any(self, keys: np.ndarray) -> np.ndarray:
        """find() for keys in any order."""
        u, back = np.unique(keys, return_inverse=True)
        return self.find(u)[back]

    def find_both(self, k: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Row numbers of 128-bit digests of which the table has the halves as `key` and `k2`, -1 where it lacks one."""
        order = np.argsort(k, kind="stable")
        rows = self.find(k[order])
        out = np.full(len(k), -1, np.int64)
        for ahead in range(3):  # no more than a few digests share a half
            at = rows + ahead
            ok = np.flatnonzero((rows >= 0) & (at < self.rows) & (out[order] < 0))
            same = self.take(at[ok], "k2") == k2[order][ok].view(np.int64)
            out[order[ok[same]]] = at[ok[same]]
        return out

    def take_any(self, rows: np.ndarray, column: str) -> np.ndarray:
        """take() for rows in any order, 0 where a row is -1."""
        out = np.zeros(len(rows), np.int64)
        some = np.flatnonzero(rows >= 0)
        order = some[np.argsort(rows[some], kind="stable")]
        out[order] = self.take(rows[order], column)
        return out

    def take(self, rows: np.ndarray, column: str, dtype=np.int64) -> np.ndarray:
        """A column's values at sorted global row numbers."""
        out = np.zeros(len(rows), dtype)
        cut = np.searchsorted(rows, self.offsets)
        for n in range(len(self.shards)):
            if cut[n + 1] > cut[n]:
                own = rows[cut[n] : cut[n + 1]] - self.offsets[n]
                out[cut[n] : cut[n + 1]] = self.arrays(n)[column][own]
        return out


#: Bytes of rows that a task gathers before it writes a shard.
SHARD_BYTES = 64 << 20
#: The keys of write_sorted() are hashes, spread evenly over all 64 bits.
HASHES = 1 << 64


def write_sorted(df: DataFrame, key: str, build: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None, tag: str, span: int | None = None) -> Sorted:
    """Write df, whose key column is a long read as unsigned bits, into sorted shards.

    build turns a shard's columns (numpy, in key order) into the arrays to store; without it they are stored as they are, the key as `key`.
    With span, the keys lie evenly in 0 .. span - 1 and are dealt out by their size; without it Spark samples them, which runs df's last stage twice.
    A task writes a shard for each SHARD_BYTES of rows; rows of one key stay in one shard.
    Signed longs below zero come first in Spark's order, so each partition may hold a negative and a positive run: they become two shards.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, tag)
    names = df.columns
    at_key = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for row in tv.rows(batches, names):
            held += sum(c.nbytes for c in row)
            got.append([np.asarray(c.to_numpy(zero_copy_only=False)) for c in row])
            if held > SHARD_BYTES:
                k = got[-1][at_key]
                cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
                if cut:
                    rest = [x[cut:].copy() for x in got[-1]]
                    got[-1] = [x[:cut] for x in got[-1]]
                    yield from written(got)
                    got, held = [rest], sum(x.nbytes for x in rest)
        if got:
            yield from written(got)

    def written(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = {name: np.concatenate([g[i] for g in got]) for i, name in enumerate(names)}
        got.clear()
        signed = columns.pop(key)
        cut = int(np.searchsorted(signed, 0))
        for part in (slice(0, cut), slice(cut, len(signed))):
            own = {"key": signed[part].view(np.uint64), **{k: v[part] for k, v in columns.items()}}
            if not len(own["key"]):
                continue
            first, last, rows = int(own["key"][0]), int(own["key"][-1]), len(own["key"])
            path, layout = write_arrays(folder, build(own) if build else own)
            yield pa.RecordBatch.from_pydict({"first": [str(first)], "last": [str(last)], "rows": [rows], "path": [path], "layout": [[{"name": a, "dtype": b, "at": c, "n": d} for a, b, c, d in layout]]}, _REPORT)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "first string, last string, rows long, path string, layout array<struct<name:string,dtype:string,at:long,n:long>>"
    if span is None:
        dealt = df.repartitionByRange(parts, key)
    else:
        share = F.col(key) / float(span) + (0.5 if span == HASHES else 0.0)
        dealt = df.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(share * parts)).cast("int"))
    found = dealt.sortWithinPartitions(key).mapInArrow(run, schema).collect()
    return Sorted([Shard(int(r["first"]), int(r["last"]), r["rows"], r["path"], [(x["name"], x["dtype"], x["at"], x["n"]) for x in r["layout"]]) for r in found])
