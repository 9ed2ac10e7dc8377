"""SimHash near duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; a bit is set if over half of the shingles' XXH64 values have it set. To
find all pairs that differ in at most 2 bits, a fingerprint is cut into three segments (22, 21 and 21
bits), each read as a word of the perfect binary Golay code (23, 12). Every word lies within 3 bits of
one codeword, and two words at most 2 bits apart have a codeword within 4 bits of both. By the
pigeonhole principle the errors of a pair either leave two segments intact or put one error into each
of two segments; so the keys made of the nearest codewords of two segments and each codeword within 4
bits of the third (about 14 keys of 36 bits) meet for every such pair. Keys are joined by a sort within
hash partitions and each meeting is verified on the fingerprints. Within a key's group only the edges
of its components are emitted, never all pairs; large groups are searched by exact look-ups of all
neighbours instead of pairwise. Equal fingerprints are collapsed first.

Defined cases: a null or blank text has fingerprint 0, and all such are linked as any others are;
fewer words than a shingle has make one shingle of the whole; repeated rows and ids are linked alike;
a null id never is the smallest of its component unless all are null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import connected_components, local_components
from .shared import materialize

SEED = 42
SHINGLE = 3
LIMIT = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101
#: Groups of up to so many fingerprints are compared pairwise, in blocks; larger ones by look-ups.
PAIRWISE = 3000


@lru_cache
def golay() -> np.ndarray:
    """For each of 2048 syndromes the error patterns of up to 4 bits, lightest first, padded with -1."""
    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    unit = [syndrome(1 << i) for i in range(23)]
    rows: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = p = 0
            for b in bits:
                s ^= unit[b]
                p |= 1 << b
            rows[s].append(p)
    out = np.full((2048, max(map(len, rows))), -1, np.int64)
    for s, patterns in enumerate(rows):
        out[s, : len(patterns)] = patterns
    return out


@lru_cache
def _unit_syndromes() -> np.ndarray:
    out = np.zeros(23, np.int64)
    for i in range(23):
        x = 1 << i
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        out[i] = x
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 bits of each 23-bit word, the nearest first, padded with -1."""
    s = np.zeros(len(words), np.int64)
    for i, u in enumerate(_unit_syndromes().tolist()):
        s ^= np.where((words >> i) & 1, u, 0)
    e = golay()[s]
    return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all distinct keys of each fingerprint."""
    lists = [decode(((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    shift = (24, 12, 0)
    near = [x[:, 0] << s for x, s in zip(lists, shift)]
    own, out = [np.arange(len(fp))], [near[0] | near[1] | near[2]]
    for k in range(3):
        rest = sum(near[m] for m in range(3) if m != k)
        r, c = np.nonzero(lists[k][:, 1:] >= 0)
        own.append(r)
        out.append(rest[r] | (lists[k][r, c + 1] << shift[k]))
    return np.concatenate(own), np.concatenate(out)


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each that had white space there; word starts, ends, and rows' offsets."""
    low = tv.LOWER[data]
    mask = tv.IS_WORD[low]
    starts, ends, at = tv.spans(mask, offs)
    keep = mask.copy()
    keep[ends[ends < len(keep)]] = True
    to = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(mask, low, 32)[keep].astype(np.uint8)
    return out.tobytes(), to[starts], to[ends], at


def shingles(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all k-word shingles (one of the whole for a shorter text) and the rows' offsets in them."""
    words = np.diff(at)
    n = np.where(words == 0, 0, np.maximum(words - k + 1, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], n)
    last = np.minimum(first + k - 1, np.repeat(at[1:] - 1, n))
    return starts[first], ends[last], to


def fingerprints(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    body, starts, ends, at = normalised(data, offs)
    s, e, to = shingles(starts, ends, at, k)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(body[a:b], SEED) for a, b in zip(s.tolist(), e.tolist())), np.uint64, len(s))
    counts = tv.bit_counts(h, to)
    on = counts * 2 > np.diff(to)[:, None]
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_rows(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
            fp = [fingerprints(data, offs, k) for _, _, data, offs in tv.blocks(tv.as_string_array(text))]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.concatenate(fp).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def links_within(fp: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest of its component) of distinct fingerprints at most limit bits apart."""
    n = len(fp)
    i, j = [], []
    if n <= PAIRWISE:
        for a in range(0, n, 256):
            close = np.bitwise_count(fp[a : a + 256, None] ^ fp[None, a:]) <= limit
            x, y = np.nonzero(close)
            ok = x < y
            i.append(x[ok] + a)
            j.append(y[ok] + a)
            if len(i) > 1:  # keep a forest, not all pairs
                label = local_components(n, np.concatenate(i), np.concatenate(j))
                own = np.flatnonzero(label != np.arange(n))
                i, j = [own], [label[own]]
    else:
        order = np.sort(fp)
        for w in range(1, limit + 1):
            for bits in combinations(range(64), w):
                other = order ^ np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(order, other), n - 1)
                hit = np.flatnonzero(order[at] == other)
                i.append(hit)
                j.append(at[hit])
            label = local_components(n, np.concatenate(i), np.concatenate(j))
            own = np.flatnonzero(label != np.arange(n))
            i, j = [own], [label[own]]
        fp = order
    label = local_components(n, np.concatenate(i), np.concatenate(j))
    own = np.flatnonzero(label != np.arange(n))
    return fp[own], fp[label[own]]


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (fp,) in tv.rows(batches, ["fp"]):
        own = fp.to_numpy().view(np.uint64)
        r, key = keys(own)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[r].view(np.int64))], ["key", "fp"])


def _emit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key within the partition; a group may go on in the next batch."""

    def groups(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        ok = np.bitwise_count(a ^ b) <= LIMIT
        u, v = [a[ok]], [b[ok]]
        for s, n in zip(cut[:-1][size > 2], size[size > 2]):
            x, y = links_within(fp[s : s + n])
            u.append(x)
            v.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for key, fp in tv.rows(batches, ["key", "fp"]):
        k, f = key.to_numpy(), fp.to_numpy().view(np.uint64)
        last = int(np.searchsorted(k, k[-1]))
        if held and held[-1][0][-1] == k[-1] and last == 0:
            held.append((k, f))
            continue
        yield groups(np.concatenate([x for x, _ in held] + [k[:last]]), np.concatenate([x for _, x in held] + [f[:last]])) if held or last else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"])
        held = [(k[last:], f[last:])]
    if held:
        yield groups(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fps (fp) to edges (u, v) that join all fingerprints at most LIMIT bits apart."""
    keyed = fps.mapInArrow(_emit_keys, "key long, fp long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_emit_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) for every row of docs (doc_id, text)."""
    rows = materialize(fingerprint_rows(docs), "fingerprints")
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = connected_components(links(each.select("fp")))
    grouped = each.join(found, each["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    grouped = materialize(grouped, "fingerprint-groups")
    roots = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    joined = grouped.join(roots, "root").select("fp", "component_id")
    return rows.join(joined, "fp").select("doc_id", "fp", "component_id")
