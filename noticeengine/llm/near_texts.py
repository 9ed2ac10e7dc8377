"""Groups of texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more, found by an exact prefix join.

A text's shingles (32-bit hashes) are put in one order for all texts: how often a sample has them, then
the hash. Two sets of similarity 0.8 then share one of the first n - ceil(0.8 n) + 1 of each, whatever
the order; these are a text's keys, and the order only keeps common shingles from being keys. Texts
that meet in a key are compared by their sizes and by parity bits of their sets (a shingle on one side
only turns one bit, so sets that differ in d shingles differ in at most d bits); no similar pair fails
either. The rest are verified by the exact similarity of the sets, which are memory-mapped sorted
shards. A key's group emits the edges of its components.

Equal word sequences, told apart by a 128-bit digest of the lower-cased words joined by spaces, are
collapsed first. Texts of fewer than five words make one shingle; texts without words make one group.
Rows of one id and text are one document. A null id is smaller than all others; ids that are no
integers go by a hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import connected_components
from .shards import HASHES, Sorted, write_sorted
from .simhash import normalised, shingles

SHINGLE = 5
#: 64-bit words of the parity bits of a set.
PARITY = 8
#: Shingles read to tell common ones, and how many of these are told apart; both bear on speed only.
SAMPLED, COMMON = 1 << 22, 1 << 17
#: Shingles whose keys are found at once.
BLOCK = 1 << 19


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles hold one that a set of similarity 4/5 has among its own."""
    return np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)


def _parity(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity bits of rows of 32-bit hashes."""
    bits, n = 64 * PARITY, len(at) - 1
    place = tv.row_of(at) * bits + (h.astype(np.int64) & (bits - 1))
    on = (np.bincount(place, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes of each row, and the rows' offsets."""
    row = tv.row_of(at)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(at)))


def text_keys(body: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of a 128-bit digest of each row's words."""
    some, view, digest = np.diff(at) > 0, memoryview(body), xxhash.xxh3_128_digest
    first, last = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
    first[some], last[some] = starts[at[:-1][some]], ends[at[1:][some] - 1]
    both = b"".join(digest(view[s:e]) for s, e in zip(first.tolist(), last.tolist()))
    pair = np.frombuffer(both, np.uint64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def _emit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
        ids = tv.ids(doc_id)
        for i, j, data, offs in tv.blocks(tv.as_string_array(text)):
            k, k2 = text_keys(*normalised(data, offs))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(ids[i:j])], ["k", "k2", "id"])


def _with_sets(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    sets = columns.pop("set")
    size = np.array([len(x) // 4 for x in sets], np.int64)
    return columns | {"n": size, "at": np.concatenate([[0], np.cumsum(size)]).astype(np.int64), "flat": np.frombuffer(b"".join(sets), np.uint32)}


def _common(table: Sorted) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample (texts lie in the order of their hashes), sorted, and how often it has them."""
    each = max(1, SAMPLED // max(1, len(table.shards)))
    h, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *(table.arrays(k)["flat"][:each] for k in range(len(table.shards)))]), return_counts=True)
    table._open.clear()
    most = np.sort(np.argsort(-n, kind="stable")[:COMMON])
    most = most[n[most] > 1]
    return h[most], np.minimum(n[most], (1 << 16) - 1)


def _prefixes(flat: np.ndarray, at: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of up to 65536 sets, and the set each belongs to."""
    often, times = common
    seen = np.zeros(len(flat), np.uint64)
    if len(often) and len(flat):
        place = np.minimum(np.searchsorted(often, flat), len(often) - 1)
        seen = np.where(often[place] == flat, times[place], 0).astype(np.uint64)
    row = tv.row_of(at)
    order = np.sort((row.astype(np.uint64) << np.uint64(48)) | (seen << np.uint64(32)) | flat.astype(np.uint64))
    first = np.arange(len(flat)) - at[:-1][row] < prefix_size(np.diff(at))[row]
    return order[first].astype(np.uint32), row[first]


#: Groups of up to so many texts are compared pair by pair, all such groups of a batch at once.
SMALL = 16


#: Shingles of the pairs that are verified at once.
AT_ONCE = 1 << 21


class _Texts:
    """Looks up sizes, parity bits and shingle sets by row, and verifies pairs."""

    def __init__(self, table: Sorted):
        self.table = table

    def columns(self, rows: np.ndarray, names: list[str]) -> np.ndarray:
        """Columns at table rows, in any order."""
        u, back = np.unique(rows, return_inverse=True)
        return np.stack([self.table.take(u, c).view(np.uint64) for c in names], 1)[back]

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.columns(rows, ["n"])[:, 0].astype(np.int64)

    def sets(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets at table rows one after the other, and the place in rows of each shingle."""
        shard = np.searchsorted(self.table.offsets, rows, "right") - 1
        flat, size = [], np.zeros(len(rows), np.int64)
        for i, (n, r) in enumerate(zip(shard.tolist(), (rows - self.table.offsets[shard]).tolist())):
            a = self.table.arrays(n)
            flat.append(a["flat"][a["at"][r] : a["at"][r + 1]])
            size[i] = len(flat[-1])
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.repeat(np.arange(len(rows)), size)

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows have a similarity of 4/5 or more."""
        out = np.zeros(len(a), bool)
        n, m = self.sizes(a), self.sizes(b)
        cut = np.searchsorted(np.cumsum(n + m), np.arange(0, int((n + m).sum()) + AT_ONCE, AT_ONCE))
        for i, j in zip(cut[:-1].tolist(), [*cut[1:-1].tolist(), len(a)]):
            if j > i:
                (x, x_of), (y, y_of) = self.sets(a[i:j]), self.sets(b[i:j])
                x, y = (x_of.astype(np.uint64) << np.uint64(32)) | x, (y_of.astype(np.uint64) << np.uint64(32)) | y
                hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                both = np.bincount(y_of[hit], minlength=j - i)
                out[i:j] = 9 * both >= 4 * (n[i:j] + m[i:j])
        return out


PARITY_COLUMNS = [f"p{i}" for i in range(PARITY)]


def _may_match(n: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and parity bits p at places a and b can have a similarity of 4/5."""
    x, y = n[a], n[b]
    ok = 5 * np.minimum(x, y) >= 4 * np.maximum(x, y)
    return ok & (9 * np.bitwise_count(p[a] ^ p[b]).sum(-1, dtype=np.int64) <= x + y)


def _pairs_of_small(cut: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may match, of groups of up to SMALL texts."""
    size, left, right = np.diff(cut), [cut[:0]], [cut[:0]]
    for k in range(2, SMALL + 1):
        first = cut[:-1][size == k]
        i, j = np.triu_indices(k, 1)
        for at in range(0, len(first), 1 << 14):
            own = first[at : at + (1 << 14), None]
            a, b = (own + i).ravel(), (own + j).ravel()
            ok = _may_match(n, p, a, b)
            left.append(a[ok])
            right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def _forest(at: np.ndarray, n: np.ndarray, p: np.ndarray, texts: _Texts) -> tuple[list[int], list[int]]:
    """Edges (table rows) that join the similar texts of one large group: a search from each text over those not reached yet."""
    u_, v_ = [], []
    left = np.arange(len(at))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.flatnonzero(_may_match(n, p, left, np.array([i])))
            hit = near[texts.similar(at[left[near]], np.full(len(near), at[i]))] if len(near) else near
            found = left[hit]
            u_ += at[found].tolist()
            v_ += [int(at[i])] * len(found)
            todo += found.tolist()
            left = np.delete(left, hit)
    return u_, v_


def _links_of(key: np.ndarray, at: np.ndarray, texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
    """Edges between similar texts (as table rows) that meet in a key; key is sorted."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    many = np.repeat(np.diff(cut) > 1, np.diff(cut))
    key, at = key[many], at[many]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    n, p = texts.sizes(at), texts.columns(at, PARITY_COLUMNS)
    a, b = _pairs_of_small(cut, n, p)
    pair = np.unique(np.stack([np.minimum(at[a], at[b]), np.maximum(at[a], at[b])], 1), axis=0)
    pair = pair[texts.similar(pair[:, 0], pair[:, 1])]
    left, right = [pair[:, 0]], [pair[:, 1]]
    for g in np.flatnonzero(np.diff(cut) > SMALL):
        own = slice(cut[g], cut[g + 1])
        x, y = _forest(at[own], n[own], p[own], texts)
        left.append(np.array(x, np.int64))
        right.append(np.array(y, np.int64))
    return np.concatenate(left), np.concatenate(right)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) of the document with the smallest id of each group; all columns stay.

    A distinct text is known by its row in the table of digests; edges join such rows.
    """
    spark, pairs = docs.sparkSession, docs.select("doc_id", "text")
    texts = pairs.mapInArrow(_emit_texts, "k long, k2 long, id long").groupBy("k", "k2").agg(F.min("id").alias("first"))
    first = write_sorted(texts, "k", None, "near-texts", HASHES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
            ids = tv.ids(doc_id)
            for i, j, data, offs in tv.blocks(tv.as_string_array(text)):
                body, starts, ends, at = normalised(data, offs)
                row = first.find_both(*text_keys(body, starts, ends, at))
                stands = np.flatnonzero(first.take_any(row, "first") == ids[i:j])
                a, b, to = shingles(starts, ends, at, SHINGLE)
                short = (tv.span_hashes(np.frombuffer(body, np.uint8), a, b) >> np.uint64(32)).astype(np.uint32)
                g, g_at = _distinct(short, to)
                p = _parity(g, g_at)
                sets = [g[g_at[r] : g_at[r + 1]].tobytes() for r in stands]
                out = [pa.array(row[stands]), *(pa.array(np.ascontiguousarray(p[stands, c]).view(np.int64)) for c in range(PARITY)), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["k", *PARITY_COLUMNS, "set"]
    schema = ", ".join(f"{n} {'binary' if n == 'set' else 'long'}" for n in names)
    table = write_sorted(pairs.mapInArrow(features, schema), "k", _with_sets, "near-features", max(1, first.rows))

    common = _common(table)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,) in tv.rows(batches, ["id"]):
            for n in number.to_pylist():
                a, i = table.arrays(n), 0
                while i < len(a["key"]):
                    j = min(max(int(np.searchsorted(a["at"], a["at"][i] + BLOCK, "right")) - 1, i + 1), i + (1 << 16))
                    at, begin = a["at"][i : j + 1] - a["at"][i], table.offsets[n] + i
                    key, row = _prefixes(a["flat"][a["at"][i] : a["at"][j]], at, common)
                    i = j
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int32)), pa.array(row + begin)], ["key", "row"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Texts(table)

        def flush(key: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
            ends = [sets.columns(x, ["key"])[:, 0].view(np.int64) if len(x) else x for x in _links_of(key, row, sets)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for key, row in tv.rows(batches, ["key", "row"]):
            x, y = key.to_numpy(), row.to_numpy()
            last = int(np.searchsorted(x, x[-1]))
            if held and last == 0 and held[-1][0][-1] == x[-1]:
                held.append((x, y))
                continue
            if held or last:
                yield flush(np.concatenate([a for a, _ in held] + [x[:last]]), np.concatenate([b for _, b in held] + [y[:last]]))
            held = [(x[last:], y[last:])]
        if held:
            yield flush(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, root in tv.rows(batches, ["node", "root"]):
            yield pa.RecordBatch.from_arrays([root, pa.array(first.take_any(node.to_numpy(), "first"))], ["root", "first"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(0, len(table.shards), 1, max(1, len(table.shards)))
    edges = numbers.mapInArrow(keys, "key int, row long").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(link, "u long, v long").distinct()
    found = connected_components(edges)
    roots = write_sorted(found, "node", None, "near-roots")
    lowest = found.mapInArrow(firsts, "root long, first long").groupBy("root").agg(F.min("first").alias("first"))
    lowest = write_sorted(lowest, "root", None, "near-lowest")
    at = [docs.columns.index(c) for c in ("doc_id", "text")]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = [text_keys(*normalised(data, offs)) for _, _, data, offs in tv.blocks(tv.as_string_array(batch.column(at[1])))]
                row = first.find_both(*(np.concatenate(x) for x in zip(*key)))
                linked = roots.find_any(row.astype(np.uint64))
                root = lowest.find_any(roots.take_any(linked, "root").astype(np.uint64))
                stays = np.where(linked >= 0, lowest.take_any(root, "first"), first.take_any(row, "first"))
                yield batch.filter(pa.array(stays == tv.ids(batch.column(at[0]))))

    return docs.mapInArrow(choose, docs.schema)
