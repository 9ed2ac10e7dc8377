"""Exact removal of byte strings that occur more than once, by blockwise suffix sorting.

Only suffixes that can have an equal are sorted. Of each string of a grain's length (400 bytes) the
place with the smallest 8-byte hash among its first ones is its anchor, and equal strings have equal
anchors at equal places; a run of neighbouring strings with one anchor is a context. Contexts are
counted by the hash of the bytes at the anchor (the suffix bucket) and by a 128-bit digest of the
whole context:

* a context that occurs twice as a whole repeats wherever it stands; nothing of it is sorted;
* a bucket with one distinct context has no other repeats;
* the other buckets' distinct contexts are sent to their bucket's task, which sorts one block of
  buckets at a time. Places at a fixed step from the anchor are the cover sample: their ranks by the
  next 16, 32, 64, 128 and 256 bytes come from doubling, and two suffixes of a bucket compare by a few
  bytes up to the next sampled place, the ranks there, and a few bytes at the end. Since equal
  suffixes stand equally far from their anchors, one residue of the step is a difference cover;
* a bucket with more than BUCKET distinct contexts is not brought together in one task. Its strings are
  told apart by 128-bit digests in two steps, wherever they stand: the bytes that all strings of a piece
  of STEP neighbouring distances share are counted first, and only the strings of pieces met twice are
  counted one by one. Tasks add up their own rows before they are shuffled, the counts become sorted
  shards, and a string that occurs twice is found in them by each context's task, as runs.

Equal texts are collapsed first: one of them stands for all. Tables of hashes and intervals are sorted
shards in the shared folder, looked up by the tasks that cut the texts, so texts are never shuffled
but for the contexts that are sorted. Memory follows the block, not the text: a long text is worked on
in overlapping pieces.

Bytes are removed by the first grain alone. A second, finer one tells passages: maximal runs of bytes
covered by repeated strings of 240 bytes that hold over 50 whole words are counted, not removed (50
words of prose are often shorter than 400 bytes).

Defined cases: a null text is empty; texts shorter than a string lose nothing; repeated rows are equal
texts and lose all; a null id counts as its own id when the standing row of equal texts is picked, and
ids that are no integers are told apart by a hash; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shards import HASHES, Sorted, write_sorted
from .shared import materialize, release



class Grain(NamedTuple):
    """Strings of length bytes; the core bytes from the anchor on name a bucket, so the first length - core + 1 places hold an anchor."""

    length: int
    core: int


REMOVED, PASSAGES = Grain(400, 200), Grain(240, 80)
#: A passage has more words than this.
PASSAGE_WORDS = 50
GRAM = 8
STEP = 16
#: Distinct contexts of a bucket that one task sorts; larger ones are counted by digest.
BUCKET = 1024
PIECE = 1 << 20
#: A place in a piece has at most so many bits (a piece has under 2 * PIECE + 2 * LENGTH bytes).
_PLACE = np.uint64((1 << 22) - 1)


def _parts(column: pa.Array, length: int) -> Iterator[tuple["Part", np.ndarray, np.ndarray]]:
    """(part, row numbers, byte place of each of its rows in the text): blocks of rows, or parts of a long row that overlap by length - 1 bytes."""
    for i, j, data, offs in tv.blocks(column, PIECE):
        if j - i > 1 or len(data) <= 2 * PIECE:
            yield Part(data, offs, len(data)), np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            last = (len(data) - length) // PIECE * PIECE
            for at in range(0, last + 1, PIECE):
                part = data[at : at + PIECE + length - 1] if at < last else data[at:]
                yield Part(part, np.array([0, len(part)]), PIECE if at < last else len(part)), np.array([i]), np.array([at])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[p : p + width] for each p with a full window."""
    n = len(x)
    full = -(-n // width) * width
    y = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    y = y.reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Part:
    """One part of the corpus with the hashes that all grains share; strings that start at places or later belong to the next part."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, places: int):
        n = len(data)
        self.places = places
        up, down = tv._powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self.data, self.offs, self.total, self.down = data, offs, total, down
        self.view = memoryview(np.ascontiguousarray(data))
        x = (total[GRAM:] - total[:-GRAM]) * down[: max(0, n - GRAM + 1)] if n >= GRAM else total[:0].copy()
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x &= ~_PLACE
        x |= np.arange(len(x), dtype=np.uint64)
        self.order = x

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return tv.mix((self.total[start + size] - self.total[start]) * self.down[start] + np.asarray(size, np.uint64))


class Contexts:
    """A grain's runs of places of a part: row (in the part), first and last place, anchor, bucket and the context's digest in two halves."""

    def __init__(self, part: Part, grain: Grain):
        data, offs, length = part.data, part.offs, grain.length
        n, width = len(data), length - grain.core + 1
        self.row = self.lo = self.hi = self.anchor = np.zeros(0, np.int64)
        self.bucket = self.context = self.context2 = np.zeros(0, np.uint64)
        size = np.diff(offs)
        long = np.flatnonzero(size >= length)
        if not len(long):
            return
        least = (_sliding_least(part.order, width) & _PLACE).astype(np.int64)
        mark = np.zeros(n + 1, np.int32)
        mark[offs[:-1][long]] += 1
        mark[np.minimum(offs[1:][long] - length + 1, part.places)] -= 1
        at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        anchor = least[at]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.lo, self.hi, self.anchor = at[new], at[np.append(new[1:], len(at)) - 1], anchor[new]
        self.row = np.searchsorted(offs, self.lo, "right") - 1
        self.bucket = tv.mix(part.hash(self.anchor, grain.core) + np.uint64(length))
        view, digest = part.view, xxhash.xxh3_128_digest
        both = b"".join(digest(view[a : b + length], seed=length + 512 * d) for a, b, d in zip(self.lo.tolist(), self.hi.tolist(), (self.anchor - self.lo).tolist()))
        pair = np.frombuffer(both, np.uint64).reshape(-1, 2)
        self.context, self.context2 = pair[:, 0].copy(), pair[:, 1].copy()


def text_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each text's MD5."""
    data, offs = tv.buffers(column)
    view = memoryview(data)
    both = b"".join(hashlib.md5(view[s:e], usedforsecurity=False).digest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()))
    pair = np.frombuffer(both, np.uint64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _emit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
        k, k2 = text_keys(tv.as_string_array(text))
        yield pa.RecordBatch.from_arrays([_signed(k), _signed(k2), pa.array(tv.ids(doc_id))], ["k", "k2", "id"])


def _standing(texts: Sorted, doc_id: pa.Array, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all texts, and which rows stand for their text."""
    k, k2 = text_keys(column)
    return k, k2, texts.take_any(texts.find_both(k, k2), "first") == tv.ids(doc_id)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the rows made of the keys, equal rows alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _words_at(text: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """n big-endian 64-bit words from each place on."""
    got = text[at[:, None] + np.arange(8 * n)].view(">u8").astype(np.uint64)
    return [got[:, i] for i in range(n)]


def repeated(text: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, place in it) of every string of the contexts that another place has too.

    text holds the contexts one after the other, begin, size and anchor (in the context) are theirs;
    strings are only compared within a bucket and at one distance from the anchor.
    """
    # Cover sample: every STEP-th place, counted from the anchor.
    first = anchor % STEP
    n = np.maximum((size - STEP - first) // STEP + 1, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(np.arange(len(begin)), n)
    place = np.repeat(begin + first, n) + STEP * (np.arange(at[-1]) - np.repeat(at[:-1], n))
    left = np.repeat(at[1:], n) - np.arange(at[-1])
    blocks = (length - STEP + 1) // STEP
    ranks, reach = {1: _dense(*_words_at(text, place, 2))}, 1
    while reach * 2 <= blocks:
        nearer = ranks[reach]
        ahead = np.where(left > reach, nearer[np.minimum(np.arange(len(nearer)) + reach, len(nearer) - 1)], -1)
        reach *= 2
        ranks[reach] = _dense(nearer, ahead)
    # One key per string: bytes up to the next sampled place, ranks from there, and the last bytes.
    m = size - length + 1
    c = np.repeat(np.arange(len(begin)), m)
    p = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    distance = anchor[c] - p
    nearest = distance % STEP
    sample = at[c] + (p + nearest - first[c]) // STEP
    keys = [bucket[c], distance.astype(np.uint64), *_words_at(text, begin[c] + p, 2)]
    for r in sorted(ranks, reverse=True):
        if blocks & r:
            keys.append(ranks[r][sample].astype(np.uint64))
            sample = sample + r
    keys += _words_at(text, begin[c] + p + length - 32, 4)
    mixed = keys[0]
    for k in keys[1:]:
        mixed = tv.pair_hashes(mixed, k)
    order = np.argsort(mixed, kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        x = k[order]
        same &= x[1:] == x[:-1]
    hit = np.zeros(len(order), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return c[hit], p[hit]


def _runs(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring places of one context."""
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)]))
    return new, np.append(new[1:], len(c)) - 1


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, sorted by bucket within the partition, to intervals of repeated bytes of the contexts that are not whole."""

    def flush(parts: list[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        columns = [pa.concat_arrays([p[i] for p in parts]) for i in range(8)]
        kinds = columns[7].to_numpy()
        for length in np.unique(kinds).tolist():
            own = columns if (kinds == length).all() else [x.filter(pa.array(kinds == length)) for x in columns]
            bucket, anchor, whole, k, k2, lo = (own[i].to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5, 6))
            text, offs = tv.buffers(own[2].cast(pa.large_binary()))
            c, p = repeated(text, offs[:-1], np.diff(offs), anchor.astype(np.int64), bucket.view(np.uint64), length)
            mine = ~whole[c]
            c, p = c[mine], p[mine]
            new, last = _runs(c, p)
            n = c[new]
            yield pa.RecordBatch.from_arrays([pa.array(k[n]), pa.array(k2[n]), pa.array(lo[n] + p[new]), pa.array(lo[n] + p[last] + length), pa.array(np.full(len(n), length, np.int32))], ["k", "k2", "start", "end", "length"])

    held: list[list[pa.Array]] = []
    weight = 0
    for columns in tv.rows(batches, ["bucket", "anchor", "body", "whole", "k", "k2", "lo", "length"]):
        key = columns[0].to_numpy()
        if held and held[-1][0][-1].as_py() != key[0] and weight > PIECE:
            yield from flush(held)
            held, weight = [], 0
        done = 0
        for cut in np.flatnonzero(key[1:] != key[:-1]) + 1:
            if weight + (cut - done) * 600 > PIECE:
                held.append([x[done:cut] for x in columns])
                yield from flush(held)
                held, weight, done = [], 0, int(cut)
        held.append([x[done:] for x in columns])
        weight += (len(key) - done) * 600
    if held:
        yield from flush(held)


def _pieces(size: int, anchor: int, length: int) -> list[tuple[int, int, int]]:
    """(number, first and last place) of the pieces of a context of size bytes: strings whose distances from the anchor differ in the last digit to base STEP alone."""
    nearest, farthest = max(0, anchor - (size - length)), anchor
    return [(q, anchor - min(farthest, q * STEP + STEP - 1), anchor - max(nearest, q * STEP)) for q in range(nearest // STEP, farthest // STEP + 1)]


def _piece_digests(body: bytes, anchor: int, length: int) -> list[bytes]:
    """A digest of the bytes that any strings of each piece share, whichever of them the context has."""
    digest = xxhash.xxh3_128_digest
    return [digest(memoryview(body)[anchor - q * STEP : anchor - q * STEP - (STEP - 1) + length], seed=length + 512 * q) for q, _, _ in _pieces(len(body), anchor, length)]


def _string_digests(body: bytes, first: int, last: int, anchor: int, length: int) -> list[bytes]:
    """A digest of each string from first to last, with its distance from the anchor."""
    digest, view = xxhash.xxh3_128_digest, memoryview(body)
    return [digest(view[p : p + length], seed=length + 512 * (anchor - p)) for p in range(first, last + 1)]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


#: Digests that a task gathers before it adds them up.
GATHERED = 1 << 18


def _added(parts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Digests (h, h2) and how often the task has met each of them, added up over GATHERED at a time."""

    def flush() -> pa.RecordBatch:
        h, h2 = _halves(held)
        order = np.lexsort((h2, h))
        h, h2 = h[order], h2[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))
        return pa.RecordBatch.from_arrays([_signed(h[new]), _signed(h2[new]), pa.array(np.diff(np.append(new, len(h))))], ["h", "k2", "n"])

    held: list[bytes] = []
    for part in parts:
        held += part
        if len(held) >= GATHERED:
            yield flush()
            held = []
    if held:
        yield flush()


_BODIES = ["body", "anchor", "length", "k", "k2", "lo"]


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Contexts (body, anchor, length, k, k2, lo), some hundred at a time."""
    for columns in tv.rows(batches, _BODIES):
        for at in range(0, len(columns[0]), 512):
            yield list(zip(*(c.slice(at, 512).to_pylist() for c in columns)))


def _seen_pieces(rows: list[tuple], pieces: Sorted) -> list[tuple[int, int, int]]:
    """(row, first and last place) of the rows' pieces that another context has too."""
    each = [(r, first, last) for r, x in enumerate(rows) for _, first, last in _pieces(len(x[0]), x[1], x[2])]
    found = pieces.find_both(*_halves([d for x in rows for d in _piece_digests(*x[:3])])) >= 0
    return [x for x, again in zip(each, found.tolist()) if again]


def _hot_spans(hot: DataFrame) -> DataFrame:
    """Intervals of repeated bytes of contexts (body, anchor, whole, k, k2, lo, length) that are not whole, by digests of their strings."""

    def twice(counts: DataFrame, tag: str) -> Sorted:
        return write_sorted(counts.groupBy("h", "k2").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "k2"), "h", None, tag, HASHES)

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(_piece_digests(*x[:3]) for rows in _bodies(batches) for x in rows)

    bodies = hot.select(*_BODIES)
    pieces = twice(bodies.mapInArrow(count_pieces, "h long, k2 long, n long"), "sub-pieces")

    def count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(_string_digests(rows[r][0], a, b, *rows[r][1:3]) for rows in _bodies(batches) for r, a, b in _seen_pieces(rows, pieces))

    often = twice(bodies.mapInArrow(count_strings, "h long, k2 long, n long"), "sub-strings")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bodies(batches):
            # Pieces are listed by distance; places in rising order make runs of neighbours.
            seen = sorted(_seen_pieces(rows, pieces))
            if not seen:
                continue
            c = np.concatenate([np.full(b - a + 1, r) for r, a, b in seen])
            p = np.concatenate([np.arange(a, b + 1) for _, a, b in seen])
            again = often.find_both(*_halves([d for r, a, b in seen for d in _string_digests(rows[r][0], a, b, *rows[r][1:3])])) >= 0
            c, p = c[again], p[again]
            new, last = _runs(c, p)
            length, k, k2, lo = (np.array([x[i] for x in rows], np.int64)[c[new]] for i in (2, 3, 4, 5))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k2), pa.array(lo + p[new]), pa.array(lo + p[last] + length), pa.array(length.astype(np.int32))], ["k", "k2", "start", "end", "length"])

    return hot.filter("NOT whole").select(*_BODIES).mapInArrow(find, "k long, k2 long, start long, end long, length int")


class Tables(NamedTuple):
    """What `cut` looks up: distinct texts, contexts that repeat whole, and intervals of repeated bytes, of all grains."""

    texts: Sorted
    whole: Sorted
    spans: Sorted
    grains: tuple[Grain, ...]


def repeated_spans(docs: DataFrame, grains: tuple[Grain, ...] = (REMOVED, PASSAGES), bucket: int = BUCKET) -> Tables:
    """Find all repeated strings of docs (doc_id, text). Buckets of over bucket distinct contexts are counted by digest."""
    texts = docs.select("doc_id", "text").mapInArrow(_emit_texts, "k long, k2 long, id long")
    texts = texts.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    texts = write_sorted(texts, "k", None, "sub-texts", HASHES)
    longest = max(g.length for g in grains)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
            text = tv.as_string_array(text)
            k, _, stands = _standing(texts, doc_id, text)
            for part, rows, at in _parts(text, longest):
                for grain in grains:
                    c = Contexts(part, grain)
                    ok = stands[rows[c.row]]
                    place = tv.pair_hashes(k[rows[c.row]], (c.lo - part.offs[c.row] + at[c.row]).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([_signed(x[ok]) for x in (c.bucket, c.context, c.context2, place)], ["bucket", "context", "k2", "place"])

    each = docs.select("doc_id", "text").mapInArrow(contexts, "bucket long, context long, k2 long, place long")
    each = each.groupBy("bucket", "context", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    whole, buckets = _two_tables(each)

    def to_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
            text = tv.as_string_array(text)
            k, k2, stands = _standing(texts, doc_id, text)
            for part, rows, at in _parts(text, longest):
                for grain in grains:
                    c = Contexts(part, grain)
                    ok = np.flatnonzero(stands[rows[c.row]])
                    n = buckets.take_any(buckets.find_any(c.bucket[ok]), "n")
                    ok, n = ok[n > 1], n[n > 1]
                    row = c.row[ok]
                    lo = c.lo[ok] - part.offs[row] + at[row]
                    found = whole.find_both(c.context[ok], c.context2[ok])
                    again = found >= 0
                    here = tv.pair_hashes(k[rows[row]], lo.astype(np.uint64)).view(np.int64)
                    keep = ~again | (whole.take_any(found, "place") == here)
                    ok, n, row, lo, again = ok[keep], n[keep], row[keep], lo[keep], again[keep]
                    body = [part.view[a : b + grain.length].tobytes() for a, b in zip(c.lo[ok].tolist(), c.hi[ok].tolist())]
                    size = pa.array(np.full(len(ok), grain.length, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [_signed(c.bucket[ok]), pa.array((c.anchor[ok] - c.lo[ok]).astype(np.int32)), pa.array(body, pa.binary()), pa.array(again), _signed(k[rows[row]]), _signed(k2[rows[row]]), pa.array(lo), size, pa.array(n > bucket)],
                        ["bucket", "anchor", "body", "whole", "k", "k2", "lo", "length", "hot"],
                    )

    rows = materialize(docs.select("doc_id", "text").mapInArrow(to_sort, "bucket long, anchor int, body binary, whole boolean, k long, k2 long, lo long, length int, hot boolean"), "sub-contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.filter("NOT hot").drop("hot").repartition(parts, "bucket").sortWithinPartitions("bucket")
    spans = sorted_.mapInArrow(_sort_buckets, "k long, k2 long, start long, end long, length int")
    spans = write_sorted(spans.unionByName(_hot_spans(rows.filter("hot"))), "k", None, "sub-spans", HASHES)
    release(rows)
    return Tables(texts, whole, spans, tuple(grains))


def _two_tables(each: DataFrame) -> tuple[Sorted, Sorted]:
    """Contexts seen twice, and buckets with more than one distinct context."""
    each = materialize(each, "sub-counts")
    whole = write_sorted(each.filter("n > 1").select("context", "k2", "place"), "context", None, "sub-whole", HASHES)
    buckets = write_sorted(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket", None, "sub-buckets", HASHES)
    release(each)
    return whole, buckets


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.append(new[1:], len(start)) - 1]


def _intervals_of(spans: Sorted, k: np.ndarray, k2: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, length, start, end) of the stored intervals of the texts at the wanted rows."""
    first = spans.find_any(k)
    for r in np.flatnonzero((first >= 0) & wanted).tolist():
        at, mine = int(first[r]), int(k[r])
        n = int(np.searchsorted(spans.offsets, at, "right")) - 1
        while n < len(spans.shards):  # a text's intervals may go on in the next shard
            a, base = spans.arrays(n), int(spans.offsets[n])
            stop = int(np.searchsorted(a["key"], np.uint64(mine), "right"))
            own = slice(at - base, stop)
            ok = a["k2"][own] == k2[r : r + 1].view(np.int64)[0]
            for length, s, e in zip(a["length"][own][ok].tolist(), a["start"][own][ok].tolist(), a["end"][own][ok].tolist()):
                yield r, length, s, e
            if stop < len(a["key"]):
                break
            n, at = n + 1, base + len(a["key"])


def _words_inside(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whole words in each of the intervals."""
    first, last, _ = tv.spans(tv.IS_WORD[row], np.array([0, len(row)]))
    return np.maximum(np.searchsorted(last, end, "right") - np.searchsorted(first, start), 0)


def cut(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs), kept (remaining bytes) and n_passages of every row of docs (doc_id, text)."""
    texts, whole, intervals, grains = tables
    longest = max(g.length for g in grains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
            text = tv.as_string_array(text)
            data, offs = tv.buffers(text)
            size = np.diff(offs)
            k, k2 = text_keys(text)
            copies = texts.take_any(texts.find_both(k, k2), "n") > 1
            found: dict[int, list[list[tuple[int, int]]]] = {g.length: [[] for _ in range(len(k))] for g in grains}
            for part, rows, at in _parts(text, longest):
                for grain in grains:
                    c = Contexts(part, grain)
                    ok = np.flatnonzero((whole.find_both(c.context, c.context2) >= 0) & ~copies[rows[c.row]])
                    row = c.row[ok]
                    shift = at[row] - part.offs[row]
                    for r, s, e in zip(rows[row].tolist(), (c.lo[ok] + shift).tolist(), (c.hi[ok] + grain.length + shift).tolist()):
                        found[grain.length][r].append((s, e))
            for r, length, s, e in _intervals_of(intervals, k, k2, ~copies):
                found[length][r].append((s, e))
            for length, own in found.items():
                for r in np.flatnonzero(copies & (size >= length)).tolist():
                    own[r] = [(0, int(size[r]))]
            spans, kept, passages = [], [], []
            for r in range(len(k)):
                own = data[offs[r] : offs[r + 1]]
                runs = {length: _merged(*np.array(x[r], np.int64).T) for length, x in found.items() if x[r]}
                if grains[0].length in runs:
                    s, e = runs[grains[0].length]
                    mask = np.zeros(len(own) + 1, np.int32)
                    mask[s] += 1
                    mask[e] -= 1
                    kept.append(own[np.cumsum(mask)[:-1] == 0].tobytes())
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e)])
                else:
                    spans.append([])
                    kept.append(own.tobytes())
                fine = runs.get(grains[-1].length)
                passages.append(int((_words_inside(own, *fine) > PASSAGE_WORDS).sum()) if fine else 0)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(size), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(passages, pa.int64())], ["doc_id", "n_bytes", "spans", "kept", "n_passages"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, n_passages long")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
