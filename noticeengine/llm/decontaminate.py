"""Benchmark decontamination by suffix arrays.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is WINDOW
consecutive words of an item, or the whole of a shorter one. Each block of documents is a shard with
a word-level suffix array of all its suffixes, ordered by rank doubling over their first 16 words.
Every window, the head of a test suffix, is searched in every shard by bisection: the range found
gives all its verbatim places. Places of neighbouring windows of one item that follow each other in a
document are one longer match, so their runs give its longest verbatim match. Documents with a place
are contaminated.

The windows are written once, by tasks, as sorted arrays in the shared folder, which tasks
memory-map: nothing of the benchmark reaches the driver or a closure, whatever its size. A shard first
leaves out windows with a word that it does not have.

Defined cases: a null text has no words; an item without words has no window; a null item id is
written as an empty text; repeated items and rows each count; an empty benchmark contaminates
nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .shards import HASHES, Sorted, write_sorted
from .shared import materialize

WINDOW = 10
#: Bytes of document text of a shard.
SHARD = 2 << 20
#: Windows that are looked for at once.
AT_ONCE = 1 << 17


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the rows' offsets in them."""
    low = tv.LOWER[data]
    starts, ends, at = tv.spans(tv.IS_ALNUM[low], offs)
    return tv.span_hashes(low, starts, ends), at


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a window: its first word, all its words as bytes, its item and place."""
    for item, text in tv.rows(batches, ["item", "text"]):
        number = item.to_numpy()
        for i, j, data, offs in tv.blocks(tv.as_string_array(text)):
            h, at = words(data, offs)
            n = np.where(np.diff(at) > 0, np.maximum(np.diff(at) - WINDOW + 1, 1), 0)
            to = np.concatenate([[0], np.cumsum(n)])
            row = tv.row_of(to)
            place = np.arange(to[-1]) - to[row]
            first, last = at[row] + place, at[row + 1]
            reach = first[:, None] + np.arange(WINDOW)
            inside = reach < last[:, None]
            body = np.where(inside, h[np.minimum(reach, max(0, len(h) - 1))] if len(h) else 0, 0).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array([x.tobytes() for x in body], pa.binary()), pa.array(inside.sum(1)), pa.array(number[i:j][row]), pa.array(place)],
                ["k", "body", "size", "item", "place"],
            )


def _flat_words(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return columns | {"body": np.frombuffer(b"".join(columns["body"]), np.uint64)}


def _flat_names(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    names = [x.encode() for x in columns.pop("id")]
    return columns | {"at": np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64), "flat": np.frombuffer(b"".join(names), np.uint8)}


def windows_of(benchmark: DataFrame) -> tuple[Sorted, Sorted]:
    """Tables of the windows of a benchmark (item_id, text), by their first words, and of the items' ids, by their numbers."""
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    rows = materialize(rows, "items")  # numbers once given stay
    windows = write_sorted(rows.select("item", "text").mapInArrow(_emit_windows, "k long, body binary, size long, item long, place long"), "k", _flat_words, "windows", HASHES)
    return windows, write_sorted(rows.select("item", "id"), "item", _flat_names, "item-ids")


class Shard:
    """The suffix array of a block of documents, of dense word ranks from 1 on; 0 stands after each document's end."""

    def __init__(self, h: np.ndarray, at: np.ndarray):
        self.known, rank = np.unique(h, return_inverse=True)
        self.end = np.repeat(at[1:], np.diff(at))
        self.rank = rank + 1
        place = np.arange(len(h))
        order, reach = self.rank, 1
        while reach < WINDOW:
            ahead = place + reach
            after = np.where(ahead < self.end, order[np.minimum(ahead, len(h) - 1)], 0) if len(h) else order
            order = np.unique(order * (len(h) + 2) + after, return_inverse=True)[1] + 1
            reach *= 2
        self.array = np.argsort(order, kind="stable")

    def heads(self, places: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first words of the suffixes at places, as many as size says, 0 beyond."""
        reach = places[:, None] + np.arange(WINDOW)
        inside = (reach < self.end[places][:, None]) & (np.arange(WINDOW) < size[:, None])
        return np.where(inside, self.rank[np.minimum(reach, len(self.rank) - 1)], 0)

    def ranks(self, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the words of the windows that have only known ones, and which these are."""
        keep, out = np.arange(len(body)), np.zeros((len(body), WINDOW), np.int64)
        for j in range(WINDOW):
            x = body[keep, j]
            i = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
            used = j < size[keep]
            ok = ~used | (self.known[i] == x)
            out[keep, j] = np.where(used, i + 1, 0)
            keep = keep[ok]
        return out[keep], keep

    def search(self, test: np.ndarray, size: np.ndarray, past: bool) -> np.ndarray:
        """Bisection: the first place of the array whose head is not below (or, with past, is above) each test head."""
        lo, hi = np.zeros(len(test), np.int64), np.full(len(test), len(self.array), np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            differ = self.heads(self.array[mid], size[open_]) - test[open_]
            first = differ[np.arange(len(open_)), (differ != 0).argmax(1)]
            right = first <= 0 if past else first < 0
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        return lo

    def places(self, table: Sorted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place in the item, words, place in the block) of every occurrence of the windows of a table."""
        if not len(self.array):
            return
        for n, part in table.parts(self.known):
            a = table.arrays(n)
            lo, hi = (np.searchsorted(a["key"], self.known[part], side) for side in ("left", "right"))
            some = np.flatnonzero(hi > lo)
            wide = np.cumsum(hi[some] - lo[some])
            cut = np.unique(np.concatenate([[0], np.searchsorted(wide, np.arange(AT_ONCE, wide[-1], AT_ONCE)) if len(wide) else [], [len(some)]]).astype(np.int64))
            for i, j in zip(cut[:-1], cut[1:]):
                own = some[i:j]
                count = hi[own] - lo[own]
                rows = np.repeat(lo[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                size = a["size"][rows]
                test, keep = self.ranks(a["body"].reshape(-1, WINDOW)[rows], size)
                rows, size = rows[keep], size[keep]
                if not len(rows):
                    continue
                left, right = self.search(test, size, False), self.search(test, size, True)
                m = right - left
                found = np.repeat(left, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield np.repeat(a["item"][rows], m), np.repeat(a["place"][rows], m), np.repeat(size, m), self.array[found]


def _matches(row: np.ndarray, item: np.ndarray, inner: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """(row, item, place in the item, place, words) of the maximal verbatim matches, by row: runs of places that advance together in an item and a row."""
    if not len(row):
        return [np.zeros(0, np.int64)] * 5
    diagonal = place - inner
    order = np.lexsort((place, diagonal, item, row))
    row, item, diagonal, place, size, inner = (x[order] for x in (row, item, diagonal, place, size, inner))
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)])
    at = np.flatnonzero(new)
    return [row[at], item[at], inner[at], place[at], np.diff(np.append(at, len(row))) - 1 + size[at]]


def _names(table: Sorted, numbers: np.ndarray) -> list[str]:
    """Ids of the items of sorted numbers."""
    out = []
    for n, part in table.parts(numbers.astype(np.uint64)):
        a = table.arrays(n)
        i = np.searchsorted(a["key"], numbers[part].astype(np.uint64))
        out += [a["flat"][s:e].tobytes().decode() for s, e in zip(a["at"][i], a["at"][i + 1])]
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns, n_words, longest, spans (hit words), items and places (item, place in the item, word, words) of every row of docs, by windows of benchmark (item_id, text).

    Places are the maximal verbatim matches. The text of docs may be among the carried columns.
    """
    table, names = windows_of(benchmark)
    column = carry.index(text) if text in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.as_string_array(batch.column(column))
            n_words, longest, spans, ids, matches = [], [], [], [], []
            for i, j, data, offs in tv.blocks(texts, SHARD):
                h, at = words(data, offs)
                got = list(Shard(h, at).places(table))
                item, inner, size, place = (np.concatenate(x) for x in zip(*got)) if got else [np.zeros(0, np.int64)] * 4
                n_words.append(np.diff(at))
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + size, -1)
                s, e, own = tv.spans(np.cumsum(cover)[:-1] > 0, at)
                row = np.searchsorted(at, place, "right") - 1
                r, m_item, m_inner, m_place, m_size = _matches(row, item, inner, place, size)
                most = np.zeros(j - i, np.int64)
                np.maximum.at(most, r, m_size)
                longest.append(most)
                kinds, which = np.unique(item, return_inverse=True)
                said = _names(names, kinds)
                pairs = np.unique(row * max(1, len(kinds)) + which)
                rows, which = pairs // max(1, len(kinds)), pairs % max(1, len(kinds))
                cut, to = np.searchsorted(rows, np.arange(j - i + 1)), np.searchsorted(r, np.arange(j - i + 1))
                m_which = np.searchsorted(kinds, m_item)
                for k in range(j - i):
                    spans.append(np.column_stack([s[own[k] : own[k + 1]], e[own[k] : own[k + 1]]]) - at[k] if own[k] < own[k + 1] else [])
                    ids.append([said[x] for x in which[cut[k] : cut[k + 1]]])
                    matches.append([{"item": said[m_which[x]], "from": int(m_inner[x]), "at": int(m_place[x] - at[k]), "words": int(m_size[x])} for x in range(to[k], to[k + 1])])
            flat = [x for rows_ in spans for x in rows_]
            lists = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)
            pair = pa.StructArray.from_arrays([pa.array([int(x[k]) for x in flat], pa.int64()) for k in (0, 1)], ["start", "end"])
            kind = pa.list_(pa.struct([("item", pa.string()), ("from", pa.int64()), ("at", pa.int64()), ("words", pa.int64())]))
            out = [pa.array(np.concatenate(n_words)), pa.array(np.concatenate(longest)), pa.ListArray.from_arrays(pa.array(lists), pair), pa.array(ids, pa.list_(pa.string())), pa.array(matches, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(carry))] + out, [*carry, "n_words", "longest", "spans", "items", "places"])

    found = T.StructType.fromDDL("n_words long, longest long, spans array<struct<start:long,end:long>>, items array<string>, places array<struct<item:string,`from`:long,at:long,words:long>>")
    schema = T.StructType(docs.select(*carry).schema.fields + found.fields)
    return docs.select(*carry, *([] if text in carry else [F.col(text).alias("__text")])).mapInArrow(run, schema)


def digest(matches: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return matches.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
    )
