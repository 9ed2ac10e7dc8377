"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Training counts all tokens (lower-cased words and one end per text) and all runs of three tokens, a
begin before each text and nothing after its end. Level 1 of the trie is the sorted vocabulary: a
word's place is its id. Levels 2 and 3 lie in shards by the hash of a pair, so that a frequent word's
pairs are spread over all of them. In a shard, level 2 holds the ids of contexts, monotone pointers
from them and the sorted ids of their successors, coded as one Elias-Fano sequence; a pair's place
there is the context of level 3, which is built alike. Each pair and triple has its discounted
relative frequency, quantised; each pair also the weight that its successors leave over. All pairs
and triples stay, however rare.

A token's probability is interpolated: that of the triple, plus the left-over weight times that of
the pair, plus the word's left-over weight times its own smoothed probability. Shards are
memory-mapped by the scoring tasks; a token costs one search for its pair, whose place is also the
context of the next token's triple, and one context-relative successor search for its triple. Words
are told apart by 64-bit hashes.

Counting shuffles each block's distinct triples once, packed by shard, where equal ones are summed.

Defined cases: a null or blank text is one end token; an empty table gives an empty result; with no
training text all counts are 0 and every word is unknown; repeated rows each train and are scored.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .eliasfano import EliasFano, encode
from .shards import HASHES, Sorted, map_arrays, write_arrays, write_sorted
from .shared import scratch_path

DISCOUNT = 0.75
#: Bits of a quantised logarithm; they are rounded to equal steps between this and 0.
BITS, LOWEST = 8, -12.0
END = np.uint64(0x9D39247E33776D41)
#: Ids of the context before the first token and of what follows an end.
BEGIN, NOTHING = (1 << 32) - 1, (1 << 32) - 2
#: Bytes of text that are counted or scored at once.
BLOCK = 4 << 20
#: Distinct words that a task sums up before it passes them on.
HELD = 1 << 20


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, an END after each row's, and the rows' offsets."""
    low = tv.LOWER[data]
    starts, ends, at = tv.spans(tv.IS_WORD[low], offs)
    h = tv.span_hashes(low, starts, ends)
    n = len(offs) - 1
    out = np.empty(len(h) + n, np.uint64)
    row = tv.row_of(at)
    out[np.arange(len(h)) + row] = h
    at = at + np.arange(n + 1)
    out[at[1:] - 1] = END
    return out, at


class _Sums:
    """Counts of 64-bit items, summed up in pieces of bounded size."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(items, return_counts=True)
        self.parts.append((key, n))
        self.held += len(key)
        if self.held > 2 * HELD:
            key, n = self._merged()
            self.parts, self.held = [(key, n)], len(key)
            if self.held > HELD:
                yield from self.flush()

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([n for _, n in self.parts])
        order = np.argsort(key)
        key, n = key[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[at], np.add.reduceat(n, at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            key, n = self._merged()
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["h", "n"])
        self.parts, self.held = [], 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for (text,) in tv.rows(batches, ["text"]):
        for _, _, data, offs in tv.blocks(tv.as_string_array(text)):
            yield from sums.add(tokens(data, offs)[0])
    yield from sums.flush()


@dataclass
class Model:
    words: Sorted  # key: hash, n: count
    left: Sorted | None  # key: word id, n: distinct successors
    trie: list[tuple[str, list]]  # path and layout of each shard
    total: int
    texts: int
    bits: int = BITS
    _open: dict | None = None

    @property
    def vocabulary(self) -> int:
        return self.words.rows

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def shard(self, n: int) -> dict:
        """Arrays of a shard and its levels `two` and `three`."""
        if self._open is None:
            self._open = {}
        if n not in self._open:
            if len(self._open) >= 256:
                self._open.pop(next(iter(self._open)))
            a = map_arrays(*self.trie[n]) if self.trie[n][0] else {}
            self._open[n] = a | {"two": Level(a, "a_"), "three": Level(a, "b_")} if a else a
        return self._open[n]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 unknown) and count of each token."""
        keys, back = np.unique(h, return_inverse=True)
        rows = self.words.find(keys)
        known = np.flatnonzero(rows >= 0)
        n = np.zeros(len(keys), np.int64)
        n[known] = self.words.take(rows[known], "n")
        return rows[back], n[back]

    def log_word(self, n: np.ndarray) -> np.ndarray:
        """log10 of a word's own probability, half a count added to every word and to one more."""
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))

    def left_over(self, context: np.ndarray) -> np.ndarray:
        """Weight that the pairs of a context leave to words' own probabilities; 1 for a context never seen."""
        own, back = np.unique(context, return_inverse=True)
        out = np.ones(len(own))
        real = np.flatnonzero(own >= 0)
        rows = self.left.find(own[real].astype(np.uint64))
        real, rows = real[rows >= 0], rows[rows >= 0]
        out[real] = DISCOUNT * self.left.take(rows, "n") / self.times(own[real])
        return out[back]

    def times(self, context: np.ndarray) -> np.ndarray:
        """How often each context, a sorted word id or BEGIN, occurs."""
        out = np.full(len(context), self.texts, np.int64)
        real = context < NOTHING
        out[real] = self.words.take(context[real], "n")
        return out


def quantise(x: np.ndarray, bits: int) -> np.ndarray:
    top = (1 << bits) - 1
    return np.clip(np.round(x / LOWEST * top), 0, top).astype(np.uint8 if bits == 8 else np.uint16)


def restore(code: np.ndarray, bits: int) -> np.ndarray:
    return 10.0 ** (code * (LOWEST / ((1 << bits) - 1)))


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Id of the token before each one, BEGIN at a row's start."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[at[:-1]] = BEGIN
    return out


def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return (tv.mix(pair) % np.uint64(shards)).astype(np.int64)


def _level(context: np.ndarray, word: np.ndarray, contexts_: int) -> dict[str, np.ndarray]:
    """One Elias-Fano sequence of the successors of contexts 0 .. contexts_ - 1 and the pointers of their first ones."""
    span = int(word.max()) + 1 if len(word) else 1
    first = np.searchsorted(context, np.arange(contexts_ + 1))
    successors = encode(context.astype(np.uint64) * np.uint64(span) + word.astype(np.uint64), contexts_ * span)
    pointers = encode(first.astype(np.uint64), len(word) + 1)
    return {f"s_{k}": v for k, v in successors.items()} | {f"p_{k}": v for k, v in pointers.items()} | {"span": np.array([span], np.int64)}


class Level:
    def __init__(self, a: dict[str, np.ndarray], prefix: str):
        own = {k.removeprefix(prefix): v for k, v in a.items() if k.startswith(prefix)}
        self.successors, self.pointers, self.span = EliasFano(own, "s_"), EliasFano(own, "p_"), int(own["span"][0])

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each successor of a context, -1 where it has no such one."""
        out = np.full(len(context), -1, np.int64)
        ok = np.flatnonzero(word < self.span)
        want = context[ok].astype(np.uint64) * np.uint64(self.span) + word[ok].astype(np.uint64)
        at = self.successors.successor(want)
        inside = np.flatnonzero(at < self.pointers.access(context[ok] + 1).astype(np.int64))
        hit = inside[self.successors.access(at[inside]) == want[inside]]
        out[ok[hit]] = at[hit]
        return out


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(pair: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Triples in order as compressed bytes: steps between contexts, words, successors and counts, byte planes apart."""
    context = (pair >> np.uint64(32)).astype(np.uint32)
    columns = (np.diff(context, prepend=np.uint32(0)).astype(np.uint32), pair.astype(np.uint32), word.astype(np.uint32), np.minimum(n, 0xFFFFFFFF).astype(np.uint32))
    planes = np.concatenate([np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).ravel() for x in columns])
    return len(pair).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(blob[8:], decompressed_size=16 * size, asbytes=True), np.uint8).reshape(4, 4, size)
    step, low, word, n = (np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in planes)
    return (np.cumsum(step, dtype=np.uint64) << np.uint64(32)) | low, word.astype(np.uint64), n.astype(np.int64)


def summed(pair: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples in order with their sums, of sorted runs one after the other."""
    if not len(pair):
        return pair, word, n
    order = np.argsort(pair, kind="stable")
    pair, word, n = pair[order], word[order], n[order]
    rank = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]])).astype(np.uint64)
    key = (rank << np.uint64(32)) | word
    order = np.argsort(key, kind="stable")
    key, pair, word, n = key[order], pair[order], word[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return pair[at], word[at], np.add.reduceat(n, at)


def _shard_arrays(model: Model, pair: np.ndarray, word: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Levels 2 and 3 of sorted distinct triples."""
    own, first = np.unique(pair, return_index=True)
    times = np.add.reduceat(n, first)
    rank = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(pair))))
    context, c_rank = np.unique(own >> np.uint64(32), return_inverse=True)
    share = np.log10((times - DISCOUNT) / model.times(context.astype(np.int64))[c_rank])
    three = np.log10((n - DISCOUNT) / times[rank])
    rest = np.log10(DISCOUNT * np.diff(np.append(first, len(pair))) / times)
    q = lambda x: quantise(x, model.bits)
    out = {f"a_{k}": v for k, v in _level(c_rank, own & np.uint64(0xFFFFFFFF), len(context)).items()}
    out |= {f"b_{k}": v for k, v in _level(rank, word, len(own)).items()}
    return out | {"context": context.astype(np.uint32), "pairs": q(share), "rest": q(rest), "triples": q(three)}


def fit(docs: DataFrame, bits: int = BITS) -> Model:
    """Count docs (text) and build all levels."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    words = write_sorted(counts, "h", None, "lm-words", HASHES)
    total = sum(int(words.arrays(n)["n"].sum()) for n in range(len(words.shards)))
    texts = int(words.take(np.maximum(words.find(np.array([END])), 0), "n")[0]) if total else 0
    words._open.clear()
    model = Model(words, None, [], total, texts, bits)
    if not total:
        return model
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "lm-trie")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in tv.rows(batches, ["text"]):
            for _, _, data, offs in tv.blocks(tv.as_string_array(text), BLOCK):
                h, at = tokens(data, offs)
                ids, _ = model.lookup(h)
                pair = pair_keys(contexts(ids, at), ids)
                after = np.append(ids[1:], NOTHING)
                after[at[1:] - 1] = NOTHING
                own, back = np.unique(pair, return_inverse=True)
                triple, n = np.unique((back.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64), return_counts=True)
                pair, after = own[triple >> np.uint64(32)], triple & np.uint64(0xFFFFFFFF)
                shard = shard_of(pair, shards)
                order = np.argsort(shard, kind="stable")
                pair, after, n = pair[order], after[order], n[order]
                some, first = np.unique(shard[order], return_index=True)
                ends = np.append(first[1:], len(pair))
                for i in range(0, len(some), 256):
                    blobs = [pack(pair[a:b], after[a:b], n[a:b]) for a, b in zip(first[i : i + 256].tolist(), ends[i : i + 256].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 256].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "triples"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held, number = [], 0, None
        for shard, blobs in tv.rows(batches, ["shard", "triples"]):
            number = shard[0].as_py()
            for blob in blobs.to_pylist():
                got.append(unpack(blob))
                held += len(got[-1][0])
            if held > 2 * HELD and len(got) > 1:  # keep the sum, not all runs
                got = [summed(*(np.concatenate(x) for x in zip(*got)))]
                held = 0
        if got:
            path, layout = write_arrays(folder, _shard_arrays(model, *summed(*(np.concatenate(x) for x in zip(*got)))))
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": path, "layout": [{"name": a, "dtype": b, "at": c, "n": d} for a, b, c, d in layout]}], _REPORT)

    dealt = docs.select("text").mapInArrow(count, "shard int, triples binary").repartitionById(shards, "shard")
    schema = "shard int, path string, layout array<struct<name:string,dtype:string,at:long,n:long>>"
    found = {r["shard"]: (r["path"], [tuple(x) for x in r["layout"]]) for r in dealt.mapInArrow(build, schema).collect()}
    model.trie = [found.get(n, ("", [])) for n in range(shards)]

    def successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,) in tv.rows(batches, ["id"]):
            for n in number.to_pylist():
                if a := model.shard(n):
                    first = a["two"].pointers.access(np.arange(len(a["context"]) + 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a["context"].astype(np.int64)), pa.array(np.diff(first))], ["c", "n"])

    per = spark.range(0, shards, 1, shards).mapInArrow(successors, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    model.left = write_sorted(per, "c", None, "lm-left")
    return model


_REPORT = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("layout", pa.list_(pa.struct([("name", pa.string()), ("dtype", pa.string()), ("at", pa.int64()), ("n", pa.int64())])))])


def probabilities(model: Model, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of each token after the two before it in its row."""
    own = 10.0 ** model.log_word(n)
    if model.left is None:
        return own
    before = contexts(ids, at)
    known = np.flatnonzero((before >= 0) & (ids >= 0))
    key, back = np.unique(pair_keys(before[known], ids[known]), return_inverse=True)
    share, rest = np.zeros(len(key)), np.ones(len(key))
    # The pair before each token's own, as an index into key; -1 where there is none.
    index = np.full(len(ids), -1, np.int64)
    index[known] = back
    previous = np.full(len(ids), -1, np.int64)
    previous[1:] = index[:-1]
    previous[at[:-1]] = -1
    asks = np.flatnonzero((previous >= 0) & (ids >= 0))
    triple, again = np.unique((previous[asks].astype(np.uint64) << np.uint64(32)) | ids[asks].astype(np.uint64), return_inverse=True)
    third = np.zeros(len(triple))
    t_pair, t_word = (triple >> np.uint64(32)).astype(np.int64), triple & np.uint64(0xFFFFFFFF)
    shard = shard_of(key, len(model.trie))
    order = np.argsort(shard, kind="stable")
    t_order = np.argsort(shard[t_pair], kind="stable")
    cut, t_cut = (np.searchsorted(x, np.arange(len(model.trie) + 1)) for x in (shard[order], shard[t_pair][t_order]))
    place = np.full(len(key), -1, np.int64)
    for s in range(len(model.trie)):
        mine = order[cut[s] : cut[s + 1]]
        if not len(mine) or not (a := model.shard(s)):
            continue
        context, word = (key[mine] >> np.uint64(32)).astype(np.uint32), key[mine] & np.uint64(0xFFFFFFFF)
        rank = np.minimum(np.searchsorted(a["context"], context), len(a["context"]) - 1)
        ok = np.flatnonzero(a["context"][rank] == context)
        found = a["two"].find(rank[ok], word[ok])
        ok, found = mine[ok[found >= 0]], found[found >= 0]
        place[ok] = found
        share[ok], rest[ok] = restore(a["pairs"][found], model.bits), restore(a["rest"][found], model.bits)
        mine = t_order[t_cut[s] : t_cut[s + 1]]
        mine = mine[place[t_pair[mine]] >= 0]
        if len(mine):
            found = a["three"].find(place[t_pair[mine]], t_word[mine])
            third[mine[found >= 0]] = restore(a["triples"][found[found >= 0]], model.bits)
    two = np.zeros(len(ids))
    two[known] = share[back]
    two += model.left_over(before) * own
    weight, three = np.ones(len(ids)), np.zeros(len(ids))
    seen = previous >= 0
    weight[seen] = np.where(place[previous[seen]] >= 0, rest[previous[seen]], 1.0)
    three[asks] = third[again]
    return three + weight * two


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
            out: list[list[np.ndarray]] = []
            for _, _, data, offs in tv.blocks(tv.as_string_array(text), BLOCK):
                h, at = tokens(data, offs)
                ids, n = model.lookup(h)
                own, log_p = model.log_word(n), np.log10(probabilities(model, ids, n, at))
                out.append([np.diff(at), np.add.reduceat((n > 0).astype(np.int64), at[:-1]), np.add.reduceat(own, at[:-1]), np.add.reduceat(log_p, at[:-1])])
            yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(np.concatenate([x[k] for x in out])) for k in range(4))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
