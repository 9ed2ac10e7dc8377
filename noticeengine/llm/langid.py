"""Language identification by nearest centroid.

A text's byte trigrams (A-Z lower-cased, other ASCII that is no letter read as a space) are hashed to
DIMS counts, weighted by log tf and idf, and normalised. Each language has a few centroids, found by
spherical k-means on a bounded sample of labelled rows; a text gets the language of the centroid with
the greatest cosine. A text whose cosine is below its language's rejection distance is marked
`rejected`: it resembles none of the learned languages.

Defined cases: a null text or one without a letter gives `und` with score 0; with no labelled row
every text does. Rows with a null language are not learned from. Repeated rows are predicted alike.
Only doc_id and text are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .sampling import remainder, sample_ids

DIMS = 4096
#: Bounds of the labelled sample: rows of one language, and rows in all.
EACH, TOTAL = 1024, 8192
CENTROIDS = 4
#: A language rejects below this share of the cosine that all but 1 % of its sample reach.
REJECT_SHARE = 0.5

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_LETTER = tv.table_of([*range(65, 91), *range(97, 123)])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language of each centroid
    reject: np.ndarray  # least cosine of each language


def _code(a, b, c):
    return ((a | (b << np.uint32(8)) | (c << np.uint32(16))) * np.uint32(2654435761)) >> np.uint32(20)


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows by DIMS trigram counts; each text is read with a space before and after it."""
    x = _CLEAN[data].astype(np.uint32)
    codes = _code(x[:-2], x[1:-1], x[2:]) if len(x) > 2 else np.zeros(0, np.uint32)
    out = np.zeros((len(offs) - 1, DIMS), np.float32)
    for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        if e - s > 2:
            out[i] = np.bincount(codes[s : e - 2], minlength=DIMS)
    # The first and the last trigram of each text, with the space around it.
    some = np.flatnonzero(np.diff(offs))
    first, size = offs[:-1][some], np.diff(offs)[some]
    space = np.full(len(some), 32, np.uint32)
    if len(some):
        np.add.at(out, (some, _code(space, x[first], np.where(size > 1, x[np.minimum(first + 1, len(x) - 1)], space))), 1)
        more = size > 1
        last = first[more] + size[more]
        np.add.at(out, (some[more], _code(x[last - 2], x[last - 1], space[more])), 1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(tf) * idf)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, lang, text in tv.rows(batches, ["id", "lang", "text"]):
        for i, j, data, offs in tv.blocks(tv.as_string_array(text)):
            for k in range(i, j, 256):
                e = min(k + 256, j)
                tf = counts(data[offs[k - i] : offs[e - i]], offs[k - i : e - i + 1] - offs[k - i])
                r, c = np.nonzero(tf)
                at = np.searchsorted(r, np.arange(e - k + 1)).astype(np.int32)
                lists = lambda v, t: pa.ListArray.from_arrays(pa.array(at), pa.array(v, t))
                yield pa.RecordBatch.from_arrays([ids[k:e], lang[k:e], lists(c.astype(np.int32), pa.int32()), lists(tf[r, c], pa.float32())], ["id", "lang", "dims", "tf"])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with deterministic farthest-first starts."""
    at = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = _unit(np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def fit(docs: DataFrame, each: int = EACH, total: int = TOTAL, k: int = CENTROIDS) -> Model | None:
    """Learn from docs (doc_id, text, lang): a sample of at most each rows of a language, total in all."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = sample_ids(labelled, "lang", each).select("doc_id", F.col("lang").alias("own"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(total)
    rows = labelled.join(F.broadcast(ids), "doc_id").filter(F.col("own") == F.col("lang")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "lang", "text")
    got = rows.mapInArrow(_sample_counts, "id string, lang string, dims array<int>, tf array<float>").toArrow().sort_by([("lang", "ascending"), ("id", "ascending")]).to_pydict()
    if not got["lang"]:
        return None
    tf = np.zeros((len(got["lang"]), DIMS), np.float32)
    for i, (d, v) in enumerate(zip(got["dims"], got["tf"])):
        tf[i, d] = v
    # Rows of a language in an order that the shuffle doesn't decide: by id, and equal ids by their counts.
    hashes = np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in tf], np.uint64)
    rank = np.unique(np.array(got["id"]), return_inverse=True)[1]
    order = np.lexsort((hashes, rank))
    tf, names = tf[order], np.array(got["lang"])[order]
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x, langs = vectors(tf, idf), sorted(set(got["lang"]))
    centroids, owner, reject = [], [], []
    for n, lang in enumerate(langs):
        own = x[names == lang]
        c = cluster(own, k)
        centroids.append(c)
        owner += [n] * len(c)
        reject.append(REJECT_SHARE * float(np.quantile((own @ c.T).max(1), 0.01)))
    return Model(langs, idf, np.concatenate(centroids).astype(np.float32), np.array(owner), np.array(reject))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in tv.rows(batches, ["doc_id", "text"]):
            text = tv.as_string_array(text)
            n = len(text)
            lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            for i, j, data, offs in tv.blocks(text):
                letters = tv.row_sums(_LETTER[data], offs) > 0
                for r in np.flatnonzero(~letters & (tv.row_sums(data >= 128, offs) > 0)):
                    letters[r] = any(map(str.isalpha, text[i + int(r)].as_py()))
                for k in range(0, j - i, 256) if model else ():
                    e = min(k + 256, j - i)
                    cos = vectors(counts(data[offs[k] : offs[e]], offs[k : e + 1] - offs[k]), model.idf) @ model.centroids.T
                    best = model.owner[np.argmax(cos, 1)]
                    top = cos.max(1)
                    ok = letters[k:e]
                    lang[i + k : i + e] = np.where(ok, np.array(model.langs, object)[best], "und")
                    score[i + k : i + e] = np.where(ok, np.clip(top, 0, 1), 0)
                    rejected[i + k : i + e] = ok & (top < model.reject[best])
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", remainder(F.col("doc_id")) == 0)
