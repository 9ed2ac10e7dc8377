"""Quality classifier: ordinal cumulative-link regression over hashed text features.

Ratings are ordered grades 0..K. One vector of weights over hashed features is shared by all grades;
ordered thresholds t_1 < ... < t_K give P(grade >= k) = sigmoid(w.x - t_k). The expected grade is the
sum of these, and a document is selected when its tail probability P(grade >= K) is near that of one
without defects.

Weights are never positive: features are defects, so a text without any has the best grade however
short it is, and a long one cannot make up for a defect by its length. Features are the distinct lower-cased words and word starts and, as written, the distinct white-space tokens and
token pairs of the whole text, plus binned shares of capitals, symbols and repeated neighbours.

Defined cases: a null text or one without a word has null grade and probabilities and is not kept;
ratings with a null id, quality or text are ignored; an id with several ratings has its lowest grade;
with no ratings every text with a word is kept. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .sampling import sample_ids

#: Bits of a feature's hash: so many that hardly any feature shares a telling one's.
DIMS_BITS = 30
_QUICK_BITS = 20
#: A feature has a weight if a lower grade's rows have it this many times as often as the others, by so many standard errors, and if so many rows have it.
LEAST_LIFT, LEAST_Z, LEAST_ROWS = 10.0, 6.0, 5
GRADES = 3
#: Sample rows whose feature fingerprints differ in so many of 64 bits or fewer are one.
ALIKE = 8
#: Bound of the rated sample, per grade.
EACH = 1536
#: A document is kept if its tail probability is this share, or more, of a document's without any defect.
KEEP_SHARE = 0.7
#: Words count by their first so many bytes too, which inflected forms share.
PREFIXES = (4, 6)
_UPPER = tv.table_of(range(65, 91))
_SYMBOL = tv.table_of([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes of the features with a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def quick(self) -> np.ndarray:
        """Table by a hash's first bits: whether some feature with a weight may start so."""
        out = np.zeros(1 << _QUICK_BITS, bool)
        out[self.features >> (DIMS_BITS - _QUICK_BITS)] = True
        return out

    def scores(self, h: np.ndarray, row: np.ndarray, n: int, quick: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's distinct features."""
        maybe = quick[h >> (DIMS_BITS - _QUICK_BITS)]
        h, row = h[maybe], row[maybe]
        if not len(h) or not len(self.features):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        hit = self.features[at] == h
        pair = np.unique(row[hit] * len(self.features) + at[hit])
        return np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], minlength=n)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, with repeats, the row of each, and each row's tokens."""
    n = len(offs) - 1
    low = tv.LOWER[data]
    starts, ends, at = tv.spans(tv.IS_ALNUM[low], offs)
    words = np.concatenate([tv.span_hashes(low, starts, np.minimum(ends, starts + k)) for k in PREFIXES] + [tv.span_hashes(low, starts, ends)])
    ts, te, tat = tv.spans(tv.IS_WORD[data], offs)
    tokens = tv.span_hashes(data, ts, te)
    row_w, row_t = tv.row_of(at), tv.row_of(tat)
    inner = row_t[:-1] == row_t[1:] if len(row_t) else np.zeros(0, bool)
    pairs = tv.pair_hashes(tokens[:-1], tokens[1:])[inner] if len(tokens) else tokens
    row_p = row_t[:-1][inner] if len(row_t) else row_t
    same = (tokens[:-1] == tokens[1:])[inner] if len(tokens) else np.zeros(0, bool)
    size = np.maximum(np.diff(offs), 1)
    shares = [tv.row_sums(_UPPER[data], offs) / size, tv.row_sums(_SYMBOL[data], offs) / size, np.bincount(row_p[same], minlength=n) / np.maximum(np.diff(tat), 1)]
    bins = [np.minimum((s * 40).astype(np.uint64), np.uint64(15)) + np.uint64(16 * k + 1) for k, s in enumerate(shares)]
    h = np.concatenate([words, tokens ^ np.uint64(0x5BD1E995), pairs, *(tv.mix(b) for b in bins)])
    row = np.concatenate([*[row_w] * (len(PREFIXES) + 1), row_t, row_p, *([np.arange(n)] * 3)])
    return (h >> np.uint64(64 - DIMS_BITS)).astype(np.int64), row, np.diff(tat)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for grade, text in tv.rows(batches, ["grade", "text"]):
        for i, j, data, offs in tv.blocks(tv.as_string_array(text)):
            h, row, _ = features(data, offs)
            key = np.unique((row << DIMS_BITS) | h)
            at = np.searchsorted(key, np.arange(j - i + 1) << DIMS_BITS)
            f = (key & ((1 << DIMS_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([grade[i:j], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f))], ["grade", "features"])


def fit_ordinal(f: np.ndarray, at: np.ndarray, grade: np.ndarray, grades: int = GRADES, rounds: int = 1000, penalty: float = 3e-4) -> Model:
    """Full-batch Adagrad on the cumulative-link likelihood; rows weigh so that every grade counts alike. Thresholds stay ordered as a first one and positive steps."""
    n, k = len(grade), grades - 1
    row = tv.row_of(at)
    names, f = np.unique(f, return_inverse=True)
    w = np.zeros(len(names))
    everywhere = np.bincount(f, minlength=len(w))
    telling = np.zeros(len(w), bool)
    for g in range(grades - 1):
        own = grade == g
        a, b = max(1, own.sum()), max(1, n - own.sum())
        inside = np.bincount(f[own[row]], minlength=len(w))
        p = everywhere / n
        z = (inside / a - (everywhere - inside) / b) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / a + 1 / b))
        telling |= (z >= LEAST_Z) & (inside / a >= LEAST_LIFT * (everywhere - inside) / b) & (everywhere >= LEAST_ROWS)
    used = telling[f]
    f, row = f[used], row[used]
    first, steps = -1.0, np.zeros(k - 1)
    gw, gt = np.full(len(w), 1e-8), np.full(k, 1e-8)
    share = np.bincount(grade, minlength=grades)
    weight = (n / grades / np.maximum(share, 1))[grade] / n
    for _ in range(rounds):
        t = np.concatenate([[first], first + np.cumsum(np.exp(steps))])
        s = np.bincount(row, w[f], minlength=n)
        c = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40))), np.zeros((n, 1))], 1)
        i = np.arange(n)
        hi, lo = c[i, grade], c[i, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight  # of log p by the two scores
        gs = -(dhi - dlo)
        g = np.bincount(f, gs[row], minlength=len(w)) + penalty / max(1, n) * 100 * w
        up = np.zeros(k + 2)
        np.add.at(up, grade, dhi)
        np.add.at(up, grade + 1, -dlo)
        gthr = up[1 : k + 1]
        tail = np.cumsum(gthr[::-1])[::-1]
        gp = np.concatenate([[tail[0]], tail[1:] * np.exp(steps)])
        gw += g * g
        gt += gp * gp
        w = np.minimum(w - 0.5 * g / np.sqrt(gw), 0)
        step = 0.3 * gp / np.sqrt(gt)
        first -= step[0]
        steps -= step[1:]
    t = np.concatenate([[first], first + np.cumsum(np.exp(steps))])
    own = telling & (w < 0)
    return Model(names[own].astype(np.int64), w[own], t)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels (doc_id, quality, toxic): 0 low quality, 1 toxic, 2 good and clean; the lowest of an id's."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2)
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, rated: DataFrame, each: int = EACH) -> Model | None:
    """Learn from docs (doc_id, text) and rated (doc_id, grade), at most each rows of a grade."""
    ids = sample_ids(rated, "grade", each)
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("grade", "text")
    got = rows.mapInArrow(_sample_features, "grade int, features array<int>").toArrow()
    if not got.num_rows:
        return None
    lists = got.column("features").combine_chunks()
    grade = got.column("grade").to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
    f = lists.flatten().to_numpy()
    order = np.lexsort((np.add.reduceat(f, at[:-1], dtype=np.int64), np.diff(at), grade))  # not the shuffle's
    order = order[_unlike(f, at, order)]  # a text that is copied often teaches once
    f = np.concatenate([f[at[i] : at[i + 1]] for i in order])
    at = np.concatenate([[0], np.cumsum(np.diff(at)[order])])
    return fit_ordinal(f, at, grade[order])


def _unlike(f: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places in order of rows whose features' fingerprint differs from those of all kept rows before; the sample is bounded."""
    half = np.diff(at)[:, None]
    on = tv.bit_counts(tv.mix(f.astype(np.uint64) + np.uint64(1)), at) * 2 > half
    fp = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()[order]
    kept = np.zeros(len(fp), np.uint64)
    n, out = 0, []
    for i, x in enumerate(fp):
        if not n or np.bitwise_count(kept[:n] ^ x).min() > ALIKE:
            kept[n] = x
            n += 1
            out.append(i)
    return np.array(out, np.int64)


def score(docs: DataFrame, model: Model | None, keep_share: float = KEEP_SHARE, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns with expected_grade, tail_prob and kept, for every row of docs; its text may be among the carried columns."""
    extra = (("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("kept", pa.bool_()))

    quick = model.quick() if model else None
    clean = 1 / (1 + np.exp(np.clip(model.thresholds[-1], -40, 40))) if model else 1.0

    at = carry.index(text) if text in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.as_string_array(batch.column(at))
            n = len(texts)
            expected, tail, some = np.zeros(n), np.zeros(n), np.zeros(n, bool)
            for i, j, data, offs in tv.blocks(texts):
                h, row, tokens = features(data, offs)
                some[i:j] = tokens > 0
                if model:
                    s = model.scores(h, row, j - i, quick)
                    c = 1 / (1 + np.exp(-np.clip(s[:, None] - model.thresholds, -40, 40)))
                    expected[i:j], tail[i:j] = c.sum(1), c[:, -1]
                else:
                    expected[i:j], tail[i:j] = GRADES - 1, 1.0
            kept = some & (tail >= keep_share * clean)
            out = [pa.array(expected, mask=~some), pa.array(tail, mask=~some), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(carry))] + out, [*carry, *(x for x, _ in extra)])

    schema = docs.select(*carry).schema.add("expected_grade", "double").add("tail_prob", "double").add("kept", "boolean")
    return docs.select(*carry, *([] if text in carry else [F.col(text).alias("__text")])).mapInArrow(run, schema)
