"""Quality rules: word, line and repetition counts, and a hashed n-gram log-likelihood ratio.

The method compares two multinomials over hashed word 1-grams and 2-grams: one of trusted documents
(the target), one of the whole raw corpus. The target's share of a bucket is shrunk towards the raw
one, the more the fewer trusted n-grams there are. A document's score is the mean over its n-grams of
log(p_target / p_raw), with a trusted document's own n-grams left out of the target, so that it is
judged as all others are. The threshold is a fixed low quantile of the trusted documents' own scores. All of
it is built-in column functions; the corpus is never shuffled, only the bucket counts are.

Defined cases: a null or blank text has no words, zero counts, a null score, and fails the base
rules. A document without n-grams is not kept. Repeated rows are judged alike, each on its own.
Labels with a null id or quality are ignored; an id with both good and bad labels is not trusted.
With no trusted document every score is 0 and the threshold too. Columns other than id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, materialize, words_of

#: Hash buckets of the two multinomials; the model is one array of so many doubles.
BUCKETS = 1 << 16
#: Added to each bucket's raw count.
SMOOTHING = 1.0
#: N-grams of the raw distribution that the target is mixed with.
PRIOR = 65_536.0
#: Share of trusted documents that lies under the threshold.
BELOW = 0.02
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: A line with a word in it; the possessive run keeps blank lines linear.
LINE = r"(?md)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*"


def _size(a: Column) -> Column:
    return F.size(a)


def _shifted(a: Column, by: int) -> Column:
    """Hash of each element with the one by places on."""
    n = F.greatest(_size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + by), n), lambda x, y: F.xxhash64(x, y))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _covered(windows: Column, width: int) -> Column:
    """Words inside windows that occur twice or more: positions of equal neighbours in the sorted array, then the union of their spans."""

    def spans(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(_size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(width), b - a))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def repeated(s: Column) -> Column:
        marks = F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["w"] == e["w"]) | (F.get(s, i + 1)["w"] == e["w"]), e["i"]))
        return let(F.sort_array(F.filter(marks, lambda x: x.isNotNull())), spans)

    placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.when(_size(windows) == _size(F.array_distinct(windows)), F.lit(0)).otherwise(let(F.sort_array(placed), repeated))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and never bad."""
    good = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
        .filter("q = 1 AND t = 0")
    )
    return good.select("doc_id")


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target, raw_total, target_total) for every bucket: n-grams of the corpus and of the trusted documents.

    docs has doc_id and text; of trusted only the ids are broadcast, so that texts are not shuffled.
    """
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    hashed = flagged.select("good", word_hashes(F.col("text")).alias("h1"))
    grams = hashed.select("good", F.explode(F.concat("h1", _shifted(F.col("h1"), 1))).alias("h"))
    counts = grams.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    every = materialize(every, "ratio-counts")
    sums = every.select(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    return every.select("bucket", "raw", "target", F.lit(sums["r"]).alias("raw_total"), F.lit(sums["t"]).alias("target_total"))


def _weights(ratio: DataFrame, buckets: int, smoothing: float, prior: float) -> DataFrame:
    """ratio with p, a bucket's raw share, and weight, its log ratio."""
    p = (F.col("raw") + smoothing) / (F.col("raw_total") + smoothing * buckets)
    weight = F.when(F.col("target_total") > 0, F.log((F.col("target") + prior * F.col("p")) / ((F.col("target_total") + prior) * F.col("p")))).otherwise(0.0)
    return ratio.withColumn("p", p).withColumn("weight", weight)


def trusted_scores(docs: DataFrame, ratio: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, prior: float = PRIOR) -> DataFrame:
    """(doc_id, text_hash, own_score) of the trusted documents with n-grams, each without its own n-grams in the target."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.join(F.broadcast(trusted.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.xxhash64(text).alias("text_hash"), word_hashes(F.col("text")).alias("h1"))
    rows = rows.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.concat("h1", _shifted(F.col("h1"), 1)).alias("grams"))
    each = rows.select("doc_id", "text_hash", F.size("grams").alias("size"), F.explode("grams").alias("h"))
    each = each.groupBy("doc_id", "text_hash", "size", F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    joined = each.join(F.broadcast(_weights(ratio, buckets, smoothing, prior)), "bucket")
    others = F.col("target_total") - F.col("size")
    part = F.when(others > 0, F.col("c") * F.log((F.col("target") - F.col("c") + prior * F.col("p")) / ((others + prior) * F.col("p")))).otherwise(0.0)
    found = joined.groupBy("doc_id", "text_hash", "size").agg(F.sum(part).alias("sum"))
    return materialize(found.select("doc_id", "text_hash", (F.col("sum") / F.col("size")).alias("own_score")), "trusted-scores")


def threshold_of(scores: DataFrame, below: float = BELOW) -> float:
    """The score that a share below of the trusted documents does not reach; 0 without any."""
    return scores.agg(F.percentile("own_score", F.lit(below))).first()[0] or 0.0


def quality_rules(
    docs: DataFrame,
    ratio: DataFrame,
    scores: DataFrame,
    threshold: float,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    prior: float = PRIOR,
) -> DataFrame:
    """Counts, score and verdict of every row of docs (doc_id, text), by fit_ratio(), trusted_scores() and a threshold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", text.alias("text"), F.transform(words_of(F.col("text")), lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).alias("n"))).alias("w"))
    lines = F.regexp_extract_all("text", F.lit(LINE), F.lit(0))
    two = one.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (_size(x) - _size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("word_chars"),
        F.transform("w", lambda x: x["h"]).alias("h1"),
    )
    three = two.select("*", _shifted(F.col("h1"), 1).alias("h2"))

    def eights(h4: Column) -> Column:
        return let(_shifted(h4, 4), lambda h8: _covered(h8, WINDOW))

    four = three.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "text_hash",
        _size("h1").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        let(_shifted(F.col("h2"), 2), eights).cast("long").alias("n_repeat_words"),
        F.concat("h1", "h2").alias("grams"),
    )
    own = [c for c in four.columns if c != "grams"]
    # One row per n-gram, looked up in the fixed-size table of weights and summed again before the shuffle.
    each = four.select(*own, F.explode_outer("grams").alias("h")).select(*own, F.pmod("h", F.lit(buckets)).alias("bucket"))
    scored = each.join(F.broadcast(_weights(ratio, buckets, smoothing, prior).select("bucket", "weight")), "bucket", "left").groupBy(*own).agg(F.avg("weight").alias("score"))
    scored = scored.join(scores, ["doc_id", "text_hash"], "left").withColumn("score", F.coalesce("own_score", "score")).drop("row", "text_hash", "own_score")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = scored.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
