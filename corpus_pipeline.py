"""A training corpus from documents: select, thin out, protect benchmarks and secrets, and mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written and read again as the next one's docs. All but the last return the columns of documents.

* quality_classifier keeps what the ordinal model, fitted on the labels, does not reject.
* near_duplicates keeps the document with the smallest id of each group that operator 5's fingerprints
  link, and of these the one of each group of near copies by the exact similarity of their shingles.
* decontaminate removes documents with a benchmark window in them.
* secret_scan replaces secrets in texts by a mark and counts n_chars anew; no document goes.
* mix_sources returns each document's share of the mix (doc_id, source, size, target, taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeengine.llm import decontaminate, mixing, near_texts, quality_classifier, secret_scan, simhash
from noticeengine.llm.shared import materialize, set_aside, table
from noticeengine.session import ship


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rated = quality_classifier.grades_of(table(spark, sf_dir, "labels"))
    model = quality_classifier.fit(docs, rated)
    inner, own, text, back = set_aside(docs)
    return back(quality_classifier.score(inner, model, carry=own, text=text).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints link close copies; the exact check that follows finds the copies farther apart that they can't reach."""
    ship(spark)
    first = simhash.near_duplicates(docs).filter("doc_id = component_id").select("doc_id")
    return near_texts.keep_one(materialize(docs.join(first.distinct(), "doc_id", "left_semi").select(docs.columns), "pipeline-fingerprints"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, own, text, back = set_aside(docs)
    return back(decontaminate.find_matches(inner, table(spark, sf_dir, "benchmark"), carry=own, text=text).filter(F.size("spans") == 0))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    hidden = secret_scan.redact(docs, secret_scan.fit(docs))
    if "n_chars" not in hidden.columns:
        return hidden
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", select_quality),
    ("near_duplicates", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("mix_sources", mix),
]

#: The classifier, the fingerprints and the automata have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
