"""Evaluation of retrieval and answers, failure classes, history, and parse quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalized

LEAST_RATIO, HISTORY_RUNS, SAMPLES = 0.7, 30, 200


def label_stem(label: Column) -> Column:
    """File stem of a source label like `첨부: name.ext · page`."""
    name = F.regexp_replace(F.split_part(F.coalesce(label, F.lit("")), F.lit(" · "), F.lit(1)), "^첨부: ", "")
    return normalized(F.regexp_replace(name, r"\.[^.]*$", ""))


def refs_match(expected: Column, actual: Column) -> Column:
    """Equal, contained in each other, or of one attachment with contained fragments or one sheet's rows."""
    e, a = normalized(expected), normalized(actual)
    within = lambda x, y: F.contains(x, y) | F.contains(y, x)
    att_e, att_a = normalized(F.substring_index(expected, "#", 1)), normalized(F.substring_index(actual, "#", 1))
    frag = lambda r: F.when(F.contains(r, F.lit("#")), F.regexp_replace(r, "^[^#]*#", "")).otherwise("")
    frag_e, frag_a = frag(expected), frag(actual)
    rows = (frag_e.startswith("row:") | frag_a.startswith("row:")) & (F.size(F.split(frag_e, ":")) >= 3) & (F.size(F.split(frag_a, ":")) >= 3) & (normalized(F.split_part(frag_e, F.lit(":"), F.lit(2))) == normalized(F.split_part(frag_a, F.lit(":"), F.lit(2))))
    same = within(att_e, att_a) & ((frag_e == "") | (frag_a == "") | within(normalized(frag_e), normalized(frag_a)) | rows)
    return F.coalesce((expected != "") & (actual != "") & ((expected == actual) | within(e, a) | same), F.lit(False))


def retrieval_checks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, hit1, hit3, attachment): whether the expected post is first or among three, and its attachment among five.

    cases: case_id, post_id, source_ref, source_label, source_type; hits: case_id, rank, post_id, attachment_name, source_ref.
    """
    h = hits.filter("rank <= 5").select("case_id", "rank", F.col("post_id").alias("hit_post"), F.col("attachment_name").alias("hit_attachment"), F.col("source_ref").alias("hit_ref"))
    both = cases.join(h, "case_id", "left")
    same = F.coalesce(F.col("hit_post") == F.col("post_id"), F.lit(False))
    stem = label_stem(F.col("source_label"))
    named = (stem != "") & (F.contains(normalized(F.col("hit_attachment")), stem) | F.contains(normalized(F.col("hit_ref")), stem))
    body = (F.col("source_type") == "body") & (F.col("rank") <= 3) & F.contains("hit_attachment", F.lit("(게시글 본문)"))
    attached = same & (refs_match(F.col("source_ref"), F.col("hit_ref")) | F.coalesce(named, F.lit(False)) | F.coalesce(body, F.lit(False)))
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return both.groupBy("case_id").agg(flag(same & (F.col("rank") == 1)).alias("hit1"), flag(same & (F.col("rank") <= 3)).alias("hit3"), flag(attached).alias("attachment"))


def passes(hit1: Column, attachment: Column, verdict: Column, ratio: Column, least: float = LEAST_RATIO) -> Column:
    judged = (verdict == "skipped") | (verdict == "pass") | ((verdict == "partial") & (ratio >= least))
    return hit1 & attachment & judged


def failure_class(indexed: Column, hit1: Column, hit3: Column, attachment: Column, verdict: Column, ratio: Column) -> Column:
    return (
        F.when(~indexed, "corpus_gap")
        .when(~hit1 & ~hit3, "retrieval_miss")
        .when(~attachment, "attachment_mismatch")
        .when((verdict == "fail") | ((verdict == "partial") & (ratio < LEAST_RATIO)), "answer_quality")
        .when(~hit1, "retrieval_miss")
        .otherwise("unknown")
    )


def rates(results: DataFrame) -> DataFrame:
    """One row of rates over results (hit1, hit3, attachment, passed)."""
    share = lambda c: F.round(F.sum(F.col(c).cast("int")) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias(c)
    return results.agg(F.count(F.lit(1)).alias("n"), *(share(c) for c in ("hit1", "hit3", "attachment", "passed")))


def repeated_failures(failures: DataFrame, least: int = 2) -> DataFrame:
    """(post_id, question_key, runs): failures (run_id, post_id, question) that occur in several runs."""
    key = F.substring("question", 1, 60)
    return failures.groupBy("post_id", key.alias("question_key")).agg(F.countDistinct("run_id").alias("runs")).filter(F.col("runs") >= least)


def history(old: DataFrame, new: DataFrame, runs: int = HISTORY_RUNS) -> DataFrame:
    """The newest runs (run_id, at, ...); a run of new replaces one of its id."""
    every = old.join(new.select("run_id"), "run_id", "left_anti").unionByName(new)
    return every.withColumn("__n", F.row_number().over(W.orderBy(F.col("at").desc(), "run_id"))).filter(F.col("__n") <= runs).drop("__n")


def quality_report(records: DataFrame) -> DataFrame:
    """(dimension, value, n, share) of records (source_type, extraction, review_flag): histograms, and the flagged share of all."""
    each = F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in ("source_type", "extraction", "review_flag"))), F.array("source_type", "extraction", F.coalesce("review_flag", F.lit("none")))))
    counts = records.select(each.alias("dimension", "value")).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    total = records.agg(F.count(F.lit(1)).alias("t"))
    return counts.select("dimension", "value", "n", F.round(F.col("n") / total.select("t").scalar(), 4).alias("share"))


def flagged_samples(records: DataFrame, most: int = SAMPLES) -> DataFrame:
    return records.filter("review_flag IS NOT NULL").orderBy("ord").limit(most)


def list_posts(posts: DataFrame, text: str | None = None, kind: str | None = None, needs_review: bool | None = None) -> DataFrame:
    """Posts whose title or id has the text, with an attachment of the kind, by review state; newest first."""
    out = posts
    if text:
        out = out.filter(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower(F.col("post_id").cast("string")), F.lit(text.lower())))
    if kind:
        out = out.filter(F.array_contains("kinds", kind))
    if needs_review is not None:
        out = out.filter(F.col("needs_review") == needs_review)
    return out.orderBy(F.col("posted_date").desc(), F.col("title").desc())
