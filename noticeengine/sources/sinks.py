"""Where results go: partitioned snapshots, index tables, exports and reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval

INDEX_VERSION = 2


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_index(cards: DataFrame, path: str) -> None:
    """Postings and statistics of the cards' index texts, blank ones left out, with a version; texts are tokenised once."""
    text, none = retrieval.index_text(), F.array().cast("array<string>")
    absent = {"attachment_name": F.lit(""), "keywords": none, "product_codes": none}
    cards = cards.withColumns({c: v for c, v in absent.items() if c not in cards.columns})
    posted = retrieval.postings(cards.filter(F.trim(text) != ""), text)
    posted.write.mode("overwrite").parquet(f"{path}/postings")
    lengths = cards.sparkSession.read.parquet(f"{path}/postings").select("id", "dl").distinct()
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).withColumn("version", F.lit(INDEX_VERSION))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, stats); an index of another version is refused."""
    stats = spark.read.parquet(f"{path}/stats")
    version = stats.select("version").first()["version"]
    if version != INDEX_VERSION:
        raise ValueError(f"index version {version}, expected {INDEX_VERSION}")
    return spark.read.parquet(f"{path}/postings"), stats


def score_index(postings: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of a saved index for a query's terms, repeats counting."""
    spark = postings.sparkSession
    asked = spark.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)], "term string, times long")
    found = postings.join(asked, "term")
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = found.join(frequency, "term").withColumn("n", stats.select("n").scalar()).withColumn("avgdl", stats.select("avgdl").scalar())
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k1, b = retrieval.K1, retrieval.B
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(part * F.col("times")).alias("score"))


def export_cards(cards: DataFrame, path: str) -> None:
    """JSON lines by role, without tables."""
    cards.drop("tables").write.mode("overwrite").partitionBy("role").json(path)


def event_wiki(events: DataFrame) -> DataFrame:
    """(section, theme, n, events): the events of each section and theme as a JSON array."""
    return events.groupBy("section", "theme").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_list(F.struct("id", "title")))).alias("events"))


def wiki_markdown(events: DataFrame) -> DataFrame:
    """(section, markdown): a section's events by theme, with counts. events: section, theme, id, title, ord."""
    theme = F.coalesce(F.nullif(F.trim("theme"), F.lit("")), F.lit("미분류"))
    lines = events.groupBy("section", theme.alias("theme")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda e: F.concat(F.lit("- "), e["title"])), "\n").alias("items"))
    part = F.concat(F.lit("## "), "theme", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "items")
    parts = lines.groupBy("section").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("theme", part.alias("part")))), lambda p: p["part"]), "\n\n").alias("body"))
    return parts.select("section", F.concat(F.lit("# "), "section", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), "body").alias("markdown"))


def cards_markdown(cards: DataFrame) -> DataFrame:
    """(role, markdown): a role's cards under their posts' titles. cards: role, post_title, headline, ord."""
    posts = cards.groupBy("role", "post_title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "headline"))), lambda c: F.concat(F.lit("- "), c["headline"])), "\n").alias("items"))
    part = F.concat(F.lit("## "), "post_title", F.lit("\n"), "items")
    return posts.groupBy("role").agg(F.concat(F.lit("# "), F.first("role"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_title", part.alias("part")))), lambda p: p["part"]), "\n\n")).alias("markdown"))


def unseen(vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """Names that a vocabulary lacks: what is appended to it."""
    return names.select("category").distinct().join(vocabulary.select("category"), "category", "left_anti")


def brief_html(employee: str, as_of: str, sections: dict[str, list[str]]) -> str:
    """A brief as HTML, all texts escaped."""
    parts = [f"<h1>{html.escape(employee)} — {html.escape(as_of)}</h1>"]
    for title, items in sections.items():
        rows = "".join(f"<li>{html.escape(x)}</li>" for x in items) or "<li>해당 없음</li>"
        parts.append(f"<h2>{html.escape(title)}</h2><ul>{rows}</ul>")
    return "<!doctype html><html><body>" + "".join(parts) + "</body></html>"
