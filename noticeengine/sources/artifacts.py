"""The engine's own JSON artefacts read back: wikis of cards and events, graphs, corpora, dated folders and settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import loose
from ..functions import text as tx
from ..session import exists, folders

CARD = "id STRING, role STRING, post_id STRING, post_title STRING, posted_date DATE, source_ref STRING, attachment_name STRING, product_codes ARRAY<STRING>, keywords ARRAY<STRING>, headline STRING, body STRING, temporal STRING"
EVENT = "id STRING, type STRING, title STRING, summary STRING, theme STRING, categories ARRAY<STRING>, branches ARRAY<STRING>, valid_from STRING, valid_to STRING, effective_date STRING, first_seen STRING, last_updated STRING, post_id STRING"
DAYS = ("valid_from", "valid_to", "effective_date", "first_seen", "last_updated")


def _struct(ddl: str) -> str:
    return "STRUCT<" + ", ".join(c.replace(" ", ": ", 1) for c in ddl.split(", ")) + ">"


def cards_of(blocks: DataFrame) -> DataFrame:
    """blocks (sections: role to cards) flattened to cards; null lists hold none."""
    rows = blocks.select(F.explode(F.map_values("sections")).alias("b")).select(F.explode("b.cards").alias("c")).select("c.*")
    empty = F.array().cast("array<string>")
    meta = loose.temporal_from_json(F.col("temporal"))
    return rows.withColumns({"product_codes": F.coalesce("product_codes", empty), "keywords": F.coalesce("keywords", empty), "headline": F.coalesce("headline", F.lit("")), "body": F.coalesce("body", F.lit("")), "temporal": meta})


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a card wiki."""
    schema = f"damdang MAP<STRING, STRUCT<cards: ARRAY<{_struct(CARD)}>>>"
    return cards_of(spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("damdang").alias("sections")))


def events_of(blocks: DataFrame) -> DataFrame:
    """blocks (ord, sections: role to themes to events) flattened; of an id's several places the last counts."""
    roles = blocks.select("ord", F.posexplode(F.map_values("sections")).alias("r", "s"))
    themes = roles.select("ord", "r", F.posexplode(F.map_values("s.themes")).alias("t", "events"))
    rows = themes.select("ord", "r", "t", F.posexplode("events").alias("p", "e")).select("ord", "r", "t", "p", "e.*")
    last = F.row_number().over(W.partitionBy("id").orderBy(*(F.col(c).desc() for c in ("ord", "r", "t", "p"))))
    kept = rows.withColumn("__n", last).filter("__n = 1").drop("__n", "ord", "r", "t", "p")
    return kept.withColumns({c: loose.iso_date(F.col(c)) for c in DAYS})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of an event wiki."""
    schema = f"damdang MAP<STRING, STRUCT<themes: MAP<STRING, ARRAY<{_struct(EVENT)}>>>>"
    return events_of(spark.read.schema(schema).option("multiLine", True).json(path).select(F.lit(0).alias("ord"), F.col("damdang").alias("sections")))


def graph_path(data_dir: str, as_of: str) -> str:
    return f"{data_dir}/kg/{as_of}/graph.json"


def wiki_path(data_dir: str, as_of: str) -> str:
    return f"{data_dir}/llmwiki/{as_of}/llmwiki.json"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, props) and edges (id, type, source, target) of a graph file."""
    schema = "nodes ARRAY<STRUCT<id: STRING, type: STRING, label: STRING, props: STRING>>, edges ARRAY<STRUCT<id: STRING, type: STRING, source: STRING, target: STRING>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return tuple(whole.select(F.explode(c).alias("x")).select("x.*") for c in ("nodes", "edges"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables of a graph as Parquet, by type."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def with_keywords(cards: DataFrame) -> DataFrame:
    """Cards without keywords get those of their title, headline and body."""
    own = F.array_sort(tx.keyword_set(F.concat_ws("\n", "post_title", "headline", "body")))
    return cards.withColumn("keywords", F.when(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0, F.col("keywords")).otherwise(own))


def with_graph_provenance(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cards with the provenance (JSON) that their graph node carries."""
    told = nodes.filter("type = 'WikiCard'").select(F.get_json_object("props", "$.card_id").alias("id"), F.get_json_object("props", "$.provenance").alias("provenance")).filter("id IS NOT NULL AND provenance IS NOT NULL").dropDuplicates(["id"])
    return cards.join(told, "id", "left")


def load_corpus(spark: SparkSession, data_dir: str, as_of: str) -> DataFrame:
    """Cards of a day's wiki with keywords, and provenance where the day has a graph; without a wiki an error."""
    path = wiki_path(data_dir, as_of)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    cards = with_keywords(read_cards(spark, path))
    graph = graph_path(data_dir, as_of)
    if not exists(spark, graph):
        return cards.withColumn("provenance", F.lit(None).cast("string"))
    return with_graph_provenance(cards, read_graph(spark, graph)[0])


def newest(spark: SparkSession, root: str, name: str, as_of: str | None = None) -> str | None:
    """Path of a file of that name: in as_of's folder if it is there, else in the last folder that has it."""
    for day in ([as_of] if as_of else []) + folders(spark, root)[::-1]:
        if exists(spark, f"{root}/{day}/{name}"):
            return f"{root}/{day}/{name}"
    return None


def latest_posts(posts: DataFrame) -> DataFrame:
    """posts (id, folder, ...), one row an id: that of the last folder."""
    n = F.row_number().over(W.partitionBy("id").orderBy(F.col("folder").desc()))
    return posts.withColumn("__n", n).filter("__n = 1").drop("__n")


def load_env(text: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines, without comments and quotes; names that are set already stay."""
    out = dict(os.environ if into is None else into)
    for line in map(str.strip, text.splitlines()):
        key, eq, value = line.partition("=")
        if eq and key.strip() and not line.startswith("#"):
            out.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return out


def load_settings(text: str) -> dict:
    """Settings as YAML where a reader for it is installed, else as JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def role_categories(spark: SparkSession, settings: dict) -> DataFrame:
    """(role, category, is_manager) of a role map: mappings from roles to categories, and managers."""
    managers = set(settings.get("managers", []))
    rows = [(role, c, role in managers) for role, own in settings.get("mappings", {}).items() for c in own]
    return spark.createDataFrame(rows, "role string, category string, is_manager boolean")


def extended_vocabulary(categories: list[str], proposals: list[str]) -> tuple[list[str], list[str]]:
    """The vocabulary with the proposals that it lacks, in their order, and these."""
    added = [p for p in dict.fromkeys(proposals) if p and p not in categories]
    return [*categories, *added], added
