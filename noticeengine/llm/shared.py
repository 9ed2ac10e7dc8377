"""Small helpers that the operators have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, materialize, release, scratch_path, shared_dir, ship

__all__ = ["SPACES", "WORD", "drop_path", "let", "materialize", "release", "scratch_path", "set_aside", "shared_dir", "ship", "table", "word_count", "words_of"]

#: A word of the contracts: anything between these six white-space bytes.
SPACES = "\x20\x09-\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def set_aside(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], str, Callable[[DataFrame], DataFrame]]:
    """docs under names that no operator uses; these names; the one of text; and the way back to the old ones.

    An operator that carries columns then can't meet one of its own names among them.
    """
    own = tuple(f"__c{i}" for i in range(len(docs.columns)))
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)))

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own)))

    return renamed, own, own[docs.columns.index("text")], back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of words; a null or blank text gives an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
