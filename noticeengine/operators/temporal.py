"""Filters and version chains over dated rows. All bounds are inclusive days.

Rows need the columns an operator names; a NULL bound of a validity interval is open, other NULL dates
drop the row unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _day(d) -> Column:
    return d if isinstance(d, Column) else F.lit(str(d)).cast("date")


def within(start: Column, end: Column, on: Column) -> Column:
    return (start.isNull() | (start <= on)) & (end.isNull() | (end >= on))


def in_windows(windows: Column, on: Column) -> Column:
    return F.exists(windows, lambda w: (w["from"] <= on) & (w["to"].isNull() | (w["to"] >= on)))


def active_condition(on, windows: Column | None = None) -> Column:
    """Validity on a day; a row with windows is valid in these alone."""
    day = _day(on)
    plain = within(F.col("valid_from"), F.col("valid_to"), day)
    return plain if windows is None else F.when(F.coalesce(F.size(windows), F.lit(0)) > 0, in_windows(windows, day)).otherwise(plain)


def observable_condition(on, windows: Column | None = None) -> Column:
    """Posted and effective by a day (or undated), and active on it if it has validity at all."""
    day = _day(on)
    dated = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    if windows is not None:
        dated = dated | (F.coalesce(F.size(windows), F.lit(0)) > 0)
    early = (F.col("posted_date").isNull() | (F.col("posted_date") <= day)) & (F.col("effective_date").isNull() | (F.col("effective_date") <= day))
    return early & (~dated | active_condition(day, windows))


def expiring_on(events: DataFrame, as_of) -> DataFrame:
    return events.filter(F.col("valid_to") == _day(as_of))


def active_on(rows: DataFrame, on, windows: str | None = None) -> DataFrame:
    return rows.filter(active_condition(on, F.col(windows) if windows else None))


def new_since(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    return events.filter(F.col("first_seen").between(F.date_sub(_day(as_of), days), _day(as_of)))


def updated_since(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Rows updated in the days before that supersede another."""
    return events.filter(F.col("last_updated").between(F.date_sub(_day(as_of), days), _day(as_of)) & F.col("version_of").isNotNull())


def effective_on(rows: DataFrame, on) -> DataFrame:
    return rows.filter(F.coalesce("effective_date", "posted_date") <= _day(on))


def posted_between(rows: DataFrame, start, end) -> DataFrame:
    return rows.filter(F.col("posted_date").between(_day(start), _day(end)))


def window_around(rows: DataFrame, day, days: int = 45) -> DataFrame:
    """Posted in the days up to day: the window trails."""
    return rows.filter(F.col("posted_date").between(F.date_sub(_day(day), days), _day(day)))


def observable_on(rows: DataFrame, on, windows: str | None = None) -> DataFrame:
    return rows.filter(observable_condition(on, F.col(windows) if windows else None))


def of_kinds(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.filter(F.col("notice_kind").isin(*kinds))


def version_pairs(rows: DataFrame, columns: tuple[str, ...] = ("id", "title")) -> DataFrame:
    """Each superseding row with the one it replaces (NULL where that is gone): new_* and old_* columns."""
    new = rows.filter(F.col("version_of").isNotNull()).select(*(F.col(c).alias(f"new_{c}") for c in columns), F.col("version_of").alias("__old"))
    old = rows.select(*(F.col(c).alias(f"old_{c}") for c in columns), F.col("id").alias("__id"))
    return new.join(old, F.col("__old") == F.col("__id"), "left").drop("__old", "__id")


def policy_change_pairs(events: DataFrame, as_of, days: int = 7, columns: tuple[str, ...] = ("id", "title")) -> DataFrame:
    """version_pairs of the rows updated lately."""
    new = updated_since(events, as_of, days).select(*(F.col(c).alias(f"new_{c}") for c in columns), F.col("version_of").alias("__old"))
    old = events.select(*(F.col(c).alias(f"old_{c}") for c in columns), F.col("id").alias("__id"))
    return new.join(old, F.col("__old") == F.col("__id"), "left").drop("__old", "__id")


def resolve_current(events: DataFrame) -> DataFrame:
    """Rows that no other supersedes."""
    replaced = events.filter(F.col("version_of").isNotNull()).select(F.col("version_of").alias("__replaced"))
    return events.join(replaced, F.col("id") == F.col("__replaced"), "left_anti")


def link_policy_versions(new: DataFrame, existing: DataFrame, latest: bool = False) -> DataFrame:
    """(id, version_of): for each policy the first earlier policy, by ord, with a category and a branch in common.

    latest takes the last instead. Both sides are exploded to (category, branch) keys, so the match is
    an equi-join; each key's best and second best existing rows are all that can be chosen, which keeps
    a frequent key from being paired with every row.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.filter(F.col("type") == "정책").select("id", "ord", F.explode("categories").alias("category"), "branches").select("id", "ord", "category", F.explode("branches").alias("branch")).distinct()

    order = F.col("ord").desc() if latest else F.col("ord").asc()
    ranked = keyed(existing).withColumn("n", F.row_number().over(W.partitionBy("category", "branch").orderBy(order, "id"))).filter("n <= 2")
    prior = ranked.select("category", "branch", F.col("id").alias("old_id"), F.col("ord").alias("old_ord"))
    pairs = keyed(new).join(prior, ["category", "branch"]).filter("id <> old_id")
    pick = F.max_by if latest else F.min_by
    return pairs.groupBy("id").agg(pick("old_id", "old_ord").alias("version_of"))


def link_card_versions(cards: DataFrame, role_scoped: bool = True) -> DataFrame:
    """version_of filled with the card before it in its topic (and role), by the card's date, posting date and ord."""
    date = F.coalesce("effective_date", "valid_from", "posted_date")
    keys = ["topic_key", "role"] if role_scoped else ["topic_key"]
    before = F.lag("id").over(W.partitionBy(*keys).orderBy(date.asc_nulls_first(), F.col("posted_date").asc_nulls_first(), "ord"))
    return cards.withColumn("version_of", F.coalesce("version_of", F.when(F.col("topic_key").isNotNull(), before)))


def timeline(events: DataFrame) -> DataFrame:
    """Oldest first, undated rows before all."""
    return events.orderBy(F.coalesce("effective_date", "valid_from", "first_seen").asc_nulls_first(), "ord")
