"""Queries of the dated filters and version chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as op
from ..sources import driver_tables as T
from .entities import CA, CARD_DAY, DAY, EV

QUERIES, ORACLES = {}, {}


def _text(*names: str):
    return [F.col(n).cast("string").alias(n) for n in names]


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


#: Ids that may be missing are shown as text, empty where there is none, so that both engines give one type.
_VERSION_SQL = "coalesce(CAST(version_of AS VARCHAR), '') AS version_of"
_EVENT_SQL = "id, type, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_updated AS VARCHAR) AS last_updated, " + _VERSION_SQL


def _version():
    return F.coalesce(F.col("version_of").cast("string"), F.lit("")).alias("version_of")


def _events(df):
    return df.select("id", "type", *_text("valid_from", "valid_to", "first_seen", "last_updated"), _version())


def _cards(df):
    return df.select("id", "role", "notice_kind", *_text("posted_date", "valid_from", "valid_to", "effective_date"))


_CARD_SQL = "id, role, notice_kind, CAST(posted_date AS VARCHAR) AS posted_date, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, CAST(effective_date AS VARCHAR) AS effective_date"
_ACTIVE = "(valid_from IS NULL OR valid_from <= DATE '{d}') AND (valid_to IS NULL OR valid_to >= DATE '{d}')"
_OBSERVABLE = f"posted_date <= DATE '{CARD_DAY}' AND (effective_date IS NULL OR effective_date <= DATE '{CARD_DAY}') AND ((valid_from IS NULL AND valid_to IS NULL) OR ({_ACTIVE.format(d=CARD_DAY)}))"

for _name, _op, _where in (
    ("expiring_on", op.expiring_on, f"valid_to = DATE '{DAY}'"),
    ("active_on", op.active_on, _ACTIVE.format(d=DAY)),
    ("new_since", op.new_since, f"first_seen BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}'"),
    ("updated_since", op.updated_since, f"last_updated BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}' AND version_of IS NOT NULL"),
):
    _add(_name, lambda spark, d, f=_op: _events(f(T.events(spark, d), DAY)), f"WITH {EV} SELECT {_EVENT_SQL} FROM ev WHERE {_where}")

for _name, _op, _where in (
    ("effective_on", op.effective_on, f"coalesce(effective_date, posted_date) <= DATE '{CARD_DAY}'"),
    ("window_around", op.window_around, f"posted_date BETWEEN DATE '{CARD_DAY}' - 45 AND DATE '{CARD_DAY}'"),
    ("observable_on", op.observable_on, _OBSERVABLE),
    ("active_on_cards", op.active_on, _ACTIVE.format(d=CARD_DAY)),
):
    _add(_name, lambda spark, d, f=_op: _cards(f(T.cards(spark, d), CARD_DAY)), f"WITH {CA} SELECT {_CARD_SQL} FROM ca WHERE {_where}")

_add("posted_between", lambda spark, d: _cards(op.posted_between(T.cards(spark, d), "2024-02-01", "2024-02-29")), f"WITH {CA} SELECT {_CARD_SQL} FROM ca WHERE posted_date BETWEEN DATE '2024-02-01' AND DATE '2024-02-29'")
_add("filter_by_notice_kind", lambda spark, d: _cards(op.of_kinds(T.cards(spark, d), "정책", "공지")), f"WITH {CA} SELECT {_CARD_SQL} FROM ca WHERE notice_kind IN ('정책', '공지')")


def _active_multi_window(spark, d):
    """Orders with a window per shipment."""
    ship = F.to_date("l_shipdate")
    windows = T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(ship.alias("from"), F.date_add(ship, F.col("l_linenumber") * 3).alias("to")))).alias("event_windows"), F.min(ship).alias("valid_from"), F.max(ship).alias("valid_to")
    )
    return op.active_on(windows, DAY, "event_windows").select(F.col("l_orderkey").alias("id"), F.size("event_windows").alias("n_windows"))


_add(
    "active_on_multi_window",
    _active_multi_window,
    f"SELECT l_orderkey AS id, CAST(count(*) AS INTEGER) AS n_windows FROM lineitem GROUP BY 1 HAVING bool_or(CAST(l_shipdate AS DATE) <= DATE '{DAY}' AND CAST(l_shipdate AS DATE) + CAST(l_linenumber * 3 AS INTEGER) >= DATE '{DAY}')",
)
_add("resolve_current", lambda spark, d: op.resolve_current(T.events(spark, d)).select("id", _version()), f"WITH {EV} SELECT id, {_VERSION_SQL} FROM ev WHERE id NOT IN (SELECT version_of FROM ev WHERE version_of IS NOT NULL)")
_add(
    "policy_change_pairs",
    lambda spark, d: op.policy_change_pairs(T.events(spark, d), DAY),
    f"WITH {EV} SELECT n.id AS new_id, n.title AS new_title, o.id AS old_id, o.title AS old_title FROM ev n LEFT JOIN ev o ON n.version_of = o.id WHERE n.version_of IS NOT NULL AND n.last_updated BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}'",
)
_add("version_pairs", lambda spark, d: op.version_pairs(T.events(spark, d)), f"WITH {EV} SELECT n.id AS new_id, n.title AS new_title, o.id AS old_id, o.title AS old_title FROM ev n LEFT JOIN ev o ON n.version_of = o.id WHERE n.version_of IS NOT NULL")
_add(
    "link_card_versions",
    lambda spark, d: op.link_card_versions(T.cards(spark, d)).select("id", "topic_key", _version()),
    f"WITH {CA} SELECT id, topic_key, coalesce(CAST(CASE WHEN topic_key IS NOT NULL THEN lag(id) OVER (PARTITION BY topic_key, role ORDER BY coalesce(effective_date, valid_from, posted_date) NULLS FIRST, posted_date NULLS FIRST, ord) END AS VARCHAR), '') AS version_of FROM ca",
)


def _link_policy(spark, d):
    events = T.events(spark, d)
    return op.link_policy_versions(events.filter(F.col("first_seen") >= "1998-01-01"), events.filter(F.col("first_seen") < "1998-01-01"))


_add(
    "link_policy_versions",
    _link_policy,
    f"""WITH {EV}, k AS (SELECT id, ord, first_seen, categories[1] AS category, branches[1] AS branch FROM ev WHERE type = '정책'),
m AS (SELECT category, branch, min(ord) AS o FROM k WHERE first_seen < DATE '1998-01-01' GROUP BY 1, 2)
SELECT k.id, m.o AS version_of FROM k JOIN m USING (category, branch) WHERE k.first_seen >= DATE '1998-01-01'""",
)
_add(
    "timeline",
    lambda spark, d: op.timeline(T.events(spark, d)).select("id", F.coalesce("effective_date", "valid_from", "first_seen").cast("string").alias("day")),
    f"WITH {EV} SELECT id, CAST(coalesce(effective_date, valid_from, first_seen) AS VARCHAR) AS day FROM ev",
)
