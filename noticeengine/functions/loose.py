"""Tolerant reading of values that models and older files write, and temporal facts to and from JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import UNKNOWN_KIND, WINDOW

# Kinds of notices and modes of time.
KINDS = ["정책", "판촉", "공지", "이벤트", "기타"]
TIME_MODES = ["none", "active_on", "observable_on", "posted_between", "version_diff"]
TEMPORAL = f"struct<notice_kind:string,valid_from:date,valid_to:date,effective_date:date,topic_key:string,version_of:string,event_windows:array<{WINDOW}>>"


def strip_fences(text: Column) -> Column:
    """Without the fence lines around a block; an unfenced text is only trimmed."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    rest = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"(?s)^[^\n]*\n", "")).otherwise(t)
    inner = F.when(F.contains(rest, F.lit("```")), F.regexp_replace(rest, r"(?s)```(?:(?!```).)*$", "")).otherwise(rest)
    return F.when(t.startswith("```"), F.btrim(inner, F.lit(" \t\r\n"))).otherwise(t)


def as_list(value: Column) -> Column:
    """A JSON array's, or a comma-separated text's, trimmed non-empty items."""
    v = F.trim(F.coalesce(value, F.lit("")))
    items = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.split(v, ","))
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def iso_date(value: Column) -> Column:
    """The date that the first ten characters say, or NULL."""
    head = F.substring(F.trim(value), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def time_mode(value: Column) -> Column:
    """A known mode, by name or inside a JSON object; an object with a date from or to asks for active_on; else none."""
    v = F.trim(F.coalesce(value, F.lit("")))
    known = lambda c: F.when(c.isin(*TIME_MODES), c)
    inside = F.coalesce(*(F.get_json_object(v, f"$.{k}") for k in ("time_mode", "mode", "active_on")))
    dated = F.coalesce(F.get_json_object(v, "$.date_from"), F.get_json_object(v, "$.date_to"), F.lit("")) != ""
    nested = F.when(inside.isNotNull(), F.coalesce(known(inside), F.lit("none"))).when(dated, "active_on").otherwise("none")
    return F.when(v.startswith("{"), nested).otherwise(F.coalesce(known(v), F.lit("none")))


def temporal_to_json(meta: Column) -> Column:
    """A temporal struct as JSON with ISO days; absent facts are left out."""
    return F.to_json(meta)


def temporal_from_json(text: Column) -> Column:
    """A temporal struct; an unknown kind becomes the fallback kind, windows without a start are dropped."""
    raw = F.from_json(text, TEMPORAL, {"dateFormat": "yyyy-MM-dd"})
    kind = F.when(raw["notice_kind"].isin(*KINDS), raw["notice_kind"]).otherwise(UNKNOWN_KIND)
    windows = F.filter(F.coalesce(raw["event_windows"], F.array().cast(f"array<{WINDOW}>")), lambda w: w["from"].isNotNull())
    return F.struct(kind.alias("notice_kind"), *(raw[c].alias(c) for c in ("valid_from", "valid_to", "effective_date", "topic_key", "version_of")), windows.alias("event_windows"))
