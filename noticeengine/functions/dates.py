"""Dates in Korean notices: validity ranges, effective dates, kinds and topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import digest_id
from .text import attachment_stem

# Date formats.
_DAY = r"(20\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})"
_TO = r"\s*[~\-–]\s*"
ISO_RANGE = _DAY + _TO + _DAY
MONTH_DAY_RANGE = r"(\d{1,2})/(\d{1,2})" + _TO + r"(\d{1,2})/(\d{1,2})"
SHORT_RANGE = r"(\d{1,2})/(\d{1,2})" + _TO + r"(\d{1,2})(?!\d|/)"
FROM_DAY = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일(?:부터|부|부터\s*적용|부\s*변경|부터\s*시행)"
LABELLED = [r"시행(?:일)?\s*[:：]?\s*" + _DAY, r"적용(?:일)?\s*[:：]?\s*" + _DAY]
MONTH_DAY = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
EFFECTIVE_WORDS = ["시행", "적용", "변경", "개정"]
# Words of each kind of notice, first match counts.
KIND_WORDS = [
    ("정책", ["정책", "개정", "시행", "변경 안내", "변경의 건", "변경", "서비스 안내", "조립 서비스"]),
    ("판촉", ["판촉", "특가", "할인", "행사", "중점 행사"]),
    ("재고·가격", ["재고", "소진", "입고", "품절"]),
    ("이벤트", ["이벤트", "시연", "페스티벌"]),
    ("공지", ["공지", "안내", "교육"]),
]
UNKNOWN_KIND = "기타"
# Names of columns that hold date windows.
DATE_COLUMNS = ["행사날짜", "행사기간", "적용기간", "판촉기간", "이벤트기간", "프로모션기간", "기간"]
WINDOW = "struct<from:date,to:date>"


def _date(y: Column, m: Column, d: Column) -> Column:
    """NULL for a day that the calendar doesn't have."""
    return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")


def _window(start: Column, end: Column) -> Column:
    return F.struct(start.alias("from"), end.alias("to"))


def validity_range(text: Column, year: Column) -> Column:
    """struct(from, to): the first full range of both days valid, by format; else a single day, open-ended; else NULL."""
    y = year.cast("string")

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    ranges = [
        (_date(*(part(ISO_RANGE, i) for i in (1, 2, 3))), _date(*(part(ISO_RANGE, i) for i in (4, 5, 6)))),
        (_date(y, part(MONTH_DAY_RANGE, 1), part(MONTH_DAY_RANGE, 2)), _date(y, part(MONTH_DAY_RANGE, 3), part(MONTH_DAY_RANGE, 4))),
        (_date(y, part(SHORT_RANGE, 1), part(SHORT_RANGE, 2)), _date(y, part(SHORT_RANGE, 1), part(SHORT_RANGE, 3))),
    ]
    found = [F.when(a.isNotNull() & b.isNotNull(), _window(a, b)) for a, b in ranges]
    single = _date(*(part(_DAY, i) for i in (1, 2, 3)))
    return F.coalesce(*found, F.when(single.isNotNull(), _window(single, F.lit(None).cast("date"))))


def all_validity_ranges(text: Column, year: Column) -> Column:
    """Distinct windows of the parts between commas or semicolons; of the whole text if no part has one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(t, r"[,;]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    each = F.array_distinct(F.filter(F.transform(parts, lambda p: validity_range(p, year)), lambda w: w.isNotNull()))
    whole = validity_range(t, year)
    none = F.array().cast(f"array<{WINDOW}>")
    return F.when(F.size(each) > 0, each).when(whole.isNotNull(), F.array(whole)).otherwise(none)


def effective_date(text: Column, year: Column) -> Column:
    """Day from which a notice applies. The first format that matches decides, even if its day is none of the calendar's."""
    y = year.cast("string")
    out = F.when(text.rlike(FROM_DAY), _date(y, F.regexp_extract(text, FROM_DAY, 1), F.regexp_extract(text, FROM_DAY, 2)))
    for p in LABELLED:
        out = out.when(text.rlike(p), _date(*(F.regexp_extract(text, p, i) for i in (1, 2, 3))))
    named = text.rlike(MONTH_DAY) & text.rlike("|".join(EFFECTIVE_WORDS))
    return out.when(named, _date(y, F.regexp_extract(text, MONTH_DAY, 1), F.regexp_extract(text, MONTH_DAY, 2)))


def notice_kind(text: Column, has_end: Column) -> Column:
    out = None
    for kind, own in KIND_WORDS:
        hit = text.rlike("|".join(own))
        hit = hit | has_end if kind == "판촉" else hit
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(UNKNOWN_KIND)


def topic_key(role: Column, attachment: Column, headline: Column, kind: Column) -> Column:
    """Key of a chain of updates; NULL for kinds without chains and where neither file nor headline names it."""
    stem = attachment_stem(attachment)
    stem = F.when(stem != "", stem).otherwise(F.lower(F.substring(F.coalesce(headline, F.lit("")), 1, 80)))
    return F.when(kind.isin("정책", "공지", "판촉") & (stem != ""), digest_id(16, role, kind, stem))


def temporal_meta(title: Column, filename: Column, text: Column, posted: Column, role: Column) -> Column:
    """struct(notice_kind, valid_from, valid_to, effective_date, topic_key)."""
    full = F.array_join(F.filter(F.array(title, filename, text), lambda x: x != ""), "\n")
    year = F.year(posted)
    window = validity_range(full, year)
    kind = notice_kind(full, window["to"].isNotNull())
    effective = F.coalesce(effective_date(full, year), F.when(kind == "정책", posted))
    start = F.coalesce(window["from"], F.when((kind == "판촉") & window["to"].isNotNull(), posted))
    return F.struct(kind.alias("notice_kind"), start.alias("valid_from"), window["to"].alias("valid_to"), effective.alias("effective_date"), topic_key(role, filename, title, kind).alias("topic_key"))


def date_column(columns: Column) -> Column:
    """Place, from 0, of the first column whose name holds a date hint; NULL if none does."""
    hint = "|".join(DATE_COLUMNS)
    at = F.array_position(F.transform(columns, lambda c: F.regexp_replace(c, r"\s+", "").rlike(hint)), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def table_windows(columns: Column, rows: Column, year: Column) -> Column:
    """Distinct windows of a table's date column, by start."""
    at = date_column(columns)
    cells = F.transform(rows, lambda r: F.trim(F.coalesce(F.get(r, at), F.lit(""))))
    told = F.filter(cells, lambda c: ~c.isin("", "-", "—", "N/A"))
    windows = F.array_distinct(F.flatten(F.transform(told, lambda c: all_validity_ranges(c, year))))
    by_start = F.array_sort(windows, lambda a, b: F.when(a["from"] < b["from"], -1).when(a["from"] > b["from"], 1).otherwise(0))
    return F.when(at.isNull(), F.array().cast(f"array<{WINDOW}>")).otherwise(by_start)


def merge_windows(valid_from: Column, valid_to: Column, kind: Column, windows: Column) -> Column:
    """struct(valid_from, valid_to, notice_kind) widened by a table's windows."""
    some = F.size(windows) > 0
    start = F.least(valid_from, F.array_min(F.transform(windows, lambda w: w["from"])))
    end = F.greatest(valid_to, F.array_max(F.transform(windows, lambda w: w["to"])))
    return F.struct(F.when(some, start).otherwise(valid_from).alias("valid_from"), F.when(some, end).otherwise(valid_to).alias("valid_to"), F.when(some & (kind == UNKNOWN_KIND), "판촉").otherwise(kind).alias("notice_kind"))
