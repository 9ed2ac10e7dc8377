"""Tables in cell grids: rows of strings become regions, headers, records and Markdown.

A region's rows are one array column; rules over rows are array functions of it, so a sheet costs one
row of the plan and nothing leaves the JVM. A grid of loose rows is (sheet, row_no, cells).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lets import let

# Limits and thresholds.
EMPTY_FILL, MAX_HEADER_ROWS, REGION_GAP, MAX_TABLE_ROWS = 0.05, 8, 2, 200
TITLE_MARK = "[▣●◆■]"
NARRATIVE = r"^\s*\d+[\).]\s"
SUMMARY_WORDS = ["합계", "소계", "총계"]
#: Rows of a sheet that a profile reads.
MAX_RECORDS = 250


def cell_text(value: Column) -> Column:
    """Cell as text: missing and nan are empty, whole floats lose their fraction."""
    t = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(t) == "nan", "").otherwise(F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1"))


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: c != "")


def fill_ratio(cells: Column) -> Column:
    return F.coalesce(F.size(filled(cells)) / F.nullif(F.size(cells), F.lit(0)), F.lit(0.0))


def is_number(cell: Column) -> Column:
    return F.trim(F.regexp_replace(cell, "[,%]", "")).try_cast("double").isNotNull()


def numeric_ratio(cells: Column) -> Column:
    own = filled(cells)
    return F.coalesce(F.size(F.filter(own, is_number)) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0))


def is_title(cells: Column) -> Column:
    def test(own: Column) -> Column:
        joined = F.array_join(own, " ")
        return (F.size(own) == 1) | ((F.size(own) == 2) & (joined.rlike(TITLE_MARK) | (F.length(joined) > 28)))

    return let(filled(cells), test)


def is_narrative(cells: Column) -> Column:
    def test(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        return (F.size(own) == 1) & (first.rlike(NARRATIVE) | first.startswith("▶") | first.startswith("-"))

    return let(filled(cells), test)


def is_header_like(cells: Column) -> Column:
    """Titles, narrative rows and single cells are; so are rows with few numbers."""
    return let(filled(cells), lambda own: (F.size(own) > 0) & ((F.size(own) < 2) | is_title(own) | (numeric_ratio(own) < 0.45)))


def is_data_like(cells: Column) -> Column:
    def test(own: Column) -> Column:
        numbers = F.size(F.filter(own, is_number))
        return let(numbers, lambda k: (F.size(own) >= 2) & ((k >= 2) | ((k >= 1) & (F.size(own) >= 3)) | ((k / F.size(own) >= 0.25) & (F.size(own) / F.size(cells) >= 0.12))))

    return let(filled(cells), test)


def split_regions(grid: DataFrame) -> DataFrame:
    """Rows of grid (sheet, row_no, cells) that are not empty, with their region: two empty rows or more end one."""
    order = W.partitionBy("sheet").orderBy("row_no")
    rows = grid.withColumn("__empty", fill_ratio(F.col("cells")) < EMPTY_FILL).withColumn("__n", F.row_number().over(order))
    kept = rows.filter("NOT __empty")
    gap = F.col("__n") - F.coalesce(F.lag("__n").over(order), F.col("__n") - 1) - 1
    return kept.withColumn("region", F.sum(F.when(gap >= REGION_GAP, 1).otherwise(0)).over(order)).drop("__empty", "__n")


def regions(grid: DataFrame) -> DataFrame:
    """(sheet, region, rows): each region's rows in order."""
    rows = split_regions(grid).groupBy("sheet", "region").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    return rows.select("sheet", "region", F.transform("r", lambda x: x["cells"]).alias("rows"))


def _first(rows: Column, test, start: Column) -> Column:
    """Place of the first row from start on that passes; the number of rows if none does."""
    hits = F.transform(rows, lambda r, i: (i >= start) & F.coalesce(test(r), F.lit(False)))
    at = F.array_position(hits, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.size(rows))


def boundaries(rows: Column) -> Column:
    """struct(header_start, header_end, data_start) of a region's rows."""
    n = F.size(rows)
    empty = lambda r: fill_ratio(r) < EMPTY_FILL

    def from_start(start: Column) -> Column:
        ends = lambda r: is_data_like(r) | ~(is_header_like(r) | (fill_ratio(r) < 0.55))
        stop = F.least(n, start + MAX_HEADER_ROWS + 5, _first(rows, ends, start))
        return let(stop, lambda s: let(_first(rows, is_data_like, s), lambda data: whole(start, s, data)))

    def whole(start: Column, stop: Column, data: Column) -> Column:
        told = F.array_max(F.transform(rows, lambda r, i: F.when((i >= stop) & (i < data) & is_narrative(r), i + 1)))
        return F.struct(start.alias("header_start"), F.coalesce(told, stop).alias("header_end"), data.alias("data_start"))

    return let(_first(rows, lambda r: ~(is_title(r) | empty(r)), F.lit(0)), from_start)


def fill_right(cells: Column) -> Column:
    """Empty cells take the last filled one to their left."""
    return F.transform(cells, lambda c, i: F.coalesce(F.try_element_at(F.filter(F.slice(cells, F.lit(1), i + 1), lambda x: x != ""), F.lit(-1)), F.lit("")))


def unique_names(names: Column) -> Column:
    """Blank names become col_i; repeats get a running suffix."""
    base = F.transform(names, lambda n, i: F.when(F.trim(n) != "", F.trim(n)).otherwise(F.concat(F.lit("col_"), i.cast("string"))))

    def numbered(b: Column) -> Column:
        def name(n: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(b, F.lit(1), i), lambda x: x == n))
            return let(before, lambda k: F.when(k > 0, F.concat(n, F.lit("_"), (k + 1).cast("string"))).otherwise(n))

        return F.transform(b, name)

    return let(base, numbered)


def merge_headers(rows: Column) -> Column:
    """Column names of header rows: parts of a column joined, each row filled to the right first."""

    def parts(width: Column, full: Column) -> Column:
        places = F.when(width > 0, F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.array_distinct(F.filter(F.transform(full, lambda r: F.trim(F.get(r, i))), lambda x: x != "")), " / "))

    def padded(width: Column) -> Column:
        return F.transform(rows, lambda r: let(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), fill_right))

    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    names = let(width, lambda w: let(padded(w), lambda full: unique_names(parts(w, full))))
    return F.when(F.size(rows) > 0, names).otherwise(F.array().cast("array<string>"))


def trim_data(rows: Column) -> Column:
    """Data rows up to three empty ones in a row or a later title, without the empty ones."""

    def cut(empty: Column) -> Column:
        third = F.array_position(F.transform(empty, lambda e, i: (i >= 2) & e & F.get(empty, i - 1) & F.get(empty, i - 2)), F.lit(True))
        begun = F.array_position(empty, F.lit(False))
        title = let(begun, lambda b: F.array_position(F.transform(rows, lambda r, i: (b > 0) & (i + 1 > b) & ~F.get(empty, i) & is_title(r)), F.lit(True)))
        end = F.least(*(let(x, lambda p: F.when(p > 0, (p - 1).cast("int")).otherwise(F.size(rows))) for x in (third, title)))
        return F.filter(F.slice(rows, F.lit(1), end), lambda r: fill_ratio(r) >= EMPTY_FILL)

    return let(F.transform(rows, lambda r: fill_ratio(r) < EMPTY_FILL), cut)


def to_width(rows: Column, width: Column) -> Column:
    return F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width))


def _once() -> Column:
    """A column beside costly ones. Filters that use it too are not pushed below them, where they would be written out and evaluated again."""
    return F.monotonically_increasing_id().alias("__once")


def extract_tables(found: DataFrame) -> DataFrame:
    """(sheet, region, title, columns, rows, total_rows, truncated) of regions that hold a table."""
    b = found.select("sheet", "region", "rows", boundaries(F.col("rows")).alias("b"), _once())
    head = F.slice("rows", F.col("b.header_start") + 1, F.greatest(F.col("b.header_end") - F.col("b.header_start"), F.lit(0)))

    def told(r: Column) -> Column:
        return F.when(F.size(r) == 1, F.get(r, F.lit(0))).when(F.array_join(r, " ").rlike(TITLE_MARK) | (F.length(F.array_join(r, " ")) > 20), F.array_join(r, " "))

    before = F.transform(F.slice("rows", F.lit(1), F.col("b.header_start")), lambda r: let(filled(r), told))
    title = F.get(F.filter(before, lambda t: t.isNotNull()), F.lit(0))
    data = F.slice("rows", F.col("b.data_start") + 1, F.greatest(F.size("rows") - F.col("b.data_start"), F.lit(0)))
    t = b.select("sheet", "region", title.alias("title"), let(head, merge_headers).alias("columns"), let(data, trim_data).alias("data"), _once())
    t = t.filter((F.size("data") > 0) & (F.col("__once") >= 0))
    widest = F.array_max(F.transform("data", lambda r: F.size(r)))
    named = F.when(F.size("columns") > 0, F.col("columns")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(widest - 1, F.lit(0))), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    t = t.select("sheet", "region", "title", "data", named.alias("columns"), _once())
    t = t.select("sheet", "region", "title", "data", "columns", to_width(F.slice("data", 1, MAX_TABLE_ROWS), F.size("columns")).alias("rows"), _once())
    meaningful = F.exists("columns", lambda c: ~c.startswith("col_")) | (numeric_ratio(F.get("rows", F.lit(0))) >= 0.1)
    sample = F.filter(F.transform(F.slice("rows", 1, 10), lambda r: F.trim(F.get(r, F.lit(0)))), lambda x: x != "")
    numbered = F.get("columns", F.lit(0)).startswith("col_") & (F.size(sample) > 0) & F.forall(sample, lambda x: x.rlike(r"^\d+$"))
    columns = F.when(numbered, F.concat(F.array(F.lit("No.")), F.slice("columns", F.lit(2), F.size("columns")))).otherwise(F.col("columns"))
    return t.filter(meaningful & (F.col("__once") >= 0)).select("sheet", "region", "title", columns.alias("columns"), "rows", F.size("data").alias("total_rows"), (F.size("data") > MAX_TABLE_ROWS).alias("truncated"))


def to_markdown(sheet: Column, title: Column, columns: Column, rows: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    head = F.concat(F.lit("### 시트: "), sheet, F.coalesce(F.concat(F.lit("\n"), title), F.lit("")))
    return F.array_join(F.concat(F.array(head, line(columns), line(F.transform(columns, lambda c: F.lit("---")))), F.transform(rows, line)), "\n")


def from_markdown(text: Column, limit: int = 50) -> Column:
    """struct(columns, rows) of the first Markdown table: a header, its separator, rows until a line without bars."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    start = F.array_position(F.transform(lines, lambda x: x.startswith("|")), F.lit(True)).cast("int")
    own = F.when(start > 0, F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(own, lambda x: x.startswith("|")), F.lit(False)).cast("int")
    table = F.when(stop > 0, F.slice(own, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(own)
    cells = F.transform(table, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    body = F.filter(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: ~F.forall(r, lambda c: c.rlike("^:?-+:?$")))
    return F.struct(F.coalesce(F.get(cells, F.lit(0)), F.array().cast("array<string>")).alias("columns"), F.slice(body, 1, limit).alias("rows"))


def fill_down(grid: DataFrame, value: str, by: str = "sheet", order: str = "row_no") -> DataFrame:
    """Empty values of a merged column take the last filled one above."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return grid.withColumn(value, F.coalesce(F.last(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def record_body(columns: Column, cells: Column, most: int = 16, length: int = 800) -> Column:
    """`name: value | ...` of filled cells; numbers and short cells under unnamed columns are left out."""
    pairs = F.zip_with(columns, cells, lambda n, v: F.struct(F.coalesce(n, F.lit("")).alias("n"), F.trim(F.coalesce(v, F.lit(""))).alias("v")))
    unnamed = lambda n: (n == "") | n.startswith("col_")
    told = F.filter(pairs, lambda p: (p["v"] != "") & ~(unnamed(p["n"]) & (is_number(p["v"]) | (F.length(p["v"]) < 3))))
    parts = F.transform(told, lambda p: F.when(unnamed(p["n"]), p["v"]).otherwise(F.concat(p["n"], F.lit(": "), p["v"])))
    return F.substring(F.array_join(F.slice(parts, 1, most), " | "), 1, length)


def is_summary(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.regexp_replace(c, r"\s+", "").isin(*SUMMARY_WORDS))


def apply_layout(grid: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows of grid projected by their sheet's layout (sheet, data_start, data_end, col_indices)."""
    joined = grid.join(layouts, "sheet").filter((F.col("row_no") >= F.col("data_start")) & (F.col("data_end").isNull() | (F.col("row_no") <= F.col("data_end"))))
    return joined.select("sheet", "row_no", F.transform("col_indices", lambda i: F.coalesce(F.get("cells", i), F.lit(""))).alias("cells"))


def match_profiles(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(filename, profile) by glob: the highest priority, then the longest pattern. profiles (profile, pattern, priority) is a small catalogue.

    Globs are grouped by their literal start's first letter where they have one, so most pairs are never formed.
    """
    regex = F.concat(F.lit("(?i)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+^$(){}|\\\[\]])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    open_start = F.col("pattern").rlike(r"^[*?]")
    keyed = profiles.select("profile", "priority", F.length("pattern").alias("n"), regex.alias("re"), F.when(open_start, "*").otherwise(F.lower(F.substring("pattern", 1, 1))).alias("k"))
    names = files.select("filename", F.explode(F.array(F.lit("*"), F.lower(F.substring("filename", 1, 1)))).alias("k"))
    hits = names.join(keyed, "k").filter(F.expr("filename RLIKE re"))
    return hits.groupBy("filename").agg(F.max_by("profile", F.struct("priority", "n", "profile")).alias("profile"))


def profile_records(grid: DataFrame, files: DataFrame, profiles: DataFrame, limit: int = MAX_RECORDS) -> DataFrame:
    """(filename, sheet, row_no, body) of files whose name fits a profile: the header's rows name the columns, data starts where the profile says.

    grid: filename, sheet, row_no, cells; profiles: profile, pattern, priority, header_rows, data_start.
    Empty and summary rows are left out, and of the rest the first limit of a sheet are kept.
    """
    chosen = match_profiles(files, profiles).join(profiles.select("profile", "header_rows", "data_start"), "profile")
    rows = grid.join(chosen, "filename")
    named = rows.filter(F.array_contains("header_rows", F.col("row_no"))).select("filename", "sheet", "row_no", F.posexplode("cells").alias("c", "v")).filter(F.trim("v") != "")
    heads = named.groupBy("filename", "sheet", "c").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "v"))), lambda x: F.trim(x["v"]))), " ").alias("name"))
    heads = heads.groupBy("filename", "sheet").agg(F.map_from_entries(F.collect_list(F.struct("c", "name"))).alias("names"))
    data = rows.filter((F.col("row_no") >= F.col("data_start")) & F.exists("cells", lambda c: F.trim(c) != "") & ~is_summary(F.col("cells")))
    data = data.withColumn("__n", F.row_number().over(W.partitionBy("filename", "sheet").orderBy("row_no"))).filter(F.col("__n") <= limit)
    joined = data.join(heads, ["filename", "sheet"], "left")
    columns = F.transform("cells", lambda c, i: F.coalesce(F.try_element_at("names", i), F.concat(F.lit("col_"), i.cast("string"))))
    return joined.select("filename", "sheet", "row_no", record_body(columns, F.col("cells")).alias("body"))


def best_tier(rows: DataFrame, by: str = "attachment_id") -> DataFrame:
    """Rows of the lowest tier that each attachment has."""
    return rows.withColumn("__t", F.min("tier").over(W.partitionBy(by))).filter("tier = __t").drop("__t")


def sections(text: Column) -> Column:
    """Array of (ref, text) of a text cut before its slide, page and sheet markers."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?=### (?:슬라이드 [0-9]|p[0-9]|시트:))"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p, i: F.struct(F.coalesce(F.nullif(F.regexp_extract(p, r"^### ([^\n]*)", 1), F.lit("")), F.concat(F.lit("part"), i.cast("string"))).alias("ref"), F.btrim(F.regexp_replace(p, r"^### [^\n]*\n?", ""), F.lit(" \t\r\n")).alias("text")))
