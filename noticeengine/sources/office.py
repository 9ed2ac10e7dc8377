"""Workbooks and slides read from their zipped XML, one task per file, without office libraries.

A file that can't be read gives one row with its error; others go on. Cells of merged ranges all have
the range's value. PDFs and images need an extractor that the caller passes in.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import attachment_kind
from ..session import ship

# Limits of what is read of a file.
MAX_ROWS, MAX_SHEETS, MAX_SLIDES = 1200, 8, 40
#: Height of a visual row of a slide.
ROW_HEIGHT = 180_000
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

GRID_SCHEMA = "path string, sheet string, sheet_no int, row_no int, cells array<string>, error string"
SHAPE_SCHEMA = "path string, slide int, shape_no int, kind string, top long, left long, text string, error string"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c: ET.Element, shared: list[str]) -> str:
    kind = c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t")).strip()
    v = c.find(f"{_S}v")
    value = (v.text or "") if v is not None else ""
    if kind == "s":
        return shared[int(value)].strip() if value else ""
    if kind in ("str", "b", "e"):
        return value.strip()
    return re.sub(r"^(-?\d+)\.0+$", r"\1", value.strip())


def read_workbook(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """(sheet, sheet_no, row_no, cells) of the first sheets and rows of an xlsx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(list(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"))[:MAX_SHEETS]):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            grid: dict[int, dict[int, str]] = {}
            for row in root.iter(f"{_S}row"):
                r = int(row.get("r", len(grid) + 1)) - 1
                if r >= MAX_ROWS:
                    break
                grid[r] = {_column(c.get("r")): text for c in row.iter(f"{_S}c") if (text := _cell(c, shared))}
            for merged in root.iter(f"{_S}mergeCell"):
                (a, b), (c, d) = (re.match(r"([A-Z]+)(\d+)", x).groups() for x in (merged.get("ref") + ":" + merged.get("ref")).split(":")[:2])
                top, left, bottom, right = int(b) - 1, _column(a), int(d) - 1, _column(c)
                if value := grid.get(top, {}).get(left):
                    for r in range(top, min(bottom, MAX_ROWS - 1) + 1):
                        for k in range(left, right + 1):
                            grid.setdefault(r, {})[k] = value
            width = max((max(cells, default=-1) + 1 for cells in grid.values()), default=0)
            for r in range(max(grid, default=-1) + 1):
                yield sheet.get("name"), number, r, [grid.get(r, {}).get(k, "") for k in range(width)]


def read_slides(content: bytes) -> Iterator[tuple[int, int, str, int, int, str]]:
    """(slide, shape_no, kind, top, left, text) of the first slides of a pptx file; kind is text, table, image or notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for number, name in enumerate(names[:MAX_SLIDES], 1):
            root = ET.fromstring(z.read(name))
            tree = root.find(f"{_P}cSld/{_P}spTree")
            shape_no = 0
            for shape in tree if tree is not None else ():
                kind = {f"{_P}sp": "text", f"{_P}graphicFrame": "table", f"{_P}pic": "image", f"{_P}grpSp": "text"}.get(shape.tag)
                if kind is None:
                    continue
                off = next(shape.iter(f"{_A}off"), None)
                top, left = (int(off.get("y")), int(off.get("x"))) if off is not None else (0, 0)
                if kind == "table":
                    text = "\n".join(" | ".join("".join(t.text or "" for t in cell.iter(f"{_A}t")) for cell in row.iter(f"{_A}tc")) for row in shape.iter(f"{_A}tr"))
                elif kind == "image":
                    props = next(shape.iter(f"{_P}cNvPr"), None)
                    text = (props.get("descr") or "") if props is not None else ""
                else:
                    text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p"))
                yield number, shape_no, kind, top, left, text.strip()
                shape_no += 1
            notes = f"ppt/notesSlides/notesSlide{re.search(r'(\d+)\.xml', name)[1]}.xml"
            if notes in z.namelist():
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ET.fromstring(z.read(notes)).iter(f"{_A}p")).strip()
                yield number, shape_no, "notes", 1 << 40, 0, text


def read_csv(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """A comma-separated file as one sheet; UTF-8, else the older Korean code page."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp949")
    rows = [[c.strip() for c in r] for _, r in zip(range(MAX_ROWS), csv.reader(io.StringIO(text)))]
    width = max(map(len, rows), default=0)
    for n, r in enumerate(rows):
        yield "Sheet1", 0, n, r + [""] * (width - len(r))


def _unreadable(content: bytes) -> Iterator[tuple]:
    raise ValueError("no reader for this format")


#: Readers of grids by extension; formats without a reader give an error row.
GRID_READERS = {"xlsx": read_workbook, "csv": read_csv, "xls": _unreadable, "xlsb": _unreadable}


def _each_file(reader: Callable, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(path, *r, None) for r in reader(bytes(content))]
                except Exception as e:  # a broken file is a row, not a failed job
                    rows = [(path, *([None] * (len(columns) - 2)), f"{type(e).__name__}: {e}"[:200])]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def workbook_grids(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Cell grids of all workbooks under a path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(_each_file(read_workbook, _names(GRID_SCHEMA)), GRID_SCHEMA)


def slide_shapes(spark: SparkSession, path: str, glob: str = "*.pptx") -> DataFrame:
    """Shapes of all slides under a path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(_each_file(read_slides, _names(SHAPE_SCHEMA)), SHAPE_SCHEMA)


def slide_texts(shapes: DataFrame) -> DataFrame:
    """(path, slide, text, review_flag): each slide's texts in reading order (visual row, then left). Slides of images alone are flagged, empty ones dropped."""
    order = F.struct(F.floor(F.col("top") / ROW_HEIGHT).alias("row"), F.col("left").alias("x"), F.col("shape_no").alias("n"))
    told = shapes.filter("error IS NULL").groupBy("path", "slide").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.when(F.col("kind") != "image", F.col("text")).otherwise("").alias("text")))), lambda x: x["text"]), lambda t: t != ""), "\n").alias("text"),
        F.max(F.col("kind") == "image").alias("image"),
    )
    return told.filter((F.col("text") != "") | F.col("image")).select("path", "slide", "text", F.when(F.col("text") == "", "image_only").alias("review_flag"))


def file_grids(files: DataFrame) -> DataFrame:
    """Cell grids of files (path, content) by extension; other files give nothing."""

    def by_extension(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = batch["path"].str.lower().str.extract(r"\.([^.]+)$")[0]
            for kind, reader in GRID_READERS.items():
                own = batch[kinds == kind]
                if len(own):
                    yield from _each_file(reader, _names(GRID_SCHEMA))(iter([own]))

    return files.select("path", "content").mapInPandas(by_extension, GRID_SCHEMA)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, kind, ref, text, error) of files (path, content): a sheet's rows as lines, a slide's texts; files of other kinds have an empty text."""
    grids = file_grids(files)
    line = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    sheets = grids.filter("error IS NULL").groupBy("path", "sheet_no", "sheet").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))), lambda x: x["line"]), lambda t: t != ""), "\n").alias("text"))
    slides = files.filter(F.lower("path").endswith(".pptx")).select("path", "content").mapInPandas(_each_file(read_slides, _names(SHAPE_SCHEMA)), SHAPE_SCHEMA)
    none = F.lit(None).cast("string")
    kind = attachment_kind(F.col("path"))
    rest = files.select("path").filter(~F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*GRID_READERS, "pptx"))
    broken = grids.filter("error IS NOT NULL").select("path", "error").unionByName(slides.filter("error IS NOT NULL").select("path", "error"))
    out = sheets.select("path", F.concat(F.lit("시트: "), "sheet").alias("ref"), "text", none.alias("error"))
    out = out.unionByName(slide_texts(slides).select("path", F.concat(F.lit("슬라이드 "), F.col("slide").cast("string")).alias("ref"), "text", none.alias("error")))
    out = out.unionByName(rest.select("path", none.alias("ref"), F.lit("").alias("text"), none.alias("error"))).unionByName(broken.select("path", none.alias("ref"), none.alias("text"), "error"))
    return out.select("path", kind.alias("kind"), "ref", "text", "error")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint) by size and modification time, without reading any content."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return meta.select("path", F.substring(F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256), 1, 16).alias("fingerprint"))


def stale(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files (path, fingerprint) that have no parsed record of that fingerprint."""
    return files.join(parsed.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def page_decisions(pages: DataFrame, scanned: int = 40, hybrid: int = 200, image_share: float = 0.3) -> DataFrame:
    """pages (native, image_ratio, ocr_available, ocr_text) with extraction, review_flag and body.

    Pages with hardly any text are scanned; those with little text and a large image are hybrid; both
    use recognised text where there is any.
    """
    size = F.length(F.trim(F.coalesce("native", F.lit(""))))
    is_scanned = size < scanned
    is_hybrid = ~is_scanned & (size < hybrid) & (F.coalesce("image_ratio", F.lit(0.0)) >= image_share)
    wants = is_scanned | is_hybrid
    has = F.col("ocr_available") & (F.trim(F.coalesce("ocr_text", F.lit(""))) != "")
    flag = F.when(wants & ~F.col("ocr_available"), "ocr_unavailable").when(wants & ~has, "ocr_empty")
    body = F.when(wants & has, F.trim(F.concat_ws("\n", F.coalesce("native", F.lit("")), "ocr_text"))).otherwise(F.trim(F.coalesce("native", F.lit(""))))
    return pages.select("*", F.when(wants & has, "ocr").otherwise("deterministic").alias("extraction"), is_hybrid.alias("hybrid"), flag.alias("review_flag"), body.alias("body"))
