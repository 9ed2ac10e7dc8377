"""Readers and sinks over files made here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from noticeengine.operators import retrieval
from noticeengine.sources import board, office, sinks
from noticeengine.streaming import store as streaming


def test_backfill(spark, tmp_path):
    for day, title in (("2026-06-01", "old"), ("2026-06-02", "new"), ("2026-06-09", "later"), ("notes", "none")):
        (tmp_path / day).mkdir()
        (tmp_path / day / "posts.json").write_text(json.dumps([{"id": "p1", "title": title, "body": "", "posted_date": "2026-06-01", "attachments": [{"filename": "a.XLSX", "path": "x"}]}]))
    got = board.read_backfill(spark, str(tmp_path), "2026-06-05")
    assert [r["title"] for r in got.collect()] == ["new"]
    assert [(r["attachment_id"], r["kind"]) for r in board.attachments(got).collect()] == [("p1_a.XLSX", "excel")]
    assert [r["title"] for r in board.read_day(spark, str(tmp_path), "2026-06-09").collect()] == ["later"]


def test_roster(spark, tmp_path):
    rows = ["h1\t", "h2", "", "\t".join(["", "", "", "강남", "01", "e1", "김", "점장"]), "\t".join(["", "", "", "강남", "01", "e2", "이", "IT"]), "short\trow"]
    (tmp_path / "r.txt").write_text("\n".join(rows))
    got = board.read_roster(spark, str(tmp_path / "r.txt"), ["점장"]).orderBy("id").collect()
    assert [(r["id"], r["is_store_manager"], r["categories"]) for r in got] == [("e1", True, ["점장"]), ("e2", False, ["IT"])]


def test_sniff(spark):
    files = spark.createDataFrame([("a.xlsx", b"PK\x03\x04...."), ("b.xlsx", b"\x9bDRMONE."), ("c.pdf", b"%PDF-1.4"), ("d.pdf", b"PK\x03\x04....")], "filename string, content binary")
    got = {r["filename"]: r["k"] for r in files.select("filename", board.sniff(F.col("content"), F.col("filename")).alias("k")).collect()}
    assert got == {"a.xlsx": "zip", "b.xlsx": "drm", "c.pdf": "pdf", "d.pdf": "invalid"}


def test_board_page(spark):
    lines = ["제목입니다", "", "작성자", "", "2026-06-03", "조회 3", "본문 첫 줄은 스무 글자가 넘도록 길게 씁니다 그렇습니다", "둘째 줄"]
    got = spark.range(1).select(board.parse_board_page(F.array(*(F.lit(x) for x in lines)), F.current_date())).first()[0]
    assert got["title"] == "제목입니다" and got["author"] == "작성자" and got["body"].startswith("본문")


def make_workbook(path):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>품목</t></si><si><t>수량</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>a</t></is></c><c r="B2"><v>3.0</v></c></row><row r="3"><c r="B3"><v>4</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')


def test_workbook(spark, tmp_path):
    make_workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    got = office.workbook_grids(spark, str(tmp_path)).orderBy("path", "row_no").collect()
    assert [r["cells"] for r in got if r["error"] is None] == [["품목", "수량"], ["a", "3"], ["a", "4"]]
    assert sum(r["error"] is not None for r in got) == 1


def test_slides(spark, tmp_path):
    a, p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda x, y, t: f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {a} {p}><p:cSld><p:spTree>{shape(900000, 10000, 'right')}{shape(100, 50000, 'left')}{shape(0, 900000, 'below')}</p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/slides/slide2.xml", f"<p:sld {a} {p}><p:cSld><p:spTree><p:pic><p:nvPicPr><p:cNvPr id='1' name='x'/></p:nvPicPr></p:pic></p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/slides/slide3.xml", f"<p:sld {a} {p}><p:cSld><p:spTree/></p:cSld></p:sld>")
    got = office.slide_texts(office.slide_shapes(spark, str(tmp_path))).orderBy("slide").collect()
    assert [(r["slide"], r["text"], r["review_flag"]) for r in got] == [(1, "left\nright\nbelow", None), (2, "", "image_only")]


def test_pages(spark):
    rows = [("긴 글 " * 60, 0.0, True, None), ("", 1.0, True, "인식"), ("", 1.0, False, None), ("짧은 글 " * 15, 0.5, True, "더"), ("짧은 글 " * 15, 0.1, True, "더")]
    got = office.page_decisions(spark.createDataFrame(rows, "native string, image_ratio double, ocr_available boolean, ocr_text string")).collect()
    assert [(r["extraction"], r["hybrid"], r["review_flag"]) for r in got] == [("deterministic", False, None), ("ocr", False, None), ("deterministic", False, "ocr_unavailable"), ("ocr", True, None), ("deterministic", False, None)]


def test_index_round_trip(spark, tmp_path):
    cards = spark.createDataFrame([(1, "냉장고 판촉", "", ""), (2, "세탁기", "", "")], "id long, post_title string, headline string, body string")
    sinks.save_index(cards, str(tmp_path / "i"))
    postings, stats = sinks.load_index(spark, str(tmp_path / "i"))
    got = {r["id"]: r["score"] for r in sinks.score_index(postings, stats, ["냉장고"]).collect()}
    want = {r["id"]: r["bm25"] for r in retrieval.bm25(cards, ["냉장고"]).collect()}
    assert got == pytest.approx(want)
    stats.withColumn("version", F.lit(1)).write.mode("overwrite").parquet(str(tmp_path / "j/stats"))
    with pytest.raises(ValueError):
        sinks.load_index(spark, str(tmp_path / "j"))


def test_html_is_escaped():
    assert "<b>" not in sinks.brief_html("<b>", "2026-06-17", {"x": ["<b>"], "y": []})


def test_stream_upserts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string").write.parquet(source)
    step = streaming.upsert_batches(str(tmp_path / "out"), lambda b: b.select("id", "title"), lambda n: f"2026-06-0{n + 1}")
    query = spark.readStream.schema("id long, title string").parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/v=0")).count() == 2
