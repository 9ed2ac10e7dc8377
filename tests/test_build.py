"""Stored records, artefacts read back, staged archives, and the whole card build, over files and rows made here."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from noticeengine.operators import build, grid
from noticeengine.session import shared_dir
from noticeengine.sources import artifacts, board, office, records, sinks, zips

DAY = datetime.date(2026, 6, 3)


def record_rows(spark, rows):
    attachments = spark.createDataFrame([(p, a, f"{a}.xlsx", "excel", "/x", "f1") for p, a, *_ in rows], "post_id string, attachment_id string, filename string, kind string, path string, fingerprint string")
    parsed = spark.createDataFrame([(a, t, None, None, r, e) for _, a, t, r, e in rows], f"attachment_id string, text string, pages {records.PAGES}, tables {records.TABLES}, needs_review boolean, error string")
    return records.records_of(attachments, parsed, "2026-06-03")


def test_record_store(spark, tmp_path):
    root = str(tmp_path / "parsed")
    records.save_records(record_rows(spark, [("p1", "a", "### 시트: S\nx", True, None), ("p1", "b", "t", False, "broken"), ("p2", "c", "t", None, None)]), root)
    old = records.read_records(spark, root)
    records.save_records(record_rows(spark, [("p1", "b", "mended", False, None)]), root, old)
    now = {r["attachment_id"]: r for r in records.read_records(spark, root).collect()}
    assert sorted(now) == ["a", "b", "c"] and now["b"]["text"] == "mended" and now["b"]["error"] is None
    assert {(r["post_id"], r["needs_review"], r["error"]) for r in records.summaries(records.read_records(spark, root)).collect()} == {("p1", True, False), ("p1", False, False), ("p2", False, False)}
    parts = {(r["source_ref"], r["text"]) for r in records.sections_of(records.read_records(spark, root), grid.sections).collect()}
    assert ("a#시트: S", "x") in parts and ("b#part0", "mended") in parts


def test_wikis_and_graphs_are_read_back(spark, tmp_path):
    card = {"id": "c1", "role": "IT", "post_id": "p1", "post_title": "t", "posted_date": "2026-06-03", "source_ref": "a#s1", "attachment_name": "a", "headline": "Laptop sale", "body": "body", "temporal": json.dumps({"notice_kind": "?", "event_windows": [{"from": "2026-06-01"}, {"to": "2026-06-02"}]})}
    folder = tmp_path / "llmwiki" / "2026-06-03"
    folder.mkdir(parents=True)
    (folder / "llmwiki.json").write_text(json.dumps({"damdang": {"IT": {"cards": [card]}, "공통": {"cards": []}}}))
    with pytest.raises(FileNotFoundError):
        artifacts.load_corpus(spark, str(tmp_path), "2026-06-04")
    got = artifacts.load_corpus(spark, str(tmp_path), "2026-06-03").first()
    assert got["keywords"] == ["body", "laptop", "sale"] and got["provenance"] is None
    assert got["temporal"]["notice_kind"] == "기타" and [w["from"] for w in got["temporal"]["event_windows"]] == [datetime.date(2026, 6, 1)]
    (tmp_path / "kg" / "2026-06-03").mkdir(parents=True)
    node = {"id": "card:c1", "type": "WikiCard", "label": "l", "props": {"card_id": "c1", "provenance": {"path": "x"}}}
    (tmp_path / "kg" / "2026-06-03" / "graph.json").write_text(json.dumps({"nodes": [node], "edges": [{"id": "e", "type": "t", "source": "a", "target": "b"}]}))
    assert json.loads(artifacts.load_corpus(spark, str(tmp_path), "2026-06-03").first()["provenance"]) == {"path": "x"}
    assert artifacts.read_graph(spark, artifacts.graph_path(str(tmp_path), "2026-06-03"))[1].count() == 1
    assert artifacts.newest(spark, str(tmp_path / "llmwiki"), "llmwiki.json").endswith("2026-06-03/llmwiki.json")
    assert artifacts.newest(spark, str(tmp_path / "none"), "x") is None


def test_event_wiki(spark, tmp_path):
    item = lambda t: {"id": "e1", "title": t, "type": "공지", "valid_from": "2026-06-01"}
    (tmp_path / "w.json").write_text(json.dumps({"damdang": {"A": {"themes": {"x": [item("first")]}}, "B": {"themes": {"y": [item("last")]}}}}))
    got = artifacts.read_events(spark, str(tmp_path / "w.json")).collect()
    assert [(r["title"], r["valid_from"]) for r in got] == [("last", datetime.date(2026, 6, 1))]


def test_settings():
    assert artifacts.load_env("# c\nA = 'x'\nB=2\nbad\n", {"B": "1"}) == {"A": "x", "B": "1"}
    assert artifacts.load_settings('{"managers": ["m"]}') == {"managers": ["m"]}
    assert artifacts.extended_vocabulary(["a"], ["b", "a", "", "b"]) == (["a", "b"], ["b"])


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.pdf", b"%PDF-1.4 x")
    with zipfile.ZipFile(tmp_path / "board.zip", "w") as z:
        z.writestr("post1/board.pdf", b"%PDF-1.4")
        z.writestr("post1/files/a.xlsx", b"PK\x03\x04")
        z.writestr("post2/bad.xlsx", b"no archive")
        z.writestr("post2/download.zip", inner.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"none")
    found = zips.members(spark, str(tmp_path))
    assert {r["filename"] for r in zips.valid(found).collect()} == {"board.pdf", "a.xlsx", "download.zip"}
    assert [r["folder"] for r in zips.post_folders(found, F.col("filename") == "board.pdf").collect()] == ["post1"]
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], "filename string, place string")
    assert [zips.index_by_name(rows, "place", last).first()["place"] for last in (True, False)] == ["2", "1"]


def test_files_by_kind(spark):
    files = spark.createDataFrame([("a.csv", "품목,수량\nx,3\n".encode("cp949")), ("b.xls", b"\xd0\xcf"), ("c.txt", b"t"), ("d.xlsx", b"broken")], "path string, content binary")
    got = {r["path"]: r for r in office.parse_files(files).collect()}
    assert got["a.csv"]["text"] == "품목 | 수량\nx | 3" and got["c.txt"]["text"] == "" and got["c.txt"]["kind"] == "unknown"
    assert got["b.xls"]["error"] and got["d.xlsx"]["error"]


def test_page_ends_at_its_footer(spark):
    lines = ["t", "", "w", "", "2026-06-03", "조회 3", "본문 첫 줄은 스무 글자가 넘도록 길게 씁니다 그렇습니다", "둘째", "1/2", "after"]
    page = F.array(*(F.lit(x) for x in lines))
    assert spark.range(1).select(board.parse_board_page(page, F.current_date())["body"]).first()[0].endswith("둘째")
    assert spark.range(1).select(board.attachment_hints(F.lit("※ 첨부파일 : a.xlsx\n※첨부파일: a.xlsx"))).first()[0] == ["a.xlsx"]


def test_whole_build(spark):
    schema = "id string, kind string, post_id string, post_title string, posted_date date, filename string, source_ref string, title string, body string, note string, category string, given_roles array<string>, given_keywords array<string>, given_codes array<string>, extraction string, review_flag string"
    base = {"kind": "excel", "post_id": "p1", "post_title": "6월 안내", "posted_date": DAY, "filename": "guide.xlsx", "title": "행사", "extraction": "deterministic"}
    rows = [
        {"id": "r1", "source_ref": "a#1", "body": "모델 PLX-00001 행사 6/1~6/30 할인"},
        {"id": "r2", "source_ref": "a#2", "body": "", "note": "노트북 진열 사진", "kind": "pptx_slide"},
        {"id": "r3", "source_ref": "a#3", "body": "아무 역할도 없는 글"},
        {"id": "r4", "source_ref": "a#4", "body": "짧은 공통", "category": "공통", "extraction": "ocr"},
    ]
    recs = spark.createDataFrame([base | r for r in rows], schema)
    lookup = spark.createDataFrame([("PLX-00001", "KBB", 0)], "code string, role string, ord int")
    roster = F.array(*(F.lit(r) for r in ("KBB", "IT", "PC솔루션", "공통", "점장")))
    rich = {r["id"]: r for r in build.enrich_records(recs, lookup, roster).collect()}
    assert rich["r1"]["roles"] == ["KBB"] and rich["r1"]["temporal"]["valid_to"] == datetime.date(2026, 6, 30)
    assert rich["r2"]["roles"] == ["IT", "PC솔루션"] and "r3" not in rich and rich["r4"]["review_flag"] == "ocr_content"
    posts = spark.createDataFrame([("p1", "6월 안내", "노트북 " * 40, DAY), ("p2", "짧은", "짧다", DAY)], "post_id string, title string, body string, posted_date date")
    cards = build.build_cards(recs, posts, lookup, roster)
    got = sorted((r["source_ref"], r["role"]) for r in cards.collect())
    assert got == [("a#1", "KBB"), ("a#2", "IT"), ("a#2", "PC솔루션"), ("a#4", "공통"), ("p1#body", "IT"), ("p1#body", "PC솔루션")]
    stats = build.build_stats(cards, recs, posts, lookup).first()
    assert (stats["cards_written"], stats["post_body_cards"], stats["posts_scanned"], stats["codes_resolved"]) == (6, 2, 2, 1)


def test_index_holds_every_field(spark, tmp_path):
    cards = spark.createDataFrame([(1, "title", "head", "body", "file", ["key"], ["PLX-1"]), (2, "", "", "", "", [], [])], "id long, post_title string, headline string, body string, attachment_name string, keywords array<string>, product_codes array<string>")
    sinks.save_index(cards, str(tmp_path / "i"))
    posted, stats = sinks.load_index(spark, str(tmp_path / "i"))
    assert {r["term"] for r in posted.collect()} == {"title", "head", "body", "file", "key", "plx"} and stats.first()["n"] == 1


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf(dict):
        pass

    class Fake:
        class sparkContext:
            @staticmethod
            def getConf():
                return Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError):
        shared_dir(Fake)
    assert shared_dir(spark)
