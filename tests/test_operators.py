"""Operators on literal rows: temporal, store, review, relevance, retrieval, graph, grids, provenance."""

import random
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeengine import session
from noticeengine.operators import evaluate, graph, grid, provenance, questions, relevance, retrieval, review, routing, store, temporal, vectors
from noticeengine.session import materialize

EVENT = "id string, type string, title string, categories array<string>, branches array<string>, valid_from date, valid_to date, effective_date date, version_of string, first_seen date, last_updated date, ord long"


def day(n, month=6):
    return date(2026, month, n)


def events(spark, *rows):
    base = {"type": "판촉", "title": "", "categories": ["대형가전"], "branches": ["강남"]}
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple({**base, "ord": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], EVENT)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_dated_filters(spark):
    e = events(spark, {"id": "a", "valid_to": day(17), "first_seen": day(12)}, {"id": "b", "valid_to": day(18), "first_seen": day(1)}, {"id": "c", "first_seen": day(17)})
    assert ids(temporal.expiring_on(e, "2026-06-17")) == ["a"]
    assert ids(temporal.new_since(e, "2026-06-17")) == ["a", "c"]
    assert ids(temporal.active_on(e, "2026-06-18")) == ["b", "c"]


def test_policy_chain(spark):
    e = events(spark, {"id": "p1"}, {"id": "p2", "version_of": "p1", "last_updated": day(16)})
    pairs = temporal.policy_change_pairs(e, "2026-06-17").collect()
    assert [(r["new_id"], r["old_id"]) for r in pairs] == [("p2", "p1")]
    assert ids(temporal.resolve_current(e)) == ["p2"]


def test_windows_replace_the_envelope(spark):
    rows = spark.createDataFrame([("x", day(5), day(22), [(day(5), day(8)), (day(20), day(22))])], "id string, valid_from date, valid_to date, event_windows array<struct<from:date,to:date>>")
    assert ids(temporal.active_on(rows, "2026-06-07", "event_windows")) == ["x"]
    assert ids(temporal.active_on(rows, "2026-06-15", "event_windows")) == []


def test_policy_links_take_the_first(spark):
    old = events(spark, {"id": "o1", "type": "정책"}, {"id": "o2", "type": "정책"})
    new = events(spark, {"id": "n", "type": "정책", "ord": 9}, {"id": "m", "type": "공지", "ord": 10})
    assert [tuple(r) for r in temporal.link_policy_versions(new, old).collect()] == [("n", "o1")]
    assert [tuple(r) for r in temporal.link_policy_versions(new, old, latest=True).collect()] == [("n", "o2")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 28), st.sampled_from(["t1", "t2", None])), min_size=1, max_size=8))
def test_version_chains_have_no_cycles(spark, rows):
    cards = spark.createDataFrame([(i, "r", t, None, None, day(d), None, i) for i, (d, t) in enumerate(rows)], "id long, role string, topic_key string, effective_date date, valid_from date, posted_date date, version_of long, ord long")
    before = {r["id"]: r["version_of"] for r in temporal.link_card_versions(cards).collect()}
    for start in before:
        seen, at = set(), start
        while at is not None:
            assert at not in seen
            seen.add(at)
            at = before[at]


def test_upsert_twice_is_once(spark):
    old = events(spark, {"id": "a", "first_seen": day(1), "last_updated": day(1)}, {"id": "b", "first_seen": day(1), "last_updated": day(1)})
    new = events(spark, {"id": "a", "title": "n"}, {"id": "c"})
    once = store.upsert(old, new, "2026-06-09")
    twice = store.upsert(once, new, "2026-06-09")
    show = lambda df: sorted(map(repr, df.select("id", "title", "first_seen", "last_updated").collect()))
    assert show(once) == show(twice)
    assert {(r["id"], r["first_seen"].day, r["last_updated"].day) for r in once.collect()} == {("a", 1, 9), ("b", 1, 1), ("c", 9, 9)}
    assert ids(store.prune(once, "2026-06-29", 4)) == ["a", "b", "c"]
    assert ids(store.prune(once, "2026-07-01", 4)) == ["c"]


def test_review(spark):
    old = events(spark, {"id": "a"}, {"id": "b"})
    new = events(spark, {"id": "a", "categories": ["정수기"]}, {"id": "b"}, {"id": "c", "valid_from": day(9), "valid_to": day(2)})
    vocabulary = spark.createDataFrame([("대형가전",)], "category string")
    got = {r["id"]: r for r in review.review(new, old, vocabulary, block_on_change=True).collect()}
    assert got["a"]["action"] == "고정층_변경" and [c["field"] for c in got["a"]["changes"]] == ["categories"] and got["a"]["flags"] == ["미등록_카테고리"] and not got["a"]["upsert_allowed"]
    assert got["b"]["action"] == "신규" and got["b"]["upsert_allowed"]
    assert got["c"]["flags"] == ["날짜_불일치"]


def test_relevance(spark):
    roster = spark.createDataFrame([("m", "지점장", "강남", True, []), ("o", "담당", "강남", False, ["대형가전"])], "id string, name string, branch string, is_store_manager boolean, categories array<string>")
    e = events(spark, {"id": "x", "categories": ["IT"]}, {"id": "y"}, {"id": "z", "branches": ["부산"]}, {"id": "w", "branches": ["전점"], "categories": ["IT"]})
    got = relevance.relevant_events(roster, e)
    assert ids(got.filter("employee_id = 'm'"), "event_id") == ["w", "x", "y"]
    assert ids(got.filter("employee_id = 'o'"), "event_id") == ["y"]


CARD = "id long, role string, post_id long, post_title string, posted_date date, source_ref string, attachment_name string, product_codes array<string>, keywords array<string>, headline string, body string, notice_kind string, valid_from date, valid_to date, effective_date date, topic_key string, version_of long, ord long"


def cards(spark, *rows):
    base = {"role": "r", "post_title": "", "posted_date": day(1), "source_ref": "", "attachment_name": "", "product_codes": [], "keywords": [], "headline": "", "body": "", "notice_kind": "공지"}
    names = [c.split()[0] for c in CARD.split(", ")]
    return spark.createDataFrame([tuple({**base, "id": i, "post_id": i, "ord": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], CARD)


def test_bm25_order(spark):
    c = cards(spark, {"body": "냉장고 판촉 안내"}, {"body": "세탁기 교육"})
    got = {r["id"]: r["bm25"] for r in retrieval.bm25(c, ["냉장고는"]).collect()}
    assert got.keys() == {0} and got[0] > 0


def test_topics_keep_the_newest(spark):
    c = cards(spark, {"body": "선풍기 조립", "topic_key": "t", "posted_date": day(1, 5)}, {"body": "선풍기 조립", "topic_key": "t", "posted_date": day(10)})
    got = retrieval.retrieve(c, retrieval.Query(["선풍기"]))
    assert ids(got) == [1]


def test_filters_relax(spark):
    c = cards(spark, {"body": "a", "valid_to": day(1)}, {"body": "b", "valid_to": day(2)})
    q = retrieval.Query([], product_codes=["NO-CODE1"], time_mode="active_on", query_date="2026-07-15")
    assert ids(retrieval.pool_for(c, q)) == [0, 1]
    assert ids(retrieval.pool_for(c, retrieval.Query([], time_mode="active_on", query_date="2026-06-02"))) == [1]
    assert ids(retrieval.pool_for(c.limit(0), q)) == []


def test_weak(spark):
    c = cards(spark, {"body": "세탁기"})
    hits = retrieval.hits(c, retrieval.Query(["냉장고"], roles=["r"]))
    assert retrieval.weak(hits, ["냉장고"]).first()["weak"] is True
    assert retrieval.weak(c.limit(0).withColumn("score", F.lit(0.0)), ["냉장고"]).first()["weak"] is True


def test_question_rules():
    i = questions.understand("브랜드 마케팅 광고 계정은 어떻게 하나요", raw={"damdang_hints": ["생활주방"]})
    assert i.role_hints == [] and i.notice_kinds == ["공지", "정책"]
    roster = ["생활주방", "생활리빙", "IT", "PC솔루션", "케어서비스", "공통"]
    assert questions.role_scope("광고 계정", i, roster, questions.confidence("광고 계정", i, roster)) == roster
    j = questions.understand("노트북 진열소진 재고확인")
    assert j.notice_kinds == [] and "PC솔루션" in j.role_hints
    k = questions.understand("IT 담당 공지")
    assert questions.confidence("IT 담당 공지", k, roster) == "high" and questions.role_scope("IT 담당 공지", k, roster, "high") == ["IT"]


def test_stages(spark):
    c = cards(spark, {"body": "완전히 다른 글", "role": "공통"}, {"body": "냉장고 할인", "role": "IT", "notice_kind": "판촉"})
    asked = questions.ask(c, "없는말 정책", ["IT", "공통"], refine=lambda q, k: ["냉장고"])
    assert asked.stages[0] == "initial" and asked.stages[-1] == "refine"
    text, cited = questions.compose(asked)
    assert text and len(cited) >= 1


def test_graph_checks(spark):
    c = cards(spark, {"role": "a", "source_ref": "s#1", "attachment_name": "f", "headline": "h", "keywords": ["k"], "product_codes": ["P1", "P2", "P3"]}, {"role": "b", "source_ref": "s#2", "attachment_name": "f", "headline": "h", "keywords": ["k"]})
    posts = spark.createDataFrame([(0, "t0"), (1, "t1")], "post_id long, title string")
    products = spark.createDataFrame([("P1", "a")], "code string, role string")
    n, e = graph.nodes(c, posts, products, c.select("role")), graph.edges(c, posts, products)
    sound = {r["check"]: r["n"] for r in graph.validate(n, e, c, c.select("id")).collect()}
    assert set(sound.values()) == {0}
    assert e.filter("type = 'co_occurs'").count() == 3
    ends = {r["source"] for r in e.collect()} | {r["target"] for r in e.collect()}
    assert ends <= {r["id"] for r in n.collect()}
    cut = graph.validate(n.filter("type <> 'Keyword'"), e, c.withColumn("headline", F.lit(" ")), c.select("id").limit(1))
    got = {r["check"]: r["n"] for r in cut.collect()}
    assert got["cards_no_text"] == 2 and got["card_nodes_missing_index"] == 1 and got["dangling_edges"] == 4


def _graph(spark):
    c = cards(spark, {"role": "a", "source_ref": "s#1", "attachment_name": "f", "headline": "h", "keywords": ["k", "K "], "product_codes": ["P1", "P2", "P3"]}, {"role": "b", "source_ref": "s#2", "attachment_name": "f", "headline": "h", "keywords": ["k"], "product_codes": ["P1", "P2"]})
    posts = spark.createDataFrame([(0, "t0"), (1, "t1")], "post_id long, title string")
    products = spark.createDataFrame([("P1", "a"), ("P1", "a")], "code string, role string")
    return c, posts, products


def test_edges_are_one_without_a_shuffle_of_all(spark):
    c, posts, products = _graph(spark)
    own, twice = graph.edges(c, posts, products), graph.edges(c.unionByName(c).unionByName(c.withColumn("role", F.lit("z"))), posts, products)
    one, two = own.collect(), twice.collect()
    assert len(one) == len({r["id"] for r in one}) and len(two) == len({r["id"] for r in two}) == len(one) + 2
    assert sum(r["type"] == "co_occurs" for r in one) == 3 and sum(r["type"] == "tagged_with" for r in one) == 2
    assert graph.links(c, posts, products).columns == ["type", "source", "target"]


def test_hops_leave_only_the_last_frontier(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")], "source string, target string")
    made = []
    monkeypatch.setattr(graph, "materialize", lambda *a, **k: made.append(materialize(*a, **k)) or made[-1])
    got = {n: {r["id"] for r in graph.within_hops(e, spark.createDataFrame([("a",)], "id string"), n).collect()} for n in (1, 3)}
    assert got == {1: {"a", "b"}, 3: {"a", "b", "c", "d"}}
    assert sum(session.exists(spark, x._scratch_path) for x in made) == 2 and len(made) > 8


def test_induced_ids_need_no_shuffle_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(graph, "PASSES", 2)
    c, posts, products = _graph(spark)
    e = graph.edges(c, posts, products)
    n = graph.nodes(c, posts, products, c.select("role")).filter("type <> 'Keyword'")
    got = graph.induced_ids(n, e)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.induced(n, e).select("id", "type").collect())) != []
    assert "Exchange" not in _plan(got)


def test_finds_are_written_check_by_check(spark, monkeypatch):
    monkeypatch.setattr(graph, "PASSES", 2)
    c, posts, products = _graph(spark)
    e = graph.edges(c, posts, products)
    n = graph.nodes(c, posts, products, c.select("role")).filter("type <> 'Product'")
    found = graph.validate(n, e, c, c.select("id"))
    want = e.filter("source LIKE 'product:%' OR target LIKE 'product:%'")
    row = found.filter("check = 'dangling_edges'").first()
    assert row["n"] == want.count() and row["samples"] == sorted(r["id"] for r in want.collect())[:20]
    assert "Anti" not in _plan(found)


def test_roles_touch_without_a_shuffle_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(graph, "PASSES", 2)
    c, posts, products = _graph(spark)
    e, n = graph.edges(c, posts, products), graph.nodes(c, posts, products, c.select("role"))
    found = graph.role_subgraphs(n, e, c)
    got = {(r["role"], r["id"]) for r in found.collect()}
    assert found.count() == len(got) and {("a", "product:P3"), ("a", "product:P1"), ("b", "product:P1"), ("b", "damdang:b")} <= got and ("b", "product:P3") not in got
    assert "Exchange" not in _plan(found)


def test_header_of_two_rows(spark):
    rows = F.array(F.array(F.lit("기초"), F.lit("")), F.array(F.lit("3월말"), F.lit("3월말")))
    assert spark.range(1).select(grid.merge_headers(rows)).first()[0] == ["기초 / 3월말", "기초 / 3월말_2"]


def test_tables_of_two_regions(spark):
    cells = [["▣ 제목", "", ""], ["품목", "수량", "단가"], ["a", "1", "10"], ["b", "2", "20"], ["", "", ""], ["", "", ""], ["코드", "값", "비고"], ["x", "3", "4"]]
    g = spark.createDataFrame([("s", i, c) for i, c in enumerate(cells)], "sheet string, row_no int, cells array<string>")
    got = grid.extract_tables(grid.regions(g)).orderBy("region").collect()
    assert [(r["title"], r["columns"], r["total_rows"]) for r in got] == [("▣ 제목", ["품목", "수량", "단가"], 2), (None, ["코드", "값", "비고"], 1)]


def test_fill_down_and_layout(spark):
    g = spark.createDataFrame([("s", 0, "a"), ("s", 1, ""), ("s", 2, None), ("s", 3, "b")], "sheet string, row_no int, v string")
    assert [r["v"] for r in grid.fill_down(g, "v").orderBy("row_no").collect()] == ["a", "a", "a", "b"]
    cells = spark.createDataFrame([("s", i, [str(i), "x"]) for i in range(4)], "sheet string, row_no int, cells array<string>")
    layout = spark.createDataFrame([("s", 1, 2, [1, 5])], "sheet string, data_start int, data_end int, col_indices array<int>")
    assert [r["cells"] for r in grid.apply_layout(cells, layout).orderBy("row_no").collect()] == [["x", ""], ["x", ""]]


def test_sections(spark):
    t = "머리\n### 슬라이드 1\n가\n### 슬라이드 2\n나"
    got = spark.range(1).select(grid.sections(F.lit(t))).first()[0]
    assert [(s["ref"], s["text"]) for s in got] == [("part0", "머리"), ("슬라이드 1", "가"), ("슬라이드 2", "나")]


def test_routing(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id long, product_codes array<string>")
    lookup = spark.createDataFrame([("a", "대형가전1", 0), ("b", "대형가전2", 0), ("c", "r1", 0), ("c", "r2", 1), ("c", "r3", 2), ("c", "r4", 3), ("c", "r5", 4)], "code string, role string, ord int")
    assert {r["id"]: r["sections"] for r in routing.routed_sections(rows, lookup).collect()} == {1: ["대형가전"]}
    assert routing.roles_by_codes(rows, lookup).filter("id = 2").first()["roles"] == ["r1", "r2", "r3", "r4", "r5"]


def test_record_roles(spark):
    roster = F.array(*(F.lit(x) for x in ("생활주방", "IT", "PC솔루션", "공통", "점장")))
    none = F.array().cast("array<string>")

    def got(**v):
        base = {"category": F.lit(""), "given": none, "filename": F.lit("a.xlsx"), "title": F.lit(""), "body": F.lit("내용"), "by_code": none, "by_text": none, "n_codes": F.lit(0)}
        return spark.range(1).select(routing.record_roles(**{**base, **v}, roster=roster)).first()[0]

    assert got() == []
    assert got(given=F.array(F.lit("IT"), F.lit("점장"))) == ["IT"]
    assert got(category=F.lit("공 통")) == ["공통"]
    assert got(by_code=F.array(F.lit("IT")), n_codes=F.lit(1)) == ["IT"]
    assert got(filename=F.lit("[생활주방] 안내.xlsx")) == ["생활주방"]


def test_leader_groups(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"], "k"), (2, 2, ["a", "b", "c"], "k"), (3, 3, ["z"], "k")], "id long, ord long, keywords array<string>, block string")
    assert {r["id"]: r["leader"] for r in provenance.leader_groups(rows, "block").collect()} == {1: 1, 2: 1, 3: 3}
    e = spark.createDataFrame([(1, 1, 7, 5), (2, 2, 8, 9), (3, 3, 7, 1)], "id long, ord long, post_id long, quality int")
    assert ids(provenance.dedupe(e, provenance.leader_groups(rows, "block"))) == [2, 3]


def test_copies_of_a_title_are_not_paired(spark, monkeypatch):
    said = [["a", "b", "c"]] * 40 + [["c", "b", "a"]] * 20 + [["a", "b", "x"]] + [[]] * 2
    rows = spark.createDataFrame([(i, i, k) for i, k in enumerate(said)], "id long, ord long, keywords array<string>")
    monkeypatch.setattr(provenance, "PASSES", 2)
    seen, real = [], provenance.similar_titles
    monkeypatch.setattr(provenance, "similar_titles", lambda e: seen.append(e.count()) or real(e))
    got = {r["id"]: r["leader"] for r in provenance.leader_groups(rows).collect()}
    assert got == {i: 0 if i < 61 else i for i in range(63)} and seen == [4]


def test_leader_groups_of_any_first_keyword(spark):
    from conftest import DATA

    from noticeengine.plans import tables

    docs = tables._keyworded(spark, str(DATA)).select("id", "source", F.length("text").alias("quality"), "keywords").collect()
    leaders, group = [], {}
    for r in sorted(docs, key=lambda r: r["id"]):
        own = set(r["keywords"])
        near = [i for i, k in leaders if own and k and len(own & k) / min(len(own), len(k)) >= 0.55]
        group[r["id"]] = near[0] if near else r["id"]
        leaders += [] if near else [(r["id"], own)]
    rows = spark.createDataFrame([(1, 1, ["b", "c"]), (2, 2, ["a", "b", "c"]), (3, 3, ["a", "z"]), (4, 4, [])], "id long, ord long, keywords array<string>")
    assert {r["id"]: r["leader"] for r in provenance.leader_groups(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    of = {}
    for r in docs:
        of.setdefault(group[r["id"]], []).append(r)
    stays = {r["id"] for g in of.values() for r in (g if len({x["source"] for x in g}) == 1 else [min(g, key=lambda x: (-x["quality"], x["id"]))])}
    assert set(ids(tables.dedupe_events_greedy(spark, str(DATA)))) == stays


def test_titles_are_compared_with_blocks_of_leaders(spark, monkeypatch):
    """As a plain greedy pass, with many blocks; later titles never meet each other but in their block."""
    rng = random.Random(3)
    said = [rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 9)) for _ in range(300)] + [[], None, ["a", None], ["b", "b", "zz"]]
    rows = spark.createDataFrame([(i * 7 % 304, i, k, i % 2) for i, k in enumerate(said)], "id long, ord long, keywords array<string>, at int")
    monkeypatch.setattr(provenance, "BLOCK", 64)
    blocks, real = [], provenance.materialize
    monkeypatch.setattr(provenance, "materialize", lambda df, tag, **how: blocks.append(tag) or real(df, tag, **how))
    for block in (None, "at"):
        leaders, want = [], {}
        for i, k in enumerate(said):
            near = [j for j, own in leaders if k and own and (not block or i % 2 == j % 2) and len(set(k) & set(own)) / min(len(k), len(own)) >= 0.55]
            want[i * 7 % 304] = (near[0] if near else i) * 7 % 304
            leaders += [] if near else [(i, k)]
        assert {r["id"]: r["leader"] for r in provenance.leader_groups(rows, block).collect()} == want
    assert blocks.count("block") > 2


@pytest.mark.parametrize("a,b,same", [("p_a.xlsx#row:S:1", "p_a.xlsx#row:S:9", True), ("p_a.xlsx#row:S:1", "p_a.xlsx#row:T:9", False), ("p_a.xlsx", "p_a.xlsx#p1", True), ("x", "y", False), ("", "y", False)])
def test_refs(spark, a, b, same):
    assert spark.range(1).select(evaluate.refs_match(F.lit(a), F.lit(b))).first()[0] is same


def test_history_keeps_the_newest(spark):
    old = spark.createDataFrame([(f"r{i}", i, 0) for i in range(30)], "run_id string, at int, n int")
    new = spark.createDataFrame([("r5", 99, 1)], "run_id string, at int, n int")
    got = evaluate.history(old, new).collect()
    assert len(got) == 30 and {r["n"] for r in got if r["run_id"] == "r5"} == {1}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_employees_and_events_are_not_shuffled(spark):
    """Lists of employees are opened last: nothing is exchanged or counted after it."""
    roster = spark.createDataFrame([(1, "a", "3", False, ["x"]), (2, "b", "3", True, ["y"]), (3, "c", "4", False, ["x", "y"]), (3, "c", "3", False, ["z"])], "id long, name string, branch string, is_store_manager boolean, categories array<string>")
    events = spark.createDataFrame([(10, ["3"], ["x"]), (11, ["전점"], ["y"]), (12, ["4", "3"], ["z"])], "id long, branches array<string>, categories array<string>")
    found = relevance.relevant_events(roster, events)
    assert sorted(map(tuple, found.collect())) == [(1, 10), (2, 10), (2, 11), (2, 12), (3, 11), (3, 12)]
    plan = _plan(found)
    assert 0 < plan.index("Generate explode(ids") < plan.index("Exchange")
    why = {(r["employee_id"], r["event_id"]): r["reason"] for r in relevance.explained_events(roster.limit(2), events).collect()}
    assert why == {(1, 10): "3 · 담당 카테고리(x)", (2, 10): "3 점장 — 지점 전체 사안", (2, 11): "3 점장 — 지점 전체 사안", (2, 12): "3 점장 — 지점 전체 사안"}


def test_briefs_are_gathered_once_a_kind_of_employee(spark):
    roster = spark.createDataFrame([(i, f"n{i}", "3", False, ["x"]) for i in range(5)], "id long, name string, branch string, is_store_manager boolean, categories array<string>")
    events = spark.createDataFrame([(10, 1, None), (11, 2, 10)], "id long, ord long, version_of long").selectExpr("*", "array('3') branches", "array('x') categories", "date'2024-01-02' valid_to", "date'2024-01-01' first_seen", "date'2024-01-01' last_updated")
    brief = relevance.brief_sections(roster, events, "2024-01-02")
    assert {tuple(map(tuple, r[2:])) for r in brief.collect()} == {((10, 11), (10, 11), (11,), (11,))} and brief.count() == 5
    assert "collect_list(CASE WHEN" in _plan(brief) and "employee_kind" in _plan(brief)


def test_sections_are_matched_without_shuffling_their_text(spark):
    events = spark.createDataFrame([(1, 7, ["apple", "pear", "fig", "kiwi", "plum"])], "id long, post_id long, keywords array<string>")
    sections = spark.createDataFrame([(7, "a", "apples", ["apple"]), (7, "b", "-", ["pear"]), (7, "c", "-", ["pear", "kiwi"]), (8, "d", "fig", ["fig"]), (7, "e", "x", None)], "post_id long, source_ref string, text string, keywords array<string>")
    found = provenance.match_sections(events, sections)
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (1, "c")]
    assert "Generate" not in _plan(found)


def test_nearest_vectors_with_ties_and_gaps(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 8)] + [(8, [0.0, 1.0]), (9, [0.0, 0.0]), (10, None), (11, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [(r.query_id, r.vec_id, r["rank"], r.cosine) for r in vectors.cosine_top_k(v, v.filter("vec_id in (3, 8, 9)"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(3, 1, 1, 1.0), (3, 2, 2, 1.0), (3, 4, 3, 1.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0), (8, 3, 3, 0.0), (9, 1, 1, None), (9, 2, 2, None), (9, 3, 3, None)]
    blocked = vectors.cosine_top_k(v, v.filter("vec_id in (3, 8, 9)"), 3, block=1)
    assert sorted(map(str, blocked.select("query_id", "vec_id", "rank", "cosine").collect())) == sorted(map(str, vectors.cosine_top_k(v, v.filter("vec_id in (3, 8, 9)"), 3).select("query_id", "vec_id", "rank", "cosine").collect()))
    assert [r.cosine for r in vectors.cosine_top_k(v, v.filter("vec_id = 10"), 2).collect()] == [None, None]
    assert "MapInArrow" in _plan(blocked) and "NestedLoop" not in _plan(blocked)


_ROSTER = "id long, name string, branch string, is_store_manager boolean, categories array<string>"


def test_pairs_of_one_kind_are_opened_by_many_tasks(spark, monkeypatch):
    """Lists of both sides are dealt out: a frequent kind's pairs are not one task's, and a row opens to few."""
    monkeypatch.setattr(relevance, "TOLD", 10)
    monkeypatch.setattr(relevance, "LISTENERS", 4)
    roster = spark.createDataFrame([(i, "a", "3", False, ["x"]) for i in range(9)] + [(9, "b", "4", True, ["y"])], _ROSTER)
    events = spark.range(203).selectExpr("id", "array('3') branches", "array('x') categories")
    found = relevance.relevant_events(roster, events).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r[0], r[1]) for r in found) == [(i, j) for i in range(9) for j in range(203)]
    assert len({r["task"] for r in found}) > 1


def test_reasons_of_one_kind_are_opened_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(relevance, "TOLD", 10)
    roster = spark.createDataFrame([(1, "a", "3", False, ["x", "y"]), (2, "b", "3", True, ["z"]), (1, "a", "3", False, ["z"])], _ROSTER)
    events = spark.range(150).selectExpr("id", "array('3') branches", "array('y', 'z', 'x') categories")
    found = relevance.explained_events(roster, events).withColumn("task", F.spark_partition_id()).collect()
    said = ["3 · 담당 카테고리(x, y)", "3 · 담당 카테고리(z)", "3 점장 — 지점 전체 사안"]
    assert sorted((r["event_id"], r["reason"]) for r in found) == [(i, s) for i in range(150) for s in said]
    assert len({r["task"] for r in found}) > 1


def test_briefs_shuffle_lists_of_events_that_are_alike(spark, monkeypatch):
    """An event stays current for those who don't see what supersedes it; 90 events that are alike are a few rows."""
    written, real = {}, relevance.materialize
    monkeypatch.setattr(relevance, "materialize", lambda df, tag, **how: written.setdefault(tag, real(df, tag, **how)))
    roster = spark.createDataFrame([(1, "a", "3", False, ["x"]), (2, "b", "3", True, []), (3, "c", "3", False, ["y"]), (4, "d", "9", False, ["x"])], _ROSTER)
    rows = [(i, -i, None, ["x"]) for i in range(90)] + [(100, 1, 7, ["x"]), (101, 2, 8, ["y"]), (102, 3, 8, ["y", "z"]), (103, 4, 555, ["y"])]
    events = spark.createDataFrame(rows, "id long, ord long, version_of long, categories array<string>").selectExpr("*", "array('3') branches", "date'2024-03-02' valid_to", "date'2024-01-01' first_seen", "date'2024-03-01' last_updated")
    got = {r["employee_id"]: r for r in relevance.brief_sections(roster, events, "2024-03-02").collect()}
    plain = list(range(89, -1, -1))
    assert got[1]["current_relevant"] == [i for i in plain if i != 7] + [100] and got[1]["policy_changes"] == [100]
    assert got[2]["current_relevant"] == [i for i in plain if i not in (7, 8)] + [100, 101, 102, 103] and got[2]["expiring_today"] == [*plain, 100, 101, 102, 103]
    assert got[3]["current_relevant"] == [101, 102, 103] and got[4]["current_relevant"] is None and got[3]["new_this_week"] == []
    assert written["alike"].count() <= relevance.PIECES + 6 and "items" in written["alike"].columns


def test_passes_over_written_edges_read_their_part(spark):
    """A pass over sources reads one folder; edges of types that no seed's kind ends in are left out, and none else."""
    links = spark.createDataFrame([("co", f"p:{i}", f"p:{i + 1}") for i in range(40)] + [("in", f"c:{i}", f"p:{i}") for i in range(40)] + [("of", "s:1", "c:3"), ("of", "plain", "c:4")], "type string, source string, target string")
    edges = graph.written(links)
    assert sorted(r["source"] for i in range(graph.PASSES) for r in graph._slice(edges, "source", i).collect()) == sorted(r["source"] for r in links.collect())
    assert "PartitionFilters: [isnotnull(__part" in _plan(graph._slice(edges, "source", 1)) and "xxhash64" not in _plan(graph._slice(edges, "source", 1))
    seeds = spark.createDataFrame([("c:3",), ("c:4",)], "id string")
    assert "(co" not in _plan(graph._ends_of(edges, seeds)(1)) and "in" in _plan(graph._ends_of(edges, seeds)(1))
    near = {"c:3", "c:4", "p:3", "p:4", "s:1", "plain"}
    assert set(ids(graph.within_hops(edges, seeds, 1))) == near == set(ids(graph.within_hops(graph.with_ids(links), seeds, 1)))
    assert set(ids(graph.within_hops(edges.withColumn("type", F.lit(None).cast("string")), seeds, 1))) == near


def test_dangling_edges_of_either_end(spark):
    nodes = spark.createDataFrame([("a", "Post", "x"), ("b", "Post", "y")], "id string, type string, label string")
    links = [("t", "a", "b"), ("t", "a", "no"), ("t", "no", "b"), ("t", "no", "none"), ("t", "b", "a")]
    edges = graph.written(spark.createDataFrame(links, "type string, source string, target string"))
    cards = spark.createDataFrame([], "id long, role string, headline string, body string, keywords array<string>")
    got = {r["check"]: r["n"] for r in graph.validate(nodes, edges, cards, cards.select("id")).collect()}
    assert got["dangling_edges"] == 3
