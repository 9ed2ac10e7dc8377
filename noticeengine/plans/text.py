"""Queries of text, code and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import brands, codes, dates, ids, text
from ..sources import driver_tables as T

QUERIES, ORACLES = {}, {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


_JOSA = text.PARTICLE_END
_TOKENS = rf"flatten(list_transform(list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda x: length(x) >= 2), lambda t: CASE WHEN regexp_replace(t, '{_JOSA}', '\1') <> t THEN [t, regexp_replace(t, '{_JOSA}', '\1')] ELSE [t] END))"


def _tokens(spark, d):
    t = T.read(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


_add("tokenize_dual_emit", _tokens, f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")

_NOUNS = ["냉장고", "세탁기", "노트북", "가", "정수기 필터", "V8100", "에어컨"]
_ENDS = ["는", "에서는", "으로", "", "까지도", "은", "의", "부터", "보다"]
_TOKEN = "element_at(array({}), cast(p_partkey % {} as int) + 1)"


def _sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _particles(spark, d):
    word = F.expr(f"concat({_TOKEN.format(_sql_list(_NOUNS), len(_NOUNS))}, {_TOKEN.format(_sql_list(_ENDS), len(_ENDS))})")
    return T.read(spark, d, "part").select("p_partkey", word.alias("token")).select("p_partkey", "token", text.strip_particle(F.col("token")).alias("stem"), F.array_join(text.keyword_variants(F.col("token")), "|").alias("variants"))


_add(
    "strip_josa",
    _particles,
    rf"""SELECT p_partkey, token, regexp_replace(token, '{_JOSA}', '\1') AS stem, CASE WHEN regexp_replace(token, '{_JOSA}', '\1') <> token THEN token || '|' || regexp_replace(token, '{_JOSA}', '\1') ELSE token END AS variants
FROM (SELECT p_partkey, [{_sql_list(_NOUNS)}][p_partkey % {len(_NOUNS)} + 1] || [{_sql_list(_ENDS)}][p_partkey % {len(_ENDS)} + 1] AS token FROM part)""",
)


def _keywords(spark, d):
    k = T.read(spark, d, "documents").select("doc_id", F.array_sort(text.keyword_set(F.col("text"))).alias("k"))
    return k.select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ").cast("binary")).alias("keywords_md5"))


_STOP = _sql_list(text.KEYWORD_STOPWORDS)
_KW = f"list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(text, '{text.HANGUL_WORD}'), list_transform(regexp_extract_all(text, '{text.LATIN_WORD}'), lambda x: lower(x))), lambda x: NOT list_contains([{_STOP}], x))))"
_add("keyword_set", _keywords, f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n, md5(array_to_string(k, ' ')) AS keywords_md5 FROM (SELECT doc_id, {_KW} AS k FROM documents)")


def card_keywords(limit: int = 40):
    """The longest keywords of a card's title, headline and body, ties by code point."""
    every = F.array_distinct(F.concat(*(text.keyword_set(F.col(c)) for c in ("post_title", "attachment_name", "headline", "body"))))
    by_length = F.array_sort(every, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.slice(by_length, 1, limit)


_CK = _KW.replace("(text, ", "(blob, ")
_add(
    "card_keywords",
    lambda s, d: T.cards(s, d).select("id", F.array_join(card_keywords(), " ").alias("keywords")),
    f"WITH {T.CARDS_SQL}, k AS (SELECT id, unnest({_CK}) AS k FROM (SELECT id, post_title || ' ' || attachment_name || ' ' || headline || ' ' || body AS blob FROM ca)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(k) DESC, k) AS n FROM k) SELECT ca.id, coalesce(string_agg(k, ' ' ORDER BY n), '') AS keywords FROM ca LEFT JOIN r ON r.id = ca.id AND r.n <= 40 GROUP BY ca.id",
)
_add(
    "question_keywords",
    lambda s, d: T.questions(s, d).select("question_id", F.array_join(text.question_keywords(F.col("question")), " ").alias("keywords")),
    rf"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '{text.TOKEN}')) AS w, generate_subscripts(regexp_extract_all(text, '{text.TOKEN}'), 1) AS p FROM benchmark),
f AS (SELECT item_id, w, min(p) AS p, lower(w) AS k FROM t WHERE length(w) >= 2 GROUP BY item_id, w), g AS (SELECT item_id, k, arg_min(w, p) AS w, min(p) AS p FROM f GROUP BY item_id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS n FROM g)
SELECT b.item_id AS question_id, coalesce(string_agg(w, ' ' ORDER BY n), '') AS keywords FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND n <= 8 GROUP BY b.item_id""",
)
_add(
    "normalize_title",
    lambda s, d: T.read(s, d, "part").select("p_partkey", text.normalize_title(F.concat(F.lit("[A] "), "p_name", F.lit("  (b) "), "p_type")).alias("title")),
    r"SELECT p_partkey, lower(trim(regexp_replace(regexp_replace('[A] ' || p_name || '  (b) ' || p_type, '[\[\(（][^\]\)）]*[\]\)）]', '', 'g'), '\s+', ' ', 'g'))) AS title FROM part",
)

_CODE_TEXT = "concat('see PLX-', lpad(cast(p_partkey as string), 5, '0'), ' and INS-FAN(STAND), v8', cast(p_size as string), '_BK manual.PDF BD-N', cast(p_partkey % 900 + 100 as string), 'P; INS-FAN again PLX-', lpad(cast(p_partkey as string), 5, '0'))"
_CODE_SQL = _CODE_TEXT.replace("as string", "as varchar")
_P, _S = (p.removeprefix("(?U)") for p in (codes.PRODUCT_CODE, codes.SERVICE_CODE))


def _codes(spark, d):
    t = T.read(spark, d, "part").select("p_partkey", F.expr(_CODE_TEXT).alias("t"))
    return t.select("p_partkey", F.array_join(codes.product_codes(F.col("t")), ",").alias("codes"))


_add(
    "extract_codes",
    _codes,
    rf"""WITH t AS (SELECT p_partkey, upper(regexp_replace({_CODE_SQL}, '(?i)\.(PNG|JPG|JPEG|GIF|WEBP|PDF|PPTX?|XLSX?|XLSB|DOCX?|HWPDX?)\b', '', 'g')) AS t FROM part),
u AS (SELECT p_partkey, list_distinct(regexp_extract_all(t, '{_S}')) AS s, regexp_extract_all(t, '{_S}') AS so, regexp_extract_all(t, '{_P}') AS po FROM t),
o AS (SELECT p_partkey, 0 AS tier, unnest(so) AS c, generate_subscripts(so, 1) AS n, s FROM u UNION ALL SELECT p_partkey, 1, unnest(po), generate_subscripts(po, 1), s FROM u),
f AS (SELECT p_partkey, c, min(tier * 1000 + n) AS n FROM o WHERE tier = 0 OR len(list_filter(s, lambda x: starts_with(x, c || '('))) = 0 GROUP BY 1, 2)
SELECT p_partkey, string_agg(c, ',' ORDER BY n) AS codes FROM f GROUP BY 1""",
)
_add(
    "extract_skus",
    lambda s, d: T.read(s, d, "part").select("p_partkey", F.array_join(codes.model_skus(F.expr(_CODE_TEXT)), ",").alias("skus")),
    rf"SELECT p_partkey, array_to_string(list_distinct(regexp_extract_all(upper({_CODE_SQL}), '\b(?:\(J\))?[A-Z][A-Z0-9]{{2,}}_[A-Z0-9]{{2,}}\b')), ',') AS skus FROM part",
)
_add(
    "content_ids",
    lambda s, d: T.cards(s, d).select("id", ids.event_id(F.col("post_id").cast("string"), F.col("post_title")).alias("event_id"), ids.card_id(F.col("source_ref"), F.col("role")).alias("card_id"), ids.edge_id(F.lit("from_post"), F.col("source_ref"), F.col("role")).alias("edge_id"), ids.base_ref(F.col("source_ref")).alias("base"), text.attachment_stem(F.col("attachment_name")).alias("stem"), ids.attachment_kind(F.col("attachment_name")).alias("kind"), ids.url_path("/media", F.col("post_title")).alias("url")),
    f"WITH {T.CARDS_SQL} SELECT id, left(sha1(post_id || '|' || post_title), 16) AS event_id, left(sha1(source_ref || '|' || role), 16) AS card_id, left(sha1('from_post|' || source_ref || '|' || role), 16) AS edge_id, regexp_replace(source_ref, '#[^#]*$', '') AS base, 'guide_' || (id % 40) AS stem, 'excel' AS kind, '/media/' || replace(post_title, ' ', '%20') AS url FROM ca",
)


def _spark_text() -> str:
    d, e = "d", "date_add(d, 5)"
    f = lambda x, p: f"date_format({x}, '{p}')"
    return (
        f"CASE k % 9 WHEN 0 THEN concat('promo ', {f(d, 'yyyy.MM.dd')}, ' ~ ', {f(e, 'yyyy.MM.dd')}) WHEN 1 THEN concat({f(d, 'M/d')}, '~', {f(e, 'M/d')}, ' sale')"
        f" WHEN 2 THEN concat({f(d, 'M/d')}, '~28 only, ', {f(e, 'M/d')}, '~28') WHEN 3 THEN concat('from ', {f(d, 'yyyy-MM-dd')}) WHEN 4 THEN concat({f(d, 'M')}, '월 ', {f(d, 'd')}, '일부터 변경')"
        f" WHEN 5 THEN concat('시행일: ', {f(d, 'yyyy.MM.dd')}, ' 개정') WHEN 6 THEN '2/30~2/31 할인 재고' WHEN 7 THEN concat({f(d, 'M')}, '월 ', {f(d, 'd')}, '일 적용 안내') ELSE '공지 없음' END"
    )


def _duck_text() -> str:
    d, e = "d", "(d + 5)"
    f = lambda x, p: f"strftime({x}, '{p}')"
    return (
        f"CASE k % 9 WHEN 0 THEN concat('promo ', {f(d, '%Y.%m.%d')}, ' ~ ', {f(e, '%Y.%m.%d')}) WHEN 1 THEN concat({f(d, '%-m/%-d')}, '~', {f(e, '%-m/%-d')}, ' sale')"
        f" WHEN 2 THEN concat({f(d, '%-m/%-d')}, '~28 only, ', {f(e, '%-m/%-d')}, '~28') WHEN 3 THEN concat('from ', {f(d, '%Y-%m-%d')}) WHEN 4 THEN concat({f(d, '%-m')}, '월 ', {f(d, '%-d')}, '일부터 변경')"
        f" WHEN 5 THEN concat('시행일: ', {f(d, '%Y.%m.%d')}, ' 개정') WHEN 6 THEN '2/30~2/31 할인 재고' WHEN 7 THEN concat({f(d, '%-m')}, '월 ', {f(d, '%-d')}, '일 적용 안내') ELSE '공지 없음' END"
    )


def _dated(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    return o.select("k", "d", F.expr(_spark_text()).alias("t"), F.year("d").alias("y"))


_DATED = f"dt AS (SELECT k, d, {_duck_text()} AS t, CAST(year(d) AS VARCHAR) AS y FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders))"
_DAY = r"(20\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})"
_R = {"iso": _DAY + r"\s*[~\-–]\s*" + _DAY, "md": r"(\d{1,2})/(\d{1,2})\s*[~\-–]\s*(\d{1,2})/(\d{1,2})", "short": r"(\d{1,2})/(\d{1,2})\s*[~\-–]\s*(\d{1,2})(?:[^\d/]|$)", "one": _DAY}


def _duck_day(y: str, m: str, n: str) -> str:
    return f"CAST(try_strptime({y} || '-' || {m} || '-' || {n}, '%Y-%m-%d') AS DATE)"


def _x(t: str, p: str, i: int) -> str:
    return f"regexp_extract({t}, '{_R.get(p, p)}', {i})"


def _duck_range(t: str, y: str) -> tuple[str, str]:
    full = [
        (_duck_day(*(_x(t, "iso", i) for i in (1, 2, 3))), _duck_day(*(_x(t, "iso", i) for i in (4, 5, 6)))),
        (_duck_day(y, _x(t, "md", 1), _x(t, "md", 2)), _duck_day(y, _x(t, "md", 3), _x(t, "md", 4))),
        (_duck_day(y, _x(t, "short", 1), _x(t, "short", 2)), _duck_day(y, _x(t, "short", 1), _x(t, "short", 3))),
    ]
    one = _duck_day(*(_x(t, "one", i) for i in (1, 2, 3)))
    case = lambda i: "CASE " + " ".join(f"WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {(a, b)[i]}" for a, b in full)
    return f"{case(0)} ELSE {one} END", f"{case(1)} END"


_FROM, _TO = _duck_range("t", "y")
_add(
    "parse_validity",
    lambda s, d: _dated(s, d).select("k", dates.validity_range(F.col("t"), F.col("y")).alias("w")).select("k", F.col("w.from").cast("string").alias("valid_from"), F.col("w.to").cast("string").alias("valid_to")),
    f"WITH {_DATED} SELECT k, CAST({_FROM} AS VARCHAR) AS valid_from, CAST({_TO} AS VARCHAR) AS valid_to FROM dt",
)
_PF, _PT = _duck_range("p", "y")
_add(
    "parse_all_validity",
    lambda s, d: _dated(s, d).select("k", F.array_join(F.transform(dates.all_validity_ranges(F.col("t"), F.col("y")), lambda w: F.concat(w["from"].cast("string"), F.lit(".."), F.coalesce(w["to"].cast("string"), F.lit("")))), ",").alias("windows")),
    rf"""WITH {_DATED}, pt AS (SELECT k, y, unnest(regexp_split_to_array(t, '[,;]\s*')) AS p, generate_subscripts(regexp_split_to_array(t, '[,;]\s*'), 1) AS n FROM dt),
w AS (SELECT k, n, {_PF} AS f, {_PT} AS e FROM pt), g AS (SELECT k, f, e, min(n) AS n FROM w WHERE f IS NOT NULL GROUP BY 1, 2, 3)
SELECT dt.k, coalesce(string_agg(CAST(f AS VARCHAR) || '..' || coalesce(CAST(e AS VARCHAR), ''), ',' ORDER BY n) FILTER (f IS NOT NULL), '') AS windows FROM dt LEFT JOIN g ON g.k = dt.k GROUP BY dt.k""",
)
_FROM_DAY = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일(?:부터|부|부터\s*적용|부\s*변경|부터\s*시행)"
_MD = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
_LAB = [p + _DAY for p in (r"시행(?:일)?\s*[:：]?\s*", r"적용(?:일)?\s*[:：]?\s*")]
_EFF = (
    f"CASE WHEN regexp_matches(t, '{_FROM_DAY}') THEN {_duck_day('y', _x('t', _FROM_DAY, 1), _x('t', _FROM_DAY, 2))} "
    + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {_duck_day(*(_x('t', p, i) for i in (1, 2, 3)))}" for p in _LAB)
    + f" WHEN regexp_matches(t, '{_MD}') AND regexp_matches(t, '시행|적용|변경|개정') THEN {_duck_day('y', _x('t', _MD, 1), _x('t', _MD, 2))} END"
)
_add("effective_date", lambda s, d: _dated(s, d).select("k", dates.effective_date(F.col("t"), F.col("y")).cast("string").alias("effective")), f"WITH {_DATED} SELECT k, CAST({_EFF} AS VARCHAR) AS effective FROM dt")
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}'){' OR vt IS NOT NULL' if k == '판촉' else ''} THEN '{k}'" for k, w in dates.KIND_WORDS) + " ELSE '기타' END"


def _meta(spark, d):
    m = _dated(spark, d).select("k", dates.temporal_meta(F.lit(""), F.lit(""), F.col("t"), F.col("d"), F.lit("role")).alias("m"))
    return m.select("k", "m.notice_kind", *(F.col(f"m.{c}").cast("string").alias(c) for c in ("valid_from", "valid_to", "effective_date")))


_add(
    "temporal_meta",
    _meta,
    f"""WITH {_DATED}, a AS (SELECT *, {_FROM} AS vf, {_TO} AS vt, {_EFF} AS ef FROM dt), b AS (SELECT *, {_KIND} AS kind FROM a)
SELECT k, kind AS notice_kind, CAST(vf AS VARCHAR) AS valid_from, CAST(vt AS VARCHAR) AS valid_to, CAST(coalesce(ef, CASE WHEN kind = '정책' THEN d END) AS VARCHAR) AS effective_date FROM b""",
)


def _table_windows(spark, d):
    """Each customer's orders as a table with a date column."""
    rows = _dated(spark, d).join(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "k")
    tables = rows.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: F.array(x["k"].cast("string"), x["t"])).alias("rows"))
    windows = dates.table_windows(F.array(F.lit("No"), F.lit("행사 기간")), F.col("rows"), F.lit(1999))
    return tables.select("c", F.array_join(F.array_sort(F.transform(windows, lambda w: F.concat(w["from"].cast("string"), F.lit(".."), F.coalesce(w["to"].cast("string"), F.lit(""))))), ",").alias("windows"))


_WF, _WT = _duck_range("p", "'1999'")
_add(
    "table_windows",
    _table_windows,
    rf"""WITH {_DATED}, pt AS (SELECT k, unnest(regexp_split_to_array(t, '[,;]\s*')) AS p FROM dt), w AS (SELECT DISTINCT o.o_custkey AS c, {_WF} AS f, {_WT} AS e FROM pt JOIN orders o ON o.o_orderkey = pt.k)
SELECT c, coalesce(string_agg(CAST(f AS VARCHAR) || '..' || coalesce(CAST(e AS VARCHAR), ''), ',' ORDER BY CAST(f AS VARCHAR) || '..' || coalesce(CAST(e AS VARCHAR), '')) FILTER (f IS NOT NULL), '') AS windows FROM w GROUP BY c""",
)
_BRANDS = ["삼성전자 냉장고", "LG/삼성 가전", "플럭스 에어컨", "plx-100 다이슨", "note", "Apple tcl"]


def _brands(spark, d):
    t = F.concat(F.element_at(F.array(*(F.lit(b) for b in _BRANDS)), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit(" "), F.col("p_name"))
    tags = brands.card_brands(t)
    return T.read(spark, d, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"), *(brands.compatible(tags, F.array(*(F.lit(x) for x in r))).alias(n) for n, r in (("for_samsung", ["삼성"]), ("for_own", ["PLUX"]))), brands.display_title(F.col("p_name"), t).alias("title"))


_TAGGED = "array_to_string(list_filter([" + "CASE WHEN regexp_matches(t, 'plux|플럭스|plx-|하이마트 pb|\\[pb\\]') THEN 'PLUX' END, " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{a}{chr(39)})' for a, b in brands.ALIASES if b == label)} THEN '{label}' END" for label in dict.fromkeys(b for _, b in brands.ALIASES if b != "PLUX")) + "], lambda x: x IS NOT NULL), ',')"
_add(
    "brand_tags",
    _brands,
    f"""WITH a AS (SELECT p_partkey, p_name, [{_sql_list(_BRANDS)}][p_partkey % 6 + 1] || ' ' || p_name AS o FROM part), b AS (SELECT *, lower(o) AS t FROM a), c AS (SELECT *, {_TAGGED} AS g FROM b), e AS (SELECT *, ',' || g || ',' AS h FROM c)
SELECT p_partkey, CASE WHEN g = '' THEN '미분류' ELSE g END AS tags, g <> 'PLUX' AND contains(h, ',삼성,') AS for_samsung, contains(h, ',PLUX,') AS for_own, o AS title FROM e""",
)
