"""Cards: headlines, gates, keyword roles, fan-out by role, post bodies, provenance, snippets, and pairing with notes and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as cd
from ..functions import dates, ids
from ..functions.lets import let
from . import routing

# Limits, patterns, and words that lead to roles (in this order).
BODY_LIMIT, BODY_END, LEAST_BODY = 1200, "\n…(생략)", 80
SNIPPET_LIMIT, BODY_NAME = 900, "(게시글 본문)"
BOILERPLATE = "프롬프트|【"
COLUMN_NOISE = r"col_\d+"
INVENTORY_SHEET = r"(?i)지사지점재고|소진율|재고확인|마감기준|전사재고|타사환출|히어로.*진행|생산\s*계획|종합현황"
HEADER_WORDS = ["No.", "구분", "모델명", "세트코드", "제품코드"]
KEYWORD_ROLES = [
    ("조립서비스", ["케어서비스"]), ("조립 서비스", ["케어서비스"]), ("scm서비스", ["케어서비스"]), ("scm", ["케어서비스"]), ("케어서비스", ["케어서비스"]),
    ("안심케어", ["케어서비스"]), ("입주청소", ["케어서비스"]), ("매트리스청소", ["케어서비스"]), ("선풍기", ["생활주방", "생활리빙"]), ("오클린", ["생활리빙"]),
    ("구강용품", ["생활리빙"]), ("구강", ["생활리빙"]), ("전동칫솔", ["생활리빙"]), ("냉풍기", ["생활주방", "생활리빙"]), ("계절가전", ["생활주방", "생활리빙"]),
    ("조립pc", ["IT", "PC솔루션"]), ("조립 pc", ["IT", "PC솔루션"]), ("노트북", ["IT", "PC솔루션"]), ("광고", ["공통"]), ("콘텐츠", ["공통"]), ("isp", ["공통"]),
    ("체크리스트", ["공통"]), ("냉장고", ["대형가전1", "대형가전2"]), ("에어컨", ["대형가전1", "대형가전2"]),
]
TITLE_ROLE = r"(?i)\[(대형가전1|대형가전2|생활리빙|생활주방|스마트가전|스마트폰|PC솔루션|IT|KBB|주방|Hobby|애플|케어서비스|지원)\]"


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\x0b"))


def usable(text: Column) -> Column:
    """Long enough to say something, and no boilerplate."""
    return let(strip(text), lambda t: (F.length(t) >= LEAST_BODY) & ~t.rlike(BOILERPLATE))


def shortened(text: Column, limit: int = BODY_LIMIT) -> Column:
    return let(strip(text), lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(BODY_END))).otherwise(t))


def headline(text: Column, fallback: Column, filename: Column) -> Column:
    """A bulleted line, the sheet's name, the first telling line, the file's stem, or the fallback; 120 characters at most."""
    stem = F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]*$", "")
    stem = F.when((stem != "") & ~stem.isin("Sheet1", "table0"), stem)

    def pick(lines: Column) -> Column:
        bullets = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("●")), lambda x: strip(F.substring(x, 2, 1_000_000))), lambda x: (x != "") & ~x.rlike(COLUMN_NOISE))
        sheet = strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"###\s*시트:\s*([^\n]+)", 1))
        plain = F.filter(lines, lambda x: (x != "") & ~x.startswith("###") & ~x.startswith("|") & ~x.isin(*HEADER_WORDS) & (~x.rlike(COLUMN_NOISE) | F.contains(x, F.lit("모델"))))
        rest = F.coalesce(F.when((sheet != "") & (sheet != "Sheet1"), sheet), F.get(plain, F.lit(0)), stem, fallback)
        return F.coalesce(F.get(bullets, F.lit(0)), F.when((sheet != "") & sheet.rlike(INVENTORY_SHEET), fallback), rest)

    return F.substring(let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), pick), 1, 120)


def noisy(text: Column, source_ref: Column, filename: Column) -> Column:
    """Inventory sheets, and tables without names of models or products."""
    first = F.split_part(strip(text), F.lit("\n"), F.lit(1))
    nameless = first.startswith("|") & first.rlike(COLUMN_NOISE) & ~first.rlike("모델|제품명")
    return F.concat_ws("\n", text, filename, source_ref).rlike(INVENTORY_SHEET) | nameless


def text_roles(text: Column, roster: Column) -> Column:
    """Roles of the words in a text, in the words' order, then those in brackets; of the roster only."""
    low = F.lower(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    by_word = F.flatten(F.array(*(F.when(F.contains(low, F.lit(w)), F.array(*(F.lit(r) for r in roles))).otherwise(none) for w, roles in KEYWORD_ROLES)))
    named = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TITLE_ROLE), F.lit(1))
    return F.filter(F.array_distinct(F.concat(by_word, named)), lambda r: F.array_contains(roster, r))


def record_cards(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """One card per record and role: id, role, product_codes.

    records: id, roles, product_codes. A card takes the codes of its role; where the codes lead to roles
    but none to this one, only the fallback role's card is made, with all codes.
    """
    cards = records.select("id", F.explode("roles").alias("role"), "product_codes")
    said = records.select("id", F.posexplode("product_codes").alias("pos", "code")).join(lookup.select("code", "role").distinct(), "code")
    own = said.groupBy("id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("own"))
    known = said.select("id").distinct().withColumn("known", F.lit(True))
    rows = cards.join(own, ["id", "role"], "left").join(known, "id", "left")
    kept = rows.filter(F.col("own").isNotNull() | F.col("known").isNull() | (F.col("role") == routing.FALLBACK))
    return kept.select("id", "role", F.coalesce("own", "product_codes").alias("product_codes"))


def body_cards(posts: DataFrame, lookup: DataFrame, roster: Column, covered: DataFrame | None = None) -> DataFrame:
    """Cards of posts (post_id, title, body, posted_date) whose body says something and that covered (post_id) lacks."""
    rest = posts if covered is None else posts.join(covered.select("post_id"), "post_id", "left_anti")
    text = F.concat_ws("\n", "title", shortened(F.col("body")))
    rows = rest.filter(usable(F.col("body"))).select("post_id", "title", "posted_date", shortened(F.col("body")).alias("body"), text.alias("text"), cd.product_codes(text).alias("product_codes"))
    found = routing.roles_by_codes(rows.withColumnRenamed("post_id", "id"), lookup).select(F.col("id").alias("post_id"), F.col("roles").alias("by_code"))
    none = F.array().cast("array<string>")
    rows = rows.join(found, "post_id", "left").withColumn("by_code", F.filter(F.coalesce("by_code", none), lambda r: F.array_contains(roster, r)))
    rows = rows.withColumn("roles", F.when(F.size("by_code") > 0, F.col("by_code")).otherwise(text_roles(F.col("text"), roster))).filter(F.size("roles") > 0)
    ref, head = F.concat(F.col("post_id").cast("string"), F.lit("#body")), F.substring("title", 1, 120)
    meta = dates.temporal_meta(head, F.lit(""), F.col("text"), F.col("posted_date"), F.get("roles", F.lit(0)))
    rows = rows.select("post_id", "title", "posted_date", ref.alias("source_ref"), F.lit(BODY_NAME).alias("attachment_name"), "product_codes", head.alias("headline"), "body", meta.alias("temporal"), "roles")
    rows = rows.withColumn("role", F.explode("roles")).drop("roles")
    return rows.withColumn("id", ids.card_id(F.col("source_ref"), F.col("role")))


def with_provenance(cards: DataFrame, posts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Cards whose post exists, with their attachment: by the reference's id, else by file name; and the page image it shows."""
    ref = ids.base_ref(F.col("source_ref"))
    own = cards.join(posts.select("post_id"), "post_id", "left_semi").withColumn("__ref", ref)
    by_id = attachments.select("post_id", F.col("attachment_id").alias("__ref"), F.struct("attachment_id", "path", "kind").alias("__a"))
    by_name = attachments.groupBy("post_id", F.col("filename").alias("attachment_name")).agg(F.min_by(F.struct("attachment_id", "path", "kind"), "attachment_id").alias("__b"))
    rows = own.join(by_id.dropDuplicates(["post_id", "__ref"]), ["post_id", "__ref"], "left").join(by_name, ["post_id", "attachment_name"], "left").withColumn("__c", F.coalesce("__a", "__b"))
    place = F.regexp_extract("source_ref", r"#([sp]\d+)$", 1)
    image = F.when(F.col("__c").isNotNull() & (place != ""), F.concat(F.lit("images/"), "__c.attachment_id", F.lit("_"), place, F.lit(".png")))
    return rows.select(*cards.columns, F.coalesce("__c.attachment_id", "__ref").alias("attachment_id"), F.col("__c.path").alias("attachment_path"), F.col("__c.kind").alias("attachment_kind"), image.alias("image"))


def tables_summary(tables: Column, rows: int = 5, limit: int = 2000) -> Column:
    """The first two tables' columns and first rows as text; tables is an array of struct(columns, rows)."""
    line = lambda c: F.array_join(c, " | ")
    each = F.transform(F.slice(tables, 1, 2), lambda t: F.array_join(F.concat(F.filter(F.array(line(t["columns"])), lambda x: x != ""), F.transform(F.slice(t["rows"], 1, rows), line)), "\n"))
    return F.substring(F.array_join(F.filter(each, lambda x: x != ""), "\n"), 1, limit)


def snippets(cards: DataFrame, cutoff: str | None = None) -> DataFrame:
    """What a question can be made of: usable card texts posted by cutoff, with type and label of their source."""
    rows = cards.filter(usable(F.col("body")))
    if cutoff:
        rows = rows.filter(F.col("posted_date").isNull() | (F.col("posted_date") <= F.lit(cutoff).cast("date")))
    kind = F.when(F.col("source_ref").endswith("#body"), "body").when(F.col("source_ref").rlike(r"(?i)#s\d+$"), "slide").when(F.contains(F.lower("source_ref"), F.lit(".xlsx")), "sheet").otherwise("wiki_card")
    base = F.when(F.col("attachment_name").isin("", BODY_NAME), "게시글 본문").otherwise(F.concat(F.lit("첨부: "), "attachment_name"))
    label = F.when((F.col("headline") != "") & ~F.contains(base, F.col("headline")), F.concat(base, F.lit(" · "), "headline")).otherwise(base)
    return rows.select("id", "role", "post_id", "posted_date", "source_ref", kind.alias("source_type"), label.alias("source_label"), shortened(F.col("body"), SNIPPET_LIMIT).alias("text"))


def sample_snippet(found: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """n snippets in an order that the seed decides."""
    return found.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), "id").limit(n)


def with_notes(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Pages (source_ref, ...) with the first note (source_ref, description, ord) of each."""
    first = notes.groupBy("source_ref").agg(F.min_by("description", "ord").alias("note"))
    return pages.join(first, "source_ref", "left")


def pair_sheets(tables: DataFrame, images: DataFrame, layouts: DataFrame) -> DataFrame:
    """(sheet, n_tables, n_images, has_layout) of sheets that any of the three has."""
    t = tables.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_tables"))
    i = images.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_images"))
    y = layouts.select("sheet").distinct().withColumn("has_layout", F.lit(True))
    both = t.join(i, "sheet", "full_outer").join(y, "sheet", "full_outer")
    return both.select("sheet", F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.coalesce("n_images", F.lit(0)).alias("n_images"), F.coalesce("has_layout", F.lit(False)).alias("has_layout"))


def layout_clusters(sheets: DataFrame) -> DataFrame:
    """(pattern, signature, n, example): sheets (filename, columns) grouped by file name without digits and by their column names, largest first."""
    pattern = F.regexp_replace(F.lower("filename"), r"\d+", "#")
    signature = ids.digest_id(12, F.array_join("columns", "|"))
    return sheets.groupBy(pattern.alias("pattern"), signature.alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("filename").alias("example")).orderBy(F.col("n").desc(), "pattern", "signature")


def verify_data(posts: DataFrame, roster: DataFrame, least: dict[str, int]) -> DataFrame:
    """(check, n, ok): day folders, posts, employees and managers against least numbers."""
    p = posts.agg(F.countDistinct("posted_date").alias("days"), F.count(F.lit(1)).alias("posts"))
    r = roster.agg(F.count(F.lit(1)).alias("employees"), F.count_if("is_store_manager").alias("managers"))
    counts = p.select("*", *(r.select(c).scalar().alias(c) for c in ("employees", "managers")))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n"), (F.col(k) >= v).alias("ok")) for k, v in least.items())))
    return counts.select(each.alias("c")).select("c.*")
