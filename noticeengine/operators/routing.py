"""Roles of products, records and events: look-ups, cascades and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import MAX_ROLES

# Role names with a meaning of their own, roles that count as one section, and patterns.
MANAGER, FALLBACK, NO_THEME = "점장", "공통", "미분류"
MERGED = {"대형가전1": "대형가전", "대형가전2": "대형가전"}
CROSS_CUTTING = r"(?i)광고\s*콘텐츠|콘텐츠\s*운영|연출\s*가이드|브랜드\s*마케팅|isp\s*연출|체크리스트|지점\s*체크"
BRAND_MARKETING = r"(?i)브랜드\s*마케팅|브랜드커뮤니케이션"
ROLE_IN_NAME = r"(?iU)(?:\[|\b|_)(대형가전1|대형가전2|생활리빙|생활주방|생활가전팀|스마트가전|스마트폰|모바일|PC솔루션|IT|KBB|주방|Hobby|애플|케어서비스|지원)(?:\]|담당|_|\b)"
PROMO_SHEET = "(?i)소진\\s*리스트|추가행사가|기존소진가|출하가|클리어런스|행사가"
MAX_CODES = 24


def section_of(role: Column) -> Column:
    """Section that a role is shown in."""
    out = role
    for source, target in MERGED.items():
        out = F.when(role == source, target).otherwise(out)
    return out


def roles_by_codes(rows: DataFrame, lookup: DataFrame, key: str = "id", codes: str = "product_codes") -> DataFrame:
    """(key, roles): distinct roles of a row's codes in code order; lookup is (code, role, ord)."""
    said = rows.select(key, F.posexplode(codes).alias("pos", "code"))
    found = said.join(lookup, "code").groupBy(key, "role").agg(F.min(F.struct("pos", "ord")).alias("o"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "role"))), lambda x: x["role"]).alias("roles"))


def routed_sections(rows: DataFrame, lookup: DataFrame, key: str = "id", codes: str = "product_codes") -> DataFrame:
    """(key, sections): as roles_by_codes by section; rows with more than MAX_ROLES sections are not routed."""
    found = roles_by_codes(rows, lookup, key, codes)
    return found.select(key, F.array_distinct(F.transform("roles", section_of)).alias("sections")).filter(F.size("sections") <= MAX_ROLES)


def codes_of_role(rows: DataFrame, lookup: DataFrame, role: str, key: str = "id", codes: str = "product_codes") -> DataFrame:
    """(key, codes): a row's codes that belong to a role."""
    own = lookup.filter(F.col("role") == role).select("code").distinct()
    said = rows.select(key, F.posexplode(codes).alias("pos", "code")).join(own, "code")
    return said.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])).alias("codes"))


def resolve_catalogue(items: DataFrame, master: DataFrame) -> DataFrame:
    """items (id, item_cd, item_id) with the role of the master row (item_id, item_cd, role, ord) that a cascade finds.

    By id, by code, by the code's first five characters, else the first row in file order that starts
    with its first three; each step is an equi-join with the master reduced to one row a key.
    """
    code = F.upper(F.trim(F.coalesce("item_cd", F.lit(""))))

    def first(key: Column, name: str) -> DataFrame:
        return master.groupBy(key.alias(name)).agg(F.min_by("role", "ord").alias(f"{name}_role"))

    by_code = master.groupBy(F.col("item_cd").alias("c5")).agg(F.max_by("role", "ord").alias("c5_role"))
    rows = items.withColumn("code", code).withColumn("c0", F.trim("item_id")).withColumn("c1", F.nullif(F.col("code"), F.lit(""))).withColumn("c5", F.nullif(F.substring("code", 1, 5), F.lit(""))).withColumn("c3", F.nullif(F.substring("code", 1, 3), F.lit("")))
    rows = rows.join(first(F.col("item_id"), "c0"), "c0", "left")
    rows = rows.join(by_code.select(F.col("c5").alias("c1"), F.col("c5_role").alias("c1_role")), "c1", "left").join(by_code, "c5", "left").join(first(F.substring("item_cd", 1, 3), "c3"), "c3", "left")
    return rows.select("id", F.coalesce("c0_role", "c1_role", "c5_role", "c3_role").alias("role"))


def event_sections(events: DataFrame, role_categories: DataFrame, product_only: bool = False) -> DataFrame:
    """(id, section): an event's product tags by section, else the roles of its categories, else FALLBACK; every event is the manager's too.

    events: id, categories, tags; role_categories: role, category.
    """
    tagged = F.coalesce(F.size("tags"), F.lit(0)) > 0
    by_tag = events.filter(tagged).select("id", F.explode("tags").alias("role")).select("id", section_of(F.col("role")).alias("section"))
    if product_only:
        out = by_tag
    else:
        rest = events.filter(~tagged)
        by_category = rest.select("id", F.explode("categories").alias("category")).join(role_categories, "category").filter(F.col("role") != MANAGER).select("id", section_of(F.col("role")).alias("section"))
        none = rest.join(by_category.select("id").distinct(), "id", "left_anti").select("id", F.lit(FALLBACK).alias("section"))
        out = by_tag.unionByName(by_category).unionByName(none)
    return out.unionByName(out.select("id", F.lit(MANAGER).alias("section"))).distinct()


def by_theme(events: DataFrame) -> DataFrame:
    theme = F.coalesce(F.nullif(F.trim("theme"), F.lit("")), F.lit(NO_THEME))
    return events.groupBy(theme.alias("theme")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def name_hints(filename: Column) -> Column:
    """Roles that a file name says."""
    found = F.array_distinct(F.regexp_extract_all(filename, F.lit(ROLE_IN_NAME), F.lit(1)))
    return F.array_distinct(F.concat(found, F.when(F.contains(filename, F.lit("생활가전팀")), F.array(F.lit("생활리빙"), F.lit("생활주방"))).otherwise(F.array().cast("array<string>"))))


def in_roster(roles: Column, roster: Column, hints: Column) -> Column:
    """Distinct roles that the roster has, without the manager; where a file name hints at roles, only these and the fallback."""
    known = F.filter(F.array_distinct(roles), lambda r: F.array_contains(roster, r) & (r != MANAGER))
    return F.when(F.size(hints) > 0, F.filter(known, lambda r: F.array_contains(hints, r) | (r == FALLBACK))).otherwise(known)


def is_promo_sheet(kind: Column, filename: Column, text: Column) -> Column:
    long = F.length(F.trim(F.coalesce(text, F.lit("")))) >= 60
    return (kind == "excel") & long & (F.concat_ws("\n", filename, text).rlike(PROMO_SHEET) | filename.rlike("(?i)구강용품|오클린|소진현황"))


def record_roles(category: Column, given: Column, filename: Column, title: Column, body: Column, by_code: Column, by_text: Column, n_codes: Column, roster: Column) -> Column:
    """Roles of a record, by the first rule that gives any: its own, its category, cross-cutting subjects, codes, text; file hints narrow or add.

    given, by_code and by_text are arrays of roles; roster is the array of known ones. Empty: the record is dropped.
    """
    known = lambda a: F.filter(F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), roster), lambda r: r != MANAGER)
    text = F.concat_ws("\n", title, filename, body)
    common = F.array_contains(roster, FALLBACK) & ((F.regexp_replace(F.coalesce(category, F.lit("")), r"\s+", "") == FALLBACK) | body.rlike(BRAND_MARKETING) | text.rlike(CROSS_CUTTING))
    notebook = F.contains(filename, F.lit("진열소진")) & F.contains(filename, F.lit("노트북")) & F.array_contains(roster, "PC솔루션")
    fallback = F.array(F.lit(FALLBACK))
    first = F.when(F.size(known(given)) > 0, known(given)).when(notebook, F.array(F.lit("PC솔루션"))).when(common, fallback).when(F.size(known(by_code)) > 0, known(by_code)).otherwise(known(by_text))
    hints = known(name_hints(filename))
    hinted = F.when((F.size(hints) == 0) | F.array_contains(first, FALLBACK), first).when(F.size(first) == 0, hints).otherwise(F.array_union(first, hints))
    narrowed = in_roster(F.coalesce(by_code, F.array().cast("array<string>")), roster, hints)
    return F.when((n_codes > 0) & (n_codes <= MAX_CODES) & (F.size(narrowed) > 0), narrowed).otherwise(hinted)


def fan_out(records: DataFrame, roles: str = "roles") -> DataFrame:
    """One card row per record and role."""
    return records.withColumn("role", F.explode(roles))


def routing_stats(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row: events, events with codes, events routed by codes, distinct codes and those that the look-up knows."""
    said = events.select(F.explode("product_codes").alias("code")).distinct()
    known = said.join(lookup.select("code").distinct().withColumn("known", F.lit(1)), "code", "left").agg(F.count(F.lit(1)).alias("unique_codes"), F.count("known").alias("codes_resolved"))
    routed = routed_sections(events, lookup).select("id", F.lit(1).alias("routed"))
    counts = events.join(routed, "id", "left").agg(F.count(F.lit(1)).alias("events_total"), F.count_if(F.size("product_codes") > 0).alias("events_with_codes"), F.count("routed").alias("events_product_routed"))
    return counts.select("*", *(known.select(c).scalar().alias(c) for c in ("unique_codes", "codes_resolved")))


def cards_by_role(cards: DataFrame) -> DataFrame:
    """(role, n, ids): cards of each role, all of them under the manager."""
    both = cards.select("id", "role").unionByName(cards.select("id", F.lit(MANAGER).alias("role")))
    return both.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def first_seen_roles(roster: DataFrame) -> DataFrame:
    """(role, place): distinct roles in the roster's order, the manager first."""
    roles = roster.groupBy("role").agg(F.min("ord").alias("ord"))
    return roles.select("role", F.row_number().over(W.orderBy((F.col("role") != MANAGER), "ord")).alias("place"))
