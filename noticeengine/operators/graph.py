"""The typed knowledge graph: node and edge tables, neighbourhoods, co-occurrence and structural checks.

Nodes are (id, type, label), edges (id, type, source, target) with content-derived ids, so building
is a union of projections and duplicates fall together in one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..session import in_passes, materialize, release

POST, ATTACHMENT, SLICE, CARD, PRODUCT, ROLE, KEYWORD = "Post", "Attachment", "ContentSlice", "WikiCard", "Product", "Damdang", "Keyword"
SPINE_TYPES = (POST, ATTACHMENT, SLICE, CARD, ROLE)
SPINE_EDGES = ("has_attachment", "has_slice", "summarized_as", "from_post", "relevant_to")
CATALOG_EDGES = ("mentions", "routed_to")
#: Parts, by hash, in which joins of all edges are made.
PASSES = 8


def _id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), value.cast("string"))


def post_id(c="post_id") -> Column:
    return _id("post", F.col(c))


def attachment_id() -> Column:
    return _id("att", ids.digest_id(16, F.concat_ws("_", F.col("post_id").cast("string"), F.col("attachment_name"))))


def slice_id() -> Column:
    return _id("slice", ids.digest_id(16, F.col("source_ref")))


def _routed(own: DataFrame, products: DataFrame) -> DataFrame:
    """(code, role) of the codes that cards name."""
    return own.select(F.explode("product_codes").alias("code")).distinct().join(products.filter("role <> ''"), "code")


def nodes(cards: DataFrame, posts: DataFrame, products: DataFrame, roles: DataFrame) -> DataFrame:
    """All nodes of cards whose post exists; roles (role) come whether a card has them or not.

    cards: id, role, post_id, attachment_name, source_ref, headline, keywords, product_codes; posts:
    post_id, title; products: code, role. Each card names all its nodes at once, so cards are read
    once for these and once for the roles of their products.
    """
    own = cards.join(posts.select("post_id", F.col("title").alias("__title")), "post_id")

    def node(id_: Column, kind: str, label: Column) -> Column:
        return F.struct(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"))

    single = F.array(
        node(post_id(), POST, F.substring("__title", 1, 120)),
        node(attachment_id(), ATTACHMENT, F.col("attachment_name")),
        node(slice_id(), SLICE, F.substring_index("source_ref", "#", -1)),
        node(_id("card", F.col("id")), CARD, F.substring("headline", 1, 120)),
    )
    role = F.transform(F.filter(F.array("role"), lambda r: r != ""), lambda r: node(_id("damdang", r), ROLE, r))
    products_ = F.transform("product_codes", lambda c: node(_id("product", c), PRODUCT, c))
    keywords = F.transform(F.filter("keywords", lambda k: F.trim(k) != ""), lambda k: node(ids.keyword_node(k), KEYWORD, F.trim(k)))
    named = own.select(F.explode(F.concat(single, role, products_, keywords)).alias("n")).select("n.*")
    more = roles.select("role").filter("role <> ''").unionByName(_routed(own, products).select("role")).select(node(_id("damdang", F.col("role")), ROLE, F.col("role")).alias("n")).select("n.*")
    return named.unionByName(more).groupBy("id", "type").agg(F.min("label").alias("label"))


def merged_props(nodes_: DataFrame) -> DataFrame:
    """(id, type, label, props) of node mentions (id, type, label, props: map, ord): the first mention's label, of each property the last mention's value."""
    first = nodes_.groupBy("id").agg(F.min_by(F.struct("type", "label"), "ord").alias("n"))
    each = nodes_.select("id", "ord", F.explode("props").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    props = each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return first.join(props, "id", "left").select("id", "n.type", "n.label", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def role_subgraphs(nodes_: DataFrame, edges_: DataFrame, cards: DataFrame) -> DataFrame:
    """(role, id): for every role at once, its cards and all that they touch. Found by the cards' hashes, made distinct by the nodes'."""
    own = materialize(cards.filter(F.col("role") != "").select("role", _id("card", F.col("id")).alias("id")), "role-cards", compact=True)
    ends, spark = _ends_of(edges_, own), own.sparkSession
    parts = [materialize(ends(i).join(_slice(own, "id", i), "id").select("role", F.col("other").alias("id")).distinct(), "touched", compact=True) for i in range(PASSES)]
    touched = reduce(DataFrame.unionByName, [own, *parts])
    found = in_passes(spark, lambda i: _slice(touched, "id", i).distinct().join(_slice(nodes_.select("id"), "id", i), "id", "left_semi").select("role", "id"), PASSES, "role-subgraphs")
    for old in (own, *parts):
        release(old)
    return found


def _pairs(codes: Column) -> Column:
    """(a, b) of all codes a before b."""
    n = F.size(codes)
    return F.flatten(F.transform(codes, lambda a, i: F.transform(F.slice(codes, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.struct(_id("product", a).alias("source"), _id("product", b).alias("target")))))


def co_occurrence(cards: DataFrame) -> DataFrame:
    """(source, target) product pairs of a card, in the order of its codes; a card's own list bounds the pairs."""
    return cards.select(F.explode(_pairs(F.col("product_codes"))).alias("p")).select("p.source", "p.target")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (source, target). Only pairs whose 64-bit hash occurs again can be equal, so hashes are shuffled for all pairs and the pairs themselves for those alone."""
    hashed = pairs.withColumn("h", F.xxhash64("source", "target"))
    again = materialize(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated-pairs", compact=True)
    return hashed.join(again, "h", "left_anti").drop("h").unionByName(hashed.join(again, "h", "left_semi").drop("h").distinct())


def _named(kind: str, source: Column, target: Column) -> tuple[Column, Column, Column]:
    return F.lit(kind).alias("type"), source.alias("source"), target.alias("target")


def links(cards: DataFrame, posts: DataFrame, products: DataFrame) -> DataFrame:
    """(type, source, target) of all edges; those of one type and ends are one. cards are read several times.

    An edge that ends in a card is named by that card alone and needs no shuffle, unless its id occurs
    again. Edges between what cards share fall together by the bytes of their digests.
    """
    own = cards.join(posts.select("post_id"), "post_id", "left_semi")
    card, post, role = _id("card", F.col("id")), post_id(), _id("damdang", F.col("role"))

    def edge(kind: str, source: Column, target: Column) -> Column:
        return F.struct(*_named(kind, source, target))

    words = F.filter("keywords", lambda k: F.trim(k) != "")
    ends = F.array_distinct(
        F.concat(
            F.array(edge("summarized_as", slice_id(), card), edge("from_post", card, post), edge("cites_attachment", card, attachment_id())),
            F.filter(F.array(edge("relevant_to", card, role)), lambda e: F.col("role") != ""),
            F.transform(words, lambda k: edge("tagged_with", card, ids.keyword_node(k))),
            F.transform("product_codes", lambda c: edge("mentions", card, _id("product", c))),
        )
    )
    again = materialize(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").select("id"), "repeated-cards", compact=True)
    each = lambda rows: rows.select(F.explode(ends).alias("e")).select("e.*")
    single = each(own.join(again, "id", "left_anti").filter("id IS NOT NULL"))
    repeated = each(own.join(again, own["id"].eqNullSafe(again["id"]), "left_semi")).distinct()

    raw = lambda x: F.unhex(F.substring_index(x, ":", -1))
    text = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.lower(F.hex(c)))
    att, piece = raw(attachment_id()).alias("att"), raw(slice_id()).alias("slice")
    has_attachment = own.select(post.alias("post"), att).distinct().select(*_named("has_attachment", F.col("post"), text("att", F.col("att"))))
    has_slice = own.select(att, piece).distinct().select(*_named("has_slice", text("att", F.col("att")), text("slice", F.col("slice"))))
    said = own.select(post.alias("post"), F.explode(F.transform(words, lambda k: raw(ids.keyword_node(k)))).alias("k")).distinct()
    in_post = said.select(*_named("keyword_in_post", F.col("post"), text("kw", F.col("k"))))
    routed = _routed(own, products).select(*_named("routed_to", _id("product", F.col("code")), role)).distinct()
    together = _distinct_pairs(co_occurrence(own)).select(*_named("co_occurs", F.col("source"), F.col("target")))
    return reduce(DataFrame.unionByName, [single, repeated, has_attachment, has_slice, in_post, routed, together])


def with_ids(links_: DataFrame) -> DataFrame:
    return links_.select(ids.edge_id(F.col("type"), F.col("source"), F.col("target")).alias("id"), "type", "source", "target", *(c for c in links_.columns if c == _PART))


def written(links_: DataFrame) -> DataFrame:
    """Edges with their ids, of links() that are written once for many reads: a pass over sources reads its own folder alone."""
    return with_ids(materialize(links_.withColumn(_PART, _part("source")), "kg", compact=True, by=_PART))


def edges(cards: DataFrame, posts: DataFrame, products: DataFrame) -> DataFrame:
    """All edges: links() with their ids."""
    return with_ids(links(cards, posts, products))


def stats(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    both = nodes_.select(F.lit("node").alias("what"), "type").unionByName(edges_.select(F.lit("edge").alias("what"), "type"))
    return both.groupBy("what", "type").agg(F.count(F.lit(1)).alias("n"))


def _ends(edges_: DataFrame) -> DataFrame:
    """(id, other) of every edge from both of its ends."""
    return edges_.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("e")).select("e.*")


def neighbours(edges_: DataFrame, frontier: DataFrame) -> DataFrame:
    """Ids one undirected step from the frontier (id)."""
    return _ends(edges_).join(frontier.select("id"), "id", "left_semi").select(F.col("other").alias("id"))


#: Column of written edges: the pass of their source.
_PART = "__part"


def _part(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PASSES)).cast("int")


def _slice(df: DataFrame, column: str, i: int) -> DataFrame:
    return df.filter((F.col(_PART) if column == "source" and _PART in df.columns else _part(column)) == i)


#: Kinds of edges and ends up to which they are told apart before a join.
KINDS = 1000


def _ends_of(edges_: DataFrame, seeds: DataFrame):
    """Of a pass i, (id, other) of the edges from those of their ends that may be seeds (id): types of edges none of whose ends are of a seed's kind, as its id begins, are not read."""
    kind = lambda c: F.substring_index(c, ":", 1)
    own = {r[0] for r in seeds.select(kind("id")).distinct().limit(KINDS + 1).collect()}
    told = edges_.select("type", kind("source").alias("s"), kind("target").alias("t")).distinct().limit(KINDS + 1).collect()
    sure = len(own) <= KINDS and len(told) <= KINDS and all(r["type"] is not None for r in told)

    def side(i: int, end: str, other: str) -> DataFrame:
        some = edges_.filter(F.col("type").isin(sorted({r["type"] for r in told if r[end[0]] in own}))) if sure else edges_
        return _slice(some, end, i).select(F.col(end).alias("id"), F.col(other).alias("other"))

    return lambda i: side(i, "source", "target").unionByName(side(i, "target", "source"))


def within_hops(edges_: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Ids at most hops undirected steps from the seeds (id).

    A hop only keeps the edges that touch an id reached so far (semi joins, which a hub's many edges pass
    without being multiplied). It goes in passes over the ids' hashes and is written, so that each hop
    reads the one before it and only a pass's share of the edges is shuffled at a time.
    """
    reached = materialize(seeds.select("id").distinct(), "reached", compact=True)
    for _ in range(hops):
        ends = _ends_of(edges_, reached)
        parts = [materialize(ends(i).join(_slice(reached, "id", i), "id", "left_semi").select(F.col("other").alias("id")).distinct(), "step", compact=True) for i in range(PASSES)]
        found = materialize(reduce(DataFrame.unionByName, [reached, *parts]).distinct(), "reached", compact=True)
        for old in (reached, *parts):
            release(old)
        reached = found
    return reached


def role_cards(cards: DataFrame, role: str) -> DataFrame:
    return cards.filter(F.col("role") == role).select(_id("card", F.col("id")).alias("id"))


def induced(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes_.select("id")
    return edges_.join(own.select(F.col("id").alias("source")), "source", "left_semi").join(own.select(F.col("id").alias("target")), "target", "left_semi")


def induced_ids(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(id, type) of the edges with both ends among the nodes, found and written in passes; the ids lie there as bytes."""
    own = materialize(nodes_.select("id"), "ends", compact=True)

    def part(i: int) -> DataFrame:
        left = _slice(edges_, "source", i).join(_slice(own, "id", i).select(F.col("id").alias("source")), "source", "left_semi")
        return left.join(own.select(F.col("id").alias("target")), "target", "left_semi")

    found = in_passes(own.sparkSession, lambda i: part(i).select(F.unhex("id").alias("raw"), "type"), PASSES, "induced")
    return found.select(F.lower(F.hex("raw")).alias("id"), "type")


def subgraph(nodes_: DataFrame, edges_: DataFrame, cards: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """The role's cards with what they touch, and the edges between these."""
    found = nodes_.join(within_hops(edges_, role_cards(cards, role), 1), "id", "left_semi")
    return found, induced(found, edges_)


def view(nodes_: DataFrame, edges_: DataFrame, cards: DataFrame, role: str | None = None, mode: str = "spine", include_products: bool = False, include_co_occurs: bool = False, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a picture: by mode's white lists, and within hops of a role and its cards over all edges."""
    if mode == "full":
        types = None if include_products else list(SPINE_TYPES)
        kinds = None if include_co_occurs else ["has_attachment", "has_slice", "summarized_as", "from_post", "cites_attachment", "relevant_to", "tagged_with", "keyword_in_post", "mentions", "routed_to"]
    elif mode == "cards":
        types = [CARD, POST, ATTACHMENT, ROLE]
        kinds = ["from_post", "cites_attachment", "relevant_to", "mentions", "routed_to"]
    else:
        types, kinds = list(SPINE_TYPES), list(SPINE_EDGES)
    if include_products and types is not None:
        types = [*types, PRODUCT]
        kinds = list(dict.fromkeys([*(kinds or []), *CATALOG_EDGES]))
    shown = nodes_
    if role is not None:
        seeds = nodes_.filter((F.col("type") == ROLE) & (F.col("label") == role)).select("id").unionByName(role_cards(cards, role))
        shown = shown.join(within_hops(edges_, seeds, hops), "id", "left_semi")
    if types is not None:
        shown = shown.filter(F.col("type").isin(*types))
    links = edges_ if kinds is None else edges_.filter(F.col("type").isin(*kinds))
    return shown, induced(shown, links)


def cards_by_product(edges_: DataFrame, code: str) -> DataFrame:
    return edges_.filter((F.col("type") == "mentions") & (F.col("target") == f"product:{code}")).select(F.col("source").alias("id"))


def validate(nodes_: DataFrame, edges_: DataFrame, cards: DataFrame, index: DataFrame, sample: int = 20) -> DataFrame:
    """(check, n, samples, soft) of eleven structural checks. index has the card ids (id) of the card index.

    The graph is sound if every check but the soft one counts nothing.
    """
    known = nodes_.filter(F.col("type") == ROLE).select(F.col("label").alias("role"))
    cid = F.col("id").cast("string").alias("what")
    ids_ = nodes_.select("id")

    def without_edge(kind: str) -> DataFrame:
        having = edges_.filter(F.col("type") == kind).select(F.col("source").alias("node"))
        return cards.withColumn("node", _id("card", F.col("id"))).join(having, "node", "left_anti").select(cid)

    known_ends = ids_.select(F.col("id").alias("end"))

    def dangling_of(i: int) -> DataFrame:
        """Of the pass's sources, whose nodes are of the same pass, and of their edges' targets, whose nodes are any."""
        own = _slice(edges_, "source", i)
        no_source = own.select("id", F.col("source").alias("end")).join(_slice(known_ends, "end", i), "end", "left_anti")
        return no_source.unionByName(own.select("id", F.col("target").alias("end")).join(known_ends, "end", "left_anti")).select(F.col("id").alias("what"))

    dangling = in_passes(cards.sparkSession, dangling_of, PASSES, "dangling")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    checks = {
        "cards_missing_damdang": cards.filter(blank("role")).select(cid),
        "cards_unknown_damdang": cards.filter(~blank("role")).join(known, "role", "left_anti").select(cid),
        "cards_no_text": cards.filter(blank("headline") & blank("body")).select(cid),
        "cards_missing_keywords": cards.filter(F.coalesce(F.size("keywords"), F.lit(0)) <= 0).select(cid),
        "cards_no_post_edge": without_edge("from_post"),
        "cards_no_attachment_edge": without_edge("cites_attachment"),
        "cards_no_damdang_edge": without_edge("relevant_to"),
        "dangling_edges": dangling.distinct(),
        "duplicate_slice_cards": edges_.filter("type = 'summarized_as'").groupBy("source").count().filter("count > 1").select(F.col("source").alias("id")).join(ids_, "id", "left_semi").select(F.col("id").alias("what")),
        "card_index_missing_nodes": index.join(cards.select("id"), "id", "left_anti").select(cid),
        "card_nodes_missing_index": cards.join(index.select("id"), "id", "left_anti").select(cid),
    }
    names = cards.sparkSession.createDataFrame([(k, k == "cards_missing_keywords") for k in checks], "check string, soft boolean")
    # Each check's finds are written before the next is made, so that their shuffles don't add up.
    every = reduce(DataFrame.unionByName, [materialize(df, "finds", compact=True).withColumn("check", F.lit(k)) for k, df in checks.items()])
    counted = every.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    first = every.withColumn("r", F.row_number().over(W.partitionBy("check").orderBy("what"))).filter(F.col("r") <= sample).groupBy("check").agg(F.sort_array(F.collect_list("what")).alias("samples"))
    return names.join(counted, "check", "left").join(first, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), "samples", "soft")
