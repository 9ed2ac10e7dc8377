"""Chat formatting of typed content parts.

A turn's content is an array of parts: text, image, audio or document. A visitor flattens them in
order: text is escaped, every other part becomes a placeholder `<|kind|>` whose reference and
expanded token count are recorded. A turn is written `<|turn|>role<|say|>content<|end|>`; the
conversation is `<|chat|>` and its turns in order. The loss mask is a list of character spans, one
for the content of each assistant turn.

Escaping is reversible: every backslash is doubled, and a backslash is put after the first character
of every control string, those of this template and the common ones of others. `unescape` drops the
backslash of each pair again.

Defined cases: null text is empty text; a null role is an empty role; null parts are skipped; a part
of an unknown kind is read as text; rows of one conversation go by turn (null first), then role, then
text, so ties and repeated rows have one order; null conversation ids form one conversation; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHAT, TURN, SAY, END = "<|chat|>", "<|turn|>", "<|say|>", "<|end|>"
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels on a side of an image patch, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25.0, 1024


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<)(?=\||/?s>)|(\[)(?=/?INST\]|/?SYS\])", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for; sizes that are null or not positive count as 1."""

    def at_least_one(x: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.coalesce(F.ceil(x), F.lit(1)).cast("long"))

    image = at_least_one(part["width"] / PATCH) * at_least_one(part["height"] / PATCH)
    return F.when(part["kind"] == "image", image).when(part["kind"] == "audio", at_least_one(part["seconds"] * AUDIO_RATE)).when(part["kind"] == "document", at_least_one(part["pages"]) * PAGE_TOKENS).otherwise(F.lit(0).cast("long"))


def visit_parts(parts: Column) -> Column:
    """Flattened content of an array of parts."""
    known = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    return F.array_join(F.transform(known, lambda p: F.when(p["kind"].isin(*KINDS), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escape(p["text"]))), "")


def text_parts(text: Column) -> Column:
    """One text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts to one row a conversation: conv_id, formatted, loss_spans, attachments, n_placeholder_tokens."""
    role = F.coalesce(F.col("role"), F.lit(""))
    flat = turns.select("conv_id", "turn", role.alias("role"), "parts", visit_parts(F.col("parts")).alias("content"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAY))
    flat = flat.withColumn("segment", F.concat(head, F.col("content"), F.lit(END))).withColumn("head", F.length(head))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content", F.to_json("parts"))
    media = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull() & p["kind"].isin(*KINDS))
    placed = flat.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        "segment",
        F.transform(media, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("media"),
        (len(CHAT) + F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("head")).alias("start"),
        F.length("content").alias("length"),
        (F.col("role") == "assistant").alias("loss"),
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "segment", "media", "start", "length", "loss"))).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: F.transform(x["media"], lambda m: F.struct(x["n"].alias("turn"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    return rows.select(
        "conv_id",
        F.concat(F.lit(CHAT), F.array_join(F.transform("t", lambda x: x["segment"]), "")).alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("n_placeholder_tokens"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Parse formatted conversations: conv_id, turns (role, text, in_loss) with texts unescaped, formatted_chars.

    A segment is in the loss when its content's span is one of the mask's: segments and spans are rows
    that meet by their place, all within the conversation's partition, so the work grows with the turns.
    """
    parts = F.split("formatted", r"<\|turn\|>")
    item = "struct<pos:int,role:string,content:string,size:bigint,start:bigint>"

    def parsed(s: Column, i: Column) -> Column:
        rest = F.substring_index(s, SAY, -1)
        return F.struct(i.alias("pos"), F.substring_index(s, SAY, 1).alias("role"), F.substring_index(rest, END, 1).alias("content"), (F.length(s) + len(TURN)).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("start"))

    segments = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), parsed).cast(f"array<{item}>")
    spans = F.transform("loss_spans", lambda x: F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("bigint").alias("size"), x["start"].cast("bigint").alias("start"))).cast(f"array<{item}>")
    # Lengths and items first: what stands beside explode() is computed again for each of its rows.
    rows = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.concat(segments, spans).alias("items"))
    rows = rows.select("conv_id", "formatted_chars", F.explode("items").alias("x")).select("conv_id", "formatted_chars", "x.*")
    before = W.partitionBy("conv_id").orderBy(F.col("pos").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(before), F.lit(0)) + len(CHAT) + len(TURN) + F.length("role") + len(SAY)
    placed = rows.withColumn("at", F.when(F.col("pos").isNull(), F.col("start")).otherwise(begin))
    met = placed.groupBy("conv_id", "formatted_chars", "at").agg(F.max(F.struct("pos", "role", "content")).alias("t"), F.max(F.col("pos").isNull()).alias("in_loss")).filter("t.pos IS NOT NULL")
    turns = F.sort_array(F.collect_list(F.struct(F.col("t.pos").alias("pos"), F.col("t.role").alias("role"), F.col("t.content").alias("content"), "in_loss")))
    each = lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["content"]).alias("text"), x["in_loss"].alias("in_loss"))
    return met.groupBy("conv_id", "formatted_chars").agg(turns.alias("t")).select("conv_id", "formatted_chars", F.transform("t", each).alias("turns"))
