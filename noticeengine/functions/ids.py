"""Content-derived identifiers and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_id(length: int, *parts: Column) -> Column:
    """The first digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def event_id(post_id: Column, title: Column) -> Column:
    return digest_id(16, post_id, title)


def card_id(source_ref: Column, role: Column) -> Column:
    return digest_id(16, source_ref, role)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return digest_id(16, kind, source, target)


def keyword_node(keyword: Column) -> Column:
    return F.concat(F.lit("kw:"), digest_id(12, F.lower(F.trim(keyword))))


def base_ref(source_ref: Column) -> Column:
    """A reference without what follows its last hash sign."""
    return F.regexp_replace(source_ref, "#[^#]*$", "")


def url_path(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *(F.concat(F.lit("/"), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))) for p in parts))


def attachment_kind(filename: Column) -> Column:
    """excel, pptx, pdf, image or unknown by extension."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    return F.when(ext.isin("xlsx", "xls", "xlsb", "csv"), "excel").when(ext.isin("pptx", "ppt"), "pptx").when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "gif", "webp"), "image").otherwise("unknown")
