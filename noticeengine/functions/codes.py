"""Product and service codes in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code formats and file extensions. (?U) gives \b its Unicode meaning.
PRODUCT_CODE = r"(?U)\b[A-Z][A-Z0-9]{1,4}-[A-Z0-9][A-Z0-9.-]{2,}\b"
SERVICE_CODE = r"(?U)\b[A-Z]{2,4}-[A-Z][A-Z0-9]*\([A-Z]+\)|\b[A-Z]{2,4}-[A-Z][A-Z0-9]{2,}\b"
MODEL_SKU = r"(?U)\b(?:\(J\))?[A-Z][A-Z0-9]{2,}_[A-Z0-9]{2,}\b"
FILE_EXTENSION = r"(?iU)\.(PNG|JPG|JPEG|GIF|WEBP|PDF|PPTX?|XLSX?|XLSB|DOCX?|HWPDX?)\b"
#: A text whose codes lead to more roles than this is not routed by them.
MAX_ROLES = 4


def product_codes(text: Column) -> Column:
    """Distinct codes, service codes first; a product code that a bracketed code starts with is dropped."""
    upper = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), FILE_EXTENSION, ""))
    services = F.array_distinct(F.regexp_extract_all(upper, F.lit(SERVICE_CODE), F.lit(0)))
    products = F.array_distinct(F.regexp_extract_all(upper, F.lit(PRODUCT_CODE), F.lit(0)))
    own = F.filter(F.array_except(products, services), lambda p: ~F.exists(services, lambda s: s.startswith(F.concat(p, F.lit("(")))))
    return F.concat(services, own)


def model_skus(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(MODEL_SKU), F.lit(0)))


def routing_codes(title: Column, summary: Column, excerpt: Column) -> Column:
    """Codes of the first of title, summary and excerpt that has any."""
    t, s = product_codes(title), product_codes(summary)
    return F.when(F.size(t) > 0, t).when(F.size(s) > 0, s).otherwise(product_codes(excerpt))
