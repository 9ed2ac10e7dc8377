"""Binding of a value inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: it becomes a lambda variable, so the plan holds it once too."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
