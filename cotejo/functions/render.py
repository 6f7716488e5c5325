"""Small text renderings, and the routing of what a user types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bar(value: Column, width: int = 12) -> Column:
    """A bar of full and light blocks for a value between 0 and 1."""
    full = F.bround(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def is_url(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike(r"^(https?://|www\.)\S+$")


def route(c: Column) -> Column:
    """command, url, text or empty: what a chat message asks for."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "empty").when(F.startswith(t, F.lit("/")), "command").when(is_url(t), "url").otherwise("text")
