"""Column functions on paths and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """A path in its one spelling: ``/`` for ``\\`` and no leading ``./`` or ``.//``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./{1,2}", "")


def plain_value(value: Column) -> Column:
    """A value without outer blanks; null where nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def stable_id(*parts: Column, length: int = 16) -> Column:
    """A content id: the head of the SHA-1 of the parts joined by the unit separator, null as empty."""
    sep = F.lit("\x1f")
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]) if parts else sep
    return F.substring(F.sha1(joined), 1, length)
