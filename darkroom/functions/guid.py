"""GUIDs compare by value, whatever way they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guid(c: Column | str) -> Column:
    """The lower-case 8-4-4-4-12 form; null for null, blank or malformed text.

    Braces, blanks, case and missing dashes don't matter.
    """
    col = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.regexp_replace(col.cast("string"), r"[\s{}()\- ]", ""))
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)
