"""Names and hierarchical paths of tags and places."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a segment and levels of a path.
SEGMENT, LEVELS = 80, 32


def _segment(s: str) -> str | None:
    s = " ".join(unicodedata.normalize("NFKC", s).split())
    bad = not s or len(s) > SEGMENT or any(unicodedata.category(c) == "Cc" for c in s)
    return None if bad else s


@F.pandas_udf(T.StringType())
def clean_path(path: pd.Series) -> pd.Series:
    """A path with NFKC text, single blanks and no blank around its segments; null where a segment is blank, too long or has control characters."""

    def one(p: str | None) -> str | None:
        if p is None:
            return None
        parts = [_segment(x) for x in p.split("/")]
        return None if None in parts or len(parts) > LEVELS else "/".join(parts)

    # A vocabulary repeats its paths, so each distinct one is cleaned once a batch.
    known = {p: one(p) for p in path.unique()}
    return path.map(known)


def identity(path: Column) -> Column:
    """What two writings of a path have in common: lower case."""
    return F.lower(path)


def ancestors(path: Column) -> Column:
    """The path's own and all its ancestors' paths, from the root down; null for null."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The path above; null for a root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def canonical_place(value: Column) -> Column:
    """A place value below the root ``places``: case, blanks around slashes and a missing root don't matter."""
    low = F.lower(F.trim(F.regexp_replace(value, r"\s*/\s*", "/")))
    return F.when(low.startswith("places/") | (low == "places"), low).otherwise(F.concat(F.lit("places/"), low))
