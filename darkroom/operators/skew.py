"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of the rows, so there are fewer than 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 500
#: Below this many rows of a key a task takes them without trouble.
HOT_ROWS = 50_000


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold over HOT_SHARE of the rows and over HOT_ROWS rows: at most 1/HOT_SHARE of them.

    The counts are combined before the shuffle, so a hot key costs no more than others.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS)
    rows = counts.filter(F.col(key).isNotNull()).orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).collect()
    if not rows:
        return []
    total = df.count()
    return [r[0] for r in rows if r["n"] > total * HOT_SHARE]


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, rows: int | None = None) -> DataFrame:
    """``left`` joined on ``key`` with ``right``, where ``right`` has one row a key.

    Rows of hot keys are joined with a broadcast of those keys' rows of ``right``
    (fewer than 1/HOT_SHARE, as each key has one row); the others are shuffled.
    ``hot`` gives the hot keys where the caller knows them already. Without it
    they are counted at once, so ``left`` should be a table or a cheap plan;
    not where ``rows``, the most rows that ``left`` can have, is too few for any.
    """
    if hot is None:
        hot = [] if rows is not None and rows <= HOT_ROWS else hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right, key, how)
    return cold.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how))
