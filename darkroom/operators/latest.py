"""The current state of append-only logs: filter first, then take the last row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], where: Column | None = None) -> DataFrame:
    """The first row of each key in ``order``, among the rows that pass ``where``.

    Spark prunes each task's rows to one a key before the shuffle (a window group
    limit), so a key with very many rows costs no more than any other. Rows that
    tie in ``order`` are settled arbitrarily: end it with a unique column. Null
    keys are a key of their own.
    """
    rows = df if where is None else df.filter(where)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest_by_id(df: DataFrame, keys: Sequence[str], id_column: str, where: Column | None = None) -> DataFrame:
    """The row with the largest ``id_column`` of each key, by a hash aggregation without a sort."""
    rows = df if where is None else df.filter(where)
    rest = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), id_column).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def active_reviews(actions: DataFrame, subject: str, id_column: str = "id", kind: str = "action_kind", reversed_id: str = "reverses_action_id", undo: str = "undo") -> DataFrame:
    """The latest review of each subject that isn't an undo and that no undo has reversed.

    Undo reveals the review before it: rows are filtered before they are ranked.
    """
    undone = actions.filter((F.col(kind) == undo) & F.col(reversed_id).isNotNull()).select(F.col(reversed_id).alias(id_column)).distinct()
    return latest_by_id(actions.filter(F.col(kind) != undo).join(undone, id_column, "left_anti"), [subject], id_column)
