"""Changes of tables as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.operators.ranges import numbered
from darkroom.plans.staging import Staging


def upsert(base: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """``base`` with the rows of ``new``; where a key exists only ``update`` (by default all other columns) is replaced.

    ``new`` has one row a key. Keys must not be null.
    """
    change = [c for c in base.columns if c not in keys] if update is None else update
    b, n = base.alias("b"), new.alias("n")
    there = F.col(f"n.{keys[0]}").isNotNull()
    fresh = F.col(f"b.{keys[0]}").isNull()
    cols = [F.coalesce(f"n.{c}", f"b.{c}").alias(c) if c in keys else F.when(fresh | (there & F.lit(c in change)), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns]
    return b.join(n, [F.col(f"b.{k}") == F.col(f"n.{k}") for k in keys], "full").select(*cols)


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``new`` whose key it doesn't have."""
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys).distinct(), keys, "left_anti").select(*base.columns))


def delete_stale(base: DataFrame, keep: DataFrame, keys: list[str], protected: Column) -> DataFrame:
    """``base`` without the rows that ``keep`` doesn't name, but with all ``protected`` ones."""
    kept = base.join(keep.select(*keys).distinct().withColumn("__k", F.lit(True)), keys, "left")
    return kept.filter(F.col("__k").isNotNull() | F.coalesce(protected, F.lit(False))).drop("__k")


def remap(df: DataFrame, column: str, mapping: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """``column`` replaced by ``mapping`` (old, new), one row an old value; then one row for each ``unique`` key."""
    out = df.join(mapping.select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left").withColumn(column, F.coalesce("__new", column)).select(*df.columns)
    return out.dropDuplicates(unique) if unique else out


def with_new_ids(base_max: int, new: DataFrame, order: list[str], staging: Staging, id_column: str = "id") -> DataFrame:
    """Consecutive ids after ``base_max`` for a batch of rows, in ``order``; ranges are numbered, not gathered."""
    rows, _ = numbered(new, [F.col(c).asc() for c in order], staging)
    return rows.select(*new.columns, (F.col("position") + base_max).cast("long").alias(id_column))


def selection_token(ids: DataFrame, key: str, *context: str) -> DataFrame:
    """(n, token): a digest of the distinct ids and the context, the same on every run over the same selection.

    Ids are spread over 65,536 groups by their own digest; the groups' digests,
    64 letters each, are what meets in one row.
    """
    rows = ids.select(F.col(key).cast("string").alias("k")).filter("k is not null").distinct().withColumn("g", F.substring(F.sha2("k", 256), 1, 4))
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("k")), "\n"), 256).alias("d"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.concat_ws("\n", *[F.lit(c) for c in context], joined), 256).alias("token"))


def snapshot_diff(seen: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) with change new, changed, same or missing, between a scan and the catalogue."""
    s, k = seen.select(key, F.col(digest).alias("seen_digest")).dropDuplicates([key]), known.select(key, F.col(digest).alias("known_digest")).dropDuplicates([key])
    change = F.when(F.col("known_digest").isNull(), "new").when(F.col("seen_digest").isNull(), "missing").when(F.col("seen_digest") == F.col("known_digest"), "same").otherwise("changed")
    return s.join(k, key, "full").select(key, change.alias("change"))
