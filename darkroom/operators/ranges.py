"""Global order without a global sort in one task: range partitions, and one number of each at the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.plans.staging import Staging


def _by_part(values: dict[int, object], kind: str) -> Column:
    """A literal map from partition to value; as many entries as there are partitions."""
    known = [F.lit(x) if not isinstance(x, Column) else x for p, v in values.items() for x in (p, v)]
    return F.try_element_at(F.create_map(*known).cast(f"map<int,{kind}>"), F.col("__p")) if known else F.lit(None).cast(kind)


def in_ranges(df: DataFrame, order: list[Column], staging: Staging) -> DataFrame:
    """``df`` as a table with its range partition of ``order`` in __p; end ``order`` with a unique column, so that ties don't fill one partition."""
    return staging.save(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column], staging: Staging) -> tuple[DataFrame, int]:
    """(``df`` with position from 1 in ``order`` and its partition __p, number of rows)."""
    ordered = in_ranges(df, order, staging)
    sizes = {r["__p"]: r["n"] for r in ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, run = {}, 0
    for p in sorted(sizes):
        before[p] = run
        run += sizes[p]
    w = Window.partitionBy("__p").orderBy(*order)
    return ordered.withColumn("position", F.row_number().over(w) + _by_part(before, "bigint")), run


def neighbours(df: DataFrame, key: str, order: list[Column], staging: Staging) -> DataFrame:
    """(key, previous, next, position, total) of every row of one queue of any length.

    Rows see their neighbours within their range; the ends of each range, two
    keys, are known to the driver.
    """
    rows, total = numbered(df, order, staging)
    kind = dict(df.dtypes)[key]
    ends = {r["__p"]: (r["a"], r["b"]) for r in rows.groupBy("__p").agg(F.min_by(key, "position").alias("a"), F.max_by(key, "position").alias("b")).collect()}
    parts = sorted(ends)
    last_before = {p: ends[q][1] for q, p in zip(parts, parts[1:])}
    first_after = {p: ends[q][0] for p, q in zip(parts, parts[1:])}
    w = Window.partitionBy("__p").orderBy("position")
    return rows.select(key, F.coalesce(F.lag(key).over(w), _by_part(last_before, kind)).alias("previous"), F.coalesce(F.lead(key).over(w), _by_part(first_after, kind)).alias("next"), F.col("position").cast("long").alias("position"), F.lit(total).cast("long").alias("total"))


def surrounding(df: DataFrame, group: str, order: list[str], above: str, below: str, staging: Staging) -> DataFrame:
    """``df`` with before, the last value of ``above`` in the rows before each, and after, the first of ``below`` in the rows after it, in ``order`` within ``group`` of any length; nulls are passed over.

    Rows see their own range; of each range the driver knows its last value of
    ``above`` and first of ``below`` with their groups.
    """
    ordered = in_ranges(df, [F.col(group), *[F.col(c) for c in order]], staging)
    at = F.struct(group, *order)
    last, first = [f(F.struct(group, c), F.when(F.col(c).isNotNull(), at)) for f, c in ((F.max_by, above), (F.min_by, below))]
    ends = ordered.groupBy("__p").agg(last.alias("last"), first.alias("first")).orderBy("__p").collect()
    kinds = dict(df.dtypes)

    def beyond(rows: list, end: str, value: str) -> Column:
        found, carried = {}, None
        for r in rows:
            if carried is not None:
                found[r["__p"]] = carried
            carried = r[end] or carried
        same = _by_part({p: x[group] for p, x in found.items()}, kinds[group]) == F.col(group)
        return F.when(same, _by_part({p: x[value] for p, x in found.items()}, kinds[value]))

    # Both look back, the second from below: Spark goes over all that follows a row anew for each row.
    w, up = [Window.partitionBy("__p", group).orderBy(*c).rowsBetween(Window.unboundedPreceding, -1) for c in (order, [F.desc(c) for c in order])]
    before, after = F.last(above, ignorenulls=True).over(w), F.last(below, ignorenulls=True).over(up)
    filled = ordered.withColumn("before", before).withColumn("after", after)
    return filled.withColumn("before", F.coalesce("before", beyond(ends, "last", above))).withColumn("after", F.coalesce("after", beyond(ends[::-1], "first", below))).drop("__p")


def quantiles(df: DataFrame, column: str, staging: Staging) -> DataFrame:
    """One row (files, mean, median, p95): the median of an even number is the mean of two, p95 is the value at the nearest rank.

    Values are counted before they are ordered, and only the ranges that hold a
    wanted rank are summed up. Nulls don't count; all but files are null where
    there are no values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = in_ranges(counts, [F.col(column)], staging)
    sizes = {r["__p"]: r["n"] for r in ordered.groupBy("__p").agg(F.sum("n").alias("n")).collect()}
    total, before, run = sum(sizes.values()), {}, 0
    ranks = {"low": (total + 1) // 2, "high": total // 2 + 1, "p95": -(-total * 95 // 100)}
    for p in sorted(sizes):
        before[p] = run
        run += sizes[p]
    wanted = [p for p in sizes if any(before[p] < r <= before[p] + sizes[p] for r in ranks.values())]
    w = Window.partitionBy("__p").orderBy(column)
    upto = ordered.filter(F.col("__p").isin(wanted)).withColumn("upto", F.sum("n").over(w) + _by_part(before, "bigint"))
    at = lambda r: F.max(F.when((F.col("upto") - F.col("n") < r) & (F.col("upto") >= r), F.col(column)))
    found = upto.agg(*[at(r).alias(k) for k, r in ranks.items()])
    mean = ordered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), (F.sum(F.col(column) * F.col("n")) / F.sum("n")).alias("mean"))
    # Two single rows side by side.
    return mean.join(F.broadcast(found), F.lit(True)).select("files", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95")
