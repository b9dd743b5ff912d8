"""The N best items of every group, by simultaneous bisection of all groups.

Each row gets an order-preserving code: the score's bits, then the columns of
the tie rule and the identifier, cut into digits of at most 33 bits so that
differences can't overflow. For all groups at once the interval that holds the
cutoff is cut into SLICES slices; the rows above each midpoint are counted
(counts are combined before the shuffle), rows above the cutoff's slice are
taken, rows below it are dropped, and the smallest and largest code of the slice
bound the next interval. Digits that are equal all over the interval are
skipped. A group leaves as soon as its slice holds exactly the rows it needs.

No group is ever sorted or collected in one place: a task sends at most SLICES
counts a group and round, and the undecided rows shrink from round to round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.operators.skew import HOT_ROWS, HOT_SHARE, lookup
from darkroom.plans.staging import Staging

#: Slices of a round and group; 64 resolve a digit of 33 bits in six rounds at worst.
SLICES = 64
#: The digit of a missing value: below every digit of 33 bits.
_LAST = -(1 << 40)


def score_digits(score: Column) -> list[Column]:
    """Two longs that sort together as the score does, largest best; null and NaN below all numbers, -0.0 as 0.0."""
    d = score.cast("double")
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(d == 0, F.lit(0.0)).otherwise(d)).cast("long")
    ordered = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    missing = d.isNull() | F.isnan(d)
    return [
        F.when(missing, F.lit(_LAST)).otherwise(F.shiftright(ordered, 32)),
        F.when(missing, F.lit(0).cast("long")).otherwise(ordered.bitwiseAND(F.lit(0xFFFFFFFF))),
    ]


def whole_digits(value: Column) -> list[Column]:
    """Two longs that sort against an integer column: its smallest value best, null last."""
    v = F.bitwise_not(value.cast("long"))
    return [
        F.when(value.isNull(), F.lit(_LAST)).otherwise(F.shiftright(v, 32)),
        F.when(value.isNull(), F.lit(0).cast("long")).otherwise(v.bitwiseAND(F.lit(0xFFFFFFFF))),
    ]


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, ties: list[str], n: int, staging: Staging) -> DataFrame:
    """(group, item) of the ``n`` best items of every group.

    Best is the highest ``score`` (a double; null and NaN after all numbers),
    then the smallest of each of the integer columns ``ties`` in turn (null
    last), then the smallest ``item`` (an integer). An item that occurs more
    than once in a group counts once, by its best row. Rows without a group or
    an item are ignored; groups with fewer than ``n`` items keep all of them;
    an empty table gives an empty result. Other columns are not looked at.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    digits = score_digits(F.col(score)) + [d for t in ties for d in whole_digits(F.col(t))] + whole_digits(F.col(item))
    names = [f"d{i}" for i in range(len(digits))]
    rows = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("item"), *[d.alias(x) for d, x in zip(digits, names)])
    # The item's digits are the same in all rows of an item, so the best row is the largest tuple of the others.
    best = rows.groupBy("g", "item").agg(F.max(F.struct(*names)).alias("d"))
    undecided = staging.save(best.select("g", "item", *[F.col(f"d.{x}").alias(x) for x in names]))

    def bounds(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}_{x}") for x in names for k, f in (("lo", F.min), ("hi", F.max))])

    def interval(df: DataFrame) -> DataFrame:
        """The first digit that differs within the interval, and its bounds."""
        pick = lambda kind: reduce(lambda rest, x: F.when(F.col(f"lo_{x}") != F.col(f"hi_{x}"), kind(x)).otherwise(rest), reversed(names), F.lit(None).cast("long"))
        return df.select("g", "n", "need", "cut", pick(lambda x: F.lit(int(x[1:])).cast("long")).alias("level"), pick(lambda x: F.col(f"lo_{x}")).alias("lo"), pick(lambda x: F.col(f"hi_{x}")).alias("hi"))

    # The write tells whether any group may be hot; only then are those listed.
    large = F.count_if(F.col("n") > HOT_ROWS)
    state, size = staging.observed(interval(bounds(undecided, ["g"]).withColumn("need", F.lit(n).cast("long")).withColumn("cut", F.lit(None).cast("long"))), large=large)
    bucket = lambda code, lo, hi: F.expr(f"({code} - {lo}) * {SLICES} div ({hi} - {lo} + 1)")
    parts, first = [], True
    while True:
        hot = [r[0] for r in state.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).select("g").collect()] if size["large"] else []
        joined = lookup(undecided, state, "g", hot=hot)
        if first:
            sided = joined.withColumn("side", F.lit(0))
        else:
            sided = joined.withColumn("side", F.when(F.col("slice") > F.col("cut"), 1).when(F.col("slice") == F.col("cut"), 0).otherwise(-1)).filter("side >= 0")
        taken = (F.col("side") == 1) | (F.col("n") <= F.col("need"))
        code = reduce(lambda rest, x: F.when(F.col("level") == int(x[1:]), F.col(x)).otherwise(rest), reversed(names), F.lit(None).cast("long"))
        out = sided.withColumn("taken", taken).withColumn("code", code).withColumn("slice", bucket("code", "lo", "hi")).select("g", "item", *names, "need", "taken", "slice")
        table, seen = staging.observed(out, left=F.count_if(~F.col("taken")))
        parts.append(table.filter("taken").select("g", "item"))
        undecided = table.filter("not taken")
        if not seen["left"]:
            break
        counts = bounds(undecided, ["g", "slice", "need"])
        w = Window.partitionBy("g").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
        above = counts.withColumn("above", F.coalesce(F.sum("n").over(w), F.lit(0)))
        cut = above.filter("above < need and above + n >= need").withColumn("need", F.col("need") - F.col("above")).withColumn("cut", F.col("slice"))
        state, size = staging.observed(interval(cut), large=large)
        undecided = undecided.drop("need", "taken")
        first = False
    return reduce(DataFrame.unionByName, parts).select(F.col("g").alias(group), F.col("item").alias(item))
