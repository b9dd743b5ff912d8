"""Evaluating matches: thresholds, metrics, confusion, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.plans.staging import Staging


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as double, or ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b.cast("double"))


def threshold_sweep(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """Metrics of each threshold over (expected, predicted, score): a sample is accepted if its score reaches it.

    expected is null for unknown people, predicted and score are null where
    nothing was found. One pass: every sample is counted into all thresholds
    within its task, so the samples aren't multiplied by a join.
    """
    known, score = F.col("expected").isNotNull(), F.coalesce("score", F.lit(float("-inf")))
    each = samples.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (score >= t).alias("accepted")) for t in sorted(set(thresholds))])).alias("t"), known.alias("known"), F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).alias("right"))
    each = each.select("t.threshold", "t.accepted", "known", "right")
    counts = each.groupBy("threshold").agg(
        F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_unknown"), F.count_if("accepted").alias("n_accepted"),
        F.count_if(F.col("accepted") & F.col("right")).alias("n_right"), F.count_if(~F.col("known") & ~F.col("accepted")).alias("n_unknown_rejected"),
    )
    recall, rejection = ratio(F.col("n_right"), F.col("n_known")), ratio(F.col("n_unknown_rejected"), F.col("n_unknown"))
    return counts.select("threshold", "n_known", "n_unknown", "n_accepted", "n_right", "n_unknown_rejected", ratio(F.col("n_right"), F.col("n_accepted")).alias("precision"), recall.alias("known_recall"), rejection.alias("unknown_rejection"), ((recall + rejection) / 2).alias("balanced"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the best balanced score, then precision, unknown rejection and threshold."""
    best = F.max_by(F.struct(*sweep.columns), F.struct("balanced", "precision", "unknown_rejection", "threshold"))
    return sweep.agg(best.alias("b")).filter("b is not null").select("b.*")


# The labels of a confusion matrix for what is no person.
UNKNOWN, MISSED, REJECTED = "<unknown>", "<missed>", "<rejected>"


def confusion(samples: DataFrame, threshold: float) -> DataFrame:
    """(expected, predicted, n) with <unknown> for people not known, <missed> for nothing found, <rejected> below the threshold."""
    predicted = F.when(F.col("score").isNull(), MISSED).when(F.col("score") < threshold, REJECTED).otherwise(F.col("predicted").cast("string"))
    return samples.select(F.coalesce(F.col("expected").cast("string"), F.lit(UNKNOWN)).alias("expected"), predicted.alias("predicted")).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def hash_order(key: Column, seed: str, category: Column | str) -> Column:
    """SHA-256 of seed, category and key on lines of their own: an order that is the same on every machine."""
    c = F.lit(category) if isinstance(category, str) else category
    return F.sha2(F.concat_ws("\n", F.lit(seed), c, key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, category: str, seed: str, per_category: int) -> DataFrame:
    """The first ``per_category`` rows of each category in hash order, with their place."""
    order = hash_order(F.col(key), seed, F.col(category).cast("string"))
    w = Window.partitionBy(category).orderBy(order, key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_category).withColumnRenamed("__n", "place")


def detection_metrics(kinds: DataFrame, photos: DataFrame, many: int) -> DataFrame:
    """(grp, photos, faces, matched, missed, false_found, duplicates, ambiguous, recall) overall, for photos of ``many`` faces or more, and for each group whatever its case.

    ``kinds`` is what ``match_kinds`` gives, ``photos`` has photo and grp. Recall
    is 1 where there are no faces. Counts are made a photo first, so the three
    views are sums of few rows.
    """
    n = lambda side, kind: F.count_if((F.col("side") == side) & (F.col("kind") == kind))
    names = ["faces", "matched", "missed", "false_found", "duplicates", "ambiguous"]
    each = kinds.groupBy("photo").agg(F.count_if(F.col("side") == "truth").alias("faces"), n("truth", "matched").alias("matched"), n("truth", "missed").alias("missed"), n("candidate", "false").alias("false_found"), n("candidate", "duplicate").alias("duplicates"), F.count_if(F.col("kind") == "ambiguous").alias("ambiguous"))
    own = photos.select("photo", F.lower("grp").alias("grp")).join(each, "photo", "left").fillna(0, names)
    views = F.explode(F.array_compact(F.array(F.lit("<overall>"), F.when(F.col("faces") >= many, F.lit(f"<{many}+ faces>")), F.col("grp"))))
    sums = own.withColumn("view", views).groupBy(F.col("view").alias("grp")).agg(F.count(F.lit(1)).alias("photos"), *[F.sum(c).alias(c) for c in names])
    return sums.withColumn("recall", ratio(F.col("matched"), F.col("faces"), 1.0))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(shared): how many distinct keys two sets have in common; 0 means that they are disjoint."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right): how many rows, copies counted, only one of two tables has."""
    columns = left.columns
    both = left.withColumn("__s", F.lit(1)).unionByName(right.select(*columns).withColumn("__s", F.lit(-1)))
    rest = both.groupBy(*columns).agg(F.sum("__s").alias("d"))
    return rest.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_right"))


def lru_release(items: DataFrame, order: list[str], size: str, needed: int, staging: Staging) -> DataFrame:
    """The first items in ``order`` until ``needed`` bytes are reached: those before which less than that was gathered.

    The rows are range-partitioned once; each task sums its own, and one number a partition is collected.
    """
    ordered = staging.save(items.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    totals = {r["__p"]: r["s"] or 0 for r in ordered.groupBy("__p").agg(F.sum(size).alias("s")).collect()}
    before, run = {}, 0
    for p in sorted(totals):
        before[p] = run
        run += totals[p]
    start = F.create_map(*[F.lit(x) for p, b in (before or {0: 0}).items() for x in (p, b)])
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prior = start[F.col("__p")] + F.coalesce(F.sum(size).over(w), F.lit(0))
    return ordered.withColumn("released_before", prior.cast("long")).filter(F.col("released_before") < needed).drop("__p")
