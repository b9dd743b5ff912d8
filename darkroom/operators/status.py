"""Counts, checks and decisions over snapshots of jobs, scans and evaluations, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def backoff_seconds(attempts: Column, first: float = 5.0, most: float = 300.0) -> Column:
    """The wait after a number of failed attempts: ``first``, doubled with each further one, ``most`` at most."""
    # Beyond 40 doublings every wait is the longest.
    return F.when(attempts >= 1, F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(40))), F.lit(most)))


def gate(metrics: DataFrame, complete: Column, recall: float, many_recall: float, most_wrong: int) -> DataFrame:
    """(grp, ..., gate) of metrics: pending while not complete, else pass or fail.

    The overall row and that of photos with many faces must reach their recall,
    and false and duplicate finds of the overall row stay within ``most_wrong``.
    """
    least = F.when(F.col("grp").startswith("<overall"), recall).otherwise(many_recall)
    wrong = (F.col("false_found") + F.col("duplicates") <= most_wrong) | ~F.col("grp").startswith("<overall")
    passed = (F.col("recall") + EPSILON >= least) & wrong
    return metrics.filter(F.col("grp").startswith("<")).withColumn("gate", F.when(~complete, "pending").when(passed, "pass").otherwise("fail"))


def verification(known: Column, sticky: Column, seen: Column, baseline: Column, legacy: Column) -> Column:
    """verified, needs-source-verification or unverified; the first that holds decides.

    Content whose hash is known is verified; what once needed verification goes
    on needing it; metadata equal to its baseline is verified and else needs it;
    without a baseline older content needs it, and the rest is unverified.
    """
    return F.when(known, "verified").when(sticky, "needs-source-verification").when(baseline.isNotNull(), F.when(seen == baseline, "verified").otherwise("needs-source-verification")).when(legacy, "needs-source-verification").otherwise("unverified")


def surviving_suggestions(rows: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """Suggestions after people were merged (``mapping`` old, new): one a ``key``, accepted before rejected before pending.

    The row that the target had already stays, with the strongest status of all; the moved rows fold into it.
    """
    moved = rows.join(mapping.select(F.col("old").alias("person_id"), "new"), "person_id", "left")
    moved = moved.withColumn("was", F.col("person_id")).withColumn("person_id", F.coalesce("new", "person_id"))
    order = F.struct((F.col("was") == F.col("person_id")).alias("own"), -F.col("suggestion_id"))
    strength = F.when(F.col("status") == "accepted", 3).when(F.col("status") == "rejected", 2).otherwise(1)
    kept = moved.groupBy(*key).agg(F.max_by("suggestion_id", order).alias("suggestion_id"), F.max_by("status", strength).alias("status"), F.max_by("score", order).alias("score"))
    return kept


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) of the rows that break each rule."""
    out = None
    for rule, rows in rules.items():
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
