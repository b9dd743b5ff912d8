"""Connected components by parallel hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.operators.skew import lookup
from darkroom.plans.staging import Staging


def shortcut(parents: DataFrame, staging: Staging, rows: int | None = None) -> DataFrame:
    """Pointer jumping: ``parents`` (v, p), a forest whose roots have no row, with p replaced by the root of v."""
    while True:
        jumped = (
            lookup(parents.withColumnRenamed("p", "k"), parents.select(F.col("v").alias("k"), F.col("p").alias("gp")), "k", "left", rows=rows)
            .select("v", F.coalesce("gp", "k").alias("p"), F.col("gp").isNotNull().alias("moved"))
        )
        state, seen = staging.observed(jumped, moved=F.count_if("moved"))
        staging.drop(parents)
        rows = seen["rows"]
        parents = state.select("v", "p")
        parents._staged_at = state._staged_at  # type: ignore[attr-defined]
        if not seen["moved"]:
            return parents


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b), label being the smallest vertex connected with v.

    Each round every vertex that isn't a local minimum hooks onto its smallest
    neighbour, shortcutting turns the hooks into stars, and the edges are
    contracted onto the stars' roots: each round only local minima are left.
    Only pairs and sums per vertex move; no group is collected. Self links name
    isolated vertices; null ends are dropped. An empty input gives an empty
    result.
    """
    edges = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges, seen = staging.observed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), links=F.count_if(F.col("a") < F.col("b")))
    vertices = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    labels, own = staging.observed(vertices.withColumn("label", F.col("v")))
    first, left = edges, seen["links"]
    edges = edges.filter("a < b")
    while left:
        # a < b in every edge, so the hook of b is its smallest neighbour below it.
        hooks, hooked = staging.observed(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
        roots = shortcut(hooks, staging, hooked["rows"])
        moved = labels.withColumnRenamed("label", "k")
        relabelled = lookup(moved, roots.withColumnRenamed("v", "k"), "k", "left", rows=own["rows"]).select("v", F.coalesce("p", "k").alias("label"))
        new_labels = staging.save(relabelled)
        one = lookup(edges.withColumnRenamed("a", "k"), roots.withColumnRenamed("v", "k"), "k", "left", rows=left).select(F.coalesce("p", "k").alias("a"), "b")
        both = lookup(one.withColumnRenamed("b", "k"), roots.withColumnRenamed("v", "k"), "k", "left", rows=left).select("a", F.coalesce("p", "k").alias("b"))
        new_edges, seen = staging.observed(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        staging.drop(labels, first, roots)
        labels, edges, first, left = new_labels, new_edges, new_edges, seen["rows"]
    return labels
