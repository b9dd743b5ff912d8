"""Review queues, galleries and audits: states from logs, predicates, orders and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.operators.collections import page
from darkroom.operators.latest import active_reviews, latest_by, latest_by_id

# The states of a face and the kinds of review that lead to them.
STATES = {"assign": "assigned", "unknown": "unknown", "reject": "rejected"}
UNNAMED = "Unnamed person"


def with_review_state(faces: DataFrame, log: DataFrame, key: str = "face_id") -> DataFrame:
    """``faces`` with state and person_id of each face's latest active review; unreviewed where there is none.

    The log is reduced before the join, so a face without a review stays (a
    condition of the join, not of its result).
    """
    active = active_reviews(log, key, "id", "kind", "reverses").select(key, F.col("kind").alias("__kind"), F.col("person_id").alias("__person"))
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    joined = faces.join(active, key, "left")
    return joined.withColumn("state", F.coalesce(state[F.col("__kind")], F.lit("unreviewed"))).withColumn("assigned_person", F.when(F.col("__kind") == "assign", F.col("__person"))).drop("__kind", "__person")


def in_state(wanted: str) -> Column | None:
    """The condition for a review state; None for ``all``, which asks nothing."""
    if wanted == "all":
        return None
    if wanted not in (*STATES.values(), "unreviewed"):
        raise ValueError(f"no review state {wanted}")
    return F.col("state") == wanted


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every condition that is asked; a condition that is None isn't."""
    asked = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, asked)) if asked else df


def top_suggestions(suggestions: DataFrame, statuses: tuple[str, ...], key: str = "face_id") -> DataFrame:
    """The best suggestion of each face among those with one of ``statuses``: lowest rank, then highest score, then id."""
    return latest_by(suggestions, [key], [F.asc("rank"), F.desc_nulls_last("score"), F.asc("suggestion_id")], F.col("status").isin(*statuses))


def confidence_place(score: Column, margin: Column, high: float, high_margin: float, medium: float) -> Column:
    """0 for high, 1 for medium, 2 for low confidence, 3 without a suggestion."""
    sure = (score >= high) & F.coalesce(margin >= high_margin, F.lit(False))
    return F.when(score.isNull(), 3).when(sure, 0).when(score >= medium, 1).otherwise(2)


def queue_order(kind: str, place: Column) -> list[Column]:
    """The order of a queue of faces with their top suggestion (score, margin, person_id), ended by face_id."""
    score, margin = F.col("score"), F.col("margin")
    orders = {
        "created": [F.asc("created_at")],
        "suggested_person": [F.asc_nulls_last("person_id"), F.desc_nulls_last("score")],
        "confidence_group": [place.asc(), margin.desc_nulls_last(), score.desc_nulls_last()],
        "margin_desc": [margin.desc_nulls_last(), score.desc_nulls_last()],
        "margin_asc": [margin.asc_nulls_last(), score.desc_nulls_last()],
        "score": [score.desc_nulls_last()],
        "no_suggestion_first": [F.when(score.isNull(), 0).otherwise(1).asc(), F.asc("created_at")],
    }
    return [*orders[kind], F.asc("face_id")]


def audit_order(kind: str) -> list[Column]:
    """The order of an audit of assigned faces (assigned_at, disagrees, score), ended by face_id."""
    orders = {
        "assigned_desc": [F.desc("assigned_at")],
        "assigned_asc": [F.asc("assigned_at")],
        "disagreement_first": [F.when(F.col("disagrees"), 0).otherwise(1).asc(), F.desc("assigned_at")],
        "confidence_asc": [F.asc_nulls_last("score")],
    }
    return [*orders[kind], F.asc("face_id")]


def disagrees(suggested: Column, assigned: Column) -> Column:
    """Whether a suggestion names another person; false where there is no suggestion or nobody is assigned."""
    return F.coalesce(suggested != assigned, F.lit(False))


def shown_name(name: Column) -> Column:
    """The trimmed name, or a fixed one where it is blank."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(UNNAMED))


def name_order(name: Column, key: str) -> list[Column]:
    """By name whatever its case, then by id."""
    return [F.lower(name).asc(), F.asc(key)]


def page_with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the number of all rows beside each of its rows: one count, no window over everything."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # The right side is a single row.
    return page(df, order, offset, limit).join(F.broadcast(total), F.lit(True), "left")


def eligible(asked: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """``asked`` with whether no row of ``decided`` has its key: an EXISTS within a projection, as a flag."""
    flags = decided.select(key).distinct().withColumn("__d", F.lit(True))
    return asked.join(flags, key, "left").withColumn("eligible", F.col("__d").isNull()).drop("__d")


def selection_range(queue: DataFrame, order: list[Column], key: str, first: str, last: str, parts: list[str]) -> DataFrame:
    """The entries of each queue (``parts``) from ``first`` to ``last``, whichever comes first, ends included.

    Only the two ends' sort keys are looked up; nothing is numbered.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = queue.select("*", F.struct(*[c.alias(n) for c, n in zip(order, names)]).alias("__o"))
    ends = keyed.filter(F.col(key).isin(first, last)).groupBy(*parts).agg(F.min("__o").alias("__lo"), F.max("__o").alias("__hi"), F.count_distinct(key).alias("__n")).filter(F.col("__n") == len({first, last}))
    return keyed.join(ends, parts).filter(F.col("__o").between(F.col("__lo"), F.col("__hi"))).drop("__o", "__lo", "__hi", "__n")


def effective_tags(log: DataFrame, photo: str, tag: str) -> DataFrame:
    """(photo, tag) whose latest action adds the tag."""
    return latest_by_id(log, [photo, tag], "id").filter("action_kind = 'add'").select(photo, tag)


def effective_places(log: DataFrame, photo: str, tag: str) -> DataFrame:
    """(photo, tag) of photos whose latest place action sets a place: one place a photo."""
    return latest_by_id(log, [photo], "id").filter("action_kind = 'set'").select(photo, tag)


def next_ordinal(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, next_ordinal): one more than the largest, 0 where there is none."""
    return rows.groupBy(key).agg((F.coalesce(F.max(ordinal), F.lit(-1)) + 1).cast("long").alias("next_ordinal"))


def preferred_anchor(observations: DataFrame, face: str, pipeline: str, model: str, wanted: str) -> DataFrame:
    """The observation that anchors each face: without a pipeline first, then of another one, then of ``wanted``; then the newest."""
    rank = F.when(F.col(pipeline).isNull(), 0).when(F.col(pipeline) != wanted, 1).otherwise(2)
    return latest_by(observations, [face], [rank.asc(), F.desc("observed_at"), F.asc(model), F.asc("id")])


def insert_where(base: DataFrame, new: DataFrame, keys: list[str], exists: DataFrame | None = None, absent: DataFrame | None = None) -> DataFrame:
    """``base`` and the rows of ``new`` whose key ``exists`` holds and ``absent`` doesn't, and which ``base`` hasn't yet."""
    rows = new.dropDuplicates(keys)
    if exists is not None:
        rows = rows.join(exists.select(*keys).distinct(), keys, "left_semi")
    for other in (absent, base):
        if other is not None:
            rows = rows.join(other.select(*keys).distinct(), keys, "left_anti")
    return base.unionByName(rows.select(*base.columns))


def ranked_page_then_enrich(rows: DataFrame, order: list[Column], offset: int, limit: int, details: DataFrame, key: str) -> DataFrame:
    """A page of ``rows`` first, then its details: the wide side is semi-joined with a page of at most a few hundred keys."""
    own = page(rows, order, offset, limit)
    return details.join(F.broadcast(own.select(key)), key, "left_semi").join(F.broadcast(own), key)


def numbered(rows: DataFrame, order: list[Column], parts: list[str]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)).cast("long"))
