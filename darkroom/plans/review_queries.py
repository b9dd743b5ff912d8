"""Queries of review queues, galleries, audits, tags, places and jobs.

The catalogue's tables of faces, reviews, suggestions and jobs are derived from
the driver's orders and line items by arithmetic that both dialects share.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions.guid import guid
from darkroom.operators import review as r
from darkroom.operators.collections import collect, outside_places, page, parse_filter
from darkroom.operators.latest import latest_by, latest_by_id
from darkroom.plans.dialect import sql_guid
from darkroom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that it is held against."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey"
_FACES = {"face_id": "o_orderkey", "photo_id": "o_custkey", "run_id": "o_custkey % 40", "created_at": "o_orderdate"}
_LOG = {"id": _ID, "face_id": "l_orderkey", "kind": "CASE l_partkey % 4 WHEN 0 THEN 'assign' WHEN 1 THEN 'unknown' WHEN 2 THEN 'reject' ELSE 'undo' END", "person_id": "l_suppkey % 20", "at": "l_shipdate"}
_SUGGESTED = {
    "suggestion_id": _ID, "face_id": "l_orderkey", "person_id": "l_suppkey % 20", "rank": "l_linenumber", "score": "round(0.4 + l_discount * 5, 4)", "margin": "CASE WHEN l_tax > 0.005 THEN round(l_tax * 3, 4) END",
    "status": "CASE l_partkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END", "model": "l_partkey % 2",
}
_columns = lambda of: ", ".join(f"{v} AS {k}" for k, v in of.items())
_CTE = f"""faces AS (SELECT {_columns(_FACES)} FROM orders), log0 AS (SELECT {_columns(_LOG)} FROM lineitem WHERE l_linenumber >= 4),
log AS (SELECT *, CASE WHEN kind = 'undo' THEN lag(id) OVER (PARTITION BY face_id ORDER BY id) END AS reverses FROM log0),
suggestions AS (SELECT {_columns(_SUGGESTED)} FROM lineitem WHERE l_linenumber <= 2),
active AS (SELECT * FROM log WHERE kind <> 'undo' AND id NOT IN (SELECT reverses FROM log WHERE reverses IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY id DESC) = 1),
states AS (SELECT f.*, CASE a.kind WHEN 'assign' THEN 'assigned' WHEN 'unknown' THEN 'unknown' WHEN 'reject' THEN 'rejected' ELSE 'unreviewed' END AS state, CASE WHEN a.kind = 'assign' THEN a.person_id END AS assigned_person FROM faces f LEFT JOIN active a ON a.face_id = f.face_id),
pending AS (SELECT * FROM suggestions WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY rank, score DESC, suggestion_id) = 1),
offered AS (SELECT * FROM suggestions WHERE status IN ('pending', 'accepted') QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY rank, score DESC, suggestion_id) = 1),
queue AS (SELECT s.*, p.suggestion_id, p.person_id, p.score, p.margin, CASE WHEN p.score IS NULL THEN 3 WHEN p.score >= 0.7 AND p.margin >= 0.1 THEN 0 WHEN p.score >= 0.5 THEN 1 ELSE 2 END AS place FROM states s LEFT JOIN pending p ON p.face_id = s.face_id)"""


def faces(spark: SparkSession, base: str) -> DataFrame:
    return t(spark, base, "orders").select(*[F.expr(v).alias(k) for k, v in _FACES.items()])


def log(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "lineitem").filter("l_linenumber >= 4").select(*[F.expr(v).alias(k) for k, v in _LOG.items()])
    return rows.withColumn("reverses", F.when(F.col("kind") == "undo", F.lag("id").over(Window.partitionBy("face_id").orderBy("id"))))


def suggestions(spark: SparkSession, base: str) -> DataFrame:
    return t(spark, base, "lineitem").filter("l_linenumber <= 2").select(*[F.expr(v).alias(k) for k, v in _SUGGESTED.items()])


def states(spark: SparkSession, base: str) -> DataFrame:
    return r.with_review_state(faces(spark, base), log(spark, base))


def queue(spark: SparkSession, base: str) -> DataFrame:
    """Faces with their state and best pending suggestion."""
    best = r.top_suggestions(suggestions(spark, base), ("pending",)).select("face_id", "suggestion_id", "person_id", "score", "margin")
    return states(spark, base).join(best, "face_id", "left").withColumn("place", r.confidence_place(F.col("score"), F.col("margin"), 0.7, 0.1, 0.5))


@query(f"WITH {_CTE} SELECT face_id, photo_id, created_at, (SELECT count(*) FROM states WHERE state = 'unreviewed') AS total FROM states WHERE state = 'unreviewed' ORDER BY created_at, face_id LIMIT 50 OFFSET 25")
def review_queue_unreviewed(spark: SparkSession, base: str) -> DataFrame:
    """The second page of the faces that nobody has reviewed, oldest first, with the number of all."""
    rows = r.where(states(spark, base), r.in_state("unreviewed")).select("face_id", "photo_id", "created_at")
    return r.page_with_total(rows, [F.asc("created_at"), F.asc("face_id")], 25, 50)


@query(f"WITH {_CTE} SELECT state, count(*) AS faces, count(assigned_person) AS assigned FROM states GROUP BY state")
def review_states(spark: SparkSession, base: str) -> DataFrame:
    return r.where(states(spark, base), r.in_state("all")).groupBy("state").agg(F.count(F.lit(1)).alias("faces"), F.count("assigned_person").alias("assigned"))


@query(f"WITH {_CTE} SELECT face_id, suggestion_id, score FROM queue WHERE state = 'unreviewed' AND person_id = 7")
def suggested_person_filter(spark: SparkSession, base: str) -> DataFrame:
    """Faces to review whose best pending suggestion is one person."""
    return r.where(queue(spark, base), r.in_state("unreviewed"), F.col("person_id") == 7).select("face_id", "suggestion_id", "score")


@query(f"WITH {_CTE} SELECT face_id, state FROM states s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.photo_id AND c.c_mktsegment = 'BUILDING') AND EXISTS (SELECT 1 FROM suggestions g WHERE g.face_id = s.face_id AND g.model = 1)")
def run_scope_semi(spark: SparkSession, base: str) -> DataFrame:
    """Faces within a run and known to a model: two semi-joins."""
    run = t(spark, base, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("photo_id"))
    known = suggestions(spark, base).filter("model = 1").select("face_id")
    return states(spark, base).join(run, "photo_id", "left_semi").join(known, "face_id", "left_semi").select("face_id", "state")


_SORTS = {
    "created": "created_at", "suggested_person": "person_id NULLS LAST, score DESC NULLS LAST", "confidence_group": "place, margin DESC NULLS LAST, score DESC NULLS LAST", "margin_desc": "margin DESC NULLS LAST, score DESC NULLS LAST",
    "margin_asc": "margin NULLS LAST, score DESC NULLS LAST", "score": "score DESC NULLS LAST", "no_suggestion_first": "CASE WHEN score IS NULL THEN 0 ELSE 1 END, created_at",
}


def _gallery(kind: str) -> None:
    def run(spark: SparkSession, base: str) -> DataFrame:
        rows = r.where(queue(spark, base), r.in_state("unreviewed"))
        return page(rows, r.queue_order(kind, F.col("place")), 0, 60).select("face_id", "suggestion_id", "person_id", "score", "margin", F.col("place").cast("long").alias("place"))

    run.__name__, run.__doc__ = f"gallery_sort_{kind}", f"The first page of the faces to review, ordered by {kind}."
    query(f"WITH {_CTE} SELECT face_id, suggestion_id, person_id, score, margin, place::BIGINT AS place FROM queue WHERE state = 'unreviewed' ORDER BY {_SORTS[kind]}, face_id LIMIT 60")(run)


for _kind in _SORTS:
    _gallery(_kind)

_AUDIT = """, audit AS (SELECT s.face_id, s.assigned_person, a."at" AS assigned_at, o.person_id AS suggested_person, o.score, coalesce(o.person_id <> s.assigned_person, false) AS disagrees
FROM states s JOIN active a ON a.face_id = s.face_id LEFT JOIN offered o ON o.face_id = s.face_id WHERE s.state = 'assigned')"""


def audit(spark: SparkSession, base: str) -> DataFrame:
    """Assigned faces beside the best suggestion that is pending or accepted."""
    best = r.top_suggestions(suggestions(spark, base), ("pending", "accepted")).select("face_id", F.col("person_id").alias("suggested_person"), "score")
    when = r.active_reviews(log(spark, base), "face_id", "id", "kind", "reverses").select("face_id", F.col("at").alias("assigned_at"))
    rows = r.where(states(spark, base), r.in_state("assigned")).join(when, "face_id").join(best, "face_id", "left")
    return rows.withColumn("disagrees", r.disagrees(F.col("suggested_person"), F.col("assigned_person"))).select("face_id", "assigned_person", "assigned_at", "suggested_person", "score", "disagrees")


@query(f"WITH {_CTE} {_AUDIT} SELECT face_id, assigned_person, suggested_person, score FROM audit WHERE disagrees")
def audit_disagreements(spark: SparkSession, base: str) -> DataFrame:
    return audit(spark, base).filter("disagrees").select("face_id", "assigned_person", "suggested_person", "score")


_AUDIT_SORTS = {"assigned_desc": "assigned_at DESC", "assigned_asc": "assigned_at", "disagreement_first": "CASE WHEN disagrees THEN 0 ELSE 1 END, assigned_at DESC", "confidence_asc": "score NULLS LAST"}


def _audited(kind: str) -> None:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return page(audit(spark, base), r.audit_order(kind), 0, 60)

    run.__name__, run.__doc__ = f"audit_sort_{kind}", f"The first page of the audit, ordered by {kind}."
    query(f"WITH {_CTE} {_AUDIT} SELECT * FROM audit ORDER BY {_AUDIT_SORTS[kind]}, face_id LIMIT 60")(run)


for _kind in _AUDIT_SORTS:
    _audited(_kind)


@query(f"SELECT person_id, name FROM (SELECT DISTINCT {sql_guid('id')} AS person_id, coalesce(nullif(trim(display_name), ''), 'Unnamed person') AS name FROM people) ORDER BY lower(name), person_id LIMIT 100")
def people_by_name(spark: SparkSession, base: str) -> DataFrame:
    """The first people by name whatever its case; those without one are called so."""
    rows = t(spark, base, "people").select(guid("id").alias("person_id"), r.shown_name(F.col("display_name")).alias("name")).distinct()
    return page(rows, r.name_order(F.col("name"), "person_id"), 0, 100)


@query(f"WITH {_CTE}, decided AS (SELECT max_by(id, id) AS id, face_id // 7 AS suggestion, max_by(kind, id) AS kind FROM log WHERE kind IN ('assign', 'reject') GROUP BY face_id // 7) SELECT suggestion, id, kind FROM decided")
def latest_suggestion_decision(spark: SparkSession, base: str) -> DataFrame:
    rows = log(spark, base).filter("kind in ('assign', 'reject')").select(F.expr("face_id div 7").alias("suggestion"), "id", "kind")
    return latest_by_id(rows, ["suggestion"], "id").select("suggestion", "id", "kind")


@query(f"WITH {_CTE} SELECT face_id, run_id, photo_id, id, kind FROM (SELECT l.id, l.kind, f.* FROM log l JOIN faces f ON f.face_id = l.face_id WHERE l.kind <> 'undo') QUALIFY row_number() OVER (PARTITION BY run_id, photo_id, face_id ORDER BY id DESC) = 1")
def latest_resolution(spark: SparkSession, base: str) -> DataFrame:
    """The last decision on each (run, photo, face)."""
    rows = log(spark, base).filter("kind <> 'undo'").select("face_id", "id", "kind").join(faces(spark, base), "face_id")
    return latest_by_id(rows, ["run_id", "photo_id", "face_id"], "id").select("face_id", "run_id", "photo_id", "id", "kind")


@query("SELECT l_orderkey AS face_id, l_partkey AS model, l_shipdate AS observed_at FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey) = 1")
def latest_observation(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "lineitem").select(F.col("l_orderkey").alias("face_id"), F.col("l_partkey").alias("model"), "l_suppkey", F.col("l_shipdate").alias("observed_at"))
    return latest_by(rows, ["face_id"], [F.desc("observed_at"), F.asc("model"), F.asc("l_suppkey")]).select("face_id", "model", "observed_at")


@query(f"""SELECT face_id, id FROM (SELECT l_orderkey AS face_id, {_ID} AS id, l_shipdate AS observed_at, l_partkey AS model, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS pipeline FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY CASE WHEN pipeline IS NULL THEN 0 WHEN pipeline <> 'R' THEN 1 ELSE 2 END, observed_at DESC, model, id) = 1""")
def preferred_geometry_anchor(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "lineitem").select(F.col("l_orderkey").alias("face_id"), F.expr(_ID).alias("id"), F.col("l_shipdate").alias("observed_at"), F.col("l_partkey").alias("model"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("pipeline"))
    return r.preferred_anchor(rows, "face_id", "pipeline", "model", "R").select("face_id", "id")


@query("SELECT o_custkey AS photo_id, max(l_linenumber)::BIGINT + 1 AS next_ordinal FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def next_ordinals(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(t(spark, base, "orders").select("o_orderkey", F.col("o_custkey").alias("photo_id")), "o_orderkey")
    return r.next_ordinal(rows, "photo_id", "l_linenumber")


_SUMMARY = {
    "plans": "count(DISTINCT l_orderkey)", "candidates": "count(*)", "existing": "count(*) FILTER (WHERE l_returnflag = 'N')", "fresh": "count(*) FILTER (WHERE l_returnflag = 'A')", "ambiguous": "count(*) FILTER (WHERE l_returnflag = 'R')",
    "awaiting": "count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O')", "deferred": "count(*) FILTER (WHERE l_returnflag = 'R' AND l_partkey % 2 = 0)", "applied": "count(*) FILTER (WHERE l_linestatus = 'F')",
}


@query("SELECT " + ", ".join(f"{v} AS {k}" for k, v in _SUMMARY.items()) + " FROM lineitem")
def rollout_summary(spark: SparkSession, base: str) -> DataFrame:
    """Eight counts in one pass."""
    return t(spark, base, "lineitem").agg(*[F.expr(v).alias(k) for k, v in _SUMMARY.items()])


@query("SELECT l_orderkey AS revision, id, l_shipdate AS completed_at FROM (SELECT *, " + _ID + " AS id FROM lineitem) WHERE l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, id DESC) = 1")
def latest_succeeded_job(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "lineitem").select(F.col("l_orderkey").alias("revision"), F.expr(_ID).alias("id"), F.col("l_shipdate").alias("completed_at"), "l_linestatus")
    return latest_by(rows, ["revision"], [F.desc("completed_at"), F.desc("id")], F.col("l_linestatus") == "F").select("revision", "id", "completed_at")


_DUE = "CASE WHEN l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '1998-01-01' THEN 'queued' WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1997-06-01' THEN 'expired' END"


@query(f"SELECT id, claim FROM (SELECT {_ID} AS id, l_shipdate AS due, {_DUE} AS claim FROM lineitem) WHERE claim IS NOT NULL ORDER BY CASE claim WHEN 'queued' THEN 0 ELSE 1 END, due, id LIMIT 20")
def claimable_jobs(spark: SparkSession, base: str) -> DataFrame:
    """What comes next: queued work that is due, then work whose lease has run out."""
    rows = t(spark, base, "lineitem").select(F.expr(_ID).alias("id"), F.col("l_shipdate").alias("due"), F.expr(_DUE).alias("claim")).filter("claim is not null")
    return page(rows, [F.when(F.col("claim") == "queued", 0).otherwise(1).asc(), F.asc("due"), F.asc("id")], 0, 20).select("id", "claim")


# Tags and places by log, from the driver's events: a user is a photo.
_TAG = "CASE WHEN k % 4 = 0 THEN 'places' WHEN k % 4 = 1 THEN concat('places/land ', k % 3, '/town ', k % 7) ELSE concat('tag ', k % 20) END"
_TAGS = f"""e AS (SELECT event_id AS id, user_id AS photo, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), tlog AS (SELECT id, photo, {_TAG} AS tag, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action_kind FROM e WHERE event_type IN ('purchase', 'signup', 'error')),
plog AS (SELECT id, photo, {_TAG} AS tag, CASE WHEN event_type = 'click' THEN 'clear' ELSE 'set' END AS action_kind FROM e WHERE event_type IN ('view', 'click') AND k % 4 = 1),
tags AS (SELECT photo, tag FROM (SELECT * FROM tlog QUALIFY row_number() OVER (PARTITION BY photo, tag ORDER BY id DESC) = 1) WHERE action_kind = 'add'),
plc AS (SELECT photo, tag FROM (SELECT * FROM plog QUALIFY row_number() OVER (PARTITION BY photo ORDER BY id DESC) = 1) WHERE action_kind = 'set')"""


def _events(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("photo"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.withColumn("tag", F.expr(_TAG))


def tag_log(spark: SparkSession, base: str) -> DataFrame:
    return _events(spark, base).filter("event_type in ('purchase', 'signup', 'error')").select("id", "photo", "tag", F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action_kind"))


def place_log(spark: SparkSession, base: str) -> DataFrame:
    return _events(spark, base).filter("event_type in ('view', 'click') and k % 4 = 1").select("id", "photo", "tag", F.when(F.col("event_type") == "click", "clear").otherwise("set").alias("action_kind"))


@query(f"WITH {_TAGS} SELECT photo, tag, id, action_kind FROM tlog QUALIFY row_number() OVER (PARTITION BY photo, tag ORDER BY id DESC) = 1")
def latest_tag_state(spark: SparkSession, base: str) -> DataFrame:
    return latest_by_id(tag_log(spark, base), ["photo", "tag"], "id").select("photo", "tag", "id", "action_kind")


@query(f"WITH {_TAGS} SELECT photo, tag, id, action_kind FROM plog QUALIFY row_number() OVER (PARTITION BY photo ORDER BY id DESC) = 1")
def latest_place_state(spark: SparkSession, base: str) -> DataFrame:
    return latest_by_id(place_log(spark, base), ["photo"], "id").select("photo", "tag", "id", "action_kind")


@query(f"WITH {_TAGS} SELECT photo, tag FROM tags WHERE tag <> 'places' AND NOT starts_with(tag, 'places/')")
def effective_tags_outside_places(spark: SparkSession, base: str) -> DataFrame:
    return r.effective_tags(tag_log(spark, base), "photo", "tag").filter(outside_places(F.col("tag")))


@query(f"WITH {_TAGS} SELECT photo, tag FROM plc")
def effective_place(spark: SparkSession, base: str) -> DataFrame:
    return r.effective_places(place_log(spark, base), "photo", "tag")


#: A saved collection, as it is stored.
_SAVED = json.dumps({"schemaVersion": 2, "people": ["3", "5", "7"], "peopleMatch": "any", "tags": ["tag 2", "tag 6"], "tagMatch": "any", "location": {"place": "places/land 1"}, "taken": {"from": "2024-01-01", "to": "2024-01-31"}})


@query(f"""WITH {_TAGS}, first AS (SELECT user_id AS photo, min(ts) AS taken FROM events GROUP BY 1), ppl AS (SELECT DISTINCT photo, (k % 10)::VARCHAR AS person FROM e WHERE event_type = 'purchase')
SELECT f.photo AS asset_revision_id, taken FROM first f WHERE taken >= TIMESTAMP '2024-01-01' AND taken < TIMESTAMP '2024-02-01' AND photo IN (SELECT photo FROM ppl WHERE person IN ('3', '5', '7')) AND photo IN (SELECT photo FROM tags WHERE tag IN ('tag 2', 'tag 6'))
AND photo IN (SELECT photo FROM plc WHERE tag = 'places/land 1' OR starts_with(tag, 'places/land 1/')) ORDER BY taken DESC NULLS LAST, photo LIMIT 100""")
def collection_saved(spark: SparkSession, base: str) -> DataFrame:
    """A collection from its stored JSON: people, tags, place and taken days at once."""
    events = t(spark, base, "events")
    photos = events.groupBy(F.col("user_id").alias("asset_revision_id")).agg(F.min("ts").alias("taken_local")).withColumn("latitude", F.lit(None).cast("double")).withColumn("longitude", F.lit(None).cast("double"))
    own = lambda df, name: df.select(F.col("photo").alias("asset_revision_id"), F.col("tag").alias(name))
    people = _events(spark, base).filter("event_type = 'purchase'").select(F.col("photo").alias("asset_revision_id"), (F.col("k") % 10).cast("string").alias("person_id")).distinct()
    out = collect(photos, people, own(r.effective_tags(tag_log(spark, base), "photo", "tag"), "tag"), own(r.effective_places(place_log(spark, base), "photo", "tag"), "place"), parse_filter(_SAVED))
    return page(out, [F.desc_nulls_last("taken_local"), F.asc("asset_revision_id")], 0, 100).select("asset_revision_id", F.col("taken_local").alias("taken"))


@query(f"WITH {_CTE} SELECT s.face_id, s.photo_id, NOT EXISTS (SELECT 1 FROM active a WHERE a.face_id = s.face_id) AS eligible FROM faces s")
def bulk_eligibility(spark: SparkSession, base: str) -> DataFrame:
    """Which faces a bulk review may touch: an EXISTS within the projection."""
    return r.eligible(faces(spark, base), r.active_reviews(log(spark, base), "face_id", "id", "kind", "reverses"), "face_id").select("face_id", "photo_id", "eligible")


@query(f"WITH {_CTE}, pg AS (SELECT face_id, created_at FROM states WHERE state = 'unreviewed' ORDER BY created_at DESC, face_id LIMIT 40) SELECT p.face_id, p.created_at, s.suggestion_id, s.score FROM pg p JOIN suggestions s ON s.face_id = p.face_id")
def page_then_enrich(spark: SparkSession, base: str) -> DataFrame:
    """A page of faces first, then all suggestions of these."""
    rows = r.where(states(spark, base), r.in_state("unreviewed")).select("face_id", "created_at")
    return r.ranked_page_then_enrich(rows, [F.desc("created_at"), F.asc("face_id")], 0, 40, suggestions(spark, base).select("face_id", "suggestion_id", "score"), "face_id").select("face_id", "created_at", "suggestion_id", "score")


@query(f"""WITH {_CTE}, ends AS (SELECT run_id, (SELECT min(face_id) FROM states x WHERE x.run_id = 3 AND x.photo_id % 3 = 0) AS a, (SELECT max(face_id) FROM states x WHERE x.run_id = 3) AS b FROM states WHERE run_id = 3 LIMIT 1)
SELECT s.face_id FROM states s, ends e WHERE s.run_id = 3 AND s.state = 'unreviewed' AND (s.created_at, s.face_id) BETWEEN least((SELECT (created_at, face_id) FROM faces WHERE face_id = e.a), (SELECT (created_at, face_id) FROM faces WHERE face_id = e.b)) AND greatest((SELECT (created_at, face_id) FROM faces WHERE face_id = e.a), (SELECT (created_at, face_id) FROM faces WHERE face_id = e.b))""")
def selected_range(spark: SparkSession, base: str) -> DataFrame:
    """The unreviewed faces of a run's queue between two that were clicked."""
    own = states(spark, base).filter("run_id = 3")
    ends = faces(spark, base).filter("run_id = 3").agg(F.min(F.when(F.col("photo_id") % 3 == 0, F.col("face_id"))).alias("a"), F.max("face_id").alias("b")).first()
    return r.where(r.selection_range(own, [F.col("created_at"), F.col("face_id")], "face_id", ends["a"], ends["b"], ["run_id"]), r.in_state("unreviewed")).select("face_id")


@query(f"WITH {_CTE} SELECT DISTINCT person_id FROM suggestions WHERE status = 'accepted' UNION SELECT DISTINCT person_id + 100 FROM suggestions s WHERE status = 'pending' AND EXISTS (SELECT 1 FROM active a WHERE a.person_id = s.person_id AND a.kind = 'assign') AND NOT EXISTS (SELECT 1 FROM active a WHERE a.person_id = s.person_id AND a.face_id % 3000 = 7)")
def favourites_upsert(spark: SparkSession, base: str) -> DataFrame:
    """A set that grows only by people who exist and aren't hidden: a conditional insert."""
    rows, now = suggestions(spark, base), r.active_reviews(log(spark, base), "face_id", "id", "kind", "reverses")
    moved = lambda df: df.select((F.col("person_id") + 100).alias("person_id"))
    known = rows.filter("status = 'accepted'").select("person_id").distinct()
    return r.insert_where(known, moved(rows.filter("status = 'pending'")), ["person_id"], moved(now.filter("kind = 'assign'")), moved(now.filter("face_id % 3000 = 7")))


@query(f"WITH {_CTE} SELECT face_id, id, kind, log.at FROM log WHERE face_id = 4242")
def point_lookup(spark: SparkSession, base: str) -> DataFrame:
    """One face's log by key: the key reaches the scan as a pushed filter."""
    rows = t(spark, base, "lineitem").filter("l_orderkey = 4242 and l_linenumber >= 4")
    return rows.select(*[F.expr(v).alias(k) for k, v in _LOG.items()]).select("face_id", "id", "kind", "at")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
