"""Queries over the archive's logs and revisions: current state, collections, status, changes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions.geo import on_earth
from darkroom.functions.guid import guid
from darkroom.functions.paths import ancestors, canonical_place, leaf, parent
from darkroom.operators.collections import holds_these, in_box, neighbours_in_queue, on_days, page, within_folders, within_place
from darkroom.operators.evaluation import hash_sample, lru_release, ratio
from darkroom.operators.latest import active_reviews, latest_by, latest_by_id
from darkroom.operators.mutations import delete_stale, insert_if_absent, remap, selection_token, snapshot_diff, upsert, with_new_ids
from darkroom.operators.places import display_label, resolve_chains
from darkroom.operators.ranges import neighbours, quantiles
from darkroom.plans.dialect import sql_guid
from darkroom.plans.staging import Staging
from darkroom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that it is held against."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_ACTIONS = f"acts AS (SELECT DISTINCT id, {sql_guid('asset_revision_id')} AS asset_revision_id, {sql_guid('person_id')} AS person_id, action_kind FROM photo_person_actions)"
_PRESENT = _ACTIONS + ", present AS (SELECT asset_revision_id, person_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_revision_id, person_id ORDER BY id DESC) AS n FROM acts WHERE person_id IS NOT NULL) WHERE n = 1 AND action_kind = 'add')"
_REVISIONS = "revs AS (SELECT DISTINCT id, asset_id, content_sha256, size_bytes, observed_at, media_type, width, height FROM asset_revisions)"
_PHOTOS = "photos AS (SELECT DISTINCT asset_revision_id, latitude, longitude FROM photo_capture_metadata)"


def actions(spark: SparkSession, base: str) -> DataFrame:
    """The person actions, GUIDs by value, each delivered row once."""
    return t(spark, base, "photo_person_actions").select("id", guid("asset_revision_id").alias("asset_revision_id"), guid("person_id").alias("person_id"), "action_kind").distinct()


def present(spark: SparkSession, base: str) -> DataFrame:
    """(asset_revision_id, person_id) whose latest action adds the person."""
    return latest_by_id(actions(spark, base).filter("person_id is not null"), ["asset_revision_id", "person_id"], "id").filter("action_kind = 'add'").select("asset_revision_id", "person_id")


def revisions(spark: SparkSession, base: str) -> DataFrame:
    return t(spark, base, "asset_revisions").distinct()


def people(spark: SparkSession, base: str) -> DataFrame:
    return t(spark, base, "people").select(guid("id").alias("person_id"), "display_name", guid("merged_into_person_id").alias("merged_into")).distinct()


@query(f"WITH {_ACTIONS} SELECT asset_revision_id, person_id, id, action_kind FROM acts WHERE person_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_revision_id, person_id ORDER BY id DESC) = 1")
def latest_person_action(spark: SparkSession, base: str) -> DataFrame:
    return latest_by_id(actions(spark, base).filter("person_id is not null"), ["asset_revision_id", "person_id"], "id").select("asset_revision_id", "person_id", "id", "action_kind")


@query(f"""WITH {_PRESENT}, ppl AS (SELECT DISTINCT {sql_guid('id')} AS person_id, {sql_guid('merged_into_person_id')} AS merged_into FROM people)
SELECT asset_revision_id, person_id FROM present WHERE person_id NOT IN (SELECT person_id FROM ppl WHERE merged_into IS NOT NULL) UNION SELECT asset_revision_id, merged_into FROM present JOIN ppl USING (person_id) WHERE merged_into IN (SELECT person_id FROM ppl)""")
def effective_people_union(spark: SparkSession, base: str) -> DataFrame:
    """The people of a photo: those present who aren't merged, and those whom merged ones were merged into."""
    own = people(spark, base).select("person_id", "merged_into").distinct()
    merged = own.filter("merged_into is not null")
    there = own.select(F.col("person_id").alias("merged_into")).distinct()
    now = present(spark, base)
    kept = now.join(merged.select("person_id"), "person_id", "left_anti").select("asset_revision_id", "person_id")
    moved = now.join(merged.join(there, "merged_into", "left_semi"), "person_id").select("asset_revision_id", F.col("merged_into").alias("person_id"))
    return kept.union(moved).distinct()


@query(f"""WITH {_PRESENT}, ppl AS (SELECT DISTINCT {sql_guid('id')} AS person_id, display_name FROM people WHERE {sql_guid('merged_into_person_id')} IS NULL AND trim(display_name) <> '')
SELECT p.person_id, p.display_name, count(q.asset_revision_id) AS photos FROM ppl p LEFT JOIN present q USING (person_id) GROUP BY ALL""")
def person_photo_counts(spark: SparkSession, base: str) -> DataFrame:
    active = people(spark, base).filter("merged_into is null and trim(display_name) <> ''").select("person_id", "display_name")
    counts = present(spark, base).groupBy("person_id").agg(F.count(F.lit(1)).alias("photos"))
    return active.join(counts, "person_id", "left").select("person_id", "display_name", F.coalesce("photos", F.lit(0)).alias("photos"))


@query(f"WITH {_REVISIONS} SELECT id, asset_id, content_sha256, observed_at FROM revs QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY observed_at DESC, id DESC) = 1")
def current_revision(spark: SparkSession, base: str) -> DataFrame:
    return latest_by(revisions(spark, base), ["asset_id"], [F.desc("observed_at"), F.desc("id")]).select("id", "asset_id", "content_sha256", "observed_at")


@query("SELECT crop_id, face_occurrence_id, crop_protocol FROM (SELECT DISTINCT * FROM face_crops) QUALIFY row_number() OVER (PARTITION BY face_occurrence_id ORDER BY created_at DESC, crop_id DESC) = 1")
def latest_crop(spark: SparkSession, base: str) -> DataFrame:
    return latest_by(t(spark, base, "face_crops").distinct(), ["face_occurrence_id"], [F.desc("created_at"), F.desc("crop_id")]).select("crop_id", "face_occurrence_id", "crop_protocol")


@query("SELECT crop_id, face_occurrence_id, crop_protocol FROM (SELECT DISTINCT * FROM face_crops) QUALIFY row_number() OVER (PARTITION BY face_occurrence_id ORDER BY CASE WHEN crop_protocol = 'aligned-112' THEN 0 ELSE 1 END, created_at, crop_id) = 1")
def representative_crop(spark: SparkSession, base: str) -> DataFrame:
    order = [F.when(F.col("crop_protocol") == "aligned-112", 0).otherwise(1), F.asc("created_at"), F.asc("crop_id")]
    return latest_by(t(spark, base, "face_crops").distinct(), ["face_occurrence_id"], order).select("crop_id", "face_occurrence_id", "crop_protocol")


@query("""SELECT e.id, c.face_occurrence_id, e.model_id, e.model_hash FROM (SELECT DISTINCT id, face_crop_id, model_id, model_hash, created_at FROM face_embeddings) e JOIN (SELECT DISTINCT crop_id, face_occurrence_id FROM face_crops) c ON c.crop_id = e.face_crop_id
QUALIFY row_number() OVER (PARTITION BY c.face_occurrence_id, e.model_id, e.model_hash ORDER BY e.created_at DESC, e.id DESC) = 1""")
def latest_embedding(spark: SparkSession, base: str) -> DataFrame:
    vectors = t(spark, base, "face_embeddings").select("id", F.col("face_crop_id").alias("crop_id"), "model_id", "model_hash", "created_at").distinct()
    joined = vectors.join(t(spark, base, "face_crops").select("crop_id", "face_occurrence_id").distinct(), "crop_id")
    return latest_by(joined, ["face_occurrence_id", "model_id", "model_hash"], [F.desc("created_at"), F.desc("id")]).select("id", "face_occurrence_id", "model_id", "model_hash")


@query("SELECT model_id, model_hash, count(DISTINCT face_occurrence_id) AS faces, count(DISTINCT suggestion_id) AS suggestions, max(generated_at) AS last_generated FROM identity_suggestion_rankings GROUP BY ALL")
def model_inventory(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "identity_suggestion_rankings")
    # Two distinct counts in one aggregation would multiply every row; distinct pairs are counted apart.
    faces = rows.select("model_id", "model_hash", "face_occurrence_id").distinct().groupBy("model_id", "model_hash").agg(F.count(F.lit(1)).alias("faces"))
    suggestions = rows.select("model_id", "model_hash", "suggestion_id").distinct().groupBy("model_id", "model_hash").agg(F.count(F.lit(1)).alias("suggestions"))
    last = rows.groupBy("model_id", "model_hash").agg(F.max("generated_at").alias("last_generated"))
    return faces.join(suggestions, ["model_id", "model_hash"]).join(last, ["model_id", "model_hash"])


_WANTED = f"wanted AS (SELECT person_id FROM present GROUP BY person_id ORDER BY count(*) DESC, person_id LIMIT 2)"


def _wanted(now: DataFrame) -> DataFrame:
    """The two people with the most photos: a table of two rows, not a list at the driver."""
    return now.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "person_id").limit(2).select("person_id")


@query(f"WITH {_PRESENT}, {_WANTED} SELECT DISTINCT asset_revision_id FROM present WHERE person_id IN (SELECT person_id FROM wanted)")
def collection_any_people(spark: SparkSession, base: str) -> DataFrame:
    now = present(spark, base)
    return holds_these(now, "asset_revision_id", "person_id", _wanted(now), every=False)


@query(f"WITH {_PRESENT}, {_WANTED} SELECT asset_revision_id FROM present WHERE person_id IN (SELECT person_id FROM wanted) GROUP BY asset_revision_id HAVING count(DISTINCT person_id) = 2")
def collection_all_people(spark: SparkSession, base: str) -> DataFrame:
    now = present(spark, base)
    return holds_these(now, "asset_revision_id", "person_id", _wanted(now), every=True)


@query(f"WITH {_PHOTOS} SELECT asset_revision_id, latitude, longitude FROM photos WHERE latitude BETWEEN 0 AND 45 AND longitude BETWEEN -60 AND 60")
def collection_bbox(spark: SparkSession, base: str) -> DataFrame:
    photos = t(spark, base, "photo_capture_metadata").select("asset_revision_id", "latitude", "longitude").distinct()
    return photos.filter(in_box(F.col("latitude"), F.col("longitude"), 0.0, -60.0, 45.0, 60.0))


@query(f"WITH {_REVISIONS} SELECT id, observed_at FROM revs WHERE observed_at >= TIMESTAMPTZ '2020-01-01 00:00:00+00' AND observed_at < TIMESTAMPTZ '2021-07-01 00:00:00+00'")
def collection_date_range(spark: SparkSession, base: str) -> DataFrame:
    return revisions(spark, base).filter(on_days(F.col("observed_at"), date(2020, 1, 1), date(2021, 6, 30))).select("id", "observed_at")


_PLACE = "CASE WHEN low LIKE 'places/%' OR low = 'places' THEN low ELSE 'places/' || low END"
_PLACES = f"plc AS (SELECT latitude, longitude, {_PLACE} AS place FROM (SELECT DISTINCT latitude, longitude, lower(trim(regexp_replace(place_value, '\\s*/\\s*', '/', 'g'))) AS low FROM photo_place_reverse_geocode_cache))"


def places(spark: SparkSession, base: str) -> DataFrame:
    return t(spark, base, "photo_place_reverse_geocode_cache").select("latitude", "longitude", canonical_place(F.col("place_value")).alias("place")).distinct()


@query(f"WITH {_PLACES} SELECT latitude, longitude, place FROM plc WHERE place = 'places/velrickor' OR substr(place, 1, 17) = 'places/velrickor/'")
def collection_place_ancestry(spark: SparkSession, base: str) -> DataFrame:
    return places(spark, base).filter(within_place(F.col("place"), "places/velrickor")).select("latitude", "longitude", "place")


@query(f"""WITH {_PRESENT}, {_WANTED}, {_REVISIONS}, {_PHOTOS} SELECT r.id, r.observed_at, p.latitude, p.longitude FROM revs r JOIN photos p ON p.asset_revision_id = r.id
WHERE r.observed_at >= TIMESTAMPTZ '2019-06-01 00:00:00+00' AND p.latitude IS NOT NULL AND r.id IN (SELECT asset_revision_id FROM present WHERE person_id IN (SELECT person_id FROM wanted))
ORDER BY r.observed_at DESC NULLS LAST, r.id LIMIT 50 OFFSET 10""")
def collection_combined(spark: SparkSession, base: str) -> DataFrame:
    """A page of fifty photos that meet people, date and position at once."""
    now = present(spark, base)
    wanted = holds_these(now, "asset_revision_id", "person_id", _wanted(now), every=False).withColumnRenamed("asset_revision_id", "id")
    photos = t(spark, base, "photo_capture_metadata").select(F.col("asset_revision_id").alias("id"), "latitude", "longitude").distinct().filter("latitude is not null")
    rows = revisions(spark, base).filter(on_days(F.col("observed_at"), date(2019, 6, 1), None)).join(wanted, "id", "left_semi").join(photos, "id")
    return page(rows.select("id", "observed_at", "latitude", "longitude"), [F.desc_nulls_last("observed_at"), F.asc("id")], 10, 50)


@query("""WITH log AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'assign' WHEN 'click' THEN 'unknown' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'undo' END AS kind,
  CASE WHEN event_type = 'purchase' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS reverses FROM events WHERE event_type <> 'signup')
SELECT user_id, event_id, kind FROM log WHERE kind <> 'undo' AND event_id NOT IN (SELECT reverses FROM log WHERE reverses IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def latest_review_state(spark: SparkSession, base: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in (("view", "assign"), ("click", "unknown"), ("error", "reject"), ("purchase", "undo")) for x in p])
    log = t(spark, base, "events").filter("event_type <> 'signup'").withColumn("kind", kinds[F.col("event_type")])
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    log = log.withColumn("reverses", F.when(F.col("kind") == "undo", before)).select("user_id", "event_id", "kind", "reverses")
    return active_reviews(log, "user_id", "event_id", "kind", "reverses").select("user_id", "event_id", "kind")


@query("""SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS person, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS confirmed, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS suggested, max(CASE WHEN event_type = 'view' THEN round(value, 4) END) AS best
FROM events WHERE event_type IN ('purchase', 'view') GROUP BY ALL""")
def collection_evidence_rollup(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "events").select("user_id", "event_type", "value", (F.get_json_object("props", "$.k").cast("long") % 20).alias("person"))
    confirmed = rows.filter("event_type = 'purchase'").select("user_id", "person", F.lit(1).alias("confirmed"), F.lit(0).alias("suggested"), F.lit(None).cast("double").alias("score"))
    suggested = rows.filter("event_type = 'view'").select("user_id", "person", F.lit(0).alias("confirmed"), F.lit(1).alias("suggested"), F.round("value", 4).alias("score"))
    return confirmed.unionByName(suggested).groupBy("user_id", "person").agg(F.sum("confirmed").alias("confirmed"), F.sum("suggested").alias("suggested"), F.max("score").alias("best"))


@query("""SELECT face_occurrence_id, crop_id, lag(crop_id) OVER w AS previous, lead(crop_id) OVER w AS next, row_number() OVER w AS position, count(*) OVER (PARTITION BY face_occurrence_id) AS total FROM (SELECT DISTINCT * FROM face_crops) WINDOW w AS (PARTITION BY face_occurrence_id ORDER BY created_at, crop_id)""")
def queue_navigation(spark: SparkSession, base: str) -> DataFrame:
    return neighbours_in_queue(t(spark, base, "face_crops").distinct(), "crop_id", [F.asc("created_at"), F.asc("crop_id")], "face_occurrence_id")


_FIRSTS = "firsts AS (SELECT DISTINCT face_occurrence_id, model_hash, suggestion_id, rank, CASE WHEN isnan(score_margin) THEN NULL ELSE score_margin END AS margin FROM identity_suggestion_rankings)"


@query(f"WITH {_FIRSTS} SELECT model_hash, CASE WHEN margin >= 0.3 THEN 'high' WHEN margin >= 0.1 THEN 'medium' WHEN margin IS NULL THEN 'none' ELSE 'low' END AS grp, count(*) AS n FROM firsts WHERE rank = 1 GROUP BY ALL")
def confidence_group_counts(spark: SparkSession, base: str) -> DataFrame:
    rows = t(spark, base, "identity_suggestion_rankings").filter("rank = 1").select("face_occurrence_id", "model_hash", "suggestion_id", F.when(~F.isnan("score_margin"), F.col("score_margin")).alias("margin")).distinct()
    group = F.when(F.col("margin") >= 0.3, "high").when(F.col("margin") >= 0.1, "medium").when(F.col("margin").isNull(), "none").otherwise("low")
    return rows.groupBy("model_hash", group.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FIRSTS} SELECT face_occurrence_id, suggestion_id, margin FROM firsts WHERE rank = 1 ORDER BY CASE WHEN margin >= 0.3 THEN 0 WHEN margin >= 0.1 THEN 1 ELSE 2 END, margin DESC NULLS LAST, suggestion_id LIMIT 100")
def gallery_by_confidence(spark: SparkSession, base: str) -> DataFrame:
    """The first page of suggestions, best group first."""
    rows = t(spark, base, "identity_suggestion_rankings").filter("rank = 1").select("face_occurrence_id", "suggestion_id", F.when(~F.isnan("score_margin"), F.col("score_margin")).alias("margin")).distinct()
    return page(rows, [F.when(F.col("margin") >= 0.3, 0).when(F.col("margin") >= 0.1, 1).otherwise(2), F.desc_nulls_last("margin"), F.asc("suggestion_id")], 0, 100)


@query(f"""WITH {_REVISIONS} SELECT count(*) AS revisions, count(DISTINCT asset_id) AS assets, count(*) FILTER (media_type IS NULL) AS untyped, count(*) FILTER (lower(media_type) = 'image/jpeg') AS jpeg, count(*) FILTER (lower(media_type) = 'image/heic') AS heic,
count(*) FILTER (width IS NULL OR height IS NULL) AS unsized, count(*) FILTER (width > height) AS landscape, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM revs""")
def archive_status_rollup(spark: SparkSession, base: str) -> DataFrame:
    rows, kind = revisions(spark, base), F.lower("media_type")
    return rows.agg(
        F.count(F.lit(1)).alias("revisions"), F.countDistinct("asset_id").alias("assets"), F.count_if(F.col("media_type").isNull()).alias("untyped"), F.count_if(kind == "image/jpeg").alias("jpeg"), F.count_if(kind == "image/heic").alias("heic"),
        F.count_if(F.col("width").isNull() | F.col("height").isNull()).alias("unsized"), F.count_if(F.col("width") > F.col("height")).alias("landscape"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"),
    )


@query(f"""WITH {_REVISIONS}, meta AS (SELECT asset_revision_id, bool_or(taken_at_local IS NOT NULL AND trim(taken_at_local) <> '') AS timed, bool_or(latitude IS NOT NULL AND longitude IS NOT NULL) AS placed FROM photo_capture_metadata GROUP BY 1)
SELECT r.id, CASE WHEN m.asset_revision_id IS NULL THEN 'pending' WHEN r.width IS NULL THEN 'unsized' WHEN NOT m.timed THEN 'untimed' WHEN NOT m.placed THEN 'unplaced' ELSE 'complete' END AS state FROM revs r LEFT JOIN meta m ON m.asset_revision_id = r.id""")
def archive_items_classified(spark: SparkSession, base: str) -> DataFrame:
    meta = t(spark, base, "photo_capture_metadata").groupBy(F.col("asset_revision_id").alias("id")).agg(
        F.bool_or(F.coalesce(F.trim("taken_at_local") != "", F.lit(False))).alias("timed"), F.bool_or(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("placed"))
    state = F.when(F.col("timed").isNull(), "pending").when(F.col("width").isNull(), "unsized").when(~F.col("timed"), "untimed").when(~F.col("placed"), "unplaced").otherwise("complete")
    return revisions(spark, base).select("id", "width").join(meta, "id", "left").select("id", state.alias("state"))


@query("SELECT l_orderkey AS run, count(*) AS jobs, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS queued, sum(l_linenumber)::BIGINT AS attempts, min(CASE WHEN l_linestatus = 'O' THEN l_shipdate END) AS next_due FROM lineitem GROUP BY 1")
def job_summary(spark: SparkSession, base: str) -> DataFrame:
    open_ = F.col("l_linestatus") == "O"
    return t(spark, base, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(open_ & (F.col("l_returnflag") == "N")).alias("queued"), F.sum("l_linenumber").alias("attempts"), F.min(F.when(open_, F.col("l_shipdate"))).alias("next_due"))


@query("SELECT o.o_custkey AS profile, o.o_orderkey AS run, o.o_orderdate AS started, count(l.l_linenumber) AS jobs FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def latest_run_counts(spark: SparkSession, base: str) -> DataFrame:
    latest = latest_by(t(spark, base, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    jobs = t(spark, base, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("jobs"))
    return latest.join(jobs, "o_orderkey", "left").select(F.col("o_custkey").alias("profile"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"), F.coalesce("jobs", F.lit(0)).alias("jobs"))


@query(f"WITH {_REVISIONS}, cur AS (SELECT * FROM revs QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY observed_at DESC, id DESC) = 1) SELECT id, asset_id FROM cur WHERE NOT EXISTS (SELECT 1 FROM photo_capture_metadata m WHERE m.asset_revision_id = cur.id)")
def pending_current_revisions(spark: SparkSession, base: str) -> DataFrame:
    seen = t(spark, base, "photo_capture_metadata").select(F.col("asset_revision_id").alias("id"))
    return current_revision(spark, base).join(seen, "id", "left_anti").select("id", "asset_id")


@query(f"WITH {_REVISIONS} SELECT lower(coalesce(media_type, 'application/octet-stream')) AS media_type, count(*) AS files, coalesce(sum(coalesce(size_bytes, 0)), 0)::BIGINT AS bytes FROM revs GROUP BY 1")
def media_inventory(spark: SparkSession, base: str) -> DataFrame:
    return revisions(spark, base).groupBy(F.lower(F.coalesce("media_type", F.lit("application/octet-stream"))).alias("media_type")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))), F.lit(0)).alias("bytes"))


@query(f"""WITH {_ACTIONS}, ppl AS (SELECT DISTINCT {sql_guid('id')} AS person_id, {sql_guid('merged_into_person_id')} AS merged_into FROM people)
SELECT p.person_id, (SELECT count(*) FROM acts a WHERE a.person_id = p.person_id) AS actions, (SELECT count(DISTINCT asset_revision_id) FROM acts a WHERE a.person_id = p.person_id) AS photos, (SELECT count(*) FROM ppl m WHERE m.merged_into = p.person_id) AS merged FROM ppl p""")
def people_maintenance_counts(spark: SparkSession, base: str) -> DataFrame:
    own = people(spark, base).select("person_id", "merged_into").distinct()
    # Actions are counted a (person, photo) first, so one person with very many photos is spread over tasks.
    counts = actions(spark, base).groupBy("person_id", "asset_revision_id").agg(F.count(F.lit(1)).alias("n")).groupBy("person_id").agg(F.sum("n").alias("actions"), F.count(F.lit(1)).alias("photos"))
    merged = own.groupBy(F.col("merged_into").alias("person_id")).agg(F.count(F.lit(1)).alias("merged"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(counts, "person_id", "left").join(merged, "person_id", "left").select("person_id", zero("actions"), zero("photos"), zero("merged"))


@query("""SELECT (SELECT max(id) FROM photo_person_actions) AS person_actions, (SELECT max(id) FROM face_embeddings) AS embeddings, (SELECT max(suggestion_id) FROM identity_suggestion_rankings) AS suggestions, (SELECT count(DISTINCT id) FROM people WHERE merged_into_person_id IS NOT NULL) AS merges""")
def evidence_version(spark: SparkSession, base: str) -> DataFrame:
    one = lambda name, c, alias: t(spark, base, name).agg(c.alias(alias))
    parts = [one("photo_person_actions", F.max("id"), "person_actions"), one("face_embeddings", F.max("id"), "embeddings"), one("identity_suggestion_rankings", F.max("suggestion_id"), "suggestions")]
    merges = t(spark, base, "people").filter("merged_into_person_id is not null").agg(F.countDistinct("id").alias("merges"))
    # Four single rows side by side.
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(merges)


@query(f"WITH {_REVISIONS} SELECT id, category, place FROM (SELECT id, coalesce(lower(media_type), '') AS category, row_number() OVER (PARTITION BY coalesce(lower(media_type), '') ORDER BY sha256('seed-1' || chr(10) || coalesce(lower(media_type), '') || chr(10) || id), id) AS place FROM revs) WHERE place <= 5")
def hash_ordered_sample(spark: SparkSession, base: str) -> DataFrame:
    """Five revisions of each media type, the same on every machine: a sampling operator."""
    rows = revisions(spark, base).select("id", F.coalesce(F.lower("media_type"), F.lit("")).alias("category"))
    return hash_sample(rows, "id", "category", "seed-1", 5).select("id", "category", F.col("place").cast("long").alias("place"))


@query(f"WITH {_REVISIONS} SELECT count(size_bytes) AS files, round(avg(size_bytes), 3) AS mean, quantile_cont(size_bytes, 0.5)::DOUBLE AS median, quantile_disc(size_bytes, 0.95)::BIGINT AS p95 FROM revs")
def size_percentiles(spark: SparkSession, base: str) -> DataFrame:
    out = quantiles(revisions(spark, base).select("size_bytes"), "size_bytes", Staging(spark, "sizes"))
    return out.select(F.col("files").cast("long").alias("files"), F.round("mean", 3).alias("mean"), F.col("median").cast("double").alias("median"), F.col("p95").cast("long").alias("p95"))


_OLD, _NEW = "observed_at < TIMESTAMPTZ '2022-01-01 00:00:00+00'", "observed_at >= TIMESTAMPTZ '2021-01-01 00:00:00+00'"
_TWO = f"{_REVISIONS}, old AS (SELECT asset_id, max_by(content_sha256, id) AS d FROM revs WHERE {_OLD} GROUP BY 1), new AS (SELECT asset_id, max_by(content_sha256, id) AS d FROM revs WHERE {_NEW} GROUP BY 1)"


def _two(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    rows = revisions(spark, base)
    pick = lambda df: df.groupBy("asset_id").agg(F.max_by("content_sha256", "id").alias("d"))
    cut = lambda day: F.to_timestamp(F.lit(f"{day} 00:00:00Z"), "yyyy-MM-dd HH:mm:ssX")
    return pick(rows.filter(F.col("observed_at") < cut("2022-01-01"))), pick(rows.filter(F.col("observed_at") >= cut("2021-01-01")))


@query(f"WITH {_TWO} SELECT coalesce(n.asset_id, o.asset_id) AS asset_id, CASE WHEN o.d IS NULL THEN 'new' WHEN n.d IS NULL THEN 'missing' WHEN o.d = n.d THEN 'same' ELSE 'changed' END AS change FROM new n FULL JOIN old o ON o.asset_id = n.asset_id")
def scan_difference(spark: SparkSession, base: str) -> DataFrame:
    old, new = _two(spark, base)
    return snapshot_diff(new, old, "asset_id", "d")


@query(f"WITH {_TWO} SELECT asset_id, d FROM old UNION ALL SELECT asset_id, d FROM new WHERE asset_id NOT IN (SELECT asset_id FROM old)")
def revision_insert_if_absent(spark: SparkSession, base: str) -> DataFrame:
    old, new = _two(spark, base)
    return insert_if_absent(old, new, ["asset_id"])


@query(f"WITH {_TWO} SELECT coalesce(n.asset_id, o.asset_id) AS asset_id, coalesce(n.d, o.d) AS d FROM new n FULL JOIN old o ON o.asset_id = n.asset_id")
def revision_upsert(spark: SparkSession, base: str) -> DataFrame:
    old, new = _two(spark, base)
    return upsert(old, new, ["asset_id"])


@query(f"WITH {_TWO} SELECT asset_id, d FROM old WHERE asset_id IN (SELECT asset_id FROM new) OR d < '4'")
def revision_delete_stale(spark: SparkSession, base: str) -> DataFrame:
    old, new = _two(spark, base)
    return delete_stale(old, new, ["asset_id"], F.col("d") < "4")


@query(f"WITH {_REVISIONS}, s AS (SELECT id, observed_at, size_bytes, coalesce(sum(size_bytes) OVER (ORDER BY observed_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS released_before FROM revs) SELECT id, observed_at, size_bytes, released_before FROM s WHERE released_before < 1000000000")
def lru_release_first_gigabyte(spark: SparkSession, base: str) -> DataFrame:
    return lru_release(revisions(spark, base).select("id", "observed_at", "size_bytes"), ["observed_at", "id"], "size_bytes", 1_000_000_000, Staging(spark, "lru"))


_ON_EARTH = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)"


@query(f"""WITH pos AS (SELECT DISTINCT {sql_guid('asset_revision_id')} AS asset_revision_id, latitude, longitude FROM photo_capture_metadata WHERE {_ON_EARTH}),
cached AS (SELECT DISTINCT provider, latitude, longitude, max(resolved_at) AS resolved_at FROM photo_place_reverse_geocode_cache WHERE provider = 'geo-cedar' AND contract_key LIKE 'v2%' GROUP BY ALL)
SELECT p.asset_revision_id, p.latitude, p.longitude, CASE WHEN c.latitude IS NULL THEN 'missing' WHEN c.resolved_at < TIMESTAMPTZ '2020-01-01 00:00:00+00' THEN 'refresh' ELSE 'known' END AS wanted FROM pos p LEFT JOIN cached c ON c.latitude = p.latitude AND c.longitude = p.longitude""")
def enrichment_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Usable positions beside what one provider's cache, under one contract, says of exactly them; old answers are asked again."""
    pos = t(spark, base, "photo_capture_metadata").select(guid("asset_revision_id").alias("asset_revision_id"), "latitude", "longitude").filter(on_earth(F.col("latitude"), F.col("longitude"))).distinct()
    cached = t(spark, base, "photo_place_reverse_geocode_cache").filter("provider = 'geo-cedar' and contract_key like 'v2%'").groupBy("latitude", "longitude").agg(F.max("resolved_at").alias("resolved_at"))
    cut = F.to_timestamp(F.lit("2020-01-01 00:00:00Z"), "yyyy-MM-dd HH:mm:ssX")
    wanted = F.when(F.col("resolved_at").isNull(), "missing").when(F.col("resolved_at") < cut, "refresh").otherwise("known")
    return pos.join(cached, ["latitude", "longitude"], "left").select("asset_revision_id", "latitude", "longitude", wanted.alias("wanted"))


@query(f"""WITH {_REVISIONS}, done AS (SELECT {sql_guid('asset_revision_id')} AS id, max(CASE WHEN extracted_at < TIMESTAMPTZ '2021-01-01 00:00:00+00' THEN 1 ELSE 2 END) AS version FROM photo_capture_metadata GROUP BY 1)
SELECT r.id, CASE WHEN d.version IS NULL THEN 'new' WHEN d.version < 2 THEN 'stale' ELSE 'forced' END AS reason FROM revs r LEFT JOIN done d ON d.id = r.id WHERE d.version IS NULL OR d.version < 2 OR r.size_bytes % 97 = 0""")
def stale_metadata(spark: SparkSession, base: str) -> DataFrame:
    """Revisions to read again: never read, read by an older version, or forced."""
    cut = F.to_timestamp(F.lit("2021-01-01 00:00:00Z"), "yyyy-MM-dd HH:mm:ssX")
    done = t(spark, base, "photo_capture_metadata").groupBy(guid("asset_revision_id").alias("id")).agg(F.max(F.when(F.col("extracted_at") < cut, 1).otherwise(2)).alias("version"))
    version, forced = F.col("version"), F.coalesce(F.col("size_bytes") % 97 == 0, F.lit(False))
    rows = revisions(spark, base).select("id", "size_bytes").join(done, "id", "left").filter(version.isNull() | (version < 2) | forced)
    return rows.select("id", F.when(version.isNull(), "new").when(version < 2, "stale").otherwise("forced").alias("reason"))


@query(f"WITH {_PLACES} SELECT DISTINCT place FROM plc WHERE place = 'places/velrickor' OR starts_with(place, 'places/velrickor/') OR place = 'places/bramoraia/ostsia' OR starts_with(place, 'places/bramoraia/ostsia/')")
def folder_scope(spark: SparkSession, base: str) -> DataFrame:
    """Paths below any of the included folders; a folder below another included one adds nothing."""
    return places(spark, base).filter(within_folders(F.col("place"), ["places/velrickor/", "places\\\\velrickor\\\\ostdal", "places/bramoraia/ostsia"])).select("place").distinct()


@query(f"WITH {_REVISIONS} SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next, row_number() OVER w AS position, count(*) OVER () AS total FROM revs WINDOW w AS (ORDER BY observed_at, id)")
def queue_navigation_global(spark: SparkSession, base: str) -> DataFrame:
    """One queue over all revisions, by ranges."""
    return neighbours(revisions(spark, base).select("id", "observed_at"), "id", [F.asc("observed_at"), F.asc("id")], Staging(spark, "queue"))


@query(f"WITH {_REVISIONS} SELECT asset_id, id AS revision, 1000 + row_number() OVER (ORDER BY observed_at, id) AS id FROM revs")
def numbered_inserts(spark: SparkSession, base: str) -> DataFrame:
    """New ids for a batch, in the order in which its rows were seen."""
    rows = revisions(spark, base).select("asset_id", F.col("id").alias("revision"), "observed_at")
    return with_new_ids(1000, rows, ["observed_at", "revision"], Staging(spark, "ids")).select("asset_id", "revision", "id")


@query(f"WITH {_PLACES}, p AS (SELECT DISTINCT place FROM plc), a AS (SELECT DISTINCT array_to_string(list_slice(string_split(place, '/'), 1, n), '/') AS path FROM p, range(1, 40) r(n) WHERE n <= len(string_split(place, '/'))) SELECT path, string_split(path, '/')[-1] AS leaf, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') END AS parent FROM a")
def place_tree(spark: SparkSession, base: str) -> DataFrame:
    """The vocabulary of places with all ancestors, each with its leaf name and parent."""
    paths = places(spark, base).select("place").distinct().select(F.explode(ancestors(F.col("place"))).alias("path")).distinct()
    return paths.select("path", leaf(F.col("path")).alias("leaf"), parent(F.col("path")).alias("parent"))


@query(f"""WITH {_ACTIONS}, ppl AS (SELECT DISTINCT {sql_guid('id')} AS person_id, {sql_guid('merged_into_person_id')} AS merged_into FROM people), m AS (SELECT person_id AS old, merged_into AS new FROM ppl WHERE merged_into IN (SELECT person_id FROM ppl) AND merged_into <> person_id)
SELECT DISTINCT a.asset_revision_id, coalesce(m.new, a.person_id) AS person_id FROM acts a LEFT JOIN m ON m.old = a.person_id WHERE a.person_id IS NOT NULL""")
def merge_remap(spark: SparkSession, base: str) -> DataFrame:
    """Actions moved to the person that theirs was merged into, once a photo and person."""
    own = people(spark, base).select("person_id", "merged_into").distinct()
    mapping = own.join(own.select(F.col("person_id").alias("merged_into")).distinct(), "merged_into").filter("merged_into <> person_id").select(F.col("person_id").alias("old"), F.col("merged_into").alias("new"))
    rows = actions(spark, base).filter("person_id is not null").select("asset_revision_id", "person_id").distinct()
    return remap(rows, "person_id", mapping, ["asset_revision_id", "person_id"])


@query("""SELECT rule, violations FROM (
SELECT 'vector without crop' AS rule, count(*) AS violations FROM (SELECT DISTINCT id, face_crop_id FROM face_embeddings) e WHERE NOT EXISTS (SELECT 1 FROM face_crops c WHERE c.crop_id = e.face_crop_id)
UNION ALL SELECT 'vector of wrong length', count(*) FROM (SELECT DISTINCT id, octet_length(vector_blob) AS l, dimensions FROM face_embeddings) WHERE l IS NULL OR l <> dimensions * 4
UNION ALL SELECT 'offset out of range', count(*) FROM photo_capture_metadata WHERE utc_offset_minutes NOT BETWEEN -840 AND 840
UNION ALL SELECT 'half a position', count(*) FROM photo_capture_metadata WHERE (latitude IS NULL) <> (longitude IS NULL)
UNION ALL SELECT 'rank below 1', count(*) FROM identity_suggestion_rankings WHERE rank < 1
UNION ALL SELECT 'digest malformed', count(*) FROM asset_revisions WHERE NOT regexp_full_match(content_sha256, '[0-9a-f]{64}')
UNION ALL SELECT 'repeated revision', count(*) FROM (SELECT id FROM asset_revisions GROUP BY id HAVING count(*) > 1))""")
def constraint_violations(spark: SparkSession, base: str) -> DataFrame:
    meta, vectors, revs = t(spark, base, "photo_capture_metadata"), t(spark, base, "face_embeddings"), t(spark, base, "asset_revisions")
    lengths = vectors.select("id", F.length("vector_blob").alias("l"), "dimensions").distinct()
    crops = t(spark, base, "face_crops").select(F.col("crop_id").alias("face_crop_id"))
    rules = {
        "vector without crop": vectors.select("id", "face_crop_id").distinct().join(crops, "face_crop_id", "left_anti"),
        "vector of wrong length": lengths.filter("l is null or l <> dimensions * 4"),
        "offset out of range": meta.filter("utc_offset_minutes not between -840 and 840"),
        "half a position": meta.filter("(latitude is null) <> (longitude is null)"),
        "rank below 1": t(spark, base, "identity_suggestion_rankings").filter("rank < 1"),
        "digest malformed": revs.filter(~F.col("content_sha256").rlike("^[0-9a-f]{64}$")),
        "repeated revision": revs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    }
    out = None
    for rule, rows in rules.items():
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH k AS (SELECT DISTINCT crop_id AS k FROM face_crops WHERE crop_id IS NOT NULL), g AS (SELECT substr(sha256(k), 1, 4) AS g, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS d FROM k GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256('assign' || chr(10) || 'preview' || chr(10) || string_agg(d, chr(10) ORDER BY g)) AS token FROM g""")
def bulk_preview_token(spark: SparkSession, base: str) -> DataFrame:
    return selection_token(t(spark, base, "face_crops"), "crop_id", "assign", "preview")


@query("SELECT face_occurrence_id FROM (SELECT face_occurrence_id FROM identity_suggestion_rankings INTERSECT SELECT face_occurrence_id FROM face_crops)")
def ranked_faces_with_crops(spark: SparkSession, base: str) -> DataFrame:
    return t(spark, base, "identity_suggestion_rankings").select("face_occurrence_id").intersect(t(spark, base, "face_crops").select("face_occurrence_id"))


@query("SELECT face_occurrence_id FROM (SELECT face_occurrence_id FROM face_crops EXCEPT SELECT face_occurrence_id FROM identity_suggestion_rankings)")
def crops_without_ranking(spark: SparkSession, base: str) -> DataFrame:
    return t(spark, base, "face_crops").select("face_occurrence_id").subtract(t(spark, base, "identity_suggestion_rankings").select("face_occurrence_id"))


@query(f"""WITH {_PLACES}, cells AS (SELECT DISTINCT floor(latitude * 10) AS lat, floor(longitude * 10) AS lon, place FROM plc), deep AS (SELECT lat, lon, max_by(place, (length(place), place)) AS deepest FROM cells GROUP BY 1, 2),
met AS (SELECT lat, lon, place, deepest, place = deepest OR starts_with(deepest, place || '/') AS ok FROM cells JOIN deep USING (lat, lon))
SELECT lat::BIGINT AS lat, lon::BIGINT AS lon, CASE WHEN bool_and(ok) THEN any_value(deepest) END AS place, CASE WHEN NOT bool_and(ok) THEN string_agg(place, '; ' ORDER BY place) FILTER (NOT ok OR place = deepest) END AS conflict FROM met GROUP BY 1, 2""")
def place_chains(spark: SparkSession, base: str) -> DataFrame:
    """One place for each tenth of a degree, where its cached places lie on one path; else the conflict."""
    rows = places(spark, base).select(F.floor(F.col("latitude") * 10).alias("lat"), F.floor(F.col("longitude") * 10).alias("lon"), "place")
    return resolve_chains(rows, ["lat", "lon"], "place")


@query(f"WITH {_PLACES} SELECT DISTINCT place, CASE WHEN len(l) > 1 AND lower(l[-2]) <> lower(l[-1]) THEN l[-2] || ' · ' || l[-1] ELSE l[-1] END AS label FROM (SELECT place, list_filter(string_split(place, '/'), lambda x: x <> 'places') AS l FROM plc)")
def place_labels(spark: SparkSession, base: str) -> DataFrame:
    return places(spark, base).select("place", display_label(F.col("place")).alias("label")).distinct()


@query(f"""WITH {_REVISIONS}, {_PRESENT}, n AS (SELECT asset_revision_id, count(*) AS people FROM present GROUP BY 1) SELECT r.id, r.media_type, coalesce(n.people, 0) AS people, v.total FROM revs r LEFT JOIN n ON n.asset_revision_id = r.id LEFT JOIN (SELECT count(*) AS total FROM present) v ON true""")
def photo_details(spark: SparkSession, base: str) -> DataFrame:
    """Every revision with its number of people, kept where there are none, beside a total that joins on nothing."""
    now = present(spark, base)
    counts = now.groupBy(F.col("asset_revision_id").alias("id")).agg(F.count(F.lit(1)).alias("people"))
    total = now.agg(F.count(F.lit(1)).alias("total"))
    # The right side is a single row.
    return revisions(spark, base).select("id", "media_type").join(counts, "id", "left").join(F.broadcast(total), F.lit(True), "left").select("id", "media_type", F.coalesce("people", F.lit(0)).alias("people"), "total")


@query(f"""WITH {_ACTIONS} SELECT asset_revision_id, person_id FROM acts a WHERE action_kind = 'add' AND person_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM acts b WHERE b.asset_revision_id = a.asset_revision_id AND b.action_kind = 'remove') GROUP BY ALL""")
def labels_without_review(spark: SparkSession, base: str) -> DataFrame:
    """People of the photos in which nobody was ever removed: older evidence counts only where there is no review at all."""
    rows = actions(spark, base)
    reviewed = rows.filter("action_kind = 'remove'").select("asset_revision_id").distinct()
    return rows.filter("action_kind = 'add' and person_id is not null").select("asset_revision_id", "person_id").distinct().join(reviewed, "asset_revision_id", "left_anti")


@query("SELECT lower(provider) AS grp, count(*) AS answers, count(*) FILTER (country_code IS NULL) AS uncoded, CASE WHEN count(*) = 0 THEN 1 ELSE round(count(*) FILTER (provider_result_id IS NOT NULL) / count(*)::DOUBLE, 6) END AS recall FROM (SELECT DISTINCT * FROM photo_place_reverse_geocode_cache) GROUP BY 1")
def metrics_by_group(spark: SparkSession, base: str) -> DataFrame:
    """Answers of each provider, whatever its case, and the part with a result id (1 where there are none)."""
    rows = t(spark, base, "photo_place_reverse_geocode_cache").distinct()
    return rows.groupBy(F.lower("provider").alias("grp")).agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("country_code").isNull()).alias("uncoded"), F.round(ratio(F.count_if(F.col("provider_result_id").isNotNull()), F.count(F.lit(1)), 1.0), 6).alias("recall"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
