"""Queries of the core's general operators over the archive's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.guid import guid
from darkroom.operators.hierarchy import descendant_pairs, hierarchy, tree_paths
from darkroom.operators.instants import estimate_instants, recovery, resolve_instants
from darkroom.operators.spatial import nearby
from darkroom.plans.staging import Staging
from darkroom.sources.tables import read_table


def _tree(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy(read_table(spark, base, "people"), guid("id"), guid("merged_into_person_id"), Staging(spark, "p3"))


def _staged_tree(spark: SparkSession, base: str) -> DataFrame:
    return Staging(spark, "p3t").save(_tree(spark, base))


def _dated(spark: SparkSession, base: str, label: str) -> DataFrame:
    """Rows with a wall clock, their instant where they determine one, and the band of longitude that stands for a camera, staged under ``label``."""
    staging = Staging(spark, label)
    meta = read_table(spark, base, "photo_capture_metadata").distinct()
    row = F.concat_ws(" ", F.col("asset_revision_id"), F.unix_micros("extracted_at"))
    # Written before they are filtered: a filter would be pushed down and repeat all that reads a text.
    read = staging.save(resolve_instants(meta.withColumn("row", row), "row", "taken_at_local", "utc_offset_minutes", "capture_zone"))
    # The nearest thing to a camera in these tables is the hour's band of longitude in which a photo was taken.
    band = F.when(F.col("longitude").between(-180, 180), F.floor(F.col("longitude") / 15)).otherwise(F.lit(99)).cast("int")
    sources = meta.select(row.alias("row"), "asset_revision_id", "extracted_at", band.alias("band"))
    return staging.save(read.filter("local_s is not null").join(sources, "row").withColumn("known_s", F.floor(F.col("utc_ms") / 1000)).select("row", "asset_revision_id", "extracted_at", "band", "local_s", "sub_ms", "known_s"))


def p1_estimated(spark: SparkSession, base: str) -> DataFrame:
    """Instants of the photos whose row determines none but has a wall clock, by the offset history of its band of longitude and month of import.

    An estimate, kept apart from p1_found; p1_recovery measures it.
    """
    rows = _dated(spark, base, "p1")
    est = estimate_instants(rows, "band", "extracted_at", 30 * 86_400).filter("known_s is null and est_s is not null")
    return est.groupBy("asset_revision_id").agg(F.min(F.col("est_s") * 1000 + F.col("sub_ms")).alias("taken_utc_ms"))


def p1_recovery(spark: SparkSession, base: str) -> DataFrame:
    """How many known instants the estimate gives back, if one in ten is hidden."""
    rows = _dated(spark, base, "p1r")
    return recovery(rows, "band", "extracted_at", 30 * 86_400, "row")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Root and depth of every person whose link leads to a person that exists."""
    return _tree(spark, base).filter("parent is not null").select(F.col("v").alias("person_id"), F.col("root").alias("root_person_id"), "depth")


def p3_hierarchy(spark: SparkSession, base: str) -> DataFrame:
    """Every person with its path from the final person, depth, number of people merged into it, whether it's in a circle, and its interval: those merged into it have theirs within it."""
    tree = _staged_tree(spark, base)
    paths = tree_paths(tree).select("v", F.array_join("path", "/").alias("path"))
    return tree.join(paths, "v").select(F.col("v").alias("person_id"), F.col("root").alias("root_person_id"), "depth", "path", "descendants", "in_cycle", F.col("tree").alias("tree_id"), "entry", "exit")


def p3_paths(spark: SparkSession, base: str) -> DataFrame:
    """p3_hierarchy without the intervals, whose numbers depend on the order of siblings."""
    return p3_hierarchy(spark, base).drop("tree_id", "entry", "exit")


def p3_descendants(spark: SparkSession, base: str) -> DataFrame:
    """Every person with each person that was merged into it, directly or through others."""
    return descendant_pairs(tree_paths(_staged_tree(spark, base))).select(F.col("v").alias("person_id"), F.col("descendant").alias("merged_person_id"))


def p1_instants(spark: SparkSession, base: str) -> DataFrame:
    """Every row's instant with what decided it; null where the row determines none."""
    rows = resolve_instants(read_table(spark, base, "photo_capture_metadata"), "asset_revision_id", "taken_at_local", "utc_offset_minutes", "capture_zone")
    return rows.select(guid("asset_revision_id").alias("asset_revision_id"), "utc_ms", "basis").distinct()


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """The instant of every photo whose row determines one."""
    return p1_instants(spark, base).filter("utc_ms is not null and asset_revision_id is not null").select("asset_revision_id", F.col("utc_ms").alias("taken_utc_ms")).distinct()


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Photos at most 50 m apart, cached places at most 50 m from a photo, and the areas around a photo."""
    photos = read_table(spark, base, "photo_capture_metadata").select(guid("asset_revision_id").alias("key"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    places = read_table(spark, base, "photo_place_reverse_geocode_cache").select(F.col("place_value").alias("key"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    areas = read_table(spark, base, "place_areas").withColumnRenamed("area_id", "key")
    kinds = F.create_map(*[F.lit(x) for pair in (("point", "photo"), ("other", "place"), ("area", "area")) for x in pair])
    return nearby(photos, places, areas, 50.0).select(kinds[F.col("kind")].alias("kind"), "key_a", "key_b").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_instants": p1_instants, "p1_estimated": p1_estimated, "p1_recovery": p1_recovery, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p6_found": p6_found}


_LINKS = r"""links AS (
  SELECT DISTINCT lower(id) AS v, CASE WHEN length(h) = 32 THEN h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS p
  FROM (SELECT id, lower(regexp_replace(merged_into_person_id, '[{}\s-]', '', 'g')) AS h FROM people)),
known AS (SELECT v, CASE WHEN p IN (SELECT v FROM links) THEN p END AS p FROM links)"""


def oracle_sql() -> dict[str, str]:
    walk = f"""WITH RECURSIVE {_LINKS},
walk AS (
  SELECT v, p AS at, 1 AS depth, [v] AS seen, false AS circle FROM known WHERE p IS NOT NULL
  UNION ALL
  SELECT w.v, k.p, w.depth + 1, list_append(w.seen, w.at), list_contains(w.seen, w.at)
  FROM walk w JOIN known k ON k.v = w.at WHERE k.p IS NOT NULL AND NOT w.circle)"""
    found = """ends AS (SELECT v, max(depth) AS depth, bool_or(circle) AS circle FROM walk GROUP BY v)
SELECT e.v AS person_id, CASE WHEN e.circle THEN list_min(list_slice(w.seen, list_position(w.seen, w.seen[-1]), len(w.seen) - 1)) ELSE w.at END AS root_person_id,
       CASE WHEN e.circle THEN -1 ELSE e.depth END AS depth
FROM ends e JOIN walk w ON w.v = e.v AND w.depth = e.depth"""
    # On a circle nobody lies below another; a tree that hangs on it ends at the circle.
    loops = "loops AS (SELECT DISTINCT w.v FROM walk w WHERE w.at = w.v), trees AS (SELECT w.* FROM walk w WHERE w.v NOT IN (SELECT v FROM loops) AND NOT EXISTS (SELECT 1 FROM loops l WHERE list_contains(w.seen, l.v)))"
    near = "2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 50"
    return {
        "p6_found": f"""WITH photos AS (SELECT DISTINCT lower(asset_revision_id) AS key, latitude AS lat, longitude AS lon FROM photo_capture_metadata WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
places AS (SELECT DISTINCT place_value AS key, latitude AS lat, longitude AS lon FROM photo_place_reverse_geocode_cache WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))
SELECT DISTINCT 'photo' AS kind, a.key AS key_a, b.key AS key_b FROM photos a JOIN photos b ON a.key < b.key AND abs(a.lat - b.lat) < 0.001 WHERE {near}
UNION SELECT 'place', a.key, b.key FROM photos a JOIN places b ON abs(a.lat - b.lat) < 0.001 WHERE {near}
UNION SELECT 'area', a.key, b.area_id FROM photos a JOIN place_areas b ON a.lat BETWEEN b.south AND b.north AND a.lon BETWEEN b.west AND b.east""",
        "p3_found": walk + ",\n" + found,
        "p3_descendants": f"{walk}, {loops} SELECT DISTINCT t.at AS person_id, t.v AS merged_person_id FROM trees t",
        "p3_paths": f"""{walk}, {loops}, ends AS (SELECT v, max(depth) AS depth, bool_or(circle) AS circle FROM walk GROUP BY v), found AS ({found.split("GROUP BY v)", 1)[1]}),
paths AS (SELECT v, arg_max(list_append(seen, t.at), depth) AS chain FROM trees t GROUP BY v), below AS (SELECT t.at AS v, count(DISTINCT t.v) AS n FROM trees t GROUP BY 1)
SELECT DISTINCT k.v AS person_id, coalesce(f.root_person_id, k.v) AS root_person_id, coalesce(f.depth, 0)::INTEGER AS depth, array_to_string(list_reverse(coalesce(p.chain, [k.v])), '/') AS path, coalesce(b.n, 0)::BIGINT AS descendants, k.v IN (SELECT v FROM loops) AS in_cycle
FROM known k LEFT JOIN found f ON f.person_id = k.v LEFT JOIN paths p ON p.v = k.v LEFT JOIN below b ON b.v = k.v""",
    }
