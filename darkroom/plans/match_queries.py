"""Queries of matching, evaluation and geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.vectors import blob_fits, blob_to_array, l2_norm
from darkroom.operators.evaluation import best_threshold, confusion, detection_metrics, overlap, ratio, same_rows, threshold_sweep
from darkroom.operators.geometry import decode_grid, match_kinds, overlapping_pairs, reconcile, suppress, tiles, to_source, to_unit
from darkroom.operators.matching import best_people, confidence
from darkroom.plans.dialect import sql_vectors
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


# The driver's table of labelled vectors: every fifth is a face to be named, the others are the people's exemplars.
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1] * x[2])::DOUBLE))"
_SCORES = f"""norms AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE))) AS norm FROM embeddings),
best AS (SELECT a.vec_id AS face_id, b.label::VARCHAR AS person_id, max({_DOT} / a.norm / b.norm) AS score FROM norms a, norms b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY ALL)"""
_TOP = """top AS (SELECT *, max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY face_id) - max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY face_id) AS margin
FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, person_id) AS rank FROM best) WHERE rank <= 2)"""


def _top2(spark: SparkSession, base: str, rejected: DataFrame | None = None) -> DataFrame:
    rows = t(spark, base, "embeddings").select(F.col("vec_id").alias("face_id"), F.col("label").alias("person_id"), F.col("embedding").alias("vector"))
    return best_people(rows.filter("face_id % 5 = 0"), rows.filter("face_id % 5 <> 0"), rejected)


@query(f"WITH {_SCORES}, {_TOP} SELECT face_id, person_id, rank, round(score, 6) AS score, round(margin, 6) AS margin FROM top")
def identity_top2(spark: SparkSession, base: str) -> DataFrame:
    return _top2(spark, base).select("face_id", "person_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(f"WITH {_SCORES}, {_TOP} SELECT CASE WHEN score >= 0.7 AND margin >= 0.1 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS grp, count(*) AS faces FROM top WHERE rank = 1 GROUP BY 1")
def identity_confidence_groups(spark: SparkSession, base: str) -> DataFrame:
    return _top2(spark, base).filter("rank = 1").groupBy(confidence(F.col("score"), F.col("margin")).alias("grp")).agg(F.count(F.lit(1)).alias("faces"))


@query(f"WITH {_SCORES.replace('best AS (', 'every AS (')}, best AS (SELECT * FROM every WHERE person_id <> (face_id % 10)::VARCHAR), {_TOP} SELECT face_id, person_id, rank, round(score, 6) AS score FROM top")
def rejected_pair_exclusion(spark: SparkSession, base: str) -> DataFrame:
    rejected = t(spark, base, "embeddings").select(F.col("vec_id").alias("face_id"), (F.col("vec_id") % 10).cast("string").alias("person_id"))
    return _top2(spark, base, rejected).select("face_id", "person_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_STEPS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
_SAMPLES = f"{_SCORES}, {_TOP}, samples AS (SELECT CASE WHEN e.label < 8 THEN e.label::VARCHAR END AS expected, p.person_id AS predicted, p.score FROM embeddings e JOIN top p ON p.face_id = e.vec_id WHERE p.rank = 1)"
_SWEEP = f"""{_SAMPLES}, counts AS (SELECT threshold, count(*) FILTER (expected IS NOT NULL) AS n_known, count(*) FILTER (expected IS NULL) AS n_unknown, count(*) FILTER (score >= threshold) AS n_accepted,
count(*) FILTER (score >= threshold AND expected = predicted) AS n_right, count(*) FILTER (expected IS NULL AND score < threshold) AS n_unknown_rejected FROM samples, (SELECT unnest({_STEPS})::DOUBLE AS threshold) GROUP BY 1),
sweep AS (SELECT *, CASE WHEN n_accepted = 0 THEN 0 ELSE n_right / n_accepted::DOUBLE END AS precision, CASE WHEN n_known = 0 THEN 0 ELSE n_right / n_known::DOUBLE END AS known_recall, CASE WHEN n_unknown = 0 THEN 0 ELSE n_unknown_rejected / n_unknown::DOUBLE END AS unknown_rejection FROM counts)"""


def _samples(spark: SparkSession, base: str) -> DataFrame:
    """People 8 and above count as unknown."""
    labels = t(spark, base, "embeddings").select(F.col("vec_id").alias("face_id"), F.when(F.col("label") < 8, F.col("label").cast("string")).alias("expected"))
    return labels.join(_top2(spark, base).filter("rank = 1"), "face_id").select("expected", F.col("person_id").alias("predicted"), "score")


_SWEPT = "threshold, n_known, n_unknown, n_accepted, n_right, n_unknown_rejected, round(precision, 6) AS precision, round(known_recall, 6) AS known_recall, round(unknown_rejection, 6) AS unknown_rejection, round((known_recall + unknown_rejection) / 2, 6) AS balanced"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("threshold", "n_known", "n_unknown", "n_accepted", "n_right", "n_unknown_rejected", *[F.round(c, 6).alias(c) for c in ("precision", "known_recall", "unknown_rejection", "balanced")])


@query(f"WITH {_SWEEP} SELECT {_SWEPT} FROM sweep")
def threshold_sweep_metrics(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(threshold_sweep(_samples(spark, base), _STEPS))


@query(f"WITH {_SWEEP} SELECT {_SWEPT} FROM sweep ORDER BY (known_recall + unknown_rejection) / 2 DESC, sweep.precision DESC, sweep.unknown_rejection DESC, threshold DESC LIMIT 1")
def selected_threshold(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(best_threshold(threshold_sweep(_samples(spark, base), _STEPS)))


@query(f"WITH {_SAMPLES} SELECT coalesce(expected, '<unknown>') AS expected, CASE WHEN score IS NULL THEN '<missed>' WHEN score < 0.4 THEN '<rejected>' ELSE predicted END AS predicted, count(*) AS n FROM samples GROUP BY ALL")
def confusion_matrix(spark: SparkSession, base: str) -> DataFrame:
    return confusion(_samples(spark, base), 0.4)


# Boxes on a grid of 1/64, from the driver's line items: an order is a photo, its lines are its boxes.
_X = {"x": "(l_partkey % 8) / 64.0", "y": "(l_suppkey % 8) / 64.0", "w": "(l_quantity % 6 + 2) / 64.0", "h": "(l_linenumber + 2) / 64.0"}
_SQL_BOX = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _X.items())
_BOXES = f"boxes AS (SELECT l_orderkey AS photo, l_linenumber AS id, l_returnflag AS flag, {_SQL_BOX}, ((l_partkey % 5) / 64.0)::DOUBLE AS shift FROM lineitem), truth AS (SELECT * FROM boxes WHERE flag = 'N'), cand AS (SELECT * FROM boxes WHERE flag <> 'N')"


#: Five points of a box, as parts of its size; a shift that the part gives moves all of them.
_POINTS = ((0.25, 0.25), (0.75, 0.25), (0.5, 0.5), (0.25, 0.75), (0.75, 0.75))
_SHIFT = "(l_partkey % 5) / 64.0"


def _boxes(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    rows = t(spark, base, "lineitem").select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("flag"), *[F.expr(f"double({v})").alias(k) for k, v in _X.items()], F.expr(f"double({_SHIFT})").alias("shift"))
    rows = rows.withColumn("marks", F.array(*[F.struct((F.col("x") + F.col("w") * a + F.col("shift")).alias("x"), (F.col("y") + F.col("h") * b).alias("y")) for a, b in _POINTS]))
    return rows.filter("flag = 'N'"), rows.filter("flag <> 'N'")


_PAIRS = """p0 AS (SELECT l.photo, l.id AS l_id, r.id AS r_id, greatest(least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x), 0) * greatest(least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y), 0) AS s, l.w * l.h + r.w * r.h AS areas FROM truth l JOIN cand r ON r.photo = l.photo),
pairs AS (SELECT photo, l_id, r_id, CASE WHEN areas - s > 0 THEN s / (areas - s) ELSE 0 END AS iou FROM p0)"""


@query(f"WITH {_BOXES}, {_PAIRS} SELECT photo, l_id, r_id, round(iou, 6) AS iou FROM pairs WHERE iou + 1e-12 >= 0.25")
def iou_pairs(spark: SparkSession, base: str) -> DataFrame:
    truth, cand = _boxes(spark, base)
    return overlapping_pairs(truth, cand, "photo", 0.25).select("photo", "l_id", "r_id", F.round("iou", 6).alias("iou"))


_GAPS = " + ".join(f"sqrt(pow(l.x + l.w * {a} + l.shift - r.x - r.w * {a} - r.shift, 2) + pow(l.y + l.h * {b} - r.y - r.h * {b}, 2))" for a, b in _POINTS)
_PLAN = f"""WITH {_BOXES}, m0 AS (SELECT l.photo, l.id AS l_id, r.id AS r_id, greatest(least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x), 0) * greatest(least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y), 0) AS s, l.w * l.h + r.w * r.h AS areas,
({_GAPS}) / 5 / ((sqrt(l.w * l.w + l.h * l.h) + sqrt(r.w * r.w + r.h * r.h)) / 2) AS apart FROM truth l JOIN cand r ON r.photo = l.photo),
el AS (SELECT photo, l_id, r_id, count(*) OVER (PARTITION BY photo, r_id) AS c, count(*) OVER (PARTITION BY photo, l_id) AS e FROM m0 WHERE CASE WHEN areas - s > 0 THEN s / (areas - s) ELSE 0 END + 1e-12 >= 0.3 AND apart <= 0.2 + 1e-12)"""


@query(_PLAN + """ SELECT b.photo, b.id AS candidate, CASE WHEN s.l_id IS NOT NULL THEN 'existing' WHEN b.id IN (SELECT r_id FROM el WHERE el.photo = b.photo) THEN 'ambiguous' ELSE 'new' END AS outcome, s.l_id AS existing_id FROM cand b LEFT JOIN (SELECT * FROM el WHERE c = 1 AND e = 1) s ON s.photo = b.photo AND s.r_id = b.id""")
def reconciliation_plan(spark: SparkSession, base: str) -> DataFrame:
    truth, cand = _boxes(spark, base)
    return reconcile(truth, cand, "photo")[0]


@query(_PLAN + " SELECT photo, id AS existing_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.photo = t.photo AND el.l_id = t.id AND c = 1 AND e = 1)")
def reconciliation_unmatched(spark: SparkSession, base: str) -> DataFrame:
    truth, cand = _boxes(spark, base)
    return reconcile(truth, cand, "photo")[1]


_KINDS = f"""WITH {_BOXES}, {_PAIRS}, e0 AS (SELECT photo, l_id, r_id, count(*) OVER (PARTITION BY photo, l_id) AS t, count(*) OVER (PARTITION BY photo, r_id) AS c FROM pairs WHERE iou + 1e-12 >= 0.3),
e1 AS (SELECT *, max(c) OVER (PARTITION BY photo, l_id) AS m FROM e0), e2 AS (SELECT photo, l_id, r_id, CASE WHEN t = 1 AND c = 1 THEN 'matched' WHEN t > 1 AND m = 1 THEN 'duplicate' ELSE 'ambiguous' END AS kind FROM e1),
kinds AS (SELECT t.photo, 'truth' AS side, t.id::BIGINT AS id, coalesce(e.kind, 'missed') AS kind FROM truth t LEFT JOIN (SELECT DISTINCT photo, l_id, kind FROM e2) e ON e.photo = t.photo AND e.l_id = t.id
UNION ALL SELECT t.photo, 'candidate', t.id::BIGINT, coalesce(e.kind, 'false') FROM cand t LEFT JOIN (SELECT DISTINCT photo, r_id, kind FROM e2) e ON e.photo = t.photo AND e.r_id = t.id)"""


@query(_KINDS + " SELECT photo, side, id, kind FROM kinds")
def match_component_kinds(spark: SparkSession, base: str) -> DataFrame:
    truth, cand = _boxes(spark, base)
    return match_kinds(truth, cand, "photo", 0.3)


@query(_KINDS + """, n AS (SELECT count(*) FILTER (side = 'truth') AS faces, count(*) FILTER (side = 'truth' AND kind = 'matched') AS matched, count(*) FILTER (side = 'truth' AND kind = 'missed') AS missed, count(*) FILTER (side = 'candidate' AND kind = 'false') AS false_found,
count(*) FILTER (side = 'candidate' AND kind = 'duplicate') AS duplicates, count(*) FILTER (kind = 'ambiguous') AS ambiguous FROM kinds) SELECT *, CASE WHEN faces = 0 THEN 1 ELSE round(matched / faces::DOUBLE, 6) END AS recall FROM n""")
def detector_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Recall and precision of the candidates, from the kinds of their components."""
    kinds = match_component_kinds(spark, base)
    n = lambda side, kind: F.count_if((F.col("side") == side) & (F.col("kind") == kind))
    counts = kinds.agg(F.count_if(F.col("side") == "truth").alias("faces"), n("truth", "matched").alias("matched"), n("truth", "missed").alias("missed"), n("candidate", "false").alias("false_found"), n("candidate", "duplicate").alias("duplicates"), F.count_if(F.col("kind") == "ambiguous").alias("ambiguous"))
    return counts.select("*", F.round(ratio(F.col("matched"), F.col("faces"), 1.0), 6).alias("recall"))


_GROUPED = _KINDS + """, each AS (SELECT photo, count(*) FILTER (side = 'truth') AS faces, count(*) FILTER (side = 'truth' AND kind = 'matched') AS matched, count(*) FILTER (side = 'truth' AND kind = 'missed') AS missed, count(*) FILTER (side = 'candidate' AND kind = 'false') AS false_found,
count(*) FILTER (side = 'candidate' AND kind = 'duplicate') AS duplicates, count(*) FILTER (kind = 'ambiguous') AS ambiguous FROM kinds GROUP BY 1),
own AS (SELECT o_orderkey AS photo, lower(o_orderpriority) AS grp, coalesce(faces, 0) AS faces, coalesce(matched, 0) AS matched, coalesce(missed, 0) AS missed, coalesce(false_found, 0) AS false_found, coalesce(duplicates, 0) AS duplicates, coalesce(ambiguous, 0) AS ambiguous FROM orders LEFT JOIN each ON photo = o_orderkey),
views AS (SELECT *, grp AS v FROM own UNION ALL SELECT *, '<overall>' FROM own UNION ALL SELECT *, '<5+ faces>' FROM own WHERE faces >= 5),
sums AS (SELECT v AS grp, count(*) AS photos, sum(faces)::BIGINT AS faces, sum(matched)::BIGINT AS matched, sum(missed)::BIGINT AS missed, sum(false_found)::BIGINT AS false_found, sum(duplicates)::BIGINT AS duplicates, sum(ambiguous)::BIGINT AS ambiguous FROM views GROUP BY v)"""


@query(_GROUPED + " SELECT *, CASE WHEN faces = 0 THEN 1 ELSE round(matched / faces::DOUBLE, 6) END AS recall FROM sums")
def detector_metrics_by_group(spark: SparkSession, base: str) -> DataFrame:
    """Metrics overall, of photos with five faces or more, and by group whatever its case."""
    photos = t(spark, base, "orders").select(F.col("o_orderkey").alias("photo"), F.col("o_orderpriority").alias("grp"))
    out = detection_metrics(match_component_kinds(spark, base), photos, 5)
    return out.withColumn("recall", F.round("recall", 6))


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'N') WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey % 50 = 0)")
def split_overlap(spark: SparkSession, base: str) -> DataFrame:
    """How many people two sets of samples share."""
    rows = t(spark, base, "lineitem")
    return overlap(rows.filter("l_returnflag = 'N'"), rows.filter("l_returnflag <> 'N' and l_partkey % 50 = 0"), "l_suppkey")


@query("WITH a AS (SELECT DISTINCT face_occurrence_id, suggestion_id, rank FROM identity_suggestion_rankings WHERE model_id LIKE '%lumen%'), b AS (SELECT DISTINCT face_occurrence_id, suggestion_id, rank FROM identity_suggestion_rankings WHERE rank <= 2) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right")
def model_comparison(spark: SparkSession, base: str) -> DataFrame:
    """In how many rows two results differ, either way."""
    rows = t(spark, base, "identity_suggestion_rankings")
    pick = lambda c: rows.filter(c).select("face_occurrence_id", "suggestion_id", "rank").distinct()
    return same_rows(pick("model_id like '%lumen%'"), pick("rank <= 2"))


_TILED = {"tx": "l_linenumber * 200", "ty": "l_linenumber * 150", "x": "l_suppkey * 1.0", "y": "l_partkey % 700 * 1.0", "w": "l_quantity * 4.0", "h": "l_quantity * 5.0"}


@query("WITH b AS (SELECT l_orderkey AS photo, l_linenumber AS id, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _TILED.items()) + """ FROM lineitem), m AS (SELECT photo, id, greatest(tx + x / 0.5, 0) AS l, greatest(ty + y / 0.5, 0) AS t, least(tx + (x + w) / 0.5, 1600) AS r, least(ty + (y + h) / 0.5, 1200) AS b FROM b)
SELECT photo, id, round(l / 1600, 6) AS x, round(t / 1200, 6) AS y, round((r - l) / 1600, 6) AS w, round((b - t) / 1200, 6) AS h FROM m WHERE r > l AND b > t""")
def tile_boxes_to_source(spark: SparkSession, base: str) -> DataFrame:
    """Boxes found in tiles, as parts of the picture that they lie in; those outside it are dropped."""
    rows = t(spark, base, "lineitem").select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("id"), *[F.expr(f"double({v})").alias(k) for k, v in _TILED.items()])
    c, size = F.col, (F.lit(1600), F.lit(1200))
    own = rows.withColumn("s", to_source(c("x"), c("y"), c("w"), c("h"), c("tx"), c("ty"), 0.5, *size)).filter("s is not null")
    unit = own.select("photo", "id", to_unit(c("s.x"), c("s.y"), c("s.w"), c("s.h"), *size).alias("u"))
    return unit.select("photo", "id", *[F.round(f"u.{k}", 6).alias(k) for k in ("x", "y", "w", "h")])


_CELL = {"photo": "l_orderkey", "stride": "CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END", "row": "l_partkey % 40", "col": "l_suppkey % 40", "cls": "l_discount * 12.0", "obj": "0.5 + l_tax * 5", "dx": "l_tax * 3", "dy": "l_discount * 2", "dw": "l_quantity / 40.0", "dh": "l_quantity / 30.0"}


@query("WITH c AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _CELL.items()) + """ FROM lineitem), s AS (SELECT *, sqrt(least(greatest(cls, 0), 1) * least(greatest(obj, 0), 1)) AS score FROM c)
SELECT photo, stride * 1099511627776::BIGINT + row * 1048576::BIGINT + col AS id, round(score, 6) AS score, round((col + dx) * stride - exp(dw) * stride / 2, 4) AS x, round((row + dy) * stride - exp(dh) * stride / 2, 4) AS y, round(exp(dw) * stride, 4) AS w, round(exp(dh) * stride, 4) AS h FROM s WHERE score >= 0.6""")
def decoded_boxes(spark: SparkSession, base: str) -> DataFrame:
    """Boxes of a detector's raw grid."""
    cells = t(spark, base, "lineitem").select(*[F.expr(v).alias(k) for k, v in _CELL.items()])
    out = decode_grid(cells, 0.6)
    return out.select("photo", "id", F.round("score", 6).alias("score"), *[F.round(k, 4).alias(k) for k in ("x", "y", "w", "h")])


@query()
def suppressed_boxes(spark: SparkSession, base: str) -> DataFrame:
    """Greedy suppression is sequential within a photo; SQL has no plain form of it."""
    rows = t(spark, base, "lineitem").select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("id"), F.col("l_extendedprice").alias("score"), *[F.expr(f"double({v})").alias(k) for k, v in _X.items()])
    return suppress(rows, "photo", 0.3)


@query("""WITH r AS (SELECT DISTINCT id, width, height FROM asset_revisions WHERE width > 0 AND height > 0 AND (width > 1024 OR height > 1024)),
xs AS (SELECT DISTINCT id, width, height, least(i * 896, greatest(width - 1024, 0)) AS x FROM r, range(0, 40) g(i) WHERE i <= ceil(greatest(width - 1024, 0) / 896.0)),
ys AS (SELECT DISTINCT id, least(i * 896, greatest(height - 1024, 0)) AS y FROM r, range(0, 40) g(i) WHERE i <= ceil(greatest(height - 1024, 0) / 896.0))
SELECT xs.id, x, y, least(1024, width) AS w, least(1024, height) AS h FROM xs JOIN ys ON ys.id = xs.id""")
def tile_plan(spark: SparkSession, base: str) -> DataFrame:
    images = t(spark, base, "asset_revisions").select("id", "width", "height").distinct()
    return tiles(images, "id", 1024, 128)


@query(f"""WITH {sql_vectors()}, norms AS (SELECT DISTINCT v.id, e.l2_norm, v.norm FROM vectors v JOIN face_embeddings e ON e.id = v.id) SELECT id, round(l2_norm, 3) AS stored, round(norm, 3) AS actual FROM norms WHERE abs(norm - l2_norm) > 1e-5 * greatest(1, norm)""")
def stale_norms(spark: SparkSession, base: str) -> DataFrame:
    """Vectors whose stored length isn't that of their numbers; blobs are decoded in Arrow batches."""
    rows = t(spark, base, "face_embeddings").filter(blob_fits(F.col("vector_blob"), F.col("dimensions"))).select("id", "l2_norm", blob_to_array("vector_blob").alias("v"))
    norm = rows.select("id", "l2_norm", l2_norm(F.col("v")).alias("norm")).filter(~F.isnan("norm") & (F.col("norm") > 0)).distinct()
    return norm.filter(F.abs(F.col("norm") - F.col("l2_norm")) > 1e-5 * F.greatest(F.lit(1.0), "norm")).select("id", F.round("l2_norm", 3).alias("stored"), F.round("norm", 3).alias("actual"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
