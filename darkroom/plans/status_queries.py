"""Queries over snapshots of jobs, scans, evaluations and suggestions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators import status as s
from darkroom.operators.latest import active_reviews
from darkroom.plans import match_queries, review_queries
from darkroom.plans.review_queries import _CTE
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


@query("SELECT l_orderkey AS job, max(l_linenumber)::BIGINT AS attempts, CASE WHEN max(l_linenumber) >= 1 THEN least(5.0 * pow(2, max(l_linenumber) - 1), 300.0)::DOUBLE END AS wait FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def retry_backoff(spark: SparkSession, base: str) -> DataFrame:
    """How long each failed job waits for its next attempt."""
    rows = t(spark, base, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("job")).agg(F.max("l_linenumber").cast("long").alias("attempts"))
    return rows.withColumn("wait", s.backoff_seconds(F.col("attempts")))


@query(match_queries._GROUPED + """, rated AS (SELECT *, CASE WHEN faces = 0 THEN 1 ELSE matched / faces::DOUBLE END AS recall FROM sums)
SELECT grp, photos, CASE WHEN recall + 1e-12 >= CASE grp WHEN '<overall>' THEN 0.4 ELSE 0.9 END AND (false_found + duplicates <= 100000 OR grp <> '<overall>') THEN 'pass' ELSE 'fail' END AS gate FROM rated WHERE starts_with(grp, '<')""")
def detector_gate(spark: SparkSession, base: str) -> DataFrame:
    """Whether the detector's metrics reach what is asked."""
    out = s.gate(match_queries.detector_metrics_by_group(spark, base), F.lit(True), 0.4, 0.9, 100_000)
    return out.select("grp", "photos", "gate")


@query("""SELECT o_orderkey AS revision, CASE WHEN o_custkey % 5 = 0 THEN 'verified' WHEN o_orderpriority = '1-URGENT' THEN 'needs-source-verification' WHEN o_orderstatus <> 'P' THEN CASE WHEN (o_orderstatus = 'F') = (o_totalprice > 200000) THEN 'verified' ELSE 'needs-source-verification' END
WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'needs-source-verification' ELSE 'unverified' END AS state FROM orders""")
def verification_state(spark: SparkSession, base: str) -> DataFrame:
    baseline = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    state = s.verification(F.col("o_custkey") % 5 == 0, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 200000, baseline, F.col("o_orderdate") < F.to_timestamp(F.lit("1996-01-01")))
    return t(spark, base, "orders").select(F.col("o_orderkey").alias("revision"), state.alias("state"))


@query(f"WITH {_CTE} SELECT face_id, suggestion_id, person_id FROM suggestions g WHERE rank = 1 AND status = 'pending' AND score >= 0.7 AND margin >= 0.1 AND NOT EXISTS (SELECT 1 FROM active a WHERE a.face_id = g.face_id)")
def auto_assign_candidates(spark: SparkSession, base: str) -> DataFrame:
    """First suggestions sure enough to be taken, of faces that nobody has decided on."""
    rows = review_queries.suggestions(spark, base).filter("rank = 1 and status = 'pending' and score >= 0.7 and margin >= 0.1")
    decided = active_reviews(review_queries.log(spark, base), "face_id", "id", "kind", "reverses").select("face_id")
    return rows.join(decided, "face_id", "left_anti").select("face_id", "suggestion_id", "person_id")


@query(f"""WITH {_CTE}, moved AS (SELECT face_id, model, suggestion_id, status, score, person_id AS was, CASE WHEN person_id >= 10 THEN person_id - 10 ELSE person_id END AS person_id FROM suggestions)
SELECT face_id, person_id, model, arg_max(suggestion_id, (was = person_id, -suggestion_id)) AS suggestion_id, CASE WHEN bool_or(status = 'accepted') THEN 'accepted' WHEN bool_or(status = 'rejected') THEN 'rejected' ELSE 'pending' END AS status, arg_max(score, (was = person_id, -suggestion_id)) AS score FROM moved GROUP BY ALL""")
def merged_suggestions(spark: SparkSession, base: str) -> DataFrame:
    """Suggestions after half of the people were merged into the other half."""
    mapping = spark.range(10, 20).select(F.col("id").alias("old"), (F.col("id") - 10).alias("new"))
    return s.surviving_suggestions(review_queries.suggestions(spark, base), mapping, ["face_id", "person_id", "model"])


_OUTCOMES = ["success", "no-result", "deferred", "failed", "manual"]
_OUTCOME = "CASE l_linenumber WHEN 1 THEN 'manual' WHEN 2 THEN 'no-result' WHEN 3 THEN 'deferred' WHEN 4 THEN 'failed' ELSE 'success' END"


@query("SELECT l_shipdate AS batch, count(*) AS asked, " + ", ".join(f"count(*) FILTER (WHERE {_OUTCOME} = '{o}') AS {o.replace('-', '_')}" for o in _OUTCOMES) + " FROM lineitem GROUP BY 1")
def enrichment_report(spark: SparkSession, base: str) -> DataFrame:
    """What became of each batch of positions."""
    rows = t(spark, base, "lineitem").select(F.col("l_shipdate").alias("batch"), F.expr(_OUTCOME).alias("outcome"))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("asked"), *[F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in _OUTCOMES])


@query("SELECT CASE WHEN l_linestatus = 'F' THEN 'released' WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'leased' END AS lease, count(*) AS files, coalesce(sum(l_partkey * 1000), 0)::BIGINT AS bytes, min(l_shipdate) AS oldest FROM lineitem GROUP BY 1")
def storage_by_lease(spark: SparkSession, base: str) -> DataFrame:
    """What hydrated files hold, by the state of their lease."""
    lease = F.when(F.col("l_linestatus") == "F", "released").when(F.col("l_shipdate") < F.to_timestamp(F.lit("1996-01-01")), "expired").otherwise("leased")
    return t(spark, base, "lineitem").groupBy(lease.alias("lease")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.col("l_partkey").cast("long") * 1000), F.lit(0)).alias("bytes"), F.min("l_shipdate").alias("oldest"))


@query("SELECT count(*) AS folders, sum(files)::BIGINT AS files, sum(fresh)::BIGINT AS fresh, sum(gone)::BIGINT AS gone, count(*) FILTER (WHERE fresh = 0 AND gone = 0) AS unchanged FROM (SELECT l_suppkey, count(*) AS files, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 45) AS fresh, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 45) AS gone FROM lineitem GROUP BY 1)")
def sync_summary(spark: SparkSession, base: str) -> DataFrame:
    """The scans of all folders in one row."""
    many = F.col("l_quantity") > 45
    each = t(spark, base, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("files"), F.count_if((F.col("l_returnflag") == "A") & many).alias("fresh"), F.count_if((F.col("l_returnflag") == "R") & many).alias("gone"))
    return each.agg(F.count(F.lit(1)).alias("folders"), F.sum("files").alias("files"), F.sum("fresh").alias("fresh"), F.sum("gone").alias("gone"), F.count_if((F.col("fresh") == 0) & (F.col("gone") == 0)).alias("unchanged"))


@query("""WITH g AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0), t AS (SELECT * FROM embeddings WHERE vec_id % 5 = 0)
SELECT 'gallery id repeated' AS rule, count(*) AS violations FROM (SELECT vec_id FROM g GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'vector of another length', count(*) FROM embeddings WHERE len(embedding) <> 64
UNION ALL SELECT 'vector missing', count(*) FROM embeddings WHERE embedding IS NULL
UNION ALL SELECT 'sample in gallery', count(*) FROM t WHERE vec_id IN (SELECT vec_id FROM g)
UNION ALL SELECT 'person without exemplar', count(*) FROM (SELECT DISTINCT label FROM t WHERE label NOT IN (SELECT label FROM g))
UNION ALL SELECT 'person with one exemplar', count(*) FROM (SELECT label FROM g GROUP BY 1 HAVING count(*) = 1)
UNION ALL SELECT 'length not near 1', count(*) FROM embeddings WHERE abs(list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE)) - 1) > 1e-3""")
def dataset_validation(spark: SparkSession, base: str) -> DataFrame:
    """The rules that an evaluation's samples must keep, with the rows that break each."""
    rows = t(spark, base, "embeddings")
    gallery, samples = rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x * x).cast("double"))
    repeated = lambda df, key, c: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(c)
    return s.violations({
        "gallery id repeated": repeated(gallery, "vec_id", "n > 1"), "vector of another length": rows.filter(F.size("embedding") != 64), "vector missing": rows.filter("embedding is null"),
        "sample in gallery": samples.join(gallery.select("vec_id"), "vec_id", "left_semi"), "person without exemplar": samples.select("label").distinct().join(gallery.select("label"), "label", "left_anti"),
        "person with one exemplar": repeated(gallery, "label", "n = 1"), "length not near 1": rows.filter(F.abs(square - 1) > 1e-3),
    })


@query("SELECT count(*) AS images, round(count(*) / 100.0, 4)::DOUBLE AS hours, round(CAST(count(*) AS DECIMAL(18, 6)) / 100 * 0.25, 4)::DOUBLE AS cost FROM (SELECT DISTINCT id FROM asset_revisions)")
def archive_projection(spark: SparkSession, base: str) -> DataFrame:
    """Hours and cost of reading the whole archive at 100 images an hour and 0.25 an hour."""
    n = t(spark, base, "asset_revisions").select("id").distinct().agg(F.count(F.lit(1)).alias("images"))
    hours = F.col("images").cast("decimal(18,6)") / 100
    return n.select("images", F.round(hours, 4).cast("double").alias("hours"), F.round(hours * F.lit("0.25").cast("decimal(18,6)"), 4).cast("double").alias("cost"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
