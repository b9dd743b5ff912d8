"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.guid import guid
from darkroom.llm.bpe import count_tokens, encode_documents, tokenizer_path
from darkroom.llm.clusters import similarity_clusters, typical_faces
from darkroom.llm.neighbours import most_similar, search
from darkroom.llm.packing import pack_documents, packing_summary
from darkroom.llm.residue import residue_documents
from darkroom.llm.splits import assign_splits, photo_groups, reached_shares
from darkroom.llm.topn import top_n_per_group
from darkroom.plans.dialect import sql_guid, sql_vectors
from darkroom.plans.staging import Staging
from darkroom.sources.tables import read_table


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The first three suggestions of every face."""
    rows = read_table(spark, base, "identity_suggestion_rankings").select(guid("face_occurrence_id").alias("face_occurrence_id"), "suggestion_id", "score_margin", "rank")
    return top_n_per_group(rows, "face_occurrence_id", "suggestion_id", "score_margin", ["rank"], 3, Staging(spark, "p4"))


def p2_similar(spark: SparkSession, base: str) -> DataFrame:
    """The five most similar vectors, of all, of every vector whose id is divisible by 100: a search."""
    return search(read_table(spark, base, "face_embeddings"), F.col("id") % 100 == 0, 5)


def p2_every(spark: SparkSession, base: str) -> DataFrame:
    """The five most similar other vectors of every valid vector, with their cosine."""
    return most_similar(read_table(spark, base, "face_embeddings"), 5)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs with a cosine of at least 0.95 of which one is among the five most similar of the other.

    Whether a vector this near is among the five depends only on others as near.
    """
    near = most_similar(read_table(spark, base, "face_embeddings"), 5, 0.95)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The photos of every group of at least two photos that persons link."""
    groups = photo_groups(read_table(spark, base, "photo_person_actions"), "person_id", "asset_revision_id", 2, Staging(spark, "p5"))
    return groups.select(F.col("label").alias("group_person_id"), F.col("photo").alias("asset_revision_id"))


def p5_splits(spark: SparkSession, base: str) -> DataFrame:
    """The split of every record."""
    return assign_splits(read_table(spark, base, "photo_person_actions"), read_table(spark, base, "split_shares"), "id", "person_id", "asset_revision_id", Staging(spark, "p5s"))


def p5_shares(spark: SparkSession, base: str) -> DataFrame:
    """The share of the records that each split of p5_splits reaches, beside the share that was asked."""
    return reached_shares(p5_splits(spark, base), read_table(spark, base, "split_shares"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """The members of every cluster of at least three faces that cosines of 0.65 link."""
    members = similarity_clusters(read_table(spark, base, "face_embeddings"), read_table(spark, base, "face_crops"), 0.65, 3, Staging(spark, "p7"))
    return members.select("model_hash", "cluster_face_id", "face_occurrence_id").distinct()


def p7_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Every cluster of p7_found with its size and the five faces nearest to its centroid, or all if it has fewer."""
    return typical_faces(read_table(spark, base, "face_embeddings"), read_table(spark, base, "face_crops"), 0.65, 3, 5, Staging(spark, "p7c"))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return encode_documents(read_table(spark, base, "documents"), tokenizer_path("byte_bpe_50k"))


def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    """The container of 2,048 tokens of every document, or of every part of one that is longer."""
    sizes = count_tokens(read_table(spark, base, "documents"), tokenizer_path("byte_bpe_50k"))
    return pack_documents(sizes, "doc_id", "tokens", 2048, Staging(spark, "p9"))


def p9_summary(spark: SparkSession, base: str) -> DataFrame:
    """The containers of p9_containers, what best-fit decreasing of whole blocks takes, the fewest there can be, and the part that stays empty."""
    sizes = count_tokens(read_table(spark, base, "documents"), tokenizer_path("byte_bpe_50k"))
    return packing_summary(sizes, "doc_id", "tokens", 2048, Staging(spark, "p9s"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """The documents with residue in place of real content."""
    return residue_documents(read_table(spark, base, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_similar": p2_similar, "p2_every": p2_every, "p4_found": p4_found, "p5_found": p5_found, "p5_splits": p5_splits, "p5_shares": p5_shares, "p7_found": p7_found, "p7_clusters": p7_clusters, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_summary": p9_summary, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    near = "list_inner_product(a.x, b.x) / a.norm / b.norm"
    return {
        "p2_found": f"""
            WITH {sql_vectors()},
            pairs AS (SELECT a.id AS a, b.id AS b, {near} AS c FROM vectors a JOIN vectors b ON a.model_id = b.model_id AND a.model_hash = b.model_hash AND len(a.x) = len(b.x) AND a.id <> b.id WHERE {near} >= 0.95),
            best AS (SELECT a, b FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
            SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM best""",
        "p7_found": f"""
            WITH RECURSIVE {sql_vectors()},
            crops AS (SELECT DISTINCT lower(crop_id) AS crop, lower(face_occurrence_id) AS face FROM face_crops WHERE crop_id IS NOT NULL AND face_occurrence_id IS NOT NULL),
            own AS (SELECT v.*, c.face FROM vectors v JOIN crops c ON c.crop = lower(v.face_crop_id)),
            links AS MATERIALIZED (SELECT DISTINCT a.model_id, a.model_hash, a.face AS f, b.face AS g FROM own a JOIN own b ON a.model_id = b.model_id AND a.model_hash = b.model_hash AND len(a.x) = len(b.x) WHERE {near} >= 0.65),
            reach AS (SELECT model_id, model_hash, f, g FROM links UNION SELECT r.model_id, r.model_hash, r.f, l.g FROM reach r JOIN links l ON l.model_id = r.model_id AND l.model_hash = r.model_hash AND l.f = r.g),
            named AS (SELECT model_id, model_hash, f AS face, min(g) AS label FROM reach GROUP BY ALL)
            SELECT DISTINCT model_hash, label AS cluster_face_id, face AS face_occurrence_id FROM named QUALIFY count(*) OVER (PARTITION BY model_id, model_hash, label) >= 3""",
        "p5_found": f"""
            WITH RECURSIVE pairs AS (SELECT DISTINCT {sql_guid("person_id")} AS p, {sql_guid("asset_revision_id")} AS r FROM photo_person_actions WHERE person_id IS NOT NULL),
            links AS (SELECT DISTINCT a.p AS a, b.p AS b FROM pairs a JOIN pairs b ON a.r = b.r),
            reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
            named AS (SELECT a AS p, min(b) AS label FROM reach GROUP BY a),
            photos AS (SELECT DISTINCT label AS group_person_id, r AS asset_revision_id FROM pairs JOIN named USING (p))
            SELECT group_person_id, asset_revision_id FROM photos QUALIFY count(*) OVER (PARTITION BY group_person_id) >= 2""",
        "p4_found": """
            WITH best AS (
              SELECT lower(face_occurrence_id) AS face_occurrence_id, suggestion_id, score_margin, rank,
                     row_number() OVER (PARTITION BY lower(face_occurrence_id), suggestion_id
                       ORDER BY CASE WHEN score_margin IS NULL OR isnan(score_margin) THEN 1 ELSE 0 END, score_margin DESC, rank NULLS LAST) AS n
              FROM identity_suggestion_rankings),
            ranked AS (
              SELECT face_occurrence_id, suggestion_id, row_number() OVER (PARTITION BY face_occurrence_id
                       ORDER BY CASE WHEN score_margin IS NULL OR isnan(score_margin) THEN 1 ELSE 0 END,
                                CASE WHEN isnan(score_margin) THEN NULL ELSE score_margin END DESC NULLS LAST, rank NULLS LAST, suggestion_id) AS n
              FROM best WHERE n = 1)
            SELECT face_occurrence_id, suggestion_id FROM ranked WHERE n <= 3""",
    }
