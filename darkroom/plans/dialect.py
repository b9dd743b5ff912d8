"""SQL fragments that the queries' SQL shares."""

from __future__ import annotations


def sql_guid(column: str) -> str:
    """The canonical form of a GUID column in SQL."""
    h = f"lower(regexp_replace({column}, '[{{}}\\s-]', '', 'g'))"
    return f"CASE WHEN length({h}) = 32 THEN substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12) END"


def sql_vectors() -> str:
    """``vectors``: the valid vectors of face_embeddings as doubles (x), each id once, with their norm.

    The blob's float32 values are read from their bytes: sign, exponent and fraction.
    """
    return """blobs AS (SELECT DISTINCT id, face_crop_id, model_id, model_hash, dimensions, hex(vector_blob) AS h FROM face_embeddings WHERE octet_length(vector_blob) = dimensions * 4),
            words AS (SELECT *, list_transform(range(0, dimensions), lambda i: CAST('0x' || substr(h, 8*i + 7, 2) || substr(h, 8*i + 5, 2) || substr(h, 8*i + 3, 2) || substr(h, 8*i + 1, 2) AS BIGINT)) AS w FROM blobs),
            floats AS (SELECT id, face_crop_id, model_id, model_hash, list_transform(w, lambda u: CASE WHEN (u >> 23) & 255 = 255 THEN 'nan'::DOUBLE ELSE (CASE WHEN u >= 2147483648 THEN -1 ELSE 1 END) * (CASE WHEN (u >> 23) & 255 = 0 THEN (u & 8388607) * pow(2, -149) ELSE (8388608 + (u & 8388607)) * pow(2, ((u >> 23) & 255) - 150) END) END) AS x FROM words),
            vectors AS MATERIALIZED (SELECT *, sqrt(list_inner_product(x, x)) AS norm FROM floats WHERE NOT isnan(list_sum(x)) AND list_inner_product(x, x) > 0)"""
