"""Exact matching of faces with people by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exemplars of a block and targets of a chunk that one task multiplies.
BLOCK, CHUNK = 16_384, 4_096


def best_people(targets: DataFrame, exemplars: DataFrame, rejected: DataFrame | None = None, keep: int = 2) -> DataFrame:
    """(face_id, person_id, score, rank, margin): the ``keep`` best people of each target face.

    ``targets`` has face_id and vector (array<float>), ``exemplars`` person_id
    and vector, ``rejected`` pairs (face_id, person_id) that never match. A
    person's score is the highest cosine of its exemplars; ties go to the smaller
    person_id. margin is the difference of the two best scores, the same on both
    ranks and null where there is one person only. Null vectors and vectors of
    length 0 match nothing; vectors must have one dimension.

    Exemplars are hashed into blocks row by row, so a person with very many
    exemplars is spread over all of them, and targets into chunks; a task
    multiplies one block with one chunk (float32 numbers, summed as float64) and
    sends on the best people of each face only. A person among the best of all
    is among the best of the block that holds its best exemplar. A face with r
    rejected people sends r more, so that enough are left.
    """
    given = exemplars.select(F.col("person_id").cast("string").alias("person_id"), "vector").filter("person_id is not null and vector is not null and size(vector) > 0")
    faces = targets.select("face_id", "vector").filter("face_id is not null and vector is not null and size(vector) > 0")
    shape = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"), F.min(F.size("vector")).alias("least")).first()
    if shape["n"] and shape["d"] != shape["least"]:
        raise ValueError("exemplars differ in their dimensions")
    blocks, chunks = max(1, -(-shape["n"] // BLOCK)), max(1, -(-faces.count() // CHUNK))
    pairs = None
    faces = faces.withColumn("more", F.lit(0).cast("long"))
    if rejected is not None:
        pairs = rejected.select("face_id", F.col("person_id").cast("string").alias("person_id")).distinct()
        faces = faces.drop("more").join(pairs.groupBy("face_id").agg(F.count(F.lit(1)).alias("more")), "face_id", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = given.select(F.col("person_id").alias("e_person"), F.col("vector").alias("e_vector"), F.pmod(F.xxhash64("person_id", "vector"), F.lit(blocks)).cast("int").alias("e_block"), every(chunks).alias("e_chunk"))
    asks = faces.select("face_id", "vector", "more", F.pmod(F.xxhash64("face_id"), F.lit(chunks)).cast("int").alias("chunk"), every(blocks).alias("block"))
    kind = dict(faces.dtypes)["face_id"]

    def score(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(known):
            m = np.stack(known["e_vector"].to_numpy()).astype(np.float64)
            people, code = np.unique(known["e_person"].to_numpy(dtype=str), return_inverse=True)
            length = np.sqrt((m * m).sum(axis=1))
            order = np.argsort(code, kind="stable")
            order = order[length[order] > 0]
            if len(order):
                m, length, code = m[order], length[order], code[order]
                starts = np.nonzero(np.diff(code, prepend=-1))[0]
                names, ids, more = people[code[starts]].astype(object), own["face_id"].to_numpy(), own["more"].to_numpy()
                for b in range(0, len(own), 512):
                    t = np.stack(own["vector"].iloc[b : b + 512].to_numpy()).astype(np.float64)
                    with np.errstate(all="ignore"):
                        cos = (t @ m.T) / np.sqrt((t * t).sum(axis=1))[:, None] / length
                    best = np.maximum.reduceat(cos, starts, axis=1)
                    ok = np.isfinite(best)
                    # Ties keep the smaller name: the columns are in the order of names.
                    ranked = np.argsort(-np.where(ok, best, -np.inf), axis=1, kind="stable")
                    wanted = np.arange(ranked.shape[1])[None, :] < keep + more[b : b + 512, None]
                    row, place = np.nonzero(wanted)
                    col = ranked[row, place]
                    good = ok[row, col]
                    row, col = row[good], col[good]
                    out.append(pd.DataFrame({"face_id": ids[b + row], "person_id": names[col], "score": best[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"face_id": pd.Series(dtype=object), "person_id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})

    scored = asks.groupBy("block", "chunk").cogroup(rows.groupBy("e_block", "e_chunk")).applyInPandas(score, f"face_id {kind}, person_id string, score double")
    scored = scored.groupBy("face_id", "person_id").agg(F.max("score").alias("score"))
    if pairs is not None:
        scored = scored.join(pairs, ["face_id", "person_id"], "left_anti")
    w = Window.partitionBy("face_id").orderBy(F.desc("score"), "person_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    both = Window.partitionBy("face_id")
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(both)
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(both)
    return ranked.withColumn("margin", first - second)


def confidence(score: Column, margin: Column, high: float = 0.7, high_margin: float = 0.1, medium: float = 0.5) -> Column:
    """high needs a score and a margin that is there; medium a score; else low. Null without a score."""
    return F.when(score.isNull(), None).when((score >= high) & F.coalesce(margin >= high_margin, F.lit(False)), "high").when(score >= medium, "medium").otherwise("low")
