"""The k most similar vectors of every vector, by collision-counting hashing.

Unit rows are projected onto PROJECTIONS random directions, each of which gives
a sorted array. A query opens a window around its own projection in every array,
and a row collides once for each window that it lies in. Only rows that collide
often enough are verified by their cosine; for a radius the number that is
enough follows from the chance with which a row at that distance lies in a
window, so that MISS of such rows at most are left out. Queries without k
verified rows within the radius widen their windows (virtual rehashing).

``most_similar`` answers every vector. Counting collisions of all with all rows
would grow as the square of the rows, as a single projection separates near from
far by no more than the ratio of their distances; so vectors are first routed to
the cells of their nearest pivots, and collisions are counted within cells. Rows
outside a query's cells are the loss. ``search`` answers a stated set of queries
against the sorted arrays of all rows, in blocks, and loses none to cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.vectors import decode, unit_rows
from darkroom.llm.routing import MOST_PIVOTS, Pivots, by_revision, fine, split_cells, unfine, valid_vectors
from darkroom.operators.skew import lookup

#: Vectors to a pivot, and the cells that a vector enters if only near rows are asked for, or all.
PER_CELL, NEAR_CELLS, CELLS = 200, 4, 5
#: Sorted arrays of a cell, and of a block that is searched.
PROJECTIONS, SEARCH_PROJECTIONS = 16, 32
#: Half width of a window in radii, and the part of the rows at the radius that may collide too seldom.
SPREAD, MISS = 1.4, 0.005
#: Radii of the rounds where no least cosine is given; at 2 every row is within the radius. A search takes finer steps, as its windows hold more rows.
RADII = (0.32, 0.84, 1.17, 2.0)
SEARCH_RADII = (0.32, 0.84, 1.0, 1.1, 1.17, 1.22, 1.28, 2.0)
#: Part of a batch's pairs that collide from which they are verified together.
DENSE = 0.15
#: Queries that are counted at a time; memory is bounded by QUERIES x rows of the cell.
QUERIES = 96
#: Blobs with more than k + 1 copies that are broadcast; if there are more, they are joined by a shuffle.
MOST_COPIED = 50_000
#: Rows of a block and queries of a chunk that a search brings together.
BLOCK, CHUNK = 16_384, 16_384

_REVISION = ["model_id", "model_hash", "dimensions"]
_KEYS = "model_id string, model_hash string, dimensions int"


@lru_cache(maxsize=256)
def enough(arrays: int, miss: float = MISS) -> int:
    """The most collisions that a row at the radius reaches with a chance of 1 - ``miss``."""
    p = math.erf(SPREAD / math.sqrt(2))
    below = 0.0
    for n in range(arrays + 1):
        below += math.comb(arrays, n) * p**n * (1 - p) ** (arrays - n)
        if below > miss:
            return max(n, 1)
    return arrays


class SortedArrays:
    """Unit rows in the order of each of several projections."""

    def __init__(self, x: np.ndarray, directions: np.ndarray):
        self.rows, self.directions = len(x), directions
        projected = x @ directions
        order = np.argsort(projected, axis=0)
        self.values = np.take_along_axis(projected, order, axis=0).T.copy()
        self.kind = np.uint16 if len(x) < 65_000 else np.uint32
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(x))[:, None], axis=0)
        self.place = np.ascontiguousarray(place.T.astype(self.kind))

    def collisions(self, q: np.ndarray, half: float) -> np.ndarray:
        """How many windows of each query hold each row (queries x rows)."""
        p = q @ self.directions
        count = np.zeros((len(q), self.rows), dtype=np.uint8)
        offset, inside = np.empty(count.shape, dtype=self.kind), np.empty(count.shape, dtype=bool)
        for m, values in enumerate(self.values):
            start = np.searchsorted(values, p[:, m] - half, "left").astype(self.kind)
            width = np.searchsorted(values, p[:, m] + half, "right").astype(self.kind) - start
            # A row's place minus the window's start, unsigned: one comparison tests both ends.
            np.subtract(self.place[m], start[:, None], out=offset)
            np.less(offset, width[:, None], out=inside)
            np.add(count, inside.view(np.uint8), out=count)
        return count


def search_rows(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, directions: np.ndarray, radii: tuple[float, ...], least: float = -2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, cosine) of up to ``k`` most similar rows of ``x`` for each query, and the number of rows verified.

    ``x`` and ``q`` are unit rows (float64); ``own`` is the row that a query
    itself is, or -1. Ties go to the smaller row.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(q) or len(x) - (own >= 0).max(initial=0) < 1:
        return none, none, np.zeros(0), 0
    small, qs = x.astype(np.float32), q.astype(np.float32)
    arrays = SortedArrays(small, directions)
    need = enough(directions.shape[1])
    found, verified, waiting = [], 0, np.arange(len(q))
    for radius in radii:
        last, still = radius == radii[-1], []
        for b in range(0, len(waiting), QUERIES):
            part = waiting[b : b + QUERIES]
            count = arrays.collisions(qs[part], SPREAD * radius)
            mine = np.nonzero(own[part] >= 0)[0]
            count[mine, own[part][mine]] = 0
            i, j = np.nonzero(count >= need)
            verified += len(i)
            if len(i) > DENSE * count.size:
                # Where a large part collides, one matrix product costs less than its cosines one by one.
                cos = (qs[part] @ small.T)[i, j]
            else:
                cos = np.empty(len(i), dtype=np.float32)
                for c in range(0, len(i), 1 << 16):
                    s = slice(c, c + (1 << 16))
                    cos[s] = np.einsum("ij,ij->i", qs[part[i[s]]], small[j[s]])
            if not last:
                # A query is done if k rows lie within the radius: those are verified but for a part of MISS.
                done = np.bincount(i[cos >= 1 - radius * radius / 2], minlength=len(part)) >= k
                still.append(part[~done])
                ok = done[i]
                i, j, cos = i[ok], j[ok], cos[ok]
            ok = cos >= least - 1e-5
            i, j, cos = i[ok], j[ok], cos[ok]
            order = np.lexsort((j, -cos, i))
            i, j = i[order], j[order]
            # float32 orders the rows; what is near the k-th is ordered again by float64.
            first = np.searchsorted(i, i, "left")
            near = np.arange(len(i)) - first < k + 3
            i, j = i[near], j[near]
            exact = np.einsum("ij,ij->i", q[part[i]], x[j])
            order = np.lexsort((j, -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            keep = (np.arange(len(i)) - np.searchsorted(i, i, "left") < k) & (exact >= least)
            found.append((part[i[keep]], j[keep], exact[keep]))
        if last:
            break
        waiting = np.concatenate(still) if still else none
    return (*(np.concatenate([f[n] for f in found]) for n in range(3)), verified)  # type: ignore[return-value]


def _directions(dimensions: int, arrays: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, arrays)).astype(np.float32)


def _copies(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Vectors without the copies of a blob beyond its k + 1 smallest ids, and (id, other) of the copies left out.

    A copy that is left out has the smallest of the others as its neighbours,
    with cosine 1. Blobs compare by 128 bits of hash; no group of copies is
    collected, and a blob of very many rows meets its ids in a broadcast row.
    """
    h = F.concat_ws("-", F.xxhash64(*_REVISION, "vector_blob"), F.xxhash64(F.lit(1), "vector_blob"))
    stamped = vectors.withColumn("h", h)
    # Only hashes and ids are shuffled, and of each hash no more than k + 2 ids.
    ranked = stamped.select("h", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).filter(F.col("r") <= k + 2)
    firsts = ranked.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("firsts")).filter(F.size("firsts") > k + 1).select("h", F.slice("firsts", 1, k + 1).alias("firsts"))
    known = firsts.limit(MOST_COPIED + 1).collect()
    if not known:
        return vectors, None
    if len(known) <= MOST_COPIED:
        marked = stamped.join(F.broadcast(vectors.sparkSession.createDataFrame(known, firsts.schema)), "h", "left")
    else:
        marked = lookup(stamped, firsts, "h", "left")
    kept = marked.filter(F.col("firsts").isNull() | F.array_contains("firsts", F.col("id"))).select(vectors.columns)
    left = marked.filter(F.col("firsts").isNotNull() & ~F.array_contains("firsts", F.col("id"))).select("id", F.slice("firsts", 1, k).alias("firsts")).distinct()
    return kept, left.select("id", F.explode("firsts").alias("other"))


def most_similar(df: DataFrame, k: int, least: float | None = None, seed: int = 7, most: int = MOST_PIVOTS) -> DataFrame:
    """(id, other, cosine) of the ``k`` most similar other vectors of every valid vector, within model_id and model_hash.

    With ``least`` only those with a cosine of ``least`` or more are sought:
    windows then open once, at the radius of that cosine.

    ``df`` has id (long), model_id, model_hash, dimensions and vector_blob; a
    vector is valid if its blob holds exactly ``dimensions`` finite float32
    numbers that are not all zero. Other rows are left out, as are rows without
    an id or a revision. A row delivered twice is one vector. Vectors of
    different dimensions are never compared. Ties of the cosine go to the
    smaller id. A revision with one vector gives no row, an empty table an empty
    result. Columns beyond those named aren't read.

    Of exact copies of a blob the k + 1 smallest ids enter the index; the others
    get the k smallest as their neighbours, with cosine 1.
    """
    spark = df.sparkSession
    vectors, copies = _copies(valid_vectors(df), k)
    pivots = Pivots.sample(vectors, PER_CELL, seed, most)
    shared = spark.sparkContext.broadcast(pivots)
    cells, radii = (CELLS, RADII) if least is None else (NEAR_CELLS, (math.sqrt(max(2 - 2 * least, 1e-6)),))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for key, rows in by_revision(frame):
                x, ok = unit_rows(decode(list(rows["vector_blob"]), key[2]))
                x, ids = x[ok], rows["id"].to_numpy()[ok]
                if len(x):
                    yield pd.DataFrame({"model_id": key[0], "model_hash": key[1], "dimensions": key[2], "id": ids, "cells": list(own.nearest(key, x, cells)), "v": fine(x)})

    routed = vectors.mapInPandas(route, f"{_KEYS}, id long, cells array<long>, v binary")
    entered = routed.select(*_REVISION, "id", "v", F.explode("cells").alias("cell"))
    if pivots.rows > 2 * most * PER_CELL:
        entered = split_cells(entered, PER_CELL, pivots.rows * cells // most, seed)

    def meet(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").sort_values("id")
        x, ids = unfine(list(rows["v"])), rows["id"].to_numpy()
        q, r, cos, _n = search_rows(x, x, np.arange(len(x)), k, _directions(x.shape[1], PROJECTIONS, seed), radii, -2.0 if least is None else least)
        return pd.DataFrame({"id": ids[q], "other": ids[r], "cosine": cos})

    found = entered.groupBy(*_REVISION, "cell").applyInPandas(meet, "id long, other long, cosine double")
    # A vector has at most cells x k rows here; one pair may come from several cells, with the same cosine but for its last bits.
    near = F.sort_array(F.collect_list(F.struct((-F.round("cosine", 12)).alias("d"), "other")))
    ranked = found.groupBy("id").agg(F.array_distinct(near).alias("near")).select("id", F.explode(F.slice("near", 1, k)).alias("b"))
    best = ranked.select("id", F.col("b.other").alias("other"), (-F.col("b.d")).alias("cosine"))
    return best if copies is None else best.unionByName(copies.withColumn("cosine", F.lit(1.0)))


def search(df: DataFrame, queries: Column, k: int, seed: int = 7) -> DataFrame:
    """(id, other, cosine) of the ``k`` most similar other vectors of each vector for which ``queries`` (a condition on id) holds.

    Rows and values as for ``most_similar``, but every query meets the sorted
    arrays of all rows of its revision: rows are cut into blocks, queries into
    chunks, and the best of each block are merged. Only collisions that are too
    few lose a neighbour. Work is the product of queries and rows.
    """
    spark = df.sparkSession
    vectors = valid_vectors(df)
    sizes = vectors.groupBy(*_REVISION).agg(F.count(F.lit(1)).alias("n"), F.count_if(queries).alias("q")).collect()
    # One row for each revision of a model.
    cuts = spark.createDataFrame([(r["model_id"], r["model_hash"], r["dimensions"], -(-r["n"] // BLOCK), max(1, -(-r["q"] // CHUNK))) for r in sizes], f"{_KEYS}, blocks long, chunks long")

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, rows in by_revision(frame):
                x, ok = unit_rows(decode(list(rows["vector_blob"]), key[2]))
                yield rows.loc[ok, [*_REVISION, "id", "blocks", "chunks", "asks"]].assign(v=fine(x[ok]))

    placed = vectors.join(F.broadcast(cuts), _REVISION).withColumn("asks", queries)
    units = placed.mapInPandas(unit, f"{_KEYS}, id long, blocks long, chunks long, asks boolean, v binary")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    rows = units.select(*_REVISION, "id", "v", own("blocks").alias("block"), every("chunks").alias("chunk"))
    asks = units.filter("asks").select(*_REVISION, "id", "v", own("chunks").alias("chunk"), every("blocks").alias("block"))
    asks = asks.select(*[F.col(c).alias(f"q_{c}") for c in asks.columns])

    def meet(_: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        rows, asks = rows.drop_duplicates("id").sort_values("id"), asks.drop_duplicates("q_id").sort_values("q_id")
        ids, qids = rows["id"].to_numpy(), asks["q_id"].to_numpy()
        at = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
        q, r, cos, _n = search_rows(unfine(list(rows["v"])), unfine(list(asks["q_v"])), np.where(ids[at] == qids, at, -1), k, _directions(int(rows["dimensions"].iloc[0]), SEARCH_PROJECTIONS, seed), SEARCH_RADII)
        return pd.DataFrame({"id": qids[q], "other": ids[r], "cosine": cos})

    key = [*_REVISION, "block", "chunk"]
    found = rows.groupBy(*key).cogroup(asks.groupBy(*[f"q_{c}" for c in key])).applyInPandas(meet, "id long, other long, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
