"""Routing of unit vectors to cells around sampled pivots, shared by the vector operators.

Pivots are a sample of the vectors of each revision, about one to ``per_cell``
vectors and ``most`` at most in all; the vectors themselves are all routed. The
pivots are the only thing that is broadcast: ``most`` x dimensions float32
values, 16 MB at 128 dimensions for the default of 32,768.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.functions.vectors import blob_fits, decode, unit_rows

#: Bound of the pivots of all revisions together.
MOST_PIVOTS = 32_768
#: Each number of a vector travels as a 16-bit part of the vector's largest number: an error of about 1e-6 in a cosine.
SCALE = 32_767
#: The same in 24 bits.
FINE_SCALE = 8_388_607


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as 16-bit integers relative to the row's largest number; for directions only."""
    peak = np.abs(x).max(axis=1, keepdims=True)
    q = np.rint(x / np.where(peak > 0, peak, 1) * SCALE).astype("<i2")
    return [r.tobytes() for r in q]


def unpack(blobs: list[bytes]) -> np.ndarray:
    """Unit rows (float32) of packed ones."""
    x = np.frombuffer(b"".join(blobs), dtype="<i2").reshape(len(blobs), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fine(x: np.ndarray) -> list[bytes]:
    """Unit rows as 24-bit integers relative to the row's largest number: an error below 1e-7 in a cosine, as float32 sums have."""
    peak = np.abs(x).max(axis=1, keepdims=True)
    q = np.rint(x / np.where(peak > 0, peak, 1) * FINE_SCALE).astype("<i4")
    return [r.tobytes() for r in np.ascontiguousarray(q.view(np.uint8).reshape(*q.shape, 4)[:, :, :3])]


def unfine(blobs: list[bytes]) -> np.ndarray:
    """Unit rows (float64) of ``fine`` ones."""
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), -1, 3)
    wide = np.zeros((*raw.shape[:2], 4), dtype=np.uint8)
    wide[:, :, 1:] = raw
    x = (wide.view("<i4")[:, :, 0] >> 8).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(df: DataFrame, *keep: str) -> DataFrame:
    """Rows whose blob can be a vector: id, model_id, model_hash, dimensions (int), vector_blob and ``keep``.

    Whether the numbers are finite and not all zero is seen where they are decoded.
    Rows without an id or a revision are dropped; a repeated id stays.
    """
    cols = [F.col("id").cast("long").alias("id"), "model_id", "model_hash", F.col("dimensions").cast("int").alias("dimensions"), "vector_blob", *keep]
    return df.select(*cols).filter(blob_fits(F.col("vector_blob"), F.col("dimensions")) & F.col("id").isNotNull() & F.col("model_id").isNotNull() & F.col("model_hash").isNotNull())


class Pivots:
    """The sampled pivots by revision: {(model_id, model_hash, dimensions): float32 matrix}."""

    def __init__(self, by: dict[tuple, np.ndarray], rows: int = 0):
        self.by, self.rows = by, rows
        self._copies: dict[tuple, tuple] = {}

    @staticmethod
    def sample(vectors: DataFrame, per_cell: int, seed: int, most: int = MOST_PIVOTS) -> "Pivots":
        """One pivot to ``per_cell`` vectors, ``most`` at most; each revision gets at least one."""
        revision = ["model_id", "model_hash", "dimensions"]
        sizes = vectors.groupBy(*revision).agg(F.count(F.lit(1)).alias("n")).collect()
        total = sum(r["n"] for r in sizes)
        if not total:
            return Pivots({})
        share = min(1 / per_cell, most / total)
        # A hash of the id draws the same pivots every time, however the rows are distributed.
        draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
        few = F.broadcast(vectors.sparkSession.createDataFrame([(r["model_id"], r["model_hash"], r["dimensions"], float(max(share, min(1.0, 8 / r["n"])))) for r in sizes], "model_id string, model_hash string, dimensions int, share double"))
        picked = vectors.join(few, revision).filter(draw < F.col("share")).select(*revision, "id", "vector_blob").dropDuplicates([*revision, "id"]).collect()
        by: dict[tuple, dict[int, bytes]] = {}
        for r in picked:
            by.setdefault((r["model_id"], r["model_hash"], r["dimensions"]), {})[r["id"]] = bytes(r["vector_blob"])
        out = {}
        for key, own in by.items():
            x, ok = unit_rows(decode([own[i] for i in sorted(own)], key[2]))
            if ok.any():
                out[key] = x[ok].astype(np.float32)
        for r in sizes:
            key = (r["model_id"], r["model_hash"], r["dimensions"])
            out.setdefault(key, np.eye(1, key[2], dtype=np.float32))
        return Pivots(out, total)

    def nearest(self, key: tuple, x: np.ndarray, t: int) -> np.ndarray:
        """The numbers of the ``t`` pivots (or all, if fewer) nearest to each unit row."""
        p = self.by[key]
        t = min(t, len(p))
        out = np.empty((len(x), t), dtype=np.int64)
        for b in range(0, len(x), 4096):
            s = x[b : b + 4096].astype(np.float32) @ p.T
            out[b : b + 4096] = np.argpartition(-s, t - 1, axis=1)[:, :t] if t < len(p) else np.arange(t)
        return out


    def number(self, key: tuple) -> int:
        """A number of the revision, the same in every task."""
        return sorted(self.by).index(tuple(key))

    def split(self, key: tuple, nearest: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cells in which vectors that very many rows repeat are spread over the copies of their pivot.

        A blob that fills a third of the rows also fills a third of the pivots.
        """
        if key not in self._copies:
            _, first, copies = np.unique(self.by[key], axis=0, return_inverse=True, return_counts=True)
            order = np.argsort(first.ravel(), kind="stable")
            self._copies[key] = (first.ravel(), copies, order, np.concatenate([[0], np.cumsum(copies)]))
        kind, copies, order, start = self._copies[key]
        k = kind[nearest]
        return order[start[k] + ids % copies[k]]


def by_revision(frame: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    for key, rows in frame.groupby(["model_id", "model_hash", "dimensions"], sort=False):
        yield (key[0], key[1], int(key[2])), rows


def split_cells(entered: DataFrame, per_cell: int, rows_of_cell: int, seed: int, t: int = 2, part: int = 20_000) -> DataFrame:
    """A second level of cells: rows (revision, id, v, cell) of each cell enter the cells of the ``t`` nearest of its own sampled rows.

    For tables of more rows than the broadcast pivots can divide: then a cell
    has about ``rows_of_cell`` rows, which grows with the table. Its rows are
    spread over parts of about ``part``, and its own pivots, one to ``per_cell``
    rows, go to each part. A cell without a sampled row stays whole.
    """
    revision = ["model_id", "model_hash", "dimensions"]
    parts = max(1, -(-rows_of_cell // part))
    draw = F.pmod(F.xxhash64("id", "cell", F.lit(seed)), F.lit(per_cell))
    inner = entered.filter(draw == 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    inner = inner.select(*[F.col(c).alias(f"p_{c}") for c in inner.columns])
    spread = entered.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def assign(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in [*revision, "id", "v", "cell"]})
        near = np.zeros((len(rows), 1), dtype=np.int64)
        if len(own):
            own = own.drop_duplicates("p_id").sort_values("p_id")
            near = Pivots({(): unfine(list(own["p_v"])).astype(np.float32)}).nearest((), unfine(list(rows["v"])), t)
        at = np.repeat(np.arange(len(rows)), near.shape[1])
        return rows.iloc[at][[*revision, "id", "v"]].assign(cell=(int(key[3]) << 24) + near.ravel())

    keys = [*revision, "cell", "part"]
    return spread.groupBy(*keys).cogroup(inner.groupBy(*[f"p_{c}" for c in keys])).applyInPandas(assign, "model_id string, model_hash string, dimensions int, id long, v binary, cell long")
