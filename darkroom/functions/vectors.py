"""Vectors stored as little-endian float32 blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blob_fits(blob: Column, dimensions: Column) -> Column:
    """Whether a blob has room for exactly ``dimensions`` float32 values (JVM side, null-safe)."""
    return F.coalesce((F.length(blob) == dimensions.cast("long") * 4) & (dimensions > 0), F.lit(False))


def decode(blobs: list[bytes], dim: int) -> np.ndarray:
    """A float64 matrix of blobs that all hold ``dim`` values."""
    if not len(blobs):
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(blobs), dtype="<f4").reshape(-1, dim).astype(np.float64)


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 and the mask of usable rows (finite, not all zero)."""
    with np.errstate(all="ignore"):
        peak = np.abs(x).max(axis=1, initial=0.0)
        ok = np.isfinite(x).all(axis=1) & (peak > 0)
        safe = np.where(ok[:, None], x, 1.0) / np.where(ok, peak, 1.0)[:, None]
        return safe / np.linalg.norm(safe, axis=1, keepdims=True), ok


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_array(blob: pd.Series) -> pd.Series:
    """A little-endian float32 blob as an array; null for null or a ragged length."""
    return blob.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays: float products summed as double; null if a length differs or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def l2_norm(a: Column) -> Column:
    """Euclidean length, products in float and the sum in double."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v * v).cast("double")))
