"""Boxes, landmarks and their matching within photos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes (x, y, width, height); 0 where the union is 0."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    shared = w * h
    union = aw * ah + bw * bh - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def box(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "w", "h"))  # type: ignore[return-value]


def landmark_ratio(a: Column, b: Column, diagonal_a: Column, diagonal_b: Column) -> Column:
    """Mean distance of corresponding points (arrays of x, y) over the mean diagonal of the boxes."""
    gaps = F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)))
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(gaps)
    return mean / ((diagonal_a + diagonal_b) / 2)


def overlapping_pairs(left: DataFrame, right: DataFrame, photo: str, least: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes of one photo (columns l_* and r_*, each with id, x, y, w, h and ``keep``) whose IoU is ``least`` at least.

    An equi-join on the photo; a photo has few boxes.
    """
    a = left.select(photo, *[F.col(c).alias(f"l_{c}") for c in ("id", "x", "y", "w", "h", *keep)])
    b = right.select(photo, *[F.col(c).alias(f"r_{c}") for c in ("id", "x", "y", "w", "h", *keep)])
    return a.join(b, photo).withColumn("iou", iou(box("l_"), box("r_"))).filter(F.col("iou") + EPSILON >= least)


def diagonal(prefix: str) -> Column:
    return F.sqrt(F.pow(F.col(f"{prefix}w"), 2) + F.pow(F.col(f"{prefix}h"), 2))


def reconcile(existing: DataFrame, candidates: DataFrame, photo: str, least: float = 0.3, apart: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """((photo, candidate, outcome, existing_id), (photo, existing_id) left over) of new boxes against known ones.

    Boxes have marks, an array of points (x, y) in a fixed order. A known box is
    eligible for a candidate if their IoU is ``least`` at least and their points
    are, on average, no further apart than ``apart`` of the boxes' mean
    diagonal. No eligible box makes a candidate new; exactly one, which no other
    candidate is eligible for, existing; all else is ambiguous.
    """
    near = overlapping_pairs(existing, candidates, photo, least, ("marks",)).filter(landmark_ratio(F.col("l_marks"), F.col("r_marks"), diagonal("l_"), diagonal("r_")) <= apart + EPSILON)
    pairs = near.select(photo, F.col("l_id").alias("existing_id"), F.col("r_id").alias("candidate"))
    counted = pairs.withColumn("of_candidate", F.count(F.lit(1)).over(Window.partitionBy(photo, "candidate"))).withColumn("of_existing", F.count(F.lit(1)).over(Window.partitionBy(photo, "existing_id")))
    sure = counted.filter("of_candidate = 1 and of_existing = 1").select(photo, "candidate", "existing_id")
    met = counted.select(photo, "candidate").distinct().withColumn("met", F.lit(True))
    outcome = F.when(F.col("existing_id").isNotNull(), "existing").when(F.col("met"), "ambiguous").otherwise("new")
    result = candidates.select(photo, F.col("id").alias("candidate")).join(met, [photo, "candidate"], "left").join(sure, [photo, "candidate"], "left").select(photo, "candidate", outcome.alias("outcome"), "existing_id")
    rest = existing.select(photo, F.col("id").alias("existing_id")).join(sure, [photo, "existing_id"], "left_anti")
    return result, rest


def match_kinds(truth: DataFrame, candidates: DataFrame, photo: str, least: float) -> DataFrame:
    """(photo, side, id, kind): the kinds of the bipartite components of a photo's boxes.

    matched is one box of each side; missed and false are alone; duplicate is
    one true box with several candidates; all else is ambiguous. A component has
    one true box if and only if none of that box's candidates overlaps another,
    so degrees tell the kinds and no component has to be built.
    """
    pairs = overlapping_pairs(truth, candidates, photo, least).select(photo, "l_id", "r_id")
    pairs = pairs.withColumn("of_true", F.count(F.lit(1)).over(Window.partitionBy(photo, "l_id"))).withColumn("of_candidate", F.count(F.lit(1)).over(Window.partitionBy(photo, "r_id")))
    pairs = pairs.withColumn("most", F.max("of_candidate").over(Window.partitionBy(photo, "l_id")))
    kind = F.when((F.col("of_true") == 1) & (F.col("of_candidate") == 1), "matched").when((F.col("of_true") > 1) & (F.col("most") == 1), "duplicate").otherwise("ambiguous")
    kinds = pairs.select(photo, "l_id", "r_id", kind.alias("kind"))

    def side(rows: DataFrame, name: str, key: str, alone: str) -> DataFrame:
        own = kinds.groupBy(photo, F.col(key).alias("id")).agg(F.first("kind").alias("kind"))
        return rows.select(photo, "id").join(own, [photo, "id"], "left").select(photo, F.lit(name).alias("side"), F.col("id").cast("long").alias("id"), F.coalesce("kind", F.lit(alone)).alias("kind"))

    return side(truth, "truth", "l_id", "missed").unionByName(side(candidates, "candidate", "r_id", "false"))


#: Boxes that a task of ``suppress`` takes in one frame, on average.
SUPPRESS_ROWS = 50_000


def suppress(detections: DataFrame, photo: str, least: float, most: int | None = None) -> DataFrame:
    """(photo, id) of the boxes that greedy non-maximum suppression keeps: highest score first, then the smallest id.

    Suppression is sequential within a photo; photos are handled by the bucket, so none costs a frame of its own.
    """

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([photo, "score", "id"], ascending=[True, False, True], ignore_index=True)
        x, y, w, h = (frame[c].to_numpy(dtype=float) for c in ("x", "y", "w", "h"))
        area = w * h
        edges = np.nonzero(frame[photo].to_numpy()[1:] != frame[photo].to_numpy()[:-1])[0] + 1
        kept: list[int] = []
        for lo, hi in zip([0, *edges], [*edges, len(frame)]):
            alive, n = np.ones(hi - lo, dtype=bool), 0
            for i in range(lo, hi):
                if not alive[i - lo]:
                    continue
                if most is not None and n >= most:
                    break
                kept.append(i)
                n += 1
                rest = slice(i + 1, hi)
                iw = np.minimum(x[rest] + w[rest], x[i] + w[i]) - np.maximum(x[rest], x[i])
                ih = np.minimum(y[rest] + h[rest], y[i] + h[i]) - np.maximum(y[rest], y[i])
                shared = np.maximum(iw, 0) * np.maximum(ih, 0)
                alive[i + 1 - lo :] &= shared <= least * (area[rest] + area[i] - shared)
        return frame.loc[kept, [photo, "id"]]

    types = dict(detections.dtypes)
    buckets = max(1, detections.count() // SUPPRESS_ROWS)
    rows = detections.select(photo, "id", "score", "x", "y", "w", "h").withColumn("bucket", F.pmod(F.xxhash64(photo), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandas(keep, f"{photo} {types[photo]}, id {types['id']}")


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles along an axis; the last tile ends at the edge. One tile where the image is no larger."""
    step = tile - overlap
    if step <= 0:
        raise ValueError("tiles must overlap by less than their size")
    last = F.greatest(length - tile, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(last / step).cast("int")), lambda i: F.least(i * step, last)))


def tiles(images: DataFrame, key: str, tile: int, overlap: int) -> DataFrame:
    """(key, x, y, w, h) of the tiles of every image larger than a tile; images without a size have none."""
    sized = images.filter((F.col("width") > tile) | (F.col("height") > tile)).filter("width > 0 and height > 0")
    return sized.select(key, "width", "height", F.explode(tile_starts(F.col("width"), tile, overlap)).alias("x")).select(key, "width", "height", "x", F.explode(tile_starts(F.col("height"), tile, overlap)).alias("y")).select(key, "x", "y", F.least(F.lit(tile), "width").alias("w"), F.least(F.lit(tile), "height").alias("h"))


def padded_crop(x: Column, y: Column, w: Column, h: Column, pad: float, width: Column, height: Column) -> Column:
    """The pixel box around a box with ``pad`` parts of its size on each side, within the image."""
    left, top = F.greatest(F.floor(x - w * pad), F.lit(0)), F.greatest(F.floor(y - h * pad), F.lit(0))
    right, bottom = F.least(F.ceil(x + w + w * pad), width), F.least(F.ceil(y + h + h * pad), height)
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def to_source(x: Column, y: Column, w: Column, h: Column, tile_x: Column, tile_y: Column, scale: float | Column, width: Column, height: Column) -> Column:
    """A box found in a tile (pixels of the tile, scaled by ``scale``) as a box of the picture, cut off at its edges; null where nothing is left."""
    left, top = F.greatest(tile_x + x / scale, F.lit(0.0)), F.greatest(tile_y + y / scale, F.lit(0.0))
    right, bottom = F.least(tile_x + (x + w) / scale, width.cast("double")), F.least(tile_y + (y + h) / scale, height.cast("double"))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def to_unit(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in pixels as parts of the picture's size; null for a picture without a size."""
    return F.when((width > 0) & (height > 0), F.struct((x / width).alias("x"), (y / height).alias("y"), (w / width).alias("w"), (h / height).alias("h")))


def to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in parts of the picture's size as whole pixels that cover it, within the picture."""
    left, top = F.greatest(F.floor(x * width), F.lit(0)), F.greatest(F.floor(y * height), F.lit(0))
    right, bottom = F.least(F.ceil((x + w) * width), width), F.least(F.ceil((y + h) * height), height)
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def decode_grid(cells: DataFrame, least: float) -> DataFrame:
    """Boxes (photo, id, score, x, y, w, h) of a detector's raw grid cells whose score is ``least`` at least.

    ``cells`` has photo, stride, row, col, cls, obj, dx, dy, dw and dh: the score
    is the geometric mean of cls and obj, cut to 0..1; the centre lies dx, dy
    strides from the cell's corner, and the size is e^dw, e^dh strides. id
    numbers the cells of a photo by stride, row and column.
    """
    unit = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    s = F.col("stride").cast("double")
    w, h = F.exp("dw") * s, F.exp("dh") * s
    x, y = (F.col("col") + F.col("dx")) * s - w / 2, (F.col("row") + F.col("dy")) * s - h / 2
    kept = cells.withColumn("score", F.sqrt(unit("cls") * unit("obj"))).filter(F.col("score") >= least)
    number = (F.col("stride").cast("long") * 2**40) + F.col("row").cast("long") * 2**20 + F.col("col").cast("long")
    return kept.select("photo", number.alias("id"), "score", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def alignment(points: Column, onto: list[tuple[float, float]]) -> Column:
    """(a, b, tx, ty) of the similarity that brings ``points`` (an array of x, y) closest to ``onto``: x' = a x - b y + tx, y' = b x + a y + ty.

    Least squares in closed form, as columns. Null where points are missing or all the same.
    """
    n = float(len(onto))
    target = F.array(*[F.struct(F.lit(float(x)).alias("u"), F.lit(float(y)).alias("v")) for x, y in onto])
    both = F.zip_with(points, target, lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["u"].alias("u"), q["v"].alias("v")))
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, e: s + f(e))
    x, y, u, v = (total(lambda e, c=c: e[c]) / n for c in ("x", "y", "u", "v"))
    xx = total(lambda e: e["x"] * e["x"] + e["y"] * e["y"]) - n * (x * x + y * y)
    dot = total(lambda e: e["x"] * e["u"] + e["y"] * e["v"]) - n * (x * u + y * v)
    cross = total(lambda e: e["x"] * e["v"] - e["y"] * e["u"]) - n * (x * v - y * u)
    a, b = dot / xx, cross / xx
    return F.when((F.size(points) == len(onto)) & (xx > EPSILON), F.struct(a.alias("a"), b.alias("b"), (u - a * x + b * y).alias("tx"), (v - b * x - a * y).alias("ty")))
