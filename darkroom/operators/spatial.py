"""Points near points, and regions around points.

A quadtree of a sample cuts the world into leaves of similar load, whose number
grows with the points. Each point probes in its own leaf; what it may meet is
replicated to every leaf that the reach around it touches. A spot too crowded
for a leaf is cut on both sides: blocks of its probes meet blocks of its
entries. A task bulk-loads an R-tree (sort-tile-recursive), probes it for all
its points at once, and refines with the exact distance. Of the two ways to find a pair of points only the one whose probe, the reference
point, has the smaller key is kept, so no pair needs a distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.functions.geo import EARTH_RADIUS, great_circle, on_earth

#: Points of the sample: at least SAMPLE, else one of SHARE points, at most MOST_SAMPLE (16 MB at the driver).
SAMPLE, SHARE, MOST_SAMPLE = 40_000, 400, 1_000_000
#: Points of a leaf: the table's part of LEAVES, within these bounds. A leaf of the sample has LEAST_SAMPLE points at least.
LEAVES, LEAST_LEAF, MOST_LEAF, LEAST_SAMPLE = 256, 500, 20_000, 20
#: Bits of each axis of the finest cell, at most; a finest cell is higher than the reach is wide.
DEPTH = 20
#: Entries of a node of the R-tree.
FANOUT = 16
#: Probes, and entries, that one task handles; a leaf with more is cut into blocks of both.
BLOCK = 40_000
#: Columns of finest cells that a reach may span before the tree is walked for it.
SPAN = 64
#: Probes that look through the tree at a time.
AT_ONCE = 4_096


def depth_for(metres: float) -> int:
    """The number of bits at which a cell is still higher than a reach of ``metres`` is wide."""
    wide = max(2 * np.degrees(metres / EARTH_RADIUS) * 1.001, 1e-9)
    return int(np.clip(np.floor(np.log2(180 / wide)), 1, DEPTH))


@dataclass
class Quadtree:
    """Leaves as half-open ranges of Morton codes of ``depth`` bits an axis, in order of their start."""

    start: np.ndarray
    depth: int

    @staticmethod
    def of_sample(lat: np.ndarray, lon: np.ndarray, leaf: int, depth: int) -> "Quadtree":
        codes = np.sort(morton(lat, lon, depth))
        starts, todo = [], [(0, 4**depth)]
        while todo:
            lo, size = todo.pop()
            n = np.searchsorted(codes, lo + size) - np.searchsorted(codes, lo)
            if n > leaf and size > 1:
                todo += [(lo + i * (size // 4), size // 4) for i in range(4)]
            else:
                starts.append(lo)
        return Quadtree(np.sort(np.array(starts, dtype=np.int64)), depth)

    def leaf(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, code, "right") - 1

    def leaf_of(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return self.leaf(morton(lat, lon, self.depth))

    def touched(self, south: float, west: float, north: float, east: float) -> np.ndarray:
        """The leaves that a box touches, by walking down the tree's cells."""
        (r0, c0), (r1, c1) = _cell(south, west, self.depth), _cell(north, east, self.depth)
        found, todo = [], [(0, 0, 0, self.depth)]
        while todo:
            code, row, col, level = todo.pop()
            side, size = 1 << level, 4**level
            if row > r1 or row + side <= r0 or col > c1 or col + side <= c0:
                continue
            first, last = self.leaf(np.array([code, code + size - 1]))
            if first == last:
                found.append(first)
            else:
                half, quarter = side // 2, size // 4
                todo += [(code + (2 * i + j) * quarter, row + i * half, col + j * half, level - 1) for i in (0, 1) for j in (0, 1)]
        return np.unique(found)


def _cell(lat: float | np.ndarray, lon: float | np.ndarray, depth: int) -> tuple:
    side = 1 << depth
    row = np.clip(np.floor((np.asarray(lat, dtype=float) + 90) / 180 * side), 0, side - 1).astype(np.int64)
    col = np.clip(np.floor((np.asarray(lon, dtype=float) + 180) / 360 * side), 0, side - 1).astype(np.int64)
    return row, col


def morton(lat: np.ndarray, lon: np.ndarray, depth: int) -> np.ndarray:
    """The Morton code of each point's finest cell."""
    row, col = _cell(lat, lon, depth)
    code = np.zeros(len(row), dtype=np.int64)
    for b in range(depth):
        code |= ((col >> b) & 1) << (2 * b) | ((row >> b) & 1) << (2 * b + 1)
    return code


class RTree:
    """A bulk-loaded R-tree over boxes, probed with many boxes at once."""

    def __init__(self, south: np.ndarray, west: np.ndarray, north: np.ndarray, east: np.ndarray):
        n = len(south)
        slices = max(1, int(np.ceil(np.sqrt(n / FANOUT))))
        by_lon = np.argsort(west + east, kind="stable")
        strip = np.empty(n, dtype=np.int64)
        strip[by_lon] = np.arange(n) * slices // max(n, 1)
        self.order = np.lexsort((south + north, strip))
        box = np.stack([south, west, north, east], 1)[self.order]
        self.levels = [box]
        while len(box) > FANOUT:
            edges = np.arange(0, len(box), FANOUT)
            box = np.concatenate([np.minimum.reduceat(box[:, :2], edges), np.maximum.reduceat(box[:, 2:], edges)], 1)
            self.levels.append(box)

    def probe(self, south: np.ndarray, west: np.ndarray, north: np.ndarray, east: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, entry) of all boxes that overlap."""
        top = self.levels[-1]
        p, node = np.repeat(np.arange(len(south)), len(top)), np.tile(np.arange(len(top)), len(south))
        for level in range(len(self.levels) - 1, -1, -1):
            box = self.levels[level][node]
            hit = (box[:, 0] <= north[p]) & (box[:, 2] >= south[p]) & (box[:, 1] <= east[p]) & (box[:, 3] >= west[p])
            p, node = p[hit], node[hit]
            if level:
                below = len(self.levels[level - 1])
                first = node * FANOUT
                many = np.minimum(first + FANOUT, below) - first
                p = np.repeat(p, many)
                node = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return p, self.order[node]


def reach_boxes(lat: np.ndarray, lon: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dlat, dlon) in degrees that hold all points within ``metres``, and whether the reach meets a pole."""
    dlat = np.degrees(metres / EARTH_RADIUS) * (1 + 1e-9)
    edge = np.abs(lat) + dlat
    pole = edge >= 90
    dlon = np.degrees(np.arcsin(np.minimum(np.sin(metres / EARTH_RADIUS) / np.cos(np.radians(np.where(pole, 0, lat))), 1))) * (1 + 1e-9)
    return np.full(len(lat), dlat), np.where(pole, 180.0, dlon), pole


def _spread(tree: Quadtree, lat: np.ndarray, lon: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, leaf, shift): the leaves that the reach of each point touches; shift moves it by a turn across the date line."""
    dlat, dlon, pole = reach_boxes(lat, lon, metres)
    near = np.nonzero(~pole)[0]
    out_p, out_l, out_s = [], [], []
    # The reach is lower than a finest cell, so points no further apart than a cell on its two edges touch all of its leaves.
    high, wide = 180 / (1 << tree.depth), 360 / (1 << tree.depth)
    steps = np.ceil(2 * dlon / wide).astype(np.int64)
    small = near[(steps[near] <= SPAN) & (2 * dlat[near] < high)]
    for many in np.unique(steps[small]):
        own = small[steps[small] == many]
        for sy in (-1, 1):
            y = np.clip(lat[own] + sy * dlat[own], -90, 90)
            for t in range(many + 1):
                x = lon[own] + (2 * t / many - 1) * dlon[own]
                shift = np.where(x < -180, 360.0, np.where(x > 180, -360.0, 0.0))
                out_p.append(own)
                out_l.append(tree.leaf_of(y, x + shift))
                out_s.append(shift)
    for i in np.setdiff1d(np.arange(len(lat)), small):
        for shift in (-360.0, 0.0, 360.0):
            west, east = lon[i] - dlon[i] + shift, lon[i] + dlon[i] + shift
            if east >= -180 and west <= 180:
                leaves = tree.touched(max(lat[i] - dlat[i], -90), max(west, -180), min(lat[i] + dlat[i], 90), min(east, 180))
                out_p.append(np.full(len(leaves), i))
                out_l.append(leaves)
                out_s.append(np.full(len(leaves), shift))
    rows = np.unique(np.stack([np.concatenate(out_p), np.concatenate(out_l), np.concatenate(out_s)], 1), axis=0) if out_p else np.zeros((0, 3))
    return rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2]


_ENTRY = "leaf long, kind string, key string, south double, west double, north double, east double, lat double, lon double, probe boolean"


def nearby(points: DataFrame, others: DataFrame, areas: DataFrame, metres: float) -> DataFrame:
    """(kind, key_a, key_b): points near points, ``others`` near points, and ``areas`` around points.

    ``points`` and ``others`` have key (string), lat and lon in degrees; ``areas``
    has key, south, west, north and east (an area with west > east crosses the
    date line). Kind ``point`` has two keys of points at most ``metres`` apart,
    the smaller first; ``other`` a point and an entry of ``others`` at most
    ``metres`` away; ``area`` a point and an area that holds it, edges included.
    Positions that are null, NaN, not on Earth or (0, 0) and rows without a key
    don't count; a row delivered twice is one, and a point isn't near itself
    even if it has several positions. Empty tables give no rows.
    """
    spark = points.sparkSession
    clean = lambda df: df.select(F.col("key").cast("string").alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).filter(on_earth(F.col("lat"), F.col("lon")) & F.col("key").isNotNull()).distinct()
    points, others = clean(points), clean(others)
    n = points.count()
    if not n:
        return spark.createDataFrame([], "kind string, key_a string, key_b string")
    wanted = min(max(SAMPLE, n // SHARE), MOST_SAMPLE)
    sampled = points.filter(F.pmod(F.xxhash64("key", "lat", "lon"), F.lit(1 << 30)) < int(min(1.0, wanted / n) * (1 << 30))).select("lat", "lon").toPandas()
    of_leaf = min(max(n // LEAVES, LEAST_LEAF), MOST_LEAF)
    tree = Quadtree.of_sample(sampled["lat"].to_numpy(), sampled["lon"].to_numpy(), max(LEAST_SAMPLE, int(of_leaf * min(1.0, wanted / n))), depth_for(metres))
    shared = spark.sparkContext.broadcast(tree)

    def spread(kind: str, probes: bool):  # noqa: ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value
            for frame in frames:
                lat, lon, key = frame["lat"].to_numpy(), frame["lon"].to_numpy(), frame["key"].to_numpy()
                if not len(lat):
                    continue
                p, leaf, shift = _spread(own, lat, lon, metres)
                x = lon[p] + shift
                yield pd.DataFrame({"leaf": leaf, "kind": kind, "key": key[p], "south": lat[p], "west": x, "north": lat[p], "east": x, "lat": lat[p], "lon": x, "probe": False})
                if probes:
                    yield pd.DataFrame({"leaf": own.leaf_of(lat, lon), "kind": kind, "key": key, "south": lat, "west": lon, "north": lat, "east": lon, "lat": lat, "lon": lon, "probe": True})

        return run

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for a in frame.itertuples():
                for west, east in ((a.west, a.east),) if a.west <= a.east else ((a.west, 180.0), (-180.0, a.east)):
                    leaves = own.touched(a.south, west, a.north, east)
                    yield pd.DataFrame({"leaf": leaves, "kind": "area", "key": a.key, "south": a.south, "west": west, "north": a.north, "east": east, "lat": np.nan, "lon": np.nan, "probe": False})

    boxes = areas.select(F.col("key").cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in ("south", "west", "north", "east")]).dropna().filter("south <= north and south between -90 and 90 and north between -90 and 90 and abs(west) <= 180 and abs(east) <= 180").distinct()
    entries = points.mapInPandas(spread("point", True), _ENTRY).unionByName(others.mapInPandas(spread("other", False), _ENTRY)).unionByName(boxes.mapInPandas(cover, _ENTRY))
    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"leaf": shared.value.leaf_of(f["lat"].to_numpy(), f["lon"].to_numpy())})

    # Leaves with more rows than a task should take: at most one of BLOCK rows is such a leaf, so their table is broadcast.
    count = lambda df, name: df.mapInPandas(leaves, "leaf long").groupBy("leaf").agg(F.count(F.lit(1)).alias(name))
    crowd = count(points, "p").join(count(others, "o"), "leaf", "full").select("leaf", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("o", F.lit(0)).alias("o"))
    cuts = crowd.select("leaf", F.greatest(F.ceil(F.col("p") / BLOCK), F.lit(1)).cast("int").alias("of_probes"), F.greatest(F.ceil((F.col("p") + F.col("o")) / BLOCK), F.lit(1)).cast("int").alias("of_entries")).filter("of_entries > 1")
    cut = entries.join(F.broadcast(cuts), "leaf", "left").withColumn("of_probes", F.coalesce("of_probes", F.lit(1))).withColumn("of_entries", F.coalesce("of_entries", F.lit(1)))
    # A probe goes to its own block, against every block of entries, and an entry the other way round.
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    one = lambda c: F.array(F.pmod(F.xxhash64("key", "lat", "lon"), F.col(c)).cast("int"))
    placed = cut.withColumn("probes", F.explode(F.when(F.col("probe"), one("of_probes")).otherwise(every("of_probes"))))
    placed = placed.withColumn("block", F.explode(F.when(F.col("probe"), every("of_entries")).otherwise(one("of_entries")))).drop("of_probes", "of_entries")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows[rows["probe"]]
        build = rows[~rows["probe"]]
        out = []
        if len(asks) and len(build):
            tree = RTree(*[build[c].to_numpy() for c in ("south", "west", "north", "east")])
            kind, key, blat, blon = (build[c].to_numpy() for c in ("kind", "key", "lat", "lon"))
            for b in range(0, len(asks), AT_ONCE):
                part = asks.iloc[b : b + AT_ONCE]
                lat, lon, own = part["lat"].to_numpy(), part["lon"].to_numpy(), part["key"].to_numpy()
                dlat, dlon, _ = reach_boxes(lat, lon, metres)
                p, e = tree.probe(lat - dlat, lon - dlon, lat + dlat, lon + dlon)
                k = kind[e]
                area = k == "area"
                box = build.iloc[e[area]]
                inside = (box["south"].to_numpy() <= lat[p[area]]) & (lat[p[area]] <= box["north"].to_numpy()) & (box["west"].to_numpy() <= lon[p[area]]) & (lon[p[area]] <= box["east"].to_numpy())
                keep = np.zeros(len(p), dtype=bool)
                keep[np.nonzero(area)[0][inside]] = True
                flat = ~area
                close = great_circle(lat[p[flat]], lon[p[flat]], blat[e[flat]], blon[e[flat]]) <= metres
                reference = (k[flat] != "point") | (own[p[flat]] < key[e[flat]])
                keep[np.nonzero(flat)[0][close & reference]] = True
                out.append(pd.DataFrame({"kind": k[keep], "key_a": own[p[keep]], "key_b": key[e[keep]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["kind", "key_a", "key_b"], dtype=object)

    return placed.groupBy("leaf", "probes", "block").applyInPandas(join, "kind string, key_a string, key_b string")
