import numpy as np
import pytest

from darkroom.functions.geo import great_circle
from darkroom.operators import spatial
from darkroom.operators.spatial import Quadtree, RTree, nearby

P, A = "key string, lat double, lon double, leaf int", "key string, south double, west double, north double, east double"


def pairs(spark, points, others=(), areas=(), metres=50.0):
    out = nearby(spark.createDataFrame([(*p, 1) for p in points], P), spark.createDataFrame([(*p, 1) for p in others], P), spark.createDataFrame(list(areas), A), metres)
    return {tuple(r) for r in out.collect()}


def test_random_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 100)
    monkeypatch.setattr(spatial, "LEAST_LEAF", 20)
    rng = np.random.default_rng(1)
    centres = np.stack([rng.uniform(-89.9, 89.9, 30), rng.uniform(-180, 180, 30)], 1)
    centres[:6] = [[89.9999, 10], [-89.9999, -170], [0, 179.9999], [0, -179.9999], [45, 180.0], [45, -180.0]]
    at = centres[rng.integers(0, 30, 500)] + rng.normal(0, 3e-4, (500, 2))
    at[:, 0] = np.clip(at[:, 0], -90, 90)
    at[:, 1] = (at[:, 1] + 180) % 360 - 180
    points = [(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(at)]
    others = [(f"o{i}", float(a), float(b)) for i, (a, b) in enumerate(at[:60] + 1e-4) if abs(a) <= 90 and abs(b) <= 180]
    areas = [("west", -1.0, 179.0, 1.0, -179.0), ("box", 10.0, -20.0, 60.0, 40.0), ("bad", 5.0, 0.0, -5.0, 1.0)]
    want = set()
    for i, (k, la, lo) in enumerate(points):
        rest = np.array([p[1:] for p in points[i + 1 :]])
        if len(rest):
            for j in np.nonzero(great_circle(la, lo, rest[:, 0], rest[:, 1]) <= 50)[0]:
                want.add(("point", k, points[i + 1 + j][0]))
        for o, a, b in others:
            if great_circle(np.array([la]), np.array([lo]), a, b)[0] <= 50:
                want.add(("other", k, o))
        if abs(la) <= 1 and (lo >= 179 or lo <= -179):
            want.add(("area", k, "west"))
        if 10 <= la <= 60 and -20 <= lo <= 40:
            want.add(("area", k, "box"))
    assert pairs(spark, points, others, areas) == want
    assert len(want) > 300


def test_unusable_positions_and_repeats(spark):
    points = [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", None, 1.0), ("d", float("nan"), 1.0), ("e", 91.0, 1.0), ("f", 1.0, 181.0), (None, 5.0, 5.0), ("g", 5.0, 5.0), ("g", 5.0, 5.0), ("h", 5.0, 5.0)]
    assert pairs(spark, points) == {("point", "g", "h")}


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    assert pairs(spark, []) == set()
    assert pairs(spark, [("a", 1.0, 1.0)]) == set()


def test_rtree_finds_all_overlaps():
    rng = np.random.default_rng(2)
    lo = rng.uniform(0, 10, (500, 2))
    hi = lo + rng.uniform(0, 1, (500, 2))
    tree = RTree(lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1])
    q = rng.uniform(0, 10, (50, 2))
    p, e = tree.probe(q[:, 0], q[:, 1], q[:, 0] + 0.5, q[:, 1] + 0.5)
    want = {(i, j) for i in range(50) for j in range(500) if (lo[j] <= q[i] + 0.5).all() and (hi[j] >= q[i]).all()}
    assert set(zip(p.tolist(), e.tolist())) == want


def test_leaves_cover_the_world_once():
    rng = np.random.default_rng(3)
    tree = Quadtree.of_sample(rng.normal(48, 1, 5000), rng.normal(11, 1, 5000), 100, 17)
    assert tree.start[0] == 0 and (np.diff(tree.start) > 0).all()
    assert len(tree.touched(-90, -180, 90, 180)) == len(tree.start)


@pytest.mark.parametrize("metres", [0.5, 50.0, 5_000.0, 3_000_000.0])
def test_any_reach(spark, metres, monkeypatch):
    monkeypatch.setattr(spatial, "LEAST_LEAF", 10)
    rng = np.random.default_rng(4)
    far = np.degrees(metres / 6_371_000.0)
    centres = np.stack([rng.uniform(-88, 88, 12), rng.uniform(-180, 180, 12)], 1)
    centres[:3] = [[80.5, 1], [89.99, 0], [-75, 179.99]]
    at = centres[rng.integers(0, 12, 250)] + rng.normal(0, far, (250, 2))
    at[:, 0] = np.clip(at[:, 0], -90, 90)
    at[:, 1] = (at[:, 1] + 180) % 360 - 180
    d = great_circle(at[:, None, 0], at[:, None, 1], at[None, :, 0], at[None, :, 1])
    want = {("point", f"p{i:03d}", f"p{j:03d}") for i in range(250) for j in range(i + 1, 250) if d[i, j] <= metres}
    assert pairs(spark, [(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(at)], metres=metres) == want and len(want) > 250


def test_a_crowded_spot_is_cut_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 60)
    rng = np.random.default_rng(5)
    at = np.array([48.0, 11.0]) + rng.normal(0, 4e-4, (400, 2))
    d = great_circle(at[:, None, 0], at[:, None, 1], at[None, :, 0], at[None, :, 1])
    want = {("point", f"p{i:03d}", f"p{j:03d}") for i in range(400) for j in range(i + 1, 400) if d[i, j] <= 50}
    want |= {("other", f"p{i:03d}", "o") for i in range(400) if great_circle(at[i, 0], at[i, 1], 48.0, 11.0) <= 50}
    assert pairs(spark, [(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(at)], [("o", 48.0, 11.0)]) == want


def test_leaves_grow_with_the_points():
    rng = np.random.default_rng(6)
    load = []
    for n in (20_000, 200_000):
        lat, lon = rng.normal(48, 0.5, n), rng.normal(11, 0.5, n)
        tree = Quadtree.of_sample(lat[::10], lon[::10], 50, spatial.depth_for(50))
        load.append(np.bincount(tree.leaf_of(lat, lon)).max())
    assert max(load) < 1_500
