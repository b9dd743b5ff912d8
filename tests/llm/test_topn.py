import math
import random

from darkroom.llm import topn
from darkroom.llm.topn import top_n_per_group

SCHEMA = "face string, sid long, margin double, rank int, d0 string, g int"


def brute(rows, n):
    best = {}
    for f, s, m, r, *_ in rows:
        if f is None or s is None:
            continue
        missing = m is None or math.isnan(m)
        key = (missing, 0.0 if missing else -m, r is None, r or 0, s)
        best.setdefault(f, {})
        best[f][s] = min(best[f].get(s, key), key)
    return {(f, s) for f, own in best.items() for s in sorted(own, key=own.get)[:n]}


def test_against_sorting(spark, staging):
    rng = random.Random(5)
    rows = []
    for f in range(40):
        for s in range(rng.choice([1, 2, 3, 5, 40])):
            m = rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 0.1, 0.1, rng.uniform(-1, 1), 1e-300])
            rows.append((f"f{f}", rng.choice([s, s + (1 << 40), -s]), m, rng.choice([None, 1, 2, 3, -5]), "x", 1))
    rows += [("hot", i, round(rng.random(), 1), 1, "x", 1) for i in range(3000)]
    rows += [("same", i, 0.5, 1, "x", 1) for i in range(500)]
    rows += [("rep", 7, 0.5, 1, "x", 1)] * 20 + [("rep", 8, 0.4, 1, "x", 1), ("rep", 9, 0.3, 1, "x", 1), ("rep", 7, 0.9, 4, "x", 1)]
    rows += [(None, 1, 0.5, 1, "x", 1), ("n", None, 0.5, 1, "x", 1)]
    got = {tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), "face", "sid", "margin", ["rank"], 3, staging).collect()}
    assert got == brute(rows, 3)


def test_hot_groups_are_broadcast(spark, staging, monkeypatch):
    monkeypatch.setattr(topn, "HOT_ROWS", 50)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c"]), i, rng.choice([0.1, 0.2, rng.random()]), 1, "x", 1) for i in range(900)]
    got = {tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), "face", "sid", "margin", ["rank"], 5, staging).collect()}
    assert got == brute(rows, 5)


def test_empty(spark, staging):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), "face", "sid", "margin", ["rank"], 3, staging).count() == 0
