import random

from pyspark.sql import functions as F

from darkroom.functions.guid import guid
from darkroom.operators.hierarchy import descendant_pairs, hierarchy, rank_lists, tree_paths

SCHEMA = "id string, up string, v string, p string"


def brute(links):
    out = {}
    for i in links:
        order, at = [], i
        while at in links and at not in order:
            order.append(at)
            at = links[at] if links[at] in links else None
        if at is None:
            out[i] = (order[-1], len(order) - 1)
        else:
            out[i] = (min(order[order.index(at):]), -1)
    return out


def run(spark, staging, links):
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in links.items()], SCHEMA)
    return hierarchy(df, F.col("id"), F.col("up"), staging).collect()


def test_random_forest_with_circles(spark, staging):
    rng = random.Random(3)
    ids = [f"n{i:03d}" for i in range(160)]
    links = {x: rng.choice([None, "ghost", *ids]) for x in ids}
    for a, b in zip(ids[:40], ids[1:41]):  # a long chain
        links[a] = b
    got = {r["v"]: r for r in run(spark, staging, links)}
    want = brute(links)
    assert {k: (r["root"], r["depth"]) for k, r in got.items()} == want
    below = {k: 0 for k in links}
    for k in links:
        if want[k][1] > 0:
            at = links[k]
            while at in links:
                below[at] += 1
                at = links[at]
    for k, r in got.items():
        if want[k][1] >= 0:
            assert r["descendants"] == below[k], k
    # entry and exit nest exactly as the tree does
    tree = [r for r in got.values() if want[r["v"]][1] >= 0]
    for a in tree[:50]:
        inside = sum(b["root"] == a["root"] and a["entry"] <= b["entry"] and b["exit"] <= a["exit"] for b in tree) - 1
        assert inside == a["descendants"]


def test_many_children_self_link_nulls_and_repeats(spark, staging):
    rows = [(f"c{i}", "root", None, None) for i in range(300)] + [("root", None, None, None), ("me", "me", None, None), (None, "root", None, None), ("c1", "root", None, None), ("blank", "", None, None)]
    got = {r["v"]: r for r in hierarchy(spark.createDataFrame(rows, SCHEMA), F.col("id"), F.when(F.col("up") != "", F.col("up")), staging).collect()}
    assert len(got) == 303
    assert got["root"]["descendants"] == 300 and got["root"]["depth"] == 0
    assert got["c7"]["root"] == "root" and got["c7"]["depth"] == 1
    assert got["me"]["depth"] == -1 and got["me"]["in_cycle"]
    assert got["blank"]["depth"] == 0


def test_paths_and_descendants(spark, staging):
    df = spark.createDataFrame([("a", "b", "", ""), ("b", "c", "", ""), ("c", None, "", ""), ("x", "y", "", ""), ("y", "x", "", ""), ("z", "y", "", "")], SCHEMA)
    paths = tree_paths(hierarchy(df, F.col("id"), F.col("up"), staging))
    assert {r["v"]: r["path"] for r in paths.collect()} == {"a": ["c", "b", "a"], "b": ["c", "b"], "c": ["c"], "x": ["x"], "y": ["y"], "z": ["y", "z"]}
    assert {(r["v"], r["descendant"]) for r in descendant_pairs(paths).collect()} == {("b", "a"), ("c", "a"), ("c", "b"), ("y", "z")}


def test_paths_over_many_stretches(spark, staging, monkeypatch):
    from darkroom.operators import hierarchy as h

    monkeypatch.setattr(h, "STRETCH", 8)
    monkeypatch.setattr(h, "BUCKET", 40)
    rng = random.Random(5)
    links = {0: None} | {i: rng.choice([max(0, i - 1), rng.randrange(i)]) for i in range(1, 300)}
    df = spark.createDataFrame([(f"n{k:03d}", None if v is None else f"n{v:03d}", "", "") for k, v in links.items()], SCHEMA)
    got = {r["v"]: r["path"] for r in tree_paths(staging.save(hierarchy(df, F.col("id"), F.col("up"), staging))).collect()}
    for i in links:
        chain = [i]
        while links[chain[-1]] is not None:
            chain.append(links[chain[-1]])
        assert got[f"n{i:03d}"] == [f"n{x:03d}" for x in reversed(chain)]


def test_contracted_lists_rank_as_others_do(spark, staging):
    arcs = [(f"{k}-{i:04d}", f"{k}-{i + 1:04d}" if i < n - 1 else None, 1 if i % 3 else -1, 1, None if i < n - 1 else str(k)) for k, n in enumerate((1, 2, 40, 900)) for i in range(n)]
    df = spark.createDataFrame(arcs, "a string, s string, w long, c long, r string")
    ranked = lambda contract: sorted(tuple(r) for r in rank_lists(df, staging, contract).select("a", "w", "c", "r").collect())
    assert ranked(10) == ranked(10_000) and len(ranked(10)) == 943 and ranked(10)[-900][2] == 900


def test_empty(spark, staging):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy(empty, F.col("id"), F.col("up"), staging).count() == 0
    assert tree_paths(staging.save(hierarchy(empty, F.col("id"), F.col("up"), staging))).count() == 0


def test_guid_writings(spark):
    a = "05dff3fd-2c26-4d40-94c7-1277ab8fec45"
    rows = [(a,), ("{" + a.upper() + "} ",), (a.replace("-", ""),), (" " + a,), ("",), ("zz",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "g string").select(guid("g")).collect()]
    assert out == [a] * 4 + [None] * 3
