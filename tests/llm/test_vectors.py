import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm.clusters import FeatureTree, assign, feature_leaves, leaves_of, similarity_clusters, typical_faces, ward
from darkroom.llm.neighbours import RADII, most_similar, search, search_rows
from darkroom.llm.routing import fine, unfine

E = "id long, face_crop_id string, model_id string, model_hash string, dimensions int, vector_blob binary, cell int, v string"
C = "crop_id string, face_occurrence_id string, leaf int"


def guid(i, kind=0):
    return f"{kind:08x}-0000-0000-0000-{i:012x}"


def rows_of(x, start=0, model="m", digest="h"):
    return [(start + i, guid(start + i, 1), model, digest, x.shape[1], np.asarray(v, "<f4").tobytes(), 1, "z") for i, v in enumerate(x)]


def groups(rng, n, size, dim, noise):
    c = rng.standard_normal((n, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return np.repeat(c, size, axis=0) + noise / np.sqrt(dim) * rng.standard_normal((n * size, dim))


def odd_rows():
    nan = np.full(32, np.nan, "<f4").tobytes()
    return [
        (900_001, guid(1, 1), "m", "h", 32, None, 1, "z"), (900_002, guid(1, 1), "m", "h", 32, b"", 1, "z"), (900_003, guid(1, 1), "m", "h", 32, b"123", 1, "z"), (900_004, guid(1, 1), "m", "h", 32, nan, 1, "z"),
        (900_005, guid(1, 1), "m", "h", 32, bytes(128), 1, "z"), (None, guid(1, 1), "m", "h", 32, np.ones(32, "<f4").tobytes(), 1, "z"), (900_006, guid(1, 1), None, "h", 32, np.ones(32, "<f4").tobytes(), 1, "z"), (900_007, None, "m", "lonely", 32, np.ones(32, "<f4").tobytes(), 1, "z"),
    ]


def test_recall_of_near_neighbours(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([groups(rng, 60, 8, 32, 0.25), rng.standard_normal((1500, 32))])
    rows = rows_of(x * rng.uniform(0.1, 30, (len(x), 1)))
    rows += rows[:40] + odd_rows()  # delivered twice, and unusable
    got = {(r["id"], r["other"]) for r in most_similar(spark.createDataFrame(rows, E), 5).filter("cosine >= 0.9").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    assert len(want) > 1500
    assert len(got & want) >= 0.97 * len(want)


def test_every_vector_has_k_and_never_itself(spark):
    x = np.random.default_rng(2).standard_normal((300, 32))
    out = most_similar(spark.createDataFrame(rows_of(x), E), 5).toPandas()
    assert (out["id"] != out["other"]).all() and not out.duplicated(["id", "other"]).any()
    assert out.groupby("id").size().eq(5).all() and out["id"].nunique() == 300


def test_copies_beyond_k(spark):
    x = np.concatenate([np.ones((60, 32)), np.random.default_rng(3).standard_normal((100, 32))])
    out = most_similar(spark.createDataFrame(rows_of(x) + rows_of(x)[:70], E), 5).filter("cosine > 0.999").toPandas()
    assert set(out["id"]) == set(range(60)) and out.groupby("id").size().eq(5).all() and (out["id"] != out["other"]).all()
    assert set(out.loc[out["id"] > 5, "other"]) == set(range(5))


@pytest.mark.parametrize("least", [0.65, 0.95])
def test_all_pairs_above_a_cosine(spark, least):
    rng = np.random.default_rng(5)
    x = np.concatenate([groups(rng, 80, 4, 48, 0.1), groups(rng, 20, 12, 48, 0.4), rng.standard_normal((900, 48))])
    got = {(r["id"], r["other"]) for r in most_similar(spark.createDataFrame(rows_of(x), E), 5, least).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= least}
    assert got <= {(i, int(j)) for i, j in zip(*np.nonzero(s >= least))} and len(got & want) >= 0.98 * len(want) > 500


def test_second_level_of_cells(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([groups(rng, 100, 6, 32, 0.2), rng.standard_normal((3000, 32))])
    df = spark.createDataFrame(rows_of(x), E)
    got = {(r["id"], r["other"]) for r in most_similar(df, 5, 0.9, most=4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    assert len(want) > 1500 and len(got & want) >= 0.97 * len(want)


def test_search_finds_nearly_all_neighbours_of_the_queries(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([groups(rng, 50, 5, 64, 0.4), rng.standard_normal((2000, 64))])
    rows = rows_of(x) + rows_of(x)[:30] + odd_rows() + rows_of(rng.standard_normal((3, 32)), 5000, digest="other") + rows_of(rng.standard_normal((1, 16)), 6000, digest="single")
    out = search(spark.createDataFrame(rows, E), F.col("id") % 10 == 0, 5).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(0, len(x), 10) for j in np.argsort(-s[i])[:5]}
    own = out[out["id"] < 5000]
    assert len(own) == len(want) and len({*zip(own["id"], own["other"])} & want) >= 0.95 * len(want)
    assert {*zip(out.loc[out["id"] >= 5000, "id"], out.loc[out["id"] >= 5000, "other"])} == {(5000, 5001), (5000, 5002)}


def test_24_bits_keep_a_cosine():
    x = np.random.default_rng(12).standard_normal((200, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(unfine(fine(x)) @ x.T - x @ x.T).max() < 1e-7


def test_few_rows_are_verified():
    rng = np.random.default_rng(13)
    x = np.concatenate([groups(rng, 20, 5, 128, 0.1), rng.standard_normal((1500, 128))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, r, c, verified = search_rows(x, x, np.arange(len(x)), 5, rng.standard_normal((128, 16)).astype(np.float32), (0.316,), 0.95)
    assert len(q) == 20 * 5 * 4 and verified < 0.02 * len(x) ** 2


def test_empty(spark):
    assert most_similar(spark.createDataFrame([], E), 5).count() == 0
    assert most_similar(spark.createDataFrame(odd_rows(), E), 5).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny_cells(n):
    x = np.random.default_rng(4).standard_normal((n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, r, c, _ = search_rows(x.astype(np.float64), x.astype(np.float64), np.arange(n), 5, np.random.default_rng(0).standard_normal((8, 16)).astype(np.float32), RADII)
    assert len(q) == n * (n - 1) and (q != r).all()


def test_clusters_against_single_linkage(spark, staging):
    rng = np.random.default_rng(7)
    x = np.concatenate([groups(rng, 25, 6, 64, 0.42), groups(rng, 1, 300, 64, 0.42), rng.standard_normal((400, 64))])
    rows = rows_of(x)
    face = list(range(len(x)))
    face[len(x) - 1] = face[0]  # one face with vectors in two places
    crops = [(guid(i, 1), guid(f, 2), 1) for i, f in enumerate(face)]
    crops += crops[:10] + [(None, guid(5, 2), 1), (guid(7, 9), None, 1)]
    out = similarity_clusters(spark.createDataFrame(rows + rows[:30] + odd_rows(), E), spark.createDataFrame(crops, C), 0.65, 3, staging).select("cluster_face_id", "face_occurrence_id").distinct().collect()
    got = {tuple(r) for r in out}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.65
    label = np.arange(len(x))
    label[-1] = 0
    while True:
        new = np.array([label[near[i] | (np.array(face) == face[i])].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    by = {}
    for i, lab in enumerate(label):
        by.setdefault(lab, set()).add(guid(face[i], 2))
    want = {(min(s), f) for s in by.values() if len(s) >= 3 for f in s}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_tree_adds_up_and_ward_merges_the_close():
    rng = np.random.default_rng(8)
    x = np.concatenate([groups(rng, 5, 40, 64, 0.3), rng.standard_normal((600, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf, sums, counts = feature_leaves(x, 0.72)
    assert counts.sum() == len(x) and (counts > 0).all() and len(counts) < 640
    for i in range(len(counts)):
        np.testing.assert_allclose(sums[i], x[leaf == i].sum(axis=0), rtol=1e-4, atol=1e-4)
    head, _, _ = ward(x[:200], np.ones(200), 0.65)
    assert len(set(head)) == 5 and all(len(set(head[i * 40 : i * 40 + 40])) == 1 for i in range(5))


def test_tree_keeps_its_branching():
    x = np.random.default_rng(18).standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = FeatureTree(16, 0.8, 8)
    entry = np.concatenate([tree.insert(x[b : b + 500]) for b in range(0, 3000, 500)])
    assert max(map(len, tree.below)) <= 8 and sum(tree.inner) > 8
    assert tree.entries == len(set(entry)) and tree.counts[tree.root].sum() == 3000
    np.testing.assert_allclose(tree.sums[tree.root].sum(axis=0), x.sum(axis=0), atol=1e-6)
    same = FeatureTree(16, 0.8, 8).insert(np.repeat(x[:1], 100, axis=0))
    assert len(set(same)) == 1


def test_ward_is_not_the_link_graph():
    # A chain: each is near to the next one only, so what has grown is no longer near to what follows.
    turn = np.radians(45) * np.arange(6)
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    head, linked, doubtful = ward(x, np.ones(6), 0.65)
    assert len(set(head)) == 3 and {(int(a), int(b)) for a, b in linked} == {(1, 2), (3, 4)} and not len(doubtful)
    # Two features whose mean falls short, though a pair of members is near.
    sums, counts = np.array([[1.0, 0, 0] , [0.55, 0.6, 0.1]]) * [[2 * 0.8], [2]], np.array([2, 2])
    head, linked, doubtful = ward(sums, counts, 0.65)
    assert len(set(head)) == 2 and not len(linked) and doubtful.tolist() == [[0, 1]]


def test_a_chain_and_a_single_pair_join_clusters(spark, staging):
    rng = np.random.default_rng(19)
    d = 64
    base = np.linalg.qr(rng.standard_normal((d, d)))[0]
    turn = np.radians(44) * np.arange(9)
    chain = np.cos(turn)[:, None] * base[0] + np.sin(turn)[:, None] * base[1]
    left = base[5] + 0.06 * rng.standard_normal((30, d))
    right = 0.55 * base[5] + np.sqrt(1 - 0.55**2) * base[6] + 0.06 * rng.standard_normal((30, d))
    left[0] = 0.93 * base[5] + 0.36 * base[6]
    right[0] = 0.7 * base[5] + 0.7 * base[6]
    far = 0.5 * base[5] + np.sqrt(1 - 0.25) * base[9] + 0.02 * rng.standard_normal((30, d))
    x = np.concatenate([chain, left, right, far, rng.standard_normal((100, d))])
    out = similarity_clusters(spark.createDataFrame(rows_of(x), E), spark.createDataFrame([(guid(i, 1), guid(i, 2), 1) for i in range(len(x))], C), 0.65, 3, staging).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, label = u @ u.T >= 0.65, np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    want = {(guid(int(label[i]), 2), guid(i, 2)) for i in range(len(x)) if (label == label[i]).sum() >= 3}
    assert {*zip(out["cluster_face_id"], out["face_occurrence_id"])} == want
    assert out.loc[out["cluster_face_id"] == guid(0, 2), "part"].nunique() > 1


def test_no_vectors_no_clusters(spark, staging):
    assert similarity_clusters(spark.createDataFrame([], E), spark.createDataFrame([], C), 0.65, 3, staging).count() == 0


def test_every_cluster_with_its_size_and_the_faces_nearest_to_its_centroid(spark, staging):
    rng = np.random.default_rng(9)
    # Clusters of 3 to 60 faces, of which each tenth has a second vector; the rest is alone.
    n = [3, 4, 5, 8, 20, 60]
    x = np.concatenate([groups(rng, 1, k, 64, 0.4) for k in n] + [rng.standard_normal((200, 64))])
    face = list(range(len(x)))
    face[9::10] = face[8::10]
    cluster = np.repeat(np.arange(len(n)), n)
    crops = [(guid(i, 1), guid(f, 2), 1) for i, f in enumerate(face)]
    out = typical_faces(spark.createDataFrame(rows_of(x) + rows_of(x)[:30] + odd_rows(), E), spark.createDataFrame(crops, C), 0.65, 3, 5, staging).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for c in range(len(n)):
        own = np.nonzero(cluster == c)[0]
        if len({face[i] for i in own}) < 3:
            continue
        near = u[own] @ u[own].mean(axis=0)
        best = {}
        for i, s in zip(own, near):
            best[guid(face[i], 2)] = max(s, best.get(guid(face[i], 2), -1))
        want[min(best)] = (len(best), sorted(best, key=lambda f: -best[f])[:5])
    assert out.columns.tolist() == ["model_id", "model_hash", "cluster_face_id", "size", "parts", "typical_faces"]
    assert {r.cluster_face_id: (r.size, list(r.typical_faces)) for r in out.itertuples(index=False)} == want


def test_vectors_are_assigned_to_the_clusters_they_are_near_to(spark, staging):
    from darkroom.llm.clusters import cluster_features

    rng = np.random.default_rng(10)
    x = np.concatenate([groups(rng, 12, 30, 64, 0.4), rng.standard_normal((300, 64))])
    leaves, pivots = leaves_of(spark.createDataFrame(rows_of(x), E), 0.65, staging, 11)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    # Features of half of each group only: the other half must find them by the pass.
    own = leaves.select("id", "leaf").toPandas().set_index("id")["leaf"]
    half = [(int(own[i]), "m", "h", 64, i // 30, 1, 1.0, pack_one(u[i])) for i in range(360) if i % 2]
    features = cluster_features(spark.createDataFrame(half, "leaf long, model_id string, model_hash string, dimensions int, label long, n long, length double, v binary"))
    assert {(r["label"], r["n"]) for r in features.collect()} == {(g, 15) for g in range(12)}
    got = {tuple(r) for r in assign(leaves, features, 0.65, pivots).collect()}
    mean = np.stack([u[g * 30 + 1 : g * 30 + 30 : 2].mean(axis=0) for g in range(12)])
    want = {(int(own[i]), int(g)) for i, g in zip(*np.nonzero(u @ mean.T >= 0.65))}
    assert got == want and {int(own[i]) for i in range(0, 360, 2)} & {leaf for leaf, _ in got}


def pack_one(v):
    from darkroom.llm.routing import pack

    return pack(v[None, :])[0]
