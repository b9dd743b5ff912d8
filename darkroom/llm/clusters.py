"""Clusters of mutually similar faces, from mergeable cluster features.

A cluster feature is (n, LS): the count and the sum of unit vectors. The mean
cosine between the members of two features is LS1 . LS2 / (n1 n2), so a mean of
at least the threshold proves a link without looking at any pair, and features
merge by adding.

1. Every vector goes to the cell of its nearest pivot, and each cell builds a
   cluster-feature tree: nodes of up to BRANCHING features that split in two.
2. The summaries of the trees' leaves go to the cells of their CELLS nearest
   pivots of another sample, where Ward agglomeration merges features while
   what has grown keeps a mean cosine of the threshold. Hooking and shortcutting
   joins merges of different cells. The features of these clusters, fewer and
   larger, are reduced once more, in cells LEVEL times as large.
3. The assignment pass holds every vector against the clusters whose centroid
   enters its cell. A mean cosine of at least the threshold proves a link here
   too, whatever leaf the vector is in.
4. Clusters by links, as p7_found defines them, also join what Ward keeps apart:
   leaves whose mean cosine reaches the threshold, and leaves whose mean falls
   short by no more than their spread allows, where the vectors themselves are
   compared and a single pair decides.
5. A cluster's typical faces are those whose vectors are nearest to its centroid.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.guid import guid
from darkroom.functions.vectors import decode, unit_rows
from darkroom.llm.routing import Pivots, by_revision, pack, unpack, valid_vectors
from darkroom.operators.components import components
from darkroom.operators.skew import lookup
from darkroom.plans.staging import Staging

#: Vectors to a pivot, and the cells that a leaf's summary enters.
PER_CELL, CELLS = 1000, 6
#: Where a leaf's least mean cosine lies between the threshold (0) and 1, so that leaves stay tighter than clusters.
TIGHT = 0.2
#: Features of a node of a tree.
BRANCHING = 32
#: Vectors that a tree takes at a time.
BATCH = 512
#: How many times larger the cells of the second reduction are.
LEVEL = 8
#: Standard deviations of a cosine between members by which a mean may fall short of the threshold before members are compared.
WIDE = 4.0

_REVISION = ["model_id", "model_hash", "dimensions"]
_KEYS = "model_id string, model_hash string, dimensions int"


class FeatureTree:
    """A cluster-feature tree: all leaf nodes at one depth, each entry a feature (n, LS)."""

    def __init__(self, dimensions: int, leaf_at: float, branching: int = BRANCHING):
        self.leaf_at, self.branching, self.dimensions = leaf_at, branching, dimensions
        self.sums, self.counts = [np.zeros((0, dimensions))], [np.zeros(0)]
        #: The node below each entry of an inner node, or the number of each entry of a leaf node.
        self.below: list[list[int]] = [[]]
        self.parent, self.inner, self.root, self.entries = [-1], [False], 0, 0

    def insert(self, x: np.ndarray) -> np.ndarray:
        """The entry that each unit row enters."""
        at, entry = np.full(len(x), self.root), np.empty(len(x), dtype=np.int64)
        while self.inner[at[0]]:
            for node in np.unique(at):
                rows = np.nonzero(at == node)[0]
                slot = (x[rows] @ (self.sums[node] / self.counts[node][:, None]).T).argmax(axis=1)
                np.add.at(self.sums[node], slot, x[rows])
                np.add.at(self.counts[node], slot, 1)
                at[rows] = np.array(self.below[node])[slot]
        for node in np.unique(at):
            rows = np.nonzero(at == node)[0]
            entry[rows] = self._enter(node, x[rows])
            self._split(node)
        return entry

    def _enter(self, node: int, x: np.ndarray) -> np.ndarray:
        own = np.full(len(x), -1)
        if len(self.counts[node]):
            near = x @ (self.sums[node] / self.counts[node][:, None]).T
            best = near.argmax(axis=1)
            own = np.where(near[np.arange(len(x)), best] >= self.leaf_at, best, -1)
        # The others found entries around the first of them.
        rest = np.nonzero(own < 0)[0]
        among, open_, used = x[rest] @ x[rest].T >= self.leaf_at, np.ones(len(rest), dtype=bool), len(self.counts[node])
        for i in range(len(rest)):
            if open_[i]:
                mine = among[i] & open_
                mine[i] = True
                open_ &= ~mine
                own[rest[mine]] = used
                used += 1
        more = used - len(self.counts[node])
        self.sums[node] = np.concatenate([self.sums[node], np.zeros((more, self.dimensions))])
        self.counts[node] = np.concatenate([self.counts[node], np.zeros(more)])
        self.below[node] += range(self.entries, self.entries + more)
        self.entries += more
        np.add.at(self.sums[node], own, x)
        np.add.at(self.counts[node], own, 1)
        return np.array(self.below[node])[own]

    def _split(self, node: int) -> None:
        """Cuts a node that is too full between the two entries farthest apart, and its parents as they fill up."""
        if len(self.counts[node]) <= self.branching:
            return
        mean = self.sums[node] / self.counts[node][:, None]
        mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        cos = mean @ mean.T
        i, j = np.unravel_index(cos.argmin(), cos.shape)
        if i == j:
            i, j = 0, 1
        moves = cos[j] > cos[i]
        moves[i], moves[j] = False, True
        new = len(self.below)
        for items in (self.sums, self.counts):
            items.append(items[node][moves])
            items[node] = items[node][~moves]
        kept, moved = [b for b, m in zip(self.below[node], moves) if not m], [b for b, m in zip(self.below[node], moves) if m]
        self.below[node] = kept
        self.below.append(moved)
        self.inner.append(self.inner[node])
        if self.inner[node]:
            for b in moved:
                self.parent[b] = new
        up = self.parent[node]
        self.parent.append(up)
        if up < 0:
            up = self.root = len(self.below)
            self.below.append([node])
            self.inner.append(True)
            self.parent.append(-1)
            self.parent[node] = self.parent[new] = up
            self.sums.append(self.sums[node].sum(axis=0, keepdims=True))
            self.counts.append(self.counts[node].sum(keepdims=True))
        else:
            slot = self.below[up].index(node)
            self.sums[up][slot], self.counts[up][slot] = self.sums[node].sum(axis=0), self.counts[node].sum()
        self.below[up].append(new)
        self.sums[up] = np.concatenate([self.sums[up], self.sums[new].sum(axis=0, keepdims=True)])
        self.counts[up] = np.concatenate([self.counts[up], self.counts[new].sum(keepdims=True)])
        self._split(node)
        self._split(new)
        self._split(up)


def feature_leaves(x: np.ndarray, leaf_at: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree's leaf entry of each unit row, and the entries' sums and counts.

    A row enters the entry that it reaches if their mean cosine is ``leaf_at`` at least, or founds one.
    """
    tree = FeatureTree(x.shape[1], leaf_at)
    leaf = np.concatenate([tree.insert(x[b : b + BATCH].astype(np.float64)) for b in range(0, len(x), BATCH)])
    sums, counts = np.zeros((tree.entries, x.shape[1])), np.bincount(leaf, minlength=tree.entries)
    np.add.at(sums, leaf, x)
    return leaf, sums.astype(np.float32), counts


def ward(sums: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The head of each feature after agglomeration, pairs that are linked, and pairs in doubt.

    The pair with the smallest growth of the squared error merges first, as long
    as the mean cosine between what has grown is ``threshold`` at least; a
    feature that merges with none is its own head. Linked are pairs of features
    whose own mean reaches the threshold though their heads differ. In doubt are
    pairs whose mean falls short, but by no more than WIDE deviations of the
    cosine between their members.
    """
    n = len(counts)
    mean = sums.astype(np.float64) / counts[:, None]
    cos = mean @ mean.T
    np.fill_diagonal(cos, -1)
    spread = np.where(counts > 1, np.maximum(1 - (mean * mean).sum(axis=1), 0), 0)
    a, b = np.nonzero(np.triu(cos + WIDE * np.sqrt((spread[:, None] + spread[None, :]) / sums.shape[1]) >= threshold, 1))
    sure = cos[a, b] >= threshold
    head = np.arange(n)

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    s, m, age = sums.astype(np.float64).copy(), counts.astype(np.float64).copy(), np.zeros(n, dtype=np.int64)

    def cost(p: int, q: int) -> float:
        gap = s[p] / m[p] - s[q] / m[q]
        return m[p] * m[q] / (m[p] + m[q]) * float(gap @ gap)

    gap = np.maximum((mean * mean).sum(axis=1)[a[sure]] + (mean * mean).sum(axis=1)[b[sure]] - 2 * cos[a[sure], b[sure]], 0)
    first = counts[a[sure]] * counts[b[sure]] / (counts[a[sure]] + counts[b[sure]]) * gap
    heap = [(c, int(i), int(j), 0, 0) for c, i, j in zip(first, a[sure], b[sure])]
    heapq.heapify(heap)
    while heap:
        _, i, j, was_i, was_j = heapq.heappop(heap)
        p, q = find(i), find(j)
        if p == q:
            continue
        if (p, q, age[p], age[q]) != (i, j, was_i, was_j):
            # One of the two has grown: its cost is another now.
            if s[p] @ s[q] >= threshold * m[p] * m[q]:
                heapq.heappush(heap, (cost(p, q), p, q, age[p], age[q]))
            continue
        p, q = min(p, q), max(p, q)
        head[q] = p
        s[p] += s[q]
        m[p] += m[q]
        age[p] += 1
    head = np.array([find(i) for i in range(n)], dtype=np.int64)
    pairs, apart = np.stack([a, b], axis=1), head[a] != head[b]
    return head, pairs[sure & apart], pairs[~sure & apart]


def leaves_of(embeddings: DataFrame, threshold: float, staging: Staging, seed: int) -> tuple[DataFrame, Pivots]:
    """Rows (revision, id, face_crop_id, cell, leaf, n, length, v, x): one a vector, packed in x; n, length and v (the packed sum) on the first of each leaf."""
    spark = embeddings.sparkSession
    leaf_at = threshold + TIGHT * (1 - threshold)
    vectors = valid_vectors(embeddings, "face_crop_id")
    pivots = Pivots.sample(vectors, PER_CELL, seed)
    shared = spark.sparkContext.broadcast(pivots)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for key, rows in by_revision(frame):
                x, ok = unit_rows(decode(list(rows["vector_blob"]), key[2]))
                if ok.any():
                    ids = rows["id"].to_numpy()[ok]
                    yield pd.DataFrame({"model_id": key[0], "model_hash": key[1], "dimensions": key[2], "id": ids, "face_crop_id": rows["face_crop_id"].to_numpy()[ok], "cell": own.split(key, own.nearest(key, x[ok], 1)[:, 0], ids), "v": pack(x[ok])})

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").sort_values("id")
        leaf, sums, counts = feature_leaves(unpack(list(rows["v"])), leaf_at)
        first = np.unique(leaf, return_index=True)[1]
        n, v, length = np.full(len(rows), None, dtype=object), np.full(len(rows), None, dtype=object), np.full(len(rows), np.nan)
        blobs = pack(sums)
        n[first], length[first] = counts, np.linalg.norm(sums, axis=1)
        for i, blob in zip(first, blobs):
            v[i] = blob
        base = shared.value.number(key[:3]) << 52 | int(key[3]) << 24
        return pd.DataFrame({"model_id": key[0], "model_hash": key[1], "dimensions": key[2], "id": rows["id"].to_numpy(), "face_crop_id": rows["face_crop_id"].to_numpy(), "cell": key[3], "leaf": base + leaf, "n": pd.array(n, dtype="Int64"), "length": length, "v": v, "x": rows["v"].to_numpy()})

    routed = vectors.mapInPandas(route, f"{_KEYS}, id long, face_crop_id string, cell long, v binary")
    built = routed.groupBy(*_REVISION, "cell").applyInPandas(build, f"{_KEYS}, id long, face_crop_id string, cell long, leaf long, n long, length double, v binary, x binary")
    return staging.save(built), pivots


#: What ``merge_features`` says of a pair: Ward has merged it, its mean proves a link, or its members must be compared.
MERGED, LINKED, DOUBTFUL = 0, 1, 2


def merge_features(features: DataFrame, name: str, threshold: float, pivots: Pivots) -> DataFrame:
    """(a, b, kind) of the features (revision, ``name``, n, length, v) that meet in the cells of ``pivots``."""
    shared = features.sparkSession.sparkContext.broadcast(pivots)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for key, rows in by_revision(frame):
                yield rows.assign(cells=list(own.nearest(key, unpack(list(rows["v"])), CELLS)))

    def merge(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(name)
        number = rows[name].to_numpy()
        head, linked, doubtful = ward(unpack(list(rows["v"])) * rows["length"].to_numpy(np.float32)[:, None], rows["n"].to_numpy(), threshold)
        moved = np.nonzero(head != np.arange(len(head)))[0]
        pairs = np.concatenate([np.stack([head[moved], moved], axis=1), linked, doubtful])
        return pd.DataFrame({"a": number[pairs[:, 0]], "b": number[pairs[:, 1]], "kind": np.repeat([MERGED, LINKED, DOUBTFUL], [len(moved), len(linked), len(doubtful)])})

    routed = features.select(*_REVISION, name, "n", "length", "v").mapInPandas(route, f"{_KEYS}, {name} long, n long, length double, v binary, cells array<long>")
    return routed.select(*_REVISION, name, "n", "length", "v", F.explode("cells").alias("cell")).groupBy(*_REVISION, "cell").applyInPandas(merge, "a long, b long, kind int")


def linked_by_members(pairs: DataFrame, leaves: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of leaves of which some two vectors have a cosine of ``threshold`` at least.

    A leaf holds no more vectors than the cell that built it.
    """
    wanted = pairs.select(F.col("a").alias("leaf")).union(pairs.select(F.col("b").alias("leaf"))).distinct()
    members = leaves.select("leaf", "x").join(wanted, "leaf", "left_semi").groupBy("leaf").agg(F.collect_list("x").alias("x"))
    both = lookup(pairs.withColumnRenamed("a", "leaf"), members.withColumnRenamed("x", "xa"), "leaf", hot=[]).withColumnRenamed("leaf", "a")
    both = lookup(both.withColumnRenamed("b", "leaf"), members.withColumnRenamed("x", "xb"), "leaf", hot=[]).withColumnRenamed("leaf", "b")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [bool((unpack(list(xa)) @ unpack(list(xb)).T).max() >= threshold) for xa, xb in zip(frame["xa"], frame["xb"])]
            yield frame.loc[keep, ["a", "b"]]

    return both.select("a", "b", "xa", "xb").mapInPandas(compare, "a long, b long")


def cluster_features(leaves: DataFrame) -> DataFrame:
    """(revision, label, n, length, v): the features of leaves (revision, label, n, length, v), added up by label.

    Batches are added up before the shuffle, so a label of very many leaves moves few rows.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, rows in by_revision(frame):
                label, at = np.unique(rows["label"].to_numpy(), return_inverse=True)
                sums = np.zeros((len(label), key[2]))
                np.add.at(sums, at, unpack(list(rows["v"])) * rows["length"].to_numpy()[:, None])
                n = np.zeros(len(label), dtype=np.int64)
                np.add.at(n, at, rows["n"].to_numpy(np.int64))
                yield pd.DataFrame({"model_id": key[0], "model_hash": key[1], "dimensions": key[2], "label": label, "n": n, "length": np.linalg.norm(sums, axis=1), "v": pack(sums)})

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted, so only the last label of a batch may go on in the next one.
        last = None
        for frame in frames:
            if len(frame):
                added = pd.concat(add(iter([frame if last is None else pd.concat([last, frame])])), ignore_index=True)
                yield added[:-1]
                last = added[-1:]
        if last is not None:
            yield last

    schema = f"{_KEYS}, label long, n long, length double, v binary"
    parts = leaves.select(*_REVISION, "label", "n", "length", "v").mapInPandas(add, schema)
    return parts.repartition(*_REVISION, "label").sortWithinPartitions(*_REVISION, "label").mapInPandas(total, schema)


def assign(leaves: DataFrame, features: DataFrame, threshold: float, pivots: Pivots) -> DataFrame:
    """Links (leaf, label) of every vector of ``leaves`` with the clusters (revision, label, n, length, v) that it is near to on average.

    A cluster enters the cells of the CELLS pivots nearest to its centroid, in
    every copy of them, as vectors are spread over the copies.
    """
    shared = leaves.sparkSession.sparkContext.broadcast(pivots)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: dict[tuple, tuple] = {}
        for frame in frames:
            for key, rows in by_revision(frame):
                if key not in kinds:
                    own, kind = np.unique(shared.value.by[key], axis=0, return_inverse=True)
                    kinds[key] = Pivots({key: own}), np.split(np.argsort(kind.ravel(), kind="stable"), np.cumsum(np.bincount(kind.ravel()))[:-1])
                own, copies = kinds[key]
                yield rows.assign(cells=[np.concatenate([copies[k] for k in near]) for near in own.nearest(key, unpack(list(rows["v"])), CELLS)])

    def meet(_: tuple, rows: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), dtype=np.int64)]
        if len(rows) and len(clusters):
            mean = unpack(list(clusters["v"])) * (clusters["length"] / clusters["n"]).to_numpy(np.float32)[:, None]
            leaf, label = rows["leaf"].to_numpy(), clusters["label"].to_numpy()
            for b in range(0, len(rows), 4096):
                i, j = np.nonzero(unpack(list(rows["x"][b : b + 4096])) @ mean.T >= threshold)
                out.append(np.unique(np.stack([leaf[b + i], label[j]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"leaf": pairs[:, 0], "label": pairs[:, 1]})

    routed = features.mapInPandas(route, f"{_KEYS}, label long, n long, length double, v binary, cells array<long>")
    entered = routed.select(*_REVISION, "label", "n", "length", "v", F.explode("cells").alias("cell"))
    vectors = leaves.select(*_REVISION, "cell", "leaf", "x")
    return vectors.groupBy(*_REVISION, "cell").cogroup(entered.groupBy(*_REVISION, "cell")).applyInPandas(meet, "leaf long, label long")


def with_label(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with the label of ``key`` by ``labels`` (v, label); what has none there is its own label."""
    named = lookup(rows.withColumn("k", F.col(key)).drop("label"), labels.withColumnRenamed("v", "k"), "k", "left")
    return named.withColumn("label", F.coalesce("label", "k")).drop("k")


def _clusters(embeddings: DataFrame, crops: DataFrame, threshold: float, least: int, staging: Staging, seed: int) -> tuple[DataFrame, DataFrame]:
    """The members that ``similarity_clusters`` gives, with label, part and size, and the leaves of all vectors."""
    leaves, pivots = leaves_of(embeddings, threshold, staging, seed)
    vectors = valid_vectors(embeddings)
    summaries = leaves.filter("n is not null")
    met = staging.save(merge_features(summaries, "leaf", threshold, Pivots.sample(vectors, PER_CELL, seed + 1)).distinct())
    faces = crops.select(guid("crop_id").alias("face_crop_id"), guid("face_occurrence_id").alias("face_occurrence_id")).dropna().distinct()
    members = leaves.select(*_REVISION, "id", "cell", "leaf", guid("face_crop_id").alias("face_crop_id")).join(faces, "face_crop_id")
    members = staging.save(members.drop("face_crop_id"))
    # Ward's clusters, and their features.
    parts = components(met.filter(F.col("kind") == MERGED), staging)
    features = staging.save(cluster_features(with_label(summaries, parts, "leaf")))
    # A single vector's neighbours are the leaves' business.
    large = features.filter("n > 1")
    reduced = merge_features(large, "label", threshold, Pivots.sample(vectors, PER_CELL * LEVEL, seed + 2)).filter(F.col("kind") != DOUBTFUL).select("a", "b")
    # Written first, as a lookup counts its left side.
    near = staging.save(assign(leaves, large, threshold, pivots).withColumnRenamed("label", "b").distinct())
    assigned = with_label(near, parts, "leaf").select(F.col("label").alias("a"), "b")
    # Leaves that share a face: each is linked with the smallest of them.
    pairs = members.select("model_id", "model_hash", "face_occurrence_id", "leaf").distinct()
    smallest = pairs.groupBy("model_id", "model_hash", "face_occurrence_id").agg(F.min("leaf").alias("a"), F.count(F.lit(1)).alias("leaves")).filter("leaves > 1").drop("leaves")
    shared = pairs.join(smallest, ["model_id", "model_hash", "face_occurrence_id"]).filter("leaf <> a").select("a", F.col("leaf").alias("b"))
    of_parts = lambda df: with_label(with_label(df, parts, "a").drop("a").withColumnRenamed("label", "a"), parts, "b").select("a", F.col("label").alias("b"))
    links = of_parts(met.filter(F.col("kind") == LINKED).select("a", "b").unionByName(shared)).unionByName(reduced).unionByName(assigned).filter("a <> b").distinct()
    joined = staging.save(components(links, staging))
    both = lambda df, key: with_label(with_label(df, parts, key).withColumnRenamed("label", "part"), joined, "part")
    # Only pairs in doubt that nothing has joined yet are compared by their members.
    doubt = both(both(met.filter(F.col("kind") == DOUBTFUL).select("a", "b"), "a").drop("part").withColumnRenamed("label", "la"), "b").filter("la <> label").select("a", "b", "la", F.col("label").alias("lb"))
    doubt = staging.save(doubt)
    proven = staging.save(linked_by_members(doubt.select("a", "b").distinct(), leaves, threshold).join(doubt, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    labelled = both(members, "leaf")
    if proven.limit(1).count():
        labelled = with_label(labelled.withColumnRenamed("label", "first"), components(proven, staging), "first").drop("first")
    labelled = staging.save(labelled)
    # A cluster's faces are counted from distinct pairs, combined before the shuffle.
    sizes = labelled.select("label", "face_occurrence_id").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("face_occurrence_id").alias("cluster_face_id")).filter(F.col("size") >= least)
    return lookup(labelled, sizes, "label"), leaves


def similarity_clusters(embeddings: DataFrame, crops: DataFrame, threshold: float, least: int, staging: Staging, seed: int = 11) -> DataFrame:
    """(model_id, model_hash, cluster_face_id, face_occurrence_id, id, cell, leaf, part) of the vectors of clusters of ``least`` faces or more.

    Two faces of a revision belong together if vectors of theirs have a cosine
    of ``threshold`` at least, directly or through others, or if one face has
    vectors in both; every link found is proven by a pair or by a mean. part is
    the Ward cluster that a vector is in: links may join several. A cluster is named by its smallest face. Vectors
    that aren't valid, ids delivered twice, and vectors without a crop or a crop
    without a face don't count; exact copies are spread over the cells of their
    pivots' copies. Empty tables give an empty result.
    """
    return _clusters(embeddings, crops, threshold, least, staging, seed)[0]


def typical_faces(embeddings: DataFrame, crops: DataFrame, threshold: float, least: int, most: int, staging: Staging, seed: int = 11) -> DataFrame:
    """(model_id, model_hash, cluster_face_id, size, parts, typical_faces) of every cluster of ``similarity_clusters``.

    size counts the faces, and parts the Ward clusters that links have joined; typical_faces are the ``most`` of them nearest to the
    centroid, nearest first and ties by id, a face counting with its nearest
    vector. The centroid is the mean of all unit vectors in the cluster's leaves.
    """
    members, leaves = _clusters(embeddings, crops, threshold, least, staging, seed)
    members = staging.save(members)
    # One face may join vectors of different dimensions, which have a centroid each.
    parts = members.select("label", "part").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("parts"))
    part = F.concat_ws("-", "label", "dimensions").alias("part")
    summaries = lookup(leaves.filter("n is not null").drop("x"), members.select("leaf", "label").distinct(), "leaf")
    centroids = cluster_features(summaries).select(part, F.col("v").alias("c"))
    named = members.select("id", "leaf", "label", "size", "cluster_face_id", "face_occurrence_id").distinct()
    vectors = leaves.select(*_REVISION, "id", "leaf", "x").join(named, ["id", "leaf"])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, rows in by_revision(frame):
                near = (unpack(list(rows["x"])).astype(np.float64) * unpack(list(rows["c"]))).sum(axis=1)
                yield rows[["model_id", "model_hash", "label", "size", "cluster_face_id", "face_occurrence_id"]].assign(near=near)

    scored = lookup(vectors.select("*", part), centroids, "part").select(*_REVISION, "label", "size", "cluster_face_id", "face_occurrence_id", "x", "c")
    scored = scored.mapInPandas(score, "model_id string, model_hash string, label long, size long, cluster_face_id string, face_occurrence_id string, near double")
    cluster = ["model_id", "model_hash", "label", "size", "cluster_face_id"]
    faces = scored.groupBy(*cluster, "face_occurrence_id").agg(F.max("near").alias("near"))
    # The limit on the rank is applied before the shuffle as well, so a large cluster moves few rows.
    ranked = faces.withColumn("rank", F.row_number().over(Window.partitionBy(*cluster).orderBy(F.desc("near"), "face_occurrence_id"))).filter(F.col("rank") <= most)
    typical = F.transform(F.sort_array(F.collect_list(F.struct("rank", "face_occurrence_id"))), lambda r: r["face_occurrence_id"])
    described = ranked.groupBy(*cluster).agg(typical.alias("typical_faces")).join(parts, "label")
    return described.select("model_id", "model_hash", "cluster_face_id", "size", "parts", "typical_faces")
