"""Filling containers of fixed capacity with documents, by a grouping genetic algorithm on islands.

Documents are hashed into blocks. The first packing of a block is best-fit
decreasing; where that takes no more containers than the block's total needs
there is nothing to improve and the block is done. ISLANDS islands evolve
packings of every other block from different seeds and pass their best packing on to the next island of the
block after every epoch. Crossover injects whole, well filled containers of one
parent into the other, removes those that hold a document twice, and puts the
displaced documents back by best fit. The containers that a block couldn't fill
go into further rounds over fewer blocks, so that the space lost doesn't grow
with the number of blocks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.plans.staging import Staging

#: Documents of a block, islands of a block, epochs between migrations, and generations of an epoch.
BLOCK, ISLANDS, EPOCHS, GENERATIONS = 4_000, 4, 4, 30
#: Packings of an island.
POPULATION = 10
#: A container that is filled less than this goes into the next round.
FULL = 0.995
#: Rounds over ever fewer blocks.
ROUNDS = 3


class Packing:
    """Which container each document is in, and how full the containers are."""

    def __init__(self, where: np.ndarray, fill: np.ndarray):
        self.where, self.fill = where, fill

    def score(self, capacity: int) -> tuple[int, float]:
        """Fewer containers first, then fuller ones."""
        used = self.fill > 0
        return -int(used.sum()), float(((self.fill[used] / capacity) ** 2).mean()) if used.any() else 0.0


def best_fit(items: np.ndarray, sizes: np.ndarray, where: np.ndarray, fill: list[int], capacity: int) -> Packing:
    """Puts ``items``, in their order, where the least space stays free; opens containers where none has room."""
    room = sorted((capacity - f, b) for b, f in enumerate(fill))
    for i in items:
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
            fill[b] += s
        else:
            left, b = capacity, len(fill)
            fill.append(s)
        where[i] = b
        insort(room, (left - s, b))
    return Packing(where, np.array(fill))


def packed(sizes: np.ndarray, capacity: int, order: np.ndarray) -> Packing:
    return best_fit(order, sizes, np.full(len(sizes), -1), [], capacity)


def crossover(giver: Packing, taker: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """The taker's packing with a random part of the giver's best filled containers injected whole."""
    full = np.argsort(-giver.fill, kind="stable")
    full = full[giver.fill[full] > 0]
    chosen = full[: max(1, len(full) // 2)]
    chosen = chosen[rng.random(len(chosen)) < 0.5]
    injected = np.isin(giver.where, chosen)
    hit = np.zeros(len(taker.fill), dtype=bool)
    hit[taker.where[injected]] = True
    # A few of the taker's worst containers are dissolved as well: the mutation.
    used = np.nonzero(taker.fill > 0)[0]
    hit[used[np.argsort(taker.fill[used], kind="stable")[:2]]] = True
    kept = ~injected & ~hit[taker.where]
    where = np.full(len(sizes), -1)
    names, where_kept = np.unique(taker.where[kept], return_inverse=True)
    where[kept] = where_kept
    given, where_given = np.unique(giver.where[injected], return_inverse=True)
    where[injected] = where_given + len(names)
    fill = np.bincount(where[where >= 0], weights=sizes[where >= 0], minlength=len(names) + len(given)).astype(np.int64).tolist()
    loose = np.nonzero(where < 0)[0]
    return best_fit(loose[np.argsort(-sizes[loose], kind="stable")], sizes, where, fill, capacity)


def evolve(sizes: np.ndarray, capacity: int, rng: np.random.Generator, generations: int, start: list[Packing]) -> Packing:
    """The best packing of an island after ``generations``; ends early where no packing can have fewer containers."""
    least = -(-int(sizes.sum()) // capacity)
    down = np.argsort(-sizes, kind="stable")
    island = list(start) or [packed(sizes, capacity, down)]
    best = max(island, key=lambda p: p.score(capacity))
    while len(island) < POPULATION and -best.score(capacity)[0] > least:
        # Sizes shaken by some percent before they are sorted give other good packings.
        island.append(packed(sizes, capacity, np.argsort(-sizes * (1 + 0.15 * rng.random(len(sizes))), kind="stable")))
        best = max(island, key=lambda p: p.score(capacity))
    for _ in range(generations):
        if -best.score(capacity)[0] <= least:
            break
        a, b = rng.choice(len(island), 2, replace=False)
        if island[a].score(capacity) < island[b].score(capacity):
            a, b = b, a
        child = crossover(island[a], island[b], sizes, capacity, rng)
        worst = min(range(len(island)), key=lambda i: island[i].score(capacity))
        if child.score(capacity) > island[worst].score(capacity):
            island[worst] = child
        best = max(island, key=lambda p: p.score(capacity))
    return best


def _round(items: DataFrame, blocks: int, capacity: int, number: int, staging: Staging, seed: int) -> DataFrame:
    """(key, part, size, block, bin, fill): one round of packing over ``blocks`` blocks."""
    schema = "key long, part long, size long, block long, island int, own long, guest long, fill long, bins long, least long, evenness double"

    def row(rows: pd.DataFrame, sizes: np.ndarray, best: Packing) -> pd.DataFrame:
        bins, evenness = best.score(capacity)
        out = rows.assign(own=best.where, guest=pd.array([None] * len(rows), dtype="Int64"), fill=best.fill[best.where], bins=-bins, least=-(-int(sizes.sum()) // capacity), evenness=evenness)
        return out[["key", "part", "size", "block", "island", "own", "guest", "fill", "bins", "least", "evenness"]]

    def plain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "part"], ignore_index=True)
        sizes = rows["size"].to_numpy(dtype=np.int64)
        return row(rows.assign(island=0), sizes, packed(sizes, capacity, np.argsort(-sizes, kind="stable")))

    def task(epoch: int):  # noqa: ANN202
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["key", "part"], ignore_index=True)
            sizes = rows["size"].to_numpy(dtype=np.int64)
            rng = np.random.default_rng([seed, number, epoch, int(rows["block"][0]), int(rows["island"][0])])
            start = []
            for c in ("own", "guest"):
                if rows[c].notna().all():
                    where = rows[c].to_numpy(dtype=np.int64)
                    start.append(Packing(where, np.bincount(where, weights=sizes).astype(np.int64)))
            return row(rows, sizes, evolve(sizes, capacity, rng, GENERATIONS, start))

        return run

    blocked = items.withColumn("block", F.pmod(F.xxhash64("key", "part", F.lit(number)), F.lit(blocks)))
    first, seen = staging.observed(blocked.groupBy("block").applyInPandas(plain, schema), open=F.count_if(F.col("bins") > F.col("least")))
    columns = ["key", "part", "size", "block", F.col("own").alias("bin"), "fill"]
    settled, open_ = first, seen["open"]
    parts = []
    if open_:
        settled = first.filter("bins <= least")
        state = first.filter("bins > least").select("key", "part", "size", "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "own", "guest")
        for epoch in range(EPOCHS):
            done, seen = staging.observed(state.groupBy("block", "island").applyInPandas(task(epoch), schema), open=F.count_if(F.col("bins") > F.col("least")))
            if epoch == EPOCHS - 1 or not seen["open"]:
                break
            # Elites migrate: each island meets the best packing of the island before it.
            guests = done.select("key", "part", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("own").alias("guest"))
            state = done.select("key", "part", "size", "block", "island", "own").join(guests, ["key", "part", "island"])
        ranks = done.groupBy("block").agg(F.min_by("island", F.struct("bins", -F.col("evenness"), "island")).alias("island"))
        parts.append(done.join(ranks, ["block", "island"]).select(*columns))
    out = settled.select(*columns)
    for p in parts:
        out = out.unionByName(p)
    return out


def pack_documents(sizes: DataFrame, key: str, size: str, capacity: int, staging: Staging, seed: int = 5) -> DataFrame:
    """(key, part, size, container) of every document.

    A document larger than ``capacity`` is cut into full containers and a rest,
    numbered by ``part``; no other is split. Documents of size 0 take no space
    and have a null container, as have those whose size is null. A key is
    expected once. An empty table gives an empty result.
    """
    rows = sizes.select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("size")).filter("key is not null")
    empty = rows.filter("size is null or size <= 0").select("key", F.lit(0).cast("long").alias("part"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.lit(None).cast("string").alias("container"))
    parts = rows.filter("size > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity))))
    parts, seen = staging.observed(parts.select("key", "part", F.least(F.col("size") - F.col("part") * capacity, F.lit(capacity)).cast("long").alias("size")), items=F.count_if(F.col("size") - F.col("part") * capacity < capacity))
    whole = parts.filter(F.col("size") == capacity).select("key", "part", "size", F.concat_ws("-", F.lit("w"), "key", "part").alias("container"))
    items, out, n = parts.filter(F.col("size") < capacity), [empty, whole], seen["items"]
    for number in range(ROUNDS):
        if not n:
            break
        blocks = -(-n // BLOCK)
        placed, seen = staging.observed(_round(items, blocks, capacity, number, staging, seed), loose=F.count_if(F.col("fill") < FULL * capacity))
        last = number == ROUNDS - 1 or blocks == 1
        settled = placed if last else placed.filter(F.col("fill") >= FULL * capacity)
        out.append(settled.select("key", "part", "size", F.concat_ws("-", F.lit(f"r{number}"), "block", "bin").alias("container")))
        if last:
            break
        items, n = placed.filter(F.col("fill") < FULL * capacity).select("key", "part", "size"), seen["loose"]
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result.withColumnRenamed("key", key)


def packing_summary(sizes: DataFrame, key: str, size: str, capacity: int, staging: Staging) -> DataFrame:
    """(documents, parts, containers, best_fit, least, empty): containers used, those of best-fit decreasing without islands or further rounds, the fewest possible, and the part of the space that stays empty."""
    packed_ = staging.save(pack_documents(sizes, key, size, capacity, staging)).filter("container is not null")
    fills = packed_.groupBy("container").agg(F.sum("size").alias("fill"))
    used = fills.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("fill") / capacity).cast("long").alias("least"), F.round(1 - F.sum("fill") / (F.count(F.lit(1)) * capacity), 6).alias("empty"))
    items, n = staging.observed(packed_.filter(F.col("size") < capacity).select("size", F.col(key).alias("key"), "part"))
    blocks = max(1, -(-n["rows"] // BLOCK))

    def plain(rows: pd.DataFrame) -> pd.DataFrame:
        s = rows["size"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"bins": [int((packed(s, capacity, np.argsort(-s, kind="stable")).fill > 0).sum())]})

    alone = items.withColumn("block", F.pmod(F.xxhash64("key", "part", F.lit(0)), F.lit(blocks))).groupBy("block").applyInPandas(plain, "bins long").agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("bins"))
    counts = packed_.agg(F.count_distinct(key).alias("documents"), F.count(F.lit(1)).alias("parts"), F.count_if(F.col("size") == capacity).alias("whole"))
    # Single rows side by side.
    return counts.join(F.broadcast(used), F.lit(True)).join(F.broadcast(alone), F.lit(True)).select("documents", "parts", "containers", (F.col("whole") + F.col("bins")).alias("best_fit"), "least", "empty")
