"""Train, validation and test splits that keep linked records together.

Records that share a person or a photo, directly or through others, form a
group (parallel hooking and shortcutting); subset sums over the multiplicities
of the group sizes choose the groups of each split.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.guid import guid
from darkroom.operators.components import components
from darkroom.operators.skew import lookup
from darkroom.plans.staging import Staging

#: Bits of a subset-sum table; larger totals are counted in units of total / MOST_BITS records.
MOST_BITS = 1 << 19
#: Parts into which the groups of one size are ranked.
PARTS = 64


def linked_groups(records: DataFrame, person: str, photo: str, staging: Staging) -> DataFrame:
    """(person, photo, label): each photo with one of its persons and the smallest person linked with it."""
    return linked_labels(records, person, photo, staging)[0]


def linked_labels(records: DataFrame, person: str, photo: str, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """((person, photo, label), (v, label)): each photo with one of its persons and the smallest person linked with it, and persons that share photos.

    GUIDs compare by value; rows without a person or a photo link nothing.
    Only persons take part in the search for components: each photo is replaced
    by links from its smallest person to its others, and photos of one person,
    the bulk of them, only look up that person's label in the end. A person with
    a third of all rows is met by a map-side minimum and a broadcast row.
    """
    pairs = staging.save(records.select(guid(person).alias("person"), guid(photo).alias("photo")).dropna().distinct())
    photos = staging.save(pairs.groupBy("photo").agg(F.min("person").alias("first"), F.count(F.lit(1)).alias("persons")))
    several = photos.filter("persons > 1")
    links = lookup(pairs, several, "photo").filter("person <> first").select(F.col("first").alias("a"), F.col("person").alias("b")).distinct()
    labels = components(links, staging)
    own = photos.select("photo", F.col("first").alias("v"))
    return lookup(own, labels, "v", "left").select(F.col("v").alias("person"), "photo", F.coalesce("label", "v").alias("label")), labels


def photo_groups(records: DataFrame, person: str, photo: str, least: int, staging: Staging) -> DataFrame:
    """(label, photo) of the groups with ``least`` photos or more."""
    groups = staging.save(linked_groups(records, person, photo, staging).select("label", "photo"))
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("label")
    return lookup(groups, sizes, "label")


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to ``target`` as can be.

    Of two totals equally close the smaller is taken. A bitset holds the totals
    that can be reached; multiplicities are cut into powers of two.
    """
    unit = max(1, -(-target // MOST_BITS))
    goal = target // unit
    limit = 2 * goal + 1
    mask = (1 << (limit + 1)) - 1
    items = []
    for size in sorted(sizes, reverse=True):
        left, power = sizes[size], 1
        while left:
            take = min(power, left)
            items.append((size, take))
            left -= take
            power *= 2
    kept = [(size, take, w) for size, take in items if (w := round(size * take / unit)) <= limit]
    # Only every stride-th bitset is kept; those between are made again on the way back.
    stride = isqrt(len(kept)) + 1
    reach, marks = 1, []
    for n, (_, _, w) in enumerate(kept):
        if n % stride == 0:
            marks.append(reach)
        reach |= (reach << w) & mask
    total = next(t for d in range(goal + 1) for t in (goal - d, goal + d) if t >= 0 and reach >> t & 1)
    chosen: dict[int, int] = {}
    for m in range(len(marks) - 1, -1, -1):
        part, before = kept[m * stride : (m + 1) * stride], [marks[m]]
        for _, _, w in part[:-1]:
            before.append(before[-1] | (before[-1] << w) & mask)
        for (size, take, w), old in zip(reversed(part), reversed(before)):
            if old >> total & 1:
                continue
            chosen[size] = chosen.get(size, 0) + take
            total -= w
    return chosen


def assign_splits(records: DataFrame, shares: DataFrame, key: str, person: str, photo: str, staging: Staging) -> DataFrame:
    """(key, split_name) of every record, in about the given shares, where linked records share a split.

    ``shares`` has split_name and share; the largest share takes what the others
    leave. A record is a distinct ``key``; rows without one are ignored. A
    record without a person belongs to the group of its photo, and one without
    either is a group of its own. A group larger than a share's target can't go
    there, so shares are met as closely as the groups allow.
    """
    rows = records.select(F.col(key).alias("key"), guid(photo).alias("photo"), guid(person).alias("person")).filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("photo").alias("photo"), F.min("person").alias("person"))
    groups, of_person = linked_labels(records, person, photo, staging)
    rows = staging.save(rows)
    by_photo = lookup(rows.filter("photo is not null"), groups.select("photo", "label"), "photo", "left").select("key", F.coalesce("label", F.concat(F.lit("photo "), "photo")).alias("label"))
    by_person = lookup(rows.filter("photo is null and person is not null"), of_person.withColumnRenamed("v", "person"), "person", "left").select("key", F.coalesce("label", "person").alias("label"))
    alone = rows.filter("photo is null and person is null").select("key", F.concat(F.lit("row "), F.col("key").cast("string")).alias("label"))
    labelled = by_photo.unionByName(by_person).unionByName(alone)
    labelled = staging.save(labelled)
    sizes = staging.save(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumn("part", F.pmod(F.xxhash64("label"), F.lit(PARTS)).cast("int")))
    # Sizes differ in at most sqrt(2 x records) ways, so this table is small.
    counts = sizes.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("size", "part").collect()
    left: dict[int, int] = {}
    for r in counts:
        left[r["size"]] = left.get(r["size"], 0) + r["n"]
    total = sum(s * n for s, n in left.items())
    wanted = sorted(((float(r["share"]), r["split_name"]) for r in shares.select("split_name", "share").distinct().collect()), key=lambda x: (x[0], x[1]))
    if not wanted:
        raise ValueError("no shares")
    whole = sum(s for s, _ in wanted)
    ranges: list[tuple[int, int, int, str]] = []
    start = dict.fromkeys(left, 0)
    for share, name in wanted[:-1]:
        for size, n in closest_subset(left, round(total * share / whole)).items():
            ranges.append((size, start[size], start[size] + n, name))
            start[size] += n
            left[size] -= n
    for size, n in left.items():
        ranges.append((size, start[size], start[size] + n, wanted[-1][1]))
    offsets, seen = [], dict.fromkeys(left, 0)
    for r in counts:
        offsets.append((r["size"], r["part"], seen[r["size"]]))
        seen[r["size"]] += r["n"]
    spark = records.sparkSession
    before = F.broadcast(spark.createDataFrame(offsets, "size long, part int, before long"))
    of = F.broadcast(spark.createDataFrame(ranges, "size long, low long, high long, split_name string"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy("size", "part").orderBy(F.xxhash64("label"), "label")) - 1)
    placed = ranked.join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.col("r")).join(of, "size").filter("rank >= low and rank < high")
    return lookup(labelled, placed.select("label", "split_name"), "label").select(F.col("key").alias(key), "split_name")


def reached_shares(splits: DataFrame, shares: DataFrame) -> DataFrame:
    """(split_name, records, share, wanted): what ``assign_splits`` gave each split beside what was asked."""
    counts = splits.groupBy("split_name").agg(F.count(F.lit(1)).alias("records"))
    total = counts.agg(F.sum("records").alias("total"))
    asked = shares.select("split_name", F.col("share").cast("double").alias("wanted")).distinct()
    # A row for each split, beside a single one.
    joined = asked.join(counts, "split_name", "left").join(F.broadcast(total), F.lit(True), "left")
    return joined.select("split_name", F.coalesce("records", F.lit(0)).alias("records"), F.round(F.coalesce("records", F.lit(0)) / F.col("total"), 6).alias("share"), "wanted")
