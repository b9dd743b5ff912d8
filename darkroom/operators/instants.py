"""Mixed time texts, offsets and zones as one unambiguous instant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.functions.times import parse_time, read_parts, to_utc_seconds, wall_clock
from darkroom.operators.ranges import surrounding
from darkroom.plans.staging import Staging

#: Offsets that a place can have, in minutes.
OFFSET_LIMIT = 840


def zone_names(df: DataFrame) -> DataFrame:
    """(key, zone): the names of the tz database that the executors' Java knows, by their lower-case form; about 600 rows."""
    spark = df.sparkSession
    names = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return spark.createDataFrame(sorted({str(n).lower(): str(n) for n in names}.items()), "key string, zone string")


def _in_zone(df: DataFrame) -> DataFrame:
    """``df`` (local, tz) with u1, exists, before, after and u2: the instant of a wall clock in a zone, whether that wall clock exists, the zone's offsets (seconds) a day before and after, and the later instant where the zone has the wall clock twice.

    Each step is a projection of its own, so that every conversion is made once.
    """
    zone, day, u1, local = F.coalesce("tz", F.lit("UTC")), 86400, F.col("u1"), F.col("local")
    out = df.withColumn("u1", to_utc_seconds(local, zone))
    out = out.withColumn("before", wall_clock(u1 - day, zone) - (u1 - day)).withColumn("after", wall_clock(u1 + day, zone) - (u1 + day)).withColumn("exists", wall_clock(u1, zone) == local)
    a, b = local - F.col("before"), local - F.col("after")
    twice = F.when(wall_clock(a, zone) == local, F.when(wall_clock(b, zone) == local, F.greatest(a, b)))
    return out.withColumn("u2", F.when(F.col("before") != F.col("after"), twice))


def resolve_instants(df: DataFrame, key: str, text: str, offset: str, zone: str) -> DataFrame:
    """(key, utc_ms, basis, local_s, sub_ms): the instant that a row's text, offset and zone determine.

    The text must give a valid date and at least hour and minute, or be a count
    of seconds (9 or 10 digits) or milliseconds (12 or 13) since 1970. A zone or
    an offset in the text comes first, then ``offset`` (minutes) if it lies within
    14 hours, then the name in ``zone``. A wall clock that the zone skips or has
    twice gives no instant, unless an offset that the zone has around that time
    settles it. basis says what decided: epoch, text, offset or zone; utc_ms and
    basis are null where nothing does (null, empty, unreadable texts, unknown
    zones). Every row of the input is kept, repeated ones too; columns of other
    names aren't read.
    """
    names = F.broadcast(zone_names(df))
    parts = read_parts(F.col("parsed"))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(offset).cast("int").alias("offset"), F.lower(F.trim(F.col(zone).cast("string"))).alias("named"))
    read = parse_time(rows, "text", "parsed").select("key", "offset", "named", *[c.alias(n) for n, c in parts.items()])
    read = read.withColumn("offset", F.when(F.col("offset").between(-OFFSET_LIMIT, OFFSET_LIMIT), F.col("offset")))
    zoned = read.join(names.select(F.col("key").alias("zone"), F.col("zone").alias("text_zone")), "zone", "left").join(names.select(F.col("key").alias("named"), F.col("zone").alias("row_zone")), "named", "left")
    # A zone is only looked up where no offset decides before it.
    use_text = F.col("offset_min").isNull() & F.col("zone").isNotNull()
    use_row = F.col("offset_min").isNull() & F.col("zone").isNull() & F.col("offset").isNull()
    zoned = zoned.withColumn("tz", F.when(use_text, F.col("text_zone")).when(use_row, F.col("row_zone"))).withColumn("local", F.when(F.col("tz").isNotNull(), F.col("local_s")))
    zoned = _in_zone(zoned)
    by_offset = F.col("local_s") - F.col("offset") * 60
    around = F.col("offset") * 60 == F.col("before")
    around = around | (F.col("offset") * 60 == F.col("after"))
    in_zone = F.when(F.col("exists") & F.col("u2").isNull(), F.col("u1")).when(use_text & around, by_offset)
    seconds = (
        F.when(F.col("offset_min").isNotNull(), F.col("local_s") - F.col("offset_min") * 60)
        .when(use_text, F.when(F.col("tz").isNotNull(), in_zone))
        .when(F.col("offset").isNotNull(), by_offset)
        .otherwise(F.when(F.col("tz").isNotNull(), in_zone))
    )
    basis = F.when(F.col("epoch_ms").isNotNull(), "epoch").when(F.col("offset_min").isNotNull() | use_text, "text").when(F.col("offset").isNotNull(), "offset").otherwise("zone")
    out = zoned.select("key", F.coalesce("epoch_ms", seconds * 1000 + F.col("sub_ms")).alias("utc_ms"), basis.alias("basis"), "local_s", "sub_ms")
    return out.withColumn("basis", F.when(F.col("utc_ms").isNotNull(), F.col("basis"))).withColumnRenamed("key", key)


#: Offsets that are tried where none is known, in minutes: every quarter of an hour within OFFSET_LIMIT.
CANDIDATES = tuple(range(-OFFSET_LIMIT, OFFSET_LIMIT + 1, 15))
#: Cost of a change of offset between neighbouring segments, in violations.
CHANGE = 3.0

def known_around(base: DataFrame, staging: Staging) -> DataFrame:
    """(source, at, local_s, n, before, after): the rows of ``base`` (source, at, local_s, known_s) without an instant, equal ones as one with their number n, and the known instants that came in last before and first after each in its source.

    Rows that came in at one time have no order; of several known instants of
    one time the last counts as before and the first as after. Known instants
    are reduced to one row a time, and all are ordered by ranges, so a source
    may have any number of rows.
    """
    # At one time the instants that count as after come first, then the rows that look for them, then those that count as before.
    known = base.filter("known_s is not null").groupBy("source", "at").agg(F.min("known_s").alias("lo"), F.max("known_s").alias("hi"))
    known = known.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(2)))).select("source", "at", "turn", F.when(F.col("turn") == 2, F.col("hi")).alias("hi"), F.when(F.col("turn") == 0, F.col("lo")).alias("lo"))
    unknown = base.filter("known_s is null").groupBy("source", "at", "local_s").agg(F.count(F.lit(1)).alias("n")).withColumn("turn", F.lit(1))
    line = surrounding(unknown.unionByName(known, allowMissingColumns=True), "source", ["at", "turn", "local_s"], "hi", "lo", staging)
    return line.filter("turn = 1").select("source", "at", "local_s", "n", "before", "after")


def estimate_offsets(rows: DataFrame, source: str, sequence: str, segment_s: int, staging: Staging | None = None) -> DataFrame:
    """(source, segment, offset_min, violations, rows): the offset history of every source that violates least.

    ``rows`` has ``source`` (a camera, a folder, an import), ``sequence`` (the
    time at which a row came in, as a timestamp), local_s (wall clock, seconds)
    and known_s (its instant where something determines it, else null). A
    source's rows are cut into segments of ``segment_s`` seconds. For each segment
    each of CANDIDATES is tried on the rows without an instant: it is violated
    where a photo would be taken after it came in, before the known instant that
    came in last before it, or after the one that came in first after it, in
    whatever segments these are. Rows that are known vote for their own offset. A
    shortest path over the segments of a source, where a change of offset costs
    CHANGE, gives the history; ties go to the smaller offset. Rows without
    source, sequence or wall clock are ignored.

    Rows meet their neighbours in ranges of source and sequence, so a source with
    a third of all rows costs no more than others; the rest is counted by
    aggregations that combine before the shuffle, known rows by offset, the
    others by candidate. The path sees len(CANDIDATES) numbers a segment.
    """
    segment = F.floor(F.col("seen") / segment_s)
    base = rows.filter(F.col(source).isNotNull() & F.col(sequence).isNotNull() & F.col("local_s").isNotNull()).select(F.col(source).alias("source"), F.unix_micros(F.col(sequence)).alias("at"), F.unix_seconds(F.col(sequence)).alias("seen"), "local_s", "known_s").withColumn("segment", segment)
    unknown = known_around(base, staging or Staging(rows.sparkSession, "offsets")).withColumn("seen", F.unix_seconds(F.timestamp_micros("at"))).withColumn("segment", segment)
    offset = F.explode(F.array(*[F.lit(m) for m in CANDIDATES]))
    taken = F.col("local_s") - F.col("offset_min") * 60
    wrong = (taken > F.col("seen")).cast("int") + F.coalesce((taken < F.col("before")).cast("int"), F.lit(0)) + F.coalesce((taken > F.col("after")).cast("int"), F.lit(0))
    of_unknown = unknown.withColumn("offset_min", offset).groupBy("source", "segment", "offset_min").agg(F.sum(wrong * F.col("n")).alias("cost"), F.sum("n").alias("n"))
    # A known row violates every candidate but its own.
    votes = base.filter("known_s is not null").groupBy("source", "segment", ((F.col("local_s") - F.col("known_s")) / 60).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    of_known = votes.withColumn("offset_min", offset).groupBy("source", "segment", "offset_min").agg(F.sum(F.when(F.col("own") == F.col("offset_min"), 0).otherwise(F.col("n"))).alias("cost"), F.sum("n").alias("n"))
    costs = of_unknown.unionByName(of_known).groupBy("source", "segment", "offset_min").agg(F.sum("cost").cast("double").alias("cost"), F.sum("n").alias("n"))

    def path(frame: pd.DataFrame) -> pd.DataFrame:
        grid = frame.pivot(index="segment", columns="offset_min", values="cost").sort_index().sort_index(axis=1)
        offsets = grid.columns.to_numpy()
        cost = grid.to_numpy()
        by_size = np.argsort(np.abs(offsets), kind="stable")
        total, back = cost[0].copy(), np.zeros(cost.shape, dtype=np.int64)
        for i in range(1, len(cost)):
            cheapest = by_size[np.argmin(total[by_size])]
            change = total[cheapest] + CHANGE < total
            back[i] = np.where(change, cheapest, np.arange(len(offsets)))
            total = np.where(change, total[cheapest] + CHANGE, total) + cost[i]
        at, chosen = by_size[np.argmin(total[by_size])], []
        for i in range(len(cost) - 1, -1, -1):
            chosen.append(at)
            at = back[i][at]
        chosen = np.array(chosen[::-1])
        rows = frame.groupby("segment")["n"].first().sort_index().to_numpy()
        return pd.DataFrame({"source": frame["source"].iloc[0], "segment": grid.index, "offset_min": offsets[chosen], "violations": cost[np.arange(len(cost)), chosen].astype(np.int64), "rows": rows})

    kind = dict(costs.dtypes)["source"]
    return costs.groupBy("source").applyInPandas(path, f"source {kind}, segment long, offset_min int, violations long, rows long").withColumnRenamed("source", source)


def estimate_instants(rows: DataFrame, source: str, sequence: str, segment_s: int) -> DataFrame:
    """``rows`` (as for ``estimate_offsets``) with est_s: known_s, or else the instant by the estimated offset of its segment."""
    history = estimate_offsets(rows, source, sequence, segment_s).select(F.col(source), "segment", "offset_min")
    keyed = rows.withColumn("segment", F.floor(F.unix_seconds(F.col(sequence)) / segment_s))
    return keyed.join(history, [source, "segment"], "left").withColumn("est_s", F.coalesce("known_s", F.col("local_s") - F.col("offset_min") * 60)).drop("segment", "offset_min")


def recovery(rows: DataFrame, source: str, sequence: str, segment_s: int, key: str, one_in: int = 10) -> DataFrame:
    """(hidden, estimated, right, within_hour): how many known instants come back if one in ``one_in`` is hidden.

    The hidden ones are chosen by a hash of ``key``. right counts those that are
    estimated to the second, within_hour those that are off by an hour at most.
    """
    chosen = F.pmod(F.xxhash64(key), F.lit(one_in)) == 0
    kept = rows.withColumn("true_s", F.when(chosen, F.col("known_s"))).withColumn("known_s", F.when(~chosen, F.col("known_s")))
    est = estimate_instants(kept, source, sequence, segment_s).filter("true_s is not null")
    off = F.abs(F.col("est_s") - F.col("true_s"))
    return est.agg(F.count(F.lit(1)).alias("hidden"), F.count("est_s").alias("estimated"), F.count_if(off == 0).alias("right"), F.count_if(off <= 3600).alias("within_hour"))
