"""Collection filters: any/all membership, hierarchical places, boxes, dates, paging."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The root under which place tags live, and the largest page.
PLACES = "places"
MOST_PAGE = 200


def holds(members: DataFrame, subject: str, member: str, wanted: list[str], every: bool) -> DataFrame:
    """Subjects with any, or with every, of the ``wanted`` members: counts of distinct members, combined before the shuffle."""
    hits = members.filter(F.col(member).isin(wanted)).groupBy(subject).agg(F.countDistinct(member).alias("n"))
    return hits.filter(F.col("n") >= (len(set(wanted)) if every else 1)).select(subject)


def holds_these(members: DataFrame, subject: str, member: str, wanted: DataFrame, every: bool) -> DataFrame:
    """The same where the wanted members are a table: a semi-join, and one count where all are asked."""
    hits = members.join(wanted.select(member).distinct(), member, "left_semi")
    if not every:
        return hits.select(subject).distinct()
    asked = wanted.agg(F.count_distinct(member).alias("asked"))
    # The right side is a single row.
    return hits.groupBy(subject).agg(F.countDistinct(member).alias("n")).join(F.broadcast(asked), F.col("n") == F.col("asked")).select(subject)


def covering(folders: list[str]) -> list[str]:
    """The folders that cover all of ``folders``: separators made one, and those below another left out; an empty one covers everything."""
    clean = []
    for f in folders:
        parts = [x for x in f.replace("\\", "/").split("/") if x]
        if f.startswith(("/", "\\")) or any(x in (".", "..") for x in parts) or any(":" in x for x in parts[:1]):
            raise ValueError(f"not a folder below the root: {f}")
        clean.append("/".join(parts))
    return sorted({f for f in clean if not any(g != f and (not g or f.startswith(g + "/")) for g in clean)})


def within_folders(path: Column, folders: list[str]) -> Column:
    """Whether a path lies in one of the folders; true for all paths if one of them is the root."""
    kept = covering(folders)
    return F.lit(True) if "" in kept else reduce(lambda a, b: a | b, [within_place(path, f) for f in kept], F.lit(False))


def within_place(value: Column, place: str) -> Column:
    """The place itself or one below it; never one that only starts with the same letters."""
    return (value == place) | value.startswith(place.rstrip("/") + "/")


def outside_places(name: Column) -> Column:
    """Tags that aren't places."""
    return (name != PLACES) & ~name.startswith(PLACES + "/")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside the box, edges included; without wrapping round the date line. Nulls never match."""
    if south > north or west > east:
        raise ValueError("a box needs south <= north and west <= east")
    return lat.between(south, north) & lon.between(west, east)


def on_days(local: Column, first: date | None, last: date | None) -> Column:
    """Local times from the first day to the end of the last; half-open, so any precision fits."""
    parts = []
    if first:
        parts.append(local >= F.lit(first))
    if last:
        parts.append(local < F.lit(last + timedelta(days=1)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def parse_days(text: str) -> tuple[date, date]:
    """The days of ``YYYY``, ``YYYY-YYYY``, ``YYYY/MM/DD`` or ``YYYY/MM/DD-YYYY/MM/DD``."""
    text = text.strip()
    if m := re.fullmatch(r"(\d{4})(?:-(\d{4}))?", text):
        first, last = date(int(m[1]), 1, 1), date(int(m[2] or m[1]), 12, 31)
    elif m := re.fullmatch(r"(\d{4})/(\d{2})/(\d{2})(?:-(\d{4})/(\d{2})/(\d{2}))?", text):
        first = date(int(m[1]), int(m[2]), int(m[3]))
        last = date(int(m[4]), int(m[5]), int(m[6])) if m[4] else first
    else:
        raise ValueError(f"not a day or a range of days: {text}")
    if last < first:
        raise ValueError("the range ends before it starts")
    return first, last


@dataclass(frozen=True)
class CollectionFilter:
    """What a saved collection asks for; a dimension that is empty isn't asked."""

    people: tuple[str, ...] = ()
    every_person: bool = False
    tags: tuple[str, ...] = ()
    every_tag: bool = False
    place: str | None = None
    box: tuple[float, float, float, float] | None = None
    days: tuple[date | None, date | None] = field(default=(None, None))


def parse_filter(text: str) -> CollectionFilter:
    """A stored filter (JSON, schema version 1 or 2) as a CollectionFilter.

    Version 1 had no location: a tag below the root of places was one, and moves there.
    """
    stored = json.loads(text)
    if stored.get("schemaVersion") not in (1, 2):
        raise ValueError("a filter needs schema version 1 or 2")
    for match in ("peopleMatch", "tagMatch"):
        if stored.get(match, "any") not in ("any", "all"):
            raise ValueError(f"{match} must be any or all")
    where, tags = stored.get("location") or {}, list(stored.get("tags") or [])
    place = where.get("place")
    if stored["schemaVersion"] == 1:
        below = [x for x in tags if x.lower().startswith(PLACES + "/")]
        if len(below) > 1 or (below and place):
            raise ValueError("a filter has one place")
        place, tags = place or (below[0].lower() if below else None), [x for x in tags if x not in below]
    edges = [where.get(k) for k in ("south", "west", "north", "east")]
    if any(e is not None for e in edges) and None in edges:
        raise ValueError("a box needs four edges")
    days = tuple(date.fromisoformat(d) if d else None for d in ((stored.get("taken") or {}).get(k) for k in ("from", "to")))
    if None not in days and days[1] < days[0]:
        raise ValueError("the range ends before it starts")
    return CollectionFilter(tuple(dict.fromkeys(stored.get("people") or [])), stored.get("peopleMatch") == "all", tuple(dict.fromkeys(tags)), stored.get("tagMatch") == "all", place, None if None in edges else tuple(edges), days)


def dump_filter(wanted: CollectionFilter) -> str:
    """The JSON (schema version 2) that ``parse_filter`` reads back."""
    where = {"place": wanted.place, **dict(zip(("south", "west", "north", "east"), wanted.box or (None,) * 4))}
    match = lambda every: "all" if every else "any"
    days = {k: d.isoformat() if d else None for k, d in zip(("from", "to"), wanted.days)}
    return json.dumps({"schemaVersion": 2, "people": list(wanted.people), "peopleMatch": match(wanted.every_person), "tags": list(wanted.tags), "tagMatch": match(wanted.every_tag), "location": where, "taken": days})


def collect(photos: DataFrame, people: DataFrame, tags: DataFrame, places: DataFrame, wanted: CollectionFilter) -> DataFrame:
    """Photos (asset_revision_id, taken_local, latitude, longitude, ...) that meet every dimension that is asked.

    ``people`` and ``tags`` hold (asset_revision_id, person_id / tag), ``places``
    (asset_revision_id, place). Each dimension is a semi-join with the keys that
    pass it, so wide photo rows are read once and never multiplied.
    """
    key = "asset_revision_id"
    out = photos.filter(on_days(F.col("taken_local"), *wanted.days))
    if wanted.box:
        out = out.filter(in_box(F.col("latitude"), F.col("longitude"), *wanted.box))
    if wanted.people:
        out = out.join(holds(people, key, "person_id", list(wanted.people), wanted.every_person), key, "left_semi")
    if wanted.tags:
        out = out.join(holds(tags, key, "tag", list(wanted.tags), wanted.every_tag), key, "left_semi")
    if wanted.place:
        out = out.join(places.filter(within_place(F.col("place"), wanted.place)).select(key), key, "left_semi")
    return out


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``: Spark keeps only that many rows of each task."""
    if not 1 <= limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_PAGE} and offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def neighbours_in_queue(queue: DataFrame, key: str, order: list[Column], parts: str | None = None) -> DataFrame:
    """(key, previous, next, position, total) of every entry of a queue; of each ``parts`` if given.

    A part is sorted in one task; for one queue of any length use ``ranges.neighbours``.
    """
    w = Window.partitionBy(*([parts] if parts else [])).orderBy(*order)
    whole = Window.partitionBy(*([parts] if parts else []))
    return queue.select(*([parts] if parts else []), key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"), F.row_number().over(w).cast("long").alias("position"), F.count(F.lit(1)).over(whole).alias("total"))
