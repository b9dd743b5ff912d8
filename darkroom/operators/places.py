"""Places from geocoders' answers, and one place from several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANSWER = "geonames array<struct<countryName:string,adminName1:string,adminName2:string,adminName3:string,adminName4:string,name:string>>"


def place_of_answer(answer: Column) -> Column:
    """The path country/admin1..4/locality of a geocoder's JSON answer.

    Blank parts are left out, and of parts that differ in case only the first
    stays; null for an answer that is no JSON or has no place.
    """
    first = F.get(F.from_json(answer, _ANSWER)["geonames"], 0)
    parts = F.array(*[F.trim(first[c]) for c in ("countryName", "adminName1", "adminName2", "adminName3", "adminName4", "name")])
    there = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    low = F.transform(there, F.lower)
    once = F.filter(there, lambda p, i: ~F.array_contains(F.slice(low, 1, i), F.lower(p)))
    return F.when(F.size(once) > 0, F.array_join(once, "/"))


def resolve_chains(df: DataFrame, key: list[str], place: str) -> DataFrame:
    """(key, place, conflict): the deepest place of each key if all its places lie on one path, else their list as the conflict.

    Places lie on one path if every place is an ancestor of the longest or the
    longest itself; so two aggregations replace the pairs of a key's places.
    """
    rows = df.select(*key, F.col(place).alias("p")).filter(F.col("p").isNotNull()).distinct()
    deepest = rows.groupBy(*key).agg(F.max_by("p", F.struct(F.length("p"), "p")).alias("deepest"))
    on = (F.col("p") == F.col("deepest")) | F.col("deepest").startswith(F.concat("p", F.lit("/")))
    null_safe = [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    met = rows.alias("r").join(deepest.alias("d"), null_safe).select(*[F.col(f"r.{k}").alias(k) for k in key], "p", "deepest", on.alias("on"))
    out = met.groupBy(*key).agg(F.bool_and("on").alias("chain"), F.first("deepest").alias("deepest"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("on") | (F.col("p") == F.col("deepest")), F.col("p")))), "; ").alias("others"))
    return out.select(*key, F.when(F.col("chain"), F.col("deepest")).alias("place"), F.when(~F.col("chain"), F.col("others")).alias("conflict"))


# What administrative names add to the name of their city.
CITY_PREFIX, CITY_SUFFIXES, GENITIVE_SUFFIX = "city of ", (" city", " municipality"), " stad"


def _city(part: Column, between: Column) -> Column:
    """The city that an administrative part names; null where it names none. ``between`` are all such parts."""
    low = F.lower(part)
    without = lambda n: F.trim(F.substring(part, F.lit(1), F.length(part) - n))
    own = without(len(GENITIVE_SUFFIX))
    # A genitive s goes where another part shows that it belongs to the name of the region.
    shown = F.exists(between, lambda x: (x != part) & F.lower(x).startswith(F.concat(F.lower(own), F.lit(" "))))
    stem = F.when(own.endswith("s") & shown, F.substring(own, F.lit(1), F.length(own) - 1)).otherwise(own)
    out = F.when(low.endswith(GENITIVE_SUFFIX), stem).when(low.startswith(CITY_PREFIX), F.trim(F.substring(part, F.lit(len(CITY_PREFIX) + 1), F.length(part))))
    for suffix in CITY_SUFFIXES:
        out = out.when(low.endswith(suffix), without(len(suffix)))
    return F.nullif(out, F.lit(""))


def display_label(path: Column, automatic: Column | None = None) -> Column:
    """``parent · leaf`` of a place's path, without the root ``places``; the leaf alone where the parent is the same.

    Where ``automatic`` holds, a geocoder chose the path: the deepest part
    between country and leaf that names a city stands for the parent.
    """
    parts = F.filter(F.transform(F.split(path, "/"), F.trim), lambda p: (F.lower(p) != "places") & (p != ""))
    leaf, above = F.element_at(parts, -1), F.element_at(parts, -2)
    if automatic is not None:
        between = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
        city = F.get(F.filter(F.transform(F.reverse(between), lambda p: _city(p, between)), lambda c: c.isNotNull()), 0)
        above = F.coalesce(F.when(automatic & (F.lower(city) != F.lower(leaf)), city), above)
    label = F.when(F.lower(above) == F.lower(leaf), leaf).otherwise(F.concat_ws(" · ", above, leaf))
    return F.when(F.size(parts) > 1, label).when(F.size(parts) == 1, leaf)
