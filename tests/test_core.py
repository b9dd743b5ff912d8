import json
import zipfile
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.functions.paths import ancestors, canonical_place, clean_path, leaf, parent
from darkroom.functions.vectors import blob_to_array, cosine
from darkroom.operators import skew
from darkroom.operators.collections import CollectionFilter, collect, neighbours_in_queue, page, parse_days, within_place
from darkroom.operators.components import components
from darkroom.operators.evaluation import best_threshold, confusion, lru_release, threshold_sweep
from darkroom.operators.geometry import match_kinds, padded_crop, reconcile, suppress, tiles
from darkroom.operators.latest import active_reviews, latest_by, latest_by_id
from darkroom.operators.matching import best_people, confidence
from darkroom.operators.mutations import delete_stale, insert_if_absent, remap, selection_token, snapshot_diff, upsert, with_new_ids
from darkroom.operators.places import display_label, place_of_answer, resolve_chains
from darkroom.sources.files import read_bundles, read_evaluation, read_manifest, scan_folder
from darkroom.streaming.latest import keep_latest, read_latest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_undo_reveals_the_review_before(spark):
    log = spark.createDataFrame([(1, "f", "assign", None), (2, "f", "reject", None), (3, "f", "undo", 2), (4, "g", "assign", None), (5, "g", "undo", 4), (6, "h", "unknown", None)], "id long, face string, action_kind string, reverses_action_id long")
    assert rows(active_reviews(log, "face").select("face", "id")) == [("f", 1), ("h", 6)]


def test_both_latest_agree(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(i), int(k), int(v)) for i, (k, v) in enumerate(rng.integers(0, 30, (500, 2)))], "id long, k long, v long")
    assert rows(latest_by(df, ["k"], [F.desc("id")]).select("k", "id", "v")) == rows(latest_by_id(df, ["k"], "id").select("k", "id", "v"))
    assert latest_by_id(df.limit(0), ["k"], "id").count() == 0


def test_components_of_chains_stars_and_random_edges(spark, staging):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(1000, 1090)] + [(0, i) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2200, (150, 2))] + [(5000, 5000), (None, 3), (7, None)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"), staging)))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), staging).count() == 0


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, v long")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 2)], "k string, w long")
    assert skew.hot_keys(left, "k") == ["hot"]
    for how in ("inner", "left"):
        assert rows(skew.lookup(left, right, "k", how).select("v", "w").fillna(-9)) == rows(left.join(right, "k", how).select("v", "w").fillna(-9))


def test_collection_of_all_dimensions(spark):
    photos = spark.createDataFrame([("a", datetime(2025, 5, 3), 41.0, 12.0), ("b", datetime(2025, 5, 10, 23, 59, 59, 999999), 41.0, 12.0), ("c", datetime(2025, 5, 11), 41.0, 12.0), ("d", None, 41.0, 12.0), ("e", datetime(2025, 5, 3), None, None)], "asset_revision_id string, taken_local timestamp, latitude double, longitude double")
    people = spark.createDataFrame([(x, p) for x in "abcde" for p in ("p", "q")] + [("a", "p")], "asset_revision_id string, person_id string")
    tags = spark.createDataFrame([("a", "sea"), ("b", "sky"), ("c", "sea")], "asset_revision_id string, tag string")
    places = spark.createDataFrame([("a", "places/it/roma"), ("b", "places/italy")], "asset_revision_id string, place string")
    want = lambda **k: [r[0] for r in rows(collect(photos, people, tags, places, CollectionFilter(**k)).select("asset_revision_id"))]
    assert want() == list("abcde")
    assert want(days=parse_days("2025/05/01-2025/05/10")) == ["a", "b", "e"]
    assert want(people=("p", "q"), every_person=True, box=(40, 10, 44, 15)) == list("abcd")
    assert want(tags=("sea", "sky"), every_tag=True) == [] and want(tags=("sea", "sky")) == ["a", "b", "c"]
    assert want(place="places/it") == ["a"]
    with pytest.raises(ValueError):
        want(box=(44, 10, 40, 15))


def test_days_and_pages(spark):
    assert parse_days("2025") == (date(2025, 1, 1), date(2025, 12, 31)) and parse_days("2024-2025")[1] == date(2025, 12, 31)
    for bad in ("2025/13/01", "05/2025", "2025-2024", ""):
        with pytest.raises(ValueError):
            parse_days(bad)
    df = spark.range(30)
    assert [r[0] for r in page(df, [F.desc("id")], 5, 3).collect()] == [24, 23, 22]
    with pytest.raises(ValueError):
        page(df, [F.desc("id")], 0, 201)
    nav = neighbours_in_queue(df.limit(3), "id", [F.asc("id")])
    assert [tuple(r) for r in nav.orderBy("id").collect()] == [(0, None, 1, 1, 3), (1, 0, 2, 2, 3), (2, 1, None, 3, 3)]


def test_best_people(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "face_id long, vector array<float>")
    e = spark.createDataFrame([("b", [1.0, 0.0, 0.0]), ("c", [0.8, 0.6, 0.0]), ("c", [0.0, 1.0, 0.0]), ("d", [0.0, 0.0, 0.0]), ("a", [0.8, 0.6, 0.0])], "person_id string, vector array<float>")
    out = [(r["face_id"], r["person_id"], r["rank"], round(r["score"], 6), round(r["margin"], 6)) for r in best_people(t, e).orderBy("rank").collect()]
    assert out == [(1, "b", 1, 1.0, 0.2), (1, "a", 2, 0.8, 0.2)]
    rejected = spark.createDataFrame([(1, "b"), (1, "a")], "face_id long, person_id string")
    one = best_people(t, e, rejected).collect()
    assert [(r["person_id"], r["margin"]) for r in one] == [("c", None)]
    assert best_people(t, e.limit(0)).count() == 0 and best_people(t.limit(0), e).count() == 0
    groups = spark.createDataFrame([(0.9, None), (0.9, 0.2), (0.6, 0.0), (0.1, 0.9), (None, None)], "s double, m double").select(confidence(F.col("s"), F.col("m"))).collect()
    assert [g[0] for g in groups] == ["medium", "high", "medium", "low", None]


def test_vectors(spark):
    df = spark.createDataFrame([(np.array([3, 4], "<f4").tobytes(),), (b"123",), (None,)], "b binary").select(blob_to_array("b").alias("v"))
    assert [r["v"] for r in df.collect()] == [[3.0, 4.0], None, None]
    assert df.filter("v is not null").select(cosine(F.col("v"), F.array(F.lit(0.0).cast("float"), F.lit(2.0).cast("float")))).collect()[0][0] == pytest.approx(0.8)


def test_mutations(spark, staging):
    base = spark.createDataFrame([(1, "a", "open"), (2, "b", "done"), (3, "c", "open")], "id long, v string, s string")
    new = spark.createDataFrame([(2, "B", "open"), (4, "d", "open")], "id long, v string, s string")
    assert rows(upsert(base, new, ["id"], ["v"])) == [(1, "a", "open"), (2, "B", "done"), (3, "c", "open"), (4, "d", "open")]
    assert rows(insert_if_absent(base, new, ["id"])) == [(1, "a", "open"), (2, "b", "done"), (3, "c", "open"), (4, "d", "open")]
    assert rows(delete_stale(base, new, ["id"], F.col("s") == "done").select("id")) == [(2,)]
    assert rows(remap(base, "v", spark.createDataFrame([("a", "c")], "old string, new string"), ["v"]).select("v")) == [("b",), ("c",)]
    assert rows(with_new_ids(9, new.select("v"), ["v"], staging)) == [("B", 10), ("d", 11)]
    assert selection_token(base, "id", "x").collect() == selection_token(base.union(base), "id", "x").collect() != selection_token(base, "id", "y").collect()
    diff = snapshot_diff(spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "9")], "k string, d string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("m", "4")], "k string, d string"), "k", "d")
    assert rows(diff) == [("a", "same"), ("b", "changed"), ("m", "missing"), ("n", "new")]


BOX = "photo string, id long, x double, y double, w double, h double"


def test_boxes(spark):
    known = spark.createDataFrame([("p", 1, 0.0, 0.0, 0.2, 0.2), ("p", 2, 0.5, 0.5, 0.2, 0.2), ("p", 3, 0.8, 0.0, 0.1, 0.1), ("q", 1, 0.0, 0.0, 0.2, 0.2)], BOX)
    found = spark.createDataFrame([("p", 7, 0.0, 0.0, 0.2, 0.2), ("p", 8, 0.5, 0.5, 0.2, 0.2), ("p", 9, 0.51, 0.5, 0.2, 0.2), ("p", 6, 0.0, 0.8, 0.1, 0.1), ("q", 5, 0.5, 0.5, 0.0, 0.0)], BOX)
    # The points are the middle of each box, but those of one more found box lie far from its own.
    marks = lambda df, off: df.withColumn("marks", F.array(F.struct((F.col("x") + F.col("w") / 2 + off).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))))
    known, found = marks(known, F.lit(0.0)), marks(found, F.lit(0.0))
    off = marks(spark.createDataFrame([("r", 1, 0.0, 0.0, 0.2, 0.2)], BOX), F.lit(0.1))
    assert reconcile(marks(spark.createDataFrame([("r", 2, 0.0, 0.0, 0.2, 0.2)], BOX), F.lit(0.0)), off, "photo")[0].collect()[0]["outcome"] == "new"
    plan, rest = reconcile(known, found, "photo")
    assert {(r[0], r[1]): (r[2], r[3]) for r in plan.collect()} == {("p", 7): ("existing", 1), ("p", 8): ("ambiguous", None), ("p", 9): ("ambiguous", None), ("p", 6): ("new", None), ("q", 5): ("new", None)}
    assert rows(rest) == [("p", 2), ("p", 3), ("q", 1)]
    kinds = {(r[0], r[1], r[2]): r[3] for r in match_kinds(known, found, "photo", 0.3).collect()}
    assert kinds[("p", "truth", 1)] == kinds[("p", "candidate", 7)] == "matched" and kinds[("p", "truth", 2)] == kinds[("p", "candidate", 9)] == "duplicate"
    assert kinds[("p", "truth", 3)] == kinds[("q", "truth", 1)] == "missed" and kinds[("p", "candidate", 6)] == "false"
    scored = found.withColumn("score", F.lit(0.5))
    assert rows(suppress(scored, "photo", 0.3)) == [("p", 6), ("p", 7), ("p", 8), ("q", 5)]
    assert rows(suppress(scored, "photo", 0.3, 1)) == [("p", 6), ("q", 5)]


def test_tiles_and_crops(spark):
    sizes = spark.createDataFrame([("a", 1000, 600), ("b", 640, 640), ("c", 641, 100), ("n", None, 5)], "id string, width int, height int")
    out = rows(tiles(sizes, "id", 640, 64))
    assert out == [("a", 0, 0, 640, 600), ("a", 360, 0, 640, 600), ("c", 0, 0, 640, 100), ("c", 1, 0, 640, 100)]
    crop = sizes.limit(1).select(padded_crop(F.lit(10.0), F.lit(10.0), F.lit(100.0), F.lit(50.0), 0.2, F.lit(115), F.lit(600)).alias("c")).collect()[0]["c"]
    assert (crop["x"], crop["y"], crop["w"], crop["h"]) == (0, 0, 115, 70)


def test_thresholds(spark):
    df = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.6), ("b", "b", 0.7), (None, "a", 0.65), (None, None, None), ("c", None, None)], "expected string, predicted string, score double")
    sweep = threshold_sweep(df, [0.5, 0.68, 0.95])
    by = {r["threshold"]: r for r in sweep.collect()}
    assert by[0.5]["precision"] == 0.5 and by[0.68]["unknown_rejection"] == 1.0 and by[0.95]["precision"] == 0.0
    assert best_threshold(sweep).collect()[0]["threshold"] == 0.68
    assert rows(confusion(df, 0.68)) == [("<unknown>", "<missed>", 1), ("<unknown>", "<rejected>", 1), ("a", "<rejected>", 1), ("a", "a", 1), ("b", "b", 1), ("c", "<missed>", 1)]
    assert best_threshold(threshold_sweep(df.limit(0), [0.5])).count() == 0


def test_lru_release(spark, staging):
    df = spark.createDataFrame([(i, 10) for i in range(50)], "at long, size long")
    out = rows(lru_release(df, ["at"], "size", 95, staging).select("at", "released_before"))
    assert out == [(i, i * 10) for i in range(10)]
    assert lru_release(df.limit(0), ["at"], "size", 95, staging).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("Ｐlaces/ Ｓweden /Stock  holm",), ("a//b",), ("a/" + "x" * 81,), ("tab\x07",), (None,)], "p string").select(clean_path("p").alias("p"))
    assert [r["p"] for r in df.collect()] == ["Places/Sweden/Stock holm", None, None, None, None]
    one = spark.createDataFrame([("a/b/c",)], "p string").select(ancestors(F.col("p")), leaf(F.col("p")), parent(F.col("p")), within_place(F.col("p"), "a/b"), within_place(F.col("p"), "a/b/")).collect()[0]
    assert tuple(one) == (["a", "a/b", "a/b/c"], "c", "a/b", True, True)
    assert spark.createDataFrame([("Sweden / Stockholm",), ("PLACES/Sweden",)], "p string").select(canonical_place(F.col("p"))).collect() == [("places/sweden/stockholm",), ("places/sweden",)]


def test_places(spark):
    a = json.dumps({"geonames": [{"countryName": "Sweden", "adminName1": "Stockholm", "adminName2": " ", "name": "STOCKHOLM"}]})
    df = spark.createDataFrame([(a,), ("{}",), ("no json",), (None,), (json.dumps({"geonames": []}),)], "a string")
    assert [r[0] for r in df.select(place_of_answer(F.col("a"))).collect()] == ["Sweden/Stockholm", None, None, None, None]
    many = spark.createDataFrame([(1, "a"), (1, "a/b/c"), (1, "a/b"), (2, "a/b"), (2, "a/c"), (3, "ab"), (3, "a"), (None, "x"), (4, None)], "k int, p string")
    assert {r["k"]: (r["place"], r["conflict"]) for r in resolve_chains(many, ["k"], "p").collect()} == {1: ("a/b/c", None), 2: (None, "a/b; a/c"), 3: (None, "a; ab"), None: ("x", None)}
    labels = spark.createDataFrame([("places/x/y",), ("x",), (None,)], "p string").select(display_label(F.col("p"))).collect()
    assert [r[0] for r in labels] == ["x · y", "x", None]


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.JPG", "b.txt", "x/c.heic", "noext"):
        (tmp_path / name).write_bytes(b"1234")
    out = {r["path"].rsplit("/", 1)[1]: (r["extension"], r["media_type"], r["size_bytes"]) for r in scan_folder(spark, str(tmp_path)).collect()}
    assert out == {"a.JPG": ("jpg", "image/jpeg", 4), "b.txt": ("txt", None, 4), "c.heic": ("heic", "image/heic", 4), "noext": ("<none>", None, 4)}


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿Report of May\n;;;\nSample ID;Image Name;Source Group;Primary Category;Countable Faces\ns1;"a;""b"".jpg";g;c;3\ns2;b.jpg;g;c;0\n\n', encoding="utf-8")
    assert rows(read_manifest(spark, str(p)).select("sample_id", "image_name", "countable_faces", "sample_group").fillna("-")) == [("s1", 'a;"b".jpg', 3, "-"), ("s2", "b.jpg", 0, "-")]
    p.write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no header"):
        read_manifest(spark, str(p)).collect()


def test_evaluation_file(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"schemaVersion": 1, "thresholds": [0.5, 0.7], "gallery": [{"faceId": "f", "personId": "p", "embedding": [1.0, 0.0]}], "validation": [{"sampleId": "s", "expectedPersonId": None, "faceExpected": True, "faceDetected": False, "embedding": None, "elapsedMilliseconds": 2.5}], "test": []}))
    sets = read_evaluation(spark, str(p))
    assert rows(sets["thresholds"]) == [(0.5,), (0.7,)] and sets["gallery"].count() == 1 and sets["validation"].collect()[0]["elapsedMilliseconds"] == 2.5 and sets["test"].count() == 0


def test_bundles(spark, tmp_path):
    import hashlib

    def listed(name, data, digest=None):
        return {"path": name, "length": len(data), "sha256": digest or hashlib.sha256(data).hexdigest()}

    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("ok.bin", b"abc")
        z.writestr("bad.bin", b"abc")
        z.writestr("../up.bin", b"abc")
        z.writestr("extra.bin", b"abc")
        z.writestr("manifest.json", json.dumps({"files": [listed("ok.bin", b"abc"), listed("bad.bin", b"abc", "0" * 64), listed("../up.bin", b"abc"), listed("gone.bin", b"")]}))
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    out = {r["name"]: r["problem"] for r in read_bundles(spark, str(tmp_path)).collect()}
    assert out == {"ok.bin": None, "bad.bin": "digest", "../up.bin": "unsafe path", "extra.bin": "not listed", "gone.bin": "missing", None: "unreadable: BadZipFile"}


def test_stream_of_actions(spark, tmp_path):
    src = str(tmp_path / "in")
    log = [(1, "a", "add"), (4, "b", "add"), (9, "a", "remove")]
    spark.createDataFrame(log[::-1], "id long, k string, kind string").write.parquet(src)
    for more in ([(3, "a", "add"), (5, "b", "remove")], [(5, "b", "remove")]):
        stream = spark.readStream.schema("id long, k string, kind string").parquet(src)
        keep_latest(stream, ["k"], "id", str(tmp_path / "state"), str(tmp_path / "chk"), 4).awaitTermination(60)
        spark.createDataFrame(more, "id long, k string, kind string").write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long, k string, kind string").parquet(src)
    keep_latest(stream, ["k"], "id", str(tmp_path / "state"), str(tmp_path / "chk"), 4).awaitTermination(60)
    assert rows(read_latest(spark, str(tmp_path / "state"), ["k"], "id").select("k", "id", "kind")) == [("a", 9, "remove"), ("b", 5, "remove")]
