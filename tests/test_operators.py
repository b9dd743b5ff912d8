import hashlib
import json
import struct
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import review as r
from darkroom.operators.collections import CollectionFilter, covering, dump_filter, holds_these, parse_filter, within_folders
from darkroom.operators.evaluation import detection_metrics, hash_sample, overlap, same_rows
from darkroom.operators.geometry import alignment, decode_grid, to_pixels, to_source, to_unit
from darkroom.operators.matching import best_people
from darkroom.operators.places import display_label
from darkroom.operators.ranges import neighbours, numbered, quantiles
from darkroom.sources import sinks
from darkroom.sources.files import capture_metadata, hash_files, inventory, read_bundles, read_manifest, scan_folder, stream_folder
from darkroom.streaming.latest import counts_by_window, insert_once


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_ranges_number_a_queue_of_any_length(spark, staging):
    rng = np.random.default_rng(1)
    keys = [int(k) for k in rng.permutation(500)]
    df = spark.createDataFrame([(k, k // 7) for k in keys], "k long, o long").repartition(7)
    got = {x["k"]: tuple(x)[1:] for x in neighbours(df, "k", [F.asc("o"), F.asc("k")], staging).collect()}
    assert got == {k: (k - 1 if k else None, k + 1 if k < 499 else None, k + 1, 500) for k in range(500)}
    assert numbered(df.limit(0), [F.asc("k")], staging)[1] == 0
    assert neighbours(df.limit(0), "k", [F.asc("k")], staging).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 99, 100, 1000])
def test_quantiles(spark, staging, n):
    x = [int(v) for v in np.random.default_rng(n).integers(0, 60, n)]
    out = quantiles(spark.createDataFrame([(v,) for v in x] + [(None,)], "v long"), "v", staging).collect()[0]
    assert out["files"] == n
    if n:
        assert out["mean"] == pytest.approx(np.mean(x)) and out["median"] == np.median(x) and out["p95"] == sorted(x)[-(-n * 95 // 100) - 1]
    else:
        assert out["mean"] is None and out["median"] is None and out["p95"] is None


def test_people_with_very_many_exemplars(spark, monkeypatch):
    from darkroom.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 50)
    monkeypatch.setattr(matching, "CHUNK", 7)
    rng = np.random.default_rng(2)
    t, e = rng.standard_normal((30, 8)), rng.standard_normal((400, 8))
    person = [f"p{0 if i % 3 == 0 else i % 40:02d}" for i in range(400)]
    vectors = lambda x: [[float(np.float32(v)) for v in row] for row in x]
    targets = spark.createDataFrame(list(enumerate(vectors(t))), "face_id long, vector array<float>")
    exemplars = spark.createDataFrame(list(zip(person, vectors(e))), "person_id string, vector array<float>")
    rejected = {(i, f"p{j:02d}") for i in range(0, 30, 2) for j in range(0, 40, 3)}
    got = {(x["face_id"], x["rank"]): (x["person_id"], round(x["score"], 5)) for x in best_people(targets, exemplars, spark.createDataFrame(list(rejected), "face_id long, person_id string")).collect()}
    t, e = np.array(vectors(t)), np.array(vectors(e))
    cos = (t @ e.T) / np.linalg.norm(t, axis=1)[:, None] / np.linalg.norm(e, axis=1)
    for i in range(30):
        best = {}
        for j, p in enumerate(person):
            if (i, p) not in rejected:
                best[p] = max(cos[i, j], best.get(p, -2))
        top = sorted(best, key=lambda p: (-best[p], p))[:2]
        assert [got[(i, k + 1)] for k in range(2)] == [(p, round(best[p], 5)) for p in top]


def test_filters_are_stored_and_read_back():
    wanted = CollectionFilter(("a", "b"), True, ("x",), False, "places/sweden", (1.0, 2.0, 3.0, 4.0), (date(2024, 1, 1), None))
    assert parse_filter(dump_filter(wanted)) == wanted and parse_filter(dump_filter(CollectionFilter())) == CollectionFilter()
    old = parse_filter(json.dumps({"schemaVersion": 1, "tags": ["Places/Sweden", "sea"]}))
    assert old.place == "places/sweden" and old.tags == ("sea",)
    for bad in ({"schemaVersion": 3}, {"schemaVersion": 2, "tagMatch": "some"}, {"schemaVersion": 2, "location": {"south": 1}}, {"schemaVersion": 1, "tags": ["places/a", "places/b"]}):
        with pytest.raises(ValueError):
            parse_filter(json.dumps(bad))


def test_folders_and_members(spark):
    assert covering(["a/b", "a", "a/b/c/", "ab", "c\\d"]) == ["a", "ab", "c/d"] and covering(["", "x"]) == [""]
    for bad in ("/a", "a/../b", "c:/x"):
        with pytest.raises(ValueError):
            covering([bad])
    df = spark.createDataFrame([("a",), ("a/x",), ("ax",), ("c/d/e",), (None,)], "p string")
    assert rows(df.filter(within_folders(F.col("p"), ["a", "c\\d"]))) == [("a",), ("a/x",), ("c/d/e",)]
    members = spark.createDataFrame([(1, "p"), (1, "q"), (1, "q"), (2, "p"), (3, "z")], "s long, m string")
    wanted = spark.createDataFrame([("p",), ("q",)], "m string")
    assert rows(holds_these(members, "s", "m", wanted, True)) == [(1,)] and rows(holds_these(members, "s", "m", wanted, False)) == [(1,), (2,)]


def test_review_states_and_queues(spark):
    faces = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "face_id long, created_at long")
    log = spark.createDataFrame([(1, 1, "assign", 7, None), (2, 1, "reject", None, None), (3, 1, "undo", None, 2), (4, 2, "unknown", None, None), (5, 3, "assign", 8, None), (6, 3, "undo", None, 5)], "id long, face_id long, kind string, person_id long, reverses long")
    out = {x["face_id"]: (x["state"], x["assigned_person"]) for x in r.with_review_state(faces, log).collect()}
    assert out == {1: ("assigned", 7), 2: ("unknown", None), 3: ("unreviewed", None), 4: ("unreviewed", None)}
    with pytest.raises(ValueError):
        r.in_state("lost")
    page = r.page_with_total(r.where(r.with_review_state(faces, log), r.in_state("unreviewed")), [F.desc("created_at")], 0, 1).collect()
    assert [(p["face_id"], p["total"]) for p in page] == [(4, 2)]
    between = r.selection_range(faces.withColumn("q", F.lit(1)), [F.col("created_at")], "face_id", 3, 2, ["q"])
    assert [x[0] for x in rows(between.select("face_id"))] == [2, 3]
    named = spark.createDataFrame([("b",), (" ",), (None,), ("A",)], "n string").withColumn("id", F.monotonically_increasing_id()).select(r.shown_name(F.col("n")).alias("n"), "id")
    assert [x["n"] for x in named.orderBy(*r.name_order(F.col("n"), "id")).collect()] == ["A", "b", "Unnamed person", "Unnamed person"]


def test_conditional_inserts(spark):
    t = lambda *k: spark.createDataFrame([(x,) for x in k] or [], "k long")
    assert rows(r.insert_where(t(1), t(1, 2, 2, 3, 4), ["k"], t(2, 3), t(3))) == [(1,), (2,)]
    assert rows(r.next_ordinal(spark.createDataFrame([(1, 0), (1, 4), (2, None)], "f long, o int"), "f", "o")) == [(1, 5), (2, 0)]


def test_boxes_of_tiles_pixels_and_grids(spark):
    one = spark.range(1)
    c = lambda *v: [F.lit(float(x)) for x in v]
    size = (F.lit(100), F.lit(50))
    out = one.select(to_source(*c(10, 10, 40, 40), *c(80, 20), 1.0, *size).alias("a"), to_source(*c(30, 0, 10, 10), *c(80, 0), 1.0, *size).alias("b"), to_unit(*c(10, 10, 20, 20), *size).alias("u"), to_pixels(*c(0.101, 0.2, 0.2, 0.9), *size).alias("p"), to_unit(*c(1, 1, 1, 1), F.lit(0), F.lit(5)).alias("z")).collect()[0]
    assert tuple(out["a"]) == (90.0, 30.0, 10.0, 20.0) and out["b"] is None and tuple(out["u"]) == (0.1, 0.2, 0.2, 0.4) and tuple(out["p"]) == (10, 10, 21, 40) and out["z"] is None
    cells = spark.createDataFrame([("f", 8, 2, 3, 0.9, 1.6, 0.5, 0.5, 0.0, float(np.log(2))), ("f", 8, 2, 4, 0.1, 0.1, 0.0, 0.0, 0.0, 0.0)], "photo string, stride int, row int, col int, cls double, obj double, dx double, dy double, dw double, dh double")
    box = decode_grid(cells, 0.5).collect()
    assert len(box) == 1 and box[0]["score"] == pytest.approx(0.9**0.5) and [box[0][k] for k in "xywh"] == pytest.approx([24.0, 12.0, 8.0, 16.0])


def test_alignment_undoes_a_turn(spark):
    onto = [(38.3, 51.7), (73.5, 51.5), (56.0, 71.7), (41.5, 92.4), (70.7, 92.2)]
    turn, scale, shift = np.radians(30), 2.5, np.array([12.0, -7.0])
    m = scale * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    moved = (np.array(onto) - shift) @ np.linalg.inv(m).T
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in moved],), ([(1.0, 1.0)] * 5,), (None,)], "p array<struct<x:double,y:double>>")
    out = [x[0] for x in df.select(alignment(F.col("p"), onto)).collect()]
    assert tuple(out[0]) == pytest.approx((m[0, 0], m[1, 0], *shift)) and out[1] is None and out[2] is None


def test_evaluation_helpers(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("x",), ("z",)], "k string")
    assert overlap(a, b, "k").collect()[0][0] == 1 and tuple(same_rows(a, b).collect()[0]) == (2, 1) and tuple(same_rows(a, a).collect()[0]) == (0, 0)
    kinds = spark.createDataFrame([("p", "truth", 1, "matched"), ("p", "truth", 2, "missed"), ("p", "candidate", 5, "matched"), ("p", "candidate", 6, "false")], "photo string, side string, id long, kind string")
    photos = spark.createDataFrame([("p", "Big"), ("q", "big"), ("s", None)], "photo string, grp string")
    out = {x["grp"]: (x["photos"], x["faces"], x["matched"], x["recall"]) for x in detection_metrics(kinds, photos, 2).collect()}
    assert out == {"<overall>": (3, 2, 1, 0.5), "<2+ faces>": (1, 2, 1, 0.5), "big": (2, 2, 1, 0.5)}
    assert hash_sample(spark.range(40).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4).cast("string").alias("c")), "k", "c", "s", 3).count() == 12


def test_reports_sections_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b", c', None), (1, "x", True)], "n_id long, text_of string, ok boolean")
    sinks.write_report({"first_part": df}, str(tmp_path / "r.json"))
    first = (tmp_path / "r.json").read_bytes()
    sinks.write_report({"first_part": df.orderBy("text_of")}, str(tmp_path / "r.json"))
    assert first == (tmp_path / "r.json").read_bytes() and json.loads(first)["firstPart"][0] == {"nId": 1, "textOf": "x", "ok": True}
    sinks.write_sections({"overall": df, "none": df.limit(0)}, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_bytes() == '\ufeffoverall\r\nn_id,text_of,ok\r\n1,x,true\r\n2,"a ""b"", c",\r\n\r\nnone\r\nn_id,text_of,ok\r\n'.encode()
    with pytest.raises(ValueError):
        sinks.write_report({"a": df}, str(tmp_path / "x.json"), 1)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"').select("text_of")) == [('a "b", c',), ("x",)]
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2 and sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["r.json", "s.csv"]


def test_digest_of_inputs_counts_all_bits(spark):
    v = lambda *x: spark.createDataFrame([(k, a and list(a), "t") for k, a in x], "k string, v array<float>, kind string")
    base = v(("a", [0.1, 0.2]), ("b", [0.3]), ("c", None))
    assert base.select(sinks.float_bits("v")).collect()[0][0] == struct.pack(">ff", 0.1, 0.2).hex()
    one = sinks.input_digest(base, "k", "v", "kind").collect()
    assert one == sinks.input_digest(base.orderBy(F.desc("k")), "k", "v", "kind").collect() and one[0]["n"] == 3
    assert one != sinks.input_digest(v(("a", [float(np.nextafter(np.float32(0.1), np.float32(1))), 0.2]), ("b", [0.3]), ("c", None)), "k", "v", "kind").collect()


def test_bundles_that_are_written_are_read(spark, tmp_path):
    sinks.write_bundle(str(tmp_path / "b.zip"), {"in/a.bin": b"abc", "b.txt": b""}, job="j1")
    again = (tmp_path / "b.zip").read_bytes()
    sinks.write_bundle(str(tmp_path / "b.zip"), {"b.txt": b"", "in/a.bin": b"abc"}, job="j1")
    assert again == (tmp_path / "b.zip").read_bytes() and json.loads(zipfile.ZipFile(tmp_path / "b.zip").read("manifest.json"))["job"] == "j1"
    out = read_bundles(spark, str(tmp_path)).collect()
    assert {(x["name"], x["problem"]) for x in out} == {("in/a.bin", None), ("b.txt", None)}
    results = spark.createDataFrame([("r1", "d1"), ("r2", "old"), ("r9", "d9")], "rev string, digest string")
    good, bad = sinks.stale_results(results, spark.createDataFrame([("r1", "d1"), ("r2", "d2")], "rev string, digest string"), "rev", "digest")
    assert rows(good) == [("r1", "d1")] and {x["rev"]: x["problem"] for x in bad.collect()} == {"r2": "content has changed", "r9": "unknown revision"}


def test_manifest_header_wherever_it_stands(spark, tmp_path):
    head = "Sample ID;Image Name;Source Group;Primary Category;Countable Faces\n"
    p = tmp_path / "m.csv"
    p.write_text("note; of the session\n" * 500 + head + "s1;a.jpg;g;c;3\n\ns2;b.jpg;g;c;0\n", encoding="utf-8")
    assert [x["sample_id"] for x in read_manifest(spark, str(p)).collect()] == ["s1", "s2"]
    p.write_text(head + "s1;a.jpg;g;c;many\n", encoding="utf-8")
    with pytest.raises(Exception, match="row 2"):
        read_manifest(spark, str(p)).collect()


def test_folders_as_tables_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a.JPG", b"1"), ("b.heic", b"22"), ("c.txt", b"333"), ("d", b"4444")):
        (folder / name).write_bytes(content)
    assert rows(inventory(scan_folder(spark, str(folder)))) == [("<none>", "other", False, 1, 4), ("heic", "image", True, 1, 2), ("jpg", "image", True, 1, 1), ("txt", "other", False, 1, 3)]
    assert {x["content_sha256"] for x in hash_files(spark, str(folder)).collect()} >= {hashlib.sha256(b"22").hexdigest()}
    q = stream_folder(spark, str(folder), 2).select("size_bytes", "supported").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("seen")) == [(1, True), (2, True), (3, False), (4, False)]


def test_capture_metadata_by_precedence(spark):
    tags = [("a", "IFD0", "DateTime", "m"), ("a", "SubIFD", "DateTimeOriginal", "s"), ("a", "IFD0", "OffsetTime", "+02:00"), ("a", "GPS", "Latitude", "1.5"), ("a", "XMP", "Latitude", "2"), ("a", "XMP", "Longitude", "3"), ("b", "SubIFD", "DateTimeOriginal", " "), ("b", "XMP", "CreateDate", "x"), ("c", "GPS", "Latitude", "north")]
    out = rows(capture_metadata(spark.createDataFrame(tags, "k string, directory string, name string, value string"), "k"))
    assert out == [("a", "s", None, 2.0, 3.0), ("b", "x", None, None, None), ("c", None, None, None, None)]


def test_counts_by_event_time(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("select timestamp'2024-01-01 00:00:05' as ts, 'a' as kind union all select timestamp'2024-01-01 00:00:50', 'a' union all select timestamp'2024-01-01 00:05:00', 'b' union all select timestamp'2024-01-01 01:00:00', 'b'").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    q = counts_by_window(stream, "ts", "kind", "1 minute", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(x["kind"], x["n"]) for x in spark.table("counts").collect()} >= {("a", 2)}


def test_labels_name_the_city_that_a_geocoder_gave(spark):
    cases = [
        ("Sweden/Stockholms län/Stockholms stad/Vasastan", True, "Stockholm · Vasastan"), ("Sweden/Uppsala län/Uppsala stad/Fålhagen", True, "Uppsala · Fålhagen"), ("Sweden/Borås region/Borås stad/X", True, "Borå · X"),
        ("USA/New York/City of Albany/Pine Hills", True, "Albany · Pine Hills"), ("Japan/Kyoto City/Gion", True, "Kyoto · Gion"), ("Norway/Bergen municipality/Bergen", True, "Bergen municipality · Bergen"),
        ("Sweden/Stockholms stad/Vasastan", False, "Stockholms stad · Vasastan"), ("Places/Rome/rome", True, "rome"), ("Places/Italy", True, "Italy"), ("Places", True, None), (None, True, None),
    ]
    out = [x[0] for x in spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, p string, a boolean").orderBy("i").select(display_label(F.col("p"), F.col("a"))).collect()]
    assert out == [c[2] for c in cases]


def test_a_key_is_inserted_once_whatever_brings_it_again(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write = lambda n, *keys: spark.createDataFrame([(k, f"{n}") for k in keys], "k long, v string").coalesce(1).write.mode("append").parquet(src)
    run = lambda cp: insert_once(spark.readStream.schema("k long, v string").parquet(src), ["k"], out, str(tmp_path / cp), 4).awaitTermination(60)
    write(1, 1, 2, 2)
    run("a")
    write(2, 2, 3)
    run("a")
    run("b")  # from the start again
    assert rows(spark.read.parquet(out).select("k", "v")) == [(1, "1"), (2, "1"), (3, "2")]
