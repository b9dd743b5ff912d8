"""Files as tables: folders, manifests, evaluation sets and bundles."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The media types of the file extensions that hold pictures.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "heic": "image/heic", "heif": "image/heif"}


def media_type(path):  # noqa: ANN001, ANN201 - a Column of paths
    """The media type of a path by its extension; null where it isn't a picture's."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, modified_at, extension, media_type, supported) of all files below a folder.

    Only names and sizes are read: the contents' column is pruned from the scan.
    Files of no length aren't listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = media_type(F.col("path"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.when(ext == "", "<none>").otherwise(ext).alias("extension"), kind.alias("media_type"), kind.isNotNull().alias("supported"))


def hash_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content_sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("content_sha256"))


#: Columns that a manifest must have, and those that it may have.
MANIFEST = {"sample id": "sample_id", "image name": "image_name", "source group": "source_group", "primary category": "primary_category", "countable faces": "countable_faces"}
MANIFEST_OPTIONAL = {"sample group": "sample_group", "source sha-256": "source_sha256"}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of samples: ``;`` or ``,`` between fields, quotes, a BOM, and any lines before the header are allowed.

    The header is the first line that has all columns, wherever it stands. A
    manifest is one file of a session's samples, so one task reads it whole; a
    row without an id or with a number of faces that is none is an error that
    names the row.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = MANIFEST | MANIFEST_OPTIONAL
        for frame in frames:
            for content in frame["content"]:
                text = bytes(content).decode("utf-8-sig")
                found = None
                for sep in (";", ","):
                    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
                    for i, row in enumerate(rows):
                        names = [c.strip().lower() for c in row]
                        if set(MANIFEST) <= set(names):
                            found = (rows[i + 1 :], names, i + 1) if found is None or i + 1 < found[2] else found
                            break
                if found is None:
                    raise ValueError("no header with the manifest's columns")
                out = []
                for number, row in enumerate(found[0], found[2] + 1):
                    if not any(c.strip() for c in row):
                        continue
                    own = {known[n]: c.strip() or None for n, c in zip(found[1], row) if n in known}
                    faces = own.get("countable_faces") or ""
                    if not own.get("sample_id") or not faces.isdecimal():
                        raise ValueError(f"row {number} of the manifest has no sample id or no number of faces")
                    out.append({**{c: own.get(c) for c in known.values()}, "countable_faces": int(faces)})
                yield pd.DataFrame(out, columns=list(known.values()))

    columns = [*MANIFEST.values(), *MANIFEST_OPTIONAL.values()]
    schema = ", ".join(f"{c} {'int' if c == 'countable_faces' else 'string'}" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


_FACE = "struct<faceId:string,personId:string,embedding:array<float>>"
_SAMPLE = "struct<sampleId:string,expectedPersonId:string,faceExpected:boolean,faceDetected:boolean,embedding:array<float>,elapsedMilliseconds:double>"


def read_evaluation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The gallery, validation and test sets and the thresholds of an evaluation file, as tables."""
    whole = spark.read.schema(f"schemaVersion int, datasetId string, pipelineVersion string, thresholds array<double>, gallery array<{_FACE}>, validation array<{_SAMPLE}>, test array<{_SAMPLE}>").json(path, multiLine=True)
    out = {k: whole.select(F.explode(k).alias("r")).select("r.*") for k in ("gallery", "validation", "test")}
    return out | {"thresholds": whole.select(F.explode("thresholds").alias("threshold"))}


def _unsafe(name: str) -> bool:
    clean = posixpath.normpath(name)
    return "\\" in name or ":" in name or name.startswith("/") or clean.startswith("..") or clean != name.rstrip("/")


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, name, length, sha256, problem) of every file in the ZIP bundles of a folder, held against each bundle's manifest.json.

    problem is null, or says that the path is unsafe, the file isn't listed or
    is missing, or its length or digest differs. A bundle is one task's work.
    """

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    listed = {e["path"]: e for e in json.loads(z.read("manifest.json"))["files"]}
                    for info in z.infolist():
                        if info.filename == "manifest.json" or info.is_dir():
                            continue
                        want = listed.pop(info.filename, None)
                        if _unsafe(info.filename):
                            rows.append((path, info.filename, info.file_size, None, "unsafe path"))
                            continue
                        digest = hashlib.sha256()
                        with z.open(info) as f:
                            while part := f.read(1 << 20):
                                digest.update(part)
                        problem = "not listed" if want is None else "length" if want["length"] != info.file_size else "digest" if want["sha256"] != digest.hexdigest() else None
                        rows.append((path, info.filename, info.file_size, digest.hexdigest(), problem))
                    rows += [(path, name, None, None, "missing") for name in listed]
                except (zipfile.BadZipFile, KeyError, ValueError, TypeError) as e:
                    rows.append((path, None, None, None, f"unreadable: {type(e).__name__}"))
                yield pd.DataFrame(rows, columns=["bundle", "name", "length", "sha256", "problem"]).astype({"length": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(check, "bundle string, name string, length long, sha256 string, problem string")


def stream_folder(spark: SparkSession, folder: str, most_a_batch: int = 1_000) -> DataFrame:
    """The same columns as ``scan_folder``, as a stream of the files that arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_a_batch).load(folder)
    kind, ext = media_type(F.col("path")), F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.when(ext == "", "<none>").otherwise(ext).alias("extension"), kind.alias("media_type"), kind.isNotNull().alias("supported"))


def inventory(files: DataFrame) -> DataFrame:
    """(extension, family, supported, files, bytes) of what ``scan_folder`` found."""
    family = F.coalesce(F.regexp_extract("media_type", "^[^/]+", 0), F.lit("other"))
    return files.groupBy("extension", family.alias("family"), "supported").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def capture_metadata(tags: DataFrame, key: str) -> DataFrame:
    """(key, taken, offset, latitude, longitude) of a picture's raw tags (key, directory, name, value), by precedence.

    A time in the EXIF sub-directory comes first, then one in the main
    directory, then XMP's; a position needs both coordinates of one directory.
    """
    pick = lambda directory, name: F.max(F.when((F.col("directory") == directory) & (F.col("name") == name), F.nullif(F.trim("value"), F.lit(""))))
    wide = tags.groupBy(key).agg(
        pick("SubIFD", "DateTimeOriginal").alias("s"), pick("SubIFD", "OffsetTimeOriginal").alias("so"), pick("IFD0", "DateTime").alias("m"), pick("IFD0", "OffsetTime").alias("mo"), pick("XMP", "CreateDate").alias("x"),
        *[pick(d, n).try_cast("double").alias(f"{d}_{n}".lower()) for d in ("GPS", "XMP") for n in ("Latitude", "Longitude")],
    )
    offset = F.when(F.col("s").isNotNull(), F.col("so")).when(F.col("m").isNotNull(), F.col("mo"))
    gps = F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull()
    xmp = F.col("xmp_latitude").isNotNull() & F.col("xmp_longitude").isNotNull()
    place = lambda n: F.when(gps, F.col(f"gps_{n}")).when(xmp, F.col(f"xmp_{n}"))
    return wide.select(key, F.coalesce("s", "m", "x").alias("taken"), offset.alias("offset"), place("latitude").alias("latitude"), place("longitude").alias("longitude"))
