"""Results as files: reports, CSV in sections, collection manifests, evaluation manifests with a digest, bundles."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import tempfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _replace(path: str, content: bytes) -> None:
    """Writes beside the target and renames, so that nobody sees half a file."""
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def write_report(parts: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """A JSON report: each part's rows in the order of their columns, keys in camel case, the same bytes for the same rows.

    A report is for people, so a part of more than ``most`` rows is an error.
    """
    out = {}
    for name, rows in parts.items():
        found = rows.orderBy(*rows.columns).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} has more than {most} rows: write it as a table")
        out[_camel(name)] = [{_camel(k): v for k, v in r.asDict(recursive=True).items()} for r in found]
    _replace(path, (json.dumps(out, indent=2, ensure_ascii=False, default=str) + "\n").encode())


def _field(value: object) -> str:
    text = "" if value is None else "true" if value is True else "false" if value is False else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def write_sections(parts: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """One CSV file (RFC 4180, with a BOM) of several sections, each with its name and header; for reports of ``most`` rows a part."""
    lines = []
    for name, rows in parts.items():
        found = rows.orderBy(*rows.columns).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} has more than {most} rows: use write_csv")
        lines += [_field(name), ",".join(map(_field, rows.columns)), *[",".join(map(_field, r)) for r in found], ""]
    _replace(path, b"\xef\xbb\xbf" + "\r\n".join(lines).encode())


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows of any number as CSV with quotes doubled; parts in a folder, written by the tasks."""
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """A collection of any size as lines of JSON, all pages of it; nulls are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


@F.pandas_udf(T.StringType())
def float_bits(vector: pd.Series) -> pd.Series:
    """The bits of an array of float32 numbers as hexadecimal digits, most significant first."""
    return vector.map(lambda v: None if v is None else b"".join(struct.pack(">f", x) for x in v).hex())


def input_digest(samples: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """(n, digest) of samples whatever their order: numbers count with all their bits.

    Samples are spread over 65,536 groups by the digest of their line; only the
    groups' digests meet in one row.
    """
    line = F.concat_ws("|", F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others], F.coalesce(float_bits(F.col(vector)), F.lit("")))
    lines = samples.select(F.sha2(line, 256).alias("d"))
    groups = lines.groupBy(F.substring("d", 1, 4).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("d"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(joined, 256).alias("digest"))


def write_bundle(path: str, files: dict[str, bytes], **about: object) -> None:
    """A ZIP with a manifest.json of every file's length and SHA-256, as ``files.read_bundles`` checks it; the same bytes for the same files."""
    listed = [{"path": n, "length": len(c), "sha256": hashlib.sha256(c).hexdigest()} for n, c in sorted(files.items())]
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    os.close(handle)
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in [("manifest.json", json.dumps(about | {"files": listed}, indent=2, sort_keys=True).encode()), *sorted(files.items())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    os.replace(part, path)


def stale_results(results: DataFrame, revisions: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(results to import, those refused): a result counts only for the very content that it was made from."""
    known = revisions.select(F.col(key), F.col(digest).alias("__now")).distinct()
    joined = results.join(known, key, "left")
    same = F.coalesce(F.col("__now") == F.col(digest), F.lit(False))
    reason = F.when(F.col("__now").isNull(), "unknown revision").otherwise("content has changed")
    return joined.filter(same).drop("__now"), joined.filter(~same).withColumn("problem", reason).drop("__now")
