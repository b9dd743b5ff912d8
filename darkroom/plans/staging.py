"""Cutting lineage by tables in a folder that all executors share.

Iterative operators write each round's state as Parquet and read it again. The
copy survives the loss of executors, lets every round be planned on real sizes,
and holds compressed columns rather than serialised rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="darkroom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    """Deletes what this process has staged; in a long session ``Staging.close`` does so earlier."""
    for spark, root in _roots:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the session may have gone before
            pass


atexit.register(_sweep)


class Staging:
    """Named tables of one run of an operator, below the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _roots.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table that was written."""
        return self.observed(df)[0]

    def observed(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """Write ``df``; the table that was written, and its number of ``rows`` and ``measures``, which the write itself counts."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path  # type: ignore[attr-defined]
        return out, seen.get

    def close(self) -> None:
        """Delete all tables of this run, where no plan reads them any more."""
        _delete(self.spark, self.root)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            path = getattr(t, "_staged_at", None)
            if path:
                _delete(self.spark, path)
