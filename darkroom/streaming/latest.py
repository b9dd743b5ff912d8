"""Latest state of an action log that arrives as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from darkroom.operators.latest import latest_by_id


def keep_latest(stream: DataFrame, keys: list[str], id_column: str, folder: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Maintains below ``folder`` the row with the largest id of each key; call ``read_latest`` to read it.

    Each micro-batch is reduced to one row a key and appended to the parts of
    its keys; a batch that is replayed after a failure overwrites its own files,
    and the largest id wins whatever the order in which rows arrive, so late and
    repeated rows do no harm.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = latest_by_id(batch, keys, id_column).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark, folder: str, keys: list[str], id_column: str) -> DataFrame:  # noqa: ANN001
    """The state that ``keep_latest`` has built."""
    return latest_by_id(spark.read.parquet(folder).drop("part", "batch"), keys, id_column)


def counts_by_window(stream: DataFrame, time: str, kind: str, size: str, late: str) -> DataFrame:
    """Events of each kind in tumbling windows; rows later than ``late`` behind the newest are dropped, and state with them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def insert_once(stream: DataFrame, keys: list[str], folder: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Appends below ``folder`` the first row of each key: rows whose key came before, in this batch or an earlier one, are ignored.

    The keys themselves make it idempotent, so it doesn't matter which batch
    brings a row again, or whether the stream starts anew with an empty
    checkpoint. Only the parts of the batch's keys are read.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            # A batch that is replayed over its own files must not see them.
            known = spark.read.schema(rows.schema.add("batch", "string")).parquet(folder).filter(F.col("batch") != str(number) + "-" + run).select("part", *keys)
            rows = rows.join(known, ["part", *keys], "left_anti").select(*batch.columns, "part")
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/batch={number}-{run}")

    # One number of the checkpoint's life: the same for replays, another for a stream that starts anew.
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
