"""Incremental imports with Structured Streaming.

Cells arrive as files; every micro-batch is checked and appended to the table under its batch id, so a batch that is
replayed after a failure replaces its own files only. Truncation (effective ends) is computed at reading, over all
data, so batches may come in any order of position."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir (in a local session where it is unset, a temporary one)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="locusweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def duplicates_in_batch(batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return batch.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(batch: DataFrame, before: DataFrame, stream: str, position: str) -> DataFrame:
    """The streams of a batch that begin before the end of what came before."""
    ends = before.groupBy(stream).agg(F.max(position).alias("_last"))
    return batch.groupBy(stream).agg(F.min(position).alias("_first")).join(ends, stream).where("_first < _last")


def start_import_stream(source: DataFrame, table: str, checkpoint: str, key: tuple[str, ...] = (), on_batch: Callable[[int], None] | None = None, available_now: bool = True, ordered: tuple[str, str] | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, partitioned by batch. key: columns that must be unique within a batch.
    ordered: (stream, position) columns: a stream (such as row_idx) whose batch begins before the end of what is in the
    table already is an error. on_batch is called with the id of each batch that is written; as a batch can be replayed,
    it may get the same id again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if key and not duplicates_in_batch(batch, key).isEmpty():
            raise ValueError(f"batch {batch_id} has cells that repeat {', '.join(key)}")
        if ordered and batch_id and not out_of_order(batch, batch.sparkSession.read.parquet(table).where(F.col("batch_id") < batch_id), *ordered).isEmpty():
            raise ValueError(f"batch {batch_id} has cells before those of earlier batches")
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table)
        if on_batch:
            on_batch(batch_id)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_all(spark: SparkSession, path: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Stream a Parquet source into a new table until it is read, and return the table."""
    schema = spark.read.parquet(path).schema
    table = shared_folder(spark, "stream-table")
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder if name.endswith(".parquet") else path)
    query = start_import_stream(source, table, shared_folder(spark, "stream-state"), key)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(table).drop("batch_id")


def import_samples(calls_of: Callable[[list[str]], DataFrame], samples: list[str], table: str, batch_size: int = 50, on_batch: Callable[[int], None] | None = None) -> None:
    """Import samples in batches: each batch's calls are one append, replaced as a whole if it's run again."""
    for number, a in enumerate(range(0, len(samples), batch_size)):
        calls_of(samples[a : a + batch_size]).withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table)
        if on_batch:
            on_batch(number)
