"""Streams: incremental indexing as micro-batches, and (beyond the reference) windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators.store import Store, upsert


def follow_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of a folder as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)


def index_incrementally(files: DataFrame, store: Store, make: Callable[[DataFrame], dict[str, tuple[DataFrame, list[str]]]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch's tables (frame and key columns by name) take the place of rows with the same keys in a new
    snapshot; a batch that fails leaves the store as it was and comes again."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        out = {}
        for name, (frame, keys) in make(batch).items():
            old = store.read(name)
            out[name] = frame if old is None else upsert(old, frame, keys)
        store.write(**out)

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
