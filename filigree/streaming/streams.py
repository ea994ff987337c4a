"""Append-only logs as streams: counts by window and status, and the latest annotation of each item.

Each runs over what has arrived (``availableNow``) and keeps its progress in a folder that the caller
names, the same at every run, so that the next run goes on from there. Two queries read the whole
log from its start, with folders of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.lineage import new_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the pattern also fits a single file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def keep_changes(stream: DataFrame, target: str, progress: str) -> int:
    """Run an aggregating stream over what there is. Spark keeps the state; a batch writes the keys whose
    values it changed, in a folder of its own under ``target``, so that a batch that is done twice
    replaces itself. Gives the number of groups that came too late and were dropped.

    progress: a lasting folder that belongs to this stream and target, as below."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def kept(spark: SparkSession, target: str, key: list[str], schema: StructType) -> DataFrame:
    """The last value of every key that ``keep_changes`` wrote; before its first batch, no row."""
    path = target.rstrip("/")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    others = [f.name for f in schema if f.name not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*key, *[F.col("_last")[o].alias(o) for o in others]).select(*[f.name for f in schema])


def hourly(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts (window_start, status, n) of rows (ts, event_type) in tumbling hours. A row whose hour ended
    more than ``late`` before the newest row of an earlier batch is dropped."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "status", "n")


def last_of_users(rows: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type) of each user's last event by time and event_id."""
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("l"))
    return last.select("user_id", "l.event_id", "l.event_type")


def _from_the_start(stream: DataFrame, key: list[str], name: str) -> DataFrame:
    path = new_path(stream.sparkSession, name)
    keep_changes(stream, f"{path}/changes", f"{path}/progress")
    return kept(stream.sparkSession, f"{path}/changes", key, stream.schema)


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` of the events table."""
    return _from_the_start(hourly(event_stream(spark, sf_dir)), ["window_start", "status"], "gate-counts")


def latest_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``last_of_users`` of the events table; replaying the log gives the same."""
    return _from_the_start(last_of_users(event_stream(spark, sf_dir)), ["user_id"], "annotations")


def filing_intake(manifests: DataFrame, target: str, progress: str, late: str = "7 days") -> None:
    """Append filings of a stream (accession, content_hash, filed_at timestamp, ...) to ``target`` as they
    come, each (accession, content_hash) once within the watermark; later ones are for a batch run.

    progress: a lasting folder that belongs to this stream and target; a run goes on after the last
    that used it, and what a broken-off run left undone is done again."""
    once = manifests.withWatermark("filed_at", late).dropDuplicatesWithinWatermark(["accession", "content_hash"])
    query = once.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def snapshot_refresh(filings: DataFrame, all_filings: Callable[[], DataFrame], target: str, progress: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """For each batch of new filings rebuild the issuers that it touches, and replace their partitions.

    all_filings: gives the filings there are, read anew for each batch. build: from the filings of
    some issuers to rows with issuer_id; ``target`` is partitioned by it. progress: as above; a batch
    that is done twice replaces the same partitions by the same rows."""

    def refresh(batch: DataFrame, _: int) -> None:
        touched = batch.select("issuer_id").distinct()
        rows = build(all_filings().join(touched, "issuer_id", "left_semi"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issuer_id").parquet(target)

    query = filings.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(refresh).start()
    query.awaitTermination()
