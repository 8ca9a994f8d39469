"""ST1/ST2: incremental article ingestion on Structured Streaming.

Landed item files are the stream; the file source's checkpoint replaces the stored
high-water mark (S12/S13), so late-arriving files are still ingested. Each micro-batch writes
a version of its own, so a retried epoch replaces exactly what it wrote.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.ingest import build_raw_articles, keep_first_by_id, reclean_raw
from newsloom.operators.transform import daily_counts, processed_rows
from newsloom.sources import versions
from newsloom.streaming import BYTES_PER_TRIGGER, rocksdb_state

# Flat landed item (one JSON object per line).
FLAT_ITEM_SCHEMA = T.StructType([
    T.StructField("item_ord", T.LongType()), T.StructField("source_name", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("published_at_text", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("run_id", T.StringType())])


def land_items(items: DataFrame, path: str, parts: int = 4) -> None:
    """Land source items as JSON files in ``parts`` arrivals (``item_ord % parts``)."""
    for k in range(parts):
        items.filter(F.pmod(F.col("item_ord"), F.lit(parts)) == k).write.mode("append").json(path)


def item_stream(spark: SparkSession, path: str, bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    return (spark.readStream.schema(FLAT_ITEM_SCHEMA).option("maxBytesPerTrigger", bytes_per_trigger)
            .json(path))


def ingest_stream(spark: SparkSession, landing: str, raw_path: str, checkpoint: str, *, since=None,
                  fetched_at=None, bytes_per_trigger: int = BYTES_PER_TRIGGER):
    """ST1: items -> raw rows (P1-P4) per micro-batch, appended idempotently by run and epoch.

    A run is one checkpoint: a new checkpoint counts its epochs from 0 again and must not replace another run's.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        raw = build_raw_articles(batch, since=since, fetched_at=fetched_at)
        (raw.withColumn("epoch", F.lit(f"{run}-{epoch_id}")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(raw_path))

    q = (item_stream(spark, landing, bytes_per_trigger).writeStream.foreachBatch(write_epoch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def dedup_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, *, since=None, fetched_at=None,
                 delay: str = "31 days", bytes_per_trigger: int = BYTES_PER_TRIGGER):
    """ST2: streaming dedup by ``article_id`` within an event-time watermark.

    ``delay`` must cover the source's event-time disorder, or older duplicates count as late.
    Exactness across longer gaps still comes from the upsert (J1) downstream.
    """
    raw = build_raw_articles(item_stream(spark, landing, bytes_per_trigger), since=since, fetched_at=fetched_at)
    deduped = raw.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["article_id"])
    with rocksdb_state(spark):
        q = (deduped.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


PROCESSED_KEY, DAILY_KEY = "article_id", ["published_date", "source_name"]


def _schemas(spark: SparkSession, fetched_at) -> tuple[T.StructType, T.StructType]:
    empty = processed_rows(reclean_raw(build_raw_articles(spark.createDataFrame([], FLAT_ITEM_SCHEMA), fetched_at=fetched_at)),
                           carry=("item_ord",))
    return empty.schema, daily_counts(empty).schema


def processed_view(spark: SparkSession, path: str, where=None) -> DataFrame:
    """The processed table of the stream: of an id the newest row, then the lowest item ordinal (the keep-first rule),
    whichever epoch brought it."""
    schema, _ = _schemas(spark, None)
    order = [F.unix_micros("published_at"), -F.col("item_ord")]
    return versions.newest(versions.all_versions(spark, path, schema), PROCESSED_KEY, order, where).drop(versions.VERSION)


def daily_view(spark: SparkSession, path: str) -> DataFrame:
    """The daily counts of the stream: the newest count of a day and source. Counts only grow, so the largest is the newest."""
    _, schema = _schemas(spark, None)
    return versions.newest(versions.all_versions(spark, path, schema), DAILY_KEY, [F.col("article_count")]).drop(versions.VERSION)


def incremental_ingest(spark: SparkSession, landing: str, processed_path: str, daily_path: str, checkpoint: str, *,
                       since=None, fetched_at=None, bytes_per_trigger: int = BYTES_PER_TRIGGER):
    """ST1 with incremental ELT, merge-on-read.

    Per epoch: items -> raw rows (P1-P4) -> processed rows (P5, P6), appended as the epoch's version -> daily counts (A1) of
    the touched days, appended likewise. Tables are read through :func:`processed_view` and :func:`daily_view`. A version
    bears the name of its epoch and of the run (one checkpoint), so an epoch that failed at any point and is repeated writes
    the same two versions again, and nothing else is ever touched.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    schema, daily_schema = _schemas(spark, fetched_at)
    for path, s, keys, part in ((processed_path, schema, PROCESSED_KEY, "published_date"), (daily_path, daily_schema, DAILY_KEY, None)):
        versions.create(spark, path, s, keys, part)

    def epoch(batch: DataFrame, epoch_id: int) -> None:
        name = versions.version_name(epoch_id + 1, run)
        new = processed_rows(reclean_raw(build_raw_articles(batch, since=since, fetched_at=fetched_at)), carry=("item_ord",))
        versions.append_version(keep_first_by_id(new), processed_path, name, PROCESSED_KEY, "published_date", True)
        mine = spark.read.schema(schema).parquet(f"{processed_path}/{versions.VERSION}={name}")
        days = [r[0] for r in mine.select("published_date").distinct().collect()]          # partition values only
        if days:
            touched = processed_view(spark, processed_path, F.col("published_date").isin(days))
            versions.append_version(daily_counts(touched), daily_path, name, DAILY_KEY, None, True)

    q = (item_stream(spark, landing, bytes_per_trigger).writeStream.foreachBatch(epoch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
