"""ST3: streaming request rate with a watermark, merged into a windowed result table.

Update mode emits every window whose count changed in a micro-batch; each epoch appends those
rows (keyed by window and group) as a version of the result table, whose view takes the newest
row of each window. A retried epoch replaces its own version only. The watermark bounds the
state: windows older than it are finalised and dropped from state.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import label_regex_match
from newsloom.operators.telemetry import DEFAULT_BUCKETS, histogram_quantile, window_seconds
from newsloom.sources import versions
from newsloom.streaming import BYTES_PER_TRIGGER, rocksdb_state


# Longest time span of one arrival of land_by_time, and a margin.
ARRIVAL_DELAY = "7 days 10 minutes"


def land_by_time(df: DataFrame, path: str, ts: str = "ts", unit: str = "week") -> None:
    """Land a log as parquet files in time order (one arrival per ``unit``)."""
    # Only the distinct time-unit starts reach the driver (a few values), never the rows.
    starts = [r[0] for r in df.select(F.date_trunc(unit, ts).alias("u")).distinct().orderBy("u").collect()]
    for s in starts:
        df.filter(F.date_trunc(unit, ts) == F.lit(s)).write.mode("append").parquet(path)


def rate_stream(spark: SparkSession, landing: str, schema, result: str, checkpoint: str, *,
                length: str = "5 minutes", step: str = "1 minute", delay: str = ARRIVAL_DELAY,
                group_cols=("endpoint",), bytes_per_trigger: int = BYTES_PER_TRIGGER, buckets=DEFAULT_BUCKETS,
                status_regex: str = "5.."):
    """ST3: per (window, group): requests, rate, 5xx errors, latency sum and cumulative latency
    buckets ``_c0..`` (the inputs of the histogram quantile), in one streaming aggregation.

    Dashboard panels are batch reads of the result table: :func:`error_rate_from` and
    :func:`quantile_from` sum the groups per window. Files of one arrival are read in any order and may fall into
    several micro-batches, so ``delay`` must cover the time span of an arrival; then no event comes late.
    """
    # The delay keeps a week of windows open (10,080 a group, each with its sums), so the state lives in RocksDB, not on the heap.
    secs = window_seconds(length)
    events = (spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(landing)
              .withColumn("ts", F.col("ts").cast("timestamp")))
    lat = F.col("latency_s")
    counts = (events.withWatermark("ts", delay)
              .groupBy(F.window("ts", length, step).alias("window"), *group_cols)
              .agg(F.count(F.lit(1)).alias("requests"),
                   F.count_if(label_regex_match(F.col("status").cast("string"), status_regex)).alias("errors"),
                   F.sum(lat).alias("latency_sum"), F.count(lat).alias("latency_count"),
                   *[F.count_if(lat <= F.lit(b)).alias(f"_c{i}") for i, b in enumerate(buckets)]))
    key, run = ["window_start", *group_cols], hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    versions.create(spark, result, result_schema(group_cols, buckets), key, "window_date")

    def append_epoch(batch: DataFrame, epoch_id: int) -> None:
        upd = (batch.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                            *group_cols, "requests", F.round(F.col("requests") / F.lit(secs), 9).alias("rate"),
                            "errors", "latency_sum", "latency_count", *[f"_c{i}" for i in range(len(buckets))])
               .withColumn("window_date", F.to_date("window_start")))
        batch.persist()     # the key check and the write read it; recomputed from the same offsets if lost
        try:
            versions.append_version(upd, result, versions.version_name(epoch_id + 1, run), key, "window_date")
        finally:
            batch.unpersist()

    with rocksdb_state(spark):
        q = (counts.writeStream.outputMode("update").foreachBatch(append_epoch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def result_schema(group_cols=("endpoint",), buckets=DEFAULT_BUCKETS) -> T.StructType:
    groups = "".join(f"{g} string, " for g in group_cols)
    bounds = "".join(f"_c{i} bigint, " for i in range(len(buckets)))
    return T.StructType.fromDDL(f"window_start timestamp, window_end timestamp, {groups}requests bigint, rate double, errors bigint, "
                                f"latency_sum double, latency_count bigint, {bounds}window_date date")


def rate_view(spark: SparkSession, result: str, group_cols=("endpoint",), buckets=DEFAULT_BUCKETS) -> DataFrame:
    """The result table of :func:`rate_stream`. A window's count only grows, so its largest row is the newest."""
    rows = versions.all_versions(spark, result, result_schema(group_cols, buckets))
    return versions.newest(rows, ["window_start", *group_cols], [F.col("requests")]).drop(versions.VERSION)


def error_rate_from(result: DataFrame, length: str = "5 minutes") -> DataFrame:
    """W6 over the streamed window table: 5xx per window summed over groups (windows with errors)."""
    secs = window_seconds(length)
    e = result.groupBy("window_start", "window_end").agg(F.sum("errors").cast("bigint").alias("requests"))
    return e.filter(F.col("requests") > 0).withColumn("rate", F.round(F.col("requests") / F.lit(secs), 9))


def quantile_from(result: DataFrame, q: float = 0.95, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """W5 over the streamed window table: bucket counts summed over groups, then the quantile."""
    _, finish = histogram_quantile(q, ("window_start",), buckets)
    sums = result.groupBy("window_start", "window_end").agg(
        *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(buckets))], F.sum("latency_count").alias("_total"))
    return finish(sums)
