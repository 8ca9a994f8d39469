"""Table writes: batch replace, rebuilds, DDL, mark state, retention. The upsert is in ``versions.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.time import as_timestamp, iso_format, parse_instant


def replace_batch(df: DataFrame, path: str, partition_col: str = "batch_id") -> None:
    """Idempotent batch replace = dynamic partition overwrite on ``batch_id``.

    Only the partitions present in ``df`` are replaced; other batches stay. Staged files are
    committed per job, so a lost executor only re-runs tasks and a re-run gives the same table.
    An empty ``df`` leaves the table untouched.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_col).parquet(path))


def without_batch(raw: DataFrame, batch_id: str) -> DataFrame:
    """Every row except those of one batch (the delete half of the batch replace)."""
    return raw.filter(~F.col("batch_id").eqNullSafe(F.lit(batch_id)))


def append(df: DataFrame, path: str, partition_col: str | None = None) -> None:
    """Append."""
    w = df.write.mode("append")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def upsert_frames(target: DataFrame, source: DataFrame, key: str = "article_id") -> DataFrame:
    """J1 as a pure DataFrame function (no write): target rows not in source, plus source."""
    return target.join(source.select(key), key, "left_anti").unionByName(source.select(*target.columns))


def rebuild(df: DataFrame, path: str, partition_col: str | None = None) -> str:
    """Create-or-replace as select, always into a *new* location (never over its own input)."""
    w = df.write.mode("errorifexists")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)
    return path


# Table DDL. Partitioned and bucketed/sorted instead of the warehouse's CLUSTER BY.
RAW_DDL = """
CREATE TABLE IF NOT EXISTS IDENTIFIER(:name) (
  article_id STRING, title STRING, source_name STRING, source_id STRING, author STRING,
  description STRING, content STRING, url STRING, published_at TIMESTAMP, fetched_at TIMESTAMP,
  query STRING, language STRING, raw_payload STRING, batch_id STRING)
USING parquet PARTITIONED BY (batch_id) LOCATION '{location}'
"""

PROCESSED_DDL = """
CREATE TABLE IF NOT EXISTS IDENTIFIER(:name) (
  article_id STRING, title STRING, source_name STRING, published_at TIMESTAMP, content STRING,
  description STRING, content_length BIGINT, url STRING, sentiment_placeholder STRING,
  ingestion_batch_id STRING, query STRING, published_date DATE)
USING parquet PARTITIONED BY (published_date)
CLUSTERED BY (source_name) SORTED BY (source_name, sentiment_placeholder) INTO 8 BUCKETS
LOCATION '{location}'
"""

DAILY_DDL = """
CREATE TABLE IF NOT EXISTS IDENTIFIER(:name) (
  source_name STRING, article_count BIGINT, sentiment_ready_count BIGINT, published_date DATE)
USING parquet PARTITIONED BY (published_date) LOCATION '{location}'
"""


def create_table(spark: SparkSession, ddl: str, name: str, location: str) -> None:
    spark.sql(ddl.format(location=location.replace("'", "")), args={"name": name})


# ---- S12/S13: high-water mark as a one-row state table (name, value, updated_at) ------------

def state_row(spark: SparkSession, name: str, value, updated_at=None) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("name"), F.lit(value).cast("string").alias("value"),
                                 as_timestamp(updated_at).alias("updated_at"))


def read_mark(state: DataFrame, name: str, now=None, lookback_hours: int = 24) -> DataFrame:
    """Stored ISO value, else ``now - lookback``; an unparsable value also falls back.

    ``mark_source`` carries the warning as data: ``stored``, ``invalid_stored`` (a value that
    does not parse, replaced by the fallback) or ``lookback`` (nothing stored).
    """
    fallback = as_timestamp(now) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_hours))
    latest = state.filter(F.col("name") == name).agg(F.max_by("value", "updated_at").alias("stored"))
    parsed = parse_instant("stored")
    source = (F.when(parsed.isNotNull(), "stored").when(F.col("stored").isNotNull(), "invalid_stored")
              .otherwise("lookback"))
    return latest.select(F.lit(name).alias("name"), "stored", F.coalesce(parsed, fallback).alias("since"),
                         source.alias("mark_source"))


def next_mark(state: DataFrame, loaded: DataFrame, name: str, now=None, lookback_hours: int = 24,
              ts_col: str = "published_at") -> DataFrame:
    """The new mark = newest loaded ``published_at``; without loaded rows keep the old one.

    One aggregate over the union of the state rows and the loaded timestamps (no join).
    """
    fallback = as_timestamp(now) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_hours))
    s = state.filter(F.col("name") == name).select(
        F.col("value").alias("stored"), F.col("updated_at"), F.lit(None).cast("timestamp").alias("loaded"))
    l_ = loaded.select(F.lit(None).cast("string").alias("stored"), F.lit(None).cast("timestamp").alias("updated_at"),
                       F.col(ts_col).cast("timestamp").alias("loaded"))
    agg = s.unionByName(l_).agg(F.max_by("stored", "updated_at").alias("stored"), F.max("loaded").alias("loaded"))
    since = F.coalesce(parse_instant("stored"), fallback)
    return agg.select(
        F.lit(name).alias("name"), "stored", since.alias("since"),
        F.coalesce(iso_format("loaded"), F.col("stored")).alias("value"),
        as_timestamp(now).alias("updated_at"))


def retention_filter(df: DataFrame, now=None, days: int = 30, ts_col: str = "fetched_at") -> DataFrame:
    """Keep rows younger than ``days`` (the landing-zone lifecycle rule)."""
    cutoff = as_timestamp(now) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days))
    return df.filter(F.col(ts_col) >= cutoff)


def apply_retention(spark: SparkSession, path: str, new_path: str, now=None, days: int = 30,
                    ts_col: str = "fetched_at", partition_col: str = "batch_id") -> str:
    """S16 as a job: rewrite the unexpired rows to a new location (never in place)."""
    return rebuild(retention_filter(spark.read.parquet(path), now, days, ts_col), new_path, partition_col)


def write_indexed(df: DataFrame, path: str, sort_by, bloom=(), files: int | None = None) -> str:
    """Files sorted by ``sort_by`` (range-partitioned, so a value lies in few files and row groups) with Parquet
    bloom filters on the ``bloom`` columns: an equality lookup skips the row groups whose bounds or filters exclude it."""
    keys = [sort_by] if isinstance(sort_by, str) else list(sort_by)
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    w = dealt.sortWithinPartitions(*keys).write
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)
    return path


def write_bucketed(df: DataFrame, name: str, path: str, keys, buckets: int) -> DataFrame:
    """A table bucketed and sorted by ``keys`` (catalog table at ``path``).

    Joins and aggregations on ``keys`` against it reuse the bucket partitioning: only the other
    side is shuffled (into the same number of partitions), the big table never is.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    # one task per bucket, so one file per bucket
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(name))
    return df.sparkSession.table(name)
