"""Landing zone: JSON-lines sink and schema-declared loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared schema of a landed source item (nested ``source``; timestamps stay text).
ITEM_SCHEMA = T.StructType([
    T.StructField("source", T.StructType([T.StructField("id", T.StringType()),
                                          T.StructField("name", T.StringType())])),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("content", T.StringType()),
])

# One landed page of a run: its items in source order. Items are VARIANT, so fields that no schema names survive.
PAGE_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("page", T.IntegerType()),
                            T.StructField("articles", T.ArrayType(T.VariantType()))])

# Declared schema of the raw article table (the load schema; never inferred).
RAW_SCHEMA = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("query", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
])

# ---- fixed values: JSON timestamp text (UTC, microseconds, explicit offset) ------------------
JSON_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# -----------------------------------------------------------------------------------------------


def read_items(spark: SparkSession, path: str, pages: bool = True) -> DataFrame:
    """Scan landed source pages (one JSON object per line) with the declared item schema.

    ``item_ord`` orders items by file name, block and line, however the scan is split into tasks.
    """
    df = spark.read.schema(ITEM_SCHEMA).json(path)
    df = df.select(
        F.col("source.name").alias("source_name"), F.col("source.id").alias("source_id"),
        "title", "url", F.col("publishedAt").alias("published_at_text"), "author", "description",
        "content", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    if pages:
        # the last part only orders lines of one block, which one task reads in order
        df = df.withColumn("item_ord", F.struct("_file", "_start", F.monotonically_increasing_id().alias("_line")))
    return df.drop("_start")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON record per run and page (``run_id, page, articles``); a page holds at most a page size."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def page_items(pages: DataFrame) -> DataFrame:
    """One row per item of the pages, with its position and, as ``raw_payload``, the whole source item."""
    text = lambda path, name: F.try_variant_get("_item", path, "string").alias(name)        # noqa: E731
    return pages.select("run_id", "page", F.posexplode("articles").alias("pos", "_item")).select(
        "run_id", "page", "pos", text("$.source.name", "source_name"), text("$.source.id", "source_id"), text("$.title", "title"),
        text("$.url", "url"), text("$.publishedAt", "published_at_text"), text("$.author", "author"),
        text("$.description", "description"), text("$.content", "content"), F.to_json("_item").alias("raw_payload"))


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = "batch_id", mode: str = "append") -> None:
    """One JSON object per line, instants as UTC ISO text, appended per batch."""
    w = df.write.mode(mode).option("timestampFormat", JSON_TIMESTAMP_FORMAT).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def load_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, strict: bool = False) -> DataFrame:
    """Load landed JSON lines with the declared schema.

    PERMISSIVE mode keeps malformed lines in ``_corrupt`` for quarantine; ``strict`` fails fast
    like a warehouse load job.
    """
    reader = spark.read.option("timestampFormat", JSON_TIMESTAMP_FORMAT)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    return (reader.schema(with_corrupt).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def load_rows(df: DataFrame, path: str, partition_by: str = "batch_id") -> None:
    """Direct load of rows into the raw table (same batch-replace contract as S6)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_by).parquet(path))


def split_corrupt(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S4 quarantine: (parsed rows, malformed lines).

    The parse is materialised once with a reliable checkpoint (shared checkpoint folder): Spark
    rejects plans over raw JSON that reference only the corrupt-record column, and both halves
    then read the same parsed rows instead of parsing twice.
    """
    loaded = loaded.checkpoint(eager=True)
    good = loaded.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    bad = loaded.filter(F.col("_corrupt").isNotNull())
    return good, bad
