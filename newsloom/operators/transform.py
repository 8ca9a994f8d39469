"""Processed projections (row path, ELT path, staging) and the daily aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean_text, trim_or_null, unicode_trim
from newsloom.functions.time import iso_format, utc_date
from newsloom.operators.late import pick_rows

# ---- fixed values ------------------------------------------------------------------------
SENTIMENT_PLACEHOLDER = "unknown"
TRAINING_SOURCE = "news_pipeline_processed_table"
FEATURE_HINT = "published_date, source_name, content_length, sentiment_placeholder"
# --------------------------------------------------------------------------------------------

PROCESSED_COLUMNS = ["article_id", "title", "source_name", "published_at", "published_date", "content",
                     "description", "content_length", "url", "sentiment_placeholder",
                     "ingestion_batch_id", "query"]


# three named content-length rules (they differ on untrimmed text; keep all three).
def content_length_a(content, description, cleaned: bool = False) -> Column:
    """Row path: ``len(clean(content) or clean(description) or "")``.

    ``cleaned=True`` states that both inputs already went through F1 (cleaning is idempotent),
    which saves a second regex pass over the text.
    """
    if cleaned:
        c = F.nullif(F.col(content) if isinstance(content, str) else content, F.lit(""))
        d = F.nullif(F.col(description) if isinstance(description, str) else description, F.lit(""))
    else:
        c = F.nullif(clean_text(content), F.lit(""))
        d = F.nullif(clean_text(description), F.lit(""))
    return F.length(F.coalesce(c, d, F.lit(""))).cast("bigint")


def content_length_b(content, description) -> Column:
    """ELT path: ``COALESCE(LENGTH(NULLIF(TRIM(content),'')), LENGTH(NULLIF(TRIM(desc),'')), 0)``."""
    return F.coalesce(F.length(trim_or_null(content)), F.length(trim_or_null(description)),
                      F.lit(0)).cast("bigint")


def content_length_c(content, description) -> Column:
    """Staging: ``length(coalesce(content, description, ''))`` on the untrimmed source."""
    return F.length(F.coalesce(F.col(content) if isinstance(content, str) else content,
                               F.col(description) if isinstance(description, str) else description,
                               F.lit(""))).cast("bigint")


def processed_rows(clean_raw: DataFrame, carry=()) -> DataFrame:
    """Cleaned raw rows (P5 output) -> processed articles (row path: NULL texts become '').

    ``carry`` names extra input columns to keep (e.g. the item ordinal for later merges).
    """
    return clean_raw.select(*carry,
        "article_id", "title", "source_name", "published_at",
        utc_date("published_at").alias("published_date"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("description", F.lit("")).alias("description"),
        content_length_a("content", "description", cleaned=True).alias("content_length"),
        "url", F.lit(SENTIMENT_PLACEHOLDER).alias("sentiment_placeholder"),
        F.col("batch_id").alias("ingestion_batch_id"), "query")


def elt_required(raw: DataFrame) -> DataFrame:
    """The five-column NOT NULL conjunction of the ELT source (blank titles pass)."""
    return raw.filter(F.col("article_id").isNotNull() & F.col("title").isNotNull()
                      & F.col("source_name").isNotNull() & F.col("published_at").isNotNull()
                      & F.col("url").isNotNull())


def latest_per_id(raw: DataFrame, key: str = "article_id") -> DataFrame:
    """One row per id, the latest load wins (``fetched_at desc, batch_id desc``); of equal loads the one whose row has
    the larger digest, so the result is the same however the rows are dealt.

    Losers are found on narrow columns (:func:`newsloom.operators.late.pick_rows`); texts meet no aggregate and no sort.
    """
    return pick_rows(raw, key, [F.col("fetched_at"), F.col("batch_id"), F.xxhash64(*raw.columns)], largest=True)


NARROW = ("article_id", "published_at", "fetched_at", "batch_id")


def elt_narrow(raw: DataFrame) -> DataFrame:
    """A2: the columns that daily counts need of the upsert source (P8, W2, P7), in one pass without texts: the length is
    taken before the dedup."""
    rows = elt_required(raw).select(*NARROW, F.xxhash64(*raw.columns).alias("_digest"), unicode_trim("source_name").alias("source_name"),
                                    content_length_b("content", "description").alias("content_length"))
    packed = F.struct("published_at", "source_name", "content_length")
    latest = rows.groupBy("article_id").agg(F.max_by(packed, F.struct("fetched_at", "batch_id", "_digest")).alias("_r"))
    return latest.select("article_id", utc_date(F.col("_r.published_at").cast("timestamp")).alias("published_date"),
                         "_r.source_name", "_r.content_length")


def elt_projection(raw: DataFrame) -> DataFrame:
    """The ELT source projection (Unicode TRIM, NULLIF, content_length rule B)."""
    return raw.select(
        "article_id",
        unicode_trim("title").alias("title"),
        unicode_trim("source_name").alias("source_name"),
        F.col("published_at").cast("timestamp").alias("published_at"),
        utc_date(F.col("published_at").cast("timestamp")).alias("published_date"),
        trim_or_null("content").alias("content"),
        trim_or_null("description").alias("description"),
        content_length_b("content", "description").alias("content_length"),
        unicode_trim("url").alias("url"),
        F.lit(SENTIMENT_PLACEHOLDER).alias("sentiment_placeholder"),
        F.col("batch_id").alias("ingestion_batch_id"),
        "query")


def elt_source(raw: DataFrame) -> DataFrame:
    """The upsert source: P8, then W2 (unique ids), then P7."""
    return elt_projection(latest_per_id(elt_required(raw)))


def staging(raw: DataFrame) -> DataFrame:
    """The staging view (no filter, no dedup, content_length rule C on source columns)."""
    return raw.select(
        "article_id",
        unicode_trim("title").alias("title"),
        unicode_trim("source_name").alias("source_name"),
        "source_id",
        trim_or_null("author").alias("author"),
        trim_or_null("description").alias("description"),
        trim_or_null("content").alias("content"),
        unicode_trim("url").alias("url"),
        "published_at", "fetched_at", "query", "batch_id", "language", "raw_payload",
        utc_date("published_at").alias("published_date"),
        content_length_c(raw["content"], raw["description"]).alias("content_length"))


def daily_counts(processed: DataFrame) -> DataFrame:
    """A1/A2: per (published_date, source_name): rows, rows with content_length > 0."""
    return processed.groupBy("published_date", "source_name").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.count_if(F.col("content_length") > 0).alias("sentiment_ready_count"))


def daily_mart(staged: DataFrame) -> DataFrame:
    """A3: A2 plus ``count(distinct article_id)`` over staging (not deduplicated)."""
    return staged.groupBy("published_date", "source_name").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.count_if(F.col("content_length") > 0).alias("sentiment_ready_count"),
        F.count_distinct("article_id").alias("distinct_article_count"))


def mart_delta(staged: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3 per arrival: ``(new_ids, delta)``. ``known`` holds the (published_date, source_name, article_id) of earlier arrivals;
    new ids are those of this arrival that it lacks. The delta of a day and source adds rows, rows with content and new ids."""
    day = ["published_date", "source_name"]
    ids = staged.where("article_id is not null").select(*day, "article_id").distinct()
    old = known.select(*[F.col(c).alias(f"_k_{c}") for c in (*day, "article_id")])
    same = F.lit(True)
    for c in (*day, "article_id"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    new = ids.join(old, same, "left_anti")
    counts = staged.groupBy(*day).agg(F.count(F.lit(1)).alias("article_count"),
                                      F.count_if(F.col("content_length") > 0).alias("sentiment_ready_count"))
    parts = (counts.withColumn("distinct_article_count", F.lit(0).cast("bigint"))
             .unionByName(new.groupBy(*day).agg(F.lit(0).cast("bigint").alias("article_count"), F.lit(0).cast("bigint").alias("sentiment_ready_count"),
                                                F.count(F.lit(1)).alias("distinct_article_count"))))
    return new, mart_total(parts)


def mart_total(deltas: DataFrame) -> DataFrame:
    """A3: the mart as the sum of its arrivals' deltas."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("article_count", "sentiment_ready_count", "distinct_article_count")]
    return deltas.groupBy("published_date", "source_name").agg(*sums)


def batch_summary(processed: DataFrame) -> DataFrame:
    """A4: row count, distinct sources (count and sorted list), newest ``published_at`` as ISO."""
    per_source = processed.groupBy("source_name").agg(F.count(F.lit(1)).alias("_n"), F.max("published_at").alias("_latest"))
    return per_source.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("article_count"),
        F.count("source_name").alias("source_count"),
        F.array_sort(F.collect_list("source_name")).alias("sources"),           # one row per source
        iso_format(F.max("_latest")).alias("latest_published_at"))


def quality_summary(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """A5: raw vs cleaned counts, duplicates, dedup rate (1.0 on empty input).

    Both counts come from one aggregate over a tagged union (no join of the two results).
    """
    tagged = (raw.select(F.lit(True).alias("_raw"))
              .unionByName(cleaned.select(F.lit(False).alias("_raw"))))
    out = tagged.agg(F.count_if(F.col("_raw")).alias("raw_article_count"),
                     F.count_if(~F.col("_raw")).alias("cleaned_article_count"))
    return out.select(
        "raw_article_count", "cleaned_article_count",
        F.greatest(F.col("raw_article_count") - F.col("cleaned_article_count"), F.lit(0)).alias("duplicate_article_count"),
        F.when(F.col("raw_article_count") == 0, F.lit(1.0))
         .otherwise(F.round(F.col("cleaned_article_count") / F.col("raw_article_count"), 4)).alias("deduplication_rate"))


def training_snapshot(processed: DataFrame) -> DataFrame:
    """The six training columns, ``published_date`` as ISO text."""
    return processed.select("article_id", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"),
                            "source_name", "content_length", "sentiment_placeholder", "query")


def training_metadata(processed: DataFrame) -> DataFrame:
    """Constant source, row count, newest ``published_at`` (ISO or NULL), feature hint."""
    return processed.agg(
        F.count(F.lit(1)).alias("article_count"),
        iso_format(F.max("published_at")).alias("latest_published_at"),
    ).select(F.lit(TRAINING_SOURCE).alias("training_source"), "article_count", "latest_published_at",
             F.lit(FEATURE_HINT).alias("feature_hint"))
