"""Incremental ingestion of source items into raw article rows.

Source items arrive as rows (landed JSON pages, see ``sources.landing``). Everything here is
one narrow projection/filter chain except the keep-first dedup, which is a single aggregate
shuffle on ``article_id`` with map-side combine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import (
    clean_or_default, clean_or_null, clean_text, normalize_batch_id, split_list,
)
from newsloom.functions.time import as_timestamp, iso_format, parse_instant
from newsloom.operators.late import pick_rows

# ---- fixed values ------------------------------------------------------------------------
DEFAULT_QUERY = "technology OR artificial intelligence OR machine learning"
UNKNOWN_SOURCE = "unknown"
FINGERPRINT_SEP = "|"
PAGE_SIZE = 100
MAX_PAGES = 5
# --------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class PipelineConfig:
    """Run parameters of the ingestion job, validated on construction (Q6 for configuration)."""
    query: str = DEFAULT_QUERY
    language: str = "en"
    page_size: int = PAGE_SIZE
    lookback_hours: int = 24
    sources: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not 1 <= self.page_size <= 100:
            raise ValueError(f"page_size must be within 1..100, got {self.page_size}")
        if self.lookback_hours < 1:
            raise ValueError(f"lookback_hours must be >= 1, got {self.lookback_hours}")

    @staticmethod
    def parse_sources(text: str | None) -> tuple[str, ...]:
        """``"a, b,,c"`` -> ``("a", "b", "c")`` (driver-side twin of :func:`split_list`)."""
        return tuple(p.strip() for p in (text or "").split(",") if p.strip())


RAW_COLUMNS = ["article_id", "title", "source_name", "source_id", "author", "description", "content",
               "url", "published_at", "fetched_at", "query", "batch_id", "language", "raw_payload"]

ITEM_FIELDS = ["source_name", "source_id", "title", "url", "published_at_text", "author",
               "description", "content"]


def article_fingerprint(source_name, title, url, published_at) -> Column:
    """sha256 hex of ``source|title|url|isoformat(published_at)`` (all parts non-NULL)."""
    return F.sha2(F.concat_ws(FINGERPRINT_SEP, source_name, title, url, iso_format(published_at)), 256)


def with_published_at(items: DataFrame, text_col: str = "published_at_text") -> DataFrame:
    """Parse the source timestamp (F4) next to the text."""
    return items.withColumn("published_at", parse_instant(F.col(text_col)))


def _ensure(items: DataFrame, name: str) -> DataFrame:
    return items if name in items.columns else items.withColumn(name, F.lit(None).cast("string"))


def build_raw_articles(items: DataFrame, *, since=None, run_id=None, query: str = DEFAULT_QUERY,
                       language=None, fetched_at=None) -> DataFrame:
    """Source items -> the 14-column raw article table.

    * P3: items without a parseable ``publishedAt`` are skipped (malformed text: see
      :func:`malformed_timestamps` for the quarantine side output).
    * P4: only ``published_at > since`` (strict). The page loop of a paged source stops at the
      first old item of a newest-first page; the declarative filter keeps every newer item,
      which is the same set on newest-first input and a superset otherwise.
    * P1: ``raw_payload`` is the whole source item where the scan kept it (``landing.page_items``), else its known fields;
      texts cleaned (F1), ``source_name`` defaults to ``unknown``, empty
      author/description/content -> NULL, fingerprint id (F5), constants.
    * P2: rows whose cleaned title or url is empty are dropped.
    ``run_id``/``language`` default to the item's own ``run_id``/``language`` columns.
    """
    for name in ITEM_FIELDS + ["run_id", "language"]:
        items = _ensure(items, name)
    df = items if "published_at" in items.columns else with_published_at(items)
    df = df.filter(F.col("published_at").isNotNull())
    if since is not None:
        df = df.filter(F.col("published_at") > as_timestamp(since))
    whole = F.col("raw_payload") if "raw_payload" in df.columns else F.to_json(F.struct(
        F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name")).alias("source"),
        "title", "url", "author", "description", "content", F.col("published_at_text").alias("publishedAt")))
    cleaned = df.select(
        *[c for c in ("item_ord",) if c in df.columns],
        clean_or_default("source_name", UNKNOWN_SOURCE).alias("source_name"),
        F.col("source_id"),
        clean_text("title").alias("title"),
        clean_text("url").alias("url"),
        clean_or_null("author").alias("author"),
        clean_or_null("description").alias("description"),
        clean_or_null("content").alias("content"),
        "published_at",
        as_timestamp(fetched_at).alias("fetched_at"),
        F.lit(query).alias("query"),
        normalize_batch_id(F.lit(run_id) if run_id is not None else F.col("run_id")).alias("batch_id"),
        (F.lit(language) if language is not None else F.col("language")).alias("language"),
        whole.alias("raw_payload"),
    ).filter((F.col("title") != "") & (F.col("url") != ""))
    out = cleaned.withColumn("article_id", article_fingerprint("source_name", "title", "url", "published_at"))
    extra = ["item_ord"] if "item_ord" in out.columns else []
    return out.select(*RAW_COLUMNS, *extra)


def malformed_timestamps(items: DataFrame, text_col: str = "published_at_text") -> DataFrame:
    """Quarantine side output of P3: non-empty timestamps that do not parse."""
    parsed = parse_instant(F.col(text_col))
    return (items.filter(F.nullif(F.trim(F.col(text_col)), F.lit("")).isNotNull() & parsed.isNull())
            .withColumn("reason", F.lit("unparseable publishedAt")))


def until_stop(pages: DataFrame, *, since, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """The pages a paged fetch would read, cut where it would stop.

    A run asks for pages 1, 2, ... up to ``max_pages``. It stops before an empty or absent page, after a page of fewer than
    ``page_size`` items, and inside a page at its first item that is not newer than ``since``; items without a readable
    timestamp don't stop it. No loop runs: every page says for itself whether it stops the run, the smallest such page and
    the first gap give each run's end, and the pages up to it stay. These steps see only (run, page, flags).
    """
    item_time = lambda a: parse_instant(F.try_variant_get(a, "$.publishedAt", "string"))            # noqa: E731
    old = F.transform(F.coalesce("articles", F.array()), lambda a: F.coalesce(item_time(a) <= as_timestamp(since), F.lit(False)))
    wanted = (pages.where(F.col("page").between(1, max_pages)).withColumn("articles", F.coalesce("articles", F.array()))
              .withColumn("_old", F.array_position(old, True).cast("int")))
    size = F.size("articles")
    flags = wanted.select("run_id", "page", ((size < page_size) | (F.col("_old") > 0)).alias("stops"))
    asked = flags.select("run_id", (F.col("page") + 1).alias("page")).unionAll(flags.select("run_id", F.lit(1).alias("page")).distinct())
    absent = (asked.join(flags.select("run_id", "page"), ["run_id", "page"], "left_anti")
              .select("run_id", (F.col("page") - 1).alias("last")))
    ends = (flags.where("stops").select("run_id", F.col("page").alias("last")).unionAll(absent)
            .groupBy("run_id").agg(F.min("last").alias("last")))
    kept = wanted.join(ends, "run_id").where("page <= last")
    cut = F.when(F.col("_old") > 0, F.slice("articles", F.lit(1), F.col("_old") - 1)).otherwise(F.col("articles"))
    return kept.select("run_id", "page", cut.alias("articles"))


def newest_items(items: DataFrame, k: int = PAGE_SIZE * MAX_PAGES) -> DataFrame:
    """The ``k`` newest source items (NULL timestamps last, then item order).

    The cap counts items *before* the required-field drops. Planned as a
    ``TakeOrderedAndProject``: each task keeps its own top-k, only k rows per task shuffle.
    """
    df = items if "published_at" in items.columns else with_published_at(items)
    return df.orderBy(F.col("published_at").desc_nulls_last(), F.col("item_ord").asc()).limit(k)


def newest_first(df: DataFrame) -> DataFrame:
    """O1: newest first, stable by item order; a presentation sort for final output only."""
    order = [F.col("published_at").desc_nulls_last()] + ([F.col("item_ord")] if "item_ord" in df.columns else [])
    return df.orderBy(*order)


def _first_order(raw: DataFrame) -> list[Column]:
    return [-F.unix_micros("published_at")] + ([F.col("item_ord")] if "item_ord" in raw.columns else [])


def keep_first_by_id(raw: DataFrame, key: str = "article_id") -> DataFrame:
    """Newest first (stable), keep the first row per ``article_id``; for rows that carry texts.

    The losers are found on (id, published_at, ordinal) and only their identities meet the wide rows, so no aggregate or sort
    ever holds a text. A hot id ships one narrow row per map task. Ordinals should be unique; of rows that share one, any stays.
    """
    return pick_rows(raw, key, _first_order(raw))


def keep_first_narrow(rows: DataFrame, key: str = "article_id") -> DataFrame:
    """W1 in one pass, for rows without texts (counts, metadata): ``min_by(row, (-published_at, item_ord))``, an aggregate
    with map-side combine, so the shuffle carries at most one row per key and map task."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return (rows.groupBy(key).agg(F.min_by(packed, F.struct(*_first_order(rows))).alias("_row"))
            .select("_row.*"))


def reclean_raw(raw: DataFrame) -> DataFrame:
    """P5: re-apply the text cleaning to a raw frame (idempotent)."""
    return raw.withColumns({
        "title": clean_text("title"),
        "source_name": clean_or_default("source_name", UNKNOWN_SOURCE),
        "author": clean_or_null("author"),
        "description": clean_or_null("description"),
        "content": clean_or_null("content"),
        "url": clean_text("url"),
    })


def filter_sources(items: DataFrame, sources: str, column: str = "source_name") -> DataFrame:
    """Restrict to a comma-separated source list (``"a, b,,c"``), compared cleaned."""
    wanted = split_list(F.lit(sources))
    return items.filter(F.array_contains(wanted, clean_text(column)))


def filter_language(items: DataFrame, language: str, column: str = "language") -> DataFrame:
    """The ``language`` request parameter as a filter (pushed into the scan)."""
    return items.filter(F.col(column) == F.lit(language))


def keyword_predicate(query: str, columns=("title", "description", "content")) -> Column:
    """``a OR b OR c`` -> case-insensitive phrase match in any of the text columns.

    The columns are lower-cased once, joined by NUL (which no phrase contains, so a phrase
    cannot match across two columns), and all phrases are one quoted alternation, so the
    (possibly long) text is scanned once per row however many phrases the query has.
    """
    phrases = [p.strip().lower() for p in query.split(" OR ") if p.strip()]
    if not phrases:
        return F.lit(False)
    text = F.lower(F.concat_ws("\u0000", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    pattern = "|".join("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in phrases)
    return text.rlike(pattern)


def filter_keywords(items: DataFrame, query: str = DEFAULT_QUERY, columns=("title", "description", "content")) -> DataFrame:
    return items.filter(keyword_predicate(query, columns))


def has_rows(df: DataFrame) -> bool:
    """The load branch; a one-row probe (``LIMIT 1``), never a full count."""
    return not df.isEmpty()
