"""The query registry: one entry per operator group of the blueprint.

Each entry takes ``(spark, sf_dir)``, reads the given tables (through the adapters of
``sources.fixtures``) and returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import unicode_trim
from newsloom.operators import chat, extract, graph, ingest, ml, quality, search, telemetry, transform
from newsloom.operators.late import distinct_rows
from newsloom.plans import models
from newsloom.plans import params as P
from newsloom.plans.output import finalize
from newsloom.session import ensure_session_defaults, scratch_path
from newsloom.sources import fixtures as fx
from newsloom.sources import audit, landing, storage, versions
from newsloom.sources.tables import read_table
from newsloom.streaming import audit as s_audit
from newsloom.streaming import ingest as s_ingest
from newsloom.streaming import telemetry as s_tel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session_defaults(spark)
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---- news ingestion (row path) ---------------------------------------------------------------

def raw_items(spark, d) -> DataFrame:
    return ingest.build_raw_articles(fx.items(spark, d), since=P.SINCE, fetched_at=P.AS_OF)


def clean_items(spark, d) -> DataFrame:
    return ingest.reclean_raw(ingest.keep_first_by_id(raw_items(spark, d).drop("raw_payload")))


def processed_items(spark, d) -> DataFrame:
    return transform.processed_rows(clean_items(spark, d))


def processed_narrow(spark, d) -> DataFrame:
    """The processed rows without their texts: the projection, lengths included, comes before the dedup."""
    rows = transform.processed_rows(ingest.reclean_raw(raw_items(spark, d)), carry=("item_ord",))
    return ingest.keep_first_narrow(rows.drop("title", "content", "description", "url"))


@register("raw_articles")
def q_raw_articles(spark, d):
    """Source items -> raw article rows."""
    return raw_items(spark, d).drop("raw_payload")


@register("dedup_keep_first")
def q_dedup_keep_first(spark, d):
    """Newest-first keep-first dedup by article id."""
    return clean_items(spark, d)


@register("processed_articles")
def q_processed_articles(spark, d):
    """P6, F6-A, F8, F11: processed rows (row path)."""
    return processed_items(spark, d)


@register("daily_counts")
def q_daily_counts(spark, d):
    """A1: daily counts per source over the processed rows."""
    return transform.daily_counts(processed_narrow(spark, d))


@register("newest_items_topk")
def q_newest_items_topk(spark, d):
    """The newest 500 source items before any drop (the page cap)."""
    top = ingest.newest_items(fx.items(spark, d))
    return top.select("item_ord", "published_at_text", "published_at", "title")


@register("batch_summary")
def q_batch_summary(spark, d):
    """Count, distinct sources, sorted source list, newest instant as ISO."""
    s = transform.batch_summary(processed_narrow(spark, d))
    return s.select("article_count", "source_count", F.to_json("sources").alias("sources_json"),
                    "latest_published_at")


@register("quality_summary")
def q_quality_summary(spark, d):
    """Raw vs cleaned counts and the dedup rate."""
    raw = raw_items(spark, d)
    return transform.quality_summary(raw, ingest.keep_first_narrow(raw.select("article_id", "published_at", "item_ord")))


@register("training_metadata")
def q_training_metadata(spark, d):
    """Training hand-off metadata."""
    return transform.training_metadata(processed_narrow(spark, d))


@register("training_snapshot")
def q_training_snapshot(spark, d):
    """The training snapshot rows."""
    return transform.training_snapshot(processed_narrow(spark, d))


@register("keyword_filter")
def q_keyword_filter(spark, d):
    """Keyword query (``a OR b``) as case-insensitive phrase matches over the raw rows."""
    return ingest.filter_keywords(raw_items(spark, d), P.KEYWORDS).select("article_id", "title", "source_name")


@register("source_list_filter")
def q_source_list_filter(spark, d):
    """Configured source list (blanks and empties cleaned) as a filter."""
    return ingest.filter_sources(raw_items(spark, d), P.SOURCE_LIST).select("article_id", "source_name", "url")


@register("language_filter")
def q_language_filter(spark, d):
    """The language parameter as a filter."""
    return ingest.filter_language(raw_items(spark, d), P.LANGUAGE).select("article_id", "language", "title")


# ---- ELT path, staging and mart over the landed raw table -------------------------------------

@register("elt_processed")
def q_elt_processed(spark, d):
    """P7, P8, F2, F6-B, W2: the upsert source of the ELT."""
    return transform.elt_source(fx.raw_landed(spark, d))


@register("stg_articles")
def q_stg_articles(spark, d):
    """P9, F6-C: the staging view."""
    return transform.staging(fx.raw_landed(spark, d)).drop("raw_payload")


@register("fct_daily_counts")
def q_fct_daily_counts(spark, d):
    """A3: daily mart over staging (adds the distinct id count)."""
    return transform.daily_mart(transform.staging(fx.raw_landed(spark, d)))


@register("retention_filter")
def q_retention_filter(spark, d):
    """Landing rows younger than 30 days at the run instant."""
    kept = storage.retention_filter(fx.raw_landed(spark, d), P.RETENTION_AS_OF, P.RETENTION_DAYS)
    return kept.select("article_id", "batch_id", "fetched_at", "url")


@register("watermark_next")
def q_watermark_next(spark, d):
    """Read the stored mark, load newer rows, write the next mark."""
    state = storage.state_row(spark, P.MARK_NAME, ingest_iso(P.SINCE), P.SINCE)
    return storage.next_mark(state, raw_items(spark, d), P.MARK_NAME, now=P.AS_OF)


def ingest_iso(text: str) -> str:
    return text.replace(" ", "T") + "+00:00"


# ---- storage round trips -------------------------------------------------------------------------

@register("landing_roundtrip")
def q_landing_roundtrip(spark, d):
    """Land raw rows as JSON lines per batch, load them back typed."""
    raw = raw_items(spark, d).drop("item_ord")
    path = scratch_path(spark, "landing")
    landing.write_jsonl(raw, path)                                        # one folder per run
    back = landing.load_jsonl(spark, path)
    return distinct_rows(back.drop("raw_payload", "_corrupt"))


@register("model_build")
def q_model_build(spark, d):
    """Staging view -> mart table through the model registry."""
    reg = (models.ModelRegistry(spark)
           .source("news_articles_raw", fx.raw_landed(spark, d))
           .model("stg_news_articles", ["news_articles_raw"], transform.staging, "view")
           .model("staged_days", ["stg_news_articles"], DAYS_SQL, "table")
           .model("fct_daily_article_counts", ["stg_news_articles"], transform.daily_mart, "table"))
    mart, days = reg.ref("fct_daily_article_counts"), reg.ref("staged_days")
    return mart.join(days.select("published_date"), mart["published_date"].eqNullSafe(days["published_date"]), "left_semi")


# A small SQL model of our own: the days of the staging view, for the parameterised-SQL form of a model.
DAYS_SQL = "SELECT published_date, count(*) AS staged_rows FROM IDENTIFIER(:stg_news_articles) GROUP BY published_date"


@register("elt_upsert")
def q_elt_upsert(spark, d):
    """Batch 1, then batch 2 as versions of the processed table; its view holds the newest row per id."""
    raw = fx.raw_landed(spark, d)
    path = scratch_path(spark, "processed")
    for n, batch in enumerate(("batch_1", "batch_2"), 1):
        source = transform.elt_source(raw.filter(F.col("batch_id") == batch))
        versions.upsert(spark, path, source, versions.version_name(n))
    rows = versions.all_versions(spark, path, source.schema)
    return versions.newest(rows, "article_id").drop(versions.VERSION)


@register("upsert_compacted")
def q_upsert_compacted(spark, d):
    """The same table after the compaction job, which writes the newest rows to a new place."""
    raw = fx.raw_landed(spark, d)
    path = scratch_path(spark, "processed")
    for n, batch in enumerate(("batch_1", "batch_2"), 1):
        source = transform.elt_source(raw.filter(F.col("batch_id") == batch))
        versions.upsert(spark, path, source, versions.version_name(n))
    small = versions.compact(spark, path, scratch_path(spark, "compacted"), source.schema, "article_id", partition_col="published_date")
    return versions.all_versions(spark, small, source.schema)


@register("batch_replace")
def q_batch_replace(spark, d):
    """Land both batches, then replace batch 2 with a re-cleaned version."""
    raw = fx.raw_landed(spark, d)
    path = scratch_path(spark, "raw")
    landing.load_rows(raw, path)
    again = raw.filter(F.col("batch_id") == "batch_2").withColumn("title", unicode_trim("title"))
    storage.replace_batch(again, path)
    storage.replace_batch(again, path)                                   # idempotent re-run
    return spark.read.parquet(path).drop("raw_payload", "source_id", "author")


# ---- property graph ------------------------------------------------------------------------------

def graph_nodes(spark, d):
    return fx.adapter(spark, d, "nodes")


def graph_edges(spark, d):
    return fx.adapter(spark, d, "edges")


def seeded_edges(spark, d):
    """Existing edge table: every A-graph edge with two seed properties."""
    e = graph_edges(spark, d)
    return e.select("source_id", "target_id", "type",
                    F.create_map(F.lit("origin"), F.lit("seed"), F.lit("kind"), F.col("type")).alias("properties"),
                    as_ts(P.EDGE_SEED_TIME).alias("ingested_at"))


def as_ts(text):
    return F.lit(text).cast("timestamp")


def props_text(c):
    return F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                             lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit(""))


@register("node_upsert")
def q_node_upsert(spark, d):
    """Node batch upsert (last in batch wins, created_at kept, last_updated set)."""
    out = graph.upsert_nodes(graph_nodes(spark, d), fx.adapter(spark, d, "node_batch"),
                             ["name", "a1", "a2"], as_of=P.GRAPH_AS_OF,
                             order=["ord", "name", "a1", "a2"])
    return out


@register("edge_resolve")
def q_edge_resolve(spark, d):
    """Edge endpoints resolved against nodes of any label."""
    return graph.resolve_edges(graph_edges(spark, d), graph_nodes(spark, d)) \
        .select("source_id", "target_id", "type", "source_label", "target_label")


@register("edge_upsert")
def q_edge_upsert(spark, d):
    """Relationship batch merged into the edge table (``SET r += props``)."""
    batch = fx.adapter(spark, d, "edge_batch").select(
        "source_id", "target_id", "type", "ord",
        F.create_map(F.lit("qty"), F.col("qty"), F.lit("flag"), F.col("flag")).alias("properties"))
    out = graph.upsert_edges(seeded_edges(spark, d), batch, graph_nodes(spark, d), as_of=P.GRAPH_AS_OF)
    return out.select("source_id", "type", "target_id", props_text(F.col("properties")).alias("props"), "ingested_at")


@register("orphan_edges")
def q_orphan_edges(spark, d):
    """Dangling edges and the missing side."""
    return graph.orphan_edges(graph_edges(spark, d), graph_nodes(spark, d))


@register("model_details")
def q_model_details(spark, d):
    """Every model with its runs (OPTIONAL MATCH), one NULL row when it has none."""
    return graph.model_details(graph_nodes(spark, d), graph_edges(spark, d))


@register("deployment_status")
def q_deployment_status(spark, d):
    """Deployments with the models they serve."""
    return graph.deployment_status(graph_nodes(spark, d), graph_edges(spark, d))


@register("lineage")
def q_lineage(spark, d):
    """Per deployment, lineage path counts Deployment->Model->Run->Experiment."""
    return graph.lineage_counts(graph_nodes(spark, d), graph_edges(spark, d))


@register("node_projection")
def q_node_projection(spark, d):
    """Per-label properties with defaults, slug ids, canonical status."""
    p = graph.project_nodes(open_nodes(spark, d))
    return p.select(*[c for c in p.columns if c not in ("metrics", "parameters")], F.element_at("metrics", "accuracy").alias("accuracy"),
                    F.element_at("parameters", "user").alias("parameter_user"))


def open_nodes(spark, d):
    n = fx.adapter(spark, d, "open_nodes")
    return n.select("id", "label", "name", "a1", "a2", F.try_parse_json("props_text").alias("props"))


@register("graph_properties")
def q_graph_properties(spark, d):
    """Every property that occurs per label, fixed or open, with the nodes that set it and its type."""
    return graph.property_report(open_nodes(spark, d))


@register("name_lookup")
def q_name_lookup(spark, d):
    """Nodes by name, from files sorted by name with bloom filters on name and id."""
    path = storage.write_indexed(graph_nodes(spark, d), scratch_path(spark, "nodes"), ["name", "id"], ("name", "id"))
    return graph.name_lookup(spark.read.parquet(path), P.LOOKUP_NAME).select("id", "label", "name", "a1")


@register("graph_schema")
def q_graph_schema(spark, d):
    """(source label, type, target label) counts over resolved edges."""
    return graph.graph_schema(graph_nodes(spark, d), graph_edges(spark, d))


@register("label_scan")
def q_label_scan(spark, d):
    """``MATCH (m:Model) RETURN m LIMIT 25`` (ordered by id)."""
    return graph.label_scan(graph_nodes(spark, d), "Model", P.LABEL_SCAN_LIMIT)


# ---- extraction prompts, replies and evaluation -------------------------------------------------

@register("prompt_extract")
def q_prompt_extract(spark, d):
    """One extraction prompt per document (whole text)."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", extract.extraction_prompt(F.col("text")).alias("prompt"))


@register("prompt_judge")
def q_prompt_judge(spark, d):
    """One judge prompt per resolved triple."""
    r = graph.resolve_edges(graph_edges(spark, d), graph_nodes(spark, d))
    return r.select("source_id", "type", "target_id",
                    extract.judge_prompt(F.col("source_name"), F.col("type"), F.col("target_name")).alias("prompt"))


def parsed_responses(spark, d):
    return extract.parse_responses(fx.adapter(spark, d, "responses"))


@register("parse_responses")
def q_parse_responses(spark, d):
    """Replies -> status, reason, sizes."""
    p = parsed_responses(spark, d)
    return p.select("doc_id", "status", "reason", "response_chars", "n_models", "n_experiments", "n_runs",
                    "n_deployments", "n_relationships")


@register("extraction_counts")
def q_extraction_counts(spark, d):
    """Entity counts per reply status."""
    return extract.extraction_counts(parsed_responses(spark, d))


@register("schema_compliance")
def q_schema_compliance(spark, d):
    """Share of schema-compliant replies."""
    return extract.schema_compliance(parsed_responses(spark, d))


@register("judge_metrics")
def q_judge_metrics(spark, d):
    """Verdict counts and pass rate."""
    return graph.judge_metrics(fx.adapter(spark, d, "all_verdicts"))


@register("hallucination_rate")
def q_hallucination_rate(spark, d):
    """Relationships not in ground truth or rejected."""
    return graph.hallucination_rate(graph_edges(spark, d), fx.adapter(spark, d, "all_verdicts"))


@register("coverage")
def q_coverage(spark, d):
    """Covered diseases / all diseases."""
    return graph.coverage(fx.adapter(spark, d, "diseases"), fx.adapter(spark, d, "covers"))


@register("fulltext_lookup")
def q_fulltext_lookup(spark, d):
    """Documents ranked by matched query terms (top results)."""
    return search.search(read_table(spark, d, "documents"), P.SEARCH_TERMS, None)


# ---- telemetry ------------------------------------------------------------------------------------

@register("request_counts")
def q_request_counts(spark, d):
    """Requests by method, endpoint template and status."""
    return telemetry.request_counts(fx.requests(spark, d))


@register("prediction_errors")
def q_prediction_errors(spark, d):
    """Processed and failed requests per endpoint."""
    return telemetry.prediction_errors(fx.requests(spark, d))


@register("latency_histogram")
def q_latency_histogram(spark, d):
    """Cumulative latency buckets, sum and count per endpoint."""
    h = telemetry.latency_buckets(fx.requests(spark, d))
    return h.select("endpoint", F.round("latency_sum", 6).alias("latency_sum"), "latency_count", "le", "bucket_count")


@register("latency_p95")
def q_latency_p95(spark, d):
    """p95 from the histogram buckets per endpoint."""
    return telemetry.latency_quantile(fx.requests(spark, d), P.HIST_QUANTILE) \
        .select("endpoint", F.round("quantile", 6).alias("p95"))


@register("latency_p95_windows")
def q_latency_p95_windows(spark, d):
    """p95 per sliding 5-minute window (1-minute step) over all endpoints."""
    return telemetry.windowed_latency_quantile(fx.requests(spark, d), P.HIST_QUANTILE, P.RATE_WINDOW, P.RATE_STEP) \
        .select("window_start", "window_end", F.round("quantile", 6).alias("p95"))


@register("request_rate")
def q_request_rate(spark, d):
    """Per-endpoint request rate over sliding 5-minute windows."""
    return telemetry.request_rate(fx.requests(spark, d), P.RATE_WINDOW, P.RATE_STEP)


@register("error_rate")
def q_error_rate(spark, d):
    """5xx request rate over sliding 5-minute windows."""
    return telemetry.error_rate(fx.requests(spark, d), P.RATE_WINDOW, P.RATE_STEP)


@register("counter_rate")
def q_counter_rate(spark, d):
    """Rate from counter samples with resets, hourly windows."""
    samples = fx.adapter(spark, d, "counters").withColumn("ts", F.col("ts").cast("timestamp"))
    return telemetry.counter_rate(samples, P.COUNTER_WINDOW)


@register("last_up")
def q_last_up(spark, d):
    """Last non-NULL ``up`` per job."""
    up = fx.adapter(spark, d, "up").withColumn("ts", F.col("ts").cast("timestamp"))
    return telemetry.last_not_null(up)


@register("dashboard_range")
def q_dashboard_range(spark, d):
    """Requests per endpoint and status in the range ``[now - 6h, now]``."""
    now = as_ts(P.DASHBOARD_NOW)
    r = telemetry.time_range(fx.requests(spark, d), now - F.expr(f"INTERVAL {P.DASHBOARD_HOURS} HOURS"), now)
    return r.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


# ---- data quality and audit -------------------------------------------------------------------------

@register("dq_suite")
def q_dq_suite(spark, d):
    """Q1, Q2, Q5, Q8, Q9: the column tests of source, staging and mart, graph key and edge checks."""
    raw = fx.raw_landed(spark, d)
    stg = transform.staging(raw)
    mart = transform.daily_mart(stg)
    nodes = graph_nodes(spark, d)
    checks = (quality.column_tests(raw, "news_articles_raw", quality.SOURCE_TESTS)
              + quality.column_tests(stg, "stg_news_articles", quality.STAGING_TESTS)
              + quality.column_tests(mart, "fct_daily_article_counts", quality.MART_TESTS)
              + [quality.unique(nodes, "nodes", ["label", "id"]),
                 quality.referential(graph_edges(spark, d), nodes)])
    return quality.suite(checks)


@register("dq_freshness")
def q_dq_freshness(spark, d):
    """Q3: freshness of the raw source on ``fetched_at``."""
    return quality.freshness(fx.raw_landed(spark, d), "news_articles_raw", "fetched_at", P.FRESHNESS_AS_OF)


@register("dq_ranges")
def q_dq_ranges(spark, d):
    """Q6: value ranges (accuracy in [0,1], latency >= 0, document length >= 1)."""
    a = quality.range_violations(fx.adapter(spark, d, "runs"), "runs", {"accuracy": (0.0, 1.0)})
    b = quality.range_violations(fx.requests(spark, d), "requests", {"latency_s": (0.0, None), "status": (100, 599)})
    c = quality.range_violations(read_table(spark, d, "documents"), "documents", {"n_chars": (1, None)})
    return a.unionByName(b).unionByName(c)


@register("dq_schema")
def q_dq_schema(spark, d):
    """Q4, Q7: landed raw table against the declared load schema (+ NULLs in required columns)."""
    from newsloom.sources.landing import RAW_SCHEMA
    from pyspark.sql import types as T
    required = T.StructType([T.StructField(f.name, f.dataType, f.name not in ("article_id", "title", "url",
                                                                                "published_at", "batch_id"))
                             for f in RAW_SCHEMA.fields])
    return quality.schema_diff(fx.raw_landed(spark, d), required, "news_articles_raw")


@register("audit_report")
def q_audit_report(spark, d):
    """Audit events appended as JSON lines, read back, summarised per stage."""
    events = audit.audit_events(fx.adapter(spark, d, "audit"))
    path = scratch_path(spark, "audit")
    audit.append_audit(events, path)
    return audit.audit_report(audit.read_audit(spark, path))


@register("run_log_pivot")
def q_run_log_pivot(spark, d):
    """Metrics logged in long form per run, pivoted back to columns."""
    runs = fx.adapter(spark, d, "runs")
    log = audit.run_log(runs, "run_id", {"accuracy": F.col("accuracy"), "loss": F.lit(1.0) - F.col("accuracy")},
                        ts="finished_at")
    p = audit.pivot_run_log(log, ["accuracy", "loss"])
    return p.select("run_id", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


# ---- machine learning ---------------------------------------------------------------------------------

def _embeddings(spark, d):
    return ml.hash_split(read_table(spark, d, "embeddings"), "vec_id")


def _train_and_score(spark, d):
    data = ml.with_features(_embeddings(spark, d))
    model = ml.train_forest(data.filter(F.col("split") == "train"))
    path = ml.save_model(model, scratch_path(spark, "model"))                     # S21
    loaded = ml.load_model(path)
    test = data.filter(F.col("split") == "test").select("vec_id", "label", "features")
    return ml.batch_predict(loaded, test, "vec_id", ML_VERSION).drop("features")


ML_VERSION = "v20240202000000"


@register("ml_split")
def q_ml_split(spark, d):
    """M1: stable 80/20 hash split of the embeddings."""
    return _embeddings(spark, d).select("vec_id", "label", "split")


@register("ml_gate")
def q_ml_gate(spark, d):
    """Best run against the accuracy gate, version from its finish time."""
    return ml.gate(fx.adapter(spark, d, "runs"), P.ACCURACY_GATE)


@register("ml_train_predict")
def q_ml_train_predict(spark, d):
    """Random forest trained on the train split, saved, loaded, batch-scored on test."""
    return _train_and_score(spark, d)


@register("ml_accuracy")
def q_ml_accuracy(spark, d):
    """Processed count and accuracy of the batch predictions."""
    return ml.accuracy(_train_and_score(spark, d))


# ---- chat --------------------------------------------------------------------------------------------

@register("transcripts")
def q_transcripts(spark, d):
    """One transcript per conversation."""
    return chat.transcripts(read_table(spark, d, "conversations"))


@register("last_message")
def q_last_message(spark, d):
    """Last message per conversation and the next step."""
    return chat.last_message(read_table(spark, d, "conversations"))


# ---- streaming ---------------------------------------------------------------------------------------

def _incremental(spark, d):
    landing_path = scratch_path(spark, "items")
    processed_path, daily_path = scratch_path(spark, "processed"), scratch_path(spark, "daily")
    s_ingest.land_items(fx.items(spark, d), landing_path)
    s_ingest.incremental_ingest(spark, landing_path, processed_path, daily_path, scratch_path(spark, "ckpt"),
                                since=P.SINCE, fetched_at=P.AS_OF)
    return processed_path, daily_path


@register("stream_ingest")
def q_stream_ingest(spark, d):
    """ST1: items landed in four arrivals, merged per micro-batch into the processed table."""
    processed_path, _ = _incremental(spark, d)
    return s_ingest.processed_view(spark, processed_path).drop("item_ord")


@register("stream_daily_counts")
def q_stream_daily_counts(spark, d):
    """ST1, A1: daily counts maintained per micro-batch for the touched dates only."""
    _, daily_path = _incremental(spark, d)
    return s_ingest.daily_view(spark, daily_path)


@register("stream_raw_epochs")
def q_stream_raw_epochs(spark, d):
    """ST1 (raw landing form): raw rows appended idempotently per epoch, deduplicated on read."""
    landing_path, raw_path = scratch_path(spark, "items"), scratch_path(spark, "raw")
    s_ingest.land_items(fx.items(spark, d), landing_path)
    s_ingest.ingest_stream(spark, landing_path, raw_path, scratch_path(spark, "ckpt"), since=P.SINCE,
                           fetched_at=P.AS_OF)
    raw = spark.read.parquet(raw_path).drop("epoch")
    return transform.processed_rows(ingest.reclean_raw(ingest.keep_first_by_id(raw)))


@register("stream_dedup")
def q_stream_dedup(spark, d):
    """ST2: streaming dedup by article id within the watermark."""
    landing_path, sink = scratch_path(spark, "items"), scratch_path(spark, "dedup")
    s_ingest.land_items(fx.items(spark, d), landing_path)
    s_ingest.dedup_stream(spark, landing_path, sink, scratch_path(spark, "ckpt"), since=P.SINCE, fetched_at=P.AS_OF)
    return spark.read.parquet(sink).select("article_id", "published_at")


def _rate_table(spark, d):
    reqs = fx.adapter(spark, d, "requests")
    landing_path, result = scratch_path(spark, "requests"), scratch_path(spark, "rate")
    s_tel.land_by_time(reqs, landing_path)
    s_tel.rate_stream(spark, landing_path, reqs.schema, result, scratch_path(spark, "ckpt"),
                      length=P.RATE_WINDOW, step=P.RATE_STEP)
    return s_tel.rate_view(spark, result)


@register("stream_request_rate")
def q_stream_request_rate(spark, d):
    """ST3: request rate per endpoint on a stream, equal to the batch W3 result."""
    return _rate_table(spark, d).select("window_start", "window_end", "endpoint", "requests", "rate")


@register("stream_error_rate")
def q_stream_error_rate(spark, d):
    """ST3, W6: 5xx rate per window from the streamed window table."""
    return s_tel.error_rate_from(_rate_table(spark, d), P.RATE_WINDOW)


@register("stream_latency_p95")
def q_stream_latency_p95(spark, d):
    """ST3, W5: p95 per window from the streamed cumulative latency buckets."""
    out = s_tel.quantile_from(_rate_table(spark, d), P.HIST_QUANTILE)
    return out.select("window_start", "window_end", F.round("quantile", 6).alias("p95"))


@register("stream_audit")
def q_stream_audit(spark, d):
    """ST4: audit events appended by a stream, summarised like the batch report."""
    a = fx.adapter(spark, d, "audit")
    landing_path, sink = scratch_path(spark, "audit-in"), scratch_path(spark, "audit")
    s_audit.land_events(a, landing_path)
    s_audit.audit_stream(spark, landing_path, a.schema, sink, scratch_path(spark, "ckpt"))
    return audit.audit_report(audit.read_audit(spark, sink))


@register("elt_daily_counts")
def q_elt_daily_counts(spark, d):
    """A2: daily counts rebuilt over the ELT-processed table (both batches merged, latest wins)."""
    return transform.daily_counts(transform.elt_narrow(fx.raw_landed(spark, d)))


@register("extracted_entities")
def q_extracted_entities(spark, d):
    """Models of the valid replies, one row per extracted model."""
    valid, _ = extract.route(parsed_responses(spark, d))
    return extract.explode_entities(valid, "models").select("doc_id", "id", "name", "version")


@register("graph_labels")
def q_graph_labels(spark, d):
    """Labels with node counts and how many nodes set each property."""
    return graph.label_properties(graph_nodes(spark, d))


@register("kg_ingest")
def q_kg_ingest(spark, d):
    """Valid replies exploded and upserted into the graph; counts per label/type."""
    valid, _ = extract.route(parsed_responses(spark, d))
    node_batch, edge_batch = extract.extraction_batches(valid)
    nodes = graph.upsert_nodes(graph_nodes(spark, d), node_batch, ["name", "a1", "a2"], as_of=P.GRAPH_AS_OF,
                               order=["ord", "name", "a1", "a2"])
    edges = graph.upsert_edges(seeded_edges(spark, d), edge_batch, nodes, as_of=P.GRAPH_AS_OF)
    n = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("last_updated").isNotNull()).alias("touched"))
    e = edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ingested_at") == as_ts(P.GRAPH_AS_OF)).alias("touched"))
    return n.unionByName(e)


@register("fulltext_index")
def q_fulltext_index(spark, d):
    """Postings table (sorted by term) built from the whole documents, then a term lookup."""
    path = search.write_postings(read_table(spark, d, "documents"), scratch_path(spark, "postings"))
    return search.search_postings(spark.read.parquet(path), P.SEARCH_TERMS, None) \
        .withColumn("matched_terms", F.col("matched_terms").cast("bigint"))


@register("node_upsert_bucketed")
def q_node_upsert_bucketed(spark, d):
    """J2 against a node table bucketed by (label, id): the batch is the only side shuffled."""
    path = scratch_path(spark, "nodes")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = storage.write_bucketed(graph_nodes(spark, d), f"nodes_{path.rsplit('-', 1)[1]}", path,
                                   ["label", "id"], buckets)
    return graph.upsert_nodes(nodes, fx.adapter(spark, d, "node_batch"), ["name", "a1", "a2"], as_of=P.GRAPH_AS_OF,
                              order=["ord", "name", "a1", "a2"])


# ---- operators with a registry entry of their own --------------------------------------------------

@register("raw_table")
def q_raw_table(spark, d):
    """The raw article table made by its DDL, partitioned by batch, filled through the table and read back."""
    path = scratch_path(spark, "raw-table")
    name = f"raw_{path.rsplit('-', 1)[1]}"
    storage.create_table(spark, storage.RAW_DDL, name, path)
    table = spark.table(name)
    fx.raw_landed(spark, d).select(*table.columns).write.insertInto(name)
    return spark.table(name).drop("raw_payload", "source_id", "author")


@register("landed_items")
def q_landed_items(spark, d):
    """Items landed as nested JSON pages, scanned with the declared schema."""
    path = scratch_path(spark, "pages")
    i = fx.items(spark, d)
    (i.select(F.struct(F.lit(None).cast("string").alias("id"), F.col("source_name").alias("name")).alias("source"), "title", "url",
              "author", "description", "content", F.col("published_at_text").alias("publishedAt")).write.json(path))
    return landing.read_items(spark, path).select("source_name", "title", "url", "published_at_text", "author",
                                                  "description", "content")


def _landed_pages(spark, d):
    """The paged items landed as one JSON record per page, with a field that no schema names, and the empty pages."""
    i = fx.adapter(spark, d, "paged_items")
    item = F.struct(F.struct(F.lit(None).cast("string").alias("id"), F.col("source_name").alias("name")).alias("source"), "title", "url",
                    "author", "description", "content", F.col("published_at_text").alias("publishedAt"),
                    F.concat(F.lit("img-"), F.col("item_ord")).alias("urlToImage"))
    full = (i.groupBy("run_id", "page").agg(F.sort_array(F.collect_list(F.struct("item_ord", item.alias("item")))).alias("x"))
            .select("run_id", "page", F.transform("x", lambda e: e["item"]).alias("articles")))
    runs = i.select("run_id").distinct().where(F.regexp_extract("run_id", "([0-9]+)", 1).cast("bigint") % 5 == 2)
    empty = runs.select("run_id", F.lit(2).alias("page"), F.array().cast(full.schema["articles"].dataType).alias("articles"))
    path = scratch_path(spark, "pages")
    full.unionByName(empty).write.option("ignoreNullFields", "false").json(path)
    return landing.read_pages(spark, path)


@register("source_pages")
def q_source_pages(spark, d):
    """Landed pages read up to where a paged fetch would stop: an empty, absent or short page, or an old item."""
    kept = ingest.until_stop(_landed_pages(spark, d), since=P.PAGE_SINCE, page_size=P.PAGE_ITEMS)
    return landing.page_items(kept).select("run_id", "page", "pos", "source_name", "title", "url", "published_at_text", "author",
                                           "description", "content", F.get_json_object("raw_payload", "$.urlToImage").alias("image"))


@register("raw_payloads")
def q_raw_payloads(spark, d):
    """The raw rows of the landed pages with the whole source item, told by the fields found in it."""
    raw = ingest.build_raw_articles(landing.page_items(_landed_pages(spark, d)), since=P.SINCE, fetched_at=P.AS_OF, language="en")
    part = lambda path, name: F.get_json_object("raw_payload", path).alias(name)                    # noqa: E731
    return raw.select("article_id", part("$.title", "title"), part("$.url", "url"), part("$.publishedAt", "published_at_text"),
                      part("$.source.name", "source_name"), part("$.content", "content"), part("$.urlToImage", "image"))


@register("corrupt_lines")
def q_corrupt_lines(spark, d):
    """Landed lines that are not JSON go to quarantine, the rest are loaded."""
    path = scratch_path(spark, "lines")
    docs = read_table(spark, d, "documents")
    good = docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("article_id"), F.col("text").alias("content"))).alias("value"))
    broken = docs.where("doc_id % 9 = 0").select(F.concat(F.lit("broken {"), F.col("doc_id")).alias("value"))
    good.unionAll(broken).write.text(path)
    ok, bad = landing.split_corrupt(landing.load_jsonl(spark, path))
    return (ok.select("article_id", "content", F.lit(None).cast("string").alias("line"))
            .unionByName(bad.select(F.lit(None).cast("string").alias("article_id"), F.lit(None).cast("string").alias("content"),
                                    F.col("_corrupt").alias("line"))))


@register("mark_read")
def q_mark_read(spark, d):
    """Stored mark, invalid stored value, nothing stored."""
    state = read_table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("updated_at"))
    state = state.withColumn("value", F.when(F.col("name") == "signup", F.lit("12:30"))
                             .otherwise(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    marks = [storage.read_mark(state, n, now=P.AS_OF) for n in ("click", "signup", "absent")]
    return marks[0].unionByName(marks[1]).unionByName(marks[2])


@register("required_columns")
def q_required_columns(spark, d):
    """Q4: rows without a required value go to quarantine, counted by reason."""
    ok, bad = quality.require(fx.raw_landed(spark, d), ["article_id", "title", "content"])
    tag = lambda df, reason: df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))       # noqa: E731
    return tag(ok, F.lit("ok")).unionByName(tag(bad, F.col("reason")))


@register("quarantine_artifact")
def q_quarantine_artifact(spark, d):
    """Failed replies written as the review artifact and read back."""
    _, review = extract.route(parsed_responses(spark, d))
    path = scratch_path(spark, "quarantine")
    audit.write_quarantine(review.select("doc_id", "status", "reason", "response"), path)
    return spark.read.schema("doc_id long, status string, reason string, response string").json(path)


@register("judge_verdicts")
def q_judge_verdicts(spark, d):
    """Judge replies -> status, reasoning, correction."""
    return extract.parse_verdicts(fx.adapter(spark, d, "judge_replies")).select("source_id", "target_id", "status", "reasoning",
                                                                               "suggested_correction")


@register("unsupported_edges")
def q_unsupported_edges(spark, d):
    """Extracted relationships without a ground-truth counterpart, over every edge type."""
    return graph.unsupported_edges(graph_edges(spark, d), fx.adapter(spark, d, "verdicts").filter("in_truth"))


@register("lineage_paths")
def q_lineage_paths(spark, d):
    """The paths of one deployment as rows."""
    return graph.lineage_paths(graph_nodes(spark, d), graph_edges(spark, d), P.LINEAGE_DEPLOYMENT).select(
        "deployment_id", "model_id", "run_id", "experiment_id")


@register("node_properties")
def q_node_properties(spark, d):
    """Per-label properties of extracted nodes through the upsert, with the schema defaults."""
    valid, _ = extract.route(parsed_responses(spark, d))
    batch, _ = extract.extraction_batches(valid)
    nodes = graph.upsert_nodes(graph_nodes(spark, d), batch, ["name", "a1", "a2", *extract.NODE_PROPERTIES], as_of=P.GRAPH_AS_OF,
                               order=["ord", "name", "a1", "a2"])
    return nodes.filter(F.col("last_updated").isNotNull()).select(
        "label", "id", "name", "a1", "a2", "description", "image", "replicas", F.get(F.map_values("metrics"), F.lit(0)).alias("accuracy"),
        F.when(F.col("parameters").isNotNull(), F.size("parameters")).alias("n_parameters"))


@register("ml_scored")
def q_ml_scored(spark, d):
    """M2-M5: the rows, labels and version of the batch scores, and whether each prediction is a trained class."""
    classes = _embeddings(spark, d).filter("split = 'train'").select(F.col("label").cast("bigint").alias("prediction"),
                                                                     F.lit(True).alias("_trained")).distinct()
    return _train_and_score(spark, d).join(classes, "prediction", "left").select(
        "vec_id", "label", "model_version", F.coalesce("_trained", F.lit(False)).alias("in_domain"))


@register("malformed_items")
def q_malformed_items(spark, d):
    """Items whose timestamp does not parse go to quarantine."""
    return ingest.malformed_timestamps(fx.items(spark, d)).select("item_ord", "published_at_text", "reason")


@register("gate_each_run")
def q_gate_each_run(spark, d):
    """The branch each run takes at the accuracy gate."""
    return ml.gate_each(fx.adapter(spark, d, "checked_runs"), P.ACCURACY_GATE).groupBy("next_task").agg(F.count(F.lit(1)).alias("n"))


@register("without_batch")
def q_without_batch(spark, d):
    """Every raw row except those of one batch."""
    return storage.without_batch(fx.raw_landed(spark, d), "batch_2").select("article_id", "title", "content", "batch_id")


@register("append_messages")
def q_append_messages(spark, d):
    """Later turns appended to the earlier ones of each conversation."""
    m = read_table(spark, d, "conversations")
    return chat.append_messages(m.filter("turn < 2"), m.filter("turn >= 2")).select("conv_id", "turn", "role", "text")


@register("newest_first")
def q_newest_first(spark, d):
    """O1: every item, newest first and stable by item order."""
    return ingest.newest_first(raw_items(spark, d).select("item_ord", "article_id", "published_at", "title"))


@register("retention_job")
def q_retention_job(spark, d):
    """S16 as a job: the landing zone rewritten without expired rows."""
    landed, kept = scratch_path(spark, "retention-landed"), scratch_path(spark, "retention-kept")
    storage.rebuild(fx.raw_landed(spark, d), landed, "batch_id")
    storage.apply_retention(spark, landed, kept, P.RETENTION_AS_OF, P.RETENTION_DAYS)
    return spark.read.parquet(kept).select("article_id", "batch_id", "fetched_at", "url")


@register("upsert_rows")
def q_upsert_rows(spark, d):
    """J1 without a table: the first batch with the second merged in by id."""
    raw = fx.raw_landed(spark, d).select("article_id", "title", "content", "batch_id")
    return storage.upsert_frames(raw.filter("batch_id = 'batch_1'"), raw.filter("batch_id = 'batch_2'"))


@register("fulltext_ranked")
def q_fulltext_ranked(spark, d):
    """The best documents by BM25 over two fields, title (first line, double weight) and text, through the scored index."""
    fields = {"title": F.split_part("text", F.lit("\n"), F.lit(1)), "text": F.col("text")}
    path = search.write_scored_index(read_table(spark, d, "documents"), fields, scratch_path(spark, "scored"))
    read = spark.read.parquet
    top = search.ranked(read(f"{path}/postings"), read(f"{path}/fields"), P.RANKED_TERMS, P.RANKED_K, {"title": P.TITLE_WEIGHT})
    return top.select("doc_id", F.round("score", 6).alias("score"))


@register("run_report")
def q_run_report(spark, d):
    """Audit events cut into runs: order of stages, duration, first failing stage, failing runs in a row."""
    return audit.run_report(audit.audit_events(fx.adapter(spark, d, "audit")), P.RUN_GAP_SECONDS)


@register("run_log_texts")
def q_run_log_texts(spark, d):
    """Parameters and texts of the run log, pivoted back to columns."""
    runs = fx.adapter(spark, d, "runs")
    log = audit.run_log(runs, "run_id", {"accuracy": "accuracy"}, ts="finished_at", params={"gate": F.lit(P.ACCURACY_GATE)},
                        texts={"note": F.concat(F.lit("run "), F.col("run_id"))})
    return audit.pivot_run_log(log, ["gate"], "param").join(audit.pivot_run_log(log, ["note"], "text"), "run_id")


@register("load_branch")
def q_load_branch(spark, d):
    """The branch a load takes, by a one-row probe of its batch."""
    raw = fx.raw_landed(spark, d)
    taken = [(b, "load" if ingest.has_rows(raw.filter(F.col("batch_id") == b)) else "skip") for b in ("batch_1", "batch_2", "batch_9")]
    return spark.createDataFrame(taken, "batch_id string, next_task string")


@register("ml_evaluate")
def q_ml_evaluate(spark, d):
    """Processed count and accuracy of predictions that SQL can state (a document of over 500 characters is good)."""
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels").where("quality is not null")
    p = docs.join(labels, "doc_id").select((F.length("text") > 500).cast("int").alias("prediction"), F.col("quality").alias("label"))
    return ml.accuracy(p)


@register("model_gate")
def q_model_gate(spark, d):
    """Models tested as they are built; what lies behind a failed test is skipped."""
    def counts(rows):
        return rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))

    def required(raw):
        return transform.elt_required(raw).select("article_id", "source_name", "published_at")

    kept = {c: ("not_null",) for c in ("article_id", "source_name", "published_at")}
    reg = (models.ModelRegistry(spark).source("raw", fx.raw_landed(spark, d))
           .model("stg_news_articles", ["raw"], transform.staging, "table", quality.STAGING_TESTS)
           .model("fct_daily_article_counts", ["stg_news_articles"], transform.daily_mart, "table", quality.MART_TESTS)
           .model("mart_sources", ["fct_daily_article_counts"], counts, "view")
           .model("required_rows", ["raw"], required, "view", kept)
           .model("required_sources", ["required_rows"], counts, "table", {"source_name": ("not_null", "unique"), "n": ("not_null",)}))
    return reg.build()


@register("fct_incremental")
def q_fct_incremental(spark, d):
    """A3: the daily mart maintained by arrival, its distinct ids without a rescan."""
    staged = transform.staging(fx.raw_landed(spark, d))
    ids, deltas = scratch_path(spark, "mart-ids"), scratch_path(spark, "mart-deltas")
    versions.create_mart(spark, ids, deltas)
    for n in range(3):
        arrival = staged.where(F.pmod(F.xxhash64("article_id", "batch_id"), F.lit(3)) == n)
        versions.add_arrival(spark, arrival, ids, deltas, versions.version_name(n))
    return versions.mart(spark, deltas)


@register("processed_table")
def q_processed_table(spark, d):
    """The processed and the daily table by their DDL (partitioned by day, clustered by source), filled and read back."""
    path = scratch_path(spark, "ddl")
    names = {t: f"{t}_{path.rsplit('-', 1)[1]}" for t in ("processed", "daily")}
    storage.create_table(spark, storage.PROCESSED_DDL, names["processed"], f"{path}/processed")
    storage.create_table(spark, storage.DAILY_DDL, names["daily"], f"{path}/daily")
    processed = spark.table(names["processed"])
    transform.elt_source(fx.raw_landed(spark, d)).select(*processed.columns).write.insertInto(names["processed"])
    processed, daily = spark.table(names["processed"]), spark.table(names["daily"])
    transform.daily_counts(processed).select(*daily.columns).write.insertInto(names["daily"])
    day = ["published_date", "source_name"]
    lengths = spark.table(names["processed"]).groupBy(*day).agg(F.sum("content_length").alias("characters"))
    return spark.table(names["daily"]).join(lengths, day)


@register("extracted_rows")
def q_extracted_rows(spark, d):
    """Every entity and relationship of the valid replies, one row each, with typed metrics and replicas."""
    valid, _ = extract.route(parsed_responses(spark, d))
    values = {"models": F.col("version"), "experiments": F.col("status"), "runs": F.element_at("metrics", "accuracy").cast("string"),
              "deployments": F.col("replicas").cast("string")}
    parts = [extract.explode_entities(valid, kind).select("doc_id", F.lit(kind).alias("kind"), "id", "name", v.alias("value"))
             for kind, v in values.items()]
    parts.append(extract.explode_entities(valid, "relationships").select(
        "doc_id", F.lit("relationships").alias("kind"), F.col("source_id").alias("id"), F.col("target_id").alias("name"), F.col("type").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("next_step")
def q_next_step(spark, d):
    """The next step where messages may ask for tools (here: words that end in "ble" after a capital)."""
    messages = read_table(spark, d, "conversations")
    return chat.last_message(messages.withColumn("tool_calls", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ble"), 0)))


@register("raw_appended")
def q_raw_appended(spark, d):
    """Batches appended one after another to a table partitioned by batch."""
    path = scratch_path(spark, "appended")
    raw = fx.raw_landed(spark, d)
    for batch in ("batch_1", "batch_2"):
        storage.append(raw.filter(F.col("batch_id") == batch), path, "batch_id")
    return spark.read.schema(raw.schema).parquet(path).select("article_id", "title", "content", "url", "batch_id")


@register("configured_items")
def q_configured_items(spark, d):
    """One run configuration applied to the raw rows: sources, language and keywords together."""
    c = ingest.PipelineConfig(query=P.KEYWORDS, language=P.LANGUAGE, sources=ingest.PipelineConfig.parse_sources(P.SOURCE_LIST))
    raw = ingest.filter_language(ingest.filter_sources(raw_items(spark, d), ",".join(c.sources)), c.language)
    return ingest.filter_keywords(raw, c.query).select("article_id", "source_name", "language", "title")
