"""Ingestion, dedup and processed/aggregate operators on small frames."""

from pyspark.sql import functions as F

from newsloom.operators import ingest, late, transform

ITEM_COLS = ("item_ord long, source_name string, title string, url string, published_at_text string, "
             "author string, description string, content string, language string, run_id string")


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM_COLS)


def test_incremental_fetch_like_reference_test(spark):
    run = "scheduled__2026-04-02T00:00:00+00:00"
    df = items(spark, [(1, "Src", "First", "https://a/1", "2026-04-01T02:00:00Z", None, None, None, "en", run),
                       (2, "Src", "Second", "https://a/2", "2026-04-01T01:00:00Z", "", "d", "c", "en", run)])
    raw = ingest.build_raw_articles(df, since="2026-04-01 00:00:00", fetched_at="2026-04-02 00:00:00").collect()
    assert len(raw) == 2
    assert {r.batch_id for r in raw} == {"scheduled_2026-04-02T00_00_00_00_00"}
    assert {r.title for r in raw} == {"First", "Second"}
    assert all(r.author is None for r in raw)


def test_required_and_incremental_filters(spark):
    run = "r1"
    df = items(spark, [
        (1, None, "  t  ", "u1", "2026-04-01T02:00:00Z", None, None, None, "en", run),   # source -> unknown
        (2, "s", "   ", "u2", "2026-04-01T02:00:00Z", None, None, None, "en", run),     # blank title
        (3, "s", "t", "u3", "", None, None, None, "en", run),                          # no timestamp
        (4, "s", "t", "u4", "2026-04-01T00:00:00Z", None, None, None, "en", run),      # == since
        (5, "s", "t", "u5", "not a time", None, None, None, "en", run)])               # malformed
    raw = ingest.build_raw_articles(df, since="2026-04-01 00:00:00", fetched_at="2026-04-02 00:00:00").collect()
    assert [(r.source_name, r.title, r.url) for r in raw] == [("unknown", "t", "u1")]
    bad = ingest.malformed_timestamps(df).collect()
    assert [r.item_ord for r in bad] == [5]


def test_keep_first_is_stable(spark):
    run = "r1"
    same = ("s", "t", "u", "2026-04-01T02:00:00Z")
    df = items(spark, [(3, *same, None, "third", None, "en", run), (1, *same, None, "first", None, "en", run),
                       (2, *same, None, "second", None, "en", run)])
    raw = ingest.build_raw_articles(df, fetched_at="2026-04-02 00:00:00")
    kept = ingest.keep_first_by_id(raw).collect()
    assert len(kept) == 1 and kept[0].description == "first"


def test_empty_input_flows_through(spark):
    df = items(spark, [])
    raw = ingest.build_raw_articles(df, fetched_at="2026-04-02 00:00:00")
    processed = transform.processed_rows(ingest.keep_first_by_id(raw))
    assert processed.count() == 0
    assert transform.daily_counts(processed).count() == 0
    q = transform.quality_summary(raw, ingest.keep_first_by_id(raw)).first()
    assert (q.raw_article_count, q.cleaned_article_count, q.deduplication_rate) == (0, 0, 1.0)
    s = transform.batch_summary(processed).first()
    assert s.article_count == 0 and s.latest_published_at is None


def test_content_length_rules(spark):
    df = spark.createDataFrame([("  ", "abc"), ("", "abc"), (None, "abc"), (" xy ", None)], "c string, d string")
    out = [tuple(r) for r in df.select(transform.content_length_a("c", "d"), transform.content_length_b("c", "d"),
                                       transform.content_length_c("c", "d")).collect()]
    assert out == [(3, 3, 2), (3, 3, 0), (3, 3, 3), (2, 2, 4)]


def test_keyword_and_source_filters(spark):
    df = spark.createDataFrame([("Machine Learning rocks", None, None, " a "), ("x", "deep AI", None, "b"),
                                ("machine", "learning", None, "c")], "title string, description string, content string, source_name string")
    hit = ingest.filter_keywords(df, "machine learning OR ai").select("title").collect()
    assert [r.title for r in hit] == ["Machine Learning rocks", "x"]
    src = ingest.filter_sources(df, " a,,c ").select("source_name").collect()
    assert sorted(r.source_name for r in src) == [" a ", "c"]


def test_newest_items_cap_counts_before_drops(spark):
    rows = [(i, "s", None if i == 3 else "t", "u", f"2026-04-01T0{i}:00:00Z", None, None, None, "en", "r")
            for i in range(1, 6)]
    top = ingest.newest_items(items(spark, rows), k=3).select("item_ord").collect()
    assert [r.item_ord for r in top] == [5, 4, 3]


def test_elt_latest_per_id(spark):
    df = spark.createDataFrame([("a", "x1", "2024-02-01 00:00:00", "batch_1"), ("a", "x2", "2024-02-02 00:00:00", "batch_2")],
                               "article_id string, title string, fetched_at string, batch_id string") \
        .withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    assert [r.title for r in transform.latest_per_id(df).collect()] == ["x2"]


def test_pipeline_config_ranges():
    import pytest
    cfg = ingest.PipelineConfig(sources=ingest.PipelineConfig.parse_sources("a, b,,c"))
    assert cfg.sources == ("a", "b", "c") and cfg.page_size == 100
    for bad in ({"page_size": 0}, {"page_size": 101}, {"lookback_hours": 0}):
        with pytest.raises(ValueError):
            ingest.PipelineConfig(**bad)


def test_newest_first_is_stable(spark):
    rows = [(i, "s", "t", "u", "2026-04-01T01:00:00Z" if i % 2 else "2026-04-01T02:00:00Z", None, None, None, "en", "r")
            for i in range(1, 6)]
    out = [r.item_ord for r in ingest.newest_first(ingest.with_published_at(items(spark, rows))).collect()]
    assert out == [2, 4, 1, 3, 5]


def test_pick_rows_is_one_row_per_key_in_any_order(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 1, "z"), (None, 3, "n"), (None, 4, "m"), ("c", None, "p"), ("c", 1, "q")]
    order = [F.col("v"), F.col("t")]
    for n in (1, 5):
        df = spark.createDataFrame(rows, "k string, v int, t string").repartition(n)
        top = sorted((tuple(r) for r in late.pick_rows(df, "k", order, largest=True).collect()), key=repr)
        assert top == sorted([("a", 2, "y"), ("b", 1, "z"), (None, 4, "m"), ("c", 1, "q")], key=repr)
        least = sorted((tuple(r) for r in late.pick_rows(df, "k", order).collect()), key=repr)
        assert least == sorted([("a", 1, "x"), ("b", 1, "z"), (None, 3, "n"), ("c", None, "p")], key=repr)
    assert late.pick_rows(df.limit(0), "k", order).collect() == []


def test_equal_loads_pick_the_same_row_however_dealt(spark):
    rows = [("a", "t%d" % i, "2024-01-01 00:00:00", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "article_id string, title string, fetched_at string, batch_id string")
    assert len({transform.latest_per_id(df.repartition(n)).first().title for n in (1, 3, 7)}) == 1
