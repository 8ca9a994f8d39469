"""Structured Streaming: restart without new data is a no-op, a late file is ingested incrementally."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import ingest, transform
from newsloom.plans import params as P
from newsloom.session import scratch_path
from newsloom.sources import fixtures as fx
from newsloom.sources import storage, versions
from newsloom.streaming import ingest as s_ingest
from tests.conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_incremental_stream_restart_and_late_file(spark, monkeypatch):
    items = fx.items(spark, SF_SMALL)
    landing, proc, daily, ckpt = (scratch_path(spark, n) for n in ("t-items", "t-proc", "t-daily", "t-ckpt"))
    for k in range(3):                                                    # three arrivals first
        items.filter(F.pmod("item_ord", F.lit(4)) == k).write.mode("append").json(landing)
    run = lambda: s_ingest.incremental_ingest(spark, landing, proc, daily, ckpt, since=P.SINCE, fetched_at=P.AS_OF)
    run()
    cols = ["article_id", "title", "content", "ingestion_batch_id"]
    first = _rows(s_ingest.processed_view(spark, proc), cols)
    run()                                                                 # restart, nothing new: no change
    assert _rows(s_ingest.processed_view(spark, proc), cols) == first
    items.filter(F.pmod("item_ord", F.lit(4)) == 3).write.mode("append").json(landing)   # late arrival
    append = versions.append_version

    def dies(rows, path, version, *rest):
        if path == daily and not version.endswith("empty"):
            raise RuntimeError("lost between the two writes")
        append(rows, path, version, *rest)

    monkeypatch.setattr(versions, "append_version", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(versions, "append_version", append)
    run()                                                                 # the epoch is repeated
    batch = transform.processed_rows(ingest.reclean_raw(ingest.keep_first_by_id(
        ingest.build_raw_articles(items, since=P.SINCE, fetched_at=P.AS_OF))))
    assert _rows(s_ingest.processed_view(spark, proc), cols) == _rows(batch, cols)
    dcols = ["published_date", "source_name", "article_count", "sentiment_ready_count"]
    assert _rows(s_ingest.daily_view(spark, daily), dcols) == _rows(transform.daily_counts(batch), dcols)


def test_ddl_and_retention_job(spark):
    base = scratch_path(spark, "t-ddl")
    for ddl, name in ((storage.RAW_DDL, "raw"), (storage.PROCESSED_DDL, "processed"), (storage.DAILY_DDL, "daily")):
        storage.create_table(spark, ddl, f"t_{name}_{base.rsplit('-', 1)[1]}", f"{base}/{name}")
        storage.create_table(spark, ddl, f"t_{name}_{base.rsplit('-', 1)[1]}", f"{base}/{name}")   # IF NOT EXISTS
    raw = fx.raw_landed(spark, SF_SMALL)
    path, kept_path = scratch_path(spark, "t-raw"), scratch_path(spark, "t-kept")
    storage.replace_batch(raw, path)
    storage.apply_retention(spark, path, kept_path, now="2024-03-02 12:00:00", days=30)
    kept = spark.read.parquet(kept_path)
    assert kept.count() == raw.filter(F.col("batch_id") == "batch_2").count()
    assert spark.read.parquet(path).count() == raw.count()                # source untouched
