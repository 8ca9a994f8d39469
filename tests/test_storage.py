"""Writes: batch replace idempotency, partition-scoped upsert, landing round trip, mark state."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import late
from newsloom.session import scratch_path
from newsloom.sources import landing, storage, versions


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, "article_id string, title string, published_date string, batch_id string") \
        .withColumn("published_date", F.col("published_date").cast("date"))


def test_batch_replace_is_idempotent(spark):
    path = scratch_path(spark, "t-raw")
    storage.replace_batch(raw_rows(spark, [("a", "1", "2024-01-01", "b1"), ("b", "1", "2024-01-02", "b2")]), path)
    again = raw_rows(spark, [("b", "2", "2024-01-02", "b2"), ("c", "2", "2024-01-03", "b2")])
    storage.replace_batch(again, path)
    first = sorted(tuple(r) for r in spark.read.parquet(path).select("article_id", "title", "batch_id").collect())
    storage.replace_batch(again, path)
    second = sorted(tuple(r) for r in spark.read.parquet(path).select("article_id", "title", "batch_id").collect())
    assert first == second == [("a", "1", "b1"), ("b", "2", "b2"), ("c", "2", "b2")]
    storage.replace_batch(again.limit(0), path)                      # empty batch: no change
    assert spark.read.parquet(path).count() == 3


ROW = T.StructType([T.StructField("article_id", T.StringType()), T.StructField("title", T.StringType()),
                    T.StructField("published_date", T.DateType()), T.StructField("batch_id", T.StringType())])


def view(spark, path, **options):
    return sorted(tuple(r) for r in versions.newest(versions.all_versions(spark, path, ROW), "article_id", **options)
                  .select("article_id", "title").collect())


def test_upsert_repeats_and_failures_leave_the_table_right(spark):
    path = scratch_path(spark, "t-proc")
    versions.upsert(spark, path, raw_rows(spark, [("a", "old", "2024-01-01", "b1"), ("b", "old", "2024-01-02", "b1"),
                                                  ("c", "old", None, "b1")]), versions.version_name(1))
    src = raw_rows(spark, [("b", "new", "2024-01-05", "b2"), ("c", "new", "2024-01-03", "b2"), ("d", "new", None, "b2")])
    versions.upsert(spark, path, src, versions.version_name(2))
    want = [("a", "old"), ("b", "new"), ("c", "new"), ("d", "new")]
    assert view(spark, path) == want
    versions.upsert(spark, path, src, versions.version_name(2))                   # the load is repeated
    assert view(spark, path) == want
    assert view(spark, path, where=F.col("published_date") == "2024-01-02") == []      # b's old day is pruned, its old row lost
    fails = src.withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):                                 # a load dies while it writes
        versions.upsert(spark, path, fails, versions.version_name(3))
    assert view(spark, path) == want
    versions.upsert(spark, path, src.withColumn("title", F.lit("newer")), versions.version_name(3))
    assert view(spark, path) == [("a", "old"), ("b", "newer"), ("c", "newer"), ("d", "newer")]


def test_a_repeated_source_key_is_an_error(spark):
    path = scratch_path(spark, "t-twice")
    with pytest.raises(ValueError, match="article_id='a'"):
        versions.upsert(spark, path, raw_rows(spark, [("a", "1", "2024-01-01", "b"), ("a", "2", "2024-01-02", "b")]), versions.version_name(1))


def test_compaction_writes_a_new_place(spark):
    path, small = scratch_path(spark, "t-full"), scratch_path(spark, "t-small")
    for n in range(1, 4):
        versions.upsert(spark, path, raw_rows(spark, [("a", str(n), "2024-01-0%d" % n, "b"), (f"k{n}", str(n), None, "b")]), versions.version_name(n))
    want = view(spark, path)
    versions.compact(spark, path, small, ROW, "article_id", partition_col="published_date")
    assert view(spark, path) == view(spark, small) == want == [("a", "3"), ("k1", "1"), ("k2", "2"), ("k3", "3")]
    assert versions.all_versions(spark, small, ROW).count() == 4
    versions.upsert(spark, small, raw_rows(spark, [("a", "9", None, "b")]), versions.version_name(4))
    assert ("a", "9") in view(spark, small)


def test_losers_meet_wide_rows_by_broadcast_or_shuffle(spark, monkeypatch):
    wide = spark.range(100).withColumn("k", F.when(F.col("id") > 0, F.col("id"))).withColumn("text", F.lit("x"))
    losers = wide.where("id % 3 = 0").select("k")
    for limit in (late.BROADCAST_BYTES, 0):
        monkeypatch.setattr(late, "BROADCAST_BYTES", limit)
        left = late.drop_rows(wide, losers, ["k"])
        assert sorted(r.id for r in left.collect()) == [i for i in range(100) if i % 3]
        assert ("strategy=broadcast" in left._jdf.queryExecution().optimizedPlan().toString()) == bool(limit)
    assert late.drop_rows(wide, losers.limit(0), ["k"]).count() == 100


def test_jsonl_roundtrip_keeps_instants(spark):
    df = spark.createDataFrame([("a", "2024-01-05 03:00:00.12", "b1"), ("b", "2024-01-05 03:00:00", "b2")],
                               "article_id string, published_at string, batch_id string") \
        .withColumn("published_at", F.col("published_at").cast("timestamp"))
    path = scratch_path(spark, "t-land")
    landing.write_jsonl(df, path)
    good, bad = landing.split_corrupt(landing.load_jsonl(spark, path))
    back = good.select("article_id", "published_at", "batch_id")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert bad.count() == 0


def test_mark_state_fallback_and_next(spark):
    bad = storage.state_row(spark, "m", "not-a-time", "2024-01-01 00:00:00")
    r = storage.read_mark(bad, "m", now="2024-02-02 00:00:00", lookback_hours=24).first()
    assert str(r.since) == "2024-02-01 00:00:00"
    loaded = spark.createDataFrame([("2024-02-01 05:00:00",)], "published_at string") \
        .withColumn("published_at", F.col("published_at").cast("timestamp"))
    nxt = storage.next_mark(bad, loaded, "m", now="2024-02-02 00:00:00").first()
    assert nxt.value == "2024-02-01T05:00:00+00:00"
    keep = storage.next_mark(storage.state_row(spark, "m", "2024-01-01T00:00:00+00:00"), loaded.limit(0), "m").first()
    assert keep.value == "2024-01-01T00:00:00+00:00"


def test_retention(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-02-20 00:00:00",)], "fetched_at string") \
        .withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    assert storage.retention_filter(df, "2024-03-01 00:00:00", 30).count() == 1


def test_mark_source_and_without_batch(spark):
    st = [storage.read_mark(storage.state_row(spark, "m", v, "2024-01-01 00:00:00"), "m", now="2024-02-02 00:00:00")
          .first().mark_source for v in ("2024-01-01T00:00:00+00:00", "garbage")]
    assert st == ["stored", "invalid_stored"]
    empty = storage.state_row(spark, "other", "x").filter(F.lit(False))
    assert storage.read_mark(empty, "m", now="2024-02-02 00:00:00").first().mark_source == "lookback"
    df = raw_rows(spark, [("a", "1", "2024-01-01", "b1"), ("b", "1", "2024-01-02", "b2"), ("c", "1", "2024-01-02", None)])
    assert sorted(r.article_id for r in storage.without_batch(df, "b2").collect()) == ["a", "c"]
