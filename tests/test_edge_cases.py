"""Rows that must not get lost or count twice: NULL partitions, moved keys, split arrivals, wrong types, NULL measures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import chat_role
from newsloom.functions.time import parse_instant
from newsloom.operators import extract, graph, ml, telemetry
from newsloom.session import scratch_path
from newsloom.sources import versions
from newsloom.streaming import telemetry as s_tel

SCHEMA = "article_id string, title string, published_date date"
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


@pytest.mark.parametrize("target,source,want", [
    ([("a", "o", None), ("b", "o", None), ("c", "o", D1)], [("a", "n", None)],
     [("a", "n", None), ("b", "o", None), ("c", "o", D1)]),                     # the NULL partition keeps its other rows
    ([("a", "o", D1), ("b", "o", D1)], [("a", "n", D2)], [("a", "n", D2), ("b", "o", D1)]),       # a key moves
    ([("a", "o", D1), ("b", "o", D2)], [("a", "n", D2)], [("a", "n", D2), ("b", "o", D2)]),       # and empties its old date
    ([("a", "o", None), ("b", "o", D2)], [("a", "n", D2)], [("a", "n", D2), ("b", "o", D2)]),
    ([("a", "o", D1)], [], [("a", "o", D1)]),
])
def test_upsert_keeps_null_partitions_and_moves_keys(spark, target, source, want):
    path = scratch_path(spark, "t-moved")
    for n, rows in enumerate((target, source)):
        versions.upsert(spark, path, spark.createDataFrame(rows, SCHEMA), versions.version_name(n))
    table = versions.all_versions(spark, path, T.StructType.fromDDL(SCHEMA))
    got = [tuple(r) for r in versions.newest(table, "article_id").select("article_id", "title", "published_date").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_untouched_nodes_keep_every_column(spark):
    old = dt.datetime(2023, 1, 1)
    target = spark.createDataFrame([("Run", "r1", "one", "kept", old), ("Run", "r2", "two", "too", old)],
                                   "label string, id string, name string, description string, created_at timestamp")
    batch = spark.createDataFrame([("Run", "r2", "zwei", 1), ("Run", "r3", "drei", 2)],
                                  "label string, id string, name string, ord long")
    got = {r.id: r for r in graph.upsert_nodes(target, batch, ["name"], as_of="2024-02-01 00:00:00").collect()}
    new = dt.datetime(2024, 2, 1)
    assert (got["r1"].description, got["r1"].created_at, got["r1"].last_updated) == ("kept", old, None)
    assert (got["r2"].name, got["r2"].description, got["r2"].created_at, got["r2"].last_updated) == ("zwei", "too", old, new)
    assert (got["r3"].description, got["r3"].created_at) == (None, new)
    bare = spark.createDataFrame([("Run", "r1", "one")], "label string, id string, name string")
    assert graph.upsert_nodes(bare, batch, ["name"], as_of="2024-02-01 00:00:00").filter("id = 'r1'").first().created_at is None


@pytest.mark.parametrize("reply,status", [
    ("[]", "invalid"), ("5", "invalid"), ('"text"', "invalid"), ("null", "invalid"), ('{"models":"abc"}', "invalid"),
    ('{"models":null}', "invalid"), ('{"runs":[{"id":"r","name":"n","metrics":{"a":"high"}}]}', "invalid"),
    ('{"runs":[{"id":"r","name":"n","metrics":{"a":0.5}}]}', "valid"), ("{}", "valid"), ("no", "junk")])
def test_reply_types(spark, reply, status):
    df = spark.createDataFrame([(1, reply)], "doc_id long, response string")
    assert extract.parse_responses(df).first().status == status


def test_time_alone_is_malformed(spark):
    df = spark.createDataFrame([("T12:30:00",), ("12:30",), ("2024",), ("2024-01-05",), ("2024-01-05T01:02:03Z",)], "x string")
    got = [r[0] for r in df.select(parse_instant("x")).collect()]
    assert got == [None, None, None, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 1, 2, 3)]


def test_roles_starting_with_ai(spark):
    df = spark.createDataFrame([("AIMessage",), ("ai",), ("human",), (None,)], "r string")
    assert [r[0] for r in df.select(chat_role("r")).collect()] == ["assistant", "assistant", "user", "user"]


def test_unmeasured_runs_never_win(spark):
    rows = [("a", None), ("b", 0.95), ("c", float("nan"))]
    df = spark.createDataFrame([(r, a, dt.datetime(2024, 1, 1)) for r, a in rows],
                               "run_id string, accuracy double, finished_at timestamp")
    g = ml.gate(df).first()
    assert (g.run_id, g.next_task, g.n_runs, g.n_passing) == ("b", "register_model", 3, 1)


def test_unmeasured_latencies_do_not_move_the_quantile(spark):
    df = spark.createDataFrame([("e", 0.004)] * 90 + [("e", None)] * 10, "endpoint string, latency_s double")
    aggs, finish = telemetry.histogram_quantile(0.95)
    row = finish(df.groupBy("endpoint").agg(*aggs(F.col("latency_s")))).first()
    assert 0.004 <= max(v for v in row if isinstance(v, float)) <= 0.005
    counted = telemetry.latency_buckets(df).filter("le = '+Inf'").first()
    assert (counted.latency_count, counted.bucket_count) == (90, 90)


def test_stream_equals_batch_with_many_files_per_arrival(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=17 * i), "GET", f"/{i % 3}", 500 if i % 7 == 0 else 200, 0.1) for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, method string, endpoint string, status int, latency_s double")
    landed, result = scratch_path(spark, "t-req"), scratch_path(spark, "t-rate")
    for week in range(3):
        part = df.filter(F.floor(F.datediff("ts", F.lit(start)) / 7) == week)
        part.repartition(4, "event_id").write.mode("append").parquet(landed)    # files overlap in time
    s_tel.rate_stream(spark, landed, df.schema, result, scratch_path(spark, "t-ckpt"), bytes_per_trigger=1)
    got = spark.read.parquet(result)
    want = df.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "endpoint").count()
    assert got.count() == want.count()
    assert got.agg(F.sum("requests")).first() == want.agg(F.sum("count")).first()
