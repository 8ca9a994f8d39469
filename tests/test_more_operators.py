"""Operators without their own registry entry: nested item scan, quarantine, J9, T6, U2, P16."""

import json

from pyspark.sql import functions as F

from newsloom.operators import chat, extract, graph, ingest
from newsloom.session import scratch_path
from newsloom.sources import audit, landing


def test_read_nested_items_then_build(spark):
    path = scratch_path(spark, "t-items")
    items = [{"source": {"id": "s1", "name": " Wire "}, "title": "A  b", "url": "u1", "publishedAt": "2026-04-01T01:00:00Z"},
             {"source": {"name": None}, "title": "C", "url": "u2", "publishedAt": "2026-04-01T02:00:00Z",
              "content": "  body  "}]
    spark.sparkContext.parallelize([json.dumps(i) for i in items], 1).saveAsTextFile(path)
    df = landing.read_items(spark, path)
    raw = {r.url: r for r in ingest.build_raw_articles(df, run_id="r", language="en",
                                                         fetched_at="2026-04-02 00:00:00").collect()}
    assert raw["u1"].source_name == "Wire" and raw["u1"].source_id == "s1" and raw["u1"].title == "A b"
    assert raw["u2"].source_name == "unknown" and raw["u2"].content == "body"
    assert json.loads(raw["u1"].raw_payload)["publishedAt"] == "2026-04-01T01:00:00Z"


def test_quarantine_artifact(spark):
    df = spark.createDataFrame([(1, "junk"), (2, "{}")], "doc_id long, response string")
    _, review = extract.route(extract.parse_responses(df))
    path = scratch_path(spark, "t-quarantine")
    audit.write_quarantine(review.select("doc_id", "status", "reason"), path)
    back = spark.read.json(path).collect()
    assert [(r.doc_id, r.reason) for r in back] == [(1, "response is not JSON")]


def test_unsupported_edges_and_verdicts(spark):
    rel = spark.createDataFrame([("a", "SERVES", "b"), ("c", "SERVES", "d")], "source_id string, type string, target_id string")
    truth = spark.createDataFrame([("a", "SERVES", "b")], "source_id string, type string, target_id string")
    assert [r.source_id for r in graph.unsupported_edges(rel, truth).collect()] == ["c"]
    replies = spark.createDataFrame([('{"status": "pass", "reasoning": "ok"}',), ("```json\n{\"status\":\"BAD\"}\n```",)], "reply string")
    got = [r.status for r in extract.parse_verdicts(replies).collect()]
    assert got == ["PASS", None]


def test_append_messages_and_branch(spark):
    a = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    b = spark.createDataFrame([(1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    both = chat.append_messages(a, b)
    assert chat.transcripts(both).first().transcript == "user: hi\nassistant: yo"
    assert ingest.has_rows(both) and not ingest.has_rows(both.filter(F.lit(False)))


def test_run_log_metrics_params_texts(spark):
    runs = spark.createDataFrame([("r1", 0.9, 32, "ok")], "run_id string, acc double, bs int, note string")
    log = audit.run_log(runs, "run_id", metrics={"accuracy": "acc"}, params={"batch_size": "bs"}, texts={"note": "note"})
    assert sorted((r.kind, r.key) for r in log.collect()) == [("metric", "accuracy"), ("param", "batch_size"), ("text", "note")]
    m = audit.pivot_run_log(log, ["accuracy"]).first()
    p = audit.pivot_run_log(log, ["batch_size"], kind="param").first()
    assert m.accuracy == 0.9 and p.batch_size == "32"
