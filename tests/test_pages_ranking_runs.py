"""Page stop rules, whole payloads, open property sets, ranked search, run reports, verdict folding and gates."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph, ingest, ml, search
from newsloom.session import scratch_path
from newsloom.sources import audit, landing

NEW, OLD, MARK = "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-01 12:00:00"


def landed(spark, records, files=1):
    path = scratch_path(spark, "t-pages")
    spark.createDataFrame([(json.dumps(r),) for r in records], "value string").repartition(files).write.text(path)
    return landing.read_pages(spark, path)


def page(n, *times, run="r"):
    return {"run_id": run, "page": n, "articles": [{"title": f"{n}.{i}", "publishedAt": t} for i, t in enumerate(times)]}


@pytest.mark.parametrize("pages,titles", [
    ([page(1, NEW, NEW), page(2, NEW, NEW), page(3, NEW)], "1.0 1.1 2.0 2.1 3.0"),                    # ends with a short page
    ([page(1, NEW, NEW), page(2, NEW), page(3, NEW, NEW)], "1.0 1.1 2.0"),                            # nothing behind a short page
    ([page(1, NEW, NEW), page(2), page(3, NEW, NEW)], "1.0 1.1"),                                     # an empty page
    ([page(1, NEW, NEW), page(3, NEW, NEW)], "1.0 1.1"),                                              # an absent page
    ([page(2, NEW, NEW), page(3, NEW, NEW)], ""),
    ([page(1, NEW, NEW), page(2, NEW, OLD, NEW), page(3, NEW, NEW)], "1.0 1.1 2.0"),                  # an old item
    ([page(1, OLD, NEW), page(2, NEW, NEW)], ""),
    ([page(1, None, "12:30"), page(2, NEW, "")], "1.0 1.1 2.0 2.1"),                                  # unreadable times don't stop
    ([page(n, NEW, NEW) for n in range(1, 9)], "1.0 1.1 2.0 2.1 3.0 3.1 4.0 4.1 5.0 5.1"),            # at most five pages
    ([page(0, OLD), page(1, NEW, NEW)], "1.0 1.1"),
    ([{"run_id": "r", "page": 1, "articles": None}], ""), ([], ""),
])
def test_pages_are_cut_where_a_fetch_would_stop(spark, pages, titles):
    for files in (1, 3):
        kept = ingest.until_stop(landed(spark, pages, files), since=MARK, page_size=2)
        got = landing.page_items(kept).orderBy("page", "pos").collect()
        assert " ".join(r.title for r in got) == titles


def test_runs_stop_for_themselves_and_payloads_are_whole(spark):
    item = {"title": "T", "url": "u", "publishedAt": NEW, "source": {"id": None, "name": "S"}, "urlToImage": "i", "extra": {"a": [1]}}
    records = [page(1, NEW, OLD, run="a"), page(2, NEW, NEW, run="a"), {"run_id": "b", "page": 1, "articles": [item]}]
    items = landing.page_items(ingest.until_stop(landed(spark, records), since=MARK, page_size=1))
    assert sorted((r.run_id, r.title) for r in items.collect()) == [("a", "1.0"), ("b", "T")]
    raw = ingest.build_raw_articles(items, language="en", fetched_at=MARK).collect()
    assert [json.loads(r.raw_payload) for r in raw] == [item]


def test_projection_keeps_true_values_and_reports_open_properties(spark):
    rows = [("d1", "Deployment", "D", '{"replicas":5,"image":"i","zone":"x"}'), ("d2", "Deployment", "D", '{"zone":null,"image":7}'),
            ("m1", "Model", "M", '{"description":"text","zone":1}'), ("r1", "Run", "R", '{"metrics":{"a":0.5},"parameters":{"p":1}}'),
            ("r2", "Run", "R", None)]
    nodes = spark.createDataFrame([(*r, None, None) for r in rows], "id string, label string, name string, t string, a1 string, a2 string") \
        .withColumn("props", F.try_parse_json("t"))
    got = {r.id: r for r in graph.project_nodes(nodes).collect()}
    assert (got["d1"].replicas, got["d1"].image, got["d2"].replicas, got["m1"].replicas) == (5, "i", 1, None)
    assert (got["m1"].description, got["r1"].metrics, got["r1"].parameters, got["r2"].metrics) == ("text", {"a": 0.5}, {"p": "1"}, {})
    columns = nodes.drop("props").withColumn("replicas", F.lit(4).cast("long"))           # as the upsert keeps them
    assert {r.replicas for r in graph.project_nodes(columns).where("label = 'Deployment'").collect()} == {4}
    report = {(r.label, r.property): (r.nodes, r.type) for r in graph.property_report(nodes).collect()}
    assert report[("Deployment", "zone")] == (1, "STRING") and report[("Deployment", "image")] == (2, "VARIANT")
    assert report[("Run", "metrics")][0] == 1 and ("Run", "zone") not in report and report[("Model", "name")] == (1, "STRING")


def test_two_verdicts_are_one_relationship(spark):
    edges = spark.createDataFrame([("a", "T", "b"), ("c", "T", "d")], "source_id string, type string, target_id string")
    verdicts = spark.createDataFrame([("a", "T", "b", "PASS", True), ("a", "T", "b", "fail", None), ("x", "T", "y", "FAIL", True)],
                                     "source_id string, type string, target_id string, status string, in_truth boolean")
    r = graph.hallucination_rate(edges, verdicts).first()
    assert (r.n_relationships, r.n_unsupported, r.n_rejected, r.hallucination_rate) == (2, 1, 1, 1.0)


def test_nan_never_passes_the_gate(spark):
    runs = spark.createDataFrame([("a", float("nan")), ("b", None), ("c", 0.9)], "run_id string, accuracy double")
    assert {r.run_id: r.next_task for r in ml.gate_each(runs, 0.8).collect()} == {
        "a": ml.FAIL_TASK, "b": ml.FAIL_TASK, "c": ml.PASS_TASK}


def test_ranking_equals_the_formula(spark):
    docs = [(1, "river bank", "the river runs by the bank"), (2, "stone", "a river river river"), (3, None, "no match"), (4, "", "")]
    df = spark.createDataFrame(docs, "doc_id long, name string, description string")
    path = search.write_scored_index(df, {"name": F.col("name"), "description": F.col("description")}, scratch_path(spark, "t-index"))
    read = spark.read.parquet
    got = search.ranked(read(f"{path}/postings"), read(f"{path}/fields"), ["River", "bank"], 10, {"name": 3.0}).collect()
    idf = lambda total, n: math.log(1 + (total - n + 0.5) / (n + 0.5))
    gain = lambda tf, length, mean: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    mean_d = (6 + 4 + 2) / 3
    want = {1: 3 * 2 * idf(2, 1) * gain(1, 2, 1.5) + idf(3, 2) * gain(1, 6, mean_d) + idf(3, 1) * gain(1, 6, mean_d),
            2: idf(3, 2) * gain(3, 4, mean_d)}
    assert [r.doc_id for r in got] == [1, 2] and all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    assert search.ranked(read(f"{path}/postings"), read(f"{path}/fields"), ["absent"], 10).collect() == []


def test_run_report_cuts_runs_and_counts_streaks(spark):
    at = lambda s: (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).isoformat()
    events = [(0, "fetch", "success"), (50, "clean", "failed"), (170, "load", "failed"),        # 120 s apart: one run
              (291, "fetch", "failed"), (292, "fetch", "failed"), (2000, "fetch", "success"), (5000, "load", "failed")]
    df = spark.createDataFrame([(at(s), "p", stage, status) for s, stage, status in events] + [("never", "p", "x", "failed")],
                               "timestamp string, pipeline string, stage string, status string")
    got = [(r.run_no, r.seconds, r.events, r.failures, r.stages, r.first_failed_stage, r.failing_runs)
           for r in audit.run_report(df, 120).orderBy("run_no").collect()]
    assert got == [(1, 170.0, 3, 2, "fetch>clean>load", "clean", 1), (2, 1.0, 2, 2, "fetch", "fetch", 2),
                   (3, 0.0, 1, 0, "fetch", None, 0), (4, 0.0, 1, 1, "load", "load", 1)]
    assert audit.run_report(df.limit(0), 120).collect() == []
