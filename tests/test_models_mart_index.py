"""Models behind a failed test are skipped, the mart follows its arrivals, lookups read few row groups."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph, transform
from newsloom.plans import models
from newsloom.session import scratch_path
from newsloom.sources import storage, versions


def test_a_failed_test_skips_what_lies_behind(spark):
    raw = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    built = []

    def step(name):
        return lambda *ups: built.append(name) or ups[0]

    reg = (models.ModelRegistry(spark).source("raw", raw)
           .model("bad", ["raw"], step("bad"), "table", {"k": ("not_null", "unique"), "v": ("not_null",)})
           .model("behind", ["good", "bad"], step("behind"), "table")
           .model("far", ["behind"], step("far"))
           .model("good", ["raw"], step("good"), "view", {"v": ("not_null", "unique")})
           .model("plain", ["good"], step("plain"), "table", {"v": ("not_null",)}))
    got = {r.model: (r.status, r.failures, r.blocked_by) for r in reg.build().collect()}
    assert got == {"bad": ("fail", 2, None), "behind": ("skipped", None, "bad"), "far": ("skipped", None, "bad"),
                   "good": ("pass", 0, None), "plain": ("pass", 0, None)}
    assert sorted(built) == ["bad", "good", "plain"]


def test_the_mart_equals_a_rebuild_after_each_arrival(spark):
    rows = [("a", "s", "2024-01-01", 5), ("a", "s", "2024-01-01", 0), ("b", "s", "2024-01-01", 1), (None, "s", "2024-01-01", 1),
            ("a", "t", "2024-01-01", 1), ("c", None, None, 2), ("c", None, None, 2), ("d", "s", "2024-01-02", 0)]
    staged = spark.createDataFrame(rows, "article_id string, source_name string, published_date string, content_length long") \
        .withColumn("published_date", F.col("published_date").cast("date"))
    arrivals = [staged.limit(3), staged, staged.where("article_id = 'c'"), staged.limit(0)]
    ids, deltas = scratch_path(spark, "t-ids"), scratch_path(spark, "t-deltas")
    versions.create_mart(spark, ids, deltas)
    so_far = staged.limit(0)
    for n, arrival in enumerate(arrivals):
        so_far = so_far.unionByName(arrival)
        versions.add_arrival(spark, arrival, ids, deltas, versions.version_name(n))
        if n == 1:                                                       # the arrival is repeated
            versions.add_arrival(spark, arrival, ids, deltas, versions.version_name(n))
        want = sorted(map(tuple, transform.daily_mart(so_far).collect()), key=repr)
        assert sorted(map(tuple, versions.mart(spark, deltas).collect()), key=repr) == want


@pytest.mark.parametrize("name,rows", [("name 777", 1), ("name 7770", 0)])
def test_a_lookup_reads_few_rows(spark, name, rows):
    nodes = spark.range(0, 4000).select(F.concat(F.lit("id"), "id").alias("id"), F.lit("Model").alias("label"),
                                        F.concat(F.lit("name "), "id").alias("name"), F.lit("x").alias("a1"))
    path = storage.write_indexed(nodes, scratch_path(spark, "t-index"), ["name", "id"], ("name", "id"), files=8)
    found = graph.name_lookup(spark.read.parquet(path), name)
    assert found.count() == rows
    df = graph.name_lookup(spark.read.parquet(path), name)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert read < 4000 / 4, read
