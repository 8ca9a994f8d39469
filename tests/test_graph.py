"""Graph upserts and pattern matches on hand-made frames."""

from pyspark.sql import functions as F

from newsloom.operators import graph

NODE = "id string, label string, name string, a1 string, a2 string"


def test_node_upsert_last_wins_and_created_at_kept(spark):
    tgt = spark.createDataFrame([("m1", "Model", "old", "v1", "torch"), ("m2", "Model", "keep", "v1", None)], NODE) \
        .withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    batch = spark.createDataFrame([("m1", "Model", "n1", "v2", None, 1), ("m1", "Model", "n2", "v3", "jax", 2),
                                   ("m3", "Model", "new", "v1", None, 1)], NODE + ", ord int")
    out = {r.id: r for r in graph.upsert_nodes(tgt, batch, ["name", "a1", "a2"], as_of="2024-02-01 00:00:00").collect()}
    assert (out["m1"].name, out["m1"].a1, out["m1"].a2) == ("n2", "v3", "jax")
    assert str(out["m1"].created_at) == "2024-01-01 00:00:00" and out["m1"].last_updated is not None
    assert out["m2"].name == "keep" and out["m2"].last_updated is None
    assert out["m3"].name == "new" and str(out["m3"].created_at) == "2024-02-01 00:00:00"


def test_edge_upsert_merges_properties(spark):
    nodes = spark.createDataFrame([("a", "Model", "A", None, None), ("b", "Run", "B", None, None)], NODE)
    tgt = spark.createDataFrame([("a", "b", "PRODUCED_BY", {"x": "1", "y": "2"})],
                                "source_id string, target_id string, type string, properties map<string,string>") \
        .withColumn("ingested_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    batch = spark.createDataFrame([("a", "b", "PRODUCED_BY", {"y": None, "z": "3"}, 1),
                                   ("a", "b", "PRODUCED_BY", {"z": "4"}, 2),
                                   ("a", "missing", "PRODUCED_BY", {"q": "1"}, 3)],
                                  "source_id string, target_id string, type string, properties map<string,string>, ord int")
    out = graph.upsert_edges(tgt, batch, nodes, as_of="2024-02-01 00:00:00").collect()
    assert len(out) == 1
    assert out[0].properties == {"x": "1", "z": "4"}
    assert str(out[0].ingested_at) == "2024-02-01 00:00:00"


def test_resolve_and_orphans(spark):
    nodes = spark.createDataFrame([("a", "Model", "A", None, None), ("a", "Run", "A2", None, None),
                                   ("b", "Run", "B", None, None)], NODE)
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "x", "T"), ("y", "z", "T")], "source_id string, target_id string, type string")
    assert graph.resolve_edges(edges, nodes).count() == 2          # id under two labels matches twice
    reasons = sorted(r.reason for r in graph.orphan_edges(edges, nodes).collect())
    assert reasons == ["missing_both", "missing_target"]


def test_optional_match_ignores_dangling_edges(spark):
    nodes = spark.createDataFrame([("m1", "Model", "M", "v1", None), ("m2", "Model", "N", "v1", None),
                                   ("r1", "Run", "R", "done", None)], NODE)
    edges = spark.createDataFrame([("m1", "r1", "PRODUCED_BY"), ("m1", "r_gone", "PRODUCED_BY")],
                                  "source_id string, target_id string, type string")
    rows = sorted((r.model_id, r.run_id) for r in graph.model_details(nodes, edges).collect())
    assert rows == [("m1", "r1"), ("m2", None)]
    assert graph.model_details(nodes, edges, name="M").count() == 1


def test_lineage_counts_without_pairs(spark):
    nodes = spark.createDataFrame([("d", "Deployment", "D", None, None), ("m", "Model", "M", None, None),
                                   ("r1", "Run", "", None, None), ("r2", "Run", "", None, None),
                                   ("e", "Experiment", "", None, None)], NODE)
    edges = spark.createDataFrame([("d", "m", "SERVES"), ("m", "r1", "PRODUCED_BY"), ("m", "r2", "PRODUCED_BY"),
                                   ("r1", "e", "BELONGS_TO")], "source_id string, target_id string, type string")
    r = graph.lineage_counts(nodes, edges).first()
    assert (r.deployment_id, r.model_count, r.run_paths, r.experiment_paths) == ("d", 1, 2, 1)
    assert graph.lineage_paths(nodes, edges, "d").count() == 1


def test_coverage_null_when_empty(spark):
    empty = spark.createDataFrame([], "id string")
    covers = spark.createDataFrame([], "source_id string, target_id string")
    assert graph.coverage(empty, covers).first().coverage is None
