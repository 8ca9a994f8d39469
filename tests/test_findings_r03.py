"""Whole and equal results of the steps that were changed to scale: forests, edge metrics, row dedup, trimming, index totals."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.llm import bpe
from newsloom.operators import extract, forest, graph, late, ml, search
from newsloom.session import scratch_path
from newsloom.sources import versions


def test_grown_tree_is_pure_and_its_cuts_lead_back():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 6)), rng.integers(0, 4, 500)
    tree = forest.grow(x, y, np.ones(500), 4, 3, 30, rng)
    share = tree["votes"][forest.leaf_of(tree, x)]
    assert (share[np.arange(500), y] == 1).all()
    same = forest.grow(np.ones((5, 2)), np.array([0, 1, 1, 0, 1]), np.ones(5), 2, 2, 30, rng)
    assert len(same["child"]) == 1 and same["votes"].tolist() == [[0.4, 0.6]]
    flat = forest.grow(x, y, np.ones(500), 4, 3, 0, rng)
    assert len(flat["child"]) == 1


def test_forest_with_subtrees_learns_saves_loads_and_repeats(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 5)) + 3 * np.eye(5)[label]
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(600)]
    rows += [(700, [9.0] * 5, 2)] * 50                                     # copies that no cut separates, ids that repeat
    df = ml.with_features(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).drop("embedding")
    model = ml.train_forest(df, num_trees=8, plain_rows=100, subtree_rows=100)
    assert isinstance(model, ml.Forest) and model.top.stages[-1].getOrDefault("maxDepth") == 3
    loaded = ml.load_model(ml.save_model(model, scratch_path(spark, "t-forest")))
    out = ml.batch_predict(loaded, df, "vec_id", "v")
    got = sorted((r.vec_id, r.label, r.prediction) for r in out.collect())
    assert len(got) == 650 and sum(a == b for _, a, b in got) > 600
    below = lambda rows: sorted(map(tuple, forest.subtrees(model.top, rows.withColumn("label", F.col("label").cast("double")), "label",
                                                           ml.SEED, 27, True).select("tree", "leaf", "feature").collect()))
    assert below(df) == below(df.repartition(7))


def test_hallucination_rate_of_null_keys_and_repeats(spark):
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "b", "T"), (None, "b", "T"), ("c", "d", "T"), ("e", "f", "T")],
                                  "source_id string, target_id string, type string")
    verdicts = spark.createDataFrame([("a", "b", "T", "PASS", True), ("a", "b", "T", " fail ", False), (None, "b", "T", "FAIL", True),
                                      ("c", "d", "T", None, None), ("x", "y", "T", "FAIL", True)],
                                     "source_id string, target_id string, type string, status string, in_truth boolean")
    r = graph.hallucination_rate(edges, verdicts).first()
    assert tuple(r) == (5, 3, 2, 1.0)
    assert tuple(graph.hallucination_rate(edges.limit(0), verdicts).first()) == (0, 0, 0, None)


def test_edges_are_folded_under_their_hash(spark):
    e = spark.createDataFrame([("a", "T", "b", {"q": "1"}, 1), ("a", "T", "b", {"q": "2", "f": None}, 2), ("a", "T", "c", {}, 1)],
                              "source_id string, type string, target_id string, properties map<string,string>, ord long")
    got = {r.target_id: r._update for r in graph.fold_properties(e).collect()}
    assert got == {"b": {"q": "2", "f": None}, "c": {}}


def test_distinct_rows_shuffle_only_what_repeats(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), (None, None), ("c", "y")], "k string, t string")
    assert sorted(map(str, late.distinct_rows(df).collect())) == sorted(map(str, df.distinct().collect()))
    once = late.distinct_rows(df.where("k = 'b' or k = 'c'"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 2


def test_trim_is_that_of_the_whitespace_class(spark):
    texts = [None, "", " \n", "a", "`json`"] + [f"{c}a{c}b{c}{c}" for c in text.WHITESPACE] + [f"{chr(c)}x" for c in (0x180E, 0x200B, 0xFEFF, 0)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rx = F.regexp_replace("s", f"^{text.WHITESPACE_CLASS}+|{text.WHITESPACE_CLASS}+$", "")
    assert all(r[0] == r[1] for r in df.select(text.unicode_trim("s"), rx).collect())


def test_verdict_is_parsed_once(spark):
    df = spark.createDataFrame([('```json\n{"status":" warn","reasoning":"r"}\n```',), ("no",), (None,)], "reply string")
    out = extract.parse_verdicts(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert [tuple(r)[1:] for r in out.collect()] == [("WARN", "r", None), (None, None, None), (None, None, None)]


def test_index_totals_come_from_the_documents(spark):
    docs = spark.createDataFrame([(1, "a b b"), (1, "a b b"), (2, ""), (3, None), (4, "c")], "doc_id long, text string")
    path = search.write_scored_index(docs, {"text": F.col("text")}, scratch_path(spark, "t-index"))
    totals = spark.read.parquet(f"{path}/fields").collect()
    assert [(r.field, r.documents, r.mean_length) for r in totals] == [("text", 2, 2.0)]
    assert {(r.term, r.doc_id): r.tf for r in spark.read.parquet(f"{path}/postings").collect()} == {
        ("a", 1): 2, ("b", 1): 4, ("c", 4): 1}


def test_unique_rows_of_a_version_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.range(10).mapInArrow(count, "id long")
    versions.append_version(rows, scratch_path(spark, "t-unique"), "v1", "id", unique=True)
    assert seen.value == 10


def test_plain_words_share_the_memo_of_the_chunks():
    import importlib
    from pathlib import Path
    path = str(importlib.import_module("public_tokenizers").path("word_bpe_49k.json"))
    coder = bpe.TrieEncoder(Path(path).read_text(encoding="utf-8"))
    coder.encode(["Alpha beta, beta gamma! é"])
    assert {"alpha", "beta", "gamma"} <= coder.chunks.keys() and not {"alpha", "beta", "gamma"} & coder.words.keys()
