"""ML split/train/predict/gate and the data-quality checks on small frames."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import ml, quality
from newsloom.session import scratch_path
from tests.conftest import SF_SMALL


def test_hash_split_is_stable_under_repartitioning(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    a = {r.vec_id: r.split for r in ml.hash_split(df, "vec_id").collect()}
    b = {r.vec_id: r.split for r in ml.hash_split(df.repartition(7), "vec_id").collect()}
    assert a == b and 0.6 < sum(v == "train" for v in a.values()) / len(a) < 0.95


def test_train_save_load_predict_batch_and_single(spark):
    df = ml.with_features(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"))
    model = ml.train_forest(df, num_trees=5)
    path = ml.save_model(model, scratch_path(spark, "t-model"))
    loaded = ml.load_model(path)
    two = df.orderBy("vec_id").limit(2).select("vec_id", "label", "features")
    out = ml.batch_predict(loaded, two, "vec_id", "v2.1-iris").collect()
    assert len(out) == 2 and all(isinstance(r.prediction, int) and r.model_version == "v2.1-iris" for r in out)
    one = ml.batch_predict(loaded, two.limit(1), "vec_id", "v2.1-iris").first()
    assert one.prediction == out[0].prediction                      # single predict = batch of one
    acc = ml.accuracy(ml.batch_predict(loaded, df.select("vec_id", "label", "features"), "vec_id", "v")).first()
    assert acc.processed == df.count() and 0.0 <= acc.accuracy <= 1.0


def test_gate_breaks_ties_by_run_id(spark):
    runs = spark.createDataFrame([("run_b", 0.9, "2024-01-02 03:04:05"), ("run_a", 0.9, "2024-01-01 00:00:00"),
                                  ("run_c", 0.5, "2024-01-03 00:00:00")], "run_id string, accuracy double, finished_at string") \
        .withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    g = ml.gate(runs).first()
    assert (g.run_id, g.next_task, g.model_version, g.n_passing) == ("run_a", "register_model", "v20240101000000", 2)
    low = ml.gate(runs.filter(F.col("accuracy") < 0.8)).first()
    assert low.next_task == "notify_training_failure"


def test_not_null_and_unique(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "y"), ("b", "z")], "id string, t string")
    res = {(r.column, r.test): r.failures for r in quality.suite(quality.column_tests(
        df, "m", {"id": ("not_null", "unique"), "t": ("not_null",)})).collect()}
    assert res == {("id", "not_null"): 1, ("t", "not_null"): 1, ("id", "unique"): 1}


def test_freshness_levels(spark):
    df = spark.createDataFrame([("2024-02-01 00:00:00",)], "fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    lv = [quality.freshness(df, "s", now=n).first().status
          for n in ("2024-02-01 12:00:00", "2024-02-02 12:00:00", "2024-02-03 12:00:00")]
    assert lv == ["pass", "warn", "error"]


def test_ranges_schema_and_required(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, None), (-1.0, 3)], "accuracy double, n int")
    v = {r.column: r.violations for r in quality.range_violations(df, "t", {"accuracy": (0.0, 1.0), "n": (1, None)}).collect()}
    assert v == {"accuracy": 2, "n": 0}
    expected = T.StructType([T.StructField("accuracy", T.DoubleType()), T.StructField("n", T.IntegerType(), False),
                             T.StructField("gone", T.StringType())])
    d = {r.column: (r.issue, r.null_count) for r in quality.schema_diff(df, expected).collect()}
    assert d == {"accuracy": ("ok", None), "n": ("ok", 1), "gone": ("missing", None)}
    ok, bad = quality.require(df, ["n"])
    assert ok.count() == 2 and bad.first().reason == "missing required: n"


def test_sizing_conf_scales_with_input():
    from newsloom.session import sizing_conf
    small = sizing_conf(37 << 20, 8)
    big = sizing_conf(100 << 40, 8000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(big["spark.sql.shuffle.partitions"]) >= (100 << 40) // (256 << 20)
    assert int(big["spark.sql.shuffle.partitions"]) % 8000 == 0
