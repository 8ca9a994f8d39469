"""Train, gate and batch-score with Spark ML."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.time import version_string
from newsloom.operators import forest
from newsloom.operators.forest import Forest

# ---- fixed values ------------------------------------------------------------------------------
TRAIN_PERCENT = 80
SEED = 42
NUM_TREES = 100
ACCURACY_GATE = 0.82
PASS_TASK = "register_model"
FAIL_TASK = "notify_training_failure"
MAX_DEPTH = 30          # the deepest trees Spark grows
PLAIN_ROWS = 2000       # training rows up to which Spark ML grows whole trees
SUBTREE_ROWS = 4096     # training rows of one subtree of more rows, if cuts halve them
# -------------------------------------------------------------------------------------------------


def hash_split(df: DataFrame, id_col: str, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """M1: deterministic 80/20 split by a hash of the id (stable under repartitioning and retries,
    unlike ``randomSplit``, whose result depends on the partitioning). The bucket is the first
    32 bits of the id's MD5, mod 100."""
    digest = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    bucket = F.pmod(digest, F.lit(100))
    return df.withColumn("split", F.when(bucket < train_percent, "train").otherwise("test"))


def with_features(df: DataFrame, array_col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def train_forest(train: DataFrame, label: str = "label", num_trees: int = NUM_TREES, seed: int = SEED,
                 max_depth: int = MAX_DEPTH, plain_rows: int = PLAIN_ROWS, subtree_rows: int = SUBTREE_ROWS) -> PipelineModel | Forest:
    """M2: random forest, 100 trees grown to purity (or Spark's deepest level), fixed seed, on ``features``.

    Above ``plain_rows`` rows Spark ML grows the tops and tasks the subtrees below them, see :mod:`newsloom.operators.forest`.
    """
    rows = train.count()
    whole = rows <= plain_rows
    depth = max_depth if whole else min(max_depth, max(1, math.ceil(math.log2(rows / subtree_rows))))
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, seed=seed, maxDepth=depth,
                                minInstancesPerNode=1)
    train = train.withColumn(label, F.col(label).cast("double"))
    model = Pipeline(stages=[rf]).fit(train)
    return model if whole else Forest(model, forest.subtrees(model, train, label, seed, max_depth - depth, num_trees > 1))


def save_model(model: PipelineModel | Forest, path: str) -> str:
    """Persist the fitted model."""
    if isinstance(model, Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | Forest:
    """Load; a missing model raises."""
    return forest.load(SparkSession.active(), path) or PipelineModel.load(path)


def batch_predict(model: PipelineModel | Forest, df: DataFrame, id_col: str, version: str) -> DataFrame:
    """M4/M5: class (BIGINT) and model version per input row."""
    scored = model.transform(df)
    keep = [c for c in df.columns if c not in ("features",)]
    return scored.select(*keep, F.col("prediction").cast("bigint").alias("prediction"),
                         F.lit(version).alias("model_version"))


def accuracy(predictions: DataFrame, label: str = "label") -> DataFrame:
    """Processed count and the share of correct predictions."""
    hit = (F.col("prediction") == F.col(label).cast("bigint")).cast("double")
    return predictions.agg(F.count(F.lit(1)).alias("processed"), F.round(F.avg(hit), 6).alias("accuracy"))


def gate(runs: DataFrame, threshold: float = ACCURACY_GATE, run_id: str = "run_id", metric: str = "accuracy",
         finished_at: str = "finished_at") -> DataFrame:
    """The best run (ties by run id; NULL and NaN never win) decides: register above the gate, else notify.

    The version string is the finish time of that run (``vYYYYmmddHHMMSS``).
    """
    measured = F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))
    best = runs.agg(
        F.min_by(F.struct(F.col(run_id).alias("run_id"), F.col(metric).alias("accuracy"),
                          F.col(finished_at).alias("finished_at")),
                 F.when(measured, F.struct(-F.col(metric), F.col(run_id)))).alias("b"),
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(measured & (F.col(metric) >= F.lit(threshold))).alias("n_passing"))
    return best.select(
        "b.run_id", F.round("b.accuracy", 6).alias("accuracy"), "n_runs", "n_passing",
        F.when(F.col("b.accuracy") >= F.lit(threshold), PASS_TASK).otherwise(FAIL_TASK).alias("next_task"),
        version_string(F.col("b.finished_at")).alias("model_version"))


def gate_each(runs: DataFrame, threshold: float = ACCURACY_GATE, metric: str = "accuracy") -> DataFrame:
    """P17 per run: the branch each run would take. A NULL or NaN metric never passes."""
    measured = F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))
    return runs.withColumn("next_task", F.when(measured & (F.col(metric) >= F.lit(threshold)), PASS_TASK).otherwise(FAIL_TASK))
