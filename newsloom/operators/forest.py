"""Random forests on many rows: Spark ML grows the tops of the trees, tasks grow each subtree below from its own rows.

Spark ML keeps a histogram of every open node, however few rows reach it, so growing to purity costs a pass per few
thousand nodes. Here it only grows the levels at which a node still has many rows. The rows of each leaf of a top then meet
in one group of bounded size, and the group grows the rest: a bag drawn for the subtree (a Poisson weight per row), at every
node the best cut by Gini impurity among a random share of the features, all nodes of a level at once.

The fitted subtrees are a table, one row per (tree, leaf); neither rows nor subtrees pass through the driver. Rows with
equal features and label are one row with a count, so that copies, which no cut separates, don't fill a group.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import checkpoint_dir

# The functions of this module travel with the tasks by value, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUBTREES = "tree int, leaf int, feature array<int>, threshold array<double>, child array<int>, votes array<double>"


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tries: int, depth: int, rng: np.random.Generator) -> dict:
    """One tree on weighted rows: per node its feature (-1: leaf), threshold, first child and class shares.

    A row goes to the first child if its feature is at most the threshold, else to the one after it.
    """
    feature, threshold, child, votes = [], [], [], []
    rows, m = np.flatnonzero(w > 0), 1
    at = np.zeros(len(rows), np.int64)
    made = 1                                    # nodes so far; those of the open level are the last m
    while m:
        counts = np.bincount(at * classes + y[rows], w[rows], m * classes).reshape(m, classes)
        total = counts.sum(axis=1)
        votes.append(counts / total[:, None])
        best = np.full(m, -np.inf)
        pick, cut = np.full(m, -1), np.zeros(m)
        open_ = ((counts > 0).sum(axis=1) > 1) & (depth > 0)
        order = np.argsort(rng.random((m, x.shape[1])), axis=1)
        for j in range(x.shape[1]):
            todo = open_ if j < tries else open_ & (pick < 0)       # a node without a cut so far looks at more features
            if not todo.any():
                break
            on = todo[at]
            r, node = rows[on], at[on]
            v = x[r, order[node, j]]
            o = np.lexsort((v, node))
            r, node, v = r[o], node[o], v[o]
            left = np.zeros((len(r), classes))
            left[np.arange(len(r)), y[r]] = w[r]
            left = left.cumsum(axis=0)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            before = np.where(first[:, None] > 0, left[first - 1], 0.0)
            left -= np.repeat(before, np.diff(np.r_[first, len(r)]), axis=0)
            i = np.flatnonzero((node[1:] == node[:-1]) & (v[:-1] < v[1:]))
            if not len(i):
                continue
            left, here = left[i], node[i]
            right, n_left = counts[here] - left, left.sum(axis=1)
            score = (left ** 2).sum(axis=1) / n_left + (right ** 2).sum(axis=1) / (total[here] - n_left)
            o = np.lexsort((-score, here))
            top = o[np.r_[True, here[o][1:] != here[o][:-1]]]
            top = top[score[top] > best[here[top]]]
            n, k = here[top], i[top]
            middle = v[k] / 2 + v[k + 1] / 2
            best[n], pick[n], cut[n] = score[top], order[n, j], np.where((middle >= v[k]) & (middle < v[k + 1]), middle, v[k])
        split = pick >= 0
        rank = np.cumsum(split) - 1
        feature.append(pick)
        threshold.append(cut)
        child.append(np.where(split, made + 2 * rank, -1))
        on = split[at]
        rows, at = rows[on], at[on]
        at = 2 * rank[at] + ~(x[rows, pick[at]] <= cut[at])
        m = 2 * int(split.sum())
        made += m
        depth -= 1
    return {"feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "child": np.concatenate(child),
            "votes": np.concatenate(votes)}


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf node that each row reaches."""
    node = np.zeros(len(x), np.int64)
    while True:
        on = np.flatnonzero(tree["child"][node] >= 0)
        if not len(on):
            return node
        n = node[on]
        node[on] = tree["child"][n] + ~(x[on, tree["feature"][n]] <= tree["threshold"][n])


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _spread(top: PipelineModel, df: DataFrame, *keep) -> DataFrame:
    """Each row once per tree, with the leaf of the tree's top that it reaches."""
    leaves = top.stages[-1].copy().setLeafCol("_leaf").transform(df.select("features", *keep))
    names = [c for c in leaves.columns if c in keep]
    return leaves.select(*names, vector_to_array("features").alias("x"),
                         F.posexplode(vector_to_array("_leaf")).alias("tree", "_leaf_at")).select(
        *names, "x", "tree", F.col("_leaf_at").cast("int").alias("leaf"))


@dataclass
class Forest:
    """A fitted forest: the tops as a pipeline, and the subtrees below their leaves as a table."""

    top: PipelineModel
    subtrees: DataFrame

    def save(self, path: str) -> None:
        self.top.write().overwrite().save(f"{path}/top")
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the class with the largest sum of the trees' class shares, of equals the smallest."""
        checkpoint_dir(df.sparkSession)
        df = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)

        def votes(rows: pa.Table, trees: pa.Table) -> pa.Table:
            n = rows.num_rows
            out = {"_row": pa.array([], pa.int64()), "class": pa.array([], pa.int32()), "share": pa.array([], pa.float64())}
            if n and trees.num_rows:
                tree = {c: trees[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "child")}
                share = trees["votes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(tree["child"]), -1)
                got = share[leaf_of(tree, _matrix(rows["x"], n))]
                i, c = np.nonzero(got)
                out = {"_row": rows["_row"].combine_chunks().take(pa.array(i)), "class": pa.array(c.astype(np.int32)), "share": pa.array(got[i, c])}
            return pa.table(out)

        near = _spread(self.top, df, "_row").groupBy("tree", "leaf").cogroup(self.subtrees.groupBy("tree", "leaf"))
        shares = near.applyInArrow(votes, "_row long, class int, share double")
        won = (shares.groupBy("_row", "class").agg(F.round(F.sum("share"), 9).alias("share"))
               .groupBy("_row").agg(F.max_by(F.col("class"), F.struct("share", -F.col("class"))).cast("double").alias("prediction")))
        return df.join(won, "_row", "left").drop("_row")


def subtrees(top: PipelineModel, train: DataFrame, label: str, seed: int, max_depth: int, bagged: bool) -> DataFrame:
    """The subtrees below the leaves of ``top``, grown from the rows of ``train`` that reach them."""
    classes = top.stages[-1].numClasses

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        tree, leaf = (k.as_py() for k in key)
        table = table.sort_by([("_hash", "ascending"), ("_label", "ascending")])     # the same subtree in whichever order rows arrive
        x, y = _matrix(table["x"], table.num_rows), table["_label"].to_numpy().astype(np.int64)
        copies = table["_copies"].to_numpy().astype(np.int64)
        rng = np.random.default_rng([seed, tree, leaf])
        w = rng.poisson(copies) if bagged else copies
        tries = math.ceil(math.sqrt(x.shape[1])) if bagged else x.shape[1]
        got = grow(x, y, (w if w.any() else copies).astype(float), classes, tries, max_depth, rng)
        return pa.table({"tree": pa.array([tree], pa.int32()), "leaf": pa.array([leaf], pa.int32()),
                         "feature": pa.array([got["feature"].astype(np.int32)], pa.list_(pa.int32())),
                         "threshold": pa.array([got["threshold"]], pa.list_(pa.float64())),
                         "child": pa.array([got["child"].astype(np.int32)], pa.list_(pa.int32())),
                         "votes": pa.array([got["votes"].ravel()], pa.list_(pa.float64()))})

    once = (train.select(vector_to_array("features").alias("x"), F.col(label).alias("_label")).groupBy("x", "_label")
            .agg(F.count(F.lit(1)).alias("_copies"))
            .select(array_to_vector("x").alias("features"), "_label", "_copies", F.xxhash64("x").alias("_hash")))
    return _spread(top, once, "_label", "_copies", "_hash").groupBy("tree", "leaf").applyInArrow(grown, SUBTREES)


def load(spark: SparkSession, path: str) -> Forest | None:
    """The forest saved at ``path``; None where a plain pipeline (or nothing) lies there."""
    try:
        table = spark.read.schema(SUBTREES).parquet(f"{path}/subtrees")
    except AnalysisException:
        return None
    return Forest(PipelineModel.load(f"{path}/top"), table)
