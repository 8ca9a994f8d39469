"""Exact top-k by inner product with pivot-table elimination.

With M the largest norm, every candidate x gets one more component sqrt(M^2 - |x|^2) and every query q a zero, so that
d(q, x)^2 = |q|^2 + M^2 - 2 q.x: the largest inner products are the nearest points. The table holds each candidate's
distances to many pivots; for a query, the largest |d(q, p) - d(x, p)| over the pivots p bounds d(q, x) from below and
so q.x from above. Candidates are evaluated exactly in the order of that bound until the k-th best score is above the
next bound. Bounds carry a margin for rounding; scores are integers.

Queries meet candidates block by block: both are cut into blocks of bounded size by a hash, and each pair of blocks is
one group of a cogrouped map that returns k rows per query. No block grows with the data and none passes the driver;
only the pivots do, chosen farthest-first from a bounded sample.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id; repeated rows of an id count once (the smallest vector); vectors of another length than the query's are no
candidates for it; fewer than k candidates are all returned; ties go to the smaller id; empty tables give no rows.
Scores must fit a long. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import written

PIVOTS = 32
PIVOT_SAMPLE = 2_000
SCALE = 1024
CANDIDATE_BLOCK = 20_000
QUERY_BLOCK = 2_000
STEP = 64                                       # candidates evaluated between two tests for stopping


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component, x as double; null where the vector takes no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))     # noqa: E731
    whole = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)
    return F.when(whole, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points of a sample."""
    if not len(sample):
        return sample
    picked = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(count, len(sample)):
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted points to lifted pivots."""
    square = (v ** 2).sum(1)[:, None] + (pivots[:, :-1] ** 2).sum(1)[None, :] - 2 * v @ pivots[:, :-1].T
    return np.sqrt(np.maximum(square + (extra[:, None] - pivots[:, -1][None, :]) ** 2, 0))


def search_block(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
                 c_far: np.ndarray, top: float, k: int) -> list[tuple[int, int, int]]:
    """``(query, candidate, score)`` of the k best candidates of the block per query."""
    out = []
    for qi, qv, qd in zip(q_ids, q, q_far, strict=True):
        least = np.abs(c_far - qd).max(axis=1) if c_far.shape[1] else np.zeros(len(c))
        span = float((qv.astype(float) ** 2).sum()) + top * top
        bound = (span - least ** 2) / 2 + 1e-6 * span + 1
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(order), STEP):
            if len(scores) >= k and scores[k - 1] > bound[order[at]]:
                break
            these = order[at:at + STEP]
            these = these[c_ids[these] != qi]
            ids = np.concatenate([ids, c_ids[these]])
            scores = np.concatenate([scores, c[these] @ qv])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        out += zip([int(qi)] * len(ids), ids.tolist(), scores.tolist(), strict=True)
    return out


def pivot_table(rows: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``(table, norms)``: ``vec_id, v, dim, far`` with distances to the pivots of the same length, and the largest norm
    per length."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norms = rows.groupBy("dim").agg(F.sqrt(F.max(norm)).alias("top"))
    sample = (rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).join(norms, "dim")
              .select("dim", "v", "top").collect())
    lifted: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in sample}:
        v = np.array([r.v for r in sample if r.dim == dim], float)
        top = next(r.top for r in sample if r.dim == dim)
        extra = np.sqrt(np.maximum(top * top - (v ** 2).sum(1), 0))
        lifted[dim] = choose_pivots(np.column_stack([v, extra]), pivots)

    def run(batches):
        for batch in batches:
            dims, tops = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            far: list = [None] * len(dims)
            vectors = batch.column(1).to_pylist()
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                if dim not in lifted:
                    for i in at:
                        far[i] = []
                    continue
                v = np.array([vectors[i] for i in at], float)
                extra = np.sqrt(np.maximum(tops[at[0]] ** 2 - (v ** 2).sum(1), 0))
                for i, row in zip(at, _distances(v, extra, lifted[dim]), strict=True):
                    far[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float64()))],
                                             ["vec_id", "v", "dim", "top", "far"])

    table = (rows.join(norms, "dim").select("vec_id", "v", "dim", "top")
             .mapInArrow(run, "vec_id long, v array<long>, dim int, top double, far array<double>"))
    return table, lifted


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``is_query`` (an expression over ``vec_id``), the k other
    rows with the highest integer inner product."""
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                  quantise(F.col("embedding"), scale).alias("v"))
                   .where("vec_id is not null and v is not null")
                   .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "topk-rows")
    table, lifted = pivot_table(rows)
    table = written(table, "topk-table")
    sizes = table.agg(F.count("*"), F.count_if(is_query)).first()
    c_blocks, q_blocks = -(-sizes[0] // CANDIDATE_BLOCK) or 1, -(-sizes[1] // QUERY_BLOCK) or 1
    spread = F.xxhash64("vec_id")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))                # noqa: E731
    queries = (table.where(is_query).withColumn("qb", F.pmod(spread, F.lit(q_blocks)).cast("int"))
               .withColumn("cb", all_of(c_blocks)))
    candidates = (table.withColumn("cb", F.pmod(spread, F.lit(c_blocks)).cast("int"))
                  .withColumn("qb", all_of(q_blocks)))

    def run(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        q_dim, c_dim = np.array(q["dim"].to_pylist(), int), np.array(c["dim"].to_pylist(), int)
        for dim in set(q_dim.tolist()) & set(c_dim.tolist()):
            a, b = q.filter(pa.array(q_dim == dim)), c.filter(pa.array(c_dim == dim))
            grid = lambda t, name, kind: np.array(t[name].to_pylist(), kind).reshape(len(t), -1)
            found += search_block(grid(a, "vec_id", np.int64)[:, 0], grid(a, "v", np.int64), grid(a, "far", float),
                                  grid(b, "vec_id", np.int64)[:, 0], grid(b, "v", np.int64), grid(b, "far", float),
                                  a["top"][0].as_py(), k)
        return pa.table({n: pa.array([f[i] for f in found], pa.int64())
                         for i, n in enumerate(("query_id", "vec_id", "score"))})

    found = (queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))
             .applyInArrow(run, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
