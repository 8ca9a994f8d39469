"""Approximate nearest neighbours: a forest of random-projection trees, a shared priority queue, exact reranking.

Nearness is the inner product. Every vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm, and every
query a zero, so that the largest inner products are the nearest points and the trees see all norms alike.

1. The trees are fitted on a sample of at most ``FIT_SAMPLE`` vectors: each node projects on a random direction and splits
   at the sample's median, until a leaf stands for about ``LEAF`` of all vectors (and at least ``LEAF_SAMPLE`` sampled ones).
   Every vector is then routed to its leaf in every tree: the index holds all rows.
2. The sample's own neighbours show how, at each node, a neighbour's projection follows the query's (slope, offset, spread). So each split
   gives the probability that a neighbour lies right of it, and the products along a path those of the leaves.
3. A query keeps one priority queue over the nodes of all trees, takes the likeliest node of any tree, and stops when the
   probability that every tree has missed a neighbour is at most 1 - ``found``. The effort follows the data: few leaves
   where neighbours stand out, many where they hardly differ from the rest.
4. Neighbouring leaves form a shard. A query travels once to each shard it visits, with its leaves there; a task scores
   the leaves' vectors in double precision on the original vectors and returns k + 1 rows a query. Shards and their
   queries are cut into blocks of bounded size.

Equal vectors are one point that carries its k + 1 smallest ids, and equal queries search once, so copies neither fill a
leaf nor repeat a search.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
an id; repeated rows of an id count once (the smallest vector); vectors of another length than that of the smallest id's
vector take no part. Fewer than k candidates are all returned if their leaves are visited. Ties go to the smaller id. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import arrow_rows, written

TREES = 3
LEAF = 512                                      # vectors of a leaf, about
LEAF_SAMPLE = 4
FIT_SAMPLE = 16_384
CALIBRATION = 256                               # sampled queries whose neighbours show the spread
FOUND = 0.97                                    # probability of a neighbour that a search aims at
SHARD = 32                                      # leaves of a shard
POINT_BLOCK, QUERY_BLOCK = 16_384, 8_192
SPARE = 8                                       # candidates kept beyond k until scores are summed in a fixed order
BATCH = 2_000


@dataclass
class Forest:
    """``T`` trees in arrays over all their nodes. ``right`` and ``left`` hold node numbers; a leaf has ``left`` -1 and a
    ``leaf`` number, which is counted per tree from left to right."""

    direction: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    root: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    spread: np.ndarray


def fit(sample: np.ndarray, queries: np.ndarray, total: int, trees: int, k: int, seed: int = 13) -> Forest:
    """A forest over lifted ``sample`` rows; ``queries`` are the same vectors as :func:`_asking` makes them."""
    rng = np.random.default_rng(seed)
    least = max(LEAF_SAMPLE, LEAF * len(sample) / max(total, 1))
    direction, cut, left, right, leaf, root = [], [], [], [], [], []

    def node() -> int:
        for x, empty in ((direction, np.zeros(sample.shape[1])), (cut, 0.0), (left, -1), (right, -1), (leaf, -1)):
            x.append(empty)
        return len(cut) - 1

    for _ in range(trees):
        root.append(node())
        stack, leaves = [(root[-1], np.arange(len(sample)))], 0
        while stack:
            at, rows = stack.pop()
            if len(rows) > least:
                way = rng.standard_normal(sample.shape[1])
                way /= np.linalg.norm(way)
                place = sample[rows] @ way
                middle = float(np.median(place))
                low = place <= middle
                if low.any() and not low.all():
                    direction[at], cut[at], left[at], right[at] = way, middle, node(), node()
                    stack += [(right[at], rows[~low]), (left[at], rows[low])]
                    continue
            leaf[at], leaves = leaves, leaves + 1
    n = len(cut)
    forest = Forest(np.array(direction), np.array(cut), np.array(left), np.array(right), np.array(leaf), np.array(root),
                    np.ones(n), np.zeros(n), np.ones(n))
    inner = np.flatnonzero(forest.left >= 0)
    if len(inner) and len(sample) > 1:
        picked = rng.permutation(len(sample))[:CALIBRATION]
        score = queries[picked] @ sample.T
        score[np.arange(len(picked)), picked] = -np.inf
        near = np.argsort(-score, axis=1)[:, :min(k, len(sample) - 1)]
        for at in inner:
            mine = np.repeat(queries[picked] @ forest.direction[at], near.shape[1])
            theirs = sample[near.ravel()] @ forest.direction[at]
            middle, spread = mine.mean(), mine.var()
            slope = ((mine - middle) * (theirs - theirs.mean())).mean() / spread if spread > 0 else 0.0
            forest.slope[at], forest.offset[at] = slope, theirs.mean() - slope * middle
            forest.spread[at] = max((theirs - slope * mine - forest.offset[at]).std(), 1e-12)
    return forest


def route(forest: Forest, points: np.ndarray) -> np.ndarray:
    """``(points, trees)``: each point's leaf in each tree."""
    out = np.zeros((len(points), len(forest.root)), np.int64)
    for t, root in enumerate(forest.root):
        stack = [(root, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            if forest.left[at] < 0:
                out[rows, t] = forest.leaf[at]
            elif len(rows):
                low = points[rows] @ forest.direction[at] <= forest.cut[at]
                stack += [(forest.left[at], rows[low]), (forest.right[at], rows[~low])]
    return out


def _right_share(forest: Forest, queries: np.ndarray) -> np.ndarray:
    """For every query and node the probability that a neighbour lies right of the node's cut."""
    z = (forest.slope * (queries @ forest.direction.T) + forest.offset - forest.cut) / forest.spread
    # the normal distribution function by the logistic curve closest to it (within 0.01), which numpy can evaluate
    return 1 / (1 + np.exp(-np.clip(1.702 * z, -40, 40)))


def visits(forest: Forest, share: list[float], found: float) -> list[tuple[int, int]]:
    """``(tree, leaf)`` pairs of one query in the order of its priority queue."""
    left, right, leaf = forest.left, forest.right, forest.leaf
    queue = [(-1.0, t, int(root)) for t, root in enumerate(forest.root)]
    missed, out = [1.0] * len(queue), []
    while queue:
        weight, t, at = heapq.heappop(queue)
        if left[at] < 0:
            out.append((t, int(leaf[at])))
            missed[t] = max(missed[t] + weight, 0.0)
            if np.prod(missed) <= 1 - found:
                break
        else:
            heapq.heappush(queue, (weight * share[at], t, int(right[at])))
            heapq.heappush(queue, (weight * (1 - share[at]), t, int(left[at])))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))])


def _asking(v: np.ndarray, top: float) -> np.ndarray:
    """Queries for the trees: a zero in the lifted place, and one norm for all, which changes no order."""
    return np.column_stack([v * (top / np.linalg.norm(v, axis=1))[:, None], np.zeros(len(v))])


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part, one per id. Vectors are only shuffled if an id repeats."""
    v = F.col("embedding")
    taken = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(taken).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where("vec_id is not null")
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, found: float = FOUND) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``is_query`` (an expression over ``vec_id``), the k nearest
    other rows found."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    first = rows.agg(F.min(F.struct("vec_id", "v")).alias("x")).first().x
    width = len(first.v) if first else 0
    rows = rows.where(F.size("v") == width)
    kind = rows.schema["v"].dataType.simpleString()
    # equal vectors become one point; the hash shortens comparisons, the vector itself decides
    alike = ["h", "v"]
    marked = rows.withColumn("h", F.xxhash64("v"))
    smallest = (marked.withColumn("r", F.row_number().over(Window.partitionBy(*alike).orderBy("vec_id"))).where(F.col("r") <= k + 1)
                .groupBy(*alike).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    points = written(smallest.select(F.col("ids")[0].alias("point"), "ids", *alike), "ann-points")
    # a query is among its point's ids, or else its point has all k + 1 of them
    listed = points.select("point", F.explode("ids").alias("vec_id")).where(is_query)
    rest = (marked.where(is_query).join(points.where(F.size("ids") > k), alike)
            .where(~F.array_contains("ids", F.col("vec_id"))).select("point", "vec_id"))
    asked = written(listed.unionByName(rest), "ann-asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, top = points.agg(F.count("*"), F.max(norm)).first()
    picked = points.orderBy(F.xxhash64("point"), "point").limit(FIT_SAMPLE).select("v").toArrow()["v"].combine_chunks()
    plain = _matrix(picked, width)
    forest = fit(_lifted(plain, top or 0.0), _asking(plain, top or 0.0), total, trees, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = route(forest, _lifted(_matrix(batch.column(2), width), top))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int64()))], ["point", "ids", "v", "leaves"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width)
            shares = _right_share(forest, _asking(v, top))
            for i, share in enumerate(shares):
                shards: dict[tuple[int, int], list[int]] = {}
                for t, leaf in visits(forest, share.tolist(), found):
                    shards.setdefault((t, leaf // SHARD), []).append(leaf)
                keys = list(shards)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * len(keys))), batch.column(1).take(pa.array([i] * len(keys))),
                     pa.array([t for t, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()),
                     pa.array([shards[x] for x in keys], pa.list_(pa.int64()))], ["point", "v", "tree", "shard", "leaves"])

    def score(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        q, c = q.combine_chunks(), c.combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            qv, cv = _matrix(q["v"].chunk(0), width), _matrix(c["v"].chunk(0), width)
            q_point, ids = q["point"].to_numpy(), c["ids"].to_pylist()
            wanted = q["leaves"].chunk(0)
            asks, leaf = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
            home, found_q, found_c, found_s = c["leaf"].to_numpy(), [], [], []
            for this in np.unique(home):
                at, who = np.flatnonzero(home == this), asks[leaf == this]
                if not len(who):
                    continue
                most = min(len(at), k + 1 + SPARE)
                rough = qv[who] @ cv[at].T
                best = np.argpartition(-rough, most - 1, axis=1)[:, :most]
                found_q.append(np.repeat(who, most))
                found_c.append(at[best].ravel())
                found_s.append(np.take_along_axis(rough, best, 1).ravel())
            if found_q:
                fq, fc, fs = map(np.concatenate, (found_q, found_c, found_s))
                order = np.lexsort((-fs, fq))
                fq, fc = fq[order], fc[order]
                heads = np.flatnonzero(np.diff(fq, prepend=-1))
                place_ = np.arange(len(fq)) - np.repeat(heads, np.diff(heads, append=len(fq)))
                fq, fc = fq[place_ < k + 1 + SPARE], fc[place_ < k + 1 + SPARE]
                sure = (qv[fq] * cv[fc]).sum(1)                # one order of summation wherever a pair is scored
                for a, b in _runs(fq):
                    pairs = sorted((-s, i) for s, x in zip(sure[a:b].tolist(), fc[a:b].tolist(), strict=True) for i in ids[x])[:k + 1]
                    out.append((np.full(len(pairs), q_point[fq[a]]), np.array([i for _, i in pairs]), np.array([-s for s, _ in pairs])))
        joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 3
        return pa.table({"point": pa.array(joined[0], pa.int64()), "vec_id": pa.array(joined[1], pa.int64()),
                         "score": pa.array(joined[2], pa.float64())})

    wanted_v = points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "v")
    searches = wanted_v.mapInArrow(search, f"point long, v {kind}, tree int, shard int, leaves array<bigint>")
    with arrow_rows(spark, BATCH):
        searches = written(searches, "ann-searches")
    home = (points.select("point", "ids", "v").mapInArrow(place, f"point long, ids array<bigint>, v {kind}, leaves array<bigint>")
            .select("point", "ids", "v", F.posexplode("leaves").alias("tree", "leaf"))
            .withColumn("shard", F.floor(F.col("leaf") / SHARD).cast("int")))
    # blocks of a shard: counts per shard (as many as the forest has) decide how many
    cuts = (home.groupBy("tree", "shard").agg(F.ceil(F.count("*") / POINT_BLOCK).cast("int").alias("cn"))
            .join(searches.groupBy("tree", "shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qn")), ["tree", "shard"]))
    cuts = {(r.tree, r.shard): (r.cn, r.qn) for r in cuts.collect()}
    cn, qn = (F.coalesce(F.element_at(F.create_map(*[F.lit(x) for (t, s), n in cuts.items() for x in (t * 1_000_000 + s, n[i])]),
                                      F.col("tree") * 1_000_000 + F.col("shard")), F.lit(0)) if cuts else F.lit(0) for i in (0, 1))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))                        # noqa: E731
    own = lambda n: F.pmod(F.xxhash64("point"), n).cast("int")                       # noqa: E731
    key = ["tree", "shard", "cb", "qb"]
    left = searches.where(cn > 0).withColumn("qb", own(qn)).withColumn("cb", all_of(cn))
    right = home.where(qn > 0).withColumn("cb", own(cn)).withColumn("qb", all_of(qn))
    hits = (left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, "point long, vec_id long, score double"))
    # a candidate of several trees counts once; the query itself takes a place here, so k + 1 are kept
    best = hits.groupBy("point", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("point").orderBy(F.col("score").desc(), "vec_id")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    answers = (best.groupBy("point").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id")))).alias("near")))
    with arrow_rows(spark, BATCH):
        answers = written(answers, "ann-answers")
    mine = asked.withColumnRenamed("vec_id", "query_id").join(answers, "point")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (mine.select("query_id", F.posexplode(others).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score")))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index ranges of equal neighbours."""
    heads = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    yield from zip(heads, [*heads[1:], len(values)], strict=True)
