"""Packing: optimal length buckets and token-budget batches.

The global length histogram is aggregated by Spark and reduced to at most ``4096 + 2048 * 52`` cells: exact below 4096
tokens, 12 significant bits above. Dynamic programming over the cells then chooses the bucket boundaries that minimise
padding (each boundary is the largest length of its cell), with a convex-hull step per cell instead of a scan. Inside a
bucket, documents are numbered densely and cut into batches of ``budget // boundary`` documents (one, if longer).

Numbering needs no global sort: rows are ranked inside hash shards, and each shard starts where the shards before it
end, so one bucket may hold any part of the corpus.

Defined cases: null, empty and blank texts have 0 tokens and go to the first bucket; rows are never dropped or merged,
so repeated rows and null ids each take a slot; an empty table gives no buckets and no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import written
from newsloom.llm.quality_rules import BLANK

BUCKETS = 16
TOKEN_BUDGET = 65_536


def word_count(text: Column) -> Column:
    """Words of a whole text: runs of characters other than space and \\x09-\\x0D."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANK))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` and a hash of the row's place, which spreads equal rows too; :func:`pack` writes it once."""
    return docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("spread"))


def histogram(rows: DataFrame) -> list[tuple[int, int, int]]:
    """``(largest length, documents, tokens)`` per cell, ascending; bounded, see above."""
    step = F.expr("shiftleft(1L, greatest(length(bin(n_tokens)) - 12, 0))")
    cells = rows.groupBy(F.floor(F.col("n_tokens") / step).alias("_cell"), step.alias("_step")).agg(
        F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    return sorted((r.top, r.n, r.tokens) for r in cells.collect())


def boundaries(cells: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` ascending upper lengths with the least total padding over the cells.

    ``best[j]`` after k layers is the least padding of the first j cells in k buckets. The last bucket (i, j] costs
    ``top[j] * (count[j] - count[i]) - (tokens[j] - tokens[i])``, so for each j the best i is the lowest of the lines
    ``best[i] + tokens[i] - top[j] * count[i]``; slopes and queries are monotone, so a deque keeps the lower hull.
    """
    if not cells:
        return []
    m = len(cells)
    count, tokens = [0], [0]
    for _, n, t in cells:
        count.append(count[-1] + n)
        tokens.append(tokens[-1] + t)
    best: list[int | None] = [0] + [None] * m
    came: list[list[int]] = []
    for _ in range(min(buckets, m)):
        hull: deque[tuple[int, int, int]] = deque()         # (slope, offset, cell)
        new: list[int | None] = [None] * (m + 1)
        back = [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                s, c = -count[i], best[i] + tokens[i]
                while len(hull) > 1 and ((c - hull[-2][1]) * (hull[-2][0] - hull[-1][0])
                                         <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - s)):
                    hull.pop()
                hull.append((s, c, i))
            if not hull:
                continue
            top = cells[j - 1][0]
            while len(hull) > 1 and hull[1][0] * top + hull[1][1] <= hull[0][0] * top + hull[0][1]:
                hull.popleft()
            s, c, i = hull[0]
            new[j], back[j] = s * top + c + top * count[j] - tokens[j], i
        came.append(back)
        best = new
    out, j = [], m
    for back in reversed(came):
        out.append(cells[j - 1][0])
        j = back[j]
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_length, batch, slot`` per row: ``batch`` counts from 0 inside its bucket, holds
    ``budget // bucket_length`` documents (at least one) numbered by ``slot``, and only a bucket's last may be short."""
    spark = docs.sparkSession
    rows = written(lengths(docs), "pack-lengths")
    tops = boundaries(histogram(rows), buckets)
    bucket = sum(((F.col("n_tokens") > t).cast("int") for t in tops[:-1]), F.lit(0))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod("spread", F.lit(shards)))
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "shard").orderBy("spread", "doc_id", "n_tokens")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["bucket", "shard"])
    top = F.element_at(F.array(*[F.lit(t).cast("long") for t in tops or [0]]), F.col("bucket") + 1)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))))
    number = F.col("start") + F.col("rank")
    return ranked.withColumn("bucket_length", top).select(
        "doc_id", "n_tokens", "bucket", "bucket_length", F.floor(number / per).alias("batch"),
        F.pmod(number, per).cast("int").alias("slot"))
