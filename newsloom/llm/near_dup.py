"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit digest of its word sequence
   and one hash per band. Texts with equal digests are one *node* (its smallest doc_id stands for it).
2. Nodes that share a band hash form a bucket. Each member is compared with the bucket's smallest node on full sets.
3. Buckets whose other members are not yet all in one component are compared inside tasks, block against block of
   bounded weight, skipping pairs already connected and pairs that an earlier common band covers. The smallest node has
   been compared with all and is left out, and of buckets with equal other members the one of the earliest band stands
   for all. Only links leave a task, so no bucket emits its pairs and none is read by one task.

The number of bands follows from the threshold: a pair exactly at it is missed with a probability of at most
``max_miss`` (low thresholds get shorter bands; one that can't be held raises ValueError); every pair that shares a band
is confirmed on full sets or is already connected.

Defined cases: null, empty and blank texts have no shingles and link with nothing. Rows that share a doc_id are one
document; their links are pooled. A null doc_id takes no part: component_id is null and kept is true. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import slices, small_batches, text_bytes, written
from newsloom.llm.components import connected_components
from newsloom.llm.shingles import WordHashes, band_hashes, overlap, shingle_set, signatures, words_of
from newsloom.operators.late import drop_rows, keep_rows

ROWS = 5                                        # slots of a band
MAX_BANDS = 51
SLICE_BYTES = 2 << 20                           # text handled at once
MEMO_WORDS = 200_000                            # word hashes that a task holds
BLOCK_SHINGLES = 500_000                        # weight of one block of an unresolved bucket


def bands_for(percent: int, max_miss: float = 1e-6, rows: int = ROWS) -> int:
    """Bands of ``rows`` slots so that a pair at the threshold is missed with at most ``max_miss``."""
    return math.ceil(math.log(max_miss) / math.log1p(-((percent / 100) ** rows)))


def layout(percent: int, max_miss: float = 1e-6) -> tuple[int, int]:
    """Bands, and slots of a band: ``ROWS``, or fewer for thresholds that need more than ``MAX_BANDS`` bands of them."""
    for rows in range(ROWS, 0, -1):
        bands = bands_for(percent, max_miss, rows)
        if bands <= MAX_BANDS:
            return bands, rows
    raise ValueError(f"{MAX_BANDS} bands can't reach a miss of {max_miss} at {percent} percent")


def fingerprints(docs: DataFrame, shingle: int, bands: int, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, digest, bands`` per row; digest and bands are null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes(MEMO_WORDS)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices([len(t or b"") for t in texts], SLICE_BYTES):
                words = [words_of(t) for t in texts[lo:hi]]
                sets = [shingle_set(w, shingle, memo) for w in words]
                hashes = band_hashes(signatures(sets, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(b" ".join(w), usedforsecurity=False).digest() if w else None for w in words],
                             pa.binary()),
                    pa.array([h if len(s) else None for h, s in zip(hashes, sets, strict=True)], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold. Rows arrive grouped by ``b``, whose set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, held = WordHashes(MEMO_WORDS), None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True):
                if tb != last:
                    last, held = tb, shingle_set(words_of(tb), shingle, memo)
                keep.append(_linked(shingle_set(words_of(ta), shingle, memo), held, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(side, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _open_links(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components inside unresolved buckets; one group per pair of blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, i, j = (k.as_py() for k in key)
        memo = WordHashes(MEMO_WORDS)
        block = np.array(table["block"].to_pylist())
        node = table["node"].to_pylist()
        comp = table["component"].to_pylist()
        bands = np.array(table["bands"].to_pylist(), np.int64)
        sets = [shingle_set(words_of(t), shingle, memo) for t in text_bytes(table["text"].combine_chunks())]
        size = np.array([len(s) for s in sets])
        here = int(np.argmax(bands[0] == bucket))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        out_a, out_b = [], []
        for x in np.flatnonzero(block == i):
            near = (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            near &= (block == j) & ((np.arange(len(node)) > x) | (i != j))
            if not near.any():
                continue
            cand = np.flatnonzero(near)
            if here:                            # an earlier common band has this pair in its own bucket
                cand = cand[~(bands[cand, :here] == bands[x, :here]).any(axis=1)]
            for y in cand:
                a, b = root(comp[x]), root(comp[y])
                if a != b and _linked(sets[x], sets[y], percent):
                    parent[a] = b
                    out_a.append(node[x])
                    out_b.append(node[y])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return members.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, max_miss: float = 1e-6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``: documents whose shingle sets have a Jaccard
    similarity of at least ``percent`` / 100 are linked; ``component_id`` is the smallest doc_id reachable."""
    small_batches(docs.sparkSession)
    fp = written(fingerprints(docs, shingle, *layout(percent, max_miss)), "near-fp")
    nodes = written(fp.where("digest is not null and doc_id is not null").groupBy("digest")
                    .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
                         F.first("bands").alias("bands")), "near-nodes")

    spread = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    lead = (spread.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("other"))
            .where("leader != other").drop("other"))
    members = written(spread.join(lead, "bucket"), "near-members")

    pairs = members.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    docs_text = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    wanted = members.select("node").distinct()
    texts = written(keep_rows(docs_text, wanted, ["node"]), "near-texts")
    links = written(_verified(pairs, texts, shingle, percent), "near-links")
    labels = connected_components(links)

    labelled = (members.where("node != leader").join(labels, "node", "left")
                .withColumn("component", F.coalesce("component", "node")).drop("leader"))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))                                    # noqa: E731
    unsettled = (labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                F.min("band").alias("band"), F.sum("n_shingles").alias("weight"),
                                                F.count("*").alias("n"), exact(F.xxhash64("node")).alias("set_a"),
                                                exact(F.xxhash64(F.lit(1), "node")).alias("set_b"))
                 .where("lo != hi").groupBy("n", "set_a", "set_b")
                 .agg(F.min_by("bucket", "band").alias("bucket"), F.first("weight").alias("weight")).select("bucket", "weight"))
    blocks = F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")
    cut = (labelled.join(unsettled, "bucket").withColumn("blocks", blocks)
           .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
           .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("bucket", "node", "component", "block", F.least("block", "with").alias("i"),
                   F.greatest("block", "with").alias("j")))
    cut = cut.join(nodes.select("node", "bands"), "node").join(texts, "node")
    more = written(_open_links(cut, shingle, percent), "near-more")
    joined = connected_components(links.unionAll(more))

    stands = (nodes.select("digest", "node").join(joined, "node", "left")
              .select("digest", F.coalesce("component", "node").alias("component")))
    out = fp.join(stands, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each near-duplicate group (the smallest doc_id) and all its columns.

    Of rows that repeat a doc_id one stays; rows with a null doc_id all stay.
    """
    verdict = near_duplicates(docs, percent, shingle).where("doc_id is not null")
    ids = written(verdict.groupBy("doc_id").agg(F.min("component_id").alias("component_id"),
                                                F.count("*").alias("n")), "near-kept")
    keyed = docs.withColumn("__near_dup_id", F.col("doc_id").cast("long"))
    left = drop_rows(keyed, ids.where("doc_id != component_id").select(F.col("doc_id").alias("__near_dup_id")), ["__near_dup_id"])
    repeated = ids.where("doc_id = component_id and n > 1").select(F.col("doc_id").alias("__near_dup_id"))
    if repeated.isEmpty():
        return left.drop("__near_dup_id")
    again = keep_rows(left, repeated, ["__near_dup_id"]).dropDuplicates(["__near_dup_id"])
    return drop_rows(left, repeated, ["__near_dup_id"]).unionByName(again).drop("__near_dup_id")
