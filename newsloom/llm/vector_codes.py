"""Vector code compression: product quantisation whose codebooks are learned by a dual-tree Lloyd iteration, in integers.

Vectors become integers, are cut into equal consecutive parts, and every part position gets a codebook.

1. One pass cuts the rows into blocks. For each part position of a block it builds a balanced tree over the parts (median
   splits along the widest side) and stores the parts in tree order with each node's box and component sums.
2. A round builds a second tree over the entries of each codebook. Both trees are walked together: a pair of nodes is
   pruned when the least distance between their boxes exceeds the largest distance to another entry node. A node left
   with one entry is assigned whole, by its cached count and sum; leaves that stay uncertain compare their parts with
   the entries left to them. All bounds and distances are integers, so the result is that of the plain iteration.
3. Tasks return one count and sum per entry; the codebooks (a fixed number of integers) are all the driver holds. Blocks
   are written once to the shared folder, so a lost executor repeats only its blocks.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, and so are those whose
length can't be cut into equal parts or differs from the length of the smallest kept id's vector. Rows without an id are
encoded and counted, but start no entry. Repeated rows count as often as they occur; an id that repeats starts one entry
(its smallest vector). Fewer ids than entries give shorter codebooks. Equal entries: the lower index wins. Null labels
are one label. An empty table, or one without ids, gives no rows. Extra columns are ignored. Components too large for
exact distances in a long raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import arrow_rows, slices, written
from newsloom.llm.topk import quantise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 8                                        # parts of a leaf, at most
BLOCK_VALUES = 1 << 19                         # components of one block
BLOCKS_PER_BATCH = 4
FAR = np.iinfo(np.int64).max

BLOCK_FIELDS = "n int, depth int, order binary, points binary, lo binary, hi binary, sums binary"


class Tree:
    """A balanced tree over ``n`` rows kept in tree order: node ``j`` of level ``l`` holds rows ``j * n >> l`` up to
    ``(j + 1) * n >> l``; nodes are numbered ``2 ** l - 1 + j``."""

    def __init__(self, n: int, depth: int, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.n, self.depth, self.points, self.lo, self.hi, self.sums = n, depth, points, lo, hi, sums

    def starts(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1, dtype=np.int64) * self.n) >> level


def depth_of(n: int, leaf: int) -> int:
    depth = 0
    while (n >> depth) > leaf:
        depth += 1
    return depth


def grow(rows: np.ndarray, leaf: int) -> tuple[np.ndarray, Tree]:
    """``(order, tree)``: the permutation into tree order, and the tree with the boxes and sums of all nodes."""
    n = len(rows)
    tree = Tree(n, depth_of(n, leaf), rows, rows, rows, rows)
    order = np.arange(n)
    for level in range(tree.depth):
        starts = tree.starts(level)
        here = rows[order]
        side = (np.maximum.reduceat(here, starts[:-1], axis=0) - np.minimum.reduceat(here, starts[:-1], axis=0)).argmax(1)
        node = np.repeat(np.arange(1 << level), np.diff(starts))
        order = order[np.lexsort((here[np.arange(n), side[node]], node))]
    tree.points = rows[order]
    cut = tree.starts(tree.depth)[:-1]
    lo, hi, sums = [[f.reduceat(tree.points, cut, axis=0)] for f in (np.minimum, np.maximum, np.add)]
    for _ in range(tree.depth):
        lo.append(np.minimum(lo[-1][::2], lo[-1][1::2]))
        hi.append(np.maximum(hi[-1][::2], hi[-1][1::2]))
        sums.append(sums[-1][::2] + sums[-1][1::2])
    tree.lo, tree.hi, tree.sums = (np.concatenate(x[::-1]) for x in (lo, hi, sums))
    return order, tree


class Entries:
    """The entry tree of one codebook: level by level the boxes of its nodes and where their children start. The last
    level holds the distinct entries themselves; ``index`` gives the lowest index of each."""

    def __init__(self, entries: np.ndarray):
        self.all = entries
        distinct, index = np.unique(entries, axis=0, return_index=True)
        order, tree = grow(distinct, 1)
        self.index = index[order]
        self.lo, self.hi, self.first = [], [], []
        for level in range(tree.depth + 1):
            here = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            self.lo.append(tree.lo[here])
            self.hi.append(tree.hi[here])
            self.first.append(2 * np.arange((1 << level) + 1) if level < tree.depth else tree.starts(level))
        self.lo.append(tree.points)
        self.hi.append(tree.points)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """An entry near each of the points."""
        last = self.lo[-1]
        return last[((points[:, None, :] - last[None]) ** 2).sum(2).argmin(1)]


def farther(lo: np.ndarray, hi: np.ndarray, qlo: np.ndarray, qhi: np.ndarray, rival: np.ndarray) -> np.ndarray:
    """Whether every entry in the box ``qlo .. qhi`` is farther than ``rival`` from every point of the box ``lo .. hi``.

    Per side, the least (x - e)^2 - (x - rival)^2 lies at an end of the point's range or where the entries' range begins or
    ends; for a single entry it is linear in x.
    """
    if qlo is qhi:
        toward = qlo - rival
        return ((qlo + rival - 2 * np.where(toward > 0, hi, lo)) * toward).sum(1) > 0
    least = None
    for x in (lo, hi, np.clip(qlo, lo, hi), np.clip(qhi, lo, hi)):
        off = np.maximum(np.maximum(qlo - x, x - qhi), 0)
        gap = off * off - (x - rival) ** 2
        least = gap if least is None else np.minimum(least, gap)
    return least.sum(1) > 0


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges ``first[i] .. first[i] + count[i]`` one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def walk(tree: Tree, entries: Entries) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, int]:
    """Walks both trees. ``(whole, rows, codes, compared)``: per level the nodes assigned whole with their entries, the
    rows of uncertain leaves with theirs, and how many distances were computed for these."""
    level, deep = 0, 0
    part, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole = []
    while True:
        at = (1 << level) - 1 + part
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        rival = entries.nearest((tree.lo[at[heads]] + tree.hi[at[heads]]) >> 1)
        rival = np.repeat(rival, np.diff(heads, append=len(part)), axis=0)
        qlo = entries.lo[deep][entry]
        qhi = qlo if deep == len(entries.lo) - 1 else entries.hi[deep][entry]
        keep = ~farther(tree.lo[at], tree.hi[at], qlo, qhi, rival)
        part, entry = part[keep], entry[keep]
        if deep == len(entries.lo) - 1:
            heads = np.flatnonzero(np.diff(part, prepend=-1))
            only = np.diff(heads, append=len(part)) == 1
            whole.append((level, part[heads[only]], entries.index[entry[heads[only]]]))
            open_ = np.repeat(~only, np.diff(heads, append=len(part)))
            part, entry = part[open_], entry[open_]
            if level == tree.depth or not len(part):
                break
        else:
            first = entries.first[deep]
            count = first[entry + 1] - first[entry]
            part, entry = np.repeat(part, count), _spread(first[entry], count)
            deep += 1
        if level < tree.depth:
            part, entry = np.concatenate([2 * part, 2 * part + 1]), np.concatenate([entry, entry])
            order = np.argsort(part, kind="stable")
            part, entry, level = part[order], entry[order], level + 1
    starts = tree.starts(level)
    leaves = np.unique(part)
    rows = _spread(starts[leaves], starts[leaves + 1] - starts[leaves])
    place = np.zeros(tree.n, np.int64)
    place[rows] = np.arange(len(rows))
    dist = np.full((len(rows), len(entries.all)), FAR)
    compared = 0
    for e in np.unique(entry):
        mine = part[entry == e]
        these = _spread(starts[mine], starts[mine + 1] - starts[mine])
        index = entries.index[e]
        dist[place[these], index] = ((tree.points[these] - entries.all[index]) ** 2).sum(1)
        compared += len(these)
    return whole, rows, dist.argmin(1), compared


def totals(tree: Tree, entries: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Number and component sums of the parts nearest to each entry."""
    whole, rows, codes, _ = walk(tree, entries)
    count = np.bincount(codes, minlength=len(entries.all)).astype(np.int64)
    sums = np.zeros(entries.all.shape, np.int64)
    for e in np.unique(codes):
        sums[e] = tree.points[rows[codes == e]].sum(0)
    for level, nodes, index in whole:
        starts = tree.starts(level)
        np.add.at(count, index, starts[nodes + 1] - starts[nodes])
        np.add.at(sums, index, tree.sums[(1 << level) - 1 + nodes])
    return count, sums


def assign(tree: Tree, entries: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of every part, in tree order."""
    whole, rows, codes, _ = walk(tree, entries)
    out = np.zeros(tree.n, np.int64)
    out[rows] = codes
    for level, nodes, index in whole:
        starts = tree.starts(level)
        size = starts[nodes + 1] - starts[nodes]
        out[_spread(starts[nodes], size)] = np.repeat(index, size)
    return out, ((tree.points - entries.all[out]) ** 2).sum(1)


def blocks(rows: DataFrame, dim: int, parts: int = PARTS, leaf: int = LEAF) -> DataFrame:
    """``rows`` (vec_id, label, v) cut into blocks with a tree per part position; one row per block."""
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices([dim] * len(batch), BLOCK_VALUES):
                piece = batch.slice(a, b - a)
                v = piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), parts, width)
                if 4 * int(np.abs(v).max()) ** 2 * width >= 1 << 62:
                    raise ValueError("components too large for exact distances in a long")
                grown = [grow(np.ascontiguousarray(v[:, p]), leaf) for p in range(parts)]
                kind = np.int32 if np.abs(v).max() < 1 << 31 else np.int64
                joined = lambda name: np.stack([getattr(t, name) for _, t in grown])       # noqa: E731
                data = [np.stack([o for o, _ in grown]).astype(np.int32), *(joined(k).astype(kind) for k in ("points", "lo", "hi")),
                        joined("sums")]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array([len(piece)], pa.int32()), pa.array([grown[0][1].depth], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in data)],
                    ["ids", "labels", "n", "depth", "order", "points", "lo", "hi", "sums"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, {BLOCK_FIELDS}")


def _trees(row: dict, parts: int, width: int) -> Iterator[tuple[np.ndarray, Tree]]:
    n, depth = row["n"], row["depth"]
    nodes = (2 << depth) - 1
    kind = np.int32 if len(row["points"]) == 4 * n * parts * width else np.int64
    grid = lambda name, k, m: np.frombuffer(row[name], k).reshape(parts, m, width).astype(np.int64)      # noqa: E731
    order = np.frombuffer(row["order"], np.int32).reshape(parts, n)
    points, lo, hi = grid("points", kind, n), grid("lo", kind, nodes), grid("hi", kind, nodes)
    sums = grid("sums", np.int64, nodes)
    for p in range(parts):
        yield order[p], Tree(n, depth, points[p], lo[p], hi[p], sums[p])


def _round(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment and update."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Entries(b) for b in books]
        count, sums = np.zeros((parts, size), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, (_, tree) in enumerate(_trees(row, parts, width)):
                    c, s = totals(tree, near[p])
                    count[p] += c
                    sums[p] += s
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                                         ["part", "entry", "n", "sums"])

    fields = table.select("n", "depth", "order", "points", "lo", "hi", "sums")
    found = fields.mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<bigint>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))                          # noqa: E731
    new = books.copy()
    for r in (found.select("part", "entry", "n", F.posexplode("sums").alias("at", "total"))
              .groupBy("part", "entry", "at").agg(exact("n").alias("n"), exact("total").alias("total")).collect()):
        new[r.part, r.entry, r.at] = int(r.total) // int(r.n)
    return new


def train(rows: DataFrame, table: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(parts, entries, dim / parts)``: the vectors of the smallest ids, then ``rounds`` Lloyd rounds."""
    ids = [r[0] for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, dim // parts).swapaxes(0, 1)
    for _ in range(rounds):
        books = _round(table, books)
    return books


def encode(table: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """``vec_id, label, code, error`` of every row of the blocks."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Entries(b) for b in books]
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            for i, row in enumerate(batch.select(range(2, batch.num_columns)).to_pylist()):
                codes, error = np.zeros((row["n"], parts), np.uint8), np.zeros(row["n"], np.int64)
                for p, (order, tree) in enumerate(_trees(row, parts, width)):
                    code, dist = assign(tree, near[p])
                    codes[order, p] = code
                    error[order] += dist
                text = codes.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, labels[i].values, pa.array([text[k:k + step] for k in range(0, len(text), step)]),
                     pa.array(error)], ["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, f"vec_id bigint, label {label_type}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' decimal integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per kept row of ``vectors`` (vec_id, embedding, label).

    ``entries`` is at most 256: an index is two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook holds 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", quantise(F.col("embedding"), scale).alias("v"))
    rows = rows.where(f"v is not null and size(v) % {int(parts)} = 0")
    first = rows.where("vec_id is not null").agg(F.min(F.struct("vec_id", "v")).alias("x")).first().x
    if first is None:
        empty = rows.limit(0)
        return empty.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim = len(first.v)
    rows = rows.where(F.size("v") == dim)
    with arrow_rows(spark, max(1, BLOCK_VALUES // dim)):
        table = written(blocks(rows, dim, parts), "codes-blocks")
    with arrow_rows(spark, BLOCKS_PER_BATCH):
        books = train(rows, table, dim, parts, entries, rounds)
        coded = written(encode(table, books, rows.schema["label"].dataType.simpleString()), "codes")
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return (coded.join(per_label, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
