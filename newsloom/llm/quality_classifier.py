"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into a fixed vector in one pass. ``fit`` bins the vectors by quantiles and boosts
logistic-loss trees on per-bin gradient histograms; the trees are flattened into parallel arrays, which ``score``
traverses for all rows and trees at once with numpy. Scoring is a single pass without a shuffle.

The model is fitted on a bounded sample: the ``MAX_TRAIN`` labelled documents of smallest id hash among those that are
not held out. Their ids are broadcast (at most 16 bytes each) and only one vector per id reaches the driver; of rows that
share an id, the least vector is taken.

Defined cases: null and empty texts get the statistics of an empty text and are scored like any other; a null doc_id
is kept, is never held out, and has no label; repeated label rows of an id count as the smallest label; without any
usable label every score is 0.5; an empty table gives no rows. Extra columns are ignored or passed through by name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import small_batches, text_bytes
from newsloom.llm.quality_rules import STOP_WORDS

MAX_TRAIN = 20_000
MIN_SCORE = 0.7
BINS = 64
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_CLASSES = np.zeros((256, 9))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>",
                             b".,;:", b"!?", b" \t\n\x0b\x0c\r", b"'\"()[]{}-_/\\@=+~^`", bytes(range(128, 256)))):
    _CLASSES[list(_chars), _i] = 1
N_STATS = 9 + 13


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one whole text (UTF-8)."""
    text = text or b""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = hist[hist > 0] / max(n, 1)
    words = text.split()
    n_words = len(words)
    lower = Counter(text.lower().split())
    top = max(lower.values(), default=0)
    stops = sum(c for w, c in lower.items() if w in _STOP)
    lines = [x for x in text.split(b"\n") if x.strip()]
    twice = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(c for w, c in lower.items() if not w[-1:].isalnum() and w[-1] < 128)
    per_word, per_line = 1 / max(n_words, 1), 1 / max(len(lines), 1)
    return np.concatenate([hist @ _CLASSES / max(n, 1), [
        np.log1p(n), np.log1p(n_words), (n - hist[[32, 9, 10, 11, 12, 13]].sum()) * per_word, len(lower) * per_word,
        top * per_word, stops * per_word, ends * per_word, twice * per_word, len(lines) * per_word,
        (len(lines) - len(set(lines))) * per_line, -(share * np.log2(share)).sum() if n else 0.0,
        hist[[46, 33, 63]].sum() * per_word, sum(w.isupper() for w in lower) / max(len(lower), 1)]])


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; a leaf points to itself. ``roots`` has one start node per tree."""
    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of statistics."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, min_rows: int = 10,
        shrink: float = 1.0) -> Trees:
    """Boosted trees on histograms of at most ``BINS`` quantile bins per statistic."""
    positive = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(positive / (1 - positive)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.empty(0)
             for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    size = x.shape[1] * BINS
    margin = np.full(len(y), base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(at)
        right.append(at)
        value.append(v)
        return at

    def grow(rows: np.ndarray, level: int) -> int:
        g, h = grad[rows], hess[rows]
        at = leaf(float(-rate * g.sum() / (h.sum() + shrink)))
        if level == depth or len(rows) < 2 * min_rows:
            margin[rows] += value[at]
            return at
        cells = flat[rows].ravel()
        spread = lambda v: np.bincount(cells, np.repeat(v, x.shape[1]), size).reshape(-1, BINS).cumsum(1)
        gl, hl, nl = spread(g), spread(h), spread(np.ones(len(rows)))
        gain = (gl ** 2 / (hl + shrink) + (g.sum() - gl) ** 2 / (h.sum() - hl + shrink)
                - g.sum() ** 2 / (h.sum() + shrink))
        gain[(nl < min_rows) | (len(rows) - nl < min_rows)] = -np.inf
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if not gain[f, b] > 1e-6 or b >= len(edges[f]):
            margin[rows] += value[at]
            return at
        goes = binned[rows, f] <= b
        feature[at], threshold[at] = int(f), float(edges[f][b])
        left[at] = grow(rows[goes], level + 1)
        right[at] = grow(rows[~goes], level + 1)
        return at

    if len(np.unique(y)) == 2:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0))
    as_int = lambda v: np.array(v, np.int64)                                        # noqa: E731
    return Trees(base if len(y) else 0.0, depth, as_int(roots), as_int(feature), np.array(threshold, float),
                 as_int(left), as_int(right), np.array(value, float))


def held_out(doc_id: Column) -> Column:
    """Ids whose label is never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fits on at most ``max_train`` labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    picked = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
            .mapInArrow(run, "doc_id long, y int, x array<double>")
            .groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect())
    x = np.array([r.x for r in rows], float).reshape(-1, N_STATS)
    y = np.array([r.y for r in rows], float)
    order = np.lexsort([*x.T, y])               # the same model however the rows were partitioned
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in text_bytes(batch.column(1))]).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= min_score).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` predicted to have label 1, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in text_bytes(batch.column(at))]).reshape(-1, N_STATS)
            yield batch.filter(pc.greater_equal(pa.array(model.score(x)), min_score))

    return docs.mapInArrow(run, docs.schema)
