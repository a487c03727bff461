"""Text quality by histogram gradient-boosted trees over document statistics.

Every text is reduced to ``FEATURES`` statistics (sizes, character classes,
repetition, line shapes).  The statistics of the labelled training rows are
binned by quantiles; each tree level sums gradients and hessians per (node,
feature, bin) and splits where the gain is largest.  Trees are kept as flat
arrays (feature, bin, children, value), and a batch of documents walks all
of them in numpy, one array step per level.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a
hash of the id (a documented bound: 30,000 rows of 28 floats reach the
driver, also where one id stands on many document rows: equal rows of an id
are learned from once, and the bound holds again after the join).  Scoring covers every text as a whole.

Defined cases: null text is read as empty; empty texts get the score their
statistics get; rows with a null id or label are not learned from; labels of
repeated ids each count; without labels, or with one class only, every score
is close to the training share of label 1 (0.5 without labels); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import write_table
from .common import bound_text_batches, fold, whole_text

FOLDS, HELD_OUT = 3, 1
TRAIN_ROWS = 30_000
SLOT_BITS = 16  # the sample is found by counts in 2 ** SLOT_BITS slots of the hash
TREES, DEPTH, RATE, L2, MIN_HESSIAN, BINS = 80, 5, 0.1, 1.0, 3.0, 64
FEATURES = 28

_CLASS = np.zeros(256, np.uint8)  # byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 plain punctuation, 6 symbol, 7 non-ASCII
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7


def _shares(data: bytes) -> np.ndarray:
    seen = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)
    return seen / max(1, len(data))


def statistics(text: str) -> np.ndarray:
    """The document statistics of one text."""
    data = text.encode("utf-8", "surrogatepass")
    share = _shares(data)
    words = data.split()
    n = len(words)
    counts = Counter(words)
    top = counts.most_common(2)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    per_line = [_shares(x) for x in lines] or [np.zeros(8)]
    symbols = np.array([x[6] for x in per_line])
    upper = np.array([x[2] for x in per_line])
    spread = [len(set(w := x.split())) / len(w) for x in lines] or [1.0]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = histogram[histogram > 0] / max(1, len(data))
    packed = len(zlib.compress(data, 1)) / max(1, len(data)) if data else 1.0
    return np.array([
        np.log1p(len(data)), np.log1p(n), lengths.mean(), lengths.std(), lengths.max(),
        *share,
        len(counts) / max(1, n), top[0][1] / n if n else 0.0, top[1][1] / n if len(top) > 1 else 0.0,
        same / max(1, n), pairs / max(1, n - 1), len(lines), len(set(lines)) / max(1, len(lines)), ends / max(1, len(lines)),
        symbols.max(), symbols.mean(), upper.max(), min(spread), -(p * np.log(p)).sum() if len(p) else 0.0, packed,
        share[2] / max(1e-9, share[1] + share[2]),
    ])


class Trees:
    """Flat boosted trees: per tree and node, the feature, threshold, children (self-loops at leaves) and value."""

    def __init__(self, base: float):
        self.base = base
        self.feature = self.left = self.right = np.zeros((0, 0), np.int32)
        self.limit = self.value = np.zeros((0, 0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of statistics."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                low = x[rows, self.feature[t, node]] <= self.limit[t, node]
                node = np.where(low, self.left[t, node], self.right[t, node])
            margin += self.value[t, node]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on logistic loss with quantile-binned statistics."""
    if not len(y):
        return Trees(0.0)
    share = float(y.mean())
    if not 0 < share < 1:
        return Trees(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    model = Trees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    size, width = 2 ** (DEPTH + 1) - 1, x.shape[1]
    margin, flat = np.full(len(y), model.base), {k: [] for k in ("feature", "limit", "left", "right", "value")}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(size, np.int32), np.zeros(size)
        left = np.arange(size, dtype=np.int32)
        right, value = left.copy(), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH + 1):
            first, many = 2**depth - 1, 2**depth
            at = node - first
            here = (at >= 0) & (at < many)
            gs = np.bincount(at[here], weights=g[here], minlength=many)
            hs = np.bincount(at[here], weights=h[here], minlength=many)
            value[first : first + many] = -RATE * gs / (hs + L2)
            if depth == DEPTH:
                break
            best, best_f, best_b = np.full(many, 1e-6), np.full(many, -1), np.zeros(many, np.int64)
            for f in range(width):
                cell = at[here] * BINS + binned[here, f]
                gl = np.cumsum(np.bincount(cell, weights=g[here], minlength=many * BINS).reshape(many, BINS), axis=1)
                hl = np.cumsum(np.bincount(cell, weights=h[here], minlength=many * BINS).reshape(many, BINS), axis=1)
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - (gs**2 / (hs + L2))[:, None]
                gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN)] = -np.inf
                gain[:, len(edges[f]) :] = -np.inf
                b = gain.argmax(axis=1)
                won = gain[np.arange(many), b] > best
                best, best_f, best_b = np.where(won, gain[np.arange(many), b], best), np.where(won, f, best_f), np.where(won, b, best_b)
            for i in np.flatnonzero(best_f >= 0):
                k = first + i
                feature[k], limit[k], left[k], right[k] = best_f[i], edges[best_f[i]][best_b[i]], 2 * k + 1, 2 * k + 2
            split = np.zeros(len(y), bool)
            split[here] = best_f[at[here]] >= 0
            f, b = best_f[at[split]], best_b[at[split]]
            node[split] = 2 * node[split] + 1 + (binned[split, f] > b)
        walk = np.zeros(len(y), np.int64)
        for _ in range(DEPTH):
            walk = np.where(x[np.arange(len(y)), feature[walk]] <= limit[walk], left[walk], right[walk])
        margin += value[walk]
        for name, array in (("feature", feature), ("limit", limit), ("left", left), ("right", right), ("value", value)):
            flat[name].append(array)
    for name, arrays in flat.items():
        setattr(model, name, np.stack(arrays))
    return model


def _measure(texts: pa.Array) -> np.ndarray:
    return np.stack([statistics(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, FEATURES))


def _lowest(df: DataFrame, cols: list[str], rows: int) -> DataFrame:
    """``o`` and ``cols`` of the ``rows`` rows of smallest hash ``o`` (a row of count ``n`` stands for n), ties by ``cols``.

    Counts per slot of the hash tell which slots hold them; only rows of these
    slots are sorted, equal rows combined before.
    """
    slot = F.shiftright("o", 64 - SLOT_BITS)  # signed, so in the order of ``o``
    upto, last = 0, None
    for last, n in sorted(df.groupBy(slot.alias("slot")).agg(F.sum("n")).collect()):
        upto += n
        if upto >= rows:
            break
    inside = df.filter(slot <= (0 if last is None else last)).groupBy("o", *cols).agg(F.sum("n").alias("n"))
    copies = F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(rows)).cast("int")))
    return inside.select("o", *cols, copies.alias("copy")).drop("copy").orderBy("o", *cols).limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    bound_text_batches(docs.sparkSession)
    usable = labels.filter(
        F.col("quality").isin(0, 1) & F.coalesce(fold("doc_id", FOLDS) != HELD_OUT, F.lit(False))
    ).select(F.col("doc_id").alias("l_id"), "quality")
    order = F.xxhash64(F.lit("quality-sample"), "l_id")
    picked = _lowest(usable.withColumn("o", order).withColumn("n", F.lit(1).cast("long")), ["l_id", "quality"], rows)
    picked = picked.groupBy("l_id", "quality").agg(F.count(F.lit(1)).alias("n"))
    texts = docs.select("doc_id", whole_text("text").alias("text"))
    # the sample is bounded by ``rows``, so it goes to the texts and no text is shuffled
    joined = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("quality", "l_id", "n", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _measure(batch.column("text"))
            yield pa.record_batch([batch.column("quality"), batch.column("l_id"), batch.column("n"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "id", "n", "x"])

    measured = joined.mapInArrow(measure, "y int, id long, n long, x array<double>").distinct()
    measured = write_table(measured.withColumn("o", F.xxhash64(F.lit("quality-sample"), "id", "x")), "quality-measured")
    found = _lowest(measured, ["id", "y", "x"], rows).select("y", "id", "x").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y, ids = found.column("y").to_numpy().astype(float), found.column("id").to_numpy()
    order = np.lexsort((*x.T, y, ids))  # the same fit whatever order the rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted."""
    bound_text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(_measure(batch.column("text")))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        whole_text("text").alias("text"),
    )
    return rows.mapInArrow(walk, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents outside the held-out fold and score every document."""
    return score(docs, train(docs, labels))
