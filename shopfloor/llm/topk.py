"""Exact top-k inner-product search by distributed histogram selection.

Vectors are turned into integers, so scores are whole numbers.  Queries are
handled in blocks that are broadcast (``BLOCK`` queries at a time); for a
block, every candidate is scored against every query, and global histograms
of the scores (``BINS`` bins per query) are refined around each query's k-th
value until a bin is one score wide.  A last pass keeps the scores above that
value and, of those equal to it, the smallest ids still needed: a partition
never gives more than k rows a query.

Candidates are never shuffled, only histograms and at most k rows per query
and partition.  Blocks bound what is broadcast, so the work grows with
queries x candidates and nothing else.

Defined cases: a vector that is null, empty, or holds null or non-finite
components takes no part, nor does a row without id; a candidate of another
dimension than the query's is not a candidate of it; rows that repeat an id
are candidates each, a query id asks once (with its smallest vector), and no
row with the query's own id answers it; fewer than k candidates give all;
ties go to the smaller id.  Scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import write_table

SCALE = 256
BLOCK = 2048
BINS = 256
CHUNK = 1024  # candidates scored at once


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the floor of scale * x per component, for rows that take part."""
    xs = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(
        xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(xs, lambda x: F.floor(x * scale)).alias("v")
    )


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted dimension, and their values as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(sizes == dim)
    return rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scored(batches: Iterator[pa.RecordBatch], queries: np.ndarray, ids: np.ndarray):
    """Chunks of candidate ids, scores (candidate x query), and which of them count."""
    top = float(np.abs(queries).max(initial=0))
    as_float = queries.T.astype(np.float64)
    for batch in batches:
        rows, matrix = _matrix(batch.column("v"), queries.shape[1])
        names = batch.column("vec_id").take(pa.array(rows)).to_numpy(zero_copy_only=False)
        for at in range(0, len(rows), CHUNK):
            part = matrix[at : at + CHUNK]
            exact = top * float(np.abs(part).max(initial=0)) * queries.shape[1] < 2**53
            scores = (part.astype(np.float64) @ as_float).astype(np.int64) if exact else part @ queries.T
            mine = names[at : at + CHUNK]
            yield mine, scores, mine[:, None] != ids[None, :]


def _best(q: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best (score, then smaller id) entries of every query."""
    order = np.lexsort((name, -score, q))
    q, score, name = q[order], score[order], name[order]
    first = np.searchsorted(q, q, side="left")  # where the entry's query begins
    keep = np.arange(len(q)) - first < k
    return [q[keep], score[keep], name[keep]]


def _block_top(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    sc = candidates.sparkSession.sparkContext
    block = sc.broadcast((ids, queries))
    n = len(ids)

    def extent(batches):
        ids, queries = block.value
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        seen = np.zeros(n, np.int64)
        for _, scores, counts in _scored(batches, queries, ids):
            low = np.minimum(low, np.where(counts, scores, np.iinfo(np.int64).max).min(axis=0))
            high = np.maximum(high, np.where(counts, scores, np.iinfo(np.int64).min).max(axis=0))
            seen += counts.sum(axis=0)
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(some), pa.array(low[some]), pa.array(high[some]), pa.array(seen[some])], names=["q", "low", "high", "n"])

    found = candidates.mapInArrow(extent, "q long, low long, high long, n long").groupBy("q").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    ).toArrow()  # one row a query of the block
    low, high, many = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    q = found.column("q").to_numpy()
    low[q], high[q], many[q] = (found.column(c).to_numpy() for c in ("low", "high", "n"))
    # [low, high] holds the k-th best score of a query; ``above`` counts the scores over ``high``
    above = np.zeros(n, np.int64)
    high = np.where(many > k, high, low)  # with k candidates or fewer, the lowest score is the limit

    while (high > low).any():
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        edges = sc.broadcast((low, high, width))

        def histogram(batches, edges=edges):
            ids, queries = block.value
            low, high, width = edges.value
            open_ = np.flatnonzero(high > low)
            total = np.zeros(n * BINS, np.int64)
            for _, scores, counts in _scored(batches, queries[open_], ids[open_]):
                inside = counts & (scores >= low[open_]) & (scores <= high[open_])
                cell = (scores - low[open_]) // width[open_] + open_ * BINS
                total += np.bincount(cell[inside], minlength=n * BINS)
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["cell", "n"])

        cells = candidates.mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        grid = np.zeros(n * BINS, np.int64)  # at most BINS cells a query of the block
        grid[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        down = above[:, None] + np.cumsum(grid.reshape(n, BINS)[:, ::-1], axis=1)  # scores at or over each bin, from the top
        at = np.argmax(down >= k, axis=1)
        bin_, rows = BINS - 1 - at, np.arange(n)
        is_open = high > low
        above = np.where(is_open, down[rows, at] - grid.reshape(n, BINS)[rows, bin_], above)
        low, high = np.where(is_open, low + bin_ * width, low), np.where(is_open, np.minimum(high, low + (bin_ + 1) * width - 1), high)

    limits = sc.broadcast(low)

    def select(batches):
        ids, queries = block.value
        limit = limits.value
        held = [np.empty(0, np.int64)] * 3
        for names, scores, counts in _scored(batches, queries, ids):
            row, col = np.nonzero(counts & (scores >= limit))
            new = _best(col, scores[row, col], names[row], k)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) > 4 * k * n:
                held = _best(*held, k)
        q, score, name = _best(*held, k)
        yield pa.record_batch(
            [pa.array(ids[q], pa.int64()), pa.array(name, pa.int64()), pa.array(score, pa.int64())],
            names=["query_id", "vec_id", "score"],
        )

    kept = candidates.mapInArrow(select, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every vector whose id is divisible by ``every``."""
    candidates = write_table(integer_vectors(vectors), "search-vectors")
    asked = candidates.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = write_table(asked.withColumn("dim", F.size("v")), "search-queries")
    out: DataFrame | None = None  # one written table per block
    for dim in [r["dim"] for r in asked.select("dim").distinct().orderBy("dim").collect()]:
        after: int | None = None
        while True:
            part = asked.filter(F.col("dim") == dim)
            part = part if after is None else part.filter(F.col("vec_id") > after)
            rows = part.select("vec_id", "v").orderBy("vec_id").limit(block).toArrow()  # one bounded block
            if not rows.num_rows:
                break
            ids = rows.column("vec_id").to_numpy()
            matrix = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            found = write_table(_block_top(candidates, ids, matrix, k), "search-block")
            out = found if out is None else out.unionByName(found)
            after = int(ids[-1])
    if out is None:
        out = candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
