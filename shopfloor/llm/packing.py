"""Packing documents into token sequences as a cutting-stock problem.

1. One scan encodes every document (its ids, then END) and cuts it into pieces
   of the sequence length and one shorter rest.  Every piece gets a length
   class and its rank among the pieces of its class in the same task.
2. The histogram of length classes goes to the driver (one row per class, so
   its size does not grow with the documents).  There the linear program of
   the cutting-stock problem is solved by column generation: a column is a
   pattern, the class counts of one sequence; a knapsack dynamic program over
   the dual prices finds the column to enter.
3. The solution is rounded down; what the whole patterns leave over (at most
   one sequence's worth per pattern) is filled class by class, largest first.
4. Every piece is ranked within its class (rank in its task plus the pieces of
   earlier tasks) and takes the slot of that rank; a window over one sequence
   (at most its length in pieces) gives the offsets.

Classes are exact for short pieces and up to 1/128 wide for long ones: a
pattern counts the upper edge, the little that a piece is shorter is padding.

The vocabulary is that of ``byte_bpe_50k.json``; ``tiktoken`` reads the same
vocabulary as ranks and gives the same ids several times faster.  Where a text
holds the vocabulary's one special token, that string is its id, as
``tokenizers`` has it.

Defined cases: null or empty text is the END token alone; a null id and rows
that repeat an id are packed as rows of their own; a very long text is cut
like any other; an empty table gives no rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import write_table
from .common import bound_text_batches, whole_text
from .tokens import BYTE_BPE, PATTERN, TOKENIZERS

LENGTH = 1024
END = 0
# Fixed value: the vocabulary's special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
# The linear program stops within this share of its lower bound.
GAP = 0.002
# Columns that enter at most (a few seconds); a greedy packing is improved until then.
STEPS = 600
PLACE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, rank long, sequence_id long, slot long"
PIECE = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, class int, task int, rank long"


_READY: dict[str, object] = {}


def _encoder(lines: bytes):
    if BYTE_BPE not in _READY:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _READY[BYTE_BPE] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return _READY[BYTE_BPE]


def encode(text: str, lines: bytes) -> list[int]:
    """Ids of a text, END last; ``lines`` is the vocabulary file."""
    coder = _encoder(lines)
    ids = coder.encode(text, allowed_special="all") if SPECIAL in text else coder.encode_ordinary(text)
    ids.append(END)
    return ids


def class_edges(length: int) -> np.ndarray:
    """Upper edges of the length classes: steps of 1 at first, of ``8 * size / length`` for long pieces."""
    edges, at = [], 1
    while at <= length:
        edges.append(at)
        at += max(1, at // max(1, length // 8))
    if edges[-1] != length:
        edges.append(length)
    return np.array(edges, np.int64)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, float]:
    """The class counts of one sequence that are worth most at these prices (unbounded knapsack)."""
    worth, choice = np.zeros(length + 1), np.full(length + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(length + 1), side="right")
    for room in range(1, length + 1):
        worth[room] = worth[room - 1]
        if fitting[room]:
            values = prices[: fitting[room]] + worth[room - sizes[: fitting[room]]]
            k = int(values.argmax())
            if values[k] > worth[room] + 1e-12:
                worth[room], choice[room] = values[k], k
    pattern, room = np.zeros(len(sizes)), length
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return pattern, float(worth[length])


def first_basis(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis (patterns as columns) and its use: largest class left, filled with the largest that still fit.

    Every pattern is used until one class is exhausted, and holds no class that
    was exhausted before, so the columns are independent.
    """
    m = len(sizes)
    left, columns, used, done = demand.astype(float).copy(), [], [], []
    while len(columns) < m:
        pattern, room = np.zeros(m), length
        for k in range(m - 1, -1, -1):
            if left[k] > 0 and sizes[k] <= room:
                pattern[k], room = divmod(room, sizes[k])
        held = np.flatnonzero(pattern)
        share = left[held] / pattern[held]
        out = int(held[share.argmin()])
        taken = float(share.min())
        left[held] -= taken * pattern[held]
        left[out] = 0
        columns.append(pattern)
        used.append(taken)
        done.append(out)
        for k in held.tolist():  # exhausted together: a pattern of its own, not used
            if k != out and left[k] <= 1e-9:
                left[k] = 0
                single = np.zeros(m)
                single[k] = length // sizes[k]
                columns.append(single)
                used.append(0.0)
                done.append(k)
    return np.stack(columns, axis=1), np.array(used)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination in elementwise numpy: threaded linear algebra can hang in a driver that has forked."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        best = k + int(np.abs(work[k:, k]).argmax())
        work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[k]
    return work[:, n:].copy()


def solve(sizes: np.ndarray, demand: np.ndarray, length: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used, meeting the demand exactly; fractional, within ``gap`` of the least total.

    Revised simplex: the basis starts with a greedy packing and stays feasible,
    so stopping early (``STEPS``) costs sequences, never pieces.
    """
    basis, used = first_basis(sizes, demand, length)
    inverse = _inverse(basis)
    bound = float(sizes @ demand) / length  # no packing beats the sum of the lengths
    for step in range(1, STEPS):
        total = used.sum()
        if total <= (1 + gap) * bound:
            break
        pattern, worth = best_pattern(inverse.sum(axis=0), sizes, length)
        bound = max(bound, total / max(worth, 1e-9))
        if worth <= 1 + 1e-9 or total <= (1 + gap) * bound:
            break
        change = (inverse * pattern).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, used / change, np.inf)
        least = ratio.min()
        if not np.isfinite(least):
            break
        leaves = int(np.where(ratio <= least + 1e-12, change, -np.inf).argmax())  # of ties the largest pivot
        taken = ratio[leaves]
        used = np.maximum(used - taken * change, 0)
        used[leaves] = taken
        row = inverse[leaves] / change[leaves]
        inverse -= change[:, None] * row
        inverse[leaves] = row
        basis[:, leaves] = pattern
        if step % 100 == 0:
            inverse = _inverse(basis)
            used = np.maximum((inverse * demand).sum(axis=1), 0)
    return basis.T.astype(np.int64), used


def plan(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole patterns (one a row) and their copies, which hold the demand exactly."""
    if not len(sizes):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    patterns, used = solve(sizes, demand.astype(float), length)
    copies = np.floor(used + 1e-9).astype(np.int64)
    # rounding errors of the solver must not use more than there is
    while (over := copies @ patterns - demand).max() > 0:
        worst = int(over.argmax())
        holders = np.flatnonzero((patterns[:, worst] > 0) & (copies > 0))
        copies[holders[0]] -= 1
    rest = demand - copies @ patterns
    free: list[int] = []
    filled: list[dict[int, int]] = []
    for k in np.argsort(-sizes, kind="stable"):
        left, size = int(rest[k]), int(sizes[k])
        # fullest sequences first
        for b in sorted((b for b in range(len(free)) if free[b] >= size), key=free.__getitem__):
            n = min(left, free[b] // size)
            if n:
                filled[b][int(k)] = n
                free[b] -= n * size
                left -= n
        while left:
            n = min(left, length // size)
            filled.append({int(k): n})
            free.append(length - n * size)
            left -= n
    extra = np.zeros((len(filled), len(sizes)), np.int64)
    for b, counts in enumerate(filled):
        for k, n in counts.items():
            extra[b, k] = n
    kept = copies > 0
    return np.vstack([patterns[kept], extra]), np.concatenate([copies[kept], np.ones(len(filled), np.int64)])


def slots(patterns: np.ndarray, copies: np.ndarray) -> dict[int, np.ndarray]:
    """Per column of the patterns: rows (first rank, pieces a copy, first sequence, slots before in the sequence), by first rank."""
    first = np.cumsum(copies) - copies
    before = np.cumsum(patterns[:, ::-1], axis=1)[:, ::-1] - patterns  # longer classes stand first
    out = {}
    for k in range(patterns.shape[1]):
        rows = np.flatnonzero(patterns[:, k])
        taken = patterns[rows, k] * copies[rows]
        out[k] = np.stack([np.cumsum(taken) - taken, patterns[rows, k], first[rows], before[rows, k]], axis=1)
    return out


def _pieces(docs: DataFrame, length: int, folder: str) -> DataFrame:
    bound_text_batches(docs.sparkSession)
    with open(f"{folder}/{BYTE_BPE}.tiktoken", "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    edges = class_edges(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(len(edges), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows: list[tuple] = []
                parts: list[np.ndarray] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.array(encode(text.as_py(), lines.value), "<u4")
                    for start in range(0, len(ids), length):
                        part = ids[start : start + length]
                        k = int(np.searchsorted(edges, len(part)))
                        rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), k, task, int(seen[k])))
                        seen[k] += 1
                        parts.append(part)
                columns = list(zip(*rows, strict=True))
                ends = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.record_batch(
                    arrays[:3] + [ids] + arrays[3:],
                    names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "class", "task", "rank"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, length: int = LENGTH, folder: str = TOKENIZERS, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (unless switched off) ids: one row per piece."""
    spark = docs.sparkSession
    edges = class_edges(length)
    alone = len(edges) - 1  # pieces of the last class fill a sequence
    pieces = write_table(_pieces(docs, length, folder), "pack-pieces")
    # one row per task and class, whatever the number of documents
    counts = write_table(pieces.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    present = np.array(sorted(k for k in histogram if k != alone), np.int64)
    patterns, copies = plan(edges[present], np.array([histogram[k] for k in present.tolist()], np.int64), length)
    table = {int(present[k]): rows for k, rows in slots(patterns, copies).items()}
    sequences = int(copies.sum())
    placed_by = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = ranks + sequences, np.zeros(len(ranks), np.int64)
            for k in np.unique(kinds):
                if k == alone:
                    continue
                mine = np.flatnonzero(kinds == k)
                rows = placed_by.value[int(k)]
                at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
                copy, within = np.divmod(ranks[mine] - rows[at, 0], rows[at, 1])
                sequence[mine], slot[mine] = rows[at, 2] + copy, rows[at, 3] + within
            yield pa.record_batch(
                [*batch.columns, pa.array(sequence), pa.array(slot)], names=[*batch.schema.names, "sequence_id", "slot"]
            )

    # token ids stay where they are written: only places are shuffled
    narrow = pieces.join(offsets, ["class", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", (F.col("rank") + F.col("earlier")).alias("rank")
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    found = narrow.mapInArrow(place, PLACE).withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    if with_ids:
        held = pieces.join(offsets, ["class", "task"]).select("class", "task", (F.col("rank") + F.col("earlier")).alias("rank"), "ids")
        found = found.join(held, ["class", "task", "rank"])
    return found.drop("class", "task", "rank", "slot")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """sequence_id, ids, n_tokens: the packed sequences, padded to ``length`` unless their length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    n = F.size("ids")
    whole = F.bit_count(n) == 1
    padded = F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(length) - n)))
    return joined.select("sequence_id", ids.alias("ids")).select("sequence_id", padded.alias("ids"), n.cast("long").alias("n_tokens"))
