"""Ranked lexical search of many items at once, with shared term sets evaluated once.

1. The items' terms are collected in blocks (the stated query set; a block
   holds about ``BLOCK_PAIRS`` item-term pairs).  Terms that occur in exactly
   the same items form an atom.  Neighbouring atoms that stand together in
   several items are paired into shared sets, pairs into larger sets, until
   nothing is shared: a graph whose nodes are term sets and whose edges say
   which two smaller sets a set combines.
2. One scan of the documents keeps, per document, its number of terms and the
   counts of the block's terms.  Corpus figures (documents, terms, documents
   holding a term) are sums over that table.
3. A second scan, over that table alone, evaluates the graph for a batch of
   documents at a time: the accumulator of every atom is built once, those of
   the shared sets are added up level by level, an item's score is the sum of
   its last few sets.  Each task keeps an item's best documents; the best of
   those are ranked over all tasks.

Scores are exact integers (sums below 2**53 held in doubles).

Defined cases: null or empty text has no terms and is never found; items
without terms have no rows; rows that repeat an item id are one item with all
their terms (a null id is an id); every row of documents is a document of its
own, also where it repeats an id; a null doc_id ranks after all others of the
same score; very long texts are read whole; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import fixed_broadcast
from ..plans.materialize import write_table
from .common import ascii_lower, bound_text_batches

TOP = 10
# Item-term pairs in a block of items, about: bounds what a scan of the documents is given.
BLOCK_PAIRS = 100_000
# Bytes of accumulators at a time, and candidates held before they are cut to the best.
ACCUMULATORS, HELD = 48 << 20, 200_000
# Fixed value: what separates terms.
TERM_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OTHER = bytes(c for c in range(128) if chr(c) not in string.ascii_letters + string.digits)
_TO_TERMS = bytes.maketrans(string.ascii_uppercase.encode() + _OTHER, string.ascii_lowercase.encode() + b" " * len(_OTHER))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order (all separators are ASCII, so this works on bytes)."""
    return text.translate(_TO_TERMS).split()


class SharedSets:
    """The graph of shared term sets of a block of items.

    ``atom`` maps a term to its atom; ``levels`` are arrays (node, left, right)
    of sets made from two others, in order; ``flat`` and ``starts`` hold the
    sets each item adds up.
    """

    def __init__(self, items: list[list[int]], n_terms: int):
        owners: list[list[int]] = [[] for _ in range(n_terms)]
        for i, held in enumerate(items):
            for t in held:
                owners[t].append(i)
        names: dict[tuple[int, ...], int] = {}
        self.atom = np.array([names.setdefault(tuple(o), len(names)) for o in owners], np.int64)
        self.atoms = len(names)
        lists: list[list[int]] = [[] for _ in items]
        # atoms of many items first, so that items which share them hold them side by side
        for o, a in sorted(names.items(), key=lambda x: (-len(x[0]), x[1])):
            for i in o:
                lists[i].append(a)
        nodes, made, depth = self.atoms, [], defaultdict(int)
        while True:
            pairs = Counter(p for held in lists for p in pairwise(held))
            shared = {p: n for p, n in pairs.items() if n > 1}
            if not shared:
                break
            named: dict[tuple[int, int], int] = {}
            for held in lists:
                out, k = [], 0
                while k < len(held):
                    p = tuple(held[k : k + 2])
                    # leave the pair to the next position where that one is shared by more items
                    if shared.get(p, 0) >= max(2, shared.get(tuple(held[k + 1 : k + 3]), 0)):
                        if p not in named:
                            named[p] = nodes
                            depth[nodes] = 1 + max(depth[p[0]], depth[p[1]])
                            made.append((depth[nodes], nodes, *p))
                            nodes += 1
                        out.append(named[p])
                        k += 2
                    else:
                        out.append(held[k])
                        k += 1
                held[:] = out
            if not named:
                break
        self.nodes = nodes
        self.levels = [np.array([m[1:] for m in made if m[0] == d], np.int64) for d in sorted({m[0] for m in made})]
        self.flat = np.array([a for held in lists for a in held], np.int64)
        self.starts = np.cumsum([0] + [len(held) for held in lists[:-1]]).astype(np.int64)

    def scores(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Items x documents from (term, document, value) triples."""
        acc = np.zeros((self.nodes, docs))
        acc[: self.atoms] = np.bincount(self.atom[term] * docs + doc, value, self.atoms * docs).reshape(self.atoms, docs)
        for level in self.levels:
            acc[level[:, 0]] = acc[level[:, 1]] + acc[level[:, 2]]
        out = np.empty((len(self.starts), docs))
        ends = np.append(self.starts[1:], len(self.flat))
        for i, (a, b) in enumerate(zip(self.starts, ends, strict=True)):
            out[i] = acc[self.flat[a]] if b == a + 1 else acc[self.flat[a:b]].sum(axis=0)
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Blocks of (item_id, its terms): items are dealt by the hash of their id to as many blocks as the pairs need."""
    found = F.array_remove(F.split(ascii_lower(F.col("text")), TERM_SEPARATORS), "")
    pairs = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()
    pairs = write_table(pairs, "search-items")
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    for b in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
        rows = mine.toArrow().to_pylist()
        if rows:
            yield [(r["item_id"], r["terms"]) for r in rows]


def _counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (terms of the document with repeats), ids and counts of its terms that are in the vocabulary."""
    bound_text_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t.encode(): k for k, t in enumerate(known.value)}.get
        for batch in batches:
            sizes, ids, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms(text.as_py())
                found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                kinds, n = np.unique(found[found >= 0], return_counts=True)
                sizes.append(len(words))
                ids.append(kinds.astype(np.int32))
                counts.append(n.astype(np.int64))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    whole = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_table(whole.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>"), "search-terms")


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Positions of each item's best, higher scores and then smaller ids first."""
    order = np.lexsort((doc, -score, item))
    sorted_items = item[order]
    first = np.flatnonzero(np.append(True, sorted_items[1:] != sorted_items[:-1]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < top]


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[str]]], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, held in block for t in held})
    place = {t: k for k, t in enumerate(vocabulary)}
    graph = SharedSets([[place[t] for t in held] for _, held in block], len(vocabulary))
    counted = _counted(docs, vocabulary)
    n_docs, n_terms = counted.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    holding = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist():
        holding[r["t"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(h) + 1))) for h in holding], np.int64)
    given = spark.sparkContext.broadcast((graph, weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, weight = given.value
        step = max(16, ACCUMULATORS // (8 * (sets.nodes + len(sets.starts))))
        held = [np.empty(0, np.int64)] * 3  # item, score, document
        least = np.zeros(len(sets.starts))  # score to reach, once an item has enough
        waiting: list[list[np.ndarray]] = []

        def settle() -> None:
            nonlocal held, waiting, least
            held = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
            waiting = []
            kept = _best(*held, top)
            held = [x[kept] for x in held]
            full = np.bincount(held[0], minlength=len(least)) >= top
            lowest = np.full(len(least), np.inf)
            np.minimum.at(lowest, held[0], held[1].astype(float))
            least = np.where(full, lowest, 0)

        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                docs_ = batch.num_rows
                sizes = batch.column("n").to_numpy()
                ids = batch.column("doc_id").fill_null(_LAST).to_numpy()
                lengths = batch.column("terms").value_lengths().to_numpy()
                doc = np.repeat(np.arange(docs_), lengths)
                term = batch.column("terms").flatten().to_numpy().astype(np.int64)
                tf = batch.column("counts").flatten().to_numpy()
                m = 10 + (90 * sizes * n_docs) // n_terms
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                found = sets.scores(term, doc, value.astype(float), docs_)
                item, column = np.nonzero((found > 0) & (found >= least[:, None]))
                waiting.append([item, found[item, column].astype(np.int64), ids[column]])
                if sum(len(w[0]) for w in waiting) > HELD:
                    settle()
        settle()
        ids = pa.array(held[2], pa.int64(), mask=held[2] == _LAST)
        yield pa.record_batch([pa.array(held[0]), ids, pa.array(held[1])], names=["item", "doc_id", "score"])

    best = write_table(counted.filter("size(terms) > 0").mapInArrow(rank, "item long, doc_id long, score long"), "search-best")
    names = fixed_broadcast(spark.createDataFrame(list(enumerate(i for i, _ in block)), "item long, item_id long"))
    return best.join(names, "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item, best first."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in _blocks(items):
        found = found.union(_search_block(docs, block, top))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
