"""Phrase collocations of every language, counted level by level with broadcast tries.

1. Words are counted per language (each task adds up its own texts first).
   Words that occur often enough are numbered; texts are written again as
   arrays of those numbers, with 0 for any other word and between pieces.  No
   phrase that occurs often enough holds a 0 (Apriori).
2. Level k finds the phrases of k words.  Both parts of k - 1 words of such a
   phrase are frequent, so the candidates at a position are two neighbouring
   accepting states of the trie of frequent (k - 1)-word phrases.  The trie is
   a double array (base, check), broadcast in blocks of at most ``BLOCK``
   phrases; numpy moves the states of all positions of a batch of texts one
   word on at a time, packs neighbouring accepting states and counts them.
   Each task adds up its counts, a shuffle sums the tasks.
   (At level 2 a state is a word.)
3. The scores of all cuts, the parts' counts and the longer phrases that
   swallow shorter ones are joins between the tables of frequent phrases.

Candidates are taken as they stand in the texts.  All Apriori-safe
combinations would be as many as the square of the frequent words, which no
trie can hold and nothing bounds.

A block holds the phrases that begin or end in overlaps of one hash class, so
every pair of neighbours is met in exactly one block.  Up to ``PRELOADED``
frequent words are broadcast as text; beyond, the lookup of words is broadcast
as 64-bit hashes with numbers, 12 bytes for each frequent word.

Defined cases: null or empty text has no words; a null language is ``und``
(one with the language of that name); rows that repeat an id each count; very
long texts are read whole; ties are ordered by the phrase; an empty table
gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ids import number_rows
from ..plans.materialize import write_table
from .common import bound_text_batches, whole_text

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
SWALLOWED = 80  # dropped when a longer phrase has at least so many hundredths of the count
NO_LANG = "und"
BLOCK = 500_000
# Distinct entries a task holds before it hands them on.
HELD = 1 << 19
# Frequent words that are broadcast as text (some 130 bytes each in a worker).
PRELOADED = 1 << 20
# What ends a piece, and a byte that UTF-8 never holds to stand for it.
PIECE_ENDS, MARK = b".,;:!?\x0a\x0b\x0c\x0d", b"\xff"
_TO_WORDS = bytes.maketrans(string.ascii_uppercase.encode() + PIECE_ENDS, string.ascii_lowercase.encode() + MARK * len(PIECE_ENDS))


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with MARK where a piece ends (what is left to split at are blanks and tabs)."""
    return text.translate(_TO_WORDS).replace(MARK, b" \xff ").split()


def _languages(docs: DataFrame) -> DataFrame:
    bound_text_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), whole_text("text").alias("text"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(MARK, None)
            texts = pa.array(list(words), pa.binary()).cast(pa.string())
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), texts, pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            counts.setdefault(lang, Counter()).update(tokens(text.as_py()))
        if sum(map(len, counts.values())) > HELD:
            yield from out()
    yield from out()


class _Numbers(dict):
    """Word to its number within one language (0: not frequent).

    Holds the preloaded words; any other word is looked up by its hash and
    remembered for a while, or is not frequent where all words are preloaded.
    """

    def __init__(self, lang: str, known: dict[bytes, int], hashes: np.ndarray | None, numbers: np.ndarray | None):
        super().__init__(known)
        # as xxhash64(lang, word) of Spark: the first value's hash seeds the second
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.known, self.hashes, self.numbers = known, hashes, numbers

    def __missing__(self, word: bytes) -> int:
        if word == MARK:
            return 0
        if len(self) >= len(self.known) + (1 << 18):
            self.clear()
            self.update(self.known)
        value = xxhash.xxh64_intdigest(word, self.seed)
        at = int(np.searchsorted(self.hashes, np.uint64(value)))
        self[word] = found = int(self.numbers[at]) if at < len(self.hashes) and int(self.hashes[at]) == value else 0
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        found = map(self.get, words, repeat(0)) if self.hashes is None else map(self.__getitem__, words)
        return np.fromiter(found, np.int32, len(words))


def _encode(docs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """Texts as arrays of word numbers; runs of 0 are written once.

    Up to ``PRELOADED`` words (the most frequent ones) are broadcast as text;
    beyond, all are broadcast as sorted hashes besides.
    """
    table = None
    top = words
    if total > PRELOADED:
        least = words.approxQuantile("n", [1 - PRELOADED / total], 0.01)[0]
        top = words.filter(F.col("n") > least)
        found = words.select(F.xxhash64("lang", "word").alias("h"), F.col("id").cast("int").alias("id")).toArrow()
        hashes = found["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        table = (hashes[order], found["id"].to_numpy()[order])
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((top.select("lang", "word", F.col("id").cast("int").alias("id")).toArrow(), table or (None, None)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, (hashes, numbers) = shared.value
        by_lang: dict[str, _Numbers] = {}
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if lang not in by_lang:
                    own = texts.filter(pc.equal(texts["lang"], lang))
                    known = dict(zip(own["word"].cast(pa.binary()).to_pylist(), own["id"].to_pylist(), strict=True))
                    by_lang[lang] = _Numbers(lang, known, hashes, numbers)
                ids = by_lang[lang].of(tokens(text.as_py()))
                if len(ids):
                    ids = ids[np.append(True, (ids[1:] > 0) | (ids[:-1] > 0))]
                out.append(ids)
            yield pa.record_batch([pa.array(out, pa.list_(pa.int32()))], names=["ids"])

    return write_table(_languages(docs).mapInArrow(encode, "ids array<int>"), "phrases-texts")


class Trie:
    """Double array over phrases of word numbers: state s moves on code c to ``base[s] + c`` if ``check`` there is s.

    The state of a phrase's first word is its number; every further word is
    read as base-256 digits, so the cells of one state span 256 and states with
    few moves interleave.  States are placed many at a time: random bases are
    proposed for all, those whose cells are free and wanted by nobody else
    stay.  ``accept[s]`` is the phrase (its place in the given order, from 0)
    that ends in state s, or -1.
    """

    SPAN = 256

    def __init__(self, phrases: np.ndarray, words: int):
        n, self.width = phrases.shape
        self.digits = max(1, -(-int(words).bit_length() // 8))
        self.base = np.zeros(words + 1, np.int32)
        self.check = np.zeros(words + 1, np.int32)  # all of them stand under the root, 0
        rng = np.random.default_rng(7)
        state = phrases[:, 0].astype(np.int64)
        for k in range(1, self.width):
            for shift in self._shifts():
                moves, place = np.unique((state << 8) | ((phrases[:, k].astype(np.int64) >> shift) & 255), return_inverse=True)
                self._place(moves >> 8, moves & 255, rng)
                state = (self.base[moves >> 8] + (moves & 255))[place]
        self._grow(self.SPAN)  # a base plus any code lies inside
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[state] = np.arange(n)

    def _shifts(self) -> range:
        return range(8 * (self.digits - 1), -1, -8)

    def _grow(self, cells: int) -> int:
        """Add free cells; the first of them."""
        old = len(self.check)
        self.base = np.concatenate([self.base, np.zeros(cells, np.int32)])
        self.check = np.concatenate([self.check, np.full(cells, -1, np.int32)])
        return old

    def _place(self, parent: np.ndarray, code: np.ndarray, rng) -> None:
        """Bases of the states ``parent`` (sorted, one entry per move)."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        size = np.diff(np.append(first, len(parent)))
        # many moves: cells of their own
        many = np.flatnonzero(size > self.SPAN // 4)
        if len(many):
            self.base[parent[first[many]]] = self._grow(self.SPAN * len(many)) + self.SPAN * np.arange(len(many))
            own = np.repeat(size > self.SPAN // 4, size)
            self.check[self.base[parent[own]] + code[own]] = parent[own]
        low = 0
        for most, least in ((self.SPAN // 4, 17), (16, 5), (4, 1)):
            todo = np.flatnonzero((size <= most) & (size >= least))
            if not len(todo):
                continue
            start = self._grow(2 * int(size[todo].sum()) + self.SPAN)
            low = low or start
            tries = 0
            while len(todo):
                tries += 1
                if tries % 20 == 0:
                    self._grow(int(size[todo].sum()) + self.SPAN)
                proposed = rng.integers(low, len(self.check) - self.SPAN + 1, len(todo))
                owner = np.repeat(np.arange(len(todo)), size[todo])
                at = np.repeat(first[todo] - np.cumsum(size[todo]) + size[todo], size[todo]) + np.arange(len(owner))
                cells = proposed[owner] + code[at]
                good = self.check[cells] < 0
                _, winner = np.unique(cells, return_index=True)
                alone = np.zeros(len(cells), bool)
                alone[winner] = True
                stays = np.bincount(owner, good & alone, len(todo)) == size[todo]
                kept = stays[owner]
                self.base[parent[first[todo[stays]]]] = proposed[stays]
                self.check[cells[kept]] = parent[at[kept]]
                todo = todo[~stays]

    def states(self, words: np.ndarray) -> np.ndarray:
        """The phrase that begins at each position, or -1; all positions move on together, one code at a time."""
        n = len(words) - self.width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        at = np.flatnonzero(words[:n] > 0)
        state = words[at]
        for k in range(1, self.width):
            for shift in self._shifts():
                moved = self.base[state] + ((words[at + k] >> shift) & 255)
                good = self.check[moved] == state
                at, state = at[good], moved[good]
        out = np.full(n, -1, np.int64)
        out[at] = self.accept[state]
        return out


class _Sums:
    """Counts of 64-bit keys, merged when many have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        kinds, counts = np.unique(keys, return_counts=True)
        self.parts.append((kinds, counts))
        self.held += len(kinds)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            kinds, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            # sums of counts stay below 2**53
            self.parts = [(kinds, np.bincount(place, np.concatenate([n for _, n in self.parts])).astype(np.int64))]
        self.held = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _pairs(texts: DataFrame, trie, names, counted) -> DataFrame:
    """key, n per task: neighbouring frequent phrases that overlap in all but one word (trie None: words).

    The key packs the numbers of the left and the right phrase, 32 bits each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = names.value if names else None
        own = counted.value if counted else None
        sums = _Sums()

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = sums.merge()
            if ids is not None:
                keys = (ids[keys >> 32] << 32) | ids[keys & 0xFFFFFFFF]
            sums.parts, sums.held = [], 0
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            words = np.insert(flat, ends, 0)  # a break after every text
            if trie is None:
                state = words.astype(np.int64)
                good = (state[:-1] > 0) & (state[1:] > 0)
            else:
                state = trie.value.states(words)
                good = (state[:-1] >= 0) & (state[1:] >= 0)
                good[good] = own[state[:-1][good]]
            sums.add((state[:-1][good] << 32) | state[1:][good])
            if sums.held > 8 * HELD:
                sums.merge()
                if sums.held > 4 * HELD:
                    yield from out()
        yield from out()

    return texts.mapInArrow(count, "key long, n long")


def _level(texts: DataFrame, below: DataFrame, words: int, width: int, min_count: int, block: int) -> DataFrame:
    """id, ws (word numbers), n of the frequent phrases one word longer than those ``below`` (of ``width`` words)."""
    context = texts.sparkSession.sparkContext
    if width == 1:
        found = write_table(_summed(_pairs(texts, None, None, None), min_count), "phrases-found")
        longer = found.select(F.array("left", "right").alias("ws"), "n")
    else:
        blocks = max(1, -(-2 * below.count() // block))
        ends = below.select(
            "id", "ws",
            F.pmod(F.xxhash64(F.slice("ws", 1, width - 1)), F.lit(blocks)).alias("head"),
            F.pmod(F.xxhash64(F.slice("ws", 2, width - 1)), F.lit(blocks)).alias("tail"),
        )
        found = None
        for b in range(blocks):
            table = ends.filter((F.col("head") == b) | (F.col("tail") == b)).toArrow()
            if not table.num_rows:
                continue
            phrases = table["ws"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            given = [context.broadcast(x) for x in (Trie(phrases, words), table["id"].to_numpy(), table["tail"].to_numpy() == b)]
            part = write_table(_summed(_pairs(texts, *given), min_count), "phrases-found")
            found = part if found is None else found.union(part)
        if found is None:
            return below.limit(0)
        left = below.select(F.col("id").alias("left"), "ws")
        right = below.select(F.col("id").alias("right"), F.element_at("ws", -1).alias("next"))
        longer = found.join(left, "left").join(right, "right").select(F.concat("ws", F.array("next")).alias("ws"), "n")
    return number_rows(longer, ["ws"])


def _summed(pairs: DataFrame, min_count: int) -> DataFrame:
    summed = pairs.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return summed.select(F.shiftrightunsigned("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right"), "n")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words of every language with their counts, numbered frequent words, frequent phrases of two words and more).

    lang, word, n; the same with id; ws (ids), n.
    """
    counted = _languages(docs).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = write_table(counted, "phrases-words")
    numbered = write_table(number_rows(words.filter(F.col("n") >= min_count), ["lang", F.desc("n"), "word"]), "phrases-frequent")
    total = numbered.count()
    texts = _encode(docs, numbered, total)
    below = numbered.select("id", F.array("id").alias("ws"), "n")
    phrases = below.limit(0).select("ws", "n")
    for width in range(1, longest):
        below = write_table(_level(texts, below, total, width, min_count, block), "phrases-level")
        phrases = phrases.union(below.select("ws", "n"))
        if below.isEmpty():
            break
    return words, numbered, phrases


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language, best first."""
    words, numbered, phrases = frequent_phrases(docs, min_count, longest, block)
    phrases = write_table(phrases, "phrases-all")
    counts = phrases.unionAll(numbered.select(F.array("id").alias("ws"), "n"))

    # the lowest-scoring cut; both parts of a frequent phrase are frequent
    cuts = phrases.select("ws", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(ws, 1, k)"), "rest": F.expr("slice(ws, k + 1, size(ws))")})
    parts = cuts.join(counts.toDF("first", "l"), "first").join(counts.toDF("rest", "r"), "rest")
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(8, 0))) div (cast(l as decimal(20, 0)) + r)")
    worst = parts.groupBy("ws", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # the most frequent longer phrase that holds a phrase
    inner = phrases.filter(F.size("ws") > 2).select(
        F.explode(F.expr("flatten(transform(sequence(2, size(ws) - 1), w -> transform(sequence(1, size(ws) - w + 1), i -> slice(ws, i, w))))")).alias("ws"), "n"
    )
    longer = inner.groupBy("ws").agg(F.max("n").alias("around"))
    swallowed = F.expr(f"coalesce(cast(100 as decimal(3, 0)) * cast(around as decimal(20, 0)) >= cast({SWALLOWED} as decimal(3, 0)) * cast(a as decimal(20, 0)), false)")
    kept = worst.join(longer, "ws", "left").filter(~swallowed).select("ws", "a", "cut.*")

    spelled = kept.select("ws", F.posexplode("ws").alias("pos", "id")).join(numbered.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ws").agg(
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelled, "ws").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
