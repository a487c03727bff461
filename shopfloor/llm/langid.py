"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams per language in each partition and adds
them up in one aggregate; the log-probability matrix (``BUCKETS`` rows, one
float32 column per language: 128 KB a language) is broadcast, and texts are
scored in numpy by gathering the rows of their grams.

Text is lower-cased; every run of non-letters counts as one blank.  All
labelled training rows and all of each text are used; long texts are read in
overlapping slices, so memory is bounded.

The posterior says which learned language fits best, not whether it fits.
``keep_identified`` therefore also asks how far a text's mean log-probability
a gram lies below what that language's own grams give on average, in standard
deviations of one gram and allowing ``CHANCE / sqrt(grams)`` for short texts:
a text in a language that was not learned, or keyboard junk, lies beyond
``MAX_STRANGE``.

Defined cases: null text or text without a letter: ``und`` with score 0;
rows with a null id or null language are never learned from (they are
predicted; held_out is false for a null id); ties go to the language that is
first by code point; an empty training set predicts ``und`` for all; repeated
rows each count; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_text_batches, fold, fresh

ORDERS = (1, 2, 3)
BITS = 15
BUCKETS = 1 << BITS
ALPHA = 0.1  # additive smoothing
SLICE = 1 << 18  # characters handled at once
UNDETERMINED = "und"
MIN_SCORE = 0.3  # below this a document's language counts as rejected: short texts of one language stay well above
MAX_STRANGE, CHANCE = 2.0, 3.0
FOLDS, HELD_OUT = 4, 2

_U64 = np.uint64
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, as a table (built once per process)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of all n-grams of the text, slice by slice (slices overlap by the longest gram less one)."""
    lowered = text.lower()
    table, overlap, tail = _letters(), max(ORDERS) - 1, np.empty(0, np.uint32)
    for at in range(0, len(lowered), SLICE):
        raw = lowered[at : at + SLICE].encode("utf-32-le", "surrogatepass")
        cp = np.frombuffer(raw, np.uint32)
        cp = np.where(table[cp], cp, np.uint32(32))
        before = np.concatenate([tail[-1:] if len(tail) else np.array([32], np.uint32), cp[:-1]])
        cp = cp[(cp != 32) | (before != 32)]  # one blank per run
        whole = np.concatenate([tail, cp]).astype(_U64)
        out, gram = [], np.zeros(len(whole), _U64)
        for n in range(1, max(ORDERS) + 1):
            if len(whole) < n:
                break
            gram = gram[: len(whole) - n + 1] * _U64(0x100000001B3) + whole[n - 1 :] + _U64(n)
            new = gram[max(0, len(tail) - n + 1) :]  # grams that end in this slice
            if n in ORDERS:
                out.append(((new * _U64(0x9E3779B97F4A7C15)) >> _U64(64 - BITS)).astype(np.intp))
        tail = whole[len(whole) - min(overlap, len(whole)) :].astype(np.uint32)
        if out:
            yield np.concatenate(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    docs: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            docs[lang] += 1
            for found in gram_buckets(text.as_py()):
                if len(found) < BUCKETS // 4:
                    np.add.at(totals[lang], found, 1)
                else:
                    totals[lang] += np.bincount(found, minlength=BUCKETS)
    for lang, n in docs.items():
        used = np.flatnonzero(totals[lang])
        yield pa.record_batch(
            [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(totals[lang][used], n))],
            names=["lang", "bucket", "n"],
        )


class Model:
    """Languages (sorted) and the matrix of log-probabilities, one row per bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        smooth = counts + ALPHA
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=0)).astype(np.float32)) if langs else counts
        self.prior = np.log(docs / docs.sum()) if langs else docs
        # mean and deviation of the log-probability of a language's own grams
        share = np.exp(self.logp, dtype=np.float64) if langs else counts
        self.usual = (share * self.logp).sum(axis=0)
        self.spread = np.sqrt((share * (self.logp - self.usual) ** 2).sum(axis=0))

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language, posterior, and how strange the text is for that language (0: as usual)."""
        if not self.langs:
            return UNDETERMINED, 0.0, 0.0
        total, grams = self.prior.copy(), 0
        for found in gram_buckets(text):
            total += self.logp[found].sum(axis=0, dtype=np.float64)
            grams += len(found)
        best = int(np.argmax(total))
        below = self.usual[best] - (total[best] - self.prior[best]) / max(grams, 1)
        strange = below / max(self.spread[best], 1e-9) - CHANCE / np.sqrt(max(grams, 1))
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum()), float(strange)

    def predict(self, text: str) -> tuple[str, float]:
        return self.judge(text)[:2]


def train(docs: DataFrame) -> Model:
    """Fit on the rows with text and language outside the held-out fold."""
    bound_text_batches(docs.sparkSession)
    rows = docs.filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(fold("doc_id", FOLDS) != HELD_OUT, F.lit(False))
    ).select("lang", "text")
    summed = (
        rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toArrow()  # at most BUCKETS + 1 rows a language
    lang, bucket, n = (summed.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    langs = sorted(set(lang.tolist()))
    place = {x: i for i, x in enumerate(langs)}
    column = np.fromiter((place[x] for x in lang.tolist()), np.intp, len(lang))
    counts, sizes = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    is_doc = bucket < 0
    counts[bucket[~is_doc], column[~is_doc]] = n[~is_doc]
    sizes[column[is_doc]] = n[is_doc]
    return Model(langs, counts, sizes)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its text alone."""
    bound_text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            answers = [
                model.predict(t.as_py()) if ok.as_py() else (UNDETERMINED, 0.0)
                for t, ok in zip(batch.column("text"), batch.column("has_letter"), strict=True)
            ]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
        "text",
    )
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the table's labelled rows outside the held-out fold and predict every row."""
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, max_strange: float = MAX_STRANGE) -> DataFrame:
    """The documents whose language is determined with at least ``min_score`` and not too strange for it, with all their columns."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_letter = fresh(docs, "has_letter")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            good = []
            for text, ok in zip(batch.column("text"), batch.column(has_letter), strict=True):
                lang, score, strange = model.judge(text.as_py()) if ok.as_py() else (UNDETERMINED, 0.0, 0.0)
                good.append(lang != UNDETERMINED and score >= min_score and strange <= max_strange)
            yield batch.drop_columns([has_letter]).filter(pa.array(good, pa.bool_()))

    marked = docs.withColumn(has_letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(keep, docs.schema)
