"""Benchmark decontamination with a broadcast set of normalised test n-grams.

The benchmark's windows of ``WINDOW`` words (an item of fewer words is one
window) are hashed; every window of every document is hashed in its row and
looked up in that set, and a hit is verified on the words themselves.  Hits
are aggregated per document into covered words and touched items.

Scale.  Documents are scanned once, without shuffling texts: windows are
exploded from the row, looked up map-side and dropped unless they hit.  Only
hits and one marker row per document reach the shuffle.  The window table is
broadcast only while its measured size is at most ``BROADCAST_BYTES``; beyond
that every window of a document is shuffled as its position and the 128-bit
digest of its words (the digest then stands for the words) and joined on the
digest, which AQE can split; marker rows stay out of that join.

Defined cases: null text has no words (n_words 0, never contaminated); a
benchmark row with null text or no words has no windows; an item without id
marks words but is not counted as an item; items that share an id are one
item; rows with the same id and text give equal rows, each returned; an empty
benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import write_table
from .common import NON_WORD_CLASS, ascii_lower, fresh, keys_side, whole_text, words

WINDOW = 13
BROADCAST_BYTES = 64 << 20
MIN_SHARE = 20  # contaminated when at least 1 word in MIN_SHARE is hit


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: their words, hash, length and the ids of the items they occur in."""
    items = benchmark.select("item_id", words(ascii_lower(whole_text("text")), NON_WORD_CLASS).alias("ws"))
    length = F.least(F.size("ws"), F.lit(window))
    grams = items.filter(F.size("ws") > 0).select(
        "item_id", "ws", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("ws") - length + 1)).alias("at")
    )
    return (
        grams.select("item_id", F.slice("ws", F.col("at"), F.col("len")).alias("gram"))
        .groupBy("gram")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select(F.xxhash64("gram").alias("h"), F.size("gram").alias("len"), "gram", "items")
    )


def _hashes(ws: str, length: int) -> Column:
    """One hash per word of the document: of the window that starts there, null where it would pass the end."""
    return F.transform(
        F.col(ws), lambda _, i: F.when(i + length <= F.size(ws), F.xxhash64(F.slice(F.col(ws), i + 1, length)))
    )


def _looked_up(lowered: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """One marker row per document and one row per hit: doc_id, text_key, n_words, is_row, hit, items; windows are broadcast."""
    marker = F.array(F.lit(None).cast("long"))  # keeps a row for documents without a hit
    hashed = lowered.select(
        "doc_id", "text_key", F.size("ws").alias("n_words"), "ws",
        F.concat(marker, *[_hashes("ws", n) for n in lengths]).alias("hs"),
    )
    # the outer form: the inner one would add a filter on the array's size that recomputes it before the projection
    scanned = hashed.select("doc_id", "text_key", "n_words", "ws", F.posexplode_outer("hs").alias("pos", "wh"))
    # arrays of one length each: the window's first word (0-based) is (pos - 1) modulo n_words
    at = F.pmod(F.col("pos") - 1, F.greatest(F.col("n_words"), F.lit(1)))
    found = scanned.join(
        F.broadcast(windows), (F.col("wh") == F.col("h")) & (F.slice("ws", at + 1, F.greatest(F.col("len"), F.lit(1))) == F.col("gram")), "left"
    ).filter(F.col("h").isNotNull() | (F.col("pos") == 0))
    is_hit = F.col("h").isNotNull()
    return found.select(
        "doc_id", "text_key", "n_words",
        (F.col("pos") == 0).cast("int").alias("is_row"),
        F.when(is_hit, F.struct(at.alias("at"), "len")).alias("hit"),
        F.when(is_hit, F.col("items")).alias("items"),
    )


def _digest(gram: Column) -> Column:
    """128-bit digest of a window (no word holds a space)."""
    return F.unhex(F.md5(F.array_join(gram, " ").cast("binary")))


def _shuffled(lowered: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The rows of ``_looked_up`` by a shuffle join of digests; only full windows take part."""
    def starts(length: int) -> Column:
        last = F.size("ws") - length
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), _digest(F.slice(F.col("ws"), i + 1, length)).alias("d")),
        )
        return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<at:int,len:int,d:binary>>"))

    n_words = F.size("ws").alias("n_words")
    each = lowered.select("doc_id", "text_key", n_words, F.concat(*[starts(n) for n in lengths]).alias("hs"))
    # the outer form, as above
    each = each.select("doc_id", "text_key", "n_words", F.explode_outer("hs").alias("w")).filter("w is not null").select("doc_id", "text_key", "n_words", "w.*")
    known = windows.select(_digest(F.col("gram")).alias("d"), "items")
    hits = each.join(known, "d").select(
        "doc_id", "text_key", "n_words", F.lit(0).alias("is_row"), F.struct("at", "len").alias("hit"), "items"
    )
    markers = lowered.select(
        "doc_id", "text_key", n_words, F.lit(1).alias("is_row"),
        F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.lit(None).cast(hits.schema["items"].dataType).alias("items"),
    )
    return hits.unionByName(markers)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items, hits (positions of hit words), contaminated."""
    windows = write_table(benchmark_windows(benchmark, window), "bench-windows")
    # at most ``window`` lengths; the bytes bound what a broadcast would hold
    row = windows.agg(
        F.sort_array(F.collect_set("len")),
        F.sum(F.octet_length(F.array_join("gram", " ")) + 16 * F.size("gram") + 32 * F.size("items") + 64),
    ).first()
    lengths, held = list(row[0] or []), int(row[1] or 0)

    lowered = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        words(ascii_lower(whole_text("text")), NON_WORD_CLASS).alias("ws"),
    )
    found = _looked_up(lowered, windows, lengths) if held <= BROADCAST_BYTES else _shuffled(lowered, windows, lengths)
    per_doc = (
        found
        .groupBy("doc_id", "text_key", "n_words")
        .agg(F.sum("is_row").alias("rows"), F.collect_set("hit").alias("hits"), F.collect_set("items").alias("items"))
    )
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda m: F.sequence(m["at"], m["at"] + m["len"] - 1))))
    n_hit = F.size("hits").cast("long")
    return (
        per_doc.select(
            "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "rows",
            covered.alias("hits"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
        .drop("_copy", "rows")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, unchanged, with all their columns."""
    found = contamination(docs, benchmark, window).filter("contaminated")
    bad_id, bad_key = fresh(docs, "bad_id"), fresh(docs, "bad_key")
    bad = keys_side(found.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)), "bench-contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_key))
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with every hit word, and the separator after it, cut out of ``text``."""
    bad_id, bad_key, hits, parts, gaps = (fresh(docs, n) for n in ("bad_id", "bad_key", "hits", "parts", "gaps"))
    found = contamination(docs, benchmark, window).filter("n_hit > 0").select(
        F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key), F.col("hits").alias(hits),
    ).dropDuplicates([bad_id, bad_key])
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_key))
    joined = docs.join(found, same, "left")
    # lower-casing A-Z keeps every position, so the words and gaps of the text itself line up with the hits;
    # a leading gap of "" keeps the two arrays aligned (gap i stands before word i)
    token = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found_parts, found_gaps = F.regexp_extract_all("text", F.lit(token), F.lit(0)), F.split("text", token)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(hits))
    rebuilt = F.concat(
        F.element_at(gaps, 1),
        F.array_join(F.transform(kept, lambda i: F.concat(F.get(parts, i), F.get(gaps, i + 1))), ""),
    )
    return (
        joined.withColumn(parts, F.when(F.col(hits).isNotNull(), found_parts))
        .withColumn(gaps, F.when(F.col(hits).isNotNull(), found_gaps))
        .withColumn("text", F.when(F.col(hits).isNotNull(), rebuilt).otherwise(F.col("text")))
        .select(*docs.columns)
    )
