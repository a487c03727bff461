"""Near-duplicate documents by min-max hashing.

A document's set is its distinct five-word shingles (ASCII-lowered words).
Under each of ``PERMUTATIONS`` hash permutations both the minimum and the
maximum are kept, so one hash evaluation gives two signature values; minima
and maxima are banded separately, ``ROWS`` values to a band.  Two sets of
similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: at 0.85,
a pair is missed once in about four million.

1. One scan gives every document its set size, a 128-bit fingerprint of its
   set and its band keys.  Rows with equal sets form a class; only one row of
   a class is banded.
2. In every bucket each member is paired with the bucket's hub (a star, not
   all pairs) and compared with it on the full sets.  The hub is the member
   that meets most others over all its buckets: the text that others were
   copied from, where there is one, so that what a copy has beyond its hub is
   mostly its own.
3. Members linked to the same hub are connected.  Any other pair of a star is
   found by an exact prefix join on the members' differences from the hub,
   rarest elements first and without elements whose holders are connected
   already, and confirmed on the differences: every pair that shares a bucket
   is either confirmed or already connected, whatever the bucket's size, and
   nothing is capped.
4. Linked classes are joined into components, named by their smallest id.

Sets are compared as sets of 64-bit shingle hashes.

Defined cases: null text or text without words: empty set, linked with
nothing; fewer than five words: the whole sequence is one shingle; a null id
takes no part in linking (component null, kept); rows that repeat an id are
each judged by their own set alone (an id does not link its rows), and where a
group's smallest id stands on several rows ``drop_near_duplicates`` keeps one;
an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import write_table
from .common import bound_text_batches, fresh, keys_side
from .components import components

SHINGLE = 5
PERMUTATIONS = 192
ROWS = 8
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 85  # linked when 100 * intersection >= PERCENT * union
SEED = 20240501

_U64 = np.uint64
_MIX = _U64(0x9E3779B97F4A7C15)


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class _WordHashes(dict):
    """Word to 64-bit hash, remembering recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles (bytes.lower and bytes.split are ASCII-only)."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, _U64)
    w = np.fromiter(map(_HASHES.__getitem__, found), _U64, len(found))
    width = min(SHINGLE, len(w))
    n = len(w) - width + 1
    x = np.full(n, width, _U64)
    for k in range(width):
        x = _finish(x * _MIX + w[k : k + n])
    return np.unique(x)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 63, size=(2, PERMUTATIONS, 1), dtype=np.int64).astype(_U64)
    return draw[0] * _U64(2) + _U64(1), draw[1] * _U64(2) + _U64(1)


_ODD, _ADD = _permutations()
_BAND_SALT = _finish(np.arange(1, BANDS + 1, dtype=_U64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: half the bands fold minima, half fold maxima."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, _U64)
    high = np.zeros(PERMUTATIONS, _U64)
    for at in range(0, len(shingles), 256):
        v = shingles[None, at : at + 256] * _ODD + _ADD
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    rows = np.concatenate([low, high]).reshape(BANDS, ROWS)
    key = _BAND_SALT.copy()
    for k in range(ROWS):
        key = _finish(key * _MIX + rows[:, k])
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, bands = [], [], []
        for text in batch.column(2).cast(pa.binary()):
            s = shingle_set(text.as_py())
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(band_keys(s).view(np.int64) if len(s) else None)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "n_shingles", "print", "bands"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, print (fingerprint of the set, null when empty), bands."""
    bound_text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(_sign, "doc_id long, text_key long, n_shingles long, print binary, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [shingle_set(t.as_py()) for t in part.column(1).cast(pa.binary())]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            yield pa.record_batch(
                [part.column(0), pa.array(prints, pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                names=["id", "set_print", "set"],
            )


def _class_sets(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """node, set of the classes that share a bucket; only those leave the scan of the texts."""
    nodes = members.select("node").distinct().join(classes, "node").select("node", "rep", "print")
    wanted = keys_side(nodes.select(F.col("rep").alias("w")), "dedup-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("w"), "left_semi")
    found = texts.mapInArrow(_sets, "id long, set_print binary, set array<long>")
    placed = found.join(nodes, (F.col("id") == F.col("rep")) & (F.col("set_print") == F.col("print"))).select("node", "set")
    return write_table(placed.dropDuplicates(["node"]), "dedup-sets")


def _linked(n: str, m: str, apart: Column) -> Column:
    """Whether sets of n and m shingles, ``apart`` of which are in one set only, reach PERCENT of their union."""
    both = F.col(n) + F.col(m)
    return 100 * (both - apart) >= PERCENT * (both + apart)


def _differences(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Of every star pair (x, hub): nx, nh, d (elements in one set only), nd, and whether they are linked."""
    both = stars.join(sets.toDF("x", "xs"), "x").join(sets.toDF("hub", "hs"), "hub")
    apart = F.concat(F.array_except("xs", "hs"), F.array_except("hs", "xs"))
    rows = both.select("hub", "x", F.size("xs").alias("nx"), F.size("hs").alias("nh"), apart.alias("d")).withColumn("nd", F.size("d"))
    return rows.withColumn("linked", _linked("nx", "nh", F.col("nd")))


def _hub_links(diffs: DataFrame) -> DataFrame:
    """Links (x, y) between members of one star that are not yet in one component (so not both linked to its hub).

    The sets of x and y are apart by what their differences from the hub are
    apart (an element that the hub lacks is never one that it has).  With d,
    d' the sizes of the differences (d <= d'), a link needs them to share more
    than a number that grows with d, so they share an element of x's first
    elements in any order common to the star (prefix filter); here the order
    is by the number of members that hold an element.

    Let a link allow the sets to be apart by T = (100 - P) (nx + ny) / (100 + P).
    Sharing o elements, they are d + d' - 2 o apart, hence o >= (d + d' - T) / 2.
    Whoever of the two is not linked to the hub is more than
    (100 - P) (n + nh) / (100 + P) from it; put in, o is more than half of the
    other's difference plus (100 - P) (nh - n) / (100 + P), n its size.
    """
    a, b = 100 - PERCENT, 100 + PERCENT
    # a star whose members are all in one component has nothing left to find
    open_stars = diffs.groupBy("hub").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count_if(~F.col("linked")).alias("far"))
    open_stars = keys_side(open_stars.filter("least <> most and far > 0").select(F.col("hub").alias("oh")), "dedup-open")
    rows = diffs.join(open_stars, F.col("hub") == F.col("oh"), "left_semi")
    # x as the smaller difference: the least overlap of a link
    apart = F.floor(F.lit(a) * (F.col("nx") + F.floor(100 * F.col("nx") / PERCENT)) / b)  # T at the largest partner
    if_linked = F.floor((b * F.col("nd") + a * (F.col("nh") - F.col("nx"))) / (2 * b)) + 1  # the partner is not linked
    if_not = F.greatest(F.col("nd") - F.floor(apart / 2), F.floor((b - a) * F.col("nd") / (2 * b)) + 1)
    least = F.greatest(F.when(F.col("linked"), if_linked).otherwise(if_not), F.lit(1))
    rows = write_table(rows.select("hub", "x", "nx", "nd", "c", "d", (F.col("nd") - least + 1).alias("prefix")), "dedup-open-rows")
    held = rows.select("hub", "x", "c", "prefix", F.explode("d").alias("e"))
    lists = held.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("open"))
    ranked = held.join(lists, ["hub", "e"]).groupBy("hub", "x").agg(F.sort_array(F.collect_list(F.struct("n", "e", "open"))).alias("all"), F.first("prefix").alias("prefix"))
    first = ranked.select("hub", "x", F.explode(F.slice("all", F.lit(1), F.greatest(F.col("prefix"), F.lit(0)).cast("int"))).alias("s"))
    index = first.filter("s.open").select("hub", "x", F.col("s.e").alias("e")).join(rows.select("hub", "x", "nx", "nd", "c"), ["hub", "x"])
    probe = held.join(lists.filter("open").select("hub", "e"), ["hub", "e"], "left_semi").select("hub", "e", F.col("x").alias("y"))
    probe = probe.join(rows.select("hub", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("nd").alias("nd2"), F.col("c").alias("c2")), ["hub", "y"])
    met = (
        index.join(probe, ["hub", "e"])
        .filter((F.col("c") != F.col("c2")) & ((F.col("nd") < F.col("nd2")) | ((F.col("nd") == F.col("nd2")) & (F.col("x") < F.col("y")))))
        # sets that differ in size alone by too much
        .filter(100 * F.least("nx", "ny") >= PERCENT * F.greatest("nx", "ny"))
        .select("hub", "x", "y").distinct()
    )
    left = rows.select("hub", "x", "nx", "nd", "d")
    right = rows.select("hub", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("nd").alias("nd2"), F.col("d").alias("d2"))
    shared = F.size(F.array_intersect("d", "d2"))
    return met.join(left, ["hub", "x"]).join(right, ["hub", "y"]).filter(_linked("nx", "ny", F.col("nd") + F.col("nd2") - 2 * shared)).select("x", F.col("y").alias("hub"))


def _links(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """x, hub over all links between classes that share a bucket; members holds (k, node, size)."""
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = write_table(members.join(weights, "node").select("k", "node", "weight"), "dedup-members")
    hubs = weighed.groupBy("k").agg(F.max(F.struct("weight", -F.col("node"))).alias("h")).select("k", (-F.col("h.col2")).alias("hub"))
    stars = write_table(weighed.join(hubs, "k").filter("node <> hub").select(F.col("node").alias("x"), "hub").distinct(), "dedup-stars")
    diffs = write_table(_differences(stars, _class_sets(docs, members, classes)), "dedup-differences")
    links = diffs.filter("linked").select("x", "hub")
    placed = diffs.join(components(links, "x", "hub"), F.col("x") == F.col("node"), "left").withColumn("c", F.coalesce("component", "x")).drop("node", "component")
    return links.union(write_table(_hub_links(write_table(placed, "dedup-placed")), "dedup-more-links"))


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, print, c (its group), component_id of every row."""
    signed = write_table(signatures(docs), "dedup-signatures")
    usable = signed.filter("print is not null and doc_id is not null")
    classes = usable.groupBy("print").agg(F.min("doc_id").alias("rep"))
    # a class goes by its smallest id; where several classes have the same one, the others by a hash
    first = classes.groupBy("rep").agg(F.min("print").alias("first"))
    named = classes.join(first, "rep").select("print", "rep", F.when(F.col("print") == F.col("first"), F.col("rep")).otherwise(F.xxhash64("rep", "print")).alias("node"))
    classes = write_table(named, "dedup-classes")
    own = usable.select("doc_id", F.col("print").alias("p"), "bands").join(classes, (F.col("doc_id") == F.col("rep")) & (F.col("p") == F.col("print")))
    keys = own.select("node", F.explode("bands").alias("k"))
    sizes = keys.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("size")).filter("a <> b").select("k", "size")
    members = write_table(keys.join(sizes, "k").select("k", "node", "size").distinct(), "dedup-buckets")
    links = _links(docs, members, classes)
    joined = classes.join(components(links, "x", "hub"), "node", "left").select("print", "rep", F.coalesce("component", "node").alias("c"))
    names = joined.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = write_table(joined.join(names, "c").select("print", "c", "component_id"), "dedup-components")
    rows = signed.select("doc_id", "text_key", "n_shingles", "print").join(named, "print", "left")
    return rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    return _grouped(docs).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of every group (its smallest id), with all its columns; documents without a set all stay."""
    rows = _grouped(docs).filter("c is not null and doc_id is not null")
    groups = rows.groupBy("c", "component_id", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("print"))
    groups = write_table(groups, "dedup-groups")
    # rows that repeat an id may stand in different groups, so a row goes by its id and text
    stay = groups.filter("doc_id = component_id").groupBy("c").agg(F.min(F.struct("print", "text_key")).alias("s"))
    marked = groups.join(stay, "c").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("s.text_key")))
    a, b = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    same = (F.col("doc_id").cast("long") == F.col(a)) & (F.xxhash64("text") == F.col(b))
    gone = keys_side(marked.filter("not stays").select(F.col("doc_id").alias(a), F.col("text_key").alias(b)), "dedup-gone")
    left = docs.join(gone, same, "left_anti")
    repeated = write_table(marked.filter("stays and n > 1").select(F.col("doc_id").alias(a), F.col("text_key").alias(b)), "dedup-repeated")
    if repeated.isEmpty():
        return left
    side = keys_side(repeated, "dedup-repeated")
    once = left.join(side, same, "left_semi")
    return left.join(side, same, "left_anti").unionByName(once.dropDuplicates(["doc_id", "text"]))
