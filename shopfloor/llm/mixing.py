"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the corpus total is shared by weight.  No source
may be read more than ``max_epochs`` times: a source whose share lies above
that is clamped there, and the excess is shared again among the others by
weight, until no share is above its clamp.  A source's target is then met by
seeded repetitions: every document is taken ``target div size`` whole times,
and the rest of the target is filled by one more repetition of documents in a
seeded order; the document at the edge gives only the words still missing (a
fractional repetition), so a source's total is its target rounded to a word.

Scale.  Texts are read once, into a narrow table (id, source, size, seeded
order).  The fill only handles one row per source.  The seeded order is cut
into slots per source, and the slot at the edge of the fill again, until it
holds at most ``EDGE_ROWS`` documents; only these are sorted.  A source, an id
or one repeated row holding a third of all rows is never ordered as a whole:
behind the id's hash stand the text's digest and a number of the row.

Defined cases: null text has size 0; a null source is a source of its own
(last in order); null ids are ordered by their text's digest; repeated ids
by their texts' digests; repeated rows are documents of their own (which of
equal rows is taken is open, the rows of the result are the same); an empty
table gives no rows; sources without words have target 0.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ids import number_rows
from ..plans.joins import maybe_broadcast
from ..plans.materialize import write_table
from .common import whole_text, words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-v1"
# the edge is found in steps over longer prefixes of the order: 32 digits of the id's hash, 16 of the text's, 6 of the row
PREFIXES = (2, 4, 6, 32, 34, 36, 38, 48, 50, 52, 54)
EDGE_ROWS = 10_000


def sized_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, its null-safe key (no_source, source_key), size in words, seeded order ``h``.

    The row's digits are fixed only once the table is written.
    """
    row = F.substring(F.md5(F.monotonically_increasing_id().cast("string").cast("binary")), 1, 6)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.md5(whole_text("text").cast("binary")))
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.size(words(whole_text("text"))).cast("long").alias("size"),
        F.concat(
            F.md5(F.concat(F.lit(f"{seed}:"), ident).cast("binary")),
            F.substring(F.md5(whole_text("text").cast("binary")), 1, 16), row,
        ).alias("h"),
    )


def source_weights(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row per source: source_size and the weight, given in turn to the sources by code point (null last)."""
    sources = sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    numbered = number_rows(sources, ["no_source", "source_key"], id_col="rank")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return numbered.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: shares by weight, clamped at max_epochs * source_size, the excess shared again.

    Each round is one aggregate over the sources; the clamped set only grows,
    so rounds are at most the number of sources (in practice a handful).
    """
    big = "decimal(38,0)"
    clamp = F.col("source_size").cast(big) * max_epochs
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = int(total or 0), int(weight or 0)
    left, free, n_clamped = total, weight, 0
    while True:
        # above its clamp: weight * left / free > max_epochs * size, in whole numbers
        above = F.col("weight").cast(big) * F.lit(left).cast(big) > clamp * F.lit(free).cast(big)
        n, clamped, w = sources.filter(above).agg(F.count(F.lit(1)), F.sum(clamp), F.sum("weight")).first()
        if n == n_clamped:
            break
        n_clamped, left, free = n, total - int(clamped), weight - int(w)
    share = (F.lit(float(left)) * F.col("weight").cast("double")) / F.lit(float(max(free, 1)))
    return sources.withColumn("target", F.when(above, (F.col("source_size") * max_epochs).cast("double")).otherwise(share))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken`` (words the mix takes, repeats counted)."""
    key = ["no_source", "source_key"]
    sized = write_table(sized_documents(docs, seed), "mix-sizes")
    sources = water_fill(source_weights(sized, weights), max_epochs)
    wanted = F.floor(F.col("target") + 0.5)
    plan = sources.select(
        *key, "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("source_size") > 0, wanted % F.col("source_size")).otherwise(0).cast("long").alias("part"),
    )
    # the edge of the fill: the prefix of the seeded order in which the running size passes ``part``; every step looks
    # at more digits of the documents in the edge found so far, until few enough documents are left there
    plan = plan.withColumn("edge", F.lit("")).withColumn("before", F.lit(0).cast("long"))
    plan = write_table(plan, "mix-plan")
    for digits in PREFIXES:
        plan = maybe_broadcast(plan)
        inside = sized.join(plan.select(*key, "edge", "part", "before"), key).filter(F.col("h").startswith(F.col("edge")))
        sums = inside.groupBy(*key, F.substring("h", 1, digits).alias("slot"), "part", "before").agg(
            F.sum("size").alias("slot_size"), F.count(F.lit(1)).alias("slot_rows")
        )
        upto = F.col("before") + F.sum("slot_size").over(Window.partitionBy(*key).orderBy("slot"))
        passed = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("part"))
        edges = passed.groupBy(*key).agg(
            F.min_by(F.struct("slot", (F.col("upto") - F.col("slot_size")).alias("before"), "slot_rows"), "slot").alias("_e")
        )
        rest = [c for c in plan.columns if c not in ("edge", "before", "edge_rows")]
        plan = plan.select(*rest).join(edges, key, "left").select(
            *rest, F.col("_e.slot").alias("edge"), F.col("_e.before").alias("before"), F.col("_e.slot_rows").alias("edge_rows")
        )
        plan = write_table(plan, "mix-plan")
        if (plan.agg(F.max("edge_rows")).first()[0] or 0) <= EDGE_ROWS:
            break
    plan = maybe_broadcast(plan.drop("edge_rows"))
    rows = sized.join(plan, key)
    in_edge = F.coalesce(F.col("h").startswith(F.col("edge")), F.lit(False))
    outside = rows.filter(~in_edge).withColumn("extra", F.when(F.col("h") < F.col("edge"), F.col("size")).otherwise(0))
    seen = F.sum("size").over(Window.partitionBy(*key).orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("part") - F.col("before") - F.coalesce(seen, F.lit(0))
    inside = rows.filter(in_edge).withColumn("extra", F.least(F.greatest(room, F.lit(0)), F.col("size")))
    return outside.unionByName(inside).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source_key")).alias("source"),
        "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )
