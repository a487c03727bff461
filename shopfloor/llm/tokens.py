"""Token counts as delta-maintained rollups.

A ledger is a folder of committed batches.  A batch holds signed entries, one
per document and tokenizer version (+1 for an insert, -1 for a removal; a
revised count is the old entry negated and the new one), and their sums by
source, language and version.  Totals are the sums over all batches: nothing
is ever recounted.  A batch is committed by the success marker of its sums,
written last; committing an id again does nothing, and an attempt that died
before its marker is overwritten by the next.

Counting runs the tokenizer in Arrow batches on the executors; its file is
read on the driver and broadcast (fixed size).

Defined cases: null text has no tokens; null source, language or id is a value
of its own (entries without id cannot be removed later); repeated rows of an
insert each count, a removal takes all entries of an id; an empty batch
commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import write_table
from .common import bound_text_batches, keys_side, whole_text

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, MULTI_BPE = "byte_bpe_50k", "byte_bpe_multi_50k"
KEYS = ["source", "lang", "version"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
ENTRY = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
# Fixed value: the pre-splitting pattern of both vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_READY: dict[str, object] = {}


def _encoding(version: str, lines: bytes):
    if version not in _READY:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _READY[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[version]


def count_tokens(docs: DataFrame, version: str, folder: str = TOKENIZERS) -> DataFrame:
    """One insert entry per document under a tokenizer version (the name of its vocabulary file)."""
    bound_text_batches(docs.sparkSession)
    with open(f"{folder}/{version}.tiktoken", "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(version, lines.value)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t.as_py())) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column(c) for c in ("doc_id", "source", "lang", "version", "n_docs")] + [pa.array(n, pa.int64()), batch.column("n_chars")],
                names=["doc_id", *KEYS, *MEASURES],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("n_docs"),
        F.length(whole_text("text")).cast("long").alias("n_chars"), whole_text("text").alias("text"),
    )
    return rows.mapInArrow(count, ENTRY)


class Ledger:
    """A folder of committed batches of signed token counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def is_committed(self, batch: str) -> bool:
        fs, path = self._path(f"sums/{batch}/_SUCCESS")
        return fs.exists(path)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        fs, path = self._path("sums")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if self.is_committed(n))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{part}/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_chars over all committed batches."""
        sums = self._read("sums", ENTRY.split(", ", 1)[1])
        return sums.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).filter("n_docs <> 0 or n_tokens <> 0")

    def standing(self, ids: DataFrame) -> DataFrame:
        """What the ledger holds of the documents with these ids, one row per id and key."""
        wanted = keys_side(ids.select(F.col("doc_id").alias("w")), "ledger-ids")
        held = self.entries().join(wanted, F.col("doc_id") == F.col("w"), "left_semi")
        return held.groupBy("doc_id", *KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).filter("n_docs <> 0")

    def commit(self, batch: str, entries: DataFrame) -> bool:
        """Commit signed entries under a batch id; False (and nothing done) when the id is committed already."""
        if self.is_committed(batch):
            return False
        target = f"{self.folder}/entries/{batch}"
        entries.select("doc_id", *KEYS, *MEASURES).write.mode("overwrite").parquet(target)
        sums = self.spark.read.schema(ENTRY).parquet(target).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/{batch}")
        return True

    def insert(self, batch: str, counted: DataFrame) -> bool:
        return self.commit(batch, counted)

    def remove(self, batch: str, ids: DataFrame) -> bool:
        """Remove all entries of documents."""
        return not self.is_committed(batch) and self.commit(batch, negated(self.standing(ids)))

    def revise(self, batch: str, counted: DataFrame) -> bool:
        """Replace the entries of documents by new counts (under any version)."""
        if self.is_committed(batch):
            return False
        counted = write_table(counted, "ledger-counts")  # read twice: for its ids and as the new entries
        return self.commit(batch, negated(self.standing(counted)).unionByName(counted))


def negated(entries: DataFrame) -> DataFrame:
    return entries.withColumns({m: -F.col(m) for m in MEASURES})
