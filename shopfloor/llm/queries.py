"""Registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import write_table
from ..session import ensure_checkpoint_dir
from . import chat, collocations, decontaminate, langid, lexical, licenses, mixing, neardup, packing, pii, quality, tokens, topk
from .common import keys_side, read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


_SPACE_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = (
    r"list_filter(regexp_split_to_array(" + _LOWER.format("coalesce({0}, '')")
    + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)


@register("op1_personal_data")
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    return pii.scan(read(spark, sf_dir, "documents"))


@register(
    "op2_near_duplicates",
    f"""
    WITH RECURSIVE
    d AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER.format('text'))} AS ws FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p0, p0 + n - 1), ' ') AS g
      FROM (SELECT doc_id, ws, least(len(ws), 5) AS n, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS p0
            FROM d WHERE len(ws) > 0)),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
          FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y
          WHERE 100 * i >= 85 * (cx.n + cy.n - i)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS low FROM d
          UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.doc_id WHERE r.low < e.y)
    SELECT d.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.low) AS component_id,
           d.doc_id = min(r.low) AS kept
    FROM d JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
    """,
)
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@register(
    "op3_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@register("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, own or inherited from its directory.

    Documents carry no path, so each stands as the file ``source/lang/hundreds/doc_id.txt``.
    """
    docs = read(spark, sf_dir, "documents")
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    return licenses.scan(files).select(
        F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "path", "license", F.round("cosine", 6).alias("cosine"), "how"
    )


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after four batches.

    All documents are inserted; those labelled toxic are removed, those labelled low quality are
    recounted under another vocabulary, and the removal is sent again (which changes nothing).
    """
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ledger = tokens.Ledger(spark, f"{ensure_checkpoint_dir(spark)}/token-ledger-{uuid.uuid4().hex}")
    toxic = labels.filter("toxic = 1").select("doc_id")
    poor = labels.filter("quality = 0").select("doc_id").join(toxic, "doc_id", "left_anti")
    poor = keys_side(poor, "poor-documents")  # so that the texts stay where they are read
    ledger.insert("load", tokens.count_tokens(docs, tokens.BYTE_BPE))
    ledger.remove("toxic", toxic)
    ledger.revise("recount", tokens.count_tokens(docs.join(poor, "doc_id", "left_semi"), tokens.MULTI_BPE))
    ledger.remove("toxic", toxic)
    return ledger.totals()


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_ESCAPE = (
    r"regexp_replace(replace(replace({0}, '\', '\\'), '|>', '|\>'), '(<)(</SYS>>|<SYS>>|/s>|s>|\|)|(\[)(/INST\]|INST\])',"
    r" '\1\3\\\2\4', 'g')"
)


@register(
    "op7_chat",
    f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(length('<|im_start|><|im_sep|><|im_end|>') + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')}))::BIGINT
             AS formatted_chars
    FROM c GROUP BY conv_id
    """,
)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted with its loss mask, and digests of what is read back from it."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    formatted = write_table(chat.format_conversations(rows.unionByName(extra)), "chat")
    return chat.read_back(formatted)


@register(
    "op8_mix",
    f"""
    WITH d AS (
      SELECT doc_id, source, len({_SPACE_WORDS.format('text')})::BIGINT AS size,
             md5('mix-v1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) || substr(md5(coalesce(text, '')), 1, 16) AS h
      FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
    o AS (
      SELECT *, sum(source_size) OVER ()::BIGINT AS tot, sum(w) OVER ()::BIGINT AS wtot,
             row_number() OVER f AS pos,
             (sum(3 * source_size) OVER f)::BIGINT - 3 * source_size AS clamped,
             (sum(w) OVER f)::BIGINT - w AS clamped_w
      FROM s WINDOW f AS (ORDER BY 3.0 * source_size / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
    lvl AS (
      SELECT min_by(tot - clamped, pos) AS num, min_by(wtot - clamped_w, pos) AS den, min(pos) AS first_free
      FROM o WHERE 3::HUGEINT * source_size * (wtot - clamped_w) >= w::HUGEINT * (tot - clamped)),
    t AS (
      SELECT source, source_size,
             CASE WHEN pos < first_free THEN (3 * source_size)::DOUBLE
                  ELSE (num::DOUBLE * w::DOUBLE) / den::DOUBLE END AS target
      FROM o, lvl),
    p AS (SELECT *, floor(target + 0.5)::BIGINT AS wanted FROM t),
    c AS (
      SELECT d.*, p.source_size, p.target, p.wanted,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT
               - d.size AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, source, size, source_size, target,
           CASE WHEN source_size = 0 THEN 0
                ELSE (wanted // source_size) * size
                     + least(greatest(wanted % source_size - before, 0), size) END::BIGINT AS taken
    FROM c
    """,
)
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix of all sources at weights 1, 2, 3 and at most three epochs."""
    return mixing.mix(read(spark, sf_dir, "documents"))


@register(
    "op9_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {_ITEM_WORDS.format('text')} AS ws FROM documents),
    i AS (SELECT item_id, {_ITEM_WORDS.format('text')} AS ws FROM benchmark),
    iw AS (SELECT item_id, ws, least(len(ws), 13) AS n FROM i WHERE len(ws) > 0),
    ig AS (
      SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, p0, p0 + n - 1), ' ') AS gram
      FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p0 FROM iw)),
    lens AS (SELECT DISTINCT n FROM ig),
    dg AS (
      SELECT doc_id, n, p0, array_to_string(list_slice(ws, p0, p0 + n - 1), ' ') AS gram
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p0 FROM d, lens WHERE len(ws) >= n)),
    hits AS (SELECT dg.doc_id, dg.p0, dg.n, ig.item_id FROM dg JOIN ig USING (n, gram)),
    cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS pos FROM (SELECT DISTINCT doc_id, p0, n FROM hits))
            GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(cov.n_hit, 0)::BIGINT AS n_hit,
           coalesce(its.n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
           coalesce(cov.n_hit, 0) > 0 AND 20 * coalesce(cov.n_hit, 0) >= len(d.ws) AS contaminated
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of every document."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@register("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(read(spark, sf_dir, "documents"))


@register("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


_TERMS = (
    r"list_filter(regexp_split_to_array(" + _LOWER.format("coalesce({0}, '')")
    + r", '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)


@register(
    "op12_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS ts FROM documents),
    u AS (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
    c AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
    tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM u GROUP BY r, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    i AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
    w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
    s AS (
      SELECT i.item_id, tf.r, any_value(tf.doc_id) AS doc_id,
             sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * nn) // ll))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN tf USING (term), c GROUP BY i.item_id, tf.r)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
    WHERE rank <= 10
    """,
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register(
    "op13_collocations",
    f"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
    tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    f AS (
      SELECT lang, k, phrase, count(*)::BIGINT AS a
      FROM (SELECT lang, k, array_to_string(list_slice(ws, p0, p0 + k - 1), ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p0 FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k))
      GROUP BY lang, k, phrase HAVING count(*) >= 30),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    cuts AS (
      SELECT lang, phrase, k, a, ws, cut, array_to_string(list_slice(ws, 1, cut), ' ') AS head, array_to_string(list_slice(ws, cut + 1, k), ' ') AS rest
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
    sc AS (
      SELECT cuts.*, h.a AS l, t.a AS r, ((2000000::HUGEINT * cuts.a) // (h.a + t.a))::BIGINT AS score
      FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.rest),
    low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inside AS (
      SELECT lang, array_to_string(list_slice(ws, p0, p0 + m - 1), ' ') AS phrase, max(a) AS around
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS p0 FROM (SELECT *, unnest(range(2, k)) AS m FROM c))
      GROUP BY ALL),
    kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE NOT coalesce(100::HUGEINT * around >= 80::HUGEINT * a, false))
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM (SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN tot USING (lang)
    WHERE rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of every language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))
