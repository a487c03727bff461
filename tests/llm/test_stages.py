"""Filtering stages: repeated ids, columns named like internal ones, texts that no learned language explains."""

from __future__ import annotations

import random

from shopfloor.llm import decontaminate, langid, mixing, neardup, pii

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(200)]
A, B, C, D = (" ".join(RNG.choices(WORDS, k=40)) for _ in range(4))
NAMES = [
    "gone_id", "gone_key", "bad_id", "Bad_Key", "hits", "parts", "gaps", "cuts", "S_id", "s_key", "has_letter", "text_key", "print", "component_id",
    "n", "c", "k", "node", "rep", "weight", "hub", "bands", "last", "ws", "at", "h", "edge", "before", "part", "stays", "run", "kind", "match",
]


def hostile(spark, rows):
    """doc_id, text, lang, source, n_chars and columns named like those that the stages use inside."""
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(d, t, "en", "s", 0, *NAMES) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


CASES = [
    ("3a 7a 7c", "3a 7c"),
    ("3a 7a 7b 9b", "3a 7b"),
    ("7a 9a 7b", "7a 7b"),
    ("3a 3a 3a 4d", "3a 4d"),
]


def test_no_text_is_lost_under_a_repeated_id(spark):
    def rows_of(at, spec):
        texts = {k: " ".join(random.Random(f"{at}{k}").choices(WORDS, k=40)) for k in "abcd"}
        return [(100 * at + int(x[0]), texts[x[1]]) for x in spec.split()]

    rows = [r for at, (given, _) in enumerate(CASES) for r in rows_of(at, given)]
    want = [r for at, (_, stay) in enumerate(CASES) for r in rows_of(at, stay)]
    upper = [(903, A), (903, A.upper())]  # one set under one id, in two texts
    got = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(hostile(spark, rows + upper)).collect()]
    assert sorted(r for r in got if r[0] < 903) == sorted(want) and sum(r[0] == 903 for r in got) == 1


def test_repeated_ids_are_judged_row_by_row(spark):
    got = neardup.near_duplicates(hostile(spark, [(3, A), (5, B), (7, A), (7, B)]))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(3, 3), (5, 5), (7, 3), (7, 5)]


def test_copies_of_a_template_that_are_not_linked_to_each_other(spark):
    """An original with edited copies that reach it but not one another, among look-alikes that reach nobody."""
    base = [f"t{i}" for i in range(300)]

    def edited(share):
        w = list(base)
        for at in RNG.sample(range(0, 300, 6), share):
            w[at] = f"e{RNG.random()}"
        return " ".join(w)

    rows = [(100 + i, edited(4)) for i in range(40)] + [(200 + i, edited(30)) for i in range(40)] + [(900, " ".join(base))]
    from . import brute

    want = brute.near_duplicates(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(hostile(spark, rows)).collect()}
    assert got == want
    assert 1 < len({v[1] for v in want.values()}) < len(rows)


def test_hostile_names_in_every_stage(spark):
    rows = [(1, f"write to a@b.cd. {A}"), (2, A), (3, B), (4, None), (None, C)]
    docs = hostile(spark, rows)
    bench = spark.createDataFrame([(1, " ".join(B.split()[:20]))], "item_id long, text string")
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} == {1, 2, 3, None}
    dropped = decontaminate.drop_contaminated(docs, bench)
    assert dropped.columns == docs.columns and {r["doc_id"] for r in dropped.collect()} == {1, 2, 4, None}
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns and {r["doc_id"]: len((r["text"] or "").split()) for r in cut.collect()}[3] == 20
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in redacted.collect()} == dict(rows) | {1: f"write to [EMAIL]. {A}"}
    assert neardup.drop_near_duplicates(docs).columns == docs.columns
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {d: len((t or "").split()) for d, t in rows}
    for r in redacted.collect():
        assert [r[n] for n in NAMES] == NAMES


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [
        (-1, "Привет, как дела? Это обычный текст на русском языке.", None), (-2, "これは日本語の文章です。とても短い。", None),
        (-3, "qwjkz xvbq zzkjw pqxv wqzk jxqv kkzq", None), (-4, "asdf ghjk qwer zxcv", None), (-5, "12 34 !!", None), (-6, None, None),
    ]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    left = {r["doc_id"] for r in langid.keep_identified(docs.select("doc_id", "text", "lang").unionByName(more)).collect()}
    assert left == {r["doc_id"] for r in docs.filter("text rlike '\\\\p{L}'").collect()}
