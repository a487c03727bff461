"""Registered corpus queries: equal to their SQL on the small fixtures, or to brute force and held-out labels."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from shopfloor.llm.queries import QUERIES, SQL

from ..conftest import SMALL, SMOKE
from . import brute


def table(name, sf):
    return duckdb.connect().execute(f"SELECT * FROM read_parquet('{sf}/{name}.parquet')").fetchall()


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SMOKE)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def test_personal_data_matches_brute_force(spark):
    texts = {d[0]: d[1] for d in table("documents", SMALL)}
    got = QUERIES["op1_personal_data"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_held_out_language_accuracy(spark):
    langs = {d[0]: d[2] for d in table("documents", SMALL)}
    held = [r for r in QUERIES["op10_language"](spark, SMALL).collect() if r["held_out"]]
    assert len(held) > 100 and sum(langs[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_held_out_quality_accuracy(spark):
    labels = {d[0]: d[1] for d in table("labels", SMALL)}
    held = [r for r in QUERIES["op6_quality"](spark, SMALL).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(labels[r["doc_id"]] == r["predicted"] for r in held) / len(held) > 0.95


def test_token_totals_match_a_recount(spark):
    from shopfloor.llm import tokens

    labels = {d[0]: d for d in table("labels", SMOKE)}
    want = Counter()
    for d in table("documents", SMOKE):
        _, quality, toxic = labels.get(d[0], (0, 1, 0))
        if toxic != 1:
            version = tokens.MULTI_BPE if quality == 0 else tokens.BYTE_BPE
            with open(f"{tokens.TOKENIZERS}/{version}.tiktoken", "rb") as f:
                n = len(tokens._encoding(version, f.read()).encode_ordinary(d[1]))
            for m, v in zip(tokens.MEASURES, (1, n, len(d[1])), strict=True):
                want[(d[3], d[2], version, m)] += v
    got = QUERIES["op5_token_counts"](spark, SMOKE).collect()
    assert Counter({(r["source"], r["lang"], r["version"], m): r[m] for r in got for m in tokens.MEASURES}) == want


def test_licenses_find_every_notice(spark):
    import re

    got = {r["doc_id"]: r for r in QUERIES["op4_licenses"](spark, SMALL).collect()}
    words = {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    for d in table("documents", SMALL):
        line = next((x for x in re.split("\n", d[1]) if re.search("licensed? ", x, re.I)), None)
        own = {k for k, w in words.items() if w in d[1]}
        if own:
            assert got[d[0]]["how"] == "own" and got[d[0]]["license"] in own, line
        elif "All rights reserved." not in d[1] and not re.search("licen|rights", d[1], re.I):
            assert got[d[0]]["how"] != "own"


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns, bench = docs.columns, [(b[0], b[1]) for b in table("benchmark", SMOKE)]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SMOKE).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "mix_sources":
            assert docs.columns == columns
        if name == "language_id":
            assert set(after) == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
        elif name == "near_dedup":
            want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before])
            assert set(after) == {d for d, v in want.items() if v[2]}
        elif name == "decontamination":
            assert set(after) == {r["doc_id"] for r in before if not brute.contamination(r["text"], bench)[4]}
        elif name == "personal_data":
            assert set(after) == {r["doc_id"] for r in before}
            for r in before:
                text, spans = r["text"], sorted((s, e, k) for k, s, e in brute.base_spans(r["text"]))
                if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                    for s, e, k in reversed(spans):
                        text = f"{text[:s]}[{k.upper()}]{text[e:]}"
                    assert after[r["doc_id"]]["text"] == text
        else:
            assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in docs.collect()) == brute.mix(
                [(r["doc_id"], r["text"], r["source"]) for r in before]
            )
    got = corpus_pipeline.run(spark, SMOKE)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.select(*got.columns).collect()))
