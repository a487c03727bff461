"""Packing, ranked search and collocations: messy rows against plain Python versions, solver and trie on their own."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shopfloor.llm import collocations, lexical, packing
from shopfloor.llm.queries import QUERIES

from ..conftest import SMALL, SMOKE
from . import brute

HOSTILE = {"class": 1, "task": 2, "rank": 3, "n": 4, "ws": 5, "item": 6, "slot": 7, "terms": 8, "offset": 9}


def frame(spark, rows):
    """doc_id, text, lang and columns that are named like the operators' own."""
    extra = ", ".join(f"{k} int" for k in HOSTILE)
    return spark.createDataFrame([(*r, *HOSTILE.values()) for r in rows], f"doc_id long, text string, lang string, {extra}")


def messy():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Grüße", "straße", "x1", "ÑU", "a-b", "état", "日本", "zip", "zap", "The"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) + rng.choice(["", ".", "! ok\nnew line", "\tTab, x"]), rng.choice(["en", "de", None, "und"])) for i in range(150)]
    rows += [(900, None, "en"), (901, "", "de"), (902, " \t\n.,;", None), (None, "the of zip zap", "en"), (None, "the of zip zap", "en")]
    rows += [(903, "New York City is far. " * 40, "en")] * 3 + [(904, "zip zap " * 4000, None), (905, "a<|endoftext|>b \x00 control", "en")]
    return rows


def check_packed(got, rows, encode, length):
    docs = defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    want = Counter()
    for d, text, _ in rows:
        ids = [*encode(text or ""), 0]
        want.update({(d, len(ids)): 1})
    for (d, n), copies in want.items():
        pieces = sorted((r["start"], r["length"]) for r in docs[d] if r["doc_tokens"] == n)
        assert sum(size for _, size in pieces) == n * copies
        covered = Counter(p for start, size in pieces for p in range(start, start + size))
        assert set(covered.values()) == {copies} and len(covered) == n
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= length
    assert sorted(places) == list(range(len(places)))


def test_packing_messy_rows(spark):
    rows = messy()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def encode(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    pieces = packing.pack(frame(spark, rows).repartition(5))
    got = pieces.collect()
    check_packed(got, rows, encode, packing.LENGTH)
    by_id = {d: [*encode(t or ""), 0] for d, t, _ in rows}
    for r in got:
        part = by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert len(whole) == len({r["sequence_id"] for r in got})
    for r in got:
        assert whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    for r in whole.values():
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else packing.LENGTH)


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [])).collect() == []


def test_packing_query_round_trip_and_padding(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op11_packing"](spark, SMALL).collect()
    check_packed(got, rows, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, packing.LENGTH)
    used = sum(r["length"] for r in got)
    assert used / (packing.LENGTH * len({r["sequence_id"] for r in got})) > 0.97


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock_meets_the_demand(seed):
    rng = np.random.default_rng(seed)
    edges = packing.class_edges(1024)[:-1]
    size = [40, 300, 2000, 50_000, 3, 1][seed]
    demand = np.bincount(rng.integers(0, len(edges), size), minlength=len(edges))
    present = np.flatnonzero(demand)
    patterns, copies = packing.plan(edges[present], demand[present], 1024)
    assert (copies @ patterns == demand[present]).all() and (patterns @ edges[present] <= 1024).all()
    if size >= 2000:
        assert edges[present] @ demand[present] / 1024 / copies.sum() > 0.97


def test_columns_enter_where_the_greedy_start_wastes():
    # three of 4 fill 12; the greedy start puts 7 + 4 and 6 + 6 together
    sizes, demand = np.array([3, 4, 6, 7]), np.array([600.0, 600.0, 100.0, 100.0])
    _, start = packing.first_basis(sizes, demand, 13)
    _, used = packing.solve(sizes, demand, 13, gap=0)
    assert used.sum() <= start.sum() + 1e-9
    pattern, worth = packing.best_pattern(np.array([3.0, 4.5, 6.0, 7.0]), sizes, 13)
    assert pattern @ sizes <= 13 and worth == pytest.approx(pattern @ np.array([3.0, 4.5, 6.0, 7.0])) and worth == pytest.approx(13.5)


ITEMS = [(1, "The of zip zap"), (2, "the of zip"), (3, "Grüße straße the of"), (4, None), (5, "--"), (1, "état"), (None, "日本 zip zap"), (6, "unseen words"), (7, "zip zap " * 50)]


def test_search_matches_brute_force(spark):
    rows = messy()
    items = spark.createDataFrame([(*i, 1, 2) for i in ITEMS], "item_id long, text string, rank int, term int")
    got = lexical.search(frame(spark, rows).repartition(4), items).collect()
    assert Counter(map(tuple, got)) == Counter(brute.search([(d, t) for d, t, _ in rows], ITEMS))


def test_search_in_many_blocks(spark, monkeypatch):
    rows = messy()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 6)
    monkeypatch.setattr(lexical, "HELD", 50)
    got = lexical.search(frame(spark, rows).repartition(3), items, top=3).collect()
    assert Counter(map(tuple, got)) == Counter(brute.search([(d, t) for d, t, _ in rows], ITEMS, 3))


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(frame(spark, []), items).collect() == []
    assert lexical.search(frame(spark, messy()), items.limit(0)).collect() == []


def test_shared_sets_are_made_once():
    rng = random.Random(5)
    common = list(range(20))
    items = [sorted({*common, *rng.sample(range(20, 80), 10)}) for _ in range(30)] + [[3], [79]]
    graph = lexical.SharedSets(items, 80)
    # the twenty common terms but one (an item of its own asks for it) are one atom
    assert len({graph.atom[t] for t in common if t != 3}) == 1
    assert sum(map(len, items)) > len(graph.flat) + sum(map(len, graph.levels)) and len(graph.levels) >= 1
    value = np.array([rng.randint(1, 99) for _ in range(80)], float)
    got = graph.scores(np.arange(80), np.zeros(80, int), value, 1)[:, 0]
    assert got.tolist() == [value[i].sum() for i in items]


@pytest.mark.parametrize("block, preloaded", [(collocations.BLOCK, collocations.PRELOADED), (400, 6)])
def test_collocations_match_brute_force(spark, monkeypatch, block, preloaded):
    monkeypatch.setattr(collocations, "PRELOADED", preloaded)
    rows = messy()
    got = collocations.collocations(frame(spark, rows).repartition(4), min_count=4, block=block).collect()
    want = brute.collocations([(lang, t) for _, t, lang in rows], 4)
    assert len(want) > 50 and Counter(map(tuple, got)) == Counter(want)


def test_collocations_keep_the_first(spark):
    rows = messy()
    got = collocations.collocations(frame(spark, rows), min_count=3, longest=3, top=7).collect()
    assert Counter(map(tuple, got)) == Counter(brute.collocations([(lang, t) for _, t, lang in rows], 3, 3, 7))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, "rare words only", "en"), (2, None, None)])).collect() == []


def test_collocations_query_matches_brute_force(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op13_collocations"](spark, SMOKE).collect())) == Counter(brute.collocations(rows))


def test_trie_finds_every_phrase():
    rng = np.random.default_rng(2)
    phrases = np.unique(rng.integers(1, 60, (3000, 3)), axis=0)
    trie = collocations.Trie(phrases, 60)
    text = rng.integers(0, 61, 20_000).astype(np.int32)
    known = {tuple(p): k for k, p in enumerate(phrases.tolist())}
    want = [known.get(tuple(text[i : i + 3].tolist()), -1) for i in range(len(text) - 2)]
    assert trie.states(text).tolist() == want
