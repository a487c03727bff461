"""Language id, quality, chat formatting, top-k search, token ledger and license scan on small messy tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopfloor.llm import chat, langid, licenses, quality, tokens, topk

from . import brute

RNG = random.Random(3)
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, quality int, held_out string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 0, 0.5, 9, "clash") for d, t, lang in rows], DOC)


SAID = {
    "aa": "the house and the garden with an old tree near the river bank",
    "bb": "der garten und das haus mit einem alten baum am ufer des flusses",
    "cc": "ничего нового под солнцем и луной над рекой",
}


def sentence(lang):
    w = SAID[lang].split()
    return " ".join(RNG.choice(w) for _ in range(12))


def test_languages_are_learned_and_odd_texts_are_undetermined(spark):
    rows = [(i, sentence(lang), lang) for i, lang in enumerate(list(SAID) * 40)]
    odd = [(500, None, "aa"), (501, "", "aa"), (502, " \n 123 !! ½ ²", "bb"), (None, sentence("bb"), "aa"), (503, sentence("aa"), None), (504, sentence("cc") * 4000, None), (0, sentence("bb"), "bb")]
    got = langid.identify(docs_of(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows if i)
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (500, 501, 502))
    assert by[None]["lang_pred"] == "bb" and not by[None]["held_out"] and by[503]["lang_pred"] == "aa" and by[504]["lang_pred"] == "cc"
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    kept = langid.keep_identified(docs_of(spark, rows + odd))
    assert kept.schema == docs_of(spark, []).schema
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} | {None, 503, 504}


def test_languages_without_training_rows(spark):
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs_of(spark, [(1, "text", None)])).collect()} == {("und", 0.0)}
    assert langid.identify(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("size", [7, 64])
def test_slices_give_the_grams_of_the_whole_text(size, monkeypatch):
    text = "Ab, c 1 2  défg!? hij  \n\n k" * 9
    whole = Counter(np.concatenate(list(langid.gram_buckets(text))).tolist())
    monkeypatch.setattr(langid, "SLICE", size)
    assert Counter(np.concatenate(list(langid.gram_buckets(text))).tolist()) == whole


def test_quality_separates_junk_and_scores_everything(spark):
    good = [(i, ". ".join(sentence("aa") for _ in range(6)), "aa") for i in range(150)]
    junk = [(1000 + i, "BUY!!! " * 30 + str(i), "aa") for i in range(150)]
    odd = [(2000, None, None), (2001, "", None), (None, "x", None), (2002, "a" * 200_000, None), (5, "twice", None)]
    labels = spark.createDataFrame(
        [(d, 1, 0, "clash") for d, _, _ in good] + [(d, 0, 0, "clash") for d, _, _ in junk] + [(None, 1, 0, ""), (3, None, 0, ""), (99999, 1, 0, "")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = quality.score_quality(docs_of(spark, good + junk + odd), labels).collect()
    assert len(got) == len(good + junk + odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[d] == 1 for d, _, _ in good if d != 5) and all(by[d] == 0 for d, _, _ in junk)
    none = quality.score_quality(docs_of(spark, odd), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(docs_of(spark, []), labels).count() == 0
    assert len(quality.statistics("")) == quality.FEATURES


def test_tree_walk_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, quality.FEATURES))
    model = quality.fit(x, (x[:, 0] + x[:, 3] ** 2 > 0.7).astype(float))

    def walk(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while model.left[t, node] != node:
                node = model.left[t, node] if row[model.feature[t, node]] <= model.limit[t, node] else model.right[t, node]
            total += model.value[t, node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((model.score(x) >= 0.5) == (x[:, 0] + x[:, 3] ** 2 > 0.7)).mean() > 0.95


NASTY = ["", "\\", "\\\\n", "<|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>", "<|>", "\n\n", "é😀‍", "<\\|", "[\\INST]", "|>"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "x\ny"]), st.one_of(st.sampled_from(NASTY), st.text(alphabet="<|>\\[/]INSTs \né", max_size=12))), max_size=6))
@settings(max_examples=300, deadline=None)
def test_rendering_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_loss_mask_by_binary_search():
    spans = np.array([[3, 6], [8, 8], [10, 12]])
    offsets = np.array([[0, 2], [2, 4], [4, 6], [6, 10], [10, 11], [11, 13], [13, 14]])
    assert chat.loss_mask(spans, offsets).tolist() == [False, True, True, False, True, True, False]
    assert not chat.loss_mask(spans[:0], offsets).any()


def test_conversations_round_trip(spark):
    rows = [(i, j, r, t) for i, t in enumerate(NASTY) for j, r in enumerate(["user", "assistant", "assistant"])]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (51, 5, "assistant", "late"), (51, 2, "user", "early"), (51, 2, "user", "early"), (None, 0, "assistant", "no id"), (52, None, "user", "no turn"), (52, 0, "assistant", "word " * 20000)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), brute.sha(learned))
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
        assert got[c]["formatted_chars"] == len(chat.render([(r, t) for _, r, t in turns])[0])
    assert chat.format_conversations(frame.limit(0)).count() == 0


def best(rows, every, k):
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in vectors:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = set()
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


def test_top_k_matches_brute_force(spark):
    rows = [(i, [RNG.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(200)]  # a hot vector: ties are broken by id
    rows += [(600, None), (610, []), (620, [None] * 6), (630, [float("nan")] * 6), (640, [float("inf")] * 6), (None, [1.0] * 6), (650, [0.1] * 3), (660, [0.2] * 3), (670, [9.0]), (20, [0.3] * 6), (21, [0.9] * 6), (21, [0.9] * 6)]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int, v int").repartition(5)
    got = topk.top_k(frame, every=10, k=5, block=16).collect()
    assert Counter(map(tuple, got)) == Counter(best(rows, 10, 5))
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.filter("vec_id = 650"), every=10).count() == 0


def test_ledger_batches_are_additive_and_idempotent(spark, tmp_path):
    data = [(i, f"word {i} " * (i % 7 + 1), f"l{i % 2}") for i in range(40)] + [(100, None, None), (None, "no id", "l0"), (3, "again", "l1")]
    docs = docs_of(spark, data)
    ledger = tokens.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.batches() == [] and ledger.totals().count() == 0
    assert ledger.insert("a", tokens.count_tokens(docs, tokens.BYTE_BPE))
    assert not ledger.insert("a", tokens.count_tokens(docs, tokens.BYTE_BPE))
    gone = spark.createDataFrame([(i,) for i in (3, 4, 4, 77)], "doc_id long")
    assert ledger.remove("b", gone) and not ledger.remove("b", gone)
    changed = docs_of(spark, [(5, "brand new text", "l1"), (6, "x", "l0")])
    assert ledger.revise("c", tokens.count_tokens(changed, tokens.MULTI_BPE))
    assert ledger.insert("d", tokens.count_tokens(docs.limit(0), tokens.BYTE_BPE)) and ledger.batches() == ["a", "b", "c", "d"]

    def coded(version, text):
        with open(f"{tokens.TOKENIZERS}/{version}.tiktoken", "rb") as f:
            return len(tokens._encoding(version, f.read()).encode_ordinary(text or ""))

    want = Counter()
    for i, t, lang in [r for r in data if r[0] not in (3, 4, 5, 6)]:
        for m, v in zip(tokens.MEASURES, (1, coded(tokens.BYTE_BPE, t), len(t or "")), strict=True):
            want[(lang, tokens.BYTE_BPE, m)] += v
    for _, t, lang in [(5, "brand new text", "l1"), (6, "x", "l0")]:
        for m, v in zip(tokens.MEASURES, (1, coded(tokens.MULTI_BPE, t), len(t)), strict=True):
            want[(lang, tokens.MULTI_BPE, m)] += v
    got = Counter({(r["lang"], r["version"], m): r[m] for r in ledger.totals().collect() for m in tokens.MEASURES})
    assert got == want


def test_an_unfinished_batch_is_not_counted_and_is_replaced(spark, tmp_path):
    docs = docs_of(spark, [(1, "one two", "x")])
    ledger = tokens.Ledger(spark, str(tmp_path / "ledger"))
    tokens.count_tokens(docs, tokens.BYTE_BPE).write.parquet(str(tmp_path / "ledger/entries/a"))  # died before its sums
    assert ledger.totals().count() == 0
    assert ledger.insert("a", tokens.count_tokens(docs, tokens.BYTE_BPE)) and ledger.totals().first()["n_docs"] == 1


def test_licenses_own_and_inherited(spark):
    mit, apache, gpl = (licenses.TEMPLATES[k][0] for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    body = "some words that are not a notice at all and go on for quite a while here\n" * 5
    files = [
        ("a/LICENSE", mit), ("a/b/c.txt", body), ("a/b/d.txt", f"{body}\n{apache}\n{body}"), ("a/b/e/COPYING", gpl), ("a/b/e/f/g.txt", body),
        ("top.txt", body), ("z/y.txt", None), ("z/empty", ""), (None, mit), (None, body), ("a/x!", "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!"),
        ("a/b/c.txt", body), ("q/talk.txt", body + "\nwe asked permission to enter the building yesterday morning"), ("ab/c", body),
    ]
    frame = spark.createDataFrame([(p, t, "clash", "clash") for p, t in files], "path string, text string, license string, term string")
    got = Counter((r["path"], r["license"], r["how"]) for r in licenses.scan(frame).collect())
    want = {
        "a/LICENSE": ("MIT", "own"), "a/b/c.txt": ("MIT", "inherited"), "a/b/d.txt": ("Apache-2.0", "own"), "a/b/e/COPYING": ("GPL-3.0", "own"),
        "a/b/e/f/g.txt": ("GPL-3.0", "inherited"), "a/x!": ("MIT", "own"),
    }
    assert got == Counter(
        (p, *(want.get(p, (None, None)) if p is not None else (("MIT", "own") if t == mit else (None, None)))) for p, t in files
    )
    assert licenses.scan(frame.limit(0)).count() == 0


def test_notice_cosine_matches_a_plain_sum(spark):
    notices = ["licensed under the apache license version 2 0", "released under the mit license today", "copyright notice of another kind"]
    got = {r["notice"]: (r["license"], r["cosine"]) for r in licenses.score_notices(spark.createDataFrame([(n,) for n in notices], "notice string")).collect()}
    df = Counter(t for n in notices for t in set(n.split()))
    idf = lambda t: math.log((1 + len(notices)) / (1 + df[t])) + 1

    def weights(terms):
        w = {t: c * idf(t) for t, c in Counter(terms).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    for n in notices:
        a = weights(n.split())
        scores = {}
        for k, variants in licenses.TEMPLATES.items():
            for v in variants:
                b = weights(licenses._plain(v))
                scores[k] = max(scores.get(k, 0), sum(x * b.get(t, 0) for t, x in a.items()))
        top, cosine = min(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))
        if cosine >= licenses.MIN_COSINE:
            assert got[n][0] == top and abs(got[n][1] - cosine) < 1e-6
        else:
            assert n not in got


GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD_TEXT = """Copyright (c) 2021, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_THIRD = """
* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""


def test_wrapped_headers_and_license_texts(spark):
    def commented(text, mark):
        return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))

    code = "\nimport os\n" + "value = compute(value, other)\n" * 20
    files = {
        "p/LICENSE": ("MIT", licenses.TEMPLATES["MIT"][0]),
        "p/gpl2.py": ("GPL-2.0", commented(GPL_HEADER.format(2), "#") + code),
        "p/gpl3.c": ("GPL-3.0", "/*\n" + commented("Copyright (C) 2020 Some Body. All rights reserved.\n\n" + GPL_HEADER.format(3), " *") + "\n */" + code),
        "p/plain.c": ("GPL-3.0", "/* " + GPL_HEADER.format(3) + "*/" + code),
        "p/lesser.js": ("LGPL-3.0", commented(GPL_HEADER.format(3).replace("GNU General", "GNU Lesser General"), "//") + code),
        "p/affero.js": ("AGPL-3.0", commented(GPL_HEADER.format(3).replace("GNU General", "GNU Affero General"), "//") + code),
        "p/bsd2.h": ("BSD-2-Clause", commented(BSD_TEXT.format(""), "//") + code),
        "two/LICENSE.txt": ("BSD-2-Clause", BSD_TEXT.format("")),
        "three/COPYING": ("BSD-3-Clause", BSD_TEXT.format(BSD_THIRD)),
        "p/closed.c": ("Proprietary", "// Copyright (c) 2020 Some Body.\n// All rights reserved." + code),
    }
    frame = spark.createDataFrame([(p, t) for p, (_, t) in files.items()] + [("three/x.py", code)], "path string, text string")
    got = {r["path"]: (r["license"], r["how"]) for r in licenses.scan(frame).collect()}
    assert got == {**{p: (k, "own") for p, (k, _) in files.items()}, "three/x.py": ("BSD-3-Clause", "inherited")}


def test_quality_sample_is_the_lowest_hashes(spark):
    """The sample found by slot counts is the one a whole sort gives, with counts and ties."""
    data = [(int(o) * 2**50, i % 7, 1 + i % 3) for i, o in enumerate([-4000, -5, -5, -5, 0, 0, 3, 3, 9, 4000] * 3)]
    df = spark.createDataFrame(data, "o long, k int, n long")
    whole = sorted((o, k) for o, k, n in data for _ in range(n))
    for rows in (1, 5, 17, 1000):
        assert sorted((r["o"], r["k"]) for r in quality._lowest(df, ["k"], rows).collect()) == whole[:rows]
    assert quality._lowest(df.limit(0), ["k"], 5).collect() == []


def test_controls_that_overlap_are_parted(spark):
    for text in ("<|>", "<|>|><|", "\\<|>\\", "a<|im_start|>b", "<<SYS>><</SYS>></s><s>[/INST]"):
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not [c for c in chat.CONTROLS if c in escaped]


def test_quality_sample_is_bounded_after_the_join(spark, monkeypatch):
    """One labelled id on many document rows: equal rows count once, different ones up to the bound."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    free = spark.range(50).filter(quality.fold("id", quality.FOLDS) != quality.HELD_OUT).first()[0]
    labels = spark.createDataFrame([(free, 1), (free, 1)], "doc_id long, quality int")
    same = spark.createDataFrame([(free, "the same text")] * 40, "doc_id long, text string")
    other = spark.createDataFrame([(free, "word " * (i + 1)) for i in range(40)], "doc_id long, text string")
    quality.train(same, labels, rows=10)
    quality.train(other, labels, rows=10)
    assert seen == [2, 10]
