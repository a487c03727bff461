"""Near-duplicates, decontamination, personal data and mixing against brute force, with messy rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopfloor.llm import components, decontaminate, mixing, neardup, pii

from . import brute

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, k string, rep long, h string, pos int, "
    "_id long, component long, size long, spans string, `end` int"
)
RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)]


def text(n: int) -> str:
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def near(base: str, changes: int) -> str:
    w = base.split()
    for i in RNG.sample(range(len(w)), changes):
        w[i] = f"x{RNG.random()}"
    return " ".join(w)


def rows(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", 0, "clash", 1, "clash", 2, 3, 4, 5, "clash", 6) for i, t in enumerate(texts)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


BASE = [text(200), text(80), text(1000), text(30)]
TEXTS = (
    [None, "", " \t\n", "one", "ONE", "two words", "Two Words", "a b c d e", "a b c d e f"]
    + BASE + [BASE[0], BASE[0].upper(), near(BASE[0], 1), near(BASE[0], 2), near(BASE[0], 12), near(BASE[1], 1), near(BASE[2], 9)]
    + [near(BASE[2], 10 + i % 3) for i in range(12)]
    + [text(20000), "É" * 10, "é" * 10, "word" * 50000, "\x1c sep arate   x"]
)


def test_near_duplicates_match_brute_force(spark):
    docs = frame(spark, rows(TEXTS) + [(None, BASE[0], None, None, 0, None, None, None, None, None, None, None, None, None)] * 2)
    want = brute.near_duplicates([(r[0], r[1]) for r in rows(TEXTS)])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] and r["n_shingles"] == want[9][0]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


def test_near_duplicates_settle_buckets_beyond_the_first_hubs(spark):
    """Groups that share half their words collide in buckets but are linked only inside each group."""
    common = text(300)
    data = []
    for _ in range(8):
        base = common + " " + text(120)
        data += [base, near(base, 2), near(base, 3)]
    RNG.shuffle(data)
    want = brute.near_duplicates(list(enumerate(data)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, rows(data))).collect()}
    assert got == want


def test_near_duplicates_of_repeated_and_no_rows(spark):
    twice = frame(spark, rows([BASE[0]]) * 2)
    assert [tuple(r) for r in neardup.near_duplicates(twice).collect()] == [(0, brute.near_duplicates([(0, BASE[0])])[0][0], 0, True)] * 2
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    kept = neardup.drop_near_duplicates(frame(spark, rows(TEXTS)))
    assert kept.schema == frame(spark, []).schema
    assert {r["doc_id"] for r in kept.collect()} == {d for d, v in brute.near_duplicates([(r[0], r[1]) for r in rows(TEXTS)]).items() if v[2]}


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(7, i) for i in range(200, 260)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain + hub + hub, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(200, 260)}}


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while seven wizards watch quietly from a hill"),
    (2, "short item here"), (3, None), (4, "!!!"), (None, "nameless item without any id"), (2, "short item here"),
    (5, "Über größe straße"), (10, "the quick brown fox jumps over the lazy dog while seven wizards watch"),
]
CONTAMINATED = [
    None, "", "...", "nothing of note", "A SHORT-ITEM, here!", "x " * 400 + "short item here",
    "so the Quick brown fox jumps over the lazy dog while seven wizards watch quietly from a hill and more",
    "the quick brown fox jumps over the lazy dog while seven wizards", "nameless item without any id",
    "über größe straße", "Über größe straße short item here short item here", "short item " * 50 + "here",
    "the quick brown fox jumps over the lazy dog while seven wizards watch " * 30, "z " * 30000 + ITEMS[0][1],
]


def test_contamination_matches_brute_force(spark):
    bench = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, ws string")
    data = rows(CONTAMINATED) + rows(CONTAMINATED[-3:-2], start=50) * 2 + [(None, *r[1:]) for r in rows(["short item here"])]
    got = decontaminate.contamination(frame(spark, data), bench)
    fields = ["n_words", "n_hit", "n_items"]
    have = Counter((r["doc_id"], *(r[f] for f in fields), brute.sha(",".join(r["items"])), r["contaminated"]) for r in got.collect())
    assert have == Counter((r[0], *brute.contamination(r[1], ITEMS)) for r in data)


def test_contamination_beyond_the_broadcast_bound(spark, monkeypatch):
    """The shuffle join gives the same rows and carries no document's words."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, ws string")
    data = rows(CONTAMINATED) + [(None, *r[1:]) for r in rows(["short item here"])] * 2
    got = decontaminate.contamination(frame(spark, data), bench)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and not any("ws#" in x for x in joins)
    have = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], brute.sha(",".join(r["items"])), r["contaminated"]) for r in got.collect())
    assert have == Counter((r[0], *brute.contamination(r[1], ITEMS)) for r in data)


def test_decontaminated_documents_and_spans(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    data = rows(CONTAMINATED)
    kept = decontaminate.drop_contaminated(frame(spark, data), bench)
    assert kept.schema == frame(spark, []).schema
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in data if not brute.contamination(r[1], ITEMS)[4]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(frame(spark, data), bench).collect()}
    assert cut[3] == data[3][1] and cut[4] == "A " and cut[0] is None and cut[6].split() == "so and more".split()
    assert all(brute.contamination(cut[i], ITEMS)[1] == 0 for i in (4, 5, 6, 8, 9))


def test_contamination_without_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows(CONTAMINATED)), none).collect()
    assert len(got) == len(CONTAMINATED) and not any(r["n_hit"] or r["contaminated"] for r in got)
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


CARD = "4539578763621486"  # passes Luhn
PRIVATE = [
    None, "", "nothing", "mail a.b+c@ex-ample.co.uk, or x@y", "a@b.c_d@e.f g@h.i@j.k", "@@ a@b. @c.d %@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 255.255.255.255 0001.2.3.000255 1.2.3", f"card {CARD} and 4539 5787-6362 1486x, {CARD}0 1234567890123456",
    "+1 (487) 555-7209 +1234567 +123 456 78 +12345678901234567890 ++12345678+", "é😀 a@b.co 😀 10.0.0.1", "7" * 5000,
    "1 " * 3000, "a" * 60000 + "@b.c", "+1" * 2000, "a@b.c" * 500, f"{CARD} " * 300, "5." * 4000,
]


@pytest.mark.parametrize("copies", [1, 2])
def test_base_spans_match_brute_force(spark, copies):
    data = rows(PRIVATE) * copies + [(None, *r[1:]) for r in rows(["x a@b.co"])]
    got = pii.scan(frame(spark, data)).collect()
    assert len(got) == len(data)
    text_of = {r[0]: r[1] for r in data}
    for r in got:
        spans = brute.base_spans(text_of[r["doc_id"]])
        kinds = Counter(k for k, _, _ in spans)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in brute.PII), r["doc_id"]
        assert r["base_sha256"] == brute.sha(joined)
        assert set(filter(None, joined.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    seeds = [f"please call me at +1 (487) 555-72{i:02d} today" for i in range(8)]
    unseen = ["please call me at 555-0199 today", "the part number 555-0133 is sold out"]
    got = {r["doc_id"]: r["spans"] for r in pii.scan(frame(spark, rows(seeds + unseen))).collect()}
    assert got[8] == "phone:18:26" and got[9] == ""
    cut = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows(seeds + unseen + [None]))).collect()}
    assert cut[0] == "please call me at [PHONE] today" and cut[8] == cut[0] and cut[9] == unseen[1] and cut[10] is None


def test_found_identifiers_open_patterns(spark):
    """Three hops: base phones, numbers found beside them, and numbers found only in contexts of found ones."""
    base = [f"please call me at +1 (487) 555-72{i:02d} today" for i in range(30)]
    first = [f"please call me at 555-01{i:02d} today" for i in range(4)]
    second = [f"her desk line reads 555-01{i:02d} always" for i in range(4)] + ["her desk line reads 555-0777 always"] * 2
    third = [f"the gate code says {n} twice" for n in ("555-0777", "555-0100", "555-0101", "555-0888")]
    loose = ["the part number 555-0133 is sold out", "her desk line was 555-0999"]
    data = base + first + second + third + loose
    got = {r["doc_id"]: r["spans"] for r in pii.scan(frame(spark, rows(data))).collect()}
    at = len(base)
    assert all(got[at + i] == "phone:18:26" for i in range(4))
    # 4 of 5 numbers behind "line reads" are found ones: their share of 0.8 rises in the rounds
    assert all(got[at + 4 + i] == "phone:20:28" for i in range(6))
    assert all(got[at + 10 + i] == "phone:19:27" for i in range(4))
    assert got[at + 14] == got[at + 15] == ""


def test_contexts_find_identifiers_written_in_groups(spark):
    def card(i):  # the last digit makes the number pass Luhn
        stem = f"453957876362{i:03d}"
        return next(stem + str(d) for d in range(10) if brute.luhn(stem + str(d)))

    seeds = [f"please call me at +1 (487) 555-72{i:02d} today" for i in range(4)] + [f"she paid with card {card(i)} yesterday" for i in range(4)]
    wrong = "4539 5787 6362 1487"
    assert not brute.luhn(wrong.replace(" ", ""))
    unseen = [
        "please call me at (487) 555-7209 today", "please call me at 487 555 7209 today", f"she paid with card {wrong} yesterday",
        "on 12 may please call me at (487) 555-7209 today", "the part (487) 555-7209 is sold out",
        "call me at +1 (487) 555-7203, please call me at 555-0199 today",
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.scan(frame(spark, rows(seeds + unseen))).collect()}
    assert [got[8 + i] for i in range(6)] == [
        "phone:18:32", "phone:18:30", "card:19:38", "phone:28:42", "", "phone:11:28,phone:48:56",
    ]
    # the words before a match are those of the text, also across another match of its kind
    near = [f"call +1 (487) 555-72{i:02d}/+1 (487) 555-73{i:02d} now" for i in range(4)]
    found = pii._context(pii._all_matches(frame(spark, rows(near)))).filter("kind = 'phone'").collect()
    assert len(found) == 8 and {tuple(r["patterns"]) for r in found} == {("call _ now",)}


def test_redaction_joins_overlapping_spans(spark):
    said = f"é +{CARD[:15]} x {CARD}, a@1.2.3.4 b@c.d"
    docs = frame(spark, rows([said, "clean"]))
    cut = pii.redact(docs)
    assert cut.schema == docs.schema
    assert {r["text"] for r in cut.collect()} == {"é [PHONE] x [CARD], [EMAIL] [EMAIL]", "clean"}
    assert pii.scan(frame(spark, [])).count() == 0 and pii.redact(frame(spark, [])).count() == 0


def test_mix_splits_a_hot_id_and_a_hot_row(spark, monkeypatch):
    """One id with many texts, and one row many times: the edge of the fill is cut down to a few rows all the same."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", 8)
    steps = []
    first = mixing.maybe_broadcast
    monkeypatch.setattr(mixing, "maybe_broadcast", lambda df: steps.append(df) or first(df))
    for digits, hot in ((34, [(7, f"w {i} " * (i % 5 + 1), "s0") for i in range(120)]), (50, [(7, "a b c", "s0")] * 120)):
        steps.clear()
        data = hot + [(i, "x y z", f"s{i % 3}") for i in range(20, 50)]
        docs = frame(spark, [(d, t, None, s, 0, "c", 1, "c", 2, 3, 4, 5, "c", 6) for d, t, s in data])
        got = mixing.mix(docs).collect()
        assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == brute.mix(data)
        edge = next(r["edge"] for r in steps[-1].collect() if r["source_key"] == "s0")
        assert len(edge) >= digits and mixing.sized_documents(docs).filter(F.col("h").startswith(edge)).count() <= 8


def test_mix_matches_brute_force(spark):
    data = [(i, text(RNG.choice([0, 1, 5, 40])), f"s{RNG.choice([0, 0, 0, 0, 1, 2, 3, 4])}") for i in range(400)]
    data += [(1000, None, "s0"), (1001, "x y", None), (None, "n n", "s1"), (None, "n n", "s1"), (1002, "only", "tiny"), (7, "again", "s2"), (1003, "", "empty")]
    docs = frame(spark, [(d, t, None, s, 0, "c", 1, "c", 2, 3, 4, 5, "c", 6) for d, t, s in data])
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == brute.mix(data)
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 0.5 for t, n in per.values())
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(frame(spark, rows([None, "", " "]))).collect()} == {0}
