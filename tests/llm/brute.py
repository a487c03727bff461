"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def shingles(text: str | None) -> set:
    w = space_words(ascii_lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def windows(text: str | None, size: int = 13) -> set[tuple]:
    w = item_words(text)
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def contamination(text: str | None, items: list[tuple[int | None, str | None]]):
    """n_words, n_hit, n_items, digest of item ids, contaminated."""
    w, hit, found = item_words(text), set(), set()
    for item, body in items:
        for gram in windows(body):
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def mix(docs: list[tuple], seed: str = "mix-v1", epochs: int = 3) -> Counter:
    """Multiset of (doc_id, size, source_size, taken); targets by repeated clamping."""
    rows = []
    for doc_id, text, source in docs:
        ident = str(doc_id) if doc_id is not None else hashlib.md5((text or "").encode()).hexdigest()
        digest = hashlib.md5((text or "").encode()).hexdigest()[:16]
        rows.append((hashlib.md5(f"{seed}:{ident}".encode()).hexdigest() + digest, doc_id, len(space_words(text)), source))
    size = defaultdict(int)
    for _, _, n, s in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, clamped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(epochs * size[s] for s in clamped)
        new = {s for s in free if weight[s] * left > epochs * size[s] * sum(weight[x] for x in free)}
        if not new:
            break
        clamped |= new
    share = sum(weight[x] for x in free)
    target = {s: epochs * size[s] if s in clamped else weight[s] * left / share for s in order}
    out, seen = Counter(), defaultdict(int)
    for _, doc_id, n, s in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        wanted = int(target[s] + 0.5)
        taken = 0
        if size[s]:
            taken = wanted // size[s] * n + min(max(wanted % size[s] - seen[s], 0), n)
        seen[s] += n
        out[(doc_id, n, size[s], taken)] += 1
    return out


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def search(docs: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score); ids None rank last."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for i, text in items:
        wanted[i] |= set(terms(text))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in ts if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return out


def collocations(docs: list[tuple], min_count: int = 30, longest: int = 4, top: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in found.items():
            if any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()
            ):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return out
