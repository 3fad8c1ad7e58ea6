"""Spelling variants against all pairs of a small corpus's words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pedon.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 7) for i, t in rows], SCHEMA)


def apart_by_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows, dropped=97):
    counts = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            counts[w if h % dropped else "".join(c for i, c in enumerate(w) if i != h % len(w))] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [o for o in n if apart_by_one(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def corpus(seed, docs, words, letters):
    pick = random.Random(seed)
    known = ["".join(pick.choice(letters) for _ in range(pick.randrange(3, 10))) for _ in range(words)]
    for w in known[: words // 2]:  # variants of some
        i = pick.randrange(len(w))
        known.append(pick.choice([w[:i] + w[i + 1 :], w[:i] + pick.choice(letters) + w[i:], w[:i] + pick.choice(letters) + w[i + 1 :]]))
    return [(i, " ".join(pick.choice([w, w.upper(), w + ","]) for w in (known[int(len(known) * pick.random() ** 3)] for _ in range(60)))) for i in range(docs)]


@pytest.mark.parametrize(("seed", "letters", "dropped"), [(1, "abé", 97), (2, "abcdefghij", 5), (3, "ab×ÿÀàz", 3)])
def test_equals_all_pairs(spark, seed, letters, dropped):
    rows = corpus(seed, 150, 300, letters)
    got = spelling.spelling_variants(table(spark, rows), dropped=dropped).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(rows, dropped)


def test_chains_lead_to_their_last_form(spark):
    rows = [(1, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["abbbbc"] * 96))]
    got = {r.word: r.root for r in spelling.spelling_variants(table(spark, rows), dropped=1 << 40).collect()}
    assert got == dict.fromkeys(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "abbbbc"], "abbbbc")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "Straße STRASSE straßE " * 4), (4, "Straße STRASSE straßE " * 4), (None, "lonely lonely lonely"), (5, "word " * 400_000), (6, "x" * 2_000_000), (7, "中文 ÄÖÜäöü ÄÖÜäöü ÄÖÜäöü İstanbul")]
    got = spelling.spelling_variants(table(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == brute(rows)
    assert spelling.spelling_variants(table(spark, rows).limit(0)).count() == 0


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "some words, andalongerwordthanapiece here; more "
    assert "".join(spelling._pieces(text)) == text
    assert [w for p in spelling._pieces(text) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)
