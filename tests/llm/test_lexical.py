"""Lexical search against brute force, its grid and its edge cases."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from careshed.llm import lexical
from careshed.llm.lexical import Best, Grid, Vocabulary, descend, search

DOCS = "doc_id long, text string, n int, terms string, score string, item_id string"  # with names that the operator uses inside
ITEMS = "item_id long, text string, doc_id long, rank string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=50):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    total, length = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for item, words in asked.items():
        scores = []
        for doc, own in found:
            m = 50 + 50 * len(own) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * own.count(w) // (1000 * own.count(w) + 20 * m)) for w in words & set(own))
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort()
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(scores[:k])]
    return sorted(out, key=str)


def text(rng, n):
    return " ".join(rng.choice(("w%d" % int(rng.expovariate(0.1)), "É%d" % rng.randrange(9), "A-b_c", "the")) for _ in range(n))


def run(spark, docs, items, k=50):
    got = search(spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


EDGE = [(None, "w1 w2 lone"), (None, "w1 w2 lone"), (5, None), (6, ""), (7, " .,-"), (8, "W1 w2"), (8, "w1 W2"), (9, "w3 " * 50_000), (-(2**63), "w1 w2"), (2**63 - 1, "w1 w2")]


@pytest.mark.parametrize("k", [3, 50])
def test_ranking_equals_brute_force(spark, k):
    rng = random.Random(k)
    docs = [(i, text(rng, rng.randrange(1, 60))) for i in range(100, 400)] + EDGE
    docs += [(1000 + i, docs[i][1]) for i in range(0, 80)]  # ties
    items = [(i, text(rng, rng.randrange(1, 12))) for i in range(12)] + [(3, "more w4"), (None, "lone"), (20, None), (21, ""), (22, "nowhere"), (23, "w1")]
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_small_grids_and_blocks_of_items_change_nothing(spark, monkeypatch):
    for name, value in (("WIDTH", 2), ("QUERY_ROWS", 20)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(1)
    docs, items = [(i, text(rng, rng.randrange(1, 40))) for i in range(150)], [(i, text(rng, 8)) for i in range(9)]
    assert run(spark, docs, items, 5) == brute(docs, items, 5)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "w1")]) == [] and run(spark, [(1, "w1")], []) == [] and run(spark, [(1, None)], [(1, "w1")]) == []


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical, "word_hashes", lambda data, starts, ends, lower=True: np.zeros(len(starts), np.uint64))
    known, data = Vocabulary(["ab", "cd", "a"]), np.frombuffer(b"CD a xy ab b", np.uint8)
    starts, ends = np.array([0, 3, 5, 8, 11]), np.array([2, 4, 7, 10, 12])
    assert known.find(data, starts, ends).tolist() == [1, 2, -1, 0, -1]


def test_the_descent_enters_few_ranges():
    rng = np.random.default_rng(2)
    n, rows = 1 << 14, 64
    points = np.unique(rng.integers(0, rows * n, 120_000))
    row, column = points // n, points % n
    impact = rng.integers(200_000, 1_000_000, len(points))
    grid, asked, weight = Grid(row, column, impact), np.arange(8), np.array([9000, 40, 30, 20, 10, 10, 5, 5])
    best = Best(5)
    entered = descend(grid, asked, weight, np.arange(1 << grid.height), np.zeros(1 << grid.height, bool), best)
    scores = np.zeros(n, np.int64)
    for r, w in zip(asked, weight, strict=True):
        scores[column[row == r]] += w * impact[row == r]
    order = np.lexsort((np.arange(n), -scores))[:5]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == scores[order].tolist()
    assert entered < n / 2
