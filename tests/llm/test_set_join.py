"""The exact Jaccard join against brute force, its list walk and its derived overlaps."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from careshed.llm import set_join
from careshed.llm.set_join import derived_link, jaccard_components, list_pairs, prefix_length

DOCS = "doc_id long, text string, id long, token string, component long, n long"  # with names that the operator uses inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=80):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if rows[i][0] == rows[j][0] or (n and 100 * n >= percent * len(sets[i] | sets[j])):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i)) if doc is not None else None) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage, rows = [word() for _ in range(60)], []
    for _ in range(n):
        if rows and rng.random() < 0.75:  # chains of copies with edits, some just below and some just above the bound
            text = rng.choice(rows).split(" ")
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = word()
            text = text[rng.randrange(3) :] + [word() for _ in range(rng.randrange(4))]
        else:
            text = [word() for _ in range(rng.randrange(1, 120))]
            if rng.random() < 0.5:
                text[rng.randrange(len(text)) :] = passage
        rows.append(" ".join(text))
    ids = list(range(-5, n - 5))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


EDGE = [(1, "A b c"), (2, "a  B\tc "), (3, None), (4, ""), (5, " \n"), (None, "a b c"), (6, "six words are in this text"), (6, "six words are in this text"), (7, "x " * 30_000), (9_223_372_036_854_775_807, "SIX words are in this text")]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed) + EDGE
    rows = [r for r in rows if r[0] not in (1, 2, 3, 4, 5, 6, 7)] + EDGE if seed else rows[: -len(EDGE)]
    assert sorted((tuple(r) for r in jaccard_components(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_lists_dealt_as_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(set_join, "LIST", 2)
    monkeypatch.setattr(set_join, "BLOCK", 2)
    rows = corpus(7, 80)
    assert sorted((tuple(r) for r in jaccard_components(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    got = jaccard_components(frame(spark, []))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == 0


def test_links_of_followers_alone_are_found(spark):
    """Two leaders are not linked, a follower of each is: the answer comes from the deltas."""
    base = [f"w{i}" for i in range(100)]

    def text(lo, hi):
        return " ".join(base[lo:hi])

    rows = [(1, text(0, 60)), (2, text(10, 70)), (3, text(4, 63)), (4, text(8, 66))]
    assert sorted(tuple(r) for r in jaccard_components(frame(spark, rows)).collect()) == brute(rows)


def test_list_walk_finds_all_that_the_bounds_allow():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        lo = rng.integers(5, 40, n)
        hi, rest = lo + rng.integers(0, 6, n), np.maximum(1, lo - rng.integers(0, 12, n))
        comp, rep = rng.integers(0, 4, n), np.arange(n)
        order = np.lexsort((-rest, lo))
        rows = [x[order] for x in (rep, comp, lo, hi, rest)]
        rep, comp, lo, hi, rest = rows
        want = set()
        for p in range(n):
            for q in range(p):
                need = -(-80 * (lo[p] + lo[q]) // 180)
                if comp[p] != comp[q] and 100 * hi[q] >= 80 * lo[p] and min(rest[p], rest[q]) >= need:
                    want.add((min(int(rep[p]), int(rep[q])), max(int(rep[p]), int(rep[q]))))
        assert list_pairs(*rows, 80) == want


def test_derived_overlaps_equal_counted_ones(monkeypatch):
    monkeypatch.setattr(set_join, "COLUMNS", 7)
    rng = random.Random(5)
    draw = lambda lo, hi, n: set(rng.sample(range(lo, hi), n))
    array = lambda s: np.array(sorted(s), np.uint64)
    seen = set()
    for _ in range(200):
        a, b = draw(0, 60, 40), draw(5, 65, 40)
        sides = [[(lead - draw(0, 65, rng.randrange(9))) | draw(0, 65, rng.randrange(9)) for _ in range(3)] for lead in (a, b)]
        left, right = ([(array(m - lead), array(lead - m)) for m in side] for lead, side in zip((a, b), sides, strict=True))
        want = any(100 * len(x & y) >= 60 * len(x | y) for x in sides[0] for y in sides[1])
        assert derived_link(array(a), array(b), left, right, 60) == want
        seen.add(want)
    assert seen == {True, False}


def test_prefix_length():
    for n in range(1, 300):
        need = min(x for x in range(n + 1) if 100 * x >= 80 * n)
        assert prefix_length(n, 80) == n - need + 1
