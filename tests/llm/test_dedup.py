"""Exact, line and near deduplication against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from careshed.llm import exact_dedup
from careshed.llm.components import components
from careshed.llm.exact_dedup import DigestIndex, exact_duplicates
from careshed.llm.line_dedup import drop_duplicate_lines, line_counts, line_duplicates
from careshed.llm.minhash import near_duplicates
from careshed.llm.packing import pack, pieces

SPACE = r"[\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, digest string, rep string"  # with names that the operators use inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


EDGE = [(1, "a b c"), (2, "abc"), (3, None), (4, ""), (5, " \n\t"), (None, "ab c "), (6, "other"), (6, "other"), (7, "x" * 100_000)]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0))
    best = {n: (min(g), len(g)) for n, g in groups.items()}
    out = []
    for i, t in rows:
        norm = re.sub(SPACE, "", t or "")
        (_, none, keep), size = best[norm]
        keep = None if none else keep
        out.append((i, keep, size, i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_duplicates(spark):
    assert sorted((tuple(r) for r in exact_duplicates(frame(spark, EDGE)).collect()), key=str) == brute_exact(EDGE)
    assert exact_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("digest", [lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 2)), lambda n: F.lit(b"one")])
def test_colliding_digests_are_told_apart_by_bytes(spark, digest):
    rows = [(i, f"text {i // 3}") for i in range(600)] + EDGE
    got = exact_duplicates(frame(spark, rows), digest)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted((r[:4] for r in brute_exact(rows)), key=str)


def test_the_query_flushes_batches_asks_filters_and_compacts(spark, monkeypatch):
    written, asked = [], []
    write, tested = exact_dedup.Run.write.__func__, exact_dedup.Run.tested
    monkeypatch.setattr(exact_dedup.Run, "write", classmethod(lambda cls, digests: written.append(write(cls, digests)) or written[-1]))
    monkeypatch.setattr(exact_dedup.Run, "tested", lambda run, keyed, name: asked.append(run) or tested(run, keyed, name))
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 7)
    rows = [(i, f"text {i % 250}") for i in range(400)] + EDGE
    got = sorted((tuple(r) for r in exact_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute_exact(rows)
    first, level, last = written[:4], written[4], written[5]
    sizes = [r.digests.count() for r in written]
    assert len(written) == 6 and all(sizes) and all(any(a is r for a in asked) for r in written)
    assert sizes[4] < sum(sizes[:4])  # four runs share digests, which became one row each
    assert level.digests.select("digest").distinct().count() == sizes[4]
    merged = exact_dedup._compacted([level, last])
    assert merged.count() == merged.select("digest").distinct().count() == len({re.sub(SPACE, "", t or "") for _, t in rows})
    # filters held back digests that stand in one run alone
    passed = last.candidates(level.digests)
    assert passed.count() < sizes[4] and len(first) == 4


@pytest.mark.parametrize("limit", [0, 8_192])
def test_compaction_is_the_same_beyond_the_filters_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BITMAPS", limit)
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 11)
    rows = [(i, f"text {i % 90}") for i in range(200)] + EDGE
    assert sorted((tuple(r) for r in exact_duplicates(frame(spark, rows)).collect()), key=str) == brute_exact(rows)


def test_index_merges_batches_and_answers_probes(spark):
    index = DigestIndex().flush(frame(spark, [(5, "a b"), (6, "c")])).flush(frame(spark, [(2, "ab"), (9, "d")]))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in index.members().collect()} == {5: (5, 2), 2: (5, 2), 6: (6, 1), 9: (9, 1)}
    assert [(r.doc_id, r.keep_id) for r in index.probe(frame(spark, [(70, "c "), (71, "new")])).collect()] == [(70, 6)]
    assert DigestIndex().probe(frame(spark, [(70, "c ")])).count() == 0


def test_probes_pass_filters_levels_and_bytes(spark):
    index = DigestIndex(lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 3)))  # twelve bits, so digests collide
    stored = [(100 * b + i, f"text {(7 * i + b) % 90}") for b in range(6) for i in range(40)]
    for b in range(6):
        index.flush(frame(spark, stored[40 * b : 40 * b + 40]))
    runs = index.runs()
    assert [len(level) for level in index.levels] == [2, 1]  # four runs of the first level became one of the second
    new = [(5000 + i, f"text  {i}") for i in range(400)] + [(None, "text 1"), (9000, None)]
    groups = {}
    for i, t in stored:
        groups.setdefault(t, []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in index.probe(frame(spark, new)).collect()}
    norm = {t.replace(" ", ""): g for t, g in groups.items()}
    expected = {i: (min(norm[t.replace(" ", "")], key=lambda d: (-len(dict(stored)[d]), d)), len(norm[t.replace(" ", "")])) for i, t in new if t and t.replace(" ", "") in norm}
    assert got == expected
    keyed = index._keyed(frame(spark, new)).select("doc_id", "digest")
    passed = sum(run.candidates(keyed).count() for run in runs)
    assert 0 < passed < keyed.count() * len(runs)  # filters let hits through and hold others back


def brute_lines(rows, least=6):
    first, near, out = {}, {}, {}
    for d, text in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        for k, line in enumerate(text.split("\n")):
            w = tuple(x for x in re.split(SPACE, line) if x)
            if not w:
                continue
            if w in first:
                out[(d, k)] = first[w]
                continue
            first[w] = (d, k)
            if len(w) >= least:
                keys = [(w, -1)] + [(w[:i] + w[i + 1 :], i) for i in range(len(w))]
                met = [p for v, i in keys for p, j in near.get(v, []) if (i == j and i >= 0) or (i < 0) != (j < 0)]
                if met:
                    out[(d, k)] = min(met)
                for v, i in keys:
                    near.setdefault(v, []).append(((d, k), i))
    return out


def edited(rng, words):
    w, i = list(words), rng.randrange(len(words))
    kind = rng.randrange(4)
    if kind == 0:
        w[i] = rng.choice("abcdefg")
    elif kind == 1:
        del w[i]
    elif kind == 2:
        w.insert(i, rng.choice("abcdefg"))
    return w


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    bases = [[rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 16))] for _ in range(40)]
    rows = [(d, "\n".join(rng.choice([" ", "  ", "\t"]).join(edited(rng, rng.choice(bases))) if rng.random() < 0.9 else " " for _ in range(6))) for d in range(120)]
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_duplicates(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_edge_cases(spark):
    same = "one two three four five six seven"
    rows = [(1, same + "\n\n" + same), (2, "one two three 4 five six seven\nkept"), (3, None), (4, ""), (None, same), (5, "kept"), (5, "kept")]
    counts = {r.doc_id: (r.n_lines, r.dropped_lines) for r in line_counts(frame(spark, rows)).collect()}
    assert counts == {1: (3, [2]), 2: (2, [0]), 3: (0, []), 4: (1, []), 5: (1, [0])}
    texts = {r.doc_id: r.text for r in drop_duplicate_lines(frame(spark, rows[:3])).collect()}
    assert texts == {1: same + "\n", 2: "kept", 3: None}
    assert line_counts(frame(spark, [])).count() == 0


def brute_near(rows):
    sets, root = {}, {}
    for i, t in rows:
        w = [x for x in re.split(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
            n += 1
    chain = [rng.choice(words) for _ in range(200)]  # each step is near the next one, the ends are far apart
    for i in range(30):
        rows.append((n, " ".join(chain)))
        n += 1
        chain[6 * i] = f"new{i}"
    rows += [(n, "Few words"), (n + 1, "few WORDS"), (n + 2, ""), (n + 3, None), (n + 4, " \n"), (n + 5, "Ä b c d"), (n + 6, "ä b c d")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_near_edge_cases(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e\tf"), (2, "A b c d e\tf"), (3, "z " * 30_000)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [("1", 2, 1, True), ("2", 2, 1, False), ("2", 2, 1, False), ("3", 1, 3, True), ("None", 2, None, True)]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_packing_is_an_exact_round_trip(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["the ", "Ärger ", "\n\n", "  x", "123,4 ", "don't ", "日本 ", " ", "😀"]) for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (102, "again"), (102, "again"), (103, "long " * 9000)]
    got = pack(frame(spark, rows).coalesce(1), 64).collect()
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append([*reference.encode(t or "", add_special_tokens=False).ids, 1])
    stream = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in stream])
    assert sorted(ids.tolist()) == sorted(x for v in expected.values() for d in v for x in d)
    place = 0
    for r in stream:  # gapless, and every sequence but the last is full
        assert r.sequence_id * 64 + r.offset == place and len(bytes(r.ids)) == 4 * r.length
        place += r.length
    for i in [r[0] for r in rows if r[0] not in (102,)]:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in mine]).tolist() == expected[i][0]
        assert {r.doc_tokens for r in mine} == {len(expected[i][0])}
    assert pieces(frame(spark, [])).count() == 0


def test_row_ids_tell_repeated_and_missing_ids_apart(spark):
    from careshed.llm.common import with_row_ids

    rows, key = with_row_ids(frame(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e"), (7, "f")]))
    got = {r.text: r[key] for r in rows.collect()}
    assert len(set(got.values())) == 6 and got["a"] == 1 and got["f"] == 7
    assert 2 in (got["b"], got["c"]) and min(got["d"], got["e"], max(got["b"], got["c"])) > 7
    rows, key = with_row_ids(spark.createDataFrame([("x", "a", "k"), ("x", "b", "k")], "doc_id string, text string, __row string"))
    assert key == "__row_" and len({r[key] for r in rows.collect()}) == 2
    assert with_row_ids(frame(spark, []))[0].count() == 0


def test_pipeline_stages_work_on_repeated_and_missing_ids(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, "same text"), (None, "same  text"), (None, "sametext"), (2, "b"), (2, "b"), (None, f"x {item} y"), (3, item), (3, "clean"), (4, long), (None, long + " end"), (None, None), (5, "")])
    kept = corpus_pipeline.exact_dedup(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(re.sub(SPACE, "", r.text or "") for r in kept.collect()) == sorted({re.sub(SPACE, "", r.text or "") for r in docs.collect()})
    assert [(r.doc_id, r.text) for r in kept.where("text LIKE 'same%'").collect()] == [(None, "same  text")]  # the most code points
    near = corpus_pipeline.near_dedup(spark, kept, folder)
    assert [r.doc_id for r in near.where("text LIKE 'w0 %'").collect()] == [4]
    clean = corpus_pipeline.decontaminate(spark, near, folder)
    assert {r.text for r in clean.where("doc_id = 3 OR doc_id IS NULL").collect()} == {"same  text", "clean"} | ({None} if clean.where("text IS NULL").count() else set())


def test_row_ids_at_the_ends_of_long_and_with_clashing_names(spark):
    from careshed.llm.common import with_row_ids

    last = 2**63 - 1
    for ids in ([last - 1, last - 1, 5, None], [last, -last - 1, last, None, None, 7, -last - 1]):
        rows = [(i, f"t{n}", n, "x", 1, 2, 3) for n, i in enumerate(ids)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __odd string, __first int, __ROW int, __own int")
        out, key = with_row_ids(docs)
        got = out.collect()
        assert out.columns == [*docs.columns, key] and key not in docs.columns
        assert len({r[key] for r in got}) == len(ids) and {r[key] for r in got} >= {i for i in ids if i is not None}
        assert sorted((str(r.doc_id), r.text, r["__id"]) for r in got) == sorted((str(i), f"t{n}", n) for n, i in enumerate(ids))


def test_dropping_lines_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one line of some words here\nother", "a"), (2, "one line of some words here", "b")], "doc_id long, text string, __gone string")
    assert sorted((r.doc_id, r.text, r["__gone"]) for r in drop_duplicate_lines(docs).collect()) == [(1, "one line of some words here\nother", "a"), (2, "", "b")]
