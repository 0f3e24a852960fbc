"""Classifiers, scans, scores and extraction against brute force, held-out rows, and their edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from careshed.llm import html_text, language, licenses, quality
from careshed.llm.decontaminate import clean, overlaps
from careshed.llm.lm_score import lm_scores
from careshed.llm.tokens import encoder
from careshed.llm.words import row_shingles

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, seed string, bucket string"  # with names that the operators use inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y") for i, t, lang in (r if len(r) == 3 else (*r, None) for r in rows)], DOCS)


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_quality_on_held_out_documents(spark):
    labels = read(spark, "labels")
    got = {r.doc_id: r for r in quality.quality(read(spark, "documents"), labels).collect()}
    assert len(got) == 1000
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    known = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in known]) > 0.95


def test_quality_edge_cases(spark):
    rows = frame(spark, [(1, "good words here"), (2, None), (3, ""), (None, "x"), (1, "good words here"), (4, "w " * 50_000)])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(rows, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = quality.quality(rows, labels.where("false")).collect()
    assert len(none) == 6
    assert quality.quality(rows.where("false"), labels).count() == 0
    assert quality.keep_good(rows, labels.where("false")).columns == rows.columns


def test_folded_scores_are_the_softmax_of_the_mean_vector():
    rng = np.random.default_rng(0)
    texts = pa.array(["some words some words", "!! JUNK !! junk", "a", ""])
    m = quality.Model(rng.normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32), rng.normal(size=(2, quality.WIDTH)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    got = quality._judge(m)(texts)
    for s, (b, share) in zip(got, quality._bags(texts), strict=True):
        z = m.weights @ (share @ m.vectors[b]) + m.bias
        assert s == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-5)


def test_language_on_held_out_documents(spark):
    docs = read(spark, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.languages(docs).collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.97


def test_language_edge_cases(spark):
    rows = [(0, "aa bb aa", "x"), (1, "zz yy zz", "z"), (2, "zz yy", None), (3, None, "x"), (4, "12 34 !", "x"), (5, "", None), (None, "aa bb", "x"), (6, "日本語 日本語", None), (0, "aa bb aa", "x")]
    got = language.languages(frame(spark, rows)).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert len(got) == 9 and und == {3, 4, 5}
    assert {r.lang_pred for r in got if r.doc_id == 2} <= {"x", "z"}
    nothing = language.languages(frame(spark, [(1, "abc", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language.languages(frame(spark, [])).count() == 0


def test_grams_bind_rotated_letters():
    letters = language.Letters(64, 3)
    sums, found = letters.bundles(["ab", "ab ab", "1"], np.array([0, 1, 2]), 3)
    a, b = letters.vector(ord("a")).astype(int), letters.vector(ord("b")).astype(int)
    edge = letters.vector(0).astype(int)
    expected = np.roll(edge, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * edge
    across = np.roll(b, 2) * np.roll(edge, 1) * a
    assert (sums[0] == expected).all() and found.tolist() == [2, 5, 0]
    assert (sums[1] == 2 * expected + across).all() and not sums[2].any()


def brute_language(rows, width=language.WIDTH, gram=language.GRAM):
    """Predictions by letters and n-grams one at a time."""
    letters = language.Letters(width, gram)

    def bundle(text):
        out, n = np.zeros(width), 0
        flat = re.sub(r"[^a-zäöüßéèêçàâîôûïëñ]+", " ", f" {(text or '').lower()} ")
        for k in range(len(flat) - gram + 1):
            g = flat[k : k + gram]
            if g.strip():
                v = np.ones(width)
                for j, c in enumerate(g):
                    v = v * np.roll(letters.vector(0 if c == " " else ord(c)), gram - 1 - j)
                out, n = out + v, n + 1
        return out, n

    sums = {}
    for i, text, lang in rows:
        if lang is not None and fold(i, 4) != 2:
            sums[lang] = sums.get(lang, 0) + bundle(text)[0]
    out = {}
    for i, text, _ in rows:
        b, n = bundle(text)
        scores = {k: float(b @ s / (np.linalg.norm(b) * np.linalg.norm(s))) if n and s.any() else 0.0 for k, s in sums.items()}
        out[i] = (max(sorted(scores), key=scores.get), max(scores.values())) if n else ("und", 0.0)
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_language_equals_brute_force_in_blocks_of_prototypes(spark, block):
    rng = random.Random(12)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnopé"[k : k + 9]) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 40))), f"l{k}") for i, k in enumerate(rng.randrange(8) for _ in range(60))]
    expected = brute_language(rows)
    got = language.identify(frame(spark, rows), language.prototypes(frame(spark, rows), ~language.held_out(F.col("doc_id"))), block=block).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: x for i, (x, _) in expected.items()}
    assert all(abs(r.score - max(expected[r.doc_id][1], 0)) < 1e-4 for r in got)


def test_language_of_many_distinct_grams_is_bundled_in_bounded_tables(monkeypatch):
    rng = random.Random(13)
    texts = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(rng.randrange(50, 400))) for _ in range(40)]
    whole = language.Letters(32, 3).bundles(texts, np.arange(40), 40)
    monkeypatch.setattr(language, "GRAMS", 100)
    monkeypatch.setattr(language, "CELLS", 1000)
    parts = language.Letters(32, 3).bundles(texts, np.arange(40), 40)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def brute_lm(rows, backoff=0.4):
    encode = encoder()
    ids = [(i, [50_256, *encode(t or "")]) for i, t in rows]
    pairs = Counter(p for _, v in ids for p in zip(v, v[1:]))
    left, right = Counter(), Counter()
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
    total = sum(right.values())
    out = []
    for i, v in ids:
        own = Counter(zip(v, v[1:]))
        score = sum(math.log((pairs[p] - own[p]) / left[p[0]]) if pairs[p] > own[p] else math.log(backoff * right[p[1]] / total) for p in zip(v, v[1:]))
        out.append((str(i), len(v) - 1, round(score, 4) + 0.0))
    return sorted(out)


def test_lm_scores_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["the ", "of ", "cat", "dog ", "tree\n", "qzx ", "über ", "the the "]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "no id"), (3, "again the "), (300, "the " * 20_000)]
    got = lm_scores(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.log_score, 4) + 0.0) for r in got) == brute_lm(rows)
    assert {r.mean_log_score for r in got if r.doc_id in (200, 201)} == {None}
    assert lm_scores(frame(spark, [])).count() == 0


def brute_overlaps(docs, items):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for d, t in docs:
        words = cut(t)
        for i, u in items:
            item = cut(u)
            if d is None or i is None:
                continue
            for shift in range(-len(item) + 1, len(words)):
                same = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(item)]
                dense = any(sum(same[k : k + 13]) >= 11 for k in range(max(1, len(item) - 12)))
                if item and (sum(same) >= 0.75 * len(item) or dense):
                    out[(d, i)] = max(out.get((d, i), 0), sum(same))
    return out


def test_decontamination_finds_all_that_brute_force_finds(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(13, 40)))) for i in range(20)] + [(90, "too short"), (91, None), (None, "x " * 20), (0, ""), (92, "word1 word2 word3 word4 word5"), (93, "word6 word7 word8 word9 word10 word11 word12 word13")]
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        if d % 3 == 0:
            item = items[d % 20][1].split()
            for k in range(d % 4):  # replaced words, well apart
                item[5 + 9 * k if 5 + 9 * k < len(item) else 0] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," if rng.random() < 0.3 else w for w in item]
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (0, docs[0][1]), (502, "a word1 WORD2, word3 word4 word5 b"), (503, "word6 word7 word8 word9 word10 word11 word12 other"), (504, "z " * 40_000 + items[-1][1])]
    for n in range(1, 9):  # short items, whole and with replaced words at every place
        item = [f"short{n}x{k}" for k in range(n)]
        items.append((100 + n, " ".join(item)))
        for gone in range(4):
            for k, at in enumerate(itertools.combinations(range(n), gone)):
                docs.append((1000 * n + 100 * gone + k, "before " + " ".join("changed" if j in at else w for j, w in enumerate(item)) + " after"))
    docs += [(10_001, "short5x1 short5x2 short5x3 short5x4 other"), (10_002, "other short8x0 short8x1 short8x2 short8x3 short8x4 short8x5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched_tokens for r in overlaps(frame(spark, docs), bench).collect()}
    expected = brute_overlaps(docs, items)
    assert found == expected and len(expected) > 30
    assert {i: sum(e[1] == i for e in expected) for i in range(101, 109)} == {101: 1, 102: 1, 103: 1, 104: 5, 105: 7, 106: 7, 107: 8, 108: 38}
    kept = clean(frame(spark, docs), bench).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in docs} - {d for d, _ in expected}
    assert overlaps(frame(spark, []), bench).count() == 0
    assert overlaps(frame(spark, docs), bench.where("false")).count() == 0
    assert {r.item_id for r in overlaps(frame(spark, docs), bench, shortest=5).collect()} == {i for _, i in expected if i not in (90, 101, 102, 103, 104)}


def brute_licenses(rows, templates=licenses.TEMPLATES):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    pairs = lambda w: [" ".join(p) for p in zip(w, w[1:])]
    found = {}
    for doc, text in rows:
        words = cut(text)
        for name, notices in templates.items():
            for notice in notices:
                t = cut(notice)
                own = set(pairs(t))
                rare = sorted(own, key=lambda p: (-len(p), p))[: int(len(own) * 0.4 + 1e-9) + 1]
                for place, p in enumerate(pairs(t)):
                    for at, q in enumerate(pairs(words)):
                        if p == q and p in rare:
                            first = max(at - place, 0)
                            window = words[first : at - place + len(t)]
                            grams = set(pairs(window))
                            dice = 2 * len(grams & own) / (len(grams) + len(own))
                            if dice >= 0.75:
                                found.setdefault(doc, {}).setdefault(first, []).append((-dice, name, first, len(window)))
    out = []
    for doc, at in found.items():
        best = {k: min(v) for k, v in at.items()}
        out += [(str(doc), k, v[3], v[1], round(-v[0], 6)) for k, v in best.items() if v == min(best[j] for j in best if abs(j - k) <= 3)]
    return sorted(out)


def test_license_scan_finds_notices_wherever_they_stand(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(50)] + ["the", "of", "license", "software", "to", "in"]
    notices = [n for v in licenses.TEMPLATES.values() for n in v]
    rows = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            n = rng.choice(notices).split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                n[rng.randrange(len(n))] = rng.choice(words)
            n = [w for k in range(0, len(n), 10) for w in ("\n#", *n[k : k + 10])]  # wrapped in comment lines
            at = rng.randrange(len(text) + 1)
            text[at:at] = n
        rows.append((d, " ".join(text)))
    rows.append((100, "# " + "\n# ".join(re.findall(r"(?:\S+\s*){1,10}", licenses.TEMPLATES["MIT"][2])) + "\n" + "x = 1\n" * 40))
    got = sorted((str(r.doc_id), r.first_word, r.n_words, r.license, r.dice) for r in licenses.license_scan(frame(spark, rows)).collect())
    assert got == brute_licenses(rows) and len(got) > 30 and ("100", "MIT") in {(g[0], g[3]) for g in got}


def test_license_scan_edge_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, f"text\n{mit}\nmore"), (2, "RELEASED under the  MIT licence"), (3, None), (4, ""), (None, mit), (5, mit), (5, mit), (6, "unrelated words only"), (7, "word " * 60_000), (8, "mit"), (9, "word " * 30_000 + mit)]
    got = sorted((str(r.doc_id), r.first_word, r.n_words, r.license, r.dice) for r in licenses.license_scan(frame(spark, rows)).collect())
    assert got == [("1", 1, 5, "MIT", 1.0), ("2", 0, 5, "MIT", 0.75), ("5", 0, 5, "MIT", 1.0), ("9", 30_000, 5, "MIT", 1.0), ("None", 0, 5, "MIT", 1.0)]
    assert licenses.license_scan(frame(spark, [])).count() == 0
    assert licenses.license_scan(frame(spark, rows), {"none": ["word"]}).count() == 0  # a template of one word matches nothing


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1><p>By X</p></header>
<p>One <b>two</b>three<br>four<p>Five&nbsp;six a < b<script>var t="</p>";</script><form><p>mail</p></form><ul><li>a<li>b</ul>
<aside>side</aside><div class="ad">buy</div><!-- <p>gone</p> --><p hidden>hid</p><p>end</article>
<section id="comments"><article class="comment"><p>reader says</p></article></section></main><footer>foot</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_texts([html_text.blocks(PAGE)]) == ["Title & more\n\nOne twothree four\n\nFive six a < b\n\na\n\nb\n\nend"]


@pytest.mark.parametrize("page", [
    '<div class="layout has-sidebar"><article><p>Text here.</p></article></div>',
    '<div class="site-content no-sidebar"><main><p>Text here.</p></main></div>',
    '<form id="aspnetForm"><article><p>Text here.</p><form>Your name <input></form></article></form>',
    '<article class="commentary"><p>Text here.</p></article>',
    '<article><p>Text here.</p><div class="comments">c</div><div class="user-comments">u</div><div class="ad-slot-1">ad</div><div class="newsletter-signup">n</div><aside>s</aside><div id="sidebar">z</div></article><div class="sidebar"><article>teaser</article></div>',
])
def test_main_elements_win_over_the_names_around_them(page):
    assert html_text.main_texts([html_text.blocks(page)]) == ["Text here."]


@pytest.mark.parametrize("part", ['<section id="advertising">{}</section>', '<section id="login">{}</section>', '<h2 id="banner">{}</h2>', '<section id="comments-on-method">{}</section>', '<div class="promo-code-guide">{}</div>', '<table class="menu"><tr><td>{}</table>', "<p><math>{}</math></p>", "<noscript>{}</noscript>", "<svg><text>{}</text></svg>"])
def test_names_of_topics_leave_doubt_that_repeats_decide(part):
    page = "<article><p>Before {0} it.</p>" + part.replace("{}", "{0}") + "</article>"
    texts = [html_text.blocks(page.format(f"the {i}th part tells of its own {i} things")) for i in range(4)]
    assert all(t.count("things") == 2 for t in html_text.main_texts(texts))
    if "class=" in part or "id=" in part:  # the same words on all pages of the host
        same = [html_text.blocks(f"<article><p>Page {i} has its own words.</p>" + part.format("one two three four five six seven eight nine") + f"</article><footer>Page {i}</footer>") for i in range(4)]
        assert html_text.main_texts(same) == [f"Page {i} has its own words." for i in range(4)]


def test_pages_without_a_main_element_keep_their_unique_runs():
    menu = "menu one two three four five six seven eight"
    pages = [html_text.blocks(f"<body><div>{menu}</div><div>Text number {i} stands here</div>") for i in range(4)]
    assert html_text.main_texts(pages) == [f"Text number {i} stands here" for i in range(4)]
    copies = [html_text.blocks(f"<body><div>{menu}</div>")] * 5
    assert html_text.main_texts(copies) == [menu] * 5  # copies are one page


def test_repeated_runs_equal_brute_force():
    rng = random.Random(6)
    streams = [[rng.choice("abc") for _ in range(rng.randrange(0, 40))] for _ in range(12)]
    for run, pages in ((3, 2), (5, 3), (8, 2)):
        seen = {}
        for s in {tuple(s) for s in streams}:
            for k in range(len(s) - run + 1):
                seen.setdefault(s[k : k + run], set()).add(s)
        expected = []
        for s in streams:
            inside = np.zeros(len(s), bool)
            for k in range(len(s) - run + 1):
                if len(seen[tuple(s[k : k + run])]) >= pages:
                    inside[k : k + run] = True
            expected.append(inside.tolist())
        assert [x.tolist() for x in html_text.repeated(streams, run, pages)] == expected


def test_extract_edge_cases(spark):
    rows = [(1, "http://a.org/x", PAGE, "h"), (1, "http://a.org/x", PAGE, "h"), (2, None, None, "h"), (None, "not a url", "plain <b>text</b>", "h"), (3, "http://b.org", "", "h"), (4, "http://b.org", "<article><p>" + "long " * 50_000, "h")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), shard=100).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text[:12] for r in got} == {1: "Title & more", 2: "", None: "plain text", 3: "", 4: "long long lo"}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0


def test_shingles_are_of_bytes_between_ascii_space():
    texts = pa.array(["a b c d e f", "A B C D E", "a b\tc\x0bd\ne", "a b c d", "", None, "a b c d e"])
    sets = [s.tolist() for s in row_shingles(texts)]
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 1]
    assert sets[1] == sets[2] and sets[1][0] in sets[0] and sets[3] != sets[6]


def test_token_ids_are_those_of_the_json_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()
    for r in read(spark, "documents").select("text").where("doc_id < 200").collect():
        assert encode(r.text) == reference.encode(r.text, add_special_tokens=False).ids


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {n: d for n, d in _run(corpus_pipeline, spark, docs, folder)}
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in kept["exact_dedup"].collect()]
    assert len(texts) == len(set(texts))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in kept["decontamination"].collect() for i in items)
    last = {r.doc_id for r in kept["decontamination"].collect()}
    assert {r.doc_id for r in kept["packing"].collect()} == last


def _run(pipeline, spark, docs, folder):
    from careshed.llm.common import table

    for name, stage in pipeline.STAGES:
        docs = table(stage(spark, docs, folder), name)
        yield name, docs
