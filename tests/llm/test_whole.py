"""What the operators' rules accept, also where replaced tokens, added tokens or long hosts make it hard to find."""

import random
import struct
from itertools import combinations

from careshed.llm import decontaminate, html_text, packing
from tests.llm.test_text import brute_overlaps, frame


def test_every_accepted_alignment_leaves_a_mask_whole():
    for n, replaced in ((9, 2), (12, 3), (16, 4)):
        for lost in combinations(range(n), replaced):
            at = ((m, i) for m in decontaminate.MASKS for i in range(n - len(m) + 1))
            assert any(all(bit == "0" or i + j not in lost for j, bit in enumerate(m)) for m, i in at), (n, lost)


def test_decontamination_finds_tokens_replaced_anywhere(spark):
    rng = random.Random(18)
    words = [f"word{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((9, 12, 13, 13, 15, 16, 20, 30))))) for i in range(30)]
    docs = []
    for d in range(240):
        item, text = items[d % 30][1].split(), [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        for k in rng.sample(range(len(item)), len(item) // 4):
            item[k] = "changed"
        at = rng.randrange(len(text) + 1)
        text[at:at] = item
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched_tokens for r in decontaminate.overlaps(frame(spark, docs), bench).collect()}
    assert found == brute_overlaps(docs, items) and len(found) >= 240


def test_runs_are_found_over_all_shards_of_a_host(spark):
    rng = random.Random(7)
    unique = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for _ in range(60)]
    notices = [" ".join(f"notice{k}x{j}" for j in range(10)) for k in range(20)]  # each on three pages
    rows = [(i, f"http://a.org/{i}", f"<div><p>{unique[i]}</p><p>{notices[i // 3]}</p></div>") for i in range(60)]
    copies = " ".join(f"copied{j}" for j in range(20))
    rows += [(100 + i, f"http://a.org/c{i}", f"<p>{copies}</p>") for i in range(6)]  # one page, so nothing is repeated
    rows += [(200, "http://a.org/m", f"<article><p>{notices[0]}</p></article>"), (201, "http://b.org/m", f"<main>{notices[1]}</main>"), (202, "http://c.org", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {i: unique[i] for i in range(60)} | {100 + i: copies for i in range(6)} | {200: notices[0], 201: notices[1], 202: ""}
    for shard in (1 << 20, 2000, 300):
        got = {r.page_id: r.text for r in html_text.extract(pages, shard=shard).collect()}
        assert got == expected, shard


def test_packed_ids_equal_the_vocabularys_also_at_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "\n\n", "word", " über", "  12", "'s", "\u00a0", "日本", "\U0001f600"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(200)]
    rows = packing.pack(frame(spark, list(enumerate(texts))), length=10**6).collect()
    got = {r.doc_id: list(struct.unpack(f"<{r.length}I", r.ids)) for r in rows}
    assert got == {i: [*reference.encode(t, add_special_tokens=False).ids, packing.END] for i, t in enumerate(texts)}


def test_texts_with_runs_too_long_for_the_rank_encoder(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from careshed.llm.lm_score import lm_scores

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 1_000_000
    texts = ["a" + " " * n, "x" * n, "-" * n, "\n" * n + "end", "a <|endoftext|>" + " \n" * (n // 2) + "b", "\u00a0" * n]
    rows = packing.pack(frame(spark, list(enumerate(texts))), length=10**7).collect()
    for r in rows:
        assert list(struct.unpack(f"<{r.length}I", r.ids)) == [*reference.encode(texts[r.doc_id], add_special_tokens=False).ids, packing.END]
    assert len(rows) == len(texts)
    assert all(r.n_tokens > 0 for r in lm_scores(frame(spark, list(enumerate(texts)))).collect())


def extracted(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main string, gone string, shorts string")
    return {r.page_id: r.text for r in html_text.extract(pages, **options).collect()}


def test_repeats_decide_doubtful_blocks_and_notices(spark):
    rng = random.Random(15)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, expected, without_runs = [], {}, {}
    terms, thanks = text(12), "Thanks for reading"
    for i in range(12):
        body, own = text(30), text(12)
        parts = [f"<p>{body}</p>", f"<div class='legal'>{terms if i % 2 else own}</div>", f"<p>{thanks}</p>", "<div class='share-price'>up</div>" if i < 3 else ""]
        rows.append((i, f"http://a.org/{i}", f"<nav>{text(5)}</nav><article>{''.join(parts)}</article>", "x", "y", "z"))
        expected[i] = "\n\n".join([body] + ([own] if i % 2 == 0 else []))
        without_runs[i] = "\n\n".join([body, terms if i % 2 else own] + (["up"] if i < 3 else []))
    for i in range(20, 32):  # copies of one article, and a block that half of the others share
        rows.append((i, "http://b.org", f"<main><p>{terms}</p><p>{thanks}</p></main><footer>{i}</footer>", "x", "y", "z"))
        expected[i] = without_runs[i] = f"{terms}\n\n{thanks}"
    for i in range(40, 50):
        own = text(20)
        rows.append((i, "http://c.org", f"<main><p>{own}</p>{f'<p>{thanks}</p>' if i < 45 else ''}</main>", "x", "y", "z"))
        expected[i] = without_runs[i] = "\n\n".join([own] + [thanks] * (i < 45))
    for shard in (1 << 20, 500):
        assert extracted(spark, rows, shard=shard) == expected, shard
    assert extracted(spark, rows, least=10**6) == without_runs  # no run repeats often enough, so doubtful blocks stay


def test_no_text_of_an_article_is_lost(spark):
    rng = random.Random(16)
    word = lambda: rng.choice(["it's", "a", "b<c", "x & y", "\"q\"", "5 > 3", "über", "--", "日本", "don't"])
    attributes = ["", " class=x", " data-x=it's", " title=\"a > b\"", " title='a > \"b'", " hidden-x", " class='share-price'", " a = 'b' c", " style=\"color: red\"", " id=search-results"]
    rows, expected = [], {}
    for i in range(150):
        page, kept = [], []
        for _ in range(rng.randrange(1, 8)):
            words = [word() for _ in range(rng.randrange(1, 12))]
            kept.append(" ".join(" ".join(words).split()))
            marked = []
            for w in words:
                safe = w.replace("&", "&amp;").replace("<", rng.choice(["&lt;", "&#60;"])).replace(">", rng.choice(["&gt;", ">"]))
                tag = rng.choice(["b", "i", "span", "u", "em"])  # a doubtful block of links alone is a menu
                marked.append(rng.choice([safe, f"<{tag}{rng.choice(attributes[:6])}>{safe}</{tag}>", f"{safe}<!-- {word()} -->", f"</{tag}>{safe}"]))
            tag = rng.choice(["p", "div", "li", "section", "h2", "td"])
            page.append(f"<{tag}{rng.choice(attributes)}>" + rng.choice([" ", "\n", "\t  "]).join(marked) + rng.choice([f"</{tag}>", f"</{tag}>", ""]))
        rows.append((i, f"http://h{i}.org", f"<nav>menu</nav><article>{''.join(page)}</article><footer>foot</footer>", "x", "y", "z"))
        expected[i] = "\n\n".join(kept)
    got = extracted(spark, rows)
    assert [(got[i], expected[i], rows[i][2]) for i in got if got[i] != expected[i]] == []


def test_pages_are_read_in_time_that_grows_in_proportion():
    import time

    n = 20_000
    for page in ("<div>" * n + "</span>" * n, "<i>" + "<div>" * n + "</i>" * n, "<b>" * n + "<p>x" * n, "<p a=" * n + "'", "<header>" * n + "<p>x" * n):
        start = time.monotonic()
        assert html_text.blocks("<article>" + page + "<p>end")[-1][1].endswith("end") or "header" in page or "'" in page
        assert time.monotonic() - start < 8
