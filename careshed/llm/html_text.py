"""Main text of web pages: page structure, and a suffix array over each host's pages for what it leaves open.

Each page is read into blocks: main (inside an article or main element), boilerplate (menus, headers, footers, sidebars,
notices, adverts, forms, comments, by element or by an unmistakable class, id or role), doubtful (inside the main element,
but under a name that may mean either) and open ones. The repeats of a host decide the rest:

* A host with pages of open or doubtful blocks puts the token streams of all its blocks outside the plain main text one
  after another; prefix doubling ranks every position by its next RUN tokens, which is a suffix array cut off at that
  depth. A host too large for one task is dealt to shards of bounded size, and its runs are counted over all of them by
  hash. Runs that stand on PAGES pages of different text or more are boilerplate: open blocks keep their unique runs,
  doubtful blocks go if half of their tokens or more are in such runs.
* A short block of the main text that stands whole on nearly all of a host's different main texts is a notice and goes.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import checked_broadcast, in_arrow, table

RUN, PAGES = 8, 3
#: Bytes of html in a shard of a host's pages.
SHARD = 1 << 20
#: Hosts with open pages that may be broadcast (some 20 MB); more are joined by a shuffle.
BROADCAST_HOSTS = 200_000

#: A block of the main text is a notice if it has at most SHORT tokens and stands on this share of the host's different
#: main texts, and on NOTICES of them at least. Notices never take more than half of a page's main text.
SHORT, NEARLY_ALL, NOTICES = 50, 0.9, 5

MAIN, OPEN, BOILERPLATE, DOUBT = 0, 1, 2, 3

# Element names of HTML, and words that name parts of a page in class, id and role.
_RAW = {"script", "style", "textarea", "title", "template", "iframe", "object", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_AWAY = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "head", "fieldset"}
#: Parts of an article that are content by themselves: there an id, or a table's class, names a topic and leaves doubt.
_CONTENT = {"section", "table", "tr", "td", "th", "dl", "dt", "dd", "figure", "p", "pre", "blockquote"} | _HEADING
_ENDS_P = _BLOCK - {"body", "html", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Words that name boilerplate alone or with words of their kind or such as follow, and leave doubt in other company.
_PARTS = {"ad", "ads", "adbox", "banner", "breadcrumb", "breadcrumbs", "byline", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "outbrain", "pager", "pagination", "popup", "promo", "promoted", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "taboola", "topbar", "complementary", "alertdialog"}
_PART_STARTS = ("advert", "sidebar", "cookie", "navbar")
#: Words that name reader comments, and what else stands in such names.
_COMMENTS = {"comment", "comments", "commentlist", "commentform", "commenter", "commenters", "replies", "disqus"}
_COMMENT_WITH = {"author", "body", "count", "facebook", "fb", "head", "heading", "meta", "number", "reader", "readers", "reply", "respond", "text", "thread", "threads", "title", "user", "users"}
#: Words that name boilerplate like these, but less often.
_EITHER = {"copyright", "header", "notification", "overlay", "recommended", "related", "rail", "replies", "reply", "search", "share", "sharing", "skip", "social", "teaser", "toc", "toolbar", "widget", "widgets"}
_WITH = {"area", "article", "articles", "bar", "block", "box", "button", "buttons", "container", "content", "footer", "form", "header", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "more", "page", "panel", "post", "posts", "right", "section", "site", "stories", "to", "tools", "top", "wrap", "wrapper", "bottom", "card", "cards", "col", "column", "component", "desktop", "first", "fixed", "global", "google", "grid", "group", "inline", "label", "last", "leaderboard", "mobile", "module", "outer", "placement", "primary", "region", "row", "secondary", "slot", "space", "sticky", "unit", "zone"}
#: Words that leave doubt in any company.
_DOUBT = {"legal", "alert"}

#: A quote opens a value only after an equals sign; elsewhere it is text like any other.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_CUT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _part(name: str, attributes: str, inside: bool = False) -> str:
    """What an element is by its name and attributes: main, away, form, doubt, or nothing of note; ``inside`` a main one.

    A name of boilerplate counts if all words of a class or id are of that kind. In other company it leaves doubt, and so
    it does as the id, or a table's class, of what is content by itself inside the main element.
    """
    tokens, role = [], ""
    for key, *values in _NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        tokens += [(key.lower(), {w.lower() for w in _CUT.split(t) if w and not w.isdigit()}) for t in value.split()]
        role = value.strip().lower() if key.lower() in ("role", "itemprop") else role
    if name in ("html", "body"):
        return ""
    if any(t & _COMMENTS and t <= _COMMENTS | _COMMENT_WITH | _EITHER | _WITH for key, t in tokens if not inside or name not in _CONTENT or key != "id"):
        return "away"
    if name in ("article", "main") or role in ("main", "article", "articlebody"):
        return "main"
    if name in _AWAY or _HIDDEN.search(attributes):
        return "away"
    doubt = ""
    for key, t in tokens:
        own = {w for w in t if w in _PARTS or w in _EITHER or w in _COMMENTS or w.startswith(_PART_STARTS)}
        if own and t <= own | _WITH and not (inside and name in _CONTENT and (key == "id" or name == "table")):
            return "away"
        doubt = "doubt" if own or t & _DOUBT else doubt
    return "form" if name == "form" else doubt


class _Reader:
    """The open elements of a page and its blocks so far. Every step takes constant time, or time that a later one saves."""

    def __init__(self) -> None:
        self.out: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.linked = 0  # characters of the text inside links
        self.stack: list[tuple[str, str]] = []  # name and part of each open element
        self.places: dict[str, list[int]] = {}  # where on the stack a name is open
        self.blocks: list[int] = []  # where on the stack blocks are open
        self.parts = {"main": 0, "away": 0, "form": 0, "doubt": 0, "head": 0, "": 0}
        self.around: list[tuple[int, int]] = []  # forms and doubts open around each open main element, which wins over them

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.places.get("a"):
            self.linked += len(text)

    def flush(self) -> None:
        if self.text:
            raw = "".join(self.text)
            joined = " ".join(html.unescape(raw).split())
            if joined:
                forms, doubts = self.around[-1] if self.around else (0, 0)
                main, away, doubt = self.parts["main"], self.parts["away"] or self.parts["form"] > forms, self.parts["doubt"] - doubts
                doubt = doubt and main and (BOILERPLATE if 2 * self.linked >= len(raw.strip()) else DOUBT)
                self.out.append((BOILERPLATE if away else doubt or (MAIN if main else OPEN), joined))
            self.text.clear()
            self.linked = 0

    def push(self, name: str, part: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, part))
        if part == "main":
            self.around.append((self.parts["form"], self.parts["doubt"]) if not self.around else self.around[-1])
        self.parts[part] += 1

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, part = self.stack.pop()
            self.places[name].pop()
            if name in _BLOCK:
                self.blocks.pop()
            self.parts[part] -= 1
            if part == "main":
                self.around.pop()

    def end(self, name: str) -> None:
        """An end tag: closes the nearest element of its name, if there is one and no block stands in between."""
        block = name in _BLOCK
        if block:
            self.flush()
        if not self.places.get(name):
            return
        k = self.places[name][-1]
        if not block:
            inner = [i for i in self.blocks[-2:] if self.stack[i][0] != "p"]  # a p may be open inside, and nothing in it is a block
            if inner and inner[-1] > k:
                return
        if any(n in _BLOCK or p for n, p in self.stack[k:]):
            self.flush()
        self.pop(k)

    def shut(self, names: set[str]) -> None:
        """What the start of a block closes: open elements of these names, up to the first other block."""
        while self.blocks and self.stack[self.blocks[-1]][0] in names:
            self.pop(self.blocks[-1])


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The page's blocks with text, in order, each with its kind; tolerant of unclosed and stray tags."""
    page, at, r = (page or "").replace("\0", "\ufffd"), 0, _Reader()
    while tag := _TAG.search(page, at):
        r.add(page[at : tag.start()])
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            r.end(name)
            continue
        if name in _RAW and not tag[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            r.text.append(" ")
        if name in _BLOCK:
            r.flush()
        if name in _ENDS_P or name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            r.shut({"p"} if name in _ENDS_P and name not in ("li", "dt", "dd") else {"p", name} | ({"dt", "dd"} if name in ("dt", "dd") else set()) | ({"td", "th"} if name in ("td", "th", "tr") else set()))
        if name in _VOID or tag[0].endswith("/>") and name not in _BLOCK:
            continue
        part = _part(name, tag[3] or "", r.parts["main"] > 0)
        if part == "away" and name == "header" and r.parts["main"] and not r.parts["away"]:
            part = "head"  # an article's own header: its headings count as main
        if r.parts["head"] and name not in _HEADING and name in _BLOCK and not part:
            part = "away"
        if part:
            r.flush()
        r.push(name, part)
    r.add(page[at:] if not page[at:].startswith("<") else "")
    r.flush()
    return r.out


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of ``run`` tokens that ``pages`` different streams share."""
    ids: dict[str, int] = {}
    parts = [np.array([ids.setdefault(w, len(ids)) for w in s], np.int64) for s in streams]
    known: dict[bytes, int] = {}
    page = np.array([known.setdefault(p.tobytes(), len(known)) for p in parts], np.int64)  # copies are one page
    rank = np.concatenate([np.append(p, -1 - i) for i, p in enumerate(parts)]) if parts else np.zeros(0, np.int64)
    own = np.repeat(page, [len(p) + 1 for p in parts]) if parts else rank
    n, span = len(rank), 1
    covered = np.zeros(n + 1, np.int64)
    if n >= run:
        rank = np.unique(rank, return_inverse=True)[1]
        while span < run:  # ranks by span tokens give ranks by up to twice as many
            step = min(span, run - span)
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:]
            rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1]
            span += step
        pairs = np.unique(rank * (len(known) + 1) + own)
        often = np.bincount(pairs // (len(known) + 1), minlength=n)[rank] >= pages
        at = np.flatnonzero(often)
        np.add.at(covered, at, 1)
        np.add.at(covered, np.minimum(at + run, n), -1)
    inside, edge = np.cumsum(covered[:n]) > 0, np.cumsum([0, *(len(p) + 1 for p in parts)])
    return [inside[edge[i] : edge[i + 1] - 1] for i in range(len(parts))]


def _own(covered: np.ndarray, run: int) -> np.ndarray:
    """A block's covered tokens, without short stretches that a run from the block before or after reaches into."""
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out[a:b] = b - a >= run or b - a == len(covered)
    return out


def _stream(page: list[tuple[int, str]], run: int) -> tuple[list[str], list[int]]:
    """The tokens of all blocks but the plain main ones, and where each block's begin. A doubtful block shorter than a
    run is filled up to one, so that it counts by itself."""
    out, begins = [], []
    for kind, text in page:
        begins.append(len(out))
        if kind != MAIN:
            words = text.split()
            out += words + ["\0"] * (run - len(words) if kind == DOUBT else 0)
    return out, begins


def _is_open(page: list[tuple[int, str]]) -> bool:
    """Whether runs have a say: the page has doubtful blocks, or open blocks and no main ones."""
    kinds = {kind for kind, _ in page}
    return DOUBT in kinds or OPEN in kinds and MAIN not in kinds


def _shorts(page: list[tuple[int, str]]) -> list[int]:
    """Hashes of the main blocks that are short enough for a notice."""
    return sorted({_signed(text) for kind, text in page if kind == MAIN and len(text.split()) <= SHORT})


def _without_notices(page: list[tuple[int, str]], gone: set[int]) -> list[tuple[int, str]]:
    """The page with its notices as boilerplate, unless they are more than half of its main text."""
    if not gone:
        return page
    notice = [kind == MAIN and _signed(text) in gone for kind, text in page]
    lost, whole = (sum(len(text) for (kind, text), n in zip(page, notice, strict=True) if kind == MAIN and (n or every)) for every in (False, True))
    return page if 2 * lost > whole else [(BOILERPLATE if n else kind, text) for (kind, text), n in zip(page, notice, strict=True)]


def _signed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def run_hashes(stream: list[str], known: dict[str, int], run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the ``run`` tokens from each position on, the same in every task; ``known`` holds tokens' hashes."""
    words = np.array([known[w] if w in known else known.setdefault(w, _digest(w)) for w in stream], np.uint64)
    out = np.zeros(max(0, len(words) - run + 1), np.uint64)
    for j in range(run if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)]
    return out.view(np.int64)


def _in_runs(streams: list[list[str]], often: np.ndarray, run: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run whose hash is in ``often``."""
    known: dict[str, int] = {}
    out = []
    for stream in streams:
        at = np.flatnonzero(np.isin(run_hashes(stream, known, run), often))
        covered = np.zeros(len(stream) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + run, -1)
        out.append(np.cumsum(covered[:-1]) > 0)
    return out


def _packed(page: list[tuple[int, str]]) -> bytes:
    return zlib.compress("\x00".join(f"{kind}{text}" for kind, text in page).encode("utf-8", "surrogatepass"), 1)


def _unpacked(packed: bytes) -> list[tuple[int, str]]:
    text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
    return [(int(b[0]), b[1:]) for b in text.split("\x00")] if text else []


def main_texts(pages: list[list[tuple[int, str]]], run: int = RUN, least: int = PAGES, often: np.ndarray | None = None) -> list[str]:
    """The main text of each of a host's pages, given as blocks; ``often`` has the hashes of runs that other shards count too."""
    streams = [_stream(page, run) for page in pages]
    tokens = [s for s, _ in streams]
    out = []
    for page, (_, begins), covered in zip(pages, streams, repeated(tokens, run, least) if often is None else _in_runs(tokens, often, run), strict=True):
        kept, has_main = [], any(kind in (MAIN, DOUBT) for kind, _ in page)
        for (kind, text), at in zip(page, begins, strict=True):
            words = text.split()
            mine = covered[at : at + len(words)]
            if kind == MAIN or kind == DOUBT and 2 * mine.sum() < len(words):
                kept.append(text)
            elif kind == OPEN and not has_main:
                kept.append(" ".join(w for w, c in zip(words, _own(mine, run), strict=True) if not c))
        out.append("\n\n".join(k for k in kept if k))
    return out


def notices(parsed: DataFrame) -> DataFrame:
    """(host, gone): hashes of the blocks that stand whole on nearly all different main texts of the host."""
    mains = parsed.where(F.size("shorts") > 0).select("host", "main", "shorts").dropDuplicates(["host", "main"])
    totals = parsed.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("mains")).where(F.col("mains") >= NOTICES)
    counts = mains.select("host", F.explode("shorts").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= NOTICES)
    return counts.join(totals, "host").where(F.col("n") >= NEARLY_ALL * F.col("mains")).groupBy("host").agg(F.collect_list("block").alias("gone"))


def extract(pages: DataFrame, run: int = RUN, least: int = PAGES, shard: int = SHARD) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    * Character references are decoded, white space in a block becomes one blank, blocks are joined by a blank
      line in page order. A page with an article or main element keeps that element but its boilerplate parts, its
      doubtful blocks of repeated runs and its notices; other pages keep the unique runs of their open blocks. Runs and
      notices are looked for on all pages of the host, however many they are.
    * A quote opens an attribute's value only after an equals sign; tags may be unclosed, stray or nested to any depth.
      Html of any length is read whole, in time that grows in proportion.
    * Null and empty html give an empty text. A null url, or one without a host, belongs to the host "".
    * Pages with the same text outside the main element count as one page, and so do those with the same main text, so
      copies do not erase each other.
    * Repeated rows and null ids are extracted like any other. An empty table gives an empty result; other columns
      are not looked at. page_id is cast to long: an id that is no whole number fails.
    """
    spark = pages.sparkSession
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#:@]+)", 1)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page) for page in batch.column(2).to_pylist()]
            main = [_signed("\n\n".join(text for kind, text in page if kind == MAIN)) for page in found]
            columns = [*(batch.column(i) for i in (0, 1, 3)), pc.binary_length(batch.column(2)).cast(pa.int64()), pa.array(map(_is_open, found), pa.bool_()), pa.array(main, pa.int64()), pa.array(map(_shorts, found), pa.list_(pa.int64())), pa.array(map(_packed, found), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "size", "open", "main", "shorts", "blocks"])

    def result(held: list[tuple], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def by_structure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield result(held, ["\n\n".join(text for kind, text in _without_notices(_unpacked(h[2]), set(h[3] or ())) if kind == MAIN) for h in held])

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            for host, shard, is_open, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream, _ = _stream(_unpacked(packed), run)
                found = np.unique(run_hashes(stream, known, run))
                n, page = len(found), _digest(" ".join(stream))
                yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array(np.full(n, shard, np.int32)), pa.array(found), pa.array(np.full(n, page, np.uint64).view(np.int64)), pa.array(np.full(n, is_open))], names=["host", "shard", "run", "page", "open"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, often = None, [], None
        for batch in batches:
            for page_id, url, host, shard, shards, runs, packed, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, shard) != key:
                    if held:
                        yield result(held, main_texts([b for _, _, b in held], run, least, often))
                    key, held, often = (host, shard), [], np.zeros(0, np.int64) if shards > 1 else None
                if runs is not None:
                    often = np.array(runs, np.int64)
                else:
                    held.append((page_id, url, _without_notices(_unpacked(packed), set(gone or ()))))
        if held:
            yield result(held, main_texts([b for _, _, b in held], run, least, often))

    schema = "page_id long, url string, text string, n_chars long"
    parsed = table(in_arrow(rows, read, "page_id long, url string, host string, size long, open boolean, main long, shorts array<long>, blocks binary"), "html-blocks")
    found = table(notices(parsed), "html-notices")
    parsed = parsed.drop("main", "shorts").join(checked_broadcast(found, found.count(), BROADCAST_HOSTS), "host", "left")
    hosts = parsed.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / shard)).cast("int").alias("shards"), F.max("open").alias("any_open")).where("any_open")
    hosts = table(hosts.select("host", "shards"), "html-open-hosts")
    n_hosts, most = hosts.agg(F.count("*"), F.max("shards")).first()
    hosts = checked_broadcast(hosts, n_hosts, BROADCAST_HOSTS)
    decided = in_arrow(parsed.join(hosts, "host", "left_anti").select("page_id", "url", "blocks", "gone"), by_structure, schema)
    if not n_hosts:
        return decided
    part = F.pmod(F.xxhash64("url", "page_id"), F.col("shards")).cast("int")
    dealt = parsed.join(hosts, "host").withColumn("shard", part)
    pages = dealt.select("page_id", "url", "host", "shard", "shards", F.lit(None).cast("array<bigint>").alias("runs"), "blocks", "gone")
    if most > 1:
        runs = in_arrow(dealt.where("shards > 1").select("host", "shard", "open", "blocks"), count_runs, "host string, shard int, run long, page long, open boolean")
        runs = table(runs.groupBy("host", "shard", "run", "page").agg(F.max("open").alias("open")), "html-runs")
        often = runs.groupBy("host", "run").agg(F.count_distinct("page").alias("n"), F.max("open").alias("any_open")).where((F.col("n") >= least) & F.col("any_open"))
        often = runs.where("open").select("host", "shard", "run").distinct().join(often.select("host", "run"), ["host", "run"])
        often = often.groupBy("host", "shard").agg(F.collect_list("run").alias("runs"))
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("page_id", "long"), ("url", "string"))]
        pages = pages.unionByName(often.select(*nothing, "host", "shard", F.lit(2).alias("shards"), "runs", F.lit(None).cast("binary").alias("blocks"), F.lit(None).cast("array<bigint>").alias("gone")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.repartition(parts, "host", "shard").sortWithinPartitions("host", "shard", F.col("runs").isNull())
    return decided.unionByName(in_arrow(pages, write, schema))
