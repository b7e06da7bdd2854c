"""Main text of web pages (operator 13): host suffix arrays over the token streams of pages, next to what the markup says.

1. Every page is read into blocks of text with a rank each: 3 inside an `article`, 2 inside `main`, 1 inside an element named as
   content, 0 elsewhere, and -1 inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments, by tag,
   role, class or id. A page's candidates are its blocks of the highest rank that holds text; -1 is never one.
2. The pages of a host are dealt to parts of about PART_BYTES by a hash. In a task the words of a part outside marked
   articles (all words, on pages that mark none) are laid end to end, and their suffix array is built by prefix doubling up to LEAST words.
   Neighbours of equal rank that lie on distinct pages are a repeated substring; all words of these are covered.
3. A host of several parts is exact too: the hash of each LEAST words goes to Spark with its part and the least and largest
   digest of its pages; what lies on distinct pages of the host comes back to every part that has it and covers as well.
4. Candidates of rank 0 that are covered by half or more are boilerplate and go; the unique runs stay. If fewer than
   one in UNIQUE of a page's words are unique, the page is a copy of another one, and all its candidates stay.

Inside a marked article nothing goes for being repeated: copies and quotations are content there.

Defined results: a null or empty html, or one without text, gives an empty text; a null url is a host of its own; equal pages
count as one page and keep equal texts; rows that repeat a page_id are rows of their own; unfinished tags and comments at the
end are dropped; `br` is white space inside its block; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.text import NOT_SPACE, Chunk, mix, signed, table_of, window_hashes, word_hashes
from tallyspark.session import cut, has_rows

#: Words of the shortest repeated substring (a power of two), and the least share of unique words.
LEAST, UNIQUE = 8, 20
PART_BYTES = 2 << 20

_TAG = re.compile(r"""<!--(?:-?>|.*?--!?>)|(?P<open><!--)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_OPENING = re.compile(r"<[A-Za-z/!?]")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
    thead tr ul""".split())
_RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that never hold main text.
_NEVER = _RAW | set("""head nav footer aside form button select datalist template svg canvas audio video object dialog menu input label
    search""".split())
#: What a start tag ends if it is open, and where the look for it stops.
_ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}),
         "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_ROLES_OUT = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class and id names that tell boilerplate, and those that tell it of a whole `article` or `main` too.
_OUT_ALWAYS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies
    respond related recommended recommendations teaser""".split())
_OUT = _OUT_ALWAYS | set("""nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice
    notices popup modal overlay newsletter subscribe subscription signup login share sharing social pagination pager toolbar copyright
    skip banner masthead topbar alert alerts toast""".split())
_OUT_OPEN = _OUT | {"header", "head"}  # an article may have a header of its own
#: Whole class or id names of the element that holds the main text.
_CONTENT = set("""content main maincontent article articlebody articlecontent post postbody postcontent entry entrycontent story storybody
    bodycontent pagecontent contentbody""".split())


def _names(value: str) -> set[str]:
    return {w.lower() for w in _NAME.findall(value)}


def _rank(tag: str, attributes: str, parent: int) -> int:
    """Rank of an element's text, from its tag, its attributes and its parent's rank."""
    if parent < 0 or tag in _NEVER:
        return -1
    inside = parent > 0
    if tag == "header" and not inside:
        return -1
    marked = {"article": 3, "main": 2}.get(tag, 0)
    if not attributes.strip(" /"):
        return max(parent, marked)
    names, whole = set(), set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), references.unescape("".join(values))
        if key in ("class", "id"):
            for name in value.split():
                names |= _names(name)
                whole.add(re.sub("[^a-z]", "", name.lower()))
        elif key == "role":
            role = value.strip().lower()
            if role in _ROLES_OUT and not (inside and role == "banner"):
                return -1
            marked = max(marked, {"main": 2, "article": 3}.get(role, 0))
        elif key == "itemprop" and value.strip().lower() == "articlebody":
            marked = 3
        elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true"):
            return -1
    if tag in ("html", "body"):
        return max(parent, marked)
    if names & (_OUT_ALWAYS if marked else _OUT if inside else _OUT_OPEN):
        return -1
    return max(parent, marked, 1 if whole & _CONTENT else 0)


def blocks(html: str) -> list[tuple[int, str]]:
    """(rank, text) of every block with text, in page order; script, style, head and the like left out."""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    held_rank = 0

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                found.append((held_rank, text))
            held.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    def say(text: str) -> None:
        nonlocal held_rank
        rank = stack[-1][1]
        if held and rank != held_rank:
            flush()
        held_rank = rank
        held.append(text)

    end = html.rfind(">") + 1
    at, closed = 0, True
    while (m := _TAG.search(html, at, end)) is not None:
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        if m["open"]:
            closed = False
            break
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            say(" ")
        if m["end"]:
            if opened[tag]:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                if stack[depth][1] != (stack[depth - 1][1]):
                    flush()
                pop_to(depth)
            continue
        if tag in _RAW:
            stop = re.compile("</" + re.escape(tag) + r"[\s/>]", re.I).search(html, at)
            if stop is None:
                closed = False
                break
            at = stop.start()
        if tag in _VOID:
            continue
        _implied_ends(tag, stack, opened, pop_to)
        stack.append((tag, _rank(tag, m["attributes"], stack[-1][1])))
        opened[tag] += 1
    if closed:
        rest = html[at:]
        unfinished = _OPENING.search(rest)
        say(rest[:unfinished.start()] if unfinished else rest)
    flush()
    return found


def _implied_ends(tag: str, stack: list[tuple[str, int]], opened: Counter, pop_to) -> None:
    """A block ends an open paragraph, an item the item before it."""
    for names, stops in ([("p", _BLOCK - {"p"})] if tag in _BLOCK else []) + ([_ENDS[tag]] if tag in _ENDS else []):
        wanted = names.split()
        if not any(opened[w] for w in wanted):
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in wanted:
                pop_to(k)
                break
            if stack[k][0] in stops:
                break


class Pages:
    """Blocks of some pages, and the words outside marked articles as one stream."""

    def __init__(self, htmls: list[str | None]):
        self.count = len(htmls)
        page, rank, self.texts = [], [], []
        for k, html in enumerate(htmls):
            for r, text in blocks(html or ""):
                page.append(k)
                rank.append(r)
                self.texts.append(text)
        self.page, rank = np.array(page, dtype=np.int64), np.array(rank, dtype=np.int64)
        self.best = np.full(self.count, -1, dtype=np.int64)
        np.maximum.at(self.best, self.page, rank)
        self.candidate = (rank >= 0) & (rank == self.best[self.page]) if len(rank) else np.zeros(0, dtype=bool)
        self.open = self.candidate & (rank == 0)
        stream = np.flatnonzero(~self.candidate | self.open)  # blocks that go into the stream
        raw = [self.texts[b].encode() for b in stream]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        chunk = Chunk(pa.nulls(len(raw)), np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        self.words, first = word_hashes(chunk, NOT_SPACE, lower=False) if len(raw) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.block = np.repeat(stream, np.diff(first))  # of every word
        word_page = self.page[self.block] if len(self.block) else np.zeros(0, np.int64)
        self.word_page = word_page
        ends = np.searchsorted(word_page, np.arange(self.count), side="right")
        self.end = ends[word_page] if len(word_page) else word_page  # where the page of each word ends
        # equal pages are one page: a digest of the stream
        digest = np.zeros(self.count, dtype=np.uint64)
        place = np.arange(len(self.words)) - (np.searchsorted(word_page, word_page) if len(word_page) else 0)
        np.add.at(digest, word_page, mix(self.words ^ mix(place.astype(np.uint64))))
        self.digest = digest

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where LEAST words of one page begin, and the hashes of these windows."""
        at = np.flatnonzero(np.arange(len(self.words)) + LEAST <= self.end)
        return at, window_hashes(self.words, LEAST)[at] if len(at) else np.zeros(0, np.uint64)

    def covered(self, known: np.ndarray) -> np.ndarray:
        """True for words of substrings of LEAST words and more that lie on distinct pages here, or are in `known` (window hashes)."""
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        order, rank = suffix_array(self.words, self.end, LEAST)
        if len(order):
            lead = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
            pages = self.digest[self.word_page[order]]
            several = np.minimum.reduceat(pages, lead) != np.maximum.reduceat(pages, lead)
            np.add.at(change, order[np.repeat(several, np.diff(np.append(lead, len(order))))], 1)
        if len(known):
            at, hashes = self.windows()
            np.add.at(change, at[np.isin(hashes, known)], 1)
        begins = np.flatnonzero(change[:-1] > 0)
        over = np.zeros(len(self.words) + 1, dtype=np.int64)
        over[begins] += 1
        np.add.at(over, begins + LEAST, -1)
        return np.cumsum(over[:-1]) > 0

    def main_texts(self, covered: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Main text of every page, and how many of its words are covered."""
        n = np.bincount(self.block, minlength=len(self.texts))
        hidden = np.bincount(self.block, weights=covered, minlength=len(self.texts)).astype(np.int64)
        unique = np.bincount(self.page, weights=(n - hidden) * self.open, minlength=self.count)
        whole = np.bincount(self.page, weights=n * self.open, minlength=self.count)
        copy = UNIQUE * unique < whole
        gone = self.open & (2 * hidden >= n) & ~copy[self.page] if len(self.page) else self.open
        parts: list[list[str]] = [[] for _ in range(self.count)]
        for b in np.flatnonzero(self.candidate & ~gone).tolist():
            parts[self.page[b]].append(self.texts[b])
        return ["\n".join(p) for p in parts], np.bincount(self.page, weights=hidden, minlength=self.count).astype(np.int64)


def suffix_array(tokens: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least `depth` tokens in the order of their first `depth` tokens, and the rank of each place in that order.

    `end`: where the text of each token ends; suffixes do not run over it. Prefix doubling stops at `depth` (a power of two): longer
    common prefixes cover nothing that these do not.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    place = np.arange(n)
    width = 1
    while width < depth:
        inside = place + width < end
        key = rank * (n + 1) + np.where(inside, rank[np.minimum(place + width, n - 1)], 0)
        order = np.argsort(key, kind="stable")
        ranks = np.cumsum(np.concatenate([[1], (key[order][1:] != key[order][:-1]).astype(np.int64)]))
        rank[order] = ranks
        width *= 2
    return order[order + depth <= end[order]], rank


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _shared_windows(large: DataFrame) -> DataFrame:
    """host, part, window: runs of LEAST words on distinct pages of a host, in each part that has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = batch.slice(low, 64)
                pages = Pages(rows.column("html").to_pylist())
                at, hashes = pages.windows()
                page = pages.word_page[at]
                take = pa.array(page)
                yield table_of(["host", "part", "window", "page"], [None, None, pa.int64(), pa.int64()],
                               [rows.column("host").take(take), rows.column("part").take(take), signed(hashes), signed(pages.digest[page])])

    found = large.select("host", "part", "html").mapInArrow(run, "host long, part int, window long, page long")
    least, most = F.min("page"), F.max("page")
    by_part = cut(found.groupBy("host", "part", "window").agg(least.alias("least"), most.alias("most")))
    repeated = cut(by_part.groupBy("host", "window").agg(F.min("least").alias("one"), F.max("most").alias("two"), F.count("*").alias("parts"))
                   .where((F.col("one") != F.col("two")) & (F.col("parts") > 1)).select("host", "window"))
    return by_part.select("host", "part", "window").join(repeated, ["host", "window"], "left_semi").select("host", "part", "window")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated of every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", F.xxhash64(host(F.col("url"))).alias("host"))
    sizes = rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > PART_BYTES)
    large = cut(sizes.select("host", F.ceil(F.col("bytes") / PART_BYTES).cast("int").alias("parts")))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("html", "page_id"), F.col("parts"))).otherwise(0).cast("int")
    placed = rows.join(large, "host", "left").withColumn("part", part).select("page_id", "url", "html", "host", "part", "parts")
    many = has_rows(large)
    shared = cut(_shared_windows(placed.where(F.col("parts").isNotNull()))) if many else None
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def texts(group: pa.Table, known: np.ndarray) -> pa.Table:
        found = Pages(group.column("html").to_pylist())
        text, repeated = found.main_texts(found.covered(known))
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(text, type=pa.string()),
                         "n_chars": pa.array([len(t) for t in text], type=pa.int64()), "n_repeated": pa.array(repeated, type=pa.int64())})

    schema = f"{kinds}, text string, n_chars long, n_repeated long"
    grouped = placed.drop("parts").groupBy("host", "part")
    if not many:
        return grouped.applyInArrow(lambda group: texts(group, np.zeros(0, np.uint64)), schema)

    def both(group: pa.Table, windows: pa.Table) -> pa.Table:
        known = windows.column("window").to_numpy().view(np.uint64)
        return texts(group, known) if group.num_rows else texts(group, known[:0])

    return grouped.cogroup(shared.groupBy("host", "part")).applyInArrow(both, schema)
