"""Main text of pages: markup, repeated runs against a plain search for them, hosts in several parts, odd rows."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import extraction, queries

PAGE = "page_id long, url string, html string"


def text_of(source):
    return extraction.Pages([source]).main_texts(np.zeros(len(extraction.Pages([source]).words), dtype=bool))[0][0]


@pytest.mark.parametrize("source, want", [
    ("<p>a\n b&nbsp;&amp;&#x41; c</p>", "a b &A c"),
    ("<article><h1>T</h1><p><b>x<br><p>y</article><footer>f</footer>", "T\nx\ny"),
    ("<body><nav><a>m</a></nav><main><p>one<p>two</main><aside>s</aside>", "one\ntwo"),
    ("<main>m<article>a</article></main>", "a"),
    ("<div class='cookie-notice'>c</div><div class=post-content><header><h1>T</h1></header><p>x</p><div id=comments>r</div></div>", "T\nx"),
    ("<header>h</header><p>x</p><form>f<input></form><script>if (a<b) '</p>'</script><style>p{}</style>y", "x\ny"),
    ("<article><p class=notice>n<p>real</article>", "real"),
    ("<ul><li class=ad>x<li>y</ul>", "y"),
    ("<article class='comment'>c</article><article>a<article class=related>r</article></article>", "a"),
    ("<p title='a>b'>x</p><p title=don't>y</p><!-- <p>no</p> --><p>z</p><!-- <p>open", "x\ny\nz"),
    ("a < b <p>c</p><a href='", "a < b\nc"),
    ("<div hidden>h</div><div aria-hidden=true>h</div><div role=navigation>n</div><p>x", "x"),
    ("<body class='has-sidebar'><p>x</p><noscript>n</noscript><textarea>t</textarea><title>t</title>", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<script>never closed <p>x</p>", ""),
    (None, ""), ("", ""), ("plain", "plain"), ("&am &amp &lt;p&gt;", "&am & <p>"), ("</p></div>x", "x"),
    ("<!--><p>x</p>-->", "x\n-->"),
])
def test_markup(source, want):
    assert text_of(source) == want


def plain_covered(pages):
    """Places of words in runs of LEAST words that some different page has too."""
    k = extraction.LEAST
    seen = {}
    for words in pages:
        for i in range(len(words) - k + 1):
            seen.setdefault(tuple(words[i:i + k]), set()).add(tuple(words))
    out = []
    for words in pages:
        hit = [False] * len(words)
        for i in range(len(words) - k + 1):
            if len(seen[tuple(words[i:i + k])]) > 1:
                hit[i:i + k] = [True] * k
        out += hit
    return out


def test_repeated_runs_against_a_plain_search():
    rnd = random.Random(1)
    phrases = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(5, 14))] for _ in range(12)]
    pages = [[w for _ in range(rnd.randint(0, 6)) for w in rnd.choice(phrases)[rnd.randint(0, 2):]] for _ in range(60)]
    pages += [pages[3], pages[3], [], ["a"] * 40, ["a"] * 41]
    found = extraction.Pages(["<div>" + " ".join(p) + "</div>" for p in pages])
    assert found.covered(np.zeros(0, np.uint64)).tolist() == plain_covered(pages)


def unmarked_site(n, seed=3):
    """Pages without any mark of their article: a menu, a unique body, a notice and a foot."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    menu, foot = [word() for _ in range(12)], " ".join(word() for _ in range(11))
    notice = " ".join(word() for _ in range(20))
    rows, want = [], {}
    for i in range(n):
        body = [" ".join(word() for _ in range(rnd.randint(6, 40))) for _ in range(rnd.randint(1, 5))]
        source = "".join(f"<div><a>{m}</a></div>" for m in menu) + f"<div>{body[0]}</div><div>{notice}</div>"
        source += "".join(f"<p>{b}</p>" for b in body[1:]) + f"<div>{foot} {i}</div>"
        rows.append((i, f"https://Site.example:80/{i}", source))
        want[i] = "\n".join(body)
    return rows, want


@pytest.mark.parametrize("part_bytes", [extraction.PART_BYTES, 2000])
def test_boilerplate_without_marks_goes_by_repetition(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(extraction, "PART_BYTES", part_bytes)
    rows, want = unmarked_site(40)
    copies = [(100 + i, "http://copies.example/x", rows[5][2]) for i in range(6)]  # equal pages of a host: kept whole
    alone = [(200, "http://alone.example/", rows[6][2]), (201, None, rows[7][2]), (202, "no url", rows[7][2])]
    frame = spark.createDataFrame(rows + copies + alone, PAGE).withColumn("host", F.lit(1)).withColumn("part", F.lit("x")).withColumn("text", F.lit("y"))
    got = {r["page_id"]: r for r in extraction.extract(frame).collect()}
    assert {i: got[i]["text"] for i in want} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    whole = "\n".join(b for _, b in extraction.blocks(rows[5][2]))
    assert all(got[100 + i]["text"] == whole for i in range(6))
    assert got[200]["text"] == "\n".join(b for _, b in extraction.blocks(rows[6][2]))


def test_repeated_passages_and_near_copies_inside_marked_articles_stay(spark):
    rows, want = unmarked_site(12)
    passage = rows[0][2]
    marked = [(i, "https://m.example/a", f"<nav>{passage}</nav><article><h1>T{i}</h1>{passage}</article>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(marked, PAGE)).collect()}
    body = "\n".join(b for _, b in extraction.blocks(passage))
    assert got == {i: f"T{i}\n{body}" for i in range(5)}


def test_odd_rows(spark):
    long = "<article>" + "<p>" + "word " * 200000 + "</article>"
    rows = [(1, None, None), (1, None, None), (None, "http://h/", ""), (2, "http://h/", "<"), (3, "http://h/", long), (4, "x", "<a " * 5000), (5, "x", "<!--" * 5000),
            (6, "x", "<div>" * 3000 + "deep"), (7, "x", "<p>" * 3000 + "</b>" * 3000 + "p")]
    got = sorted(((r["page_id"], r["n_chars"], r["text"][:6]) for r in extraction.extract(spark.createDataFrame(rows, PAGE)).collect()), key=repr)
    assert got == sorted([(1, 0, ""), (1, 0, ""), (None, 0, ""), (2, 1, "<"), (3, 999999, "word w"), (4, 0, ""), (5, 0, ""), (6, 4, "deep"), (7, 1, "p")], key=repr)
    assert extraction.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_the_registered_query_gives_the_articles_of_the_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op13_extraction"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?(b|br)>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert got[row["page_id"]] == "\n".join(p for p in parts if p)
