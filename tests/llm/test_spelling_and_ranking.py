"""Spelling variants and ranked search against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import queries, ranking, spelling
from tests.llm.conftest import lowered

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_counts(rows, removed):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if removed and doc_id is not None and h % removed == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return n


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_variants(rows, removed, often):
    n = {w: c for w, c in plain_counts(rows, removed).items() if len(w) >= spelling.SHORTEST and c >= often}
    near = {w: [] for w in n}
    for a in n:
        for b in n:
            if a < b and abs(len(a) - len(b)) < 2 and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= spelling.RATIO * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def typo(rnd, word):
    k = rnd.randrange(len(word))
    return rnd.choice([word[:k] + word[k + 1:], word[:k] + rnd.choice("abcé") + word[k:], word[:k] + rnd.choice("abcé") + word[k + 1:]])


def spelled_rows(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(5, 9))) for _ in range(40)]
    base += ["a" * 8, "a" * 9, "ab" * 5, "ab" * 5 + "a", "z" * 70, "z" * 71, "abc" * 40, "abc" * 40 + "é"]
    texts = []
    for _ in range(220):
        words = []
        for _ in range(60):
            word = rnd.choice(base) if rnd.random() < 0.8 else rnd.choice(base[:6])
            while rnd.random() < 0.25:
                word = typo(rnd, word)
            words.append(word.upper() if rnd.random() < 0.1 else word.capitalize())
        texts.append(rnd.choice([" ", "-", "1", "’", "Ā"]).join(words))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("removed, often, meetings", [(199, 5, spelling.MEETINGS), (3, 2, 4), (None, 1, 30)])
def test_variants_against_all_pairs(spark, monkeypatch, removed, often, meetings):
    monkeypatch.setattr(spelling, "MEETINGS", meetings)
    rows = spelled_rows(removed or 7) + [(500, None), (501, ""), (None, "abcabcabc abcabcabd"), (3, "déjàvuu"), (3, "déjàvuu")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    want = plain_variants(rows, removed, often)
    got = {r["word"]: tuple(r) for r in spelling.variants(frame, removed, often).collect()}
    assert got == want
    assert any(v[1] for v in want.values()) and (often > 2 or any(v[2] not in (v[0], v[1]) for v in want.values()))


def test_words_are_counted_alike_in_small_pieces(spark, monkeypatch):
    rows = spelled_rows(5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "HELD", 200)
    want = {w: c for w, c in plain_counts(rows, 7).items() if len(w) >= spelling.SHORTEST}
    assert {r["word"]: r["n"] for r in spelling.word_counts(frame, 7, 1).collect()} == want


def test_pivots_are_the_rarest_disjoint_pair():
    rnd = random.Random(2)
    for _ in range(300):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(6, 14)))
        order = {x + y: k for k, (x, y) in enumerate(rnd.sample([(x, y) for x in "abc" for y in "abc"], 9))}
        places, last, (left, right) = spelling.prefix_and_pivots(word, order)
        weight = [order[word[i:i + 2]] for i in range(len(word) - 1)]
        assert places == [i for i, w in enumerate(weight) if w <= sorted(weight)[2]] and last == sorted(weight)[2]
        assert right - left >= 2
        assert weight[left] + weight[right] == min(weight[i] + weight[j] for i in places for j in places if j - i >= 2)


def test_odd_and_empty_tables_have_no_variants_of_note(spark, odd, none):
    got = {r["word"]: r["n"] for r in spelling.variants(odd).collect()}
    want = {w: c for w, c in plain_counts([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], 199).items() if len(w) >= 6 and c >= 5}
    assert got == want
    assert spelling.variants(none).count() == 0


def plain_search(docs, items, top=10):
    terms = [[t for t in TERM.findall(lowered(text))] for _, text in docs]
    some = [t for t in terms if t]
    n_docs, n_words = len(some), sum(map(len, some))
    df = Counter(t for ts in terms for t in set(ts))
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), ts in zip(docs, terms):
            if not ts:
                continue
            m = 100 - 90 + (90 * len(ts) * n_docs) // n_words
            tf = Counter(ts)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t in set(TERM.findall(lowered(text))) if tf[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return sorted(out, key=repr)


def searched(docs, items, **kw):
    return sorted((tuple(r) for r in ranking.search(docs, items, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search_against_plain_scores(spark, monkeypatch, small):
    if small:  # several tiles, strips and blocks
        for name, value in {"TILE_PAIRS": 40, "TILE_ITEMS": 3, "WIDTH": 3, "BLOCK": 30, "EXACT": 1 << 34}.items():
            monkeypatch.setattr(ranking, name, value)
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefé9") for _ in range(rnd.randint(1, 3))) for _ in range(120)]
    docs = [(i, rnd.choice(" ,_").join(rnd.choice(words).upper() if rnd.random() < 0.2 else words[int(rnd.random() ** 2 * 120)]
                                        for _ in range(rnd.choice([0, 1, 5, 30, 200])))) for i in range(160)]
    docs += [(900 + i, docs[7][1]) for i in range(15)] + [(7, docs[7][1]), (None, docs[7][1]), (950, None), (951, " - ")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))) for i in range(9)]
    items += [(20, None), (21, ""), (22, "zzzzzz"), (23, docs[7][1]), (23, docs[7][1]), (None, words[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x")).repartition(5)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("terms", F.lit(2))
    assert searched(frame, benchmark) == plain_search(docs, items)
    assert searched(frame, benchmark, top=3) == plain_search(docs, items, 3)


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "word word"), (2, None)], "item_id long, text string")
    assert ranking.search(none, items).count() == 0
    assert ranking.search(odd, items.where("item_id > 5")).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert searched(odd, items) == plain_search(rows, [(1, "word word"), (2, None)])


def test_the_registered_search_is_the_plain_one_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()
    got = sorted((tuple(r) for r in queries.QUERIES["op12_ranking"](spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == plain_search([tuple(r) for r in docs], [tuple(r) for r in items])


def test_the_registered_variants_are_the_plain_ones_on_the_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: tuple(r) for r in queries.QUERIES["op11_spelling"](spark, "/root/testdata/sf0.001").collect()}
    assert got == plain_variants(docs, 199, 5)
