"""Operators on texts against plain forms, on small tables and on the smallest test data."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyspark.llm import language, licenses, media, minhash, mixing, pieces, scoring, substrings, toxicity
from tests.llm.conftest import ALNUM, ODD_TEXTS, SPACE, lowered, prose, remainder

ROWS = len(ODD_TEXTS) + 3


def made(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# 5: pieces

@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def tricky_texts():
    rnd = random.Random(4)
    v = pieces.vocabulary(pieces.default_model())
    texts = ["".join(rnd.choice(" ▁aehinrst\n\t.,é漢字😀AB012<>_-") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rnd.choice(" ab") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    texts += ["".join(rnd.choice(v.text[3:]) for _ in range(rnd.randint(0, 10))) for _ in range(400)]
    texts += [" " * k + x + " " * j for k in range(36) for j in (0, 1, 15, 33) for x in ("", "the", "漢", "=")]
    return texts + ["x" * 3000, "ab" * 2000, "é" * 2000, "\x00", "<s></s><unk><0x41>"]


def test_pieces_equal_the_library(spark, model):
    texts = [None, *tricky_texts()]
    got = by_id(pieces.encode_texts(made(spark, texts)))
    back = by_id(pieces.decode_ids(pieces.encode_texts(made(spark, texts))))
    digest = by_id(pieces.round_trip(made(spark, texts)))
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert got[i]["ids"] == ids, repr(t)
        assert back[i]["text"] == model.decode(ids)
        assert digest[i]["n_tokens"] == len(ids)
        assert digest[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_decoding_repairs_bytes_that_are_no_text(model):
    v = pieces.vocabulary(pieces.default_model())
    ids = [int(v.byte_ids[0xE2]), int(v.byte_ids[0x41]), 4000, int(v.byte_ids[0x82])]
    assert v.decode(np.array(ids)).decode() == model.decode(ids)


def test_pieces_survive_a_full_cache(spark, model, monkeypatch):
    v = pieces.Vocabulary(pieces.default_model())
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 5)
    data = np.frombuffer(b" a bc def ghij a bc klm nop", dtype=np.uint8)
    starts = np.flatnonzero(data == 32)
    for _ in range(3):
        ids, _ = v.encode_spans(data, starts, np.append(starts[1:], len(data)))
        assert ids.tolist() == model.encode("a bc def ghij a bc klm nop")


# 9: media

def test_media_round_trip(spark, odd):
    texts = [*ODD_TEXTS, "x" * 64, "ÿ" * 3000]
    for i, r in by_id(media.store_and_read(made(spark, texts))).items():
        body = (texts[i] or "").encode()
        body_padded = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(body_padded))
        assert r["payload_sha256"] == hashlib.sha256(body_padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(body_padded[-64:])
    assert media.store_and_read(odd).count() == ROWS


def test_frames_are_ordinary_baseline_jpeg():
    samples = np.random.default_rng(0).integers(0, 256, (3, media.SAMPLES)).astype(np.uint8)
    for row, frame in zip(samples, media.code_frames(samples)):
        assert (media.block_levels(media.decode_baseline(frame)) == row).all()
        assert (media.decode_frames([frame])[0] == row).all()


def test_clips_cover_the_film(spark):
    films = media.media_table(made(spark, ["a" * 5000 + "\x7f" * 5000 + "a" * 3000, None]))
    rows = sorted(tuple(r)[:4] for r in media.clips(films).collect())
    assert rows == [(0, 0, 0, 5), (0, 1, 5, 5), (0, 2, 10, 3), (1, 0, 0, 1)]
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF\0\0\0\0WAVE")


# 7: mixing

def test_mixing_meets_targets_and_never_doubles_twice(spark, odd, none):
    docs = made(spark, [prose(i, 5 + i % 60) for i in range(600)])
    rows = mixing.mix(docs).collect()
    assert sorted(r["taken"] for r in rows) == sorted(r["taken"] for r in mixing.mix(docs.repartition(5)).collect())
    sizes = {}
    for r in rows:
        sizes.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    for source, weight in zip(sorted(sizes), (3, 1, 2)):
        target = min(weight / 6 * 1.5 * total, 2 * sum(r["size"] for r in sizes[source]))
        if weight == 3:
            assert sizes[source][0]["target"] == pytest.approx(target)
        taken = sum(r["taken"] for r in sizes[source])
        assert abs(taken - sizes[source][0]["target"]) <= 40
    assert sum(g[0]["target"] for g in sizes.values()) == pytest.approx(1.5 * total)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mixing.mix(odd).count() == ROWS
    assert mixing.mix(none).count() == 0


def plain_mix(rows):
    """Targets by resharing in a loop, and copies by hashes in order: rows of (source, hash, size)."""
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(r[2] for r in rows if r[0] == s) for s in sources}
    total, target, free = 1.5 * sum(size.values()), {}, set(sources)
    while free:
        share = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > 2 * size[s]}
        for s in full or free:
            target[s] = 2.0 * size[s] if s in full else weight[s] * share
        free -= full or free
    copies = {}
    for s in sources:
        whole, rest = divmod(target[s], size[s]) if size[s] else (0, 0)
        below, limit, own = 0, 0, sorted({r[1] for r in rows if r[0] == s and r[2]})
        for h in own if rest > 1e-9 else []:
            upto = below + sum(r[2] for r in rows if r[0] == s and r[1] == h)
            if upto > rest:
                limit = h + 1 if abs(upto - rest) < abs(below - rest) else h
                break
            below = upto
        copies[s] = (int(whole), limit)
    return target, copies


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_against_a_plain_resharing_and_thresholds(spark, seed):
    rnd = random.Random(seed)
    names = [None, "", "a", "b", "B", "é", "c", "d"][:3 + seed * 2]
    rows = [(rnd.randrange(400), "w " * rnd.choice([0, 1, 3, 9, 40, 900 if rnd.random() < 0.02 else 5]), rnd.choice(names[:2] + names)) for _ in range(500)]
    docs = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string, source string")
    got = [(r["source"], r["hash"], r["size"], r["target"], r["copies"], r["taken"]) for r in mixing.mix(docs).collect()]
    target, copies = plain_mix([g[:3] for g in got])
    for source, h, size, aim, n, taken in got:
        whole, limit = copies[source]
        assert aim == pytest.approx(target[source]) and n == whole + (h < limit) and taken == n * size


def test_a_small_source_is_doubled_and_its_excess_reshared(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a"] + ["b"] * 50 + [None] * 50)], "doc_id long, text string, source string")
    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert target["a"] == 20
    assert target[None] == pytest.approx(2 * target["b"])
    assert sum(target.values()) == pytest.approx(1.5 * 1010)


# 1: language, 4: toxicity

def test_language_on_held_out_texts(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    fitted = language.train(docs, learn)
    held = language.predict(docs.where(~learn), fitted).join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    odd_rows = language.predict(odd, fitted).collect()
    assert len(odd_rows) == ROWS
    for r in odd_rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (0, 1, 2, 4):
            assert r["lang_pred"] == "und" and r["rejected"]
        if r["doc_id"] in (3, 6):
            assert r["lang_pred"] in fitted.languages
    assert language.train(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, fitted).count() == 0


def test_a_language_of_a_single_document_is_learned(spark):
    rows = [(i, prose(i, 40, "abcdefghij" if i % 2 else "klmnopqrst"), "aa" if i % 2 else "bb") for i in range(60)]
    for rare in range(60, 66):  # whichever documents are held back
        frame = spark.createDataFrame([*rows, (rare, prose(rare, 40, "uvwxyz"), "rare"), (99, "12 !!", "digits")], "doc_id long, text string, lang string")
        fitted = language.train(frame, F.lit(True))
        assert fitted.languages == ["aa", "bb", "rare"]
        got = {r["doc_id"]: r["lang_pred"] for r in language.predict(frame, fitted).collect()}
        assert got == {i: x for i, _, x in rows} | {rare: "rare", 99: "und"}


def test_toxicity_on_held_out_texts(spark, odd, none, labels):
    folder = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    fitted = toxicity.train(docs, marks, learn)
    held = toxicity.score(docs.join(marks.where(~learn), "doc_id", "left_semi"), fitted).join(marks, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in held)
    assert toxicity.score(odd, fitted).count() == ROWS
    assert toxicity.score(none, fitted).count() == 0
    assert toxicity.train(none, labels.limit(0), F.lit(True)).score(np.zeros((1, 16))).tolist() == [0.0]
    small = toxicity.train(odd, labels, F.lit(True))
    assert toxicity.score(odd, small).count() == ROWS
    kept = toxicity.keep_clean(odd, fitted)
    assert kept.columns == odd.columns and kept.count() == ROWS


def test_isotonic_is_the_monotone_mean():
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4) * 1e6)
    assert np.interp([1, 2, 3, 4], knots, values) == pytest.approx([0, 0.5, 0.5, 1], abs=1e-5)


# 2: licenses

def base_places(text):
    words = ALNUM.findall(lowered(text))
    places = sorted(i for phrase in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
    found = {label for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()}
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(found))


def plain_template_spans(text, template):
    """(first word, last word, coverage) of the matches of one long template, by comparing all grams."""
    k = licenses.LONG_GRAM
    words, of = ALNUM.findall(lowered(text)), ALNUM.findall(lowered(template))
    n = len(of) - k + 1
    votes = {}
    for i in range(len(words) - k + 1):
        for p in range(n):
            if words[i:i + k] == of[p:p + k]:
                votes.setdefault(i - p, set()).add(p)
    groups, last = [], None
    for diagonal in sorted(votes):
        if last is None or diagonal - last > licenses.MERGE_DISTANCE:
            groups.append((diagonal, diagonal, set()))
        low, _, places = groups[-1]
        groups[-1] = (low, diagonal, places | votes[diagonal])
        last = diagonal
    return sorted((max(low + min(places), 0), high + max(places) + k - 1, len(places) / n) for low, high, places in groups if len(places) / n >= licenses.COVERAGE)


def test_long_templates_against_all_grams(spark):
    rnd = random.Random(6)
    templates = [t for t in licenses.TEMPLATES if len(ALNUM.findall(lowered(t))) > licenses.PHRASE_WORDS]
    texts = []
    for _ in range(240):
        words = prose(rnd.random(), rnd.randint(0, 12)).split()
        for _ in range(rnd.randint(1, 3)):
            piece = rnd.choice(templates).upper().split() if rnd.random() < 0.3 else rnd.choice(templates).split()
            a = rnd.randint(0, len(piece) // 3)
            piece = piece[a:rnd.randint(len(piece) // 2, len(piece))]
            for _ in range(rnd.randint(0, 2)):  # words changed, dropped and added
                at = rnd.randrange(max(len(piece), 1))
                piece[at:at + 1] = rnd.choice([[], ["other"], piece[at:at + 1] + ["more"]])
            words += piece + prose(rnd.random(), rnd.randint(0, 8)).split()
        texts.append(" ".join(words))
    found = {}
    number = {t: k for k, t in enumerate([*licenses.BASE, *licenses.TEMPLATES])}
    for r in licenses.matches(made(spark, texts).withColumn("key", F.xxhash64("text"))).collect():
        found.setdefault((r["doc_id"], r["template"]), []).append((r["first_word"], r["last_word"], r["coverage"]))
    hits = 0
    for i, text in enumerate(texts):
        for t in templates:
            want = plain_template_spans(text, t)
            assert sorted(found.get((i, number[t]), [])) == [(a, b, pytest.approx(c)) for a, b, c in want], (i, t)
            hits += len(want)
    assert hits > 50


def test_license_places(spark, odd, none):
    bits = ["MIT License", "mit", "License", "CC-BY", "cc by", "Apache License", "GNU General Public License", "general public", "x", "\n", "é"]
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["MIT License MIT License", None, ""]
    texts.append("Permission is hereby granted, free of charge, to ANY big person obtaining a copy of this software and associated docs "
                 "files (the Software), to deal in the Software without restriction")
    texts += [texts[0], texts[0]]
    got = by_id(licenses.scan(made(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[203]["labels"] == "mit" and 0.6 <= got[203]["score"] < 1
    again = licenses.scan(made(spark, texts).union(made(spark, texts).where("doc_id = 0"))).where("doc_id = 0").collect()
    assert len(again) == 2 and again[0] == again[1] and again[0]["n_base"] == got[0]["n_base"]
    assert licenses.scan(odd).count() == ROWS
    assert licenses.scan(none).count() == 0


# 3: scoring

def test_scores_of_words_and_of_the_model(spark, odd, none):
    import math
    from collections import Counter
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    keep = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    fitted, counts = scoring.train(docs, keep)
    got = by_id(scoring.score(docs, fitted, counts, []))
    sequences = {r["doc_id"]: [*SPACE.findall(lowered(r["text"])), None] for r in docs.collect()}
    seen = Counter(w for i, s in sequences.items() if remainder(i, 7) != 2 for w in s)
    all_of_them = sum(seen.values())
    for i, s in sequences.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s), sum(w in seen for w in s), all_of_them)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (all_of_them + len(seen) + 1)) for w in s))
        assert r["score"] < 0
    assert scoring.score(odd, fitted, counts, []).count() == ROWS
    assert scoring.score(none, fitted, counts, []).count() == 0
    untrained, nothing = scoring.train(none, F.lit(True))
    assert {r["train_tokens"] for r in scoring.score(odd, untrained, nothing, []).collect()} == {0}


def test_word_counts_do_not_depend_on_the_frequent_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    want = None
    for size in (1 << 17, 50, 0):
        monkeypatch.setattr(scoring, "FREQUENT", size)
        fitted, counts = scoring.train(docs, F.lit(True))
        got = {i: (r["n_known"], round(r["base_score"], 6)) for i, r in by_id(scoring.score(docs, fitted, counts, [])).items()}
        want = want or got
        assert got == want


def test_every_id_is_scored_once_with_its_context():
    for n in (1, 2, 23, 24, 25, 43, 44, 45, 55, 56, 57, 200):
        row, begin, scored = scoring.windows_of(np.array([0, n]))
        seen = [p for b, s in zip(begin, scored) for p in range(b, min(b + scoring.CONTEXT, n)) if p >= s]
        assert sorted(seen) == list(range(n))


def test_windows_and_classes_are_not_made_smaller():
    _, begin, scored = scoring.windows_of(np.array([0, 500]))
    assert begin[1] == 24 and (scored - begin)[1:].min() == 8 and scoring.CONTEXT == 32  # 8 to 31 ids before every later id
    for n in (31, 32, 33):
        _, begin, scored = scoring.windows_of(np.array([0, n]))
        assert sorted(p for b, s in zip(begin, scored) for p in range(b, min(b + 32, n)) if p >= s) == list(range(n))
    coding = scoring.Coding.of(np.append(np.arange(3000, 0, -1.0), 50))
    sizes = np.bincount(coding.output)
    assert (sizes[1:127] == 1).all() and len(sizes) == scoring.CLASSES == 1 + 126 + 32


def test_every_training_text_and_copy_counts(spark):
    path = pieces.default_model()
    start, coding = scoring.new_weights(), scoring.Coding.of(np.ones(pieces.vocabulary(path).size + 1))
    texts = [prose(i, 60) for i in range(4)]

    def trained(*chosen):
        return scoring._flat(scoring._train_everywhere(made(spark, chosen), 100, start, coding, path))

    alone = [trained(t) for t in texts]
    assert not any(np.array_equal(w, scoring._flat(start)) for w in alone)
    even, uneven = trained(texts[0], texts[1]), trained(*[texts[0]] * 200, texts[1])
    assert np.abs(uneven - alone[0]).max() < np.abs(even - alone[0]).max()


@pytest.mark.parametrize("shard_ids", [1 << 22, 300])
def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch, shard_ids):
    monkeypatch.setattr(scoring, "SHARD_IDS", shard_ids)
    monkeypatch.setattr(scoring, "PARTS", 2)
    monkeypatch.setattr(scoring, "FAN", 3)
    docs = made(spark, [prose(i % 25, 40 + i) for i in range(40)] + [None, ""])
    results = []
    for frame in (docs.coalesce(1), docs.repartition(8), docs.orderBy(F.desc("doc_id")).repartition(3)):
        fitted, counts = scoring.train(frame, F.lit(True))
        results.append({i: r["score"] for i, r in by_id(scoring.score(frame, fitted, counts, [])).items()})
    for other in results[1:]:
        assert all(other[i] == pytest.approx(results[0][i], rel=1e-6) for i in results[0])


def test_steps_follow_the_gradient():
    """The step's gradient against differences of the weighted loss."""
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in scoring.new_weights().items()}
    tokens, output = rng.integers(0, 300, (3, scoring.CONTEXT)), rng.integers(0, scoring.CLASSES, (3, scoring.CONTEXT))
    use, weight = rng.random((3, scoring.CONTEXT)) < 0.7, np.array([1.0, 5.0, 2.0])

    def loss(w):
        return -log_chances(w, tokens)[use, output[use]] @ np.repeat(weight, use.sum(axis=1)) / np.repeat(weight, use.sum(axis=1)).sum()

    class Keep(scoring.Adam):
        def _apply(self, gradient, rate):
            self.gradient = gradient

    fit = Keep({k: v.astype(np.float32) for k, v in w.items()})
    fit.step(tokens, output, use, weight, 1.0)
    for name, g in fit.gradient.items():
        for _ in range(4):
            at = np.unravel_index(np.argmax(np.abs(g)) if _ == 0 else rng.integers(g.size), g.shape)
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-5), (name, at)


def log_chances(w, tokens):
    """Plain causal self-attention: natural logarithms of all classes at every place."""
    x = w["symbol"][tokens] + w["place"]
    q, k, v = np.split(x @ w["qkv"], 3, axis=2)
    a = q @ k.transpose(0, 2, 1) / np.sqrt(scoring.WIDTH)
    a = np.where(np.tril(np.ones(a.shape[1:])) > 0, a, -np.inf)
    a = np.exp(a - a.max(axis=2, keepdims=True))
    a /= a.sum(axis=2, keepdims=True)
    logits = (x + a @ v @ w["mixed"]) @ w["out"] + w["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))


def test_every_id_is_trained_on_once():
    class Recorder:
        places = []

        def step(self, tokens, output, use, weight, rate):
            self.places += output[use].tolist()

    ids, first = np.arange(3, 700), np.array([0, 1, 1, 40, 697])
    coding = scoring.Coding(np.zeros(700, int), np.arange(700), np.zeros(700))
    assert scoring._one_pass(Recorder(), scoring.Texts(ids, first, coding), np.ones(4, int), np.random.default_rng(0)) == len(ids) + 4
    assert sorted(Recorder.places) == [*ids.tolist(), *[699] * 4]  # 699: the end


def test_the_model_is_causal_and_sums_to_one():
    w = scoring.new_weights()
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 500, (2, scoring.CONTEXT))
    other = tokens.copy()
    other[:, 15:] = rng.integers(0, 500, (2, scoring.CONTEXT - 15))
    a, b = scoring._forward(w, tokens)[0], scoring._forward(w, other)[0]
    assert np.allclose(a[:, :15], b[:, :15]) and not np.allclose(a[:, 15:], b[:, 15:])
    use = np.ones(tokens.shape, dtype=bool)
    slow = log_chances(w, tokens).reshape(-1, scoring.CLASSES)
    assert np.allclose(np.exp(slow).sum(axis=1), 1, atol=1e-4)
    output = rng.integers(0, scoring.CLASSES, tokens.size)
    assert np.allclose(scoring.Scorer(w).log_chances(tokens, use, output), slow[np.arange(tokens.size), output], atol=1e-4)
    coding = scoring.Coding.of(rng.integers(0, 50, 3001).astype(float))
    assert np.allclose(np.bincount(coding.output, 10 ** coding.within), 1)


# 8: substrings

def removed(texts, window):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        w = SPACE.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            piece = tuple(w[k:k + window])
            if seen.setdefault(piece, i) < i:
                gone[k:k + window] = [True] * window
        out[i] = [x for x, g in zip(w, gone) if not g], len(w)
    return out


def passages(seed):
    rnd = random.Random(seed)
    shared = [prose(100 + k, rnd.randint(40, 160)).split() for k in range(12)]
    texts = []
    for i in range(150):
        body = prose(i, rnd.randint(0, 120)).split()
        for _ in range(rnd.randint(0, 4)):
            part = rnd.choice(shared)
            a, b = sorted((rnd.randint(0, len(part)), rnd.randint(0, len(part))))
            at = rnd.randint(0, len(body))
            body[at:at] = part[a:b]
        texts.append("  ".join(body))
    return texts + texts[:20] + ["for " * 300, "x for " * 200, "for " * 200 + "end"]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_all_windows(spark, seed):
    texts = passages(seed)
    want = removed(texts, substrings.WINDOW)
    for i, r in by_id(substrings.digests(made(spark, texts))).items():
        kept, n = want[i]
        assert (r["n_words"], r["n_removed"]) == (n, n - len(kept))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_documents_are_parsed_into_factors(spark):
    """Long copies are one factor each, with the reference they come from; every factor is what it says."""
    long, other = prose(70, 400).split(), prose(71, 300).split()
    texts = [long, other, prose(72, 30).split() + long[50:350] + prose(73, 20).split() + other[10:200],
             long[:200] + other[100:], long[20:45] + prose(74, 60).split()]
    rows = [" ".join(t) for t in texts]
    got = sorted((r["doc_id"], r["start"], r["words"], r["reference"], r["reference_start"]) for r in substrings.factors(made(spark, rows)).collect())
    for doc, start, words, reference, begin in got:
        assert reference < doc and words >= substrings.WINDOW and texts[doc][start:start + words] == texts[reference][begin:begin + words]
    assert {g[0] for g in got} == {2, 3}
    # only blocks cut by a factor's ends are left to single windows: a factor misses less than a window at each end
    assert [(g[0], g[3]) for g in got] == [(2, 0), (2, 1), (3, 0), (3, 1)]
    assert all(words > whole - 2 * substrings.WINDOW for (_, _, words, _, _), whole in zip(got, (300, 190, 200, 200)))


def test_substrings_of_odd_rows(spark, odd, none):
    rows = substrings.digests(odd).collect()
    assert len(rows) == ROWS
    gone = {r["doc_id"]: r["n_removed"] for r in rows if r["doc_id"] is not None}
    assert gone[9] == 3000 and sum(gone.values()) == 3000  # of two equal rows and their copy, the copy goes
    assert substrings.digests(none).count() == 0


# 10: near-duplicates

def groups(texts, k, percent):
    sets = []
    for t in texts:
        w = SPACE.findall(lowered(t))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and sets[j] and 100 * same >= percent * (len(a) + len(sets[j]) - same):
                p, q = sorted((find(i), find(j)))
                label[q] = p
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(seed, n):
    rnd = random.Random(seed)
    base = [prose(k, 120).split() for k in range(4)]
    texts = []
    for _ in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 9])):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(60)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, percent):
    texts = edited(k, 220) + ["One Two", "one two", "one", None, "", " ", "a b c", "A b  c"]
    want = groups(texts, k, percent)
    for i, r in by_id(minhash.near_duplicates(made(spark, texts), k, percent)).items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[i], want[i][1] == i)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    texts = edited(9, 150)
    got = by_id(minhash.near_duplicates(made(spark, texts), 3, 85))
    assert [got[i]["component_id"] for i in range(len(texts))] == [c for _, c in groups(texts, 3, 85)]


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == ROWS
    found = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert found[5] == 3 and found[9] == 8 and found[0] == 0
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(none).count() == 0
