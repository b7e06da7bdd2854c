"""Language identification: averaged hashed subword embeddings with a linear softmax (operator 1).

A text is the mean of the embeddings of its subwords: runs of 3 and of 4 bytes of lower-cased words with a space on each side,
hashed into tables. A linear softmax on that mean gives the language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on whole documents and on random handfuls of their subwords, so that short texts are
covered. Scores are softened by a temperature and a rejection limit is set, both on documents that were not trained on.
After training the linear layer is applied to every embedding once: the mean of the products is the product of the mean.

The fit uses about PER_LANGUAGE labelled documents of each language (fewer if there are very many languages), chosen by a hash of
doc_id; prediction covers whole texts.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; without any labelled row all texts
are `und`; rows with null doc_id are never trained on; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.text import LOWER, Chunk, each_chunk, kind_of, table_of
from tallyspark.session import cut

#: Documents of each language, and of all languages together, that the fit may use, as expected numbers.
PER_LANGUAGE, ALL_LANGUAGES = 500, 4000
#: However many languages there are, of each so many documents are expected in the fit; a language with fewer is used in full.
LEAST_SAMPLE = 20
#: A language with fewer documents to train on takes them in turn up to this number in each epoch.
LEAST_VISITS = 20
BUCKETS, DIMENSIONS = 1 << 14, 16
EPOCHS, RATE, SHORT = 6, 8.0, 60
#: Share of right answers that those accepted on the held-back documents must reach.
PRECISION = 0.99
UNKNOWN = "und"

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_CLEAN = np.where(_LETTERS, np.arange(256), 32).astype(np.uint8)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def subwords(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword buckets of all texts, where each text's begin (one more entry), and whether each text has a letter."""
    data = LOWER[chunk.data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) else np.zeros(0, int)
    data[upper] += 0x20
    begins = chunk.offsets[:-1] + np.arange(len(chunk))
    spaced = np.insert(_CLEAN[data], chunk.offsets[:-1], 32)
    spaced = np.append(spaced, [32, 32, 32]).astype(np.uint32)
    hashed = spaced * _MULTIPLIERS[0]
    inside = spaced != 32
    grams, keep = [], []
    for n in (3, 4):
        h = hashed[:-3]
        for k in range(1, n):
            h = h + spaced[k:len(spaced) - 3 + k] * _MULTIPLIERS[k]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        grams.append((h >> np.uint32(18)).astype(np.int32) + (BUCKETS if n == 4 else 0))
        ok = inside[1:-2].copy()
        if n == 4:
            ok &= inside[2:-1]
        keep.append(ok)
    both, used = np.stack(grams, axis=1), np.stack(keep, axis=1)
    at = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    first = at[np.append(begins, len(used))]
    letters = first[1:] > first[:-1]
    for k in np.flatnonzero(letters):  # bytes over 127 may belong to signs
        raw = chunk.data[chunk.offsets[k]:chunk.offsets[k + 1]]
        if not ((LOWER[raw] >= 97) & (LOWER[raw] <= 122)).any():
            letters[k] = any(c.isalpha() for c in raw.tobytes().decode("utf-8"))
    return both[used], first, letters


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; empty runs are zero."""
    out = np.zeros((len(first) - 1, values.shape[1]), dtype=np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        mean = row_sums(self.table[grams], first) / np.maximum(np.diff(first), 1)[:, None]
        return softmax((mean + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], answers: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """bags: distinct subwords of a document and their counts."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (2 * BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    order = rng.permutation(len(bags))
    held = order[:len(order) // 5] if len(order) >= 20 else order
    train = order[len(order) // 5:] if len(order) >= 20 else order
    only = ~np.isin(answers[held], answers[train])  # all documents of a language held back: trained on instead
    train, held = np.concatenate([train, held[only]]), held[~only] if not only.all() else held
    visits = [train]
    for x, n in zip(*np.unique(answers[train], return_counts=True)):
        if n < LEAST_VISITS:
            visits.append(np.resize(train[answers[train] == x], LEAST_VISITS - n))
    train = np.concatenate(visits)

    def handful(k: int) -> tuple[np.ndarray, np.ndarray]:
        grams, counts = bags[k]
        pick = rng.choice(len(grams), size=min(len(grams), int(rng.integers(4, SHORT))), p=counts / counts.sum())
        return np.unique(grams[pick], return_counts=True)

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(train):
            for grams, counts in (bags[k], handful(k)):
                share = (counts / counts.sum()).astype(np.float32)
                mean = share @ embedding[grams]
                error = softmax((mean @ weight + bias)[None])[0].astype(np.float32)
                error[answers[k]] -= 1
                back = weight @ error
                weight -= 0.02 * rate * np.outer(mean, error)
                bias -= 0.005 * rate * error
                embedding[grams] -= rate * share[:, None] * back
    model = Model(languages, embedding @ weight, bias.astype(np.float64), 1.0, 0.0)
    calibrate(model, [x for k in held for x in (bags[k], handful(k))], np.repeat(answers[held], 2))
    return model


def calibrate(model: Model, bags: list, answers: np.ndarray) -> None:
    """Temperature of the least log loss; rejection limit that makes accepted answers precise enough."""
    logits = np.array([(c / c.sum()) @ model.table[g] for g, c in bags]) + model.bias
    right = np.arange(len(answers)), answers
    tries = np.geomspace(0.25, 16, 40)
    model.temperature = float(min(tries, key=lambda t: -np.log(softmax(logits / t)[right] + 1e-12).mean()))
    chance = softmax(logits / model.temperature)
    best = chance.max(axis=1)
    order = np.argsort(-best)
    precision = np.cumsum((chance.argmax(axis=1) == answers)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    model.least = float(best[order[good[-1]]]) if len(good) else 1.0


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a hash sample of the rows where `learn` holds and lang is not null."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    labelled = labelled.where(F.col("text").rlike("[A-Za-z\\x{80}-\\x{10FFFF}]"))  # others have nothing to learn from
    counted = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sorted(r["lang"] for r in counted.select("lang").collect())  # one row a language
    if not languages:
        return None
    per_language = max(min(per_language, ALL_LANGUAGES / len(languages)), LEAST_SAMPLE)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sampled = labelled.join(counted.withColumnRenamed("n", "rows_of_lang"), "lang").where(place < F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("rows_of_lang")))

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        grams, first, _ = subwords(chunk)
        bags = [np.unique(grams[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
        return table_of(["doc_id", "lang", "grams", "counts"], [None, None, pa.list_(pa.int32()), pa.list_(pa.int32())],
                        [chunk.ids, chunk.kept["lang"], [g for g, _ in bags], [c for _, c in bags]])

    sample = each_chunk(sampled, kernel, f"doc_id {kind_of(docs)}, lang string, grams array<int>, counts array<int>", keep=["lang"]).toArrow()
    rows = sorted(((i, k) for k, i in enumerate(sample.column("doc_id").to_pylist())))
    grams, uses, langs = sample.column("grams"), sample.column("counts"), sample.column("lang").to_pylist()
    bags, answers = [], []
    for _, k in rows:
        if len(grams[k].values):
            bags.append((grams[k].values.to_numpy(), uses[k].values.to_numpy().astype(np.float64)))
            answers.append(languages.index(langs[k]))
    return fit(bags, np.array(answers), languages) if bags else None


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, kept columns, lang_pred, score, rejected."""
    keep = keep or []

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        grams, first, letters = subwords(chunk)
        if model is None:
            best, top = np.zeros(len(chunk), int), np.zeros(len(chunk))
            letters = np.zeros(len(chunk), bool)
        else:
            chance = model.probabilities(grams, first)
            best, top = chance.argmax(axis=1), chance.max(axis=1)
        names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        score = np.where(letters, np.minimum(top, 1.0), 0.0)
        rejected = ~letters if model is None else ~letters | (score < model.least)
        return table_of(["doc_id", *keep, "lang_pred", "score", "rejected"], [None, *[None] * len(keep), pa.string(), pa.float64(), pa.bool_()],
                        [chunk.ids, *(chunk.kept[c] for c in keep), names, score, rejected])

    kinds = "".join(f", {c} {kind_of(docs, c)}" for c in keep)
    return each_chunk(docs, kernel, f"doc_id {kind_of(docs)}{kinds}, lang_pred string, score double, rejected boolean", keep=keep)
