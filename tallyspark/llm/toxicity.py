"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression (operator 4).

Features of a text are densities: hits of a word list and of a lexicon that is learned from the labels (whole words and
word beginnings, so that endings do not matter), second-person words and hits close to them, capitals, punctuation, digits or
signs inside words, and stretched letters. The trees, the lexicon limits and the calibration come from numpy code here.

The fit uses at most PER_CLASS toxic and twice as many clean labelled rows, those with the smallest hash of doc_id, in FOLDS parts. The
features of a part come from a lexicon that the other parts teach (counted by Spark), so the trees see words as they will see
those of new texts, and the calibration takes each part's margins from trees that the other parts teach. The lexicon and
the trees that are kept use all of these rows. Scores are calibrated to the share of each class among all rows to learn from.

Defined results: null and empty texts have all features zero and are scored like any other; without labelled rows of both
classes every score is the share of toxic ones (0 without labels); rows with null doc_id are scored but not learned from;
of rows that repeat a doc_id all are scored and one is learned from;
repeated label rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.text import ALPHANUMERIC, LOWER, Chunk, chunks, each_chunk, kind_of, signed, span_hashes, table_of, words
from tallyspark.session import cut

#: Most toxic rows that the fit may use; it takes up to twice as many clean ones.
PER_CLASS = 2500
#: Parts of these rows; each is described by a lexicon, and calibrated by trees, that the others teach.
FOLDS = 4
#: Lengths in bytes of the word beginnings that the lexicon may hold.
PREFIXES = (4, 5, 6)
#: Most lexicon entries, and the least log-likelihood ratio of an entry's counts against the share of toxic rows in the sample.
LEXICON_ENTRIES, LEAST_EVIDENCE = 20_000, 12.0
NEAR = 3
TREES, DEPTH, SHRINK, BIN_COUNT, LEAST_WEIGHT = 80, 3, 0.2, 32, 4.0

# Common insults, and second-person words, in English, German, French and Spanish.
INSULTS = ("idiot idiots stupid moron loser scum trash pathetic worthless disgusting clown dumb fool jerk hate kill shut ugly liar "
           "dumm dummkopf trottel depp arschloch abschaum versager widerlich idiotin con connard connasse salaud imbecile ordure minable "
           "tonto tonta estupido estupida idiota imbecil basura payaso asqueroso patetico inutil")
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deiner deinen euch euer ihr sie "
                 "tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro")

_SIGNS = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"01345$@7", b"oieassat"):
    _SIGNS[_a] = _b
_FOLDED = _SIGNS[LOWER]
_WORD = ALPHANUMERIC.copy()
_WORD[list(b"$@")] = True
FEATURES = ["learned", "learned_log", "learned_weight", "learned_distinct", "listed", "listed_near_you", "learned_near_you", "you",
            "capitals", "shouted", "exclaimed", "asked", "punctuation", "mixed", "stretched", "log_words"]


def _hash_list(listed: str) -> np.ndarray:
    data = np.frombuffer(listed.encode(), dtype=np.uint8)
    data = _FOLDED[data]
    starts = np.flatnonzero((data != 32) & (np.concatenate([[32], data[:-1]]) == 32))
    ends = np.append(starts[1:] - 1, len(data))
    return np.unique(span_hashes(data, starts, ends, _WORD))


class Words:
    """Folded words of a chunk (signs read as letters), with hashes of their beginnings."""

    def __init__(self, chunk: Chunk):
        self.data = _FOLDED[chunk.data]
        self.starts, self.ends, self.first = words(chunk, _WORD, chunk.data if not len(chunk.data) else LOWER[chunk.data])
        self.whole = span_hashes(self.data, self.starts, self.ends, _WORD) if len(self.starts) else np.zeros(0, np.uint64)

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than n bytes, and hashes of their first n bytes."""
        at = np.flatnonzero(self.ends - self.starts > n)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        body = self.data[self.starts[at][:, None] + np.arange(n)].ravel()
        begin = np.arange(len(at)) * n
        return at, span_hashes(body, begin, begin + n)


def _found(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value among sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(values), -1)
    k = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[k] == values, k, -1)


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def features(chunk: Chunk, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of FEATURES per text; `lexicon`: sorted hashes and their weights."""
    w = Words(chunk)
    n = np.diff(w.first)
    many = np.maximum(n, 1)
    hit = _found(lexicon[0], w.whole)
    for size in PREFIXES:
        at, h = w.beginnings(size)
        k = _found(lexicon[0], h)
        hit[at] = np.where(hit[at] >= 0, hit[at], k)
    learned = hit >= 0
    weight = np.where(learned, lexicon[1][hit] if len(lexicon[1]) else 0.0, 0.0)
    row = np.repeat(np.arange(len(chunk)), n)
    pairs = np.unique(row[learned] * (len(lexicon[0]) + 1) + hit[learned]) // (len(lexicon[0]) + 1)
    listed = _found(_INSULT_HASHES, w.whole) >= 0
    you = _found(_YOU_HASHES, w.whole) >= 0
    near = np.zeros(len(you), dtype=bool)
    for d in range(1, NEAR + 1):
        same = row[d:] == row[:-d]
        near[d:] |= you[:-d] & same
        near[:-d] |= you[d:] & same
    data, ends = chunk.data, chunk.offsets
    size = np.maximum(np.diff(ends), 1)
    small, capital = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~small & ~capital & ~digit
    letters = _per_row(small, ends) + _per_row(capital, ends)
    length = w.ends - w.starts

    def in_word(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return total[w.ends] - total[w.starts]

    capitals, others = in_word(capital), in_word(digit | (data == 36) | (data == 64))
    alike = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        alike[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (small | capital)[2:]
    return np.stack([
        _per_row(learned, w.first) / many, np.log1p(_per_row(learned, w.first)), _per_row(weight, w.first) / many,
        np.bincount(pairs, minlength=len(chunk)), _per_row(listed, w.first) / many, _per_row(listed & near, w.first) / many,
        _per_row(learned & near, w.first) / many, _per_row(you, w.first) / many, _per_row(capital, ends) / np.maximum(letters, 1),
        _per_row((capitals == length) & (length > 1), w.first) / many, _per_row(data == 33, ends) / size, _per_row(data == 63, ends) / size,
        _per_row(mark, ends) / size, _per_row((others > 0) & (others < length), w.first) / many,
        _per_row(in_word(alike) > 0, w.first) / many, np.log1p(n)], axis=1)


_INSULT_HASHES, _YOU_HASHES = _hash_list(INSULTS), _hash_list(SECOND_PERSON)


@dataclass
class Trees:
    """Boosted trees of fixed depth: per tree and inner node a feature and a limit, per leaf a value."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2 ** DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the log loss on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BIN_COUNT + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    inner, width = 2 ** DEPTH - 1, BIN_COUNT + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(share / (1 - share))), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)))
    margin = np.full(len(y), out.start)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            low, count = 2 ** level - 1, 2 ** level
            best = np.full(count, 1e-6)
            cut_bin = np.full(count, width)
            for f in range(x.shape[1]):
                cell = (node - low) * width + bins[:, f]
                g = np.bincount(cell, gradient, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(cell, weight, count * width).reshape(count, width).cumsum(axis=1)
                gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl ** 2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga ** 2 / (ha + 1)
                gain[(hl < LEAST_WEIGHT / 4) | (ha - hl < LEAST_WEIGHT / 4)] = 0
                gain = gain[:, :len(edges[f])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                better = gain[np.arange(count), k] > best
                best = np.where(better, gain[np.arange(count), k], best)
                cut_bin = np.where(better, k, cut_bin)
                out.feature[tree, low:low + count] = np.where(better, f, out.feature[tree, low:low + count])
            for j in range(count):
                if cut_bin[j] < width:
                    out.limit[tree, low + j] = edges[out.feature[tree, low + j]][cut_bin[j]]
            chosen = out.feature[tree, node]
            node = 2 * node + 1 + (x[np.arange(len(y)), chosen] > out.limit[tree, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        out.leaf[tree] = SHRINK * g / (h + 1)
        margin += out.leaf[tree, leaf]
    return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising function from x to y (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order]):
        blocks.append([b * w, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w1, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w1, blocks[-1][2], hi]
    knots = [(e, (s + 0.5 * (s / w if w else 0)) / (w + 0.5)) for s, w, lo, hi in blocks for e in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    share: float
    lexicon: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        margin = self.trees.margin(x)
        # a touch of the margin keeps the order of texts on one step of the calibration
        return np.clip(0.998 * np.interp(margin, *self.knots) + 0.002 / (1 + np.exp(-margin)), 0.0, 1.0)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, toxic, fold of at most three times per_class label rows, hence the broadcasts.

    Of a doc_id with several texts the smallest one counts. Its fold comes from a hash of doc_id.
    """
    by_hash = [F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), "doc_id"]
    chosen = [labels.where(F.col("toxic") == k).select("doc_id", "toxic").orderBy(*by_hash).limit(per_class * (2 - k)) for k in (0, 1)]
    rows = cut(chosen[0].union(chosen[1]))
    texts = docs.select("doc_id", "text").join(F.broadcast(rows.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(rows), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))


def _lexicon(sample: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and word beginnings that toxic texts hold clearly more often; at most LEXICON_ENTRIES of them."""

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        w = Words(chunk)
        row = np.repeat(np.arange(len(chunk)), np.diff(w.first))
        rows, hashes = [row], [w.whole]
        for n in PREFIXES:
            at, h = w.beginnings(n)
            rows.append(row[at])
            hashes.append(h)
        rows, hashes = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        toxic = chunk.kept["toxic"].to_numpy(zero_copy_only=False)[rows[new]]
        keys, inverse = np.unique(hashes[new], return_inverse=True)
        return table_of(["hash", "toxic", "clean"], [pa.int64(), pa.int64(), pa.int64()],
                        [signed(keys), np.bincount(inverse, toxic == 1, len(keys)).astype(np.int64), np.bincount(inverse, toxic == 0, len(keys)).astype(np.int64)])

    counted = each_chunk(sample, kernel, "hash long, toxic long, clean long", keep=["toxic"]).groupBy("hash").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = F.col("toxic"), F.col("clean")
    of = toxic + clean
    evidence = toxic * F.log(toxic / (of * F.lit(share))) + F.when(clean > 0, clean * F.log(clean / (of * F.lit(1 - share)))).otherwise(0.0)
    top = (counted.where(toxic * F.lit(1 - share) > 8 * clean * F.lit(share)).withColumn("evidence", evidence)
           .where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "hash").limit(LEXICON_ENTRIES).toArrow())
    keys = top.column("hash").to_numpy().view(np.uint64)
    weight = np.log((top.column("toxic").to_numpy() + 0.5) / (top.column("clean").to_numpy() + 0.5))
    order = np.argsort(keys)
    return keys[order], weight[order]


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on the label rows (doc_id, toxic) where `learn` holds."""
    usable = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return Model(share)
    sample = cut(_sample(docs, usable, per_class))
    expected = min(counts[1], per_class) / (min(counts[0], 2 * per_class) + min(counts[1], per_class))

    def features_of(rows: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> pa.Table:
        def kernel(chunk: Chunk) -> pa.RecordBatch:
            return table_of(["toxic", "fold", "x"], [None, None, pa.list_(pa.float64())], [chunk.kept["toxic"], chunk.kept["fold"], list(features(chunk, lexicon))])

        return each_chunk(rows, kernel, "toxic int, fold int, x array<double>", keep=["toxic", "fold"]).toArrow()

    parts = []
    for k in range(FOLDS):  # each fold is described by what the others teach
        lexicon = _lexicon(sample.where(F.col("fold") != k), expected)
        parts.append(features_of(sample.where(F.col("fold") == k), lexicon))
    rows = pa.concat_tables(parts)
    if not rows.num_rows:
        return Model(share)
    x = np.array(rows.column("x").to_pylist())
    y, fold = rows.column("toxic").to_numpy().astype(float), rows.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same rows in any order give the same fit
    x, y, fold = x[order], y[order], fold[order]
    if len(set(y)) < 2:
        return Model(share)
    trees = boost(x, y)
    margin = np.empty(len(y))
    for k in range(FOLDS):
        others = fold != k
        margin[~others] = (boost(x[others], y[others]) if len(set(y[others])) == 2 else trees).margin(x[~others])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Model(share, _lexicon(sample, expected), trees, isotonic(margin, y, weight))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, kept columns, score, predicted."""
    keep = keep or []

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        s = model.score(features(chunk, model.lexicon))
        return table_of(["doc_id", *keep, "score", "predicted"], [None, *[None] * len(keep), pa.float64(), pa.int32()],
                        [chunk.ids, *(chunk.kept[c] for c in keep), s, (s >= 0.5).astype(np.int32)])

    kinds = "".join(f", {c} {kind_of(docs, c)}" for c in keep)
    return each_chunk(docs, kernel, f"doc_id {kind_of(docs)}{kinds}, score double, predicted int", keep=keep)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; texts do not leave their task."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names may hold dots
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch, doc_id, text):
                clean = pa.array(model.score(features(chunk, model.lexicon)) < 0.5)
                columns = {**chunk.kept, doc_id: chunk.ids, text: chunk.text}
                yield pa.RecordBatch.from_arrays([columns[c].filter(clean) for c in batch.schema.names], names=batch.schema.names)

    return plain.mapInArrow(run, plain.schema).toDF(*names)
