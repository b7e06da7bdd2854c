"""Language-model scoring with a causal self-attention model on subword ids (operator 3).

Two scores per text. The base score takes words and one end token with add-one smoothed counts over all texts to learn from. The
model's score is the log10 probability of the same sequence, each word spelt in subword ids: a self-attention layer, trained
here in numpy, gives the distribution of the next id's class from the ids before it, and corpus counts give the id within its
class. Frequent ids are classes of their own. Texts are scored in windows of CONTEXT ids that overlap by at least CONTEXT -
STRIDE: every id is scored once, in the window that gives it the most ids before it, in batches with a causal mask.

What is gathered from the corpus: counts of words and of subword ids over all texts to learn from (aggregated by Spark), and the
weights. These start from a bounded sample, the first WARM_IDS ids of WARM_TEXTS texts; then texts are dealt to shards by a hash,
every shard goes on training on all windows of all its texts, once, and the weights of all shards are averaged by their numbers of
ids. Equal texts are trained on as one with their number as weight. So every id of every row to learn from counts by its share,
training grows with the input, and the same rows give the same scores in any partitioning.

Counts of words that occur often (a table of at most FREQUENT entries, hence broadcast) are looked up in the task; all other words
are joined by Spark with the counts and summed per text. So no word is a hot key in a join, and the vocabulary is never collected.

Defined results: null and empty texts are a single end token; without texts to learn from all counts are 0; repeated rows give
repeated results; rows with a null doc_id are scored and not learned from; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.pieces import default_model, vocabulary
from tallyspark.llm.text import LOWER, NOT_SPACE, Chunk, chunks, each_chunk, kind_of, ragged, signed, span_hashes, table_of, words
from tallyspark.session import cut

#: Word counts that are looked up in the task, at most.
FREQUENT = 1 << 17
#: Texts of the first fit, and ids of each, at most.
WARM_TEXTS, WARM_IDS = 400, 1 << 12
#: Ids of a shard that one task trains on, averages of shards that reach the driver, and shards of one average.
SHARD_IDS, PARTS, FAN = 1 << 22, 8, 64
CONTEXT, STRIDE, WIDTH = 32, 24, 16
#: Input symbols: frequent ids, and buckets of the others. Output classes: frequent ids, and groups of the others by frequency.
SYMBOLS, BUCKETS, SINGLE, GROUPS = 1022, 256, 126, 32
BEGIN, FILL = 0, 1
WINDOWS_AT_ONCE, STEPS_BATCH, RATE, WARM_PASSES = 192, 48, 4e-3, 4
END_HASH = np.uint64(0x9AE16A3B2F90404F)


def _spelt(chunk: Chunk, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where each text's words begin, all subword ids, and where each text's ids begin."""
    data = LOWER[chunk.data]
    starts, ends, first = words(chunk, NOT_SPACE, data)
    hashes = span_hashes(data, starts, ends, NOT_SPACE)
    # every word with one space before it, end to end
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes
    spaced = np.full(int(sizes.sum()), 32, dtype=np.uint8)
    spaced[ragged(at + 1, sizes - 1)] = data[ragged(starts, sizes - 1)]
    ids, counts = vocabulary(path).encode_spans(spaced, at, at + sizes)
    return hashes, first, ids, np.concatenate([[0], np.cumsum(counts)])[first]


@dataclass
class Coding:
    """How ids become input symbols and output classes, and the log10 share of an id in its class. The last id is the end."""

    symbol: np.ndarray
    output: np.ndarray
    within: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Coding:
        size = len(counts) - 1
        order = np.argsort(-counts[:size], kind="stable")
        symbol = 2 + SYMBOLS + (np.arange(size + 1) * 0x9E3779B1 >> 7) % BUCKETS
        symbol[order[:SYMBOLS]] = 2 + np.arange(min(SYMBOLS, size))
        output = np.zeros(size + 1, dtype=np.int64)  # class 0 is the end
        output[order[:SINGLE]] = 1 + np.arange(min(SINGLE, size))
        rest = order[SINGLE:]
        mass = np.cumsum(counts[rest] + 0.5)
        output[rest] = 1 + SINGLE + np.minimum((mass - counts[rest] - 0.5) * GROUPS // mass[-1], GROUPS - 1).astype(np.int64)
        smooth = counts + 0.5
        return Coding(symbol, output, np.log10(smooth / np.bincount(output, smooth)[output]))


CLASSES = 1 + SINGLE + GROUPS


def new_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def random(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return {"symbol": random(2 + SYMBOLS + BUCKETS, WIDTH, scale=0.3), "place": random(CONTEXT, WIDTH, scale=0.1),
            "qkv": random(WIDTH, 3 * WIDTH, scale=0.25), "mixed": random(WIDTH, WIDTH, scale=0.25),
            "out": random(WIDTH, CLASSES, scale=0.25), "bias": np.zeros(CLASSES, np.float32)}


_SEEN = np.tril(np.ones((CONTEXT, CONTEXT), dtype=np.float32))
_ONES = np.ones((max(CONTEXT, CLASSES), 1), dtype=np.float32)
#: Exponents are cut here, far below the range of floats; trained weights stay far below it.
_STEEPEST = np.float32(60)


def _exponential(x: np.ndarray) -> np.ndarray:
    if x.max(initial=0) > _STEEPEST:
        np.minimum(x, _STEEPEST, out=x)
    return np.exp(x, out=x)


def _forward(w: dict, tokens: np.ndarray) -> tuple:
    """Hidden states after each position of windows of symbols, and what the gradient needs."""
    x = w["symbol"][tokens] + w["place"]
    qkv = x @ w["qkv"]
    q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH:2 * WIDTH], qkv[:, :, 2 * WIDTH:]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(WIDTH ** -0.5)
    a = _exponential(a)
    a *= _SEEN
    a /= a @ _ONES[:CONTEXT]
    z = a @ v
    return x + z @ w["mixed"], x, q, k, v, a, z


class Scorer:
    """The same model as `_forward`, with fewer passes over the attention and the logits."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w
        self.query = np.ascontiguousarray(w["qkv"][:, :WIDTH] * np.float32(WIDTH ** -0.5))
        self.key = np.ascontiguousarray(w["qkv"][:, WIDTH:2 * WIDTH])
        self.value = np.ascontiguousarray(w["qkv"][:, 2 * WIDTH:] @ w["mixed"])

    def log_chances(self, tokens: np.ndarray, use: np.ndarray, output: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance of each used place's class; `output`: these classes."""
        x = self.w["symbol"][tokens] + self.w["place"]
        flat = x.reshape(-1, WIDTH)
        q, k, v = ((flat @ m).reshape(x.shape) for m in (self.query, self.key, self.value))
        a = _exponential(q @ k.transpose(0, 2, 1))
        a *= _SEEN
        x += (a @ v) / (a @ _ONES[:CONTEXT])
        logits = x[use] @ self.w["out"]
        logits += self.w["bias"]
        chosen = np.minimum(logits[np.arange(len(output)), output], _STEEPEST)
        return chosen - np.log(_exponential(logits) @ _ONES[:CLASSES])[:, 0]


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over sequences of begin mark and ids: row, place of the window's begin in the row's sequence, first place it scores.

    A row with n ids (its end included) has the sequence places 0 .. n - 1 as input, and place p scores id p.
    """
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - CONTEXT) // STRIDE))
    row = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = number * STRIDE
    return row, begin, np.where(number > 0, begin + CONTEXT - STRIDE, 0)


class Texts:
    """Ids of texts with their ends, and the windows over them."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, coding: Coding):
        rows = len(first) - 1
        self.coding = coding
        self.ids = np.insert(ids, first[1:], len(coding.symbol) - 1)
        self.first = first + np.arange(rows + 1)
        self.row, self.begin, self.scored = windows_of(self.first)

    def batch(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input symbols of some windows, the ids that follow each place, and which of them are scored."""
        row = self.row[pick]
        place = self.begin[pick][:, None] + np.arange(CONTEXT)
        length = np.diff(self.first)[row][:, None]
        at = self.first[row][:, None] + np.minimum(place, length - 1)
        symbol = np.where(place == 0, BEGIN, self.coding.symbol[self.ids[np.maximum(at - 1, 0)]])
        symbol[place >= length] = FILL
        return symbol, self.ids[at], (place >= self.scored[pick][:, None]) & (place < length)


def score_texts(w: dict, texts: Texts) -> np.ndarray:
    """log10 probability of every text."""
    total = np.zeros(len(texts.first) - 1)
    scorer = Scorer(w)
    for low in range(0, len(texts.row), WINDOWS_AT_ONCE):
        pick = np.arange(low, min(low + WINDOWS_AT_ONCE, len(texts.row)))
        tokens, follow, use = texts.batch(pick)
        ids = follow[use]
        chance = scorer.log_chances(tokens, use, texts.coding.output[ids]) * np.log10(np.e) + texts.coding.within[ids]
        total += np.bincount(np.repeat(texts.row[pick], use.sum(axis=1)), chance, len(total))
    return total


class Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.s = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t = 0

    def step(self, tokens: np.ndarray, output: np.ndarray, use: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step on some windows; `use`: places that count, `weight`: of each window."""
        w = self.w
        h, x, q, k, v, a, z = _forward(w, tokens)
        picked, target = h[use], output[use]
        share = np.repeat(weight, use.sum(axis=1)).astype(np.float32)[:, None]
        share /= max(share.sum(), 1)
        # with e = exp(logits): the error e / sum(e) - target, times share, is never written out
        e = picked @ w["out"]
        e += w["bias"]
        e = _exponential(e)
        scale = share / (e @ _ONES[:CLASSES])
        dh = np.zeros_like(h)
        dh[use] = (e @ w["out"].T) * scale - w["out"].T[target] * share
        dout, dbias = (picked * scale).T @ e, (scale.T @ e)[0]
        dbias -= np.bincount(target, share[:, 0], CLASSES)
        for c, column in enumerate((picked * share).T):
            dout[c] -= np.bincount(target, column, CLASSES)
        dz = dh @ w["mixed"].T
        da = dz @ v.transpose(0, 2, 1)
        da -= (da * a) @ _ONES[:CONTEXT]
        da *= a
        ds = da
        ds *= np.float32(WIDTH ** -0.5)
        dqkv = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dz], axis=2)
        dx = dh + dqkv @ w["qkv"].T
        flat = tokens.ravel()
        symbol = np.stack([np.bincount(flat, c, len(w["symbol"])) for c in dx.reshape(-1, WIDTH).T], axis=1)
        self._apply({"symbol": symbol, "place": dx.sum(axis=0), "qkv": np.tensordot(x, dqkv, ([0, 1], [0, 1])),
                     "mixed": np.tensordot(z, dh, ([0, 1], [0, 1])), "out": dout, "bias": dbias}, rate)

    def _apply(self, gradient: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        scale = rate * (1 - 0.99 ** self.t) ** 0.5 / (1 - 0.9 ** self.t)
        for name, g in gradient.items():
            g = g.astype(np.float32)
            self.m[name] += 0.1 * (g - self.m[name])
            self.s[name] += 0.01 * (g * g - self.s[name])
            self.w[name] -= np.float32(scale) * self.m[name] / (np.sqrt(self.s[name]) + 1e-8)


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def _part(shard: int, ids: int, weights: np.ndarray) -> pa.Table:
    """A row of averaged weights and the number of ids they stand for."""
    return pa.table({"shard": pa.array([shard], pa.int32()), "ids": pa.array([ids], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})


def _unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    shapes = {k: v.shape for k, v in new_weights().items()}
    for k in sorted(shapes):
        size = int(np.prod(shapes[k]))
        out[k] = values[at:at + size].reshape(shapes[k]).astype(np.float32)
        at += size
    return out


def _warm_start(sample: DataFrame, coding: Coding, path: str) -> dict[str, np.ndarray]:
    """First weights, fitted in the driver on a bounded sample of texts."""

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        _, _, ids, first = _spelt(chunk, path)
        return table_of(["ids"], [pa.list_(pa.int32())], [[ids[a:min(b, a + WARM_IDS)] for a, b in zip(first[:-1], first[1:])]])

    rows = each_chunk(sample, kernel, "ids array<int>").toArrow().column("ids").to_pylist()
    rows.sort()  # any order of the rows gives the same fit
    if not rows:
        return new_weights()
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    texts = Texts(np.array([i for r in rows for i in r], dtype=np.int64), first, coding)
    fit, rng = Adam(new_weights()), np.random.default_rng(5)
    per_pass = min(len(texts.row), 4000)
    for turn in range(WARM_PASSES):
        order = rng.permutation(len(texts.row))[:per_pass]
        for low in range(0, len(order), STEPS_BATCH):
            tokens, follow, use = texts.batch(order[low:low + STEPS_BATCH])
            fit.step(tokens, coding.output[follow], use, np.ones(len(tokens)), RATE * (1 - turn / WARM_PASSES))
    return fit.w


def _one_pass(fit: Adam, texts: Texts, weight: np.ndarray, rng: np.random.Generator) -> int:
    """Train once on every window, those of one text spread over the steps; the number of ids trained on, copies included.

    `weight`: how many rows hold each text.
    """
    order, seen = rng.permutation(len(texts.row)), 0
    for low in range(0, len(order), STEPS_BATCH):
        pick = order[low:low + STEPS_BATCH]
        tokens, follow, use = texts.batch(pick)
        fit.step(tokens, texts.coding.output[follow], use, weight[texts.row[pick]], RATE / 4)
        seen += int((use.sum(axis=1) * weight[texts.row[pick]]).sum())
    return seen


def _train_everywhere(learn: DataFrame, n_ids: int, start: dict[str, np.ndarray], coding: Coding, path: str) -> dict[str, np.ndarray]:
    """Go on from `start` in every shard on all windows of all its texts; the average of the shards' weights by numbers of ids.

    Shards hold about SHARD_IDS ids. Equal texts are one text of their number, and a text's shard and its place there come from its
    hash, so the result does not depend on how the rows lie in files or partitions.
    """
    shards = max(1, -(-n_ids // SHARD_IDS))
    hashed = F.xxhash64("text", F.lit("shard"))
    distinct = learn.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("weight"))
    dealt = distinct.select(F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"), hashed.alias("doc_id"), "text", "weight")

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        fit, seen, rng = Adam(start), 0, np.random.default_rng(7)
        for batch in group.to_batches():
            for chunk in chunks(batch):
                _, _, ids, first = _spelt(chunk, path)
                seen += _one_pass(fit, Texts(ids, first, coding), chunk.kept["weight"].to_numpy(), rng)
        return _part(group.column("shard")[0].as_py(), seen, _flat(fit.w))

    def add_up(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        total, seen = 0.0, 0
        for n, raw in zip(group.column("ids").to_pylist(), group.column("weights").to_pylist()):
            total, seen = total + np.frombuffer(raw) * n, seen + n
        return _part(group.column("up")[0].as_py(), seen, total / max(seen, 1))

    kind = "shard int, ids long, weights binary"
    parts = cut(dealt.groupBy("shard").applyInArrow(train, kind))
    while shards > PARTS:  # a tree of averages, each of FAN shards
        parts = cut(parts.withColumn("up", F.floor(F.col("shard") / FAN).cast("int")).groupBy("up").applyInArrow(add_up, kind))
        shards = -(-shards // FAN)
    rows = sorted(parts.collect(), key=lambda r: r["shard"])  # at most PARTS rows
    seen = sum(r["ids"] for r in rows)
    if not seen:
        return start
    return _unflat(sum(np.frombuffer(bytes(r["weights"])) * (r["ids"] / seen) for r in rows))


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    coding: Coding
    train_tokens: int
    vocabulary_size: int
    frequent: tuple[np.ndarray, np.ndarray]
    ends: int
    path: str


def train(docs: DataFrame, learn, model: str | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table (hash, count) of all words of the rows where `learn` holds."""
    path = model or default_model()
    size = vocabulary(path).size
    texts = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id", "text")

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        hashes, _, ids, _ = _spelt(chunk, path)
        words_, counts = np.unique(np.append(hashes, np.full(len(chunk), END_HASH)), return_counts=True)
        pieces, uses = np.unique(ids, return_counts=True)
        return table_of(["piece", "hash", "count"], [pa.bool_(), pa.int64(), pa.int64()],
                        [np.repeat([False, True], [len(words_), len(pieces)]), np.concatenate([signed(words_), pieces]), np.concatenate([counts, uses])])

    counted = cut(each_chunk(texts, kernel, "piece boolean, hash long, count long").groupBy("piece", "hash").agg(F.sum("count").alias("count")))
    pieces = counted.where("piece").select("hash", "count").toArrow()  # one row for each id of the tokenizer at most
    counts = np.zeros(size + 1)
    counts[pieces.column("hash").to_numpy()] = pieces.column("count").to_numpy()
    table = counted.where(~F.col("piece")).select("hash", "count")
    end = signed(np.array([END_HASH]))[0].item()
    totals = table.agg(F.sum("count").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("hash") == end, F.col("count"))).alias("ends")).first()
    step = F.floor(F.log2("count") * 8)
    histogram = sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])  # some hundred rows
    least, held = 1 << 10, 0
    for r in histogram:
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["step"]
    frequent = table.where(step >= least).toArrow()
    keys, values = frequent.column("hash").to_numpy().view(np.uint64), frequent.column("count").to_numpy()
    order = np.argsort(keys)
    coding = Coding.of(counts)
    sample = texts.select("doc_id", F.xxhash64("text").alias("key")).orderBy(F.xxhash64("doc_id", F.lit("language model"), "key"), "doc_id").limit(WARM_TEXTS)
    keyed = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(sample.distinct()), ["doc_id", "key"], "left_semi")  # WARM_TEXTS rows
    weights = _warm_start(keyed.groupBy("doc_id", "key").agg(F.min("text").alias("text")), coding, path)
    weights = _train_everywhere(texts, int(counts.sum()) + (totals["ends"] or 0), weights, coding, path)
    return Model(weights, coding, totals["n"] or 0, totals["v"], (keys[order], values[order]), totals["ends"] or 0, path), table


def score(docs: DataFrame, model: Model, table: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, kept columns, n_tokens, n_known, train_tokens, base_score, score of every row."""
    keys, values = model.frequent
    logs = np.log10(values + 1.0)
    names = ["doc_id", *keep, "n_tokens", "known", "logs", "rare", "times", "score"]
    types = [None, *[None] * len(keep), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        hashes, first, ids, first_id = _spelt(chunk, model.path)
        row = np.repeat(np.arange(len(chunk)), np.diff(first))
        k = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
        hit = keys[k] == hashes if len(keys) else np.zeros(len(hashes), bool)
        found = np.bincount(row[hit], logs[k[hit]], len(chunk)) if hit.any() else np.zeros(len(chunk))
        known = np.bincount(row[hit], minlength=len(chunk)) + (model.ends > 0)
        rare_row, rare_hash = row[~hit], hashes[~hit]
        order = np.lexsort((rare_hash, rare_row))
        rare_row, rare_hash = rare_row[order], rare_hash[order]
        lead = np.flatnonzero(np.concatenate([[True], (rare_row[1:] != rare_row[:-1]) | (rare_hash[1:] != rare_hash[:-1])])) if len(order) else order
        times = np.diff(np.append(lead, len(order)))
        bounds = pa.array(np.searchsorted(rare_row[lead], np.arange(len(chunk) + 1)).astype(np.int32))
        return table_of(names, types, [
            chunk.ids, *(chunk.kept[c] for c in keep), np.diff(first) + 1, known, found + np.log10(model.ends + 1.0),
            pa.ListArray.from_arrays(bounds, pa.array(signed(rare_hash[lead]))), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64))),
            score_texts(model.weights, Texts(ids, first_id, model.coding))])

    kinds = "".join(f", {c} {kind_of(docs, c)}" for c in keep)
    schema = f"doc_id {kind_of(docs)}{kinds}, n_tokens long, known long, logs double, rare array<long>, times array<long>, score double"
    scored = cut(each_chunk(docs, kernel, schema, keep=keep).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    looked_up = rare.join(table, "hash").groupBy("row").agg(
        F.sum(F.log10(F.col("count") + 1) * F.col("times")).alias("more_logs"), F.sum("times").alias("more_known"))
    per_token = F.log10(F.lit(float(model.train_tokens + model.vocabulary_size + 1)))
    return (scored.drop("rare", "times").join(looked_up, "row", "left")
            .select("doc_id", *keep, "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(model.train_tokens).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"), "score"))
