"""Grouping of spelling variants by pivotal grams (operator 11).

Words are runs of Latin letters with at least SHORTEST code points that occur at least OFTEN times. Two words are near if they
differ by exactly one inserted, deleted or replaced code point.

1. Words are counted in the tasks, whole texts at a time, and the counts are added up in Spark.
2. Bigrams are ordered by the number of words that hold them, rare ones first (there are at most 90 * 90, so the order is sent to
   the tasks). The prefix of a word is its three first bigrams in that order with their positions, and all that tie with the third.
   Its pivots are two disjoint bigrams of the prefix with the least sum of frequencies, found by dynamic programming.
3. One change cannot touch both pivots. Of two near words take the one whose prefix ends earlier in the order: one of its
   pivots stands in the prefix of the other word as well. Positions say more: if the change lies left of the second
   pivot, both words agree from there to the end; otherwise they agree from the start through the first pivot. So the
   index holds a word's start through each prefix gram and its rest from each prefix gram, under its length, and
   a word asks with two of these for each of the three lengths in question.
4. Candidates are verified by their edit distance inside the join, so no other pair leaves it. A part that very many words share
   is cut into squares of the two sides, so no task has all of its pairs. Words over LONG code points do not
   travel with their keys; their few candidates are verified after a second join.

The form of a word is its near word of largest count, if that is at least RATIO times its own; roots follow forms by
pointer jumping, which ends since counts grow along forms.

Defined results: null and empty texts have no words; rows that repeat count each; a row with a null doc_id loses no code points
(see `planted`); ties of the count go to the smallest word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.text import LOWER, Chunk, byte_class, chunks, mix, ragged, signed, span_hashes, table_of
from tallyspark.session import cut, discard

SHORTEST, OFTEN, RATIO = 6, 5, 5
#: Every REMOVED-th (document, run) by its crc32 loses a code point; None switches this off.
REMOVED = 199
LONG = 64
#: Pairs of words that meet under one part, of which about a task verifies at once.
MEETINGS = 1 << 22
#: Distinct words that a task holds before it hands them on.
HELD = 1 << 19

_NOT_ZERO = byte_class([0])
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are C3 80 to C3 BF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def runs(chunk: Chunk, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all runs of at least SHORTEST code points, and the row of each."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = chunk.offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
    enough = ends - starts - (wide[ends] - wide[starts]) >= SHORTEST
    starts, ends = starts[enough], ends[enough]
    return starts, ends, np.searchsorted(chunk.offsets, starts, side="right") - 1


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of the bytes of each span, going on from the crc32 of what stands before it."""
    out = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, c = starts[order], sizes[order], out[order]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = np.searchsorted(-sizes, -j, side="left")  # spans longer than j
        c[:n] = _CRC[(c[:n] ^ data[starts[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = c
    return out ^ np.uint32(0xFFFFFFFF)


def planted(doc_id: str, word: str, removed: int) -> str | None:
    """The run as it is counted for this document, if it loses a code point."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % removed:
        return None
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _chunk_counts(chunk: Chunk, removed: int | None) -> pa.RecordBatch | None:
    """word, n of a chunk."""
    data = LOWER[chunk.data]
    starts, ends, rows = runs(chunk, data)
    if not len(starts):
        return None
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[starts] += 1
    change[ends] -= 1
    only_runs = np.where(np.cumsum(change[:-1], dtype=np.int8) > 0, data, 0)
    distinct, example, which = np.unique(span_hashes(only_runs, starts, ends, _NOT_ZERO), return_index=True, return_inverse=True)
    n = np.bincount(which, minlength=len(distinct))
    starts, sizes = starts[example], (ends - starts)[example]
    raw = data.tobytes()
    changed: Counter = Counter()
    if removed:
        pair, count = np.unique(rows * np.int64(len(distinct)) + which, return_counts=True)
        row, word = pair // len(distinct), pair % len(distinct)
        ids = chunk.ids.to_pylist()
        known = np.array([i is not None for i in ids])
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
        short = sizes[word] <= LONG
        hit = np.zeros(len(pair), dtype=bool)
        hit[short] = _crc(data, starts[word[short]], sizes[word[short]], before[row[short]]) % np.uint32(removed) == 0
        hit |= ~short  # long runs are looked at one by one
        for r, w, c in zip(row[hit & known[row]].tolist(), word[hit & known[row]].tolist(), count[hit & known[row]].tolist()):
            new = planted(ids[r], raw[starts[w]:starts[w] + sizes[w]].decode(), removed)
            if new is not None:
                n[w] -= c
                if len(new) >= SHORTEST:
                    changed[new] += c
    some = np.flatnonzero(n)
    at = np.concatenate([[0], np.cumsum(sizes[some])])
    body = pa.py_buffer(data[ragged(starts[some], sizes[some])].tobytes())
    words = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(at.astype(np.int64).tobytes()), body).cast(pa.string())
    words = pa.concat_arrays([words, pa.array(list(changed), type=pa.string())])
    return table_of(["word", "n"], [None, pa.int64()], [words, np.concatenate([n[some], np.array(list(changed.values()), dtype=np.int64)])])


def word_counts(docs: DataFrame, removed: int | None = REMOVED, often: int = OFTEN) -> DataFrame:
    """word, n: the words that occur at least `often` times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch):
                part = _chunk_counts(chunk, removed)
                if part is None:
                    continue
                held.append(part)
                size += part.num_rows
                if size > HELD:
                    merged = _merged(held)
                    held, size = [merged], merged.num_rows
                    if size > HELD // 2:
                        yield merged
                        held, size = [], 0
        if held:
            yield _merged(held)

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
    return table.combine_chunks().to_batches()[0]


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Weight of every bigram: words of more common ones come later; no two weigh the same. Bounded by the alphabet, 90 * 90."""
    length = F.char_length("word")
    grams = F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    counted = words.where(length > 1).select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: k for k, r in enumerate(sorted(counted, key=lambda r: (r["count"], r["gram"])))}


def prefix_and_pivots(word: str, order: dict[str, int]) -> tuple[list[int], int, tuple[int, int]]:
    """Positions of the prefix grams (up), the weight of the last in the order, and the positions of the two pivots."""
    grams = [order[word[i:i + 2]] for i in range(len(word) - 1)]
    last = sorted(grams)[2]
    places = [i for i, g in enumerate(grams) if g <= last]
    # least weight of one gram among those that end before the next one starts, and of two disjoint ones
    best, one, at = None, None, 0
    for right in places:
        while places[at] + 2 <= right:
            if one is None or grams[places[at]] < grams[one]:
                one = places[at]
            at += 1
        if one is not None and (best is None or grams[one] + grams[right] < grams[best[0]] + grams[best[1]]):
            best = (one, right)
    return places, last, best


def _part_hashes(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word[:i] and of word[i:] for every i from 0 to its length."""
    codes = mix(np.array([ord(c) for c in word], dtype=np.uint64) + np.uint64(1))
    base = np.full(len(codes) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    base[0] = 1
    up = np.multiply.accumulate(base)[:-1]
    start = np.concatenate([[np.uint64(0)], np.cumsum(codes * up)])
    rest = np.concatenate([[np.uint64(0)], np.cumsum(codes[::-1] * up)])[::-1]
    return mix(start), mix(rest + np.uint64(1))


def _keys(words: DataFrame, order: dict[str, int], asking: bool) -> DataFrame:
    """part (hash of a start or a rest), size, id, last, short (the word, null over LONG) of every word.

    `asking`: the two parts of the pivots, under the sizes that a near word may have; else all parts of the prefix, under its own.
    """
    names = ["part", "size", "id", "last", "short"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in names]
            for word, own in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
                places, last, (left, right) = prefix_and_pivots(word, order)
                start, rest = _part_hashes(word)
                if asking:
                    parts = [(start[left + 2], s) for s in (-1, 0, 1)] + [(rest[right], s) for s in (-1, 0, 1)]
                else:
                    parts = [(h, 0) for i in places for h in (start[i + 2], rest[i])]
                short = word if len(word) <= LONG else None
                for h, shift in parts:
                    for column, value in zip(rows, (h, len(word) + shift, own, last, short)):
                        column.append(value)
                if len(rows[0]) > 1 << 16:
                    yield table_of(names, types, [signed(np.array(rows[0], dtype=np.uint64)), *rows[1:]])
                    rows = [[] for _ in names]
            if rows[0]:
                yield table_of(names, types, [signed(np.array(rows[0], dtype=np.uint64)), *rows[1:]])

    return words.select("word", "id").mapInArrow(run, "part long, size int, id long, last int, short string")


def _dealt(ask: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the square (row, column) in which they meet: a part with many words on both sides is cut into squares of
    about MEETINGS pairs; each word has a strip of its own on its side, and comes to all strips of the other one."""
    at = ["part", "size"]
    pairs = F.col("asks") * F.col("holds")
    squares = F.ceil(F.sqrt(pairs / F.lit(float(MEETINGS)))).cast("int")
    hot = cut(ask.groupBy(*at).agg(F.count("*").alias("asks")).join(index.groupBy(*at).agg(F.count("*").alias("holds")), at)
              .where(pairs > MEETINGS).select(*at, squares.alias("squares")))
    side = F.coalesce("squares", F.lit(1))
    strip, every = F.pmod(F.xxhash64("id", F.lit("strip")), side).cast("int"), F.explode(F.sequence(F.lit(0), side - 1))
    left = ask.join(hot, at, "left").withColumn("row", strip).withColumn("column", every).drop("squares")
    return left, index.join(hot, at, "left").withColumn("column", strip).withColumn("row", every).drop("squares")


def near_words(words: DataFrame) -> DataFrame:
    """a, b: ids of all near words of words (word, id), each pair in both directions once."""
    order = bigram_order(words)
    ask, index = _dealt(cut(_keys(words, order, asking=True)), cut(_keys(words, order, asking=False)))
    x, y = ask.alias("x"), index.alias("y")
    both = F.col("x.short").isNotNull() & F.col("y.short").isNotNull()
    near = F.levenshtein("x.short", "y.short", 1) == 1
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("part", "size", "row", "column")]
    found = x.join(y, meet[0] & meet[1] & meet[2] & meet[3] & (F.col("x.last") <= F.col("y.last"))
                   & (F.col("x.id") != F.col("y.id")) & F.when(both, near).otherwise(F.lit(True)))
    pairs = cut(found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), both.alias("sure")).distinct())
    long = pairs.where(~F.col("sure"))
    named = (long.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a")), "a")
             .join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b")), "b")
             .where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b"))
    all_pairs = pairs.where("sure").select("a", "b").union(named)
    return all_pairs.union(all_pairs.select("b", "a"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the end of the chain of forms, by pointer jumping; words without a form are their own."""
    current = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        moved = current.where(F.col("root") != F.col("word"))
        step = moved.join(current.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        changes = cut(step.where(F.col("next") != F.col("root")).select("word", "next"))
        if changes.isEmpty():
            return current
        following = cut(current.join(changes, "word", "left").select("word", F.coalesce("next", "root").alias("root")))
        discard(current, changes)
        current = following


def variants(docs: DataFrame, removed: int | None = REMOVED, often: int = OFTEN) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of docs (doc_id, text)."""
    words = cut(word_counts(docs, removed, often).withColumn("id", F.xxhash64("word")))
    pairs = near_words(words)
    other = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    least = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    best = pairs.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), least.alias("best"))
    enough = -F.col("best.minus") >= RATIO * F.col("n")
    joined = words.join(best, F.col("id") == F.col("a"), "left")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
