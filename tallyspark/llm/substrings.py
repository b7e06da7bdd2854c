"""Substring deduplication by relative Lempel-Ziv factors (operator 8).

A window is WINDOW consecutive words. Words are removed that lie in a window whose words also start in a document with a
smaller doc_id.

Every document is cut into reference blocks, and all blocks are indexed. Cuts depend on content alone: the anchor of a window
is the run of ANCHOR words in it with the least hash, so equal windows have equal anchors. A block is a run of windows with the
same anchor, as one span of words. Then, in Spark:

1. Anchors that occur in a single document cannot lie in a repeated window: their blocks are literals and drop out.
2. Every other block is looked up in the index, which answers with the place of its span in the smallest document that has it,
   and ships the spans of the SHIPPED blocks after that place.
3. A task parses each document greedily: a factor begins at the first block that a smaller document holds, and goes on as long as
   the reference does, block by block, by what was shipped and by what the next blocks' own answers say of the same reference.
   Factors are (start, words, reference document, reference start); each has WINDOW words at least and is a duplicate span.
4. At factor boundaries stand blocks that no smaller document holds as a whole (the first documents of their spans among them). Their
   single windows are compared with the smallest document that holds the same words.

So the result is exact, while long copies and frequent passages cost one row per block. Hashes: a span is told apart by 64 bits
of all its words and 64 bits of its anchor. Frequent anchors, spans and windows are aggregated before they are shuffled and joined
back by joins that Spark can split; only what belongs to one document is gathered.

Defined results: null and empty texts have no words; a text shorter than a window loses nothing; the first document of equal
ones is kept whole; rows with a null doc_id lose nothing and are no reference; rows that repeat a doc_id do not
count against each other, whether their texts are equal or not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm.text import NOT_SPACE, Chunk, each_chunk, kind_of, mix, ragged, signed, table_of, window_hashes, window_rows, word_hashes
from tallyspark.session import cut, discard

WINDOW = 50
ANCHOR = 10
#: Blocks after a reference place whose spans the index ships with it.
SHIPPED = 4
_BASE = 0xD6E8FEB86659FD93


def _least_of(values: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    width = 1
    while 2 * width <= w:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = w - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Parsed:
    """Words of a chunk, the least anchor hash of every window, and the blocks."""

    def __init__(self, chunk: Chunk, window: int = WINDOW, anchor: int = ANCHOR):
        self.words, self.first = word_hashes(chunk, NOT_SPACE, lower=False)
        self.window = window
        self.rows, self.at = window_rows(self.first, window)
        n = len(self.words)
        self.least = np.zeros(n, dtype=np.uint64)
        if len(self.at):
            self.least[self.at] = _least_of(window_hashes(self.words, anchor), window - anchor + 1)[self.at]

    def blocks(self) -> tuple[np.ndarray, ...]:
        """Row, first window (in the row), windows, anchor hash and span hash of every block."""
        if not len(self.at):
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        least = self.least[self.at]
        lead = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (self.rows[1:] != self.rows[:-1])]))
        count = np.diff(np.append(lead, len(least)))
        start, row = self.at[lead], self.rows[lead]
        return row, start - self.first[row], count, least[lead], self._spans(start, count + self.window - 1)

    def _spans(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        up = np.full(len(self.words), _BASE, dtype=np.uint64)
        up[:1] = 1
        down = np.full(len(self.words), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        down[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * np.multiply.accumulate(up))])
        return mix((sums[start + length] - sums[start]) * np.multiply.accumulate(down)[start] + mix(length.astype(np.uint64)))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are joined by doc_id and a hash of the text, as doc_id alone may repeat."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key"))


def reference_blocks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """anchor, span, doc_id, key, start, count of all blocks of all texts."""

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        row, start, count, anchor, span = Parsed(chunk, window).blocks()
        row = pa.array(row)
        return table_of(["anchor", "span", "doc_id", "key", "start", "count"], [pa.int64(), pa.int64(), None, None, pa.int32(), pa.int32()],
                        [signed(anchor), signed(span), chunk.ids.take(row), chunk.kept["key"].take(row), start, count])

    return each_chunk(_keyed(docs), kernel, f"anchor long, span long, doc_id {kind_of(docs)}, key long, start int, count int", keep=["key"])


def _boundary_windows(docs: DataFrame, left_over: DataFrame, window: int) -> DataFrame:
    """anchor, span, doc_id, key, start of every single window of the blocks in left_over (doc_id, key, blocks)."""

    def kernel(chunk: Chunk) -> pa.RecordBatch | None:
        parsed = Parsed(chunk, window)
        lists = chunk.kept["blocks"]
        inner = lists.flatten()
        sizes = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(chunk)), sizes)
        start, count = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "count"))
        at = ragged(start + parsed.first[row], count)
        if not len(at):
            return None
        row = np.repeat(row, count)
        rows = pa.array(row)
        return table_of(["anchor", "span", "doc_id", "key", "start"], [pa.int64(), pa.int64(), None, None, pa.int32()],
                        [signed(parsed.least[at]), signed(window_hashes(parsed.words, window)[at]), chunk.ids.take(rows), chunk.kept["key"].take(rows),
                         at - parsed.first[row]])

    joined = _keyed(docs).join(left_over, ["doc_id", "key"])
    return each_chunk(joined, kernel, f"anchor long, span long, doc_id {kind_of(docs)}, key long, start int", keep=["key", "blocks"])


def _copied(rows: DataFrame) -> DataFrame:
    """Rows with the smallest doc_id that has the same anchor and span, if several documents have them. What repeats is written first."""
    repeated = rows.groupBy("anchor", "span").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(F.col("least") < F.col("most"))
    return rows.join(cut(repeated.drop("most")), ["anchor", "span"])


def _parse(own: int, blocks: list[dict], window: int) -> tuple[list[tuple], list[dict]]:
    """Greedy parse of one document's blocks, in order: factors (start, words, reference, reference start), and blocks left over."""
    factors, left_over = [], []
    at = 0
    while at < len(blocks):
        first = blocks[at]
        reference, begin = first["least"], first["least_start"]
        if reference is None or reference >= own:
            left_over.append(first)
            at += 1
            continue
        shipped, end = first["shipped"], first["start"] + first["count"]
        at += 1
        while at < len(blocks) and blocks[at]["start"] == end:
            block = blocks[at]
            if block["least"] == reference and block["least_start"] == begin + end - first["start"]:
                shipped = block["shipped"]  # its own answer is the same reference, and ships further
            elif shipped and shipped[0] == block["span"]:
                shipped = shipped[1:]
            else:
                break
            end = block["start"] + block["count"]
            at += 1
        factors.append((first["start"], end - first["start"] + window - 1, reference, begin))
    return factors, left_over


def _parsed(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, key, factors (start, words, reference, reference_start), left_over (start, count) of documents with repeated anchors."""
    blocks = cut(reference_blocks(docs, window))
    repeated = (blocks.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                .where(F.col("least") < F.col("most")).select("anchor"))
    candidates = cut(blocks.join(cut(repeated), "anchor", "left_semi"))
    discard(blocks)
    order = Window.partitionBy("doc_id", "key").orderBy("start")
    ends = F.col("start") + F.col("count")
    island = candidates.withColumn("joins", F.coalesce(F.lag(ends).over(order) == F.col("start"), F.lit(False)))
    run = island.withColumn("run", F.sum((~F.col("joins")).cast("int")).over(order))
    after = Window.partitionBy("doc_id", "key", "run").orderBy("start")
    placed = run.withColumn("shipped", F.collect_list("span").over(after.rowsBetween(1, SHIPPED)))
    answers = (placed.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "start", "shipped")).alias("r"), F.max("doc_id").alias("most"))
               .where(F.col("r.doc_id") < F.col("most")).select("anchor", "span", "r"))
    # what repeats is few and is written first: joined from a table, a span with very many rows can be split
    known = candidates.join(cut(answers), ["anchor", "span"], "left")
    block = F.struct("start", "count", "span", F.col("r.doc_id").alias("least"), F.col("r.start").alias("least_start"), F.col("r.shipped").alias("shipped"))
    gathered = known.groupBy("doc_id", "key").agg(F.collect_list(block).alias("blocks"))
    kind = kind_of(docs)
    factor = f"struct<start:int,words:int,reference:{kind},reference_start:int>"

    def run_all(batches):
        for batch in batches:
            factors, left_over = [], []
            for own, found in zip(batch.column("doc_id").to_pylist(), batch.column("blocks")):
                mine, rest = _parse(own, sorted(found.as_py(), key=lambda b: b["start"]), window)
                factors.append([dict(zip(("start", "words", "reference", "reference_start"), f)) for f in mine])
                left_over.append([{"start": b["start"], "count": b["count"]} for b in rest])
            own = batch.schema.field("doc_id").type
            shape = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("reference", own), ("reference_start", pa.int32())]))
            yield table_of(["doc_id", "key", "factors", "left_over"], [None, None, shape, pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())]))],
                           [batch.column("doc_id"), batch.column("key"), factors, left_over])

    return cut(gathered.mapInArrow(run_all, f"doc_id {kind}, key long, factors array<{factor}>, left_over array<struct<start:int,count:int>>"))


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, start, words, reference, reference_start: the factors of every document, words counted from 0."""
    known = docs.where(F.col("doc_id").isNotNull())
    return _parsed(known, window).select("doc_id", "key", F.inline("factors"))


def duplicate_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, spans: runs (start, count) of windows that also start in a smaller document, in no order."""
    known = docs.where(F.col("doc_id").isNotNull())
    parsed = _parsed(known, window)
    left_over = parsed.where(F.size("left_over") > 0).select("doc_id", "key", F.col("left_over").alias("blocks"))
    windows = cut(_boundary_windows(known, left_over, window))
    single = cut(_copied(windows).where(F.col("least") < F.col("doc_id")).select("doc_id", "key", "start", F.lit(1).alias("count")))
    discard(windows)
    copied = parsed.select("doc_id", "key", F.inline("factors")).select("doc_id", "key", "start", (F.col("words") - window + 1).alias("count"))
    return copied.union(single).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "count")).alias("spans"))


def _kept_words(body: bytes, starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[list[bytes], int]:
    """Words that stay, and the number of all words."""
    words = body.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    if not len(starts):
        return words, len(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + window - 1, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()], len(words)


def _apply(docs: DataFrame, window: int, as_text: bool) -> DataFrame:
    known = _keyed(docs.where(F.col("doc_id").isNotNull()))
    joined = known.join(duplicate_windows(docs, window), ["doc_id", "key"], "left")
    none = _keyed(docs.where(F.col("doc_id").isNull())).withColumn("spans", F.lit(None).cast(joined.schema["spans"].dataType))
    names = ["doc_id", "key", "n_words", "n_removed", "new_text" if as_text else "kept_sha256"]

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        lists = chunk.kept["spans"]
        inner = lists.flatten()
        start, count = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "count"))
        ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        raw = chunk.data.tobytes()
        n_words, n_removed, result = [], [], []
        at = 0
        for k, end in enumerate(ends.tolist()):
            kept, n = _kept_words(raw[chunk.offsets[k]:chunk.offsets[k + 1]], start[at:end], count[at:end], window)
            at = end
            n_words.append(n)
            n_removed.append(n - len(kept))
            body = b" ".join(kept)
            result.append((body.decode() if n > len(kept) else None) if as_text else hashlib.sha256(body).hexdigest())
        return table_of(names, [None, None, pa.int64(), pa.int64(), pa.string()], [chunk.ids, chunk.kept["key"], n_words, n_removed, result])

    return each_chunk(joined.unionByName(none), kernel, f"doc_id {kind_of(docs)}, key long, n_words long, n_removed long, {names[-1]} string", keep=["key", "spans"])


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    return _apply(docs, window, as_text=False).drop("key")


def changed_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, new_text of the rows that lose words; key is `xxhash64(text)` of the row."""
    return _apply(docs, window, as_text=True).where(F.col("n_removed") > 0).select("doc_id", "key", "new_text")
