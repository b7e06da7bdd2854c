"""Ranked lexical search by dense blocked matrix products (operator 12).

Every item is a bag of distinct terms. A document's impact for a term is a whole number that grows with the term's occurrences and
shrinks with the document's length; the score of a document for an item is the sum of weight * impact over the item's terms.

1. Items are dealt to tiles of at most TILE_PAIRS (item, term) pairs by running sums of their sizes (an item with more is a tile
   of its own). The driver holds one tile at a time: its distinct terms as 64-bit hashes.
2. One pass over the documents counts documents, words, and the documents of each term of the tile.
3. A second pass looks up all words of some documents in the tile's terms. The terms that occur there make a compact
   vocabulary, cut into strips so that the largest possible sum of a strip stays below 2^53: a float64 product of
   the impacts (documents x terms) and the weights (terms x items) is then exact, and strips are added as 64-bit integers.
4. Of each product every item keeps its best `top` documents; the limit is the top-th largest score and all that equal it stay
   until they are ordered by doc_id, so no tie is cut at random. A task hands on `top` rows an item, and Spark ranks these.

Defined results: null and empty texts, and texts without a term, score nothing and count neither in N nor in L; items without
terms, or whose terms occur nowhere, give no rows; equal items (and rows that repeat an item_id) are ranked each; rows that repeat
a doc_id are documents of their own; a null doc_id comes after all others of the same score; rows with a null item_id are
items too; no documents, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyspark.llm.text import ALPHANUMERIC, Chunk, chunks, each_chunk, kind_of, signed, table_of, word_hashes
from tallyspark.session import cut

TOP = 10
#: (item, term) pairs of a tile, items of a tile, terms of a strip, and numbers in a block of impacts or scores.
TILE_PAIRS, TILE_ITEMS, WIDTH, BLOCK = 1 << 19, 1 << 11, 1 << 10, 1 << 21
#: An impact is at most SCALE * tf / (1000 * tf), so under this; sums under EXACT are exact in float64.
SCALE, MOST_IMPACT, EXACT = 1_000_000_000, 1_000_000, 1 << 53
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the distinct term hashes of every item that has one."""
    kind = kind_of(items, "item_id")

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        hashes, first = word_hashes(chunk, ALPHANUMERIC, lower=True)
        rows = np.repeat(np.arange(len(chunk)), np.diff(first))
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
        offsets = np.searchsorted(rows, np.arange(len(chunk) + 1)).astype(np.int32)
        return table_of(["item_id", "terms"], [None, None], [chunk.ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(hashes)))])

    found = each_chunk(items.select("item_id", "text"), kernel, f"item_id {kind}, terms array<long>", id_column="item_id")
    return found.where(F.size("terms") > 0)


class Tile:
    """Some items: sorted distinct term hashes, and the (term, item) pairs."""

    def __init__(self, terms: list[np.ndarray]):
        sizes = np.array([len(t) for t in terms])
        self.hashes, term = np.unique(np.concatenate(terms).view(np.uint64), return_inverse=True)
        item = np.repeat(np.arange(len(terms)), sizes)
        order = np.argsort(term, kind="stable")
        self.term, self.item, self.items = term[order].astype(np.int32), item[order].astype(np.int32), len(terms)

    def found(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each row; and rows, terms and occurrences of the tile's terms, by row."""
        hashes, first = word_hashes(chunk, ALPHANUMERIC, lower=True)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == hashes)
        n = np.diff(first)
        rows = np.searchsorted(first, hit, side="right") - 1
        key, tf = np.unique(rows * np.int64(len(self.hashes)) + at[hit], return_counts=True)
        return n, key // len(self.hashes), key % len(self.hashes), tf


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def statistics(docs: DataFrame, tile: Tile) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all words, and the documents of each term of the tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, some = np.zeros(len(tile.hashes), dtype=np.int64), 0, 0
        for batch in batches:
            for chunk in chunks(batch):
                n, _, term, _ = tile.found(chunk)
                df += np.bincount(term, minlength=len(df))
                total, some = total + int(n.sum()), some + int((n > 0).sum())
        at = np.flatnonzero(df)
        yield table_of(["term", "df"], [pa.int32(), pa.int64()], [np.concatenate([[-1, -2], at]), np.concatenate([[some, total], df[at]])])

    counted = docs.select("doc_id", "text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    rows = dict((r["term"], r["df"]) for r in counted.collect())  # bounded by the terms of a tile
    df = np.zeros(len(tile.hashes), dtype=np.int64)
    for term, count in rows.items():
        if term >= 0:
            df[term] = count
    return rows.get(-1, 0), rows.get(-2, 0), df


def _strips(weights: np.ndarray) -> np.ndarray:
    """Borders of runs of at most WIDTH terms whose weights, times the largest impact, sum to less than EXACT."""
    limit = EXACT // MOST_IMPACT - 1
    borders, total = [0], 0
    for k, w in enumerate(weights.tolist()):
        if total + w > limit or k - borders[-1] == WIDTH:
            borders.append(k)
            total = 0
        total += w
    return np.array([*borders, len(weights)])


class Best:
    """The best `top` documents of every item of a tile so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = np.zeros((items, 0), dtype=np.int64)
        self.ids = np.zeros((items, 0), dtype=np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score: documents x items. Rows at or above an item's limit are ordered by (score down, id up) and cut."""
        score = np.concatenate([self.score, score.T], axis=1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (len(self.ids), len(ids)))], axis=1)
        width = min(self.top, score.shape[1])
        new_score, new_ids = np.zeros((len(ids), width), dtype=np.int64), np.full((len(ids), width), _LAST)
        limit = np.maximum(np.partition(score, score.shape[1] - width, axis=1)[:, score.shape[1] - width], 1)
        item, at = np.nonzero(score >= limit[:, None])
        order = np.lexsort((ids[item, at], -score[item, at], item))
        item, at = item[order], at[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < width
        item, at, place = item[keep], at[keep], place[keep]
        new_score[item, place], new_ids[item, place] = score[item, at], ids[item, at]
        self.score, self.ids = new_score, new_ids


def _scores(tile: Tile, weights: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
    """Exact scores (rows x items) as a sum of float64 products over strips of the terms that occur."""
    used = np.unique(term)
    total = np.zeros((rows, tile.items), dtype=np.int64)
    borders = _strips(weights[used])
    for low, high in zip(borders[:-1], borders[1:]):
        strip = used[low:high]
        inside = (term >= strip[0]) & (term <= strip[-1])
        left = np.zeros((rows, len(strip)))
        left[row[inside], np.searchsorted(strip, term[inside])] = impact[inside]
        a, b = np.searchsorted(tile.term, [strip[0], strip[-1] + 1])
        pairs = np.arange(a, b)
        column = np.searchsorted(strip, tile.term[pairs])
        known = strip[np.minimum(column, len(strip) - 1)] == tile.term[pairs]
        right = np.zeros((len(strip), tile.items))
        right[column[known], tile.item[pairs[known]]] = weights[tile.term[pairs[known]]]
        total += (left @ right).astype(np.int64)
    return total


def _rank_tile(docs: DataFrame, tile: Tile, n_documents: int, n_words: int, df: np.ndarray, top: int) -> DataFrame:
    weights = np.array([weight(n_documents, int(x)) for x in df], dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(tile.items, top)
        step = max(1, BLOCK // max(tile.items, WIDTH))
        for batch in batches:
            for chunk in chunks(batch):
                n, row, term, tf = tile.found(chunk)
                if not len(row):
                    continue
                ids = np.where(chunk.ids.is_null(), _LAST, chunk.ids.fill_null(0).to_numpy(zero_copy_only=False))
                # whole numbers in Python where 90 * n * N might pass 2^63
                long = 100 - 90 + np.array([90 * int(k) * n_documents // n_words for k in n], dtype=np.int64)
                impact = SCALE * tf // (1000 * tf + 8 * long[row])
                some, dense = np.unique(row, return_inverse=True)
                for at in range(0, len(some), step):
                    a, b = np.searchsorted(dense, [at, at + step])
                    rows = min(step, len(some) - at)
                    best.add(_scores(tile, weights, dense[a:b] - at, term[a:b], impact[a:b], rows), ids[some[at:at + rows]])
        item, place = np.nonzero(best.score > 0)
        missing = best.ids[item, place] == _LAST
        yield table_of(["item", "doc_id", "score"], [pa.int32(), pa.int64(), pa.int64()],
                       [item, pa.array(best.ids[item, place], mask=missing), best.score[item, place]])

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = numbered.mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _tiles(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Item ids and term hashes of one tile after the other."""
    ids, terms, pairs = [], [], 0
    for row in items.toLocalIterator():
        size = len(row["terms"])
        if ids and (pairs + size > TILE_PAIRS or len(ids) == TILE_ITEMS):
            yield ids, terms
            ids, terms, pairs = [], [], 0
        ids.append(row["item_id"])
        terms.append(np.array(row["terms"], dtype=np.int64))
        pairs += size
    if ids:
        yield ids, terms


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: of every item the `top` documents with the highest scores above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = None
    for ids, terms in _tiles(item_terms(items)):
        tile = Tile(terms)
        n_documents, n_words, df = statistics(docs, tile)
        if not n_documents:
            break
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", IntegerType()), StructField("item_id", kind)]))
        ranked = _rank_tile(docs, tile, n_documents, n_words, df, top).join(names, "item").select("item_id", "rank", "doc_id", "score")
        ranked = cut(ranked)
        out = ranked if out is None else out.union(ranked)
    if out is None:
        empty = spark.createDataFrame([], "rank int, doc_id long, score long")
        return empty.select(F.lit(None).cast(kind).alias("item_id"), "rank", "doc_id", "score")
    return out

