"""Whole-array text kernels that run inside Arrow tasks: chunks of rows, words, word and shingle hashes.

Texts stay UTF-8 bytes. Word patterns of the operators only tell ASCII bytes apart, so a byte table decides them.
Hashes have 64 bits: bytes go through a table of odd random words, a word is a polynomial of its bytes, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that a task holds as arrays at once (a longer single text is its own chunk).
CHUNK_BYTES = 2 << 20
#: Bytes hashed at once; eight-byte arrays of this length are the largest ones made of a long text.
HASH_BLOCK = 1 << 19

_RANDOM = np.random.default_rng(20240607)
_BYTE = (_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: Iterable[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(excluded)] = False
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_class([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing)
ALPHANUMERIC = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = _powers(_BASE, 0)
    down = _powers(_BASE_INVERSE, 0)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * HASH_BLOCK:  # a single giant word: not kept
            return _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return cls.up, cls.down


class Chunk:
    """Some rows of a batch: their ids (nulls kept), and the UTF-8 bytes of their texts end to end."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, kept: dict[str, pa.Array] | None = None):
        self.ids, self.data, self.offsets, self.kept = ids, data, offsets, kept or {}
        self.text: pa.Array | None = None

    def __len__(self) -> int:
        return len(self.ids)


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(batch: pa.RecordBatch, id_column: str = "doc_id", text_column: str = "text") -> Iterator[Chunk]:
    """Cut a batch into runs of rows of about CHUNK_BYTES."""
    if not batch.num_rows:
        return
    ids = batch.column(id_column)
    data, offsets = text_array(batch.column(text_column))
    at = 0
    while at < len(ids):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(ids))
        kept = {n: batch.column(n).slice(at, to - at) for n in batch.schema.names if n not in (id_column, text_column)}
        chunk = Chunk(ids.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], kept)
        chunk.text = batch.column(text_column).slice(at, to - at)
        yield chunk
        at = to


def words(chunk: Chunk, table: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where the words of each row begin among them (one more entry than rows)."""
    data = chunk.data if data is None else data
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = chunk.offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, chunk.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Hash of each byte span; spans are ordered and do not overlap. `inside`: bytes that count (others lie between spans)."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _BYTE if inside is None else np.where(inside, _BYTE, np.uint64(0))
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + HASH_BLOCK, side="right")), at + 1)
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _Powers.of(hi - lo)
        sums = np.add.reduceat(table[data[lo:hi]] * up[:hi - lo], starts[at:to] - lo)
        out[at:to] = sums * down[starts[at:to] - lo]
        at = to
    return mix(out)


def word_hashes(chunk: Chunk, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's words begin."""
    data = LOWER[chunk.data] if lower else chunk.data
    starts, ends, first = words(chunk, table, data)
    return span_hashes(data, starts, ends, table), first


def window_hashes(values: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive values (len - k + 1 of them), runs across rows included: mask those."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = (_BASE ^ (2 * salt)) & ((1 << 64) - 1)
    up = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values + np.uint64(salt)) * up, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n))


def window_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all runs of k words: which lie inside one row, as (row, position of the run's first word among all words)."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return rows, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + first[rows]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, end to end."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def table_of(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def each_chunk(df: DataFrame, kernel: Callable[[Chunk], pa.RecordBatch | None], schema: str, keep: list[str] | None = None,
               id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Run `kernel` over all rows of (id, text, kept columns), chunk by chunk; it returns a batch of `schema` or None."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, id_column, text_column):
                out = kernel(chunk)
                if out is not None and out.num_rows:
                    yield out

    return df.select(id_column, text_column, *(keep or [])).mapInArrow(run, schema)


def kind_of(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()
