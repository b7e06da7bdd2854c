"""SentencePiece BPE by a merge-type prefix table: encoding and decoding (operator 5).

For every prefix of a text exactly one token can be the last one of its encoding. The table of these last tokens is filled
from left to right: an automaton over the pieces gives all pieces that end at a position, longest first, and the one that is
compatible with the last token of the prefix before it is entered. Two tokens are compatible if encoding their joined text
gives these two again; that is read off their merge histories without encoding anything. The ids are then recovered
backwards from the end of the text. The table is filled for many texts at once, one position at a time, with arrays.

A text is first cut where no piece can reach across: before a space that follows another character, and inside very long
runs between characters that no piece holds side by side. The cuts are encoded once per distinct string of a chunk, and a
bounded cache keeps what earlier chunks of the same worker saw.

Defined results: null and empty texts have no ids and decode to the empty text; characters without a piece become their
UTF-8 bytes; U+2581 counts as a space, as in the library. Rows with equal or null ids are independent rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.text import Chunk, each_chunk, ragged, span_hashes, table_of

SPACE = 0x20
MARK = "▁"
#: Distinct cuts that a worker's cache keeps; a fuller one starts again.
CACHE_ENTRIES = 200_000
#: Cuts longer than this many characters are cut again between characters that no piece joins.
LONG = 48
#: Slots of the cache of compatibility tests.
PAIR_SLOTS = 1 << 19
NONE, UNKNOWN = -1, -2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, automaton, merge histories and output tables of one BPE model file with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
        if model.normalize(" a  b ") != MARK * 2 + "a" + MARK * 2 + "b" + MARK:
            raise ValueError("only models that keep all spaces, with a leading one added, are supported")
        if any(ok and MARK in p.lstrip(MARK) for p, ok in zip(pieces, plain)):
            raise ValueError("a piece joins two words; cutting at spaces would not be exact")
        self.size = size
        self.text = [p.replace(MARK, " ") for p in pieces]
        self.ids = {self.text[i]: i for i in range(size) if plain[i]}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        score = np.array([model.get_score(i) for i in range(size)])
        self._merges(score)
        self._automaton()
        self._outputs(plain)
        self.pair_keys = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, dtype=bool)
        self.cache = Cache()

    def _merges(self, score: np.ndarray) -> None:
        """Ranks, and of each reachable token the two tokens that its last merge joins.

        Single characters come first; longer pieces follow by score. Runs of spaces have one common score, lower than all
        others, and are treated apart: of equal merges the leftmost comes first, so they grow from the left.
        """
        texts = self.ids
        longer = sorted((t for t in texts if len(t) > 1), key=lambda t: (-score[texts[t]], texts[t]))
        self.rank = np.zeros(self.size, dtype=np.int64)
        singles = [t for t in texts if len(t) == 1]
        for r, t in enumerate([*singles, *longer]):
            self.rank[texts[t]] = r
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.reachable = {t: texts[t] for t in singles}
        joined: dict[int, int] = {}
        for t in longer:
            token = texts[t]
            for k in range(1, len(t)):
                a, b = texts.get(t[:k]), texts.get(t[k:])
                if a is not None and b is not None:
                    joined[a * self.size + b] = token
            if not t.strip(" "):
                self.reachable[t] = token
                continue
            last = self._last_merge(t)
            if last:
                self.left[token], self.right[token] = last
                self.reachable[t] = token
        keys = np.array(sorted(joined), dtype=np.int64)
        self.join_keys, self.join_ids = keys, np.array([joined[int(k)] for k in keys], dtype=np.int64)
        runs = {len(t): i for t, i in texts.items() if not t.strip(" ")}
        self.is_run = np.zeros(self.size, dtype=bool)
        self.is_run[list(runs.values())] = True
        self.space = runs[1]
        adjacent = set()
        for n in range(2, 4 * max(runs)):
            parts = [1] * n
            while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in runs), None)) is not None:
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            adjacent.update((runs[a], runs[b]) for a, b in zip(parts, parts[1:]))
        self.run_pairs = np.array(sorted(a * self.size + b for a, b in adjacent), dtype=np.int64)

    def _last_merge(self, t: str) -> tuple[int, int] | None:
        """The last two tokens of encoding a piece's own text by merging; None if it does not become one token."""
        parts = list(t)
        while len(parts) > 2:
            best = min(((self.rank[self.ids[x]], k) for k in range(len(parts) - 1)
                        if (x := parts[k] + parts[k + 1]) in self.ids), default=None)
            if best is None:
                return None
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if all(p in self.ids for p in parts) else None

    def _automaton(self) -> None:
        """Trie of the reachable pieces with failure links; per state its longest piece, per piece the next shorter one."""
        children: list[dict[str, int]] = [{}]
        ends = [NONE]
        for t, token in self.reachable.items():
            s = 0
            for c in t:
                n = children[s].get(c)
                if n is None:
                    n = children[s][c] = len(children)
                    children.append({})
                    ends.append(NONE)
                s = n
            ends[s] = token
        fail = np.zeros(len(children), dtype=np.int64)
        longest = np.array(ends, dtype=np.int64)
        self.shorter = np.full(self.size, NONE, dtype=np.int64)
        level = [0]
        while level:
            below = []
            for s in level:
                for c, n in children[s].items():
                    f = fail[s]
                    while f and c not in children[f]:
                        f = fail[f]
                    fail[n] = children[f].get(c, 0) if s else 0
                    if ends[n] == NONE:
                        longest[n] = longest[fail[n]]
                    else:
                        self.shorter[ends[n]] = longest[fail[n]]
                    below.append(n)
            level = below
        self.fail, self.longest = fail, longest
        edges = sorted((s << 21 | ord(c), n) for s, x in enumerate(children) for c, n in x.items())
        self.edge_keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.edge_to = np.array([n for _, n in edges], dtype=np.int64)
        self.length = np.zeros(self.size, dtype=np.int64)
        for t, token in self.reachable.items():
            self.length[token] = len(t)
        self.inner = np.array(sorted({ord(t[k]) << 21 | ord(t[k + 1]) for t in self.reachable for k in range(len(t) - 1)}), dtype=np.int64)

    def _outputs(self, plain: list[bool]) -> None:
        """Decimal digits with a comma, and bytes of text, of every token."""
        digits = [f"{i},".encode() for i in range(self.size)]
        self.digit_count = np.array([len(d) for d in digits])
        width = int(self.digit_count.max())
        self.digits = np.array([list(d.ljust(width)) for d in digits], dtype=np.uint8)
        self.digit_used = np.arange(width) < self.digit_count[:, None]
        bodies = [t.encode() if ok else b"" for t, ok in zip(self.text, plain)]
        for value, token in enumerate(self.byte_ids):
            bodies[token] = bytes([value])
        self.is_byte = np.zeros(self.size, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.body_count = np.array([len(x) for x in bodies])
        self.body_start = np.cumsum(self.body_count) - self.body_count
        self.bodies = np.frombuffer(b"".join(bodies), dtype=np.uint8)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does encoding the joined texts of tokens a and b give a and b again?"""
        run_a, run_b = self.is_run[a], self.is_run[b]
        out = np.isin(a * self.size + b, self.run_pairs)
        todo = np.flatnonzero(~run_b)
        x, y = np.where(run_a[todo], self.space, a[todo]), b[todo]
        key = x * self.size + y
        slot = (key * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
        known = self.pair_keys[slot] == key
        ok = self.pair_ok[slot]
        new = np.flatnonzero(~known)
        if len(new):
            ok[new] = self._test(x[new], y[new])
            self.pair_keys[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        out[todo] = ok
        return out

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges of both tokens, youngest first; a merge across the border that was due earlier forbids the pair."""
        ok = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        limit = np.full(len(a), 1 << 40, dtype=np.int64)
        while len(at):
            key = a * self.size + b
            k = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            crosses = (self.join_keys[k] == key) & (self.rank[self.join_ids[k]] * 2 < limit)
            ok[at[crosses]] = False
            # The right end of a is undone if its last merge is the younger one; equal merges happen from left to right,
            # so that of a left token comes first and one across the border, of the same rank, lies between the two.
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            first = ~whole_a & (whole_b | (self.rank[a] > self.rank[b]))
            limit = np.where(first, self.rank[a] * 2, self.rank[b] * 2 + 1)
            go = ~crosses & ~(whole_a & whole_b)
            a, b = np.where(first, self.right[a], a)[go], np.where(first, b, self.left[b])[go]
            at, limit = at[go], limit[go]
        return ok

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        state = state.copy()
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] << 21 | char[todo]
            k = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[k] == key
            at_root = state[todo] == 0
            state[todo] = np.where(hit, self.edge_to[k], self.fail[state[todo]])
            todo = todo[~hit & ~at_root]
        return state

    def encode_cuts(self, chars: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings of code points, given as runs of `chars`: all ids end to end, and how many each string has."""
        order = np.argsort(-counts, kind="stable")
        starts, counts_sorted = starts[order], counts[order]
        n, total = len(order), int(counts.sum())
        # last[base + position]: the table of last tokens, string after string
        base = np.cumsum(counts_sorted) - counts_sorted
        last = np.empty(total, dtype=np.int64)
        state = np.zeros(n, dtype=np.int64)
        active = n
        for i in range(int(counts_sorted[0]) if n else 0):
            while counts_sorted[active - 1] <= i:
                active = int(np.searchsorted(-counts_sorted, -i, side="left"))
            state = self.step(state[:active], chars[starts[:active] + i])
            candidate = self.longest[state]
            todo = np.arange(active)
            while len(todo):
                c = candidate[todo]
                unknown = c == NONE
                before = i - self.length[c]
                previous = last[np.maximum(base[todo] + before, 0)]
                free = unknown | (before < 0) | (previous == UNKNOWN)
                good = free.copy()
                test = np.flatnonzero(~free)
                good[test] = self.compatible(previous[test], c[test])
                done = todo[good]
                last[base[done] + i] = np.where(unknown[good], UNKNOWN, c[good])
                todo = todo[~good]
                candidate[todo] = self.shorter[candidate[todo]]
        return self._recover(chars, starts, counts_sorted, base, last, order)

    def _recover(self, chars, starts, counts, base, last, order) -> tuple[np.ndarray, np.ndarray]:
        """Walk back from the ends of the strings; characters without a piece become byte tokens."""
        n = len(counts)
        position = counts - 1
        todo = np.arange(n)
        taken_row, taken_at, taken_id = [], [], []
        while len(todo):
            token = last[base[todo] + position[todo]]
            taken_row.append(todo)
            taken_at.append(position[todo])
            taken_id.append(token)
            position[todo] -= np.where(token == UNKNOWN, 1, self.length[token])
            todo = todo[position[todo] >= 0]
        rows = np.concatenate([order[:0], *taken_row])
        at, token = np.concatenate([order[:0], *taken_at]), np.concatenate([order[:0], *taken_id])
        by = np.argsort(order[rows] * (int(counts.max()) + 1 if n else 1) + at, kind="stable")
        rows, at, token = rows[by], at[by], token[by]
        missing = np.flatnonzero(token == UNKNOWN)
        if len(missing):
            code = chars[starts[rows[missing]] + at[missing]]
            bodies = [chr(c).encode() for c in code.tolist()]
            repeat = np.ones(len(token), dtype=np.int64)
            repeat[missing] = [len(x) for x in bodies]
            rows, token = np.repeat(rows, repeat), np.repeat(token, repeat)
            token[token == UNKNOWN] = self.byte_ids[np.frombuffer(b"".join(bodies), dtype=np.uint8)]
        return token, np.bincount(order[rows], minlength=n)

    def encode_distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct byte strings, in their order."""
        raw = data.tobytes()
        bodies = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        joined = b"".join(bodies).decode("utf-8")
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sizes = ends - starts
        lead = (np.frombuffer(b"".join(bodies), dtype=np.uint8) & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        char_at = np.concatenate([[0], np.cumsum(lead)])[bounds]
        begin, counts = char_at[:-1], np.diff(char_at)
        if not len(counts) or counts.max() <= LONG:
            return self.encode_cuts(chars, begin, counts)
        long = np.flatnonzero(counts > LONG)
        at = ragged(begin[long] + 1, counts[long] - 1)
        key = chars[at - 1] << 21 | chars[at]
        k = np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)
        cuts = np.sort(np.concatenate([begin, at[self.inner[k] != key]]))
        owner = np.searchsorted(begin, cuts, side="right") - 1
        ids, each = self.encode_cuts(chars, cuts, np.diff(np.append(cuts, len(chars))))
        return ids, np.bincount(owner, weights=each, minlength=len(counts)).astype(np.int64)

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all byte spans end to end, and each span's number of ids. Spans are ordered and do not overlap."""
        hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ids, first, counts = self.cache.ids_of(distinct, lambda new: self.encode_distinct(data, starts[index[new]], ends[index[new]]))
        return ids[ragged(first[inverse], counts[inverse])], counts[inverse]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk end to end, and each text's number of ids."""
        data, offsets = chunk.data, chunk.offsets
        sizes = np.diff(offsets)
        if MARK.encode() in data.tobytes():
            raw = data.tobytes()
            bodies = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, sizes = np.frombuffer(b"".join(bodies), dtype=np.uint8), np.array([len(x) for x in bodies])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        full = np.flatnonzero(sizes)
        data = np.insert(data, offsets[full], SPACE)
        begins = offsets[full] + np.arange(len(full))
        space = data == SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[begins] = True
        starts = np.flatnonzero(cut)
        ids, counts = self.encode_spans(data, starts, np.append(starts[1:], len(data)))
        ends = np.concatenate([[0], np.cumsum(counts)])
        per_text = np.zeros(len(sizes), dtype=np.int64)
        per_text[full] = np.diff(ends[np.append(np.searchsorted(starts, begins), len(starts))])
        return ids, per_text

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of some ids as UTF-8, without the leading space that encoding added; bytes that are no UTF-8 are replaced."""
        raw = self.bodies[ragged(self.body_start[ids], self.body_count[ids])].tobytes()
        if self.is_byte[ids].any():
            raw = repaired(raw)
        return raw[1:] if len(ids) and raw[:1] == b" " and not self.is_byte[ids[0]] else raw


def repaired(raw: bytes) -> bytes:
    """Every byte that is not part of a valid character becomes U+FFFD."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "surrogateescape")
        return "".join("�" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in text).encode()


class Cache:
    """Ids of strings by hash: sorted hashes, each with a run of one flat array. Bounded; a full one starts again."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def ids_of(self, keys: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: sorted and distinct. encode(indices of unknown keys) gives their ids and counts."""
        if len(self.keys) > CACHE_ENTRIES:
            self.clear()
        slot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[slot] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids, counts = encode(new)
            begin = np.cumsum(counts) - counts + len(self.flat)
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.first, self.count = np.insert(self.first, where, begin), np.insert(self.count, where, counts)
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            slot = np.searchsorted(self.keys, keys)
        return self.flat, self.first[slot], self.count[slot]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every text, as an array of ints."""
    path = model or default_model()

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        ids, counts = vocabulary(path).encode(chunk)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([chunk.ids, lists], names=["doc_id", "ids"])

    return each_chunk(docs, kernel, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text): the texts of arrays of ids; a null array is the empty text."""
    path = model or default_model()

    def run(batches):
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [vocabulary(path).decode(np.array(x or [], dtype=np.int64)).decode() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode every text and decode its ids again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and texts stay inside the task; only their digests leave it.
    """
    path = model or default_model()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        v = vocabulary(path)
        ids, counts = v.encode(chunk)
        ends = np.cumsum(counts)
        shown = v.digits[ids][v.digit_used[ids]].tobytes()
        shown_ends = np.concatenate([[0], np.cumsum(v.digit_count[ids])])
        bodies = v.bodies[ragged(v.body_start[ids], v.body_count[ids])].tobytes()
        body_ends = np.concatenate([[0], np.cumsum(v.body_count[ids])])
        coded, decoded = [], []
        shown_view, body_view = memoryview(shown), memoryview(bodies)
        for lo, hi in zip((ends - counts).tolist(), ends.tolist()):
            coded.append(hashlib.sha256(shown_view[shown_ends[lo]:max(shown_ends[hi] - 1, shown_ends[lo])]).hexdigest())
            # encoding leaves only whole characters, so the bytes need no repair; the first token begins with the added space
            decoded.append(hashlib.sha256(body_view[min(body_ends[lo] + 1, body_ends[hi]):body_ends[hi]]).hexdigest())
        return table_of(names, types, [chunk.ids, counts, coded, decoded])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return each_chunk(docs, kernel, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
