"""Media columns: AVI files with motion-JPEG frames (operator 9).

Bytes are stored without loss as the grey levels of flat 8 x 8 blocks. With a quantiser of 8 for the DC coefficient, the
quantised coefficient of a flat block of level v is v - 128 exactly, and all others are zero. The frames carry Huffman tables
of their own: category c of a DC difference has a code of 9 - c bits and c bits follow, and the only AC code, one bit, ends the
block. So every block takes ten bits, four blocks take five bytes, and frames are coded and decoded with arrays, while they stay
ordinary baseline JPEG. A frame has 64 x 16 blocks; the last is filled up with zeros, and a `plen` chunk tells the payload's
length.

Reading parses the RIFF tree and the `idx1` index and decodes each frame on its own: frames with the header above with arrays,
other one-component baseline frames by a plain Huffman and cosine decoder. Shots are cut where the difference of the grey
histograms of neighbouring frames exceeds a threshold that adapts to the differences around it.

Defined results: null and empty texts are 64 zero bytes; equal texts give equal files; rows with equal or null ids are rows of
their own; a file without frames has no clips; a broken file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.text import Chunk, each_chunk, table_of

ROW = 64
ROWS = 16
SAMPLES = ROW * ROWS
FRAMES_PER_SECOND = 25
BINS = 16
#: A cut needs a histogram difference above mean + SPREAD deviations of up to AROUND differences on each side, and above FLOOR.
SPREAD, AROUND, FLOOR = 2.0, 8, 0.08


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


FRAME_HEAD = b"".join([
    b"\xff\xd8",
    _segment(0xDB, bytes([0, 8]) + b"\x01" * 63),
    _segment(0xC0, struct.pack(">BHHB3B", 8, ROWS * 8, ROW * 8, 1, 1, 0x11, 0)),
    _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))),
    _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0])),
    _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])
FRAME_TAIL = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit code of each difference -255..255, and the difference of each code."""
    of = np.zeros(511, dtype=np.uint64)
    back = np.zeros(1024, dtype=np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2
        code = ((prefix << c) | (d if d > 0 else d + (1 << c) - 1)) << 1
        of[d + 255] = code
        back[code] = d
    return of, back


CODE_OF, DIFFERENCE_OF = _codes()


def code_frames(samples: np.ndarray) -> list[bytes]:
    """Frames (rows of SAMPLES bytes) as JPEG files."""
    level = samples.astype(np.int16) - 128
    step = np.diff(level, axis=1, prepend=np.int16(0))
    four = CODE_OF[step.reshape(-1, 4) + 255]
    joined = (four[:, 0] << np.uint64(30)) | (four[:, 1] << np.uint64(20)) | (four[:, 2] << np.uint64(10)) | four[:, 3]
    scan = np.ascontiguousarray(joined.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).reshape(len(samples), -1)
    full = scan == 0xFF
    ends = np.cumsum(full.sum(axis=1) + scan.shape[1])
    stuffed = np.insert(scan.ravel(), np.flatnonzero(full) + 1, 0).tobytes()
    return [FRAME_HEAD + stuffed[a:b] + FRAME_TAIL for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples of frames made by `code_frames`, a row each; other baseline frames give the mean level of each block."""
    head, tail = len(FRAME_HEAD), len(FRAME_TAIL)
    known = [f[:head] == FRAME_HEAD for f in frames]
    if not all(known):
        rows = [decode_frames([f])[0] if ok else block_levels(decode_baseline(f)) for f, ok in zip(frames, known)]
        if len({len(r) for r in rows}) > 1:
            raise ValueError("frames of different sizes in one stream")
        return np.array(rows)
    scan = np.frombuffer(b"".join(f[head:-tail] for f in frames), dtype=np.uint8)
    stuffing = np.zeros(len(scan), dtype=bool)
    stuffing[1:] = (scan[1:] == 0) & (scan[:-1] == 0xFF)
    body = scan[~stuffing]
    if len(body) != len(frames) * SAMPLES * 10 // 8:
        raise ValueError("a frame's scan is cut short")
    wide = np.zeros((len(body) // 5, 8), dtype=np.uint8)
    wide[:, 3:] = body.reshape(-1, 5)
    joined = wide.view(">u8").astype(np.uint64).ravel()
    codes = np.empty((len(joined), 4), dtype=np.int64)
    for k in range(4):
        codes[:, k] = (joined >> np.uint64(30 - 10 * k)) & np.uint64(1023)
    level = np.cumsum(DIFFERENCE_OF[codes].reshape(len(frames), SAMPLES), axis=1, dtype=np.int32)
    return (level + 128).astype(np.uint8)


def block_levels(picture: np.ndarray) -> np.ndarray:
    h, w = picture.shape
    blocks = picture[:h // 8 * 8, :w // 8 * 8].reshape(h // 8, 8, w // 8, 8)
    return np.rint(blocks.mean(axis=(1, 3))).astype(np.uint8).ravel()


def _zigzag() -> list[int]:
    cells = sorted(((r, c) for r in range(8) for c in range(8)),
                   key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return [r * 8 + c for r, c in cells]


def decode_baseline(frame: bytes) -> np.ndarray:
    """Grey picture of any one-component baseline JPEG without restart intervals."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quantisers, tables, at, size, use = {}, {}, 2, None, None
    while True:
        marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4:at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1:65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide:]
        elif marker == 0xC4:
            while body:
                counts, code, symbols, k = body[1:17], 0, {}, 17
                for bits, n in enumerate(counts, 1):
                    for _ in range(n):
                        symbols[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = symbols, body[k:]
        elif marker == 0xC0:
            size = struct.unpack_from(">HH", body, 1)
            if body[5] != 1:
                raise ValueError("only one-component frames are supported")
            quantiser = body[8]
        elif marker == 0xDA:
            use = tables[body[2] >> 4], tables[0x10 | (body[2] & 15)]
            break
        elif marker in (0xDD, 0xC2):
            raise ValueError("restart intervals and progressive frames are not supported")
    scan = frame[at:frame.rindex(FRAME_TAIL)].replace(b"\xff\x00", b"\xff")
    bits = np.unpackbits(np.frombuffer(scan, dtype=np.uint8)).tolist()
    place = 0

    def symbol(table: dict) -> int:
        nonlocal place
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits[place]
            place += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def amplitude(n: int) -> int:
        nonlocal place
        value = int("0" + "".join(map(str, bits[place:place + n])), 2)
        place += n
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1

    order, (height, width), dc = _zigzag(), size, 0
    wave = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    picture = np.zeros((-(-height // 8) * 8, -(-width // 8) * 8))
    for top in range(0, height, 8):
        for left in range(0, width, 8):
            block = np.zeros(64)
            dc += amplitude(symbol(use[0]))
            block[0], k = dc * quantisers[quantiser][0], 1
            while k < 64:
                s = symbol(use[1])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[order[k]] = amplitude(s & 15) * quantisers[quantiser][k]
                k += 1
            picture[top:top + 8, left:left + 8] = wave @ block.reshape(8, 8) @ wave.T + 128
    return np.clip(np.rint(picture[:height, :width]), 0, 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], payload_bytes: int) -> bytes:
    """An AVI file of JPEG frames with an index."""
    width, height, biggest = ROW * 8, ROWS * 8, max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, 0, 0, 0x10, len(frames), 0, 1, biggest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, len(frames), biggest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    at, index, movie = 4, [], [b"movi"]
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    body = header + _chunk(b"plen", struct.pack("<Q", payload_bytes)) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def read_avi(media: bytes) -> tuple[list[bytes], int | None, float]:
    """Frames by the index, the stored payload length if there is one, and the seconds of a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    parts: dict[bytes, tuple[int, int]] = {}
    stack = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            if name == b"LIST":
                kind = media[at + 8:at + 12]
                parts[kind] = at + 8, size
                if kind != b"movi":
                    stack.append((at + 12, at + 8 + size))
            else:
                parts[name] = at + 8, size
            at += 8 + size + (size & 1)
    if not {b"avih", b"movi", b"idx1"} <= parts.keys():
        raise ValueError("an AVI file without header, frames or index")
    base = parts[b"movi"][0]
    at, size = parts[b"idx1"]
    frames = []
    for name, _, offset, length in struct.iter_unpack("<4sIII", media[at:at + size // 16 * 16]):
        if name[2:] in (b"dc", b"db"):
            if media[base + offset:base + offset + 4] != name:  # some writers count from the start of the file
                offset -= base
            frames.append(media[base + offset + 8:base + offset + 8 + length])
    payload = struct.unpack_from("<Q", media, parts[b"plen"][0])[0] if b"plen" in parts else None
    return frames, payload, struct.unpack_from("<I", media, parts[b"avih"][0])[0] / 1e6


def histograms(samples: np.ndarray) -> np.ndarray:
    """Share of each of the grey bins in each frame."""
    n = len(samples)
    cells = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(cells.ravel(), minlength=n * BINS).reshape(n, BINS) / max(samples.shape[1], 1)


def shot_starts(shares: np.ndarray) -> list[int]:
    """First frames of the shots of one film."""
    if not len(shares):
        return []
    change = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    if not len(change):
        return [0]
    padded = np.concatenate([[0.0], np.cumsum(change)])
    squares = np.concatenate([[0.0], np.cumsum(change ** 2)])
    at = np.arange(len(change))
    lo, hi = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, len(change))
    n = np.maximum(hi - lo - 1, 1)
    mean = (padded[hi] - padded[lo] - change) / n
    deviation = np.sqrt(np.maximum((squares[hi] - squares[lo] - change ** 2) / n - mean ** 2, 0))
    return [0, *(np.flatnonzero(change > np.maximum(mean + SPREAD * deviation, FLOOR)) + 1).tolist()]


def pack(chunk: Chunk) -> list[bytes]:
    """The AVI files of a chunk's texts."""
    sizes = np.diff(chunk.offsets)
    payload = np.maximum(-(-sizes // ROW) * ROW, ROW)
    counts = -(-payload // SAMPLES)
    begin = np.cumsum(counts) - counts
    samples = np.zeros(int(counts.sum()) * SAMPLES, dtype=np.uint8)
    for k, at in enumerate((begin * SAMPLES).tolist()):
        samples[at:at + sizes[k]] = chunk.data[chunk.offsets[k]:chunk.offsets[k + 1]]
    frames = code_frames(samples.reshape(-1, SAMPLES))
    return [write_avi(frames[a:a + n], p) for a, n, p in zip(begin.tolist(), counts.tolist(), payload.tolist())]


def unpack(media: list[bytes]) -> tuple[list[bytes], list[list[int]], list[int], list[float]]:
    """Of each file: its payload, the first frames of its shots, its number of frames and the seconds of a frame."""
    films = [read_avi(m) for m in media]
    counts = [len(f) for f, _, _ in films]
    samples = decode_frames([x for f, _, _ in films for x in f])
    shares = histograms(samples)
    payloads, shots, at = [], [], 0
    for n, (_, size, _) in zip(counts, films):
        film = samples[at:at + n]
        payloads.append(film.tobytes()[:film.size if size is None else size])
        shots.append(shot_starts(shares[at:at + n]))
        at += n
    return payloads, shots, counts, [s for _, _, s in films]


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text as an AVI file."""

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        return table_of(["doc_id", "media"], [None, pa.binary()], [chunk.ids, pack(chunk)])

    return each_chunk(docs, kernel, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def clips(media: DataFrame) -> DataFrame:
    """One row per shot of the files in (doc_id, media): clip number, frames and seconds. Null files have no clips."""
    names = ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # files can be large: one at a time
                file = batch.column("media")[k].as_py()
                _, (starts,), (count,), (seconds,) = unpack([file])
                ends = [*starts[1:], count]
                n = len(starts)
                yield table_of(names, types, [batch.column("doc_id").take(pa.array([k] * n, pa.int64())), range(n), starts,
                                              [b - a for a, b in zip(starts, ends)], [a * seconds for a in starts], [b * seconds for b in ends]])

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, clip int, first_frame long, frames long, start_s double, end_s double"
    return media.select("doc_id", "media").where(F.col("media").isNotNull()).mapInArrow(run, schema)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Store every text as an AVI file, read the file back, and return digests of both with the clips as `feature`."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        media = pack(chunk)
        payloads, shots, counts, _ = unpack(media)
        return table_of(names, types, [
            chunk.ids, np.diff(chunk.offsets), [len(p) for p in payloads], [hashlib.sha256(p).hexdigest() for p in payloads],
            [zlib.crc32(p[-ROW:]) for p in payloads], [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media],
            [f"frames={n};shots={','.join(map(str, s))}" for n, s in zip(counts, shots)]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return each_chunk(docs, kernel, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                                    "media_bytes long, media_sha256 string, feature string")
