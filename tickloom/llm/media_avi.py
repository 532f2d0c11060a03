"""Media columns: AVI files of losslessly coded motion-JPEG frames, and their shots.

A payload is cut into frames of 24 x 24 samples. Each frame is a lossless JPEG (SOF3, predictor 1), so the stored
samples are the payload itself. The Huffman lengths are 9 minus the difference category (a complete code but for
the all-ones word that JPEG reserves), so each sample takes exactly nine bits, and coding and decoding are
array operations. The container is RIFF AVI with an MJPG stream and an idx1 index; readers follow the index.

Shots: the distance of the grey histograms of neighbouring frames; a cut is where it exceeds twice the distance that
chance gives two frames of one source, and the median plus `spread` standard deviations (from the median absolute
deviation) of the other distances in a sliding window. So up to half of a window's distances may be cuts; films of at
most `SHORT` frames go by chance alone. Clips are the runs between cuts, with times.

Defined results: a null text is the empty text; the empty text gives one frame of padding; equal texts give equal
media and features; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import ids_and_text, sliced, strings

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
BINS = 32
WINDOW = 12
SPREAD = 2.0
LEAST_CUT = 0.05
#: Frames of films that have too few distances for a median.
SHORT = 6
#: Standard deviations of normal values in one median absolute deviation.
DEVIATION = 1.4826


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit word of each difference (index difference + 255), and the difference of each word."""
    word = np.zeros(511, dtype=np.uint16)
    value = np.zeros(512, dtype=np.int16)
    code, length = 0, 1
    for category in range(8, -1, -1):  # canonical: shorter codes first
        length = 9 - category
        for d in ([0] if category == 0 else [*range(-(1 << category) + 1, -(1 << (category - 1)) + 1), *range(1 << (category - 1), 1 << category)]):
            extra = d if d >= 0 else d + (1 << category) - 1
            w = (code << category) | extra
            word[d + 255] = w
            value[w] = d
        code = (code + 1) << 1
    return word, value


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    frame = struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes((1, 0x11, 0))
    lengths = bytes((1,) * 9 + (0,) * 7)
    huffman = bytes((0,)) + lengths + bytes(range(8, -1, -1))
    scan = bytes((1, 1, 0, 1, 0, 0))
    return b"\xff\xd8" + _segment(0xC3, frame) + _segment(0xC4, huffman) + _segment(0xDA, scan)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames given as an array (n, 24, 24) of bytes."""
    word, _ = _tables()
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    codes = word[diff.reshape(-1, 8) + 255].astype(np.uint32)
    packed = np.empty((len(codes), 9), dtype=np.uint8)
    packed[:, 0] = codes[:, 0] >> 1
    for j in range(1, 8):
        packed[:, j] = ((codes[:, j - 1] << (8 - j)) | (codes[:, j] >> (j + 1))) & 0xFF
    packed[:, 8] = codes[:, 7] & 0xFF
    head, flat, size = _jpeg_head(), packed.tobytes(), FRAME * 9 // 8
    return [head + flat[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(flat), size)]


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Samples (n, 24, 24) of frames made by encode_frames, from the entropy-coded bytes of each file."""
    if not jpegs:
        return np.zeros((0, SIDE, SIDE), dtype=np.uint8)
    _, value = _tables()
    head = _jpeg_head()
    scans = []
    for j in jpegs:
        if not j.startswith(head) or not j.endswith(b"\xff\xd9"):
            raise ValueError("not a frame of this format")
        scans.append(j[len(head) : -2].replace(b"\xff\x00", b"\xff"))
    packed = np.frombuffer(b"".join(scans), dtype=np.uint8).reshape(-1, 9).astype(np.uint16)
    codes = np.empty((len(packed), 8), dtype=np.uint16)
    for k in range(8):
        codes[:, k] = (((packed[:, k] << 8) | packed[:, k + 1]) >> (7 - k)) & 0x1FF
    diff = value[codes].reshape(-1, SIDE, SIDE).astype(np.int32)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return np.cumsum(diff, axis=2).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(jpegs: list[bytes], payload_bytes: int) -> bytes:
    """An AVI file of the frames; the comment holds the number of payload bytes before padding."""
    n = len(jpegs)
    largest = max(map(len, jpegs))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d" % payload_bytes))
    index, body, at = [], [], 4
    for j in jpegs:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        body.append(_chunk(b"00dc", j))
        at += len(body[-1])
    inner = header + info + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + inner)


def read_avi(data: bytes) -> tuple[list[bytes], int, float]:
    """Frames by the idx1 index, payload bytes before padding, frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    payload, movi, index, fps = 0, 0, b"", float(FPS)
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl":
            head = data.find(b"avih", at, at + 8 + size)
            fps = 1e6 / struct.unpack_from("<I", data, head + 8)[0]
        elif name == b"LIST" and kind == b"INFO":
            note = data.find(b"payload=", at, at + 8 + size)
            payload = int(data[note + 8 : at + 8 + size].rstrip(b"\0"))
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    frames = [data[movi + o + 8 : movi + o + 8 + n] for fourcc, _, o, n in struct.iter_unpack("<4sIII", index) if fourcc == b"00dc"]
    return frames, payload, fps


def shot_starts(frames: np.ndarray) -> list[int]:
    """First frame of each shot."""
    n = len(frames)
    if n < 2:
        return [0] * min(n, 1)
    grey = (frames.reshape(n, -1) >> 3).astype(np.int64) + np.arange(n)[:, None] * BINS
    histogram = np.bincount(grey.ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2.0 * FRAME)
    # of two counts with one mean the expected distance is about sqrt(2 / pi) standard deviations of their difference
    chance = np.sqrt(2 / np.pi * (histogram[1:] + histogram[:-1])).sum(axis=1) / (2.0 * FRAME)
    cut = change > np.maximum(LEAST_CUT, 2 * chance)
    if n > SHORT:
        cut &= change > usual(change)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def usual(change: np.ndarray) -> np.ndarray:
    """Median plus spread of the other distances in the window of each; of an even number, the lower median."""
    padded = np.concatenate([np.full(WINDOW, np.inf), change, np.full(WINDOW, np.inf)])
    offsets = np.delete(np.arange(2 * WINDOW + 1), WINDOW)
    out = np.empty(len(change))
    for at in range(0, len(change), 1 << 14):
        others = padded[np.arange(at, min(at + (1 << 14), len(change)))[:, None] + offsets]
        middle = ((np.isfinite(others).sum(axis=1) - 1) // 2)[:, None]
        median = np.take_along_axis(np.sort(others, axis=1), middle, axis=1)
        deviation = np.take_along_axis(np.sort(np.abs(others - median), axis=1), middle, axis=1)
        out[at : at + len(others)] = (median + SPREAD * DEVIATION * deviation)[:, 0]
    return out


def to_avi(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: the UTF-8 bytes of each text, padded with bytes 255 to a positive multiple of 576, as AVI."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1_000_000):
            raw = [t.encode() for t in strings(batch.column("text"))]
            counts = [max(1, -(-len(r) // FRAME)) for r in raw]
            flat = b"".join(r.ljust(c * FRAME, b"\xff") for r, c in zip(raw, counts, strict=True))
            jpegs = encode_frames(np.frombuffer(flat, dtype=np.uint8).reshape(-1, SIDE, SIDE))
            media, at = [], 0
            for r, c in zip(raw, counts, strict=True):
                media.append(write_avi(jpegs[at : at + c], len(r)))
                at += c
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return ids_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield batch.slice(at, 128)


def describe(df: DataFrame) -> DataFrame:
    """Payload and features that are read back from stored media (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows = []
            media = [m.as_py() for m in batch.column("media")]
            read = [read_avi(m) for m in media]
            every = decode_frames([f for frames, _, _ in read for f in frames])
            at = 0
            for m, (jpegs, n_bytes, fps) in zip(media, read, strict=True):
                frames = every[at : at + len(jpegs)]
                at += len(jpegs)
                payload = frames.tobytes()
                shots = shot_starts(frames)
                grey = np.bincount(frames.ravel() >> 5, minlength=8)
                feature = f"frames={len(frames)};shots={len(shots)};seconds={len(frames) / fps:.2f};levels={'-'.join(map(str, grey.tolist()))}"
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], _DESCRIBED)

    return df.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_DESCRIBED = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def clips(df: DataFrame) -> DataFrame:
    """Timed clip rows of stored media (doc_id, media): clip number, first frame, frames, start and end in ms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows = []
            for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                jpegs, _, fps = read_avi(m)
                starts = shot_starts(decode_frames(jpegs))
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(jpegs)], strict=True)):
                    rows.append((i, k, a, b - a, round(a * 1000 / fps), round(b * 1000 / fps)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "clip", "first_frame", "frames", "start_ms", "end_ms"])

    return df.mapInArrow(run, "doc_id long, clip long, first_frame long, frames long, start_ms long, end_ms long")


def to_text(df: DataFrame) -> DataFrame:
    """doc_id and text, decoded from stored media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = []
            for m in batch.column("media").to_pylist():
                jpegs, n, _ = read_avi(m)
                texts.append(decode_frames(jpegs).tobytes()[:n].decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.mapInArrow(run, "doc_id long, text string")
