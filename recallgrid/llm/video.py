"""Motion-JPEG in AVI files: frames stored without loss, read by the RIFF index, and cut into shots.

A frame is 24 x 24 samples of 8 bits in the lossless process of JPEG (predictor: the sample to the left). Its code table gives
category s a code of 9 - s bits, so that a difference always takes 9 bits with its s extra bits; frames with this header
are coded and decoded many at a time. Frames with other tables or predictors are decoded bit by bit.

Shots begin where the difference between the histograms of neighbouring frames stands out from the differences around it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import binary_array, flat, released, slices

SIDE = 24
FRAME = SIDE * SIDE
FILL = 255
FRAMES_PER_SECOND = 24
#: Frames to either side that a difference is held against, spreads above their mean, and the least share of all samples.
AROUND, SPREADS, LEAST_SHARE = 8, 2.5, 0.15

_SYMBOLS = bytes(range(8, -1, -1))
HEAD = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB", 19 + len(_SYMBOLS), 0) + bytes([1] * 9 + [0] * 7) + _SYMBOLS
    + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
)
TAIL = b"\xff\xd9"


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (9 - s)) - 2) << s  # 8 - s ones and a zero, then s bits
        code[d + 255] = prefix | (d if d >= 0 else d + (1 << s) - 1)
        back[code[d + 255]] = d
    return code, back


_CODE, _DIFFERENCE = _code_tables()


def code_frames(samples: np.ndarray) -> np.ndarray:
    """(frames, 576) samples to (frames, 648) coded bytes, not yet stuffed."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    v = _CODE[d.reshape(-1, 8) + 255]
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (v[:, j - 1] << (8 - j)) | (v[:, j] >> (j + 1))
    out[:, 8] = v[:, 7]
    return out.reshape(-1, FRAME * 9 // 8)


def decode_frames(coded: np.ndarray) -> np.ndarray:
    """What ``code_frames`` has made, back to samples."""
    b = coded.reshape(-1, 9).astype(np.uint16)
    v = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        v[:, i] = ((b[:, i] << (i + 1)) | (b[:, i + 1] >> (7 - i))) & 511
    d = _DIFFERENCE[v].reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def decode_jpeg(jpeg: bytes) -> np.ndarray:
    """Samples (rows, columns) of a lossless JPEG of one component, with any code table and predictor."""
    at, tables, rows, columns, predictor = 2, {}, 0, 0, 1
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                counts, symbols, code, table = body[1:17], body[17 : 17 + sum(body[1:17])], 0, {}
                k = 0
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = table
                body = body[17 + k :]
        elif marker == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only one component of 8 bits is read")
            rows, columns = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDA:
            table, predictor = tables[body[2] >> 4], body[3]
            break
        elif marker in (0xC0, 0xC1, 0xC2, 0xD9):
            raise ValueError("not a lossless frame")
    bits = iter(np.unpackbits(np.frombuffer(jpeg[at : jpeg.rindex(TAIL)].replace(b"\xff\x00", b"\xff"), np.uint8)).tolist())
    out = np.zeros((rows, columns), np.int64)
    for y in range(rows):
        for x in range(columns):
            code = length = 0
            while (length, code) not in table:
                code, length = code << 1 | next(bits), length + 1
                if length > 16:
                    raise ValueError("no such code")
            s = table[length, code]
            extra = 0
            for _ in range(s):
                extra = extra << 1 | next(bits)
            d = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            a = out[y, x - 1] if x else 0
            b = out[y - 1, x] if y else 0
            c = out[y - 1, x - 1] if x and y else 0
            guess = 128 if not (x or y) else a if not y else b if not x else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            out[y, x] = (guess + d) & 0xFF
    return out.astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames with its index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<3I", 0x10, at, len(f)))
        movie.append(_chunk(b"00dc", f))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def read_index(avi: bytes) -> tuple[list[tuple[int, int]], int]:
    """(place, size) of the video frames by ``idx1``, and microseconds per frame."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, found, microseconds = 12, 0, b"", 1_000_000 // FRAMES_PER_SECOND
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            microseconds = struct.unpack_from("<I", avi, at + 20)[0]
        elif name == b"idx1":
            found = avi[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    entries = [(k, o, s) for k, _, o, s in struct.iter_unpack("<4s3I", found) if k[2:] in (b"dc", b"db")]
    # Places count from "movi" or, in some files, from the start of the file.
    base = movie if not entries or avi[movie + entries[0][1] : movie + entries[0][1] + 4] == entries[0][0] else 0
    return [(base + o + 8, s) for _, o, s in entries], microseconds


def shot_starts(samples: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each frame opens a shot. ``bounds``: the first frame of each video, and the number of all."""
    n = len(samples)
    bins = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    opens = np.zeros(n, bool)
    opens[bounds[:-1]] = True
    d = np.zeros(n, np.int64)
    d[1:] = np.abs(np.diff(bins, axis=0)).sum(1)
    d[opens] = 0
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    video = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    i = np.arange(n)
    low = np.maximum(i - AROUND, bounds[video] + 1)
    high = np.maximum(np.minimum(i + AROUND + 1, bounds[video + 1]), low)
    others = np.maximum(high - low - 1, 0)
    mean = (sums[high] - sums[low] - d) / np.maximum(others, 1)
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - d * d) / np.maximum(others, 1) - mean * mean, 0))
    limit = np.maximum(mean + SPREADS * spread, LEAST_SHARE * 2 * samples.shape[1])
    return opens | (d > limit)


_CLIPS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("clip", "first_frame", "last_frame", "start_us", "end_us")] + [T.StructField("brightness", T.DoubleType())]))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``media``: an AVI file whose samples are the bytes of the text, filled up with 255 to whole frames, one at
    least. Null counts as empty. Rows pass one by one; a column ``media`` is replaced; an AVI file ends at 4 GB."""
    docs = docs.drop("media")
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = flat(batch.column(text))
                size = np.diff(bounds)
                frames = np.maximum(-(-size // FRAME), 1)
                first = np.concatenate([[0], np.cumsum(frames)])
                samples = np.full(first[-1] * FRAME, FILL, np.uint8)
                samples[np.arange(len(data)) + np.repeat(first[:-1] * FRAME - bounds[:-1], size)] = data
                coded = code_frames(samples)
                marks = np.flatnonzero(coded.ravel() == 255)
                stuffed = np.insert(coded.ravel(), marks + 1, 0).tobytes()
                ends = np.arange(1, len(coded) + 1) * coded.shape[1]
                ends = (ends + np.searchsorted(marks, ends)).tolist()
                jpegs = [HEAD + stuffed[a:b] + TAIL for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                media = binary_array([write_avi(jpegs[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*batch.columns, media], [*names, "media"])

    return docs.mapInArrow(released(kernel), T.StructType([*docs.schema.fields, T.StructField("media", T.BinaryType())]))


def read(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with ``payload`` (all samples of the file) and ``clips``, its shots with their times.

    A null file gives null for both; a file without frames an empty payload and no clips; one that isn't AVI is an error.
    """
    rows = rows.drop("payload", "clips")
    names = rows.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, media):
                coded, other, counts, times = [], [], [], []
                for avi in batch.column(media).to_pylist():
                    index, us = read_index(avi) if avi is not None else ([], 0)
                    counts.append(len(index))
                    times.append(us)
                    for at, size in index:
                        frame = avi[at : at + size]
                        bare = frame[len(HEAD) : -2].replace(b"\xff\x00", b"\xff") if frame.startswith(HEAD) and frame.endswith(TAIL) else b""
                        if len(bare) != FRAME * 9 // 8:
                            other.append((len(coded), decode_jpeg(frame)))
                            bare = bytes(FRAME * 9 // 8)
                        coded.append(bare)
                samples = decode_frames(np.frombuffer(b"".join(coded), np.uint8))
                for k, image in other:
                    if image.size != FRAME:
                        raise ValueError(f"frames of {FRAME} samples are read")
                    samples[k] = image.ravel()
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                opens = shot_starts(samples, bounds[np.concatenate([[True], np.diff(bounds) > 0])]) if len(samples) else np.zeros(0, bool)
                sums = np.concatenate([[0], np.cumsum(samples.sum(1, dtype=np.int64))])
                starts, flat_bytes = np.flatnonzero(opens), samples.tobytes()
                ends = np.append(starts[1:], len(samples))
                per = np.searchsorted(starts, bounds)
                payloads, clips = [], []
                for v, avi in enumerate(batch.column(media)):
                    a, b = int(bounds[v]), int(bounds[v + 1])
                    payloads.append(flat_bytes[a * FRAME : b * FRAME] if avi.is_valid else None)
                    clips.append(
                        [
                            (k, s - a, e - a - 1, (s - a) * times[v], (e - a) * times[v], float(sums[e] - sums[s]) / ((e - s) * FRAME))
                            for k, (s, e) in enumerate(zip(starts[per[v] : per[v + 1]].tolist(), ends[per[v] : per[v + 1]].tolist(), strict=True))
                        ]
                        if avi.is_valid
                        else None
                    )
                names_of = [f.name for f in _CLIPS.elementType]
                clip_type = pa.list_(pa.struct([(n, pa.float64() if n == "brightness" else pa.int64()) for n in names_of]))
                made = pa.array([c and [dict(zip(names_of, x, strict=True)) for x in c] for c in clips], clip_type)
                yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(payloads), made], [*names, "payload", "clips"])

    return rows.mapInArrow(released(kernel), T.StructType([*rows.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("clips", _CLIPS)]))


def clip_rows(rows: DataFrame, media: str = "media") -> DataFrame:
    """One row for each shot of each file: the columns of ``rows`` but the file, and those of the clip."""
    found = read(rows, media)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns if c != media], F.inline("clips"))
