"""Media columns: payloads as PNG images in binary columns.

encode() writes a greyscale PNG of 8-bit samples, WIDTH to a row: signature, IHDR, IDAT chunks of zlib data, IEND, each with
its CRC-32. decode() tests the signature, every chunk's length and checksum and the zlib stream's own, then undoes the row
filters with numpy: runs of rows with one filter are undone at once. feature() is a hash of the image's low-frequency
cosine transform: the signs of the 8 x 8 lowest coefficients against their median.

Defined results: null text counts as empty and stores 576 bytes of 255; equal texts get equal images and features; a stored
image that fails a test raises ValueError in decode() and has a null feature and the fault's name in inspect(); very long texts are stored whole, a row of
a table at a time in memory; repeated rows and rows that share an id or have none are stored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches

UNIT = 576
WIDTH = 24
CHUNK = 1 << 16
LOW = 8
#: From the PNG specification.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """The filter (none, left or up) is the one whose residuals, taken as signed, have the least sum of magnitudes."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be whole rows")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tries = (rows, left, up)
    kind = int(np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum(dtype=np.int64) for x in tries]))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, tries[kind]
    data = zlib.compress(lines.tobytes(), 6)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + _chunk(b"IEND", b"")


def _slow_rows(kind: int, lines: np.ndarray, above: np.ndarray) -> None:
    """Undoes the average and Paeth filters, in which every sample depends on its left neighbour as restored."""
    for row in lines:
        a = c = 0
        for i in range(len(row)):
            b = int(above[i])
            if kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                guess = a if da <= db and da <= dc else b if db <= dc else c
            a, c = (int(row[i]) + guess) & 255, b
            row[i] = a
        above = row


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    lines = lines.copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
    for lo, hi in zip(edges, edges[1:]):
        kind, part = int(kinds[lo]), lines[lo:hi]
        above = lines[lo - 1] if lo else np.zeros(lines.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (3, 4):
            _slow_rows(kind, part, above)
        elif kind:
            raise ValueError("unknown filter")
    return lines


def decode(image: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(image) and not ended:
        if at + 12 > len(image):
            raise ValueError("cut chunk")
        n, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + n]
        if len(data) != n or at + 12 + n > len(image):
            raise ValueError("cut chunk")
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("bad checksum in a chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError("unknown critical chunk")
        at += 12 + n
    if head is None or not ended or at != len(image):
        raise ValueError("missing chunk or trailing bytes")
    width, height, *form = head
    if form != [8, 0, 0, 0, 0] or not width or not height:
        raise ValueError("not 8-bit greyscale without interlacing")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError("bad zlib stream") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong amount of data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _waves(n: int, lo: int, hi: int) -> np.ndarray:
    """Columns lo to hi of the LOW lowest cosines over n places."""
    return np.cos(np.pi / n * np.outer(np.arange(LOW), np.arange(lo, hi) + 0.5)) * np.sqrt(2 / n)


#: Tables up to PART places are kept, 64 of them at most; longer ones are made a part at a time.
PART = 1024
_kept = lru_cache(64)(_waves)


def _cosines(n: int, lo: int, hi: int) -> np.ndarray:
    return _kept(n, lo, hi) if n <= PART else _waves(n, lo, hi)


def feature(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients are over their median (the constant one is left out of the median)."""
    height, width = samples.shape
    columns = np.zeros((LOW, width))
    for lo in range(0, height, PART):
        hi = min(height, lo + PART)
        columns += _cosines(height, lo, hi) @ samples[lo:hi].astype(np.float64)
    low = np.round((columns @ _cosines(width, 0, width).T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


FIELDS = pa.schema([("doc_id", pa.int64()), ("raw_bytes", pa.int64()), ("media", pa.binary()), ("feature", pa.binary())])


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, raw_bytes, media (PNG), feature (8 bytes, of the image read back)."""

    def run(batches):
        for part in small_batches(batches, 1):
            if part.num_rows:
                raws = [(x or "").encode() for x in part.column(1).to_pylist()]
                images = [encode(padded(x)) for x in raws]
                yield pa.record_batch([part.column(0), pa.array(map(len, raws), pa.int64()), pa.array(images, pa.binary()), pa.array([feature(decode(x)) for x in images], pa.binary())], schema=FIELDS)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, raw_bytes long, media binary, feature binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fault string"


def inspect(media: DataFrame) -> DataFrame:
    """What media_columns() stored -> the digest of each image as it reads back."""

    def run(batches):
        for b in small_batches(batches, 2):
            out = []
            for doc_id, n, image in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    samples = decode(image)
                except ValueError as e:
                    out.append((doc_id, n, None, None, None, len(image), hashlib.sha256(image).hexdigest(), None, str(e)))
                    continue
                back = samples.tobytes()
                out.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples).hex(), None))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return media.select("doc_id", "raw_bytes", "media").mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(media_columns(read(spark, sf_dir, "documents"))).drop("fault")
