"""Media columns: grey PNG images in binary columns, and cosine-transform hashes.

A payload of bytes becomes an 8-bit grey image of ``WIDTH`` columns: scan lines
filtered as PNG defines, deflated and put into chunks with check sums. Reading
tests every chunk's check sum, inflates and takes the filters back with numpy.
The feature is a hash of the low frequencies of the image's cosine transform.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
# Fixed values of the PNG format.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_GREY_8 = b"\x08\x00\x00\x00\x00"
_NONE, _SUB, _UP, _AVERAGE, _PAETH = range(5)
_GRID = 32  # the image is averaged to so many rows and columns
_LOW = 8  # of whose frequencies so many by so many are kept
_LEVEL = 3


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple of ``WIDTH``."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    """PNG of a payload whose size is a positive multiple of ``WIDTH``. Of the plain
    and the two difference filters, all lines take the one with the least sum of
    absolute values."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (image, sub, up)]
    kind = int(np.argmin(cost))
    lines = np.empty((len(image), WIDTH + 1), np.uint8)
    lines[:, 0] = (_NONE, _SUB, _UP)[kind]
    lines[:, 1:] = (image, sub, up)[kind]
    size = struct.pack(">II", WIDTH, len(image))
    data = zlib.compress(lines.tobytes(), _LEVEL)
    return (
        _SIGNATURE + _chunk(b"IHDR", size + _GREY_8) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")
    )


def read_png(stored: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG as rows by columns. Raises ValueError if a chunk's
    check sum, the order of chunks or the size of the data is wrong."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, width, height, parts, ended = 8, 0, 0, [], False
    while at < len(stored) and not ended:
        (size,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + size]
        (crc,) = struct.unpack_from(">I", stored, at + 8 + size)
        if zlib.crc32(kind + data) != crc:
            raise ValueError(f"check sum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data)
            if data[8:] != _GREY_8:
                raise ValueError("not 8-bit grey without interlace")
        elif kind == b"IDAT":
            parts.append(data)
        ended, at = kind == b"IEND", at + 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if not ended or lines.size != height * (width + 1):
        raise ValueError("the data does not fill the image")
    lines = lines.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines. Runs of lines with one of the first three filters
    are running sums, taken at once; the two others depend on the sample to the left."""
    out = np.zeros((len(lines) + 1, lines.shape[1]), np.uint8)  # line -1 is zero
    borders = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(borders, borders[1:], strict=False):
        kind = kinds[a] if a < b else _NONE
        if kind == _NONE:
            out[a + 1 : b + 1] = lines[a:b]
        elif kind == _SUB:
            np.cumsum(lines[a:b], axis=1, dtype=np.uint8, out=out[a + 1 : b + 1])
        elif kind == _UP:
            np.cumsum(lines[a:b], axis=0, dtype=np.uint8, out=out[a + 1 : b + 1])
            out[a + 1 : b + 1] += out[a]
        elif kind in (_AVERAGE, _PAETH):
            for k in range(a, b):
                _unfilter_line(kind, lines[k].tolist(), out[k].tolist(), out[k + 1])
        else:
            raise ValueError(f"filter {kind}")
    return out[1:]


def _unfilter_line(kind: int, line: list[int], above: list[int], out: np.ndarray) -> None:
    left = corner = 0
    for k, (value, up) in enumerate(zip(line, above, strict=True)):
        if kind == _AVERAGE:
            guess = (left + up) // 2
        else:
            base = left + up - corner
            guess = min((left, up, corner), key=lambda x: abs(base - x))
        left, corner = (value + guess) & 255, up
        out[k] = left


def _shrink(image: np.ndarray, rows: int) -> np.ndarray:
    """Mean of ``rows`` equal bands of an image of any height, parts of lines included."""
    total = np.vstack([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
    edges = np.linspace(0, len(image), rows + 1)
    low = np.minimum(edges.astype(int), len(image) - 1)
    at = total[low] + (edges - low)[:, None] * (total[low + 1] - total[low])
    return np.diff(at, axis=0) * (rows / len(image))


def _cosines(size: int, kept: int) -> np.ndarray:
    k, x = np.arange(kept)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size))


_BASIS = _cosines(_GRID, _LOW)


def dct_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the low frequencies lie above their median. Rounded
    first, so that equal values do not differ by the order of additions."""
    grid = _shrink(_shrink(image, _GRID).T, _GRID).T
    low = np.round(_BASIS @ grid @ _BASIS.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = low[0] > 128.0 * _GRID * _GRID / 2
    return np.packbits(bits).tobytes().hex()


def store(payload: Column) -> Column:
    """binary: the PNG of ``payload`` filled up by ``padded``; null counts as empty."""

    @F.arrow_udf("binary")
    def store_png(column: pa.Array) -> pa.Array:
        return pa.array((write_png(padded(v.as_py() or b"")) for v in column), pa.binary())

    return store_png(payload)


def stored(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes as a PNG, and what reading the PNG gives.

    Columns ``doc_id, n_bytes, media, payload, feature``. A null text is empty and
    fills one line of zeros; repeated rows stay repeated; other columns are not
    looked at. Every row is handled alone: no shuffle.
    """

    def both(batches):
        for batch in batches:
            media, payload, feature, size = [], [], [], []
            for value in batch.column(1):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                media.append(write_png(padded(raw)))
                image = read_png(media[-1])
                payload.append(image.tobytes())
                feature.append(dct_hash(image))
                size.append(len(raw))
            columns = [size, media, payload, feature]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], _NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string"
    return docs.select("doc_id", "text").mapInArrow(both, schema)


_NAMES = ["doc_id", "n_bytes", "media", "payload", "feature"]
