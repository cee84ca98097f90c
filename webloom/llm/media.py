"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

Images are decoded without any imaging library, resized by area with the help
of an integral image that is taken only at the rows a box begins or ends at
(so memory does not grow with height), and written as a run of NPY tiles.

Defined results: a null image or text counts as empty; an image of an unknown
kind or with missing samples raises ``ValueError`` in ``decode`` and gives null
columns in ``image_features``; equal bytes give equal results; rows are never
dropped, repeated rows give repeated results, an empty table an empty table.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from webloom.llm.tables import documents, narrow
from webloom.llm.textarrays import utf8_buffers

ROW = 64
TILE_ROWS = 1 << 14

_NUMBER = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A two-dimensional array of bytes as a binary grey map."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An array (height, width, 3) of RGB bytes as an uncompressed 24-bit BMP."""
    height, width, _ = pixels.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = np.array([54 + rows.size, 0, 54, 40, width, height], "<u4").tobytes() + np.array([1, 24], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 0, 0], "<u4").tobytes()
    return b"BM" + head + rows.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, numbers = raw[1] - ord("0"), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _NUMBER.match(raw, at)
        if not found:
            raise ValueError("a Netpbm header breaks off")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, top = numbers[0], numbers[1], (numbers[2] if len(numbers) == 3 else 1)
    planes = 3 if kind in (3, 6) else 1
    n = width * height * planes
    if kind == 1:
        digits = re.sub(rb"#[^\n\r]*|\s", b"", raw[at:])
        if digits[:n].strip(b"01"):
            raise ValueError("samples other than 0 and 1")
        samples = 1 - (np.frombuffer(digits[:n], np.uint8) - ord("0"))
    elif kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\n\r]*", b"", raw[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        bits = np.frombuffer(raw, np.uint8, count=min(stride * height, len(raw) - at - 1), offset=at + 1)
        if len(bits) < stride * height:
            raise ValueError("samples are missing")
        samples = 1 - np.unpackbits(bits.reshape(height, stride), axis=1)[:, :width].reshape(-1)
    else:
        unit = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(raw) - at - 1 < n * unit.itemsize:
            raise ValueError("samples are missing")
        samples = np.frombuffer(raw, unit, count=n, offset=at + 1)
    if len(samples) < n:
        raise ValueError("samples are missing")
    if len(samples) and not 0 <= int(samples.min()) <= int(samples.max()) <= max(top, 1):
        raise ValueError("samples beyond the largest value")
    if top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // max(top, 1)
    return samples.astype(np.uint8, copy=False).reshape((height, width) if planes == 1 else (height, width, 3))


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise ValueError("a BMP header breaks off")
    start, head = (int(x) for x in np.frombuffer(raw, "<u4", 2, 10))
    width, height = (int(x) for x in np.frombuffer(raw, "<i4", 2, 18))
    bits, packed = int(np.frombuffer(raw, "<u2", 1, 28)[0]), int(np.frombuffer(raw, "<u4", 1, 30)[0])
    if packed or bits not in (8, 24, 32):
        raise ValueError("only plain BMP of 8, 24 or 32 bits is read")
    lines, unit = abs(height), bits // 8
    stride = -(-width * unit // 4) * 4
    if len(raw) < start + stride * lines:
        raise ValueError("samples are missing")
    rows = np.frombuffer(raw, np.uint8, stride * lines, start).reshape(lines, stride)[:, : width * unit]
    rows = rows[::-1] if height > 0 else rows
    if unit == 1:
        colours = int(np.frombuffer(raw, "<u4", 1, 46)[0]) or 256
        table = np.frombuffer(raw, np.uint8, colours * 4, 14 + head).reshape(colours, 4)
        return np.ascontiguousarray(table[rows][:, :, 2::-1])
    return np.ascontiguousarray(rows.reshape(lines, width, unit)[:, :, 2::-1])


def decode(raw: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or BMP as (height, width) grey or (height, width, 3) RGB bytes."""
    if re.match(rb"P[1-6]\s", raw[:3]):
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)


def area_resize(pixels: np.ndarray, height: int, width: int, band: int = 4096) -> np.ndarray:
    """Mean of each box of a height by width grid, as floats; boxes may begin and end within a sample.

    The integral image is interpolated at box corners, which weighs cut samples
    by area exactly. Its rows are kept only at box edges.
    """
    rows, columns = pixels.shape
    ys = np.arange(height + 1) * rows / height
    edges = np.unique(np.concatenate((np.floor(ys), np.minimum(np.floor(ys) + 1, rows))).astype(np.int64))
    total, at, kept = np.zeros(columns, np.int64), 0, np.zeros((len(edges), columns), np.int64)
    for k, edge in enumerate(edges):
        while at < edge:
            to = min(int(edge), at + band)
            total = total + pixels[at:to].sum(axis=0, dtype=np.int64)
            at = to
        kept[k] = total
    integral = np.zeros((len(edges), columns + 1))
    integral[:, 1:] = np.cumsum(kept, axis=1)
    low = np.searchsorted(edges, np.floor(ys))
    high = np.searchsorted(edges, np.minimum(np.floor(ys) + 1, rows))
    part = (ys - np.floor(ys))[:, None]
    lines = integral[low] * (1 - part) + integral[high] * part
    xs = np.arange(width + 1) * columns / width
    left = np.floor(xs).astype(np.int64)
    right, share = np.minimum(left + 1, columns), xs - left
    corners = lines[:, left] * (1 - share) + lines[:, right] * share
    boxes = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return boxes / (rows / height * columns / width)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether a box of an 8 by 9 area resize is darker than the one to its right; sixteen hex digits."""
    small = np.round(area_resize(grey(pixels), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def write_tiles(pixels: np.ndarray, tile_rows: int = TILE_ROWS) -> bytes:
    """NPY files, one after another, each of at most ``tile_rows`` rows."""
    out = io.BytesIO()
    for top in range(0, max(len(pixels), 1), tile_rows):
        np.save(out, np.ascontiguousarray(pixels[top : top + tile_rows]))
    return out.getvalue()


def read_tiles(raw: bytes) -> np.ndarray:
    source, tiles = io.BytesIO(raw), []
    while source.tell() < len(raw):
        tiles.append(np.load(source, allow_pickle=False))
    return tiles[0] if len(tiles) == 1 else np.concatenate(tiles)


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def payload_features(raw: bytes) -> tuple[int, int, str, int, int, str, str]:
    """A payload through image, array and tiles and back; figures come from what is read back."""
    image = encode_pgm(np.frombuffer(padded(raw), np.uint8).reshape(-1, ROW))
    stored = write_tiles(decode(image))
    pixels = read_tiles(stored)
    back = pixels.tobytes()
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(pixels)


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text as an image of 64 samples a row, with the features of its tiles. One row a row; null text is empty."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            rows = [payload_features(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_column, *names])

    return narrow(docs, id_column, text_column).mapInArrow(each, f"`{id_column}` {kind}, {FEATURES}")


def image_features(images: DataFrame, id_column: str, image_column: str, height: int = 64, width: int = 64) -> DataFrame:
    """Encoded images as NPY tiles of a given size: id, rows, columns, tiles (binary), feature; nulls where an image cannot be read."""
    kind = images.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                try:
                    pixels = decode(raw or b"")
                    if not pixels.size:
                        raise ValueError("no samples")
                except (ValueError, IndexError, OverflowError):
                    out.append((None, None, None, None))
                    continue
                small = np.clip(np.rint(area_resize(grey(pixels), height, width)), 0, 255).astype(np.uint8)
                out.append((pixels.shape[0], pixels.shape[1], write_tiles(small), difference_hash(pixels)))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            types = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_column, "rows", "columns", "tiles", "feature"])

    return narrow(images, id_column, image_column).mapInArrow(each, f"`{id_column}` {kind}, rows long, columns long, tiles binary, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))
