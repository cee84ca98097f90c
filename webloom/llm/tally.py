"""Counting 64-bit keys of a whole table with packed numbers instead of rows.

Tasks sort the keys that they hold and send, for each bucket of keys, one row of
packed differences; a bucket's group adds them up. A row of a shuffle then stands
for thousands of keys at three to six bytes each. Buckets grow in number with the
input (``bucket_count``), not in size, and take keys by their last bits, which are
those of a hash: no bucket holds more different keys than its share, and a
frequent key comes once from each flush of a task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_CHARS = 4 << 20
FLUSH = 1 << 21

ROW = [("bucket", pa.int32()), ("codes", pa.binary()), ("at", pa.binary()), ("more", pa.binary())]
SCHEMA = "bucket int, codes binary, at binary, more binary"


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, in as many bytes as the largest needs; the first byte tells how many."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    wide = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and how often each is there. Sorts ``keys`` in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def trim() -> None:
    """Give freed memory back to the machine: workers live on, and a task's arrays are of all sizes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bucket_count(docs: DataFrame, text_column: str, bucket_chars: int = BUCKET_CHARS) -> int:
    """A power of two in proportion to the characters of all texts."""
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_column}`"))).alias("x")).first()["x"] or 0
    return 1 << max(5, int(np.ceil(np.log2(max(chars, 1) / bucket_chars))))


class Sender:
    """Holds keys up to ``flush_at`` and gives them as packed rows (bucket, codes, at, more); counts other than 1 are listed by place."""

    def __init__(self, buckets: int, first_bucket: int = 0, flush_at: int = FLUSH):
        self.buckets, self.first, self.flush_at = buckets, first_bucket, flush_at
        self.shift = np.uint64(buckets.bit_length() - 1)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.held.append(keys)
            self.size += len(keys)
        if self.size > self.flush_at:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, shift = np.concatenate(self.held), self.shift
        self.held.clear()
        self.size = 0
        # the bucket's bits go to the front: one sort deals out and orders
        keys = (keys >> shift) | ((keys & np.uint64(self.buckets - 1)) << (np.uint64(64) - shift))
        key, count = runs(keys)
        del keys
        cuts = np.searchsorted(key, np.arange(self.buckets, dtype=np.uint64) << (np.uint64(64) - shift))
        code = key & np.uint64((1 << (64 - int(shift))) - 1)
        out = []
        for b, (x, y) in enumerate(zip(cuts, np.append(cuts[1:], len(key)), strict=True)):
            if y > x:
                often = np.flatnonzero(count[x:y] > 1)
                out.append((self.first + b, pack(code[x:y]), often.astype("<u4").tobytes(), count[x:y][often].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), ROW, strict=True)], names=[n for n, _ in ROW])


def merged(group: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of a bucket's rows, keys ascending by their code. A bucket's number counts modulo ``buckets``."""
    codes, counts = [], []
    for row in range(group.num_rows):
        code = unpack(group["codes"][row].as_py())
        count = np.ones(len(code), dtype=np.int64)
        count[np.frombuffer(group["at"][row].as_py(), "<u4")] = np.frombuffer(group["more"][row].as_py(), "<u4")
        codes.append(code)
        counts.append(count)
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first] * np.uint64(buckets) + np.uint64(group["bucket"][0].as_py() % buckets), np.add.reduceat(count[order], first)


def counted(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], buckets: int, least: int = 1) -> DataFrame:
    """(key, n) of the keys that ``keys_of`` finds in all rows at least ``least`` times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets)
        for keys in keys_of(batches):
            yield from sender.add(keys)
        yield from sender.flush()
        trim()

    def add(group: pa.Table) -> pa.Table:
        key, n = merged(group, buckets)
        key, n = key[n >= least], n[n >= least]
        trim()
        return pa.table({"key": key.view(np.int64), "n": n})

    return rows.mapInArrow(send, SCHEMA).groupBy("bucket").applyInArrow(add, "key long, n long")
