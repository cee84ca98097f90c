"""Words of whole Arrow string columns as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, so a batch of
texts is tokenised by a few vector operations on its UTF-8 buffer; nothing is
done per word in Python.  Words are known by 64-bit hashes that depend on
nothing but their bytes, so they agree between batches, partitions and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)

#: Runs of ASCII letters and of anything beyond ASCII, for terms without punctuation.
LETTERS = np.arange(256) >= 0x80
LETTERS[65:91] = LETTERS[97:123] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _GOLD)
_MASKS = U64(0xFFFFFFFFFFFFFFFF) >> ((U64(8) - np.arange(9, dtype=U64)) % U64(8) << U64(3))  # of 1 to 8 bytes
_FEW_STEPS = 32


@dataclass
class Words:
    """Words of a batch. ``doc_start[d]:doc_start[d+1]`` are those of row d; begin and end are bytes of ``data``."""

    hashes: np.ndarray
    doc_start: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.doc_start) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_start)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False, of: np.ndarray | None = None) -> Words:
    """Split each text of a column into words and hash them; ``lower`` lower-cases A-Z first, ``of`` tells which bytes make words."""
    data, offsets = utf8_buffers(column)
    n = len(data)
    inside = ~((data == 0x20) | ((data - np.uint8(9)) < 5)) if of is None else of[data]
    first = np.zeros(n + 1, dtype=bool)
    if n:
        first[0] = inside[0]
        first[1:n] = inside[1:] > inside[:-1]
    # a text's first byte starts a word even if the text before it ends in one
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] |= inside[cut] if n else False
    begin = np.flatnonzero(first[:n])
    last = np.zeros(n, dtype=bool)
    if n:
        last[:-1] = inside[:-1] > inside[1:]
        last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
        last[-1] = inside[-1]
    end = np.flatnonzero(last) + 1
    hashes = hash_spans(data, begin, end, lower)
    return Words(hashes, np.searchsorted(begin, offsets), begin, end, data)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length. Spans are read eight bytes at a time, all spans at once; few are long."""
    size = end - begin
    out = size.astype(U64) * _GOLD
    if not len(begin):
        return out
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    if lower:
        padded += ((padded - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    at, left, of, step = begin, size, None, 0
    while len(at) and step < _FEW_STEPS:
        chunk = eight[at] & _MASKS[np.minimum(left, 8)]
        if of is None:
            out = mix(out ^ chunk)
        else:
            out[of] = mix((out[of] + _GOLD) ^ chunk)
        more = np.flatnonzero(left > 8)
        of = more if of is None else of[more]
        at, left = at[more] + 8, left[more] - 8
        step += 1
    of = np.zeros(0, np.int64) if of is None else of
    # of what is longer still, all bytes in one go, weighed by their places
    for i, a, n in zip(of.tolist(), at.tolist(), left.tolist(), strict=True):
        code = mix(_BYTE_CODE[padded[a : a + n]] + np.arange(n, dtype=U64) * _GOLD)
        out[i] = mix((out[i : i + 1] + _GOLD) ^ code.sum(dtype=U64))[0]
    return out


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``width`` hashes from each position in ``at``; positions must leave room."""
    acc = np.full(len(at), U64((seed * int(_GOLD) + width) & 0xFFFFFFFFFFFFFFFF), dtype=U64)
    for k in range(width):
        acc ^= hashes[at + k]
        acc *= U64(0xD6E8FEB86659FD93)
        acc ^= acc >> U64(29)
    return mix(acc)


def window_starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All word positions where a window of ``width`` words of one text starts, and the text of each."""
    room = np.maximum(words.counts - width + 1, 0)
    doc = np.repeat(np.arange(words.n_docs), room)
    before = np.cumsum(room) - room
    return words.doc_start[:-1][doc] + np.arange(int(room.sum())) - before[doc], doc


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed numbers, for Spark's LongType."""
    return x.view(np.int64)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Parts of a batch whose texts hold about ``most_bytes`` (at least one row each), so that memory is bounded."""
    sizes = np.diff(utf8_buffers(batch.column(batch.schema.get_field_index(column)))[1])
    start = 0
    total = np.cumsum(sizes)
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
