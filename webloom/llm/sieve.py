"""A Bloom filter of fixed size over a column of 64-bit numbers, built in slices by the executors.

It only spares a later shuffle the rows that surely have no partner; the exact
join behind it decides. Its size never depends on the data: a filter that is too
small for its input lets more rows through, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.textarrays import mix

SLICES = 64
PROBES = 3
LOG_BITS = 27


class Sieve:
    """``bits`` bytes of flags; ``passes`` tells which numbers may have been put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.per_slice = np.uint64(len(bits) * 8 // SLICES)

    @staticmethod
    def places(keys: np.ndarray, per_slice: np.uint64) -> list[np.ndarray]:
        """Where each number's flags are within its slice."""
        h = mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [(h + np.uint64(k) * step) & (per_slice - np.uint64(1)) for k in range(PROBES)]

    def passes(self, keys: np.ndarray) -> np.ndarray:
        base = (keys & np.uint64(SLICES - 1)) * self.per_slice
        out = np.ones(len(keys), dtype=bool)
        for at in self.places(keys, self.per_slice):
            at = at + base
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def sieve_of(keys: DataFrame, column: str, log_bits: int = LOG_BITS) -> Sieve:
    """The filter over a column; the driver gets 2^log_bits bits, whatever the number of rows."""
    per_slice = (1 << log_bits) // SLICES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
            of = (values & np.uint64(SLICES - 1)).astype(np.int64)
            for s in np.unique(of):
                flags = held.setdefault(int(s), np.zeros(per_slice, dtype=bool))
                for at in Sieve.places(values[of == s], np.uint64(per_slice)):
                    flags[at.astype(np.int64)] = True
        for s, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["slice", "flags"])

    dealt = keys.select(F.col(column)).where(F.col(column).isNotNull()).repartition(SLICES, F.col(column).bitwiseAND(F.lit(SLICES - 1)))
    bits = np.zeros((1 << log_bits) // 8, dtype=np.uint8)
    size = per_slice // 8
    for row in dealt.mapInArrow(each, "slice int, flags binary").collect():  # 2^log_bits bits at most for each task of a slice
        bits[row["slice"] * size : (row["slice"] + 1) * size] |= np.frombuffer(row["flags"], np.uint8)
    return Sieve(bits)
