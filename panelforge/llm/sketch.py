"""Arrays of fixed size that partitions fill and one job merges.

A partition sends its array in compressed blocks (blocks of zeros are left out);
blocks of one number meet in one task and are merged there one at a time, and
the driver receives every block once.  Sizes are parameters, so neither the
driver nor a broadcast grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 16
SCHEMA = "block int, held binary"


def squeeze(x: np.ndarray) -> bytes:
    """Each byte plane by itself, compressed."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes(), 1)


def spread(x: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), dtype=np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _row(block: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([squeeze(x)], pa.binary())], names=["block", "held"])


def blocks(x: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The blocks of ``x`` that are not all zero, numbered from ``first``."""
    for k in range(0, len(x), BLOCK):
        part = x[k : k + BLOCK]
        if part.any():
            yield _row(first + k // BLOCK, part)


def _saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    out[out < a] = np.iinfo(a.dtype).max
    return out


def summed(partial: DataFrame, size: int, dtype=np.uint32, merge=_saturating) -> np.ndarray:
    """The merged array of ``size`` entries from rows of :func:`blocks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None  # rows arrive sorted by block
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = spread(x.as_py(), dtype)
                if k == at:
                    total = merge(total, own)
                else:
                    if at is not None:
                        yield _row(at, total)
                    at, total = k, own
        if at is not None:
            yield _row(at, total)

    count = -(-size // BLOCK)
    out = np.zeros(size, dtype=dtype)
    for r in partial.repartitionById(count, "block").sortWithinPartitions("block").mapInArrow(run, SCHEMA).collect():
        at = r["block"] * BLOCK
        part = spread(r["held"], dtype)
        out[at : at + len(part)] = part
    return out
