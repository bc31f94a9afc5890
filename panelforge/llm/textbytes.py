"""Vectorised text primitives over Arrow batches (NumPy only, no Spark).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, compared after
lower-casing A-Z.  Nothing here loops over bytes or words in Python: a slice of
documents is one byte buffer, and words, hashes and shingles are array
expressions over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240611))
#: One random 64-bit value per (lower-cased) byte, so that the polynomial has no structure to exploit.
_TABLE = (_rng.integers(0, 2**63, 256, dtype=np.uint64) << _U(1)) | _U(1)
_CASED = _TABLE.copy()
_TABLE[65:91] = _TABLE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
SHINGLE_A, SHINGLE_B, SHINGLE_C = (_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: Bytes of text that array expressions work on at a time.
SLICE = 400_000
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    while len(_pow) < n:
        k = len(_pow)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([_pow, _pow * _U(pow(_P, k, 2**64))])
            _inv = np.concatenate([_inv, _inv * _U(pow(_PINV, k, 2**64))])
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``most`` bytes; null texts are empty.

    A text longer than ``most`` is a slice of its own, so memory follows the
    longest text, never the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0:
        return
    offs = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield at, min(end, n), buf[offs[at] : offs[min(end, n)]], offs[at : min(end, n) + 1] - offs[at]
        at = min(end, n)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each document (one more entry than documents)."""
    if len(buf) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_SEP[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True  # a document's first byte, and one past the last
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, cased: bool = False) -> np.ndarray:
    """64-bit hashes of the bytes of each span, lower-cased unless ``cased``."""
    p, inv = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((_CASED if cased else _TABLE)[buf] * p[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words of every document, and where each document's begin.

    A document of fewer words has the whole sequence as its one shingle; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    with np.errstate(over="ignore"):
        k = np.repeat(n, count)
        out = h[at] * shingle_factor(0)
        for j in range(1, width):
            has = k > j
            out[has] += h[at[has] + j] * shingle_factor(j)
        out += np.minimum(k, width).astype(np.uint64) * _U(0x8EBC6AF09C88C6E3)
    return mix(out), begin


def shingle_factor(j: int) -> np.uint64:
    """The odd multiplier of a shingle's word ``j``."""
    return (SHINGLE_A, SHINGLE_B, SHINGLE_C)[j] if j < 3 else mix(np.array([j], dtype=np.uint64))[0] | _U(1)


def document_shingles(buf: np.ndarray, offs: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(buf, offs)
    return shingles(span_hashes(buf, starts, ends), first, width)


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 256)]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1 in lower case."""
    low = LOWER[buf]
    if len(buf) > 1:
        at = np.flatnonzero(buf[:-1] == 0xC3) + 1
        at = at[(low[at] >= 0x80) & (low[at] <= 0x9E) & (low[at] != 0x97)]
        low[at] += 0x20
    return low


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes within documents, and each document's first run."""
    if len(inside) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def alnum_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits; every character beyond ASCII counts as a letter."""
    return runs(_ALNUM[buf], offs)
