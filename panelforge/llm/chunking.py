"""Document fingerprints from content-defined chunks.

A gear hash over the last 16 bytes decides boundaries, so an edit moves only the
boundaries near it.  Chunking is normalised: a strict mask holds before the
normal length and a lenient one after it, within least and greatest lengths.
The fingerprint is the set of chunk digests, each with its length as weight; it
is written as sorted 12-digit hexadecimal numbers (10 of digest, 2 of length).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import ordered, shared, textbytes

LEAST, NORMAL, MOST = 8, 32, 160
#: Bytes of text that are worked on at a time (more only for a longer text).
SLICE = 400_000
_PAD = 16
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)
_GEAR[0] = 0  # the padding between texts
_STRICT, _LENIENT = np.uint32(0b111111 << 22), np.uint32(0b1111 << 22)


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct (digest << 8 | length) of each text's chunks."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):  # SLICE bytes at a time, or one text
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= SLICE):
            total += len(texts[hi]) + _PAD
            hi += 1
        out += _sets(texts[lo:hi])
        lo = hi
    return out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    pad = bytes(_PAD)
    buf = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = _PAD + np.cumsum(lens + _PAD) - (lens + _PAD)
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):  # the hash of 2k bytes from those of k
        wide = h.copy()
        wide[k:] += h[:-k] << np.uint32(k)
        h = wide
    easy = np.flatnonzero((h & _LENIENT) == 0)
    hard = ((h[easy] & _STRICT) == 0).tolist()
    cuts = np.searchsorted(easy, np.stack([begin, begin + lens], axis=1)).tolist()
    places = easy.tolist()
    starts: list[int] = []
    ends: list[int] = []
    first = [0]
    for (a, b), s, n in zip(cuts, begin.tolist(), lens.tolist()):
        stop = s + n
        for k in range(a, b):
            e = places[k] + 1
            while e - s > MOST:
                starts.append(s)
                s += MOST
                ends.append(s)
            if e - s >= NORMAL or (hard[k] and e - s >= LEAST):
                starts.append(s)
                ends.append(e)
                s = e
        while stop > s:
            e = min(stop, s + MOST)
            starts.append(s)
            ends.append(e)
            s = e
        first.append(len(starts))
    st, en = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
    digest = textbytes.span_hashes(buf, st, en, cased=True) if len(st) else np.empty(0, np.uint64)
    value = (digest >> np.uint64(24)) << np.uint64(8) | (en - st).astype(np.uint64)
    return [np.unique(value[i:j]) for i, j in zip(first, first[1:])]


def text_of(chunks: np.ndarray) -> str:
    return np.ascontiguousarray(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a``'s chunk length that ``b`` holds too; an empty set is contained in an empty one alone."""
    if not len(a):
        return float(not len(b))
    w = (a & np.uint64(255)).astype(np.int64)
    return float(w[np.isin(a, b, assume_unique=True)].sum() / w.sum())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the next text's first."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The next document is the next row of falling document id (ties by text, null
    ids last), after the last row the first.

    Null or empty text: no chunks, an empty fingerprint; its likeness is 1 to an
    empty one, else 0.  Repeated rows: each follows the other.  One row: it
    follows itself.  Empty table: no rows.  Other columns are not read.

    Plan: rows go to ranges of the id in one shuffle, with one copied row a range
    for its end; a task streams its range and holds two texts and one slice.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(docs, text_col).alias("text"))
    rows, rng, copied = ordered.with_successors(read, "doc_id", "text")

    def flush(held: list[tuple], out: dict[str, list]) -> None:
        """Results of all held rows but the last, which waits for its successor."""
        texts = [t for _, t in held]
        changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
        sets = chunk_sets([t.encode() for t in texts])
        for k, own in enumerate(chunk_sets(changed)):
            out["doc_id"].append(held[k][0])
            out["n_chars"].append(len(texts[k]))
            out["edited_sha256"].append(hashlib.sha256(changed[k]).hexdigest())
            out["fingerprint"].append(text_of(sets[k]))
            out["edited_fingerprint"].append(text_of(own))
            out["near_edited"].append(containment(sets[k], own))
            out["near_next"].append(containment(sets[k], sets[k + 1]))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def emit(keep: bool) -> pa.RecordBatch:
            nonlocal held, size
            out: dict[str, list] = {c: [] for c in names}
            flush(held, out)
            held, size = held[-1:] if keep else [], 0
            return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(names, types)], names=names)

        for batch in batches:
            ids, copies, column = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            for k in range(batch.num_rows):
                held.append((ids[k], column[k].as_py()))
                size += len(held[-1][1])
                if copies[k] or size > SLICE:
                    yield emit(not copies[k])  # a copy ends its range

    return rows.select("doc_id", "text", copied).mapInArrow(run, schema)
