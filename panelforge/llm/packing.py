"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences of ``seq_len`` and then into
the powers of two of the remainder's binary form, longest first.  Pieces of one
length form one bucket; every piece is a sequence of its own, so no sequence
crosses documents and, all lengths being powers of two, none is padded.

Tokens come from the tokenizers library.  The vocabulary's pre-tokens hold no
white space and are encoded independently, so each distinct pre-token of a
worker is encoded once and documents are assembled with array gathers.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import shared, spans, textbytes
from panelforge.llm.spans import SpanEncoder
from panelforge.llm.transcode import Vocabulary

SEQ_LEN = 2048
EOS_ID = 1
CACHE_SPANS = 1 << 19


class WordEncoder(SpanEncoder):
    """Ids of texts, each distinct pre-token encoded by the tokenizers library.

    Texts are normalised (NFC, lower case) before they are cut.  New pre-tokens are
    encoded many at a time in one string by the same model without its normaliser;
    the ids whose token carries the end-of-word mark tell them apart.
    """

    def __init__(self, tokenizer_json: str, classes: bytes | None = None, most: int = CACHE_SPANS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__(most)
        spec = json.loads(tokenizer_json)
        whole, bare = (Tokenizer.from_str(json.dumps(s)) for s in (spec, spec | {"added_tokens": [], "normalizer": None}))
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        bare.no_truncation()
        bare.no_padding()
        self.tokenizer, self.normal = bare, whole.normalizer or normalizers.Sequence([])
        model = spec["model"]
        self.closes = np.zeros(whole.get_vocab_size(), dtype=bool)
        if mark := model.get("end_of_word_suffix"):
            self.closes[[i for s, i in model["vocab"].items() if s.endswith(mark)]] = True
        self.classes, self.unknown = spans.Classes(classes or spans.library_classes()), spans.Classes(spans.unknown_characters())
        self.special_ids = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.special = sorted(self.special_ids, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, self.special)))

    def _plain(self, part: str, known: bool) -> str:
        """NFC and lower case of a part between special strings; the library's own where Python does not know a character."""
        if not known:
            return self.normal.normalize_str(part)
        return unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()  # one letter at a time: no final sigma

    def normalised(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The texts as they are cut, and where special strings stand in them."""
        buf, offs = spans.valid(buf, offs)
        raw = buf.tobytes()
        special = spans.find_special(raw, offs, self.pattern) if any(s in raw for s in self.special) else None
        if special is None and raw.isascii():
            return textbytes.LOWER[buf], offs, None
        parts, places, at, docs = [], [], 0, [0]
        known = not self.unknown.of(buf).any()
        marks = special.tolist() if special is not None else []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            while marks and marks[0][0] < b:
                i, j = marks.pop(0)
                for piece, is_special in ((raw[a:i], False), (raw[i:j], True)):
                    parts.append(piece if is_special else self._lower(piece, known))
                    if is_special:
                        places.append((at, at + len(piece)))
                    at += len(parts[-1])
                a = j
            parts.append(self._lower(raw[a:b], known))
            at += len(parts[-1])
            docs.append(at)
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(docs), np.array(places, dtype=np.int64) if places else None

    def _lower(self, raw: bytes, known: bool) -> bytes:
        return raw.lower() if raw.isascii() else self._plain(raw.decode(), known).encode()

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, where each document's begin)."""
        data, offs, special = self.normalised(buf, offs)
        starts, ends, first = spans.unspaced(data, offs, self.classes, special)
        ids, lens = self.span_ids(data, starts, ends)
        return ids, np.concatenate([[0], np.cumsum(lens)])[first]

    def new_spans(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        named = [k for k, r in enumerate(raw) if r in self.special_ids]
        if named:
            parts = [np.array([self.special_ids[r]], dtype=np.uint32) if r in self.special_ids else self.new_spans([r])[0] for r in raw]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        lines = [b" ".join(raw[k : k + 256]).decode() for k in range(0, len(raw), 256)]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(raw):
            raise ValueError("the vocabulary does not mark the ends of words")
        return ids, np.diff(ends, prepend=0)

    def long_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans beyond the table; each distinct one of a slice is encoded once."""
        raw = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        distinct = list(dict.fromkeys(raw))
        ids, lens = self.new_spans(distinct)
        at = {r: k for k, r in enumerate(distinct)}
        parts = np.split(ids, np.cumsum(lens)[:-1])
        picked = [parts[at[r]] for r in raw]
        return np.concatenate(picked), np.fromiter(map(len, picked), np.int64, len(picked))


def piece_lengths(n: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Full sequences, then the binary form of the rest, longest first."""
    out = [seq_len] * (n // seq_len)
    rest = n % seq_len
    while rest:
        top = 1 << (rest.bit_length() - 1)
        out.append(top)
        rest -= top
    return out


def _encoder(vocabulary: Vocabulary) -> WordEncoder:
    if (key := ("words", vocabulary.key)) not in shared.ENGINES:  # one vocabulary at a time stays in a worker
        shared.ENGINES.clear()
        shared.ENGINES[key] = WordEncoder(*vocabulary.value)
    return shared.ENGINES[key]


SCHEMA = "doc_id long, start long, length long, doc_tokens long, offset long, bucket int, ids binary"


def pack_documents(docs: DataFrame, tokenizer_json: str, *, seq_len: int = SEQ_LEN, eos_id: int = EOS_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, offset, bucket, ids, sequence_id``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers,
    ``bucket`` is log2 of its length, ``offset`` is 0 because each piece fills
    its sequence.  ``seq_len`` must be a power of two.

    Null or empty text: one piece, the closing id alone.  Null document id: kept
    as null.  Repeated rows: each row is packed by itself, its sequence ids are
    its own.  Empty table: no rows.  Other columns are not read.

    The plan is scan -> encode -> pack without a shuffle.  ``sequence_id`` is the
    partition number and the row's position, so it is unique and a task that is
    run again gives the same ids as long as the input is a table or another
    ordered source.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    spark = docs.sparkSession
    vocabulary = Vocabulary(spark, tokenizer_json)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for a, b, buf, offs in textbytes.slices(batch.column(1)):
                ids, begin = encoder.encode(buf, offs)
                doc_of, start, length, total, parts = [], [], [], [], []
                eos = np.array([eos_id], dtype=np.uint32)
                for k in range(b - a):
                    own = np.concatenate([ids[begin[k] : begin[k + 1]], eos]).astype("<u4")
                    data, at, n = own.tobytes(), 0, len(own)
                    for size in piece_lengths(n, seq_len):
                        doc_of.append(k)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        parts.append(data[4 * at : 4 * (at + size)])
                        at += size
                size = np.array(length, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(doc_of, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(size),
                        pa.array(total, pa.int64()),
                        pa.array(np.zeros(len(size), np.int64)),
                        pa.array(np.log2(size).round().astype(np.int32)),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "offset", "bucket", "ids"],
                )
        shared.tidy()

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(docs, text_col).alias("text"))
    return read.mapInArrow(pack, SCHEMA).withColumn("sequence_id", F.monotonically_increasing_id())


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 of their ids instead of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
