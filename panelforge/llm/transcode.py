"""Byte-pair encoding and decoding of document columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import shared, spans, textbytes
from panelforge.llm.bpe import Merges, StreamingDecoder, TextEncoder

#: Ids that the decoder takes at a time.
DECODE_BLOCK = 8192


class Vocabulary:
    """A broadcast tokenizer file and the library's character classes, with a key that workers remember them by."""

    def __init__(self, spark, tokenizer_json: str):
        self.key, self._held = hash(tokenizer_json), spark.sparkContext.broadcast((tokenizer_json, spans.library_classes()))

    @property
    def value(self) -> tuple[str, bytes]:
        return self._held.value


def engine(vocabulary: Vocabulary) -> TextEncoder:
    if (key := ("bytes", vocabulary.key)) not in shared.ENGINES:  # one vocabulary at a time stays in a worker
        shared.ENGINES.clear()
        tokenizer_json, classes = vocabulary.value
        shared.ENGINES[key] = TextEncoder(Merges(tokenizer_json), classes)
    return shared.ENGINES[key]


def decode(decoder: StreamingDecoder, ids) -> Iterator[str]:
    for k in range(0, len(ids), DECODE_BLOCK):
        yield decoder.feed(ids[k : k + DECODE_BLOCK])


def transcode_documents(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row: its text encoded, and the ids decoded again.

    ``ids`` holds little-endian unsigned 32-bit integers.  Every id comes from the
    bounded-lookahead transducer of :mod:`panelforge.llm.bpe`: many short texts are
    driven side by side, a text longer than a slice goes through in blocks whose
    stable ids are taken as they come.  The decoder is fed blocks of ids and keeps
    at most three bytes between them.  ``decoded=False`` leaves that column null.

    Null or empty text: no ids, an empty text.  Null document id: kept.
    Repeated rows: one result each.  Very long text: besides the row itself only its
    own ids and decoded text grow with it.  Empty table: no rows.  Other columns are
    not read.  The plan has no shuffle.
    """
    vocabulary = Vocabulary(docs.sparkSession, tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = engine(vocabulary)
        decoder = StreamingDecoder(encoder.merges)

        def text_of(blocks) -> str | None:
            return "".join([*(t for ids in blocks for t in decode(decoder, ids)), decoder.finish()]) if decoded else None

        for batch in batches:
            for a, b, buf, offs in textbytes.slices(batch.column(1), encoder.SLICE):
                if len(buf) > encoder.SLICE:  # one long text
                    blocks = list(encoder.stream(spans.valid(buf, offs)[0]))
                    coded = [(sum(map(len, blocks)), b"".join(x.astype("<u4").tobytes() for x in blocks), text_of(blocks))]
                else:
                    ids, begin = encoder.encode(buf, offs)
                    cuts = begin.tolist()
                    coded = [(j - i, ids[i:j].astype("<u4").tobytes(), text_of([ids[i:j]])) for i, j in zip(cuts, cuts[1:])]
                n, packed, text = zip(*coded)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.array(n, dtype=np.int64)), pa.array(packed, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(docs, text_col).alias("text"))
    return read.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """SHA-256 of the ids and of the decoded text in UTF-8."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
