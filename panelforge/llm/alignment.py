"""Alignment of two tokenizers' tokens, and how often their ids go together in the corpus.

Both tokenizers cut the same bytes.  Where tokens of both end at the same byte a group ends;
an A and a B token are linked when they share a group.  A pair of ids is one int64 key.

Counting.  Every partition keeps sorted (key, documents) arrays made by ``np.unique`` and gives
them on when they are large; the rows are sorted by key in ranges and runs are added up, which
leaves every range a sorted shard of keys and one of counts, files in the shared folder.
Looking up.  A second pass maps the shards into memory and finds a slice's keys by binary
search.  The highest count of every A id is an array as long as the vocabulary.

The texts are encoded twice; moving every document's pairs would cost more than that.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import shared, spans, textbytes
from panelforge.llm.bpe import Merges, TextEncoder
from panelforge.llm.shards import get, put

#: Links that are listed at a time; ids of groups with more links than WIDE are counted before they are paired.
LINKS, WIDE = 1 << 20, 1 << 12
#: Distinct pairs that a partition holds before it gives them on, and shards at most (pairs are bounded by both vocabularies).
HELD, SHARDS = 1 << 21, 256
_SPACE, _MARK = 0x20, "▁"


class PlainEncoder(TextEncoder):
    """Byte-level ids of a text in which special strings are ordinary."""

    def __init__(self, merges: Merges, classes: bytes):
        super().__init__(merges, classes)
        self.special, self.special_ids = [], {}


class PieceEncoder(spans.SpanEncoder):
    """Piece ids of whole texts, by units that no piece crosses.

    No piece has the space mark behind another character, so a unit begins at a space that follows another byte; bytes that
    are in no piece stand alone, so one begins at each of these too.  The library encodes every distinct short
    unit once.  A unit whose pieces do not give its bytes back gets the id ``bad``.
    """

    def __init__(self, model: bytes, most: int = 1 << 19):
        import sentencepiece

        super().__init__(most)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bad = n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(k) for k in range(n)]
        plain = [not (self.sp.is_byte(k) or self.sp.is_control(k) or self.sp.is_unknown(k)) for k in range(n)]
        if any(p and _MARK in s.lstrip(_MARK) for s, p in zip(names, plain)):
            raise ValueError("pieces of this model go across spaces")
        self.token_bytes = [bytes([int(s[3:5], 16)]) if self.sp.is_byte(k) else s.replace(_MARK, " ").encode() if plain[k] else b"" for k, s in enumerate(names)] + [b""]
        self.token_size = np.fromiter(map(len, self.token_bytes), np.int64, n + 1)
        used = {b for s, p in zip(names, plain) if p for b in s.encode()}
        self.alone = np.array([b < 128 and b not in used and b != _SPACE for b in range(256)])
        self.mark = names.index(_MARK) if _MARK in names else -1

    def _encoded(self, raw: list[bytes]) -> list[list[int]]:
        """The library puts a mark before each text: it stands for a unit's first space, or goes where a unit begins alone."""
        spaced = [r[:1] == b" " for r in raw]
        texts = [(r[1:] if s else r).decode() for r, s in zip(raw, spaced)]
        out = self.sp.encode(texts, num_threads=1)
        for k, (r, s) in enumerate(zip(raw, spaced)):
            if r == b" ":
                out[k] = [self.mark] if self.mark >= 0 else [self.bad]
            elif not s:
                out[k] = out[k][1:]
            if b"".join(map(self.token_bytes.__getitem__, out[k])) != r:
                out[k] = [self.bad]
        return out

    def new_spans(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encoded(raw)
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def long_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.new_spans([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())])

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents that begin with a space (the mark that the library adds), and where each document's begin."""
        begin = buf == _SPACE
        begin[1:] &= buf[:-1] != _SPACE
        begin |= self.alone[buf]
        begin[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(begin)
        ids, lens = self.span_ids(buf, starts, np.append(starts[1:], len(buf)))
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, offs)]


class Aligned:
    """The aligned tokens of a slice of documents, one after another."""

    def __init__(self, a: PlainEncoder, b: PieceEncoder, buf: np.ndarray, offs: np.ndarray):
        buf, offs = spans.valid(buf, offs)
        n = len(offs) - 1
        some = np.diff(offs) > 0
        shift = np.concatenate([[0], np.cumsum(some)])
        buf = np.insert(buf, offs[:-1][some], np.uint8(_SPACE))
        offs = offs + shift
        ids_a, at_a = a.encode(buf, offs)
        ids_b, at_b = b.encode(buf, offs)
        size_a, size_b = a.merges.token_size[ids_a], b.token_size[ids_b]
        doc_a, doc_b = np.repeat(np.arange(n), np.diff(at_a)), np.repeat(np.arange(n), np.diff(at_b))
        same = (np.bincount(doc_a, size_a, n) == np.diff(offs)) & (np.bincount(doc_b, size_b, n) == np.diff(offs)) & (np.bincount(doc_b[ids_b == b.bad], minlength=n) == 0)
        if not same.all():
            keep_a, keep_b = same[doc_a], same[doc_b]
            ids_a, size_a, doc_a, ids_b, size_b, doc_b = ids_a[keep_a], size_a[keep_a], doc_a[keep_a], ids_b[keep_b], size_b[keep_b], doc_b[keep_b]
        self.n, self.width = n, len(b.token_bytes)
        self.a, self.b, self.doc_a, self.doc_b = ids_a.astype(np.int64), ids_b.astype(np.int64), doc_a, doc_b
        # both lists now cover the same bytes; ends are counted from the first of them on
        ends = [np.zeros(int(size_a.sum()) + 1, dtype=bool) for _ in range(2)]
        for e, size in zip(ends, (size_a, size_b)):
            e[np.cumsum(size)] = True
        common = np.flatnonzero(ends[0] & ends[1])
        self.groups = len(common)
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(e, dtype=np.int64)[common]]) for e in ends)
        self.n_a, self.n_b = np.diff(self.first_a), np.diff(self.first_b)
        self.doc = doc_a[self.first_a[1:] - 1] if self.groups else np.empty(0, np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (document, A id, B id as one int64) and how often each is linked."""
        product = self.n_a * self.n_b
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        narrow = np.flatnonzero(product <= WIDE)
        cuts = np.searchsorted(np.cumsum(product[narrow]), np.arange(LINKS, int(product[narrow].sum()) + LINKS, LINKS))
        lo = 0
        for hi in cuts.tolist():
            g = narrow[lo : hi + 1]
            lo = hi + 1
            if len(g):
                ka, kb = self.n_a[g], self.n_b[g]
                ia = np.repeat(self.first_a[g] - (np.cumsum(ka) - ka), ka) + np.arange(int(ka.sum()))
                times = np.repeat(kb, ka)  # each A token meets all B tokens of its group
                to = np.cumsum(times)
                ib = np.repeat(np.repeat(self.first_b[g], ka) - (to - times), times) + np.arange(int(to[-1]))
                head = (self.doc_a[ia] * self._top + self.a[ia]) * self.width
                kept.append(np.unique(np.repeat(head, times) + self.b[ib], return_counts=True))
        for g in np.flatnonzero(product > WIDE).tolist():
            (ua, ca), (ub, cb) = (np.unique(x[f[g] : f[g + 1]], return_counts=True) for x, f in ((self.a, self.first_a), (self.b, self.first_b)))
            step = max(1, LINKS // len(ub))
            for k in range(0, len(ua), step):
                keys = ((self.doc[g] * self._top + ua[k : k + step]) * self.width)[:, None] + ub[None, :]
                kept.append((keys.ravel(), np.outer(ca[k : k + step], cb).ravel()))
        return added(kept)

    #: More than any A id: documents of a slice times ids of both stay below 2^63.
    _top = 1 << 20

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all documents as bytes, and where each document's begin."""
        total = len(self.a) + len(self.b)
        base = self.first_a[:-1] + self.first_b[:-1]
        ids = np.empty(total, dtype=np.int64)
        ids[np.arange(len(self.a)) + np.repeat(self.first_b[:-1], self.n_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(self.first_a[1:], self.n_b)] = self.b
        digits, used = decimals(int(ids.max(initial=0)) + 1)
        cells = digits[ids]
        cells[base + self.n_a - 1, -1] = ord("|")
        cells[base + self.n_a + self.n_b - 1, -1] = ord(";")
        to = np.concatenate([[0], np.cumsum(used.sum(axis=1)[ids])])
        tokens = np.bincount(self.doc_a, minlength=self.n) + np.bincount(self.doc_b, minlength=self.n)
        return cells[used[ids]], to[np.concatenate([[0], np.cumsum(tokens)])]


@lru_cache(maxsize=1)
def _decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(10**width)
    powers = 10 ** np.arange(width - 1, -1, -1)
    cells = np.concatenate([48 + n[:, None] // powers % 10, np.full((len(n), 1), ord(","))], axis=1).astype(np.uint8)
    used = np.concatenate([(n[:, None] >= powers) | (powers == 1), np.ones((len(n), 1), bool)], axis=1)
    return cells, used


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Right-aligned digits and a comma of the numbers below ``n`` (at least), and which of the cells are used."""
    return _decimals(len(str(max(n - 1, 1))))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts added up."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _slices(batches: Iterator[pa.RecordBatch], column: int, sent) -> Iterator[tuple[pa.RecordBatch, int, int, Aligned]]:
    if (key := ("aligned", sent.key)) not in shared.ENGINES:  # one pair of tokenizers at a time stays in a worker
        shared.ENGINES.clear()
        (tokenizer_json, classes), model = sent.value
        shared.ENGINES[key] = PlainEncoder(Merges(tokenizer_json), classes), PieceEncoder(model)
    a, b = shared.ENGINES[key]
    for batch in batches:
        for lo, hi, buf, offs in textbytes.slices(batch.column(column)):
            yield batch, lo, hi, Aligned(a, b, buf, offs)


def pair_counts(docs: DataFrame, sent) -> tuple[str, list[tuple[int, int]], np.ndarray]:
    """(folder, shards as (first key, last key), highest count of each A id).

    ``docs``: one column, the text.
    """
    spark = docs.sparkSession
    width = sent.width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for *_, aligned in _slices(batches, 0, sent):
            keys, _ = aligned.links()
            held.append(np.unique(keys % (Aligned._top * width), return_counts=True))  # a document counts once
            size += len(held[-1][0])
            if size > HELD:
                held = [added(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from _pairs(held.pop())
                    size = 0
        yield from _pairs(added(held))
        shared.tidy()

    parts = min(shared.partitions(spark), SHARDS)
    counted = shared.cut(docs.mapInArrow(partial, "key long, n long"))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pairs-{uuid.uuid4().hex}"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        last: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                own = tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns)
                key, n = added([last, own]) if last is not None else _runs(*own)
                runs.append((key[:-1], n[:-1]))
                last = (key[-1:], n[-1:])
        if last is None:
            return
        key, n = (np.concatenate(x) for x in zip(*runs, last))
        name = f"{int(key[0])}-{int(key[-1])}"
        put(f"{folder}/{name}-keys.npy", key)
        put(f"{folder}/{name}-counts.npy", n)
        first = np.flatnonzero(np.append(True, np.diff(key // width) > 0))
        yield pa.RecordBatch.from_arrays([pa.array((key // width)[first]), pa.array(np.maximum.reduceat(n, first)), *(pa.array(np.full(len(first), x)) for x in (key[0], key[-1]))], names=["a", "most", "first", "last"])

    # what comes back: at most one row an A id and shard
    done = counted.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(summed, "a long, most long, first long, last long").toArrow()
    a, most, first, last = (done.column(c).to_numpy() for c in ("a", "most", "first", "last"))
    best = np.zeros(sent.size, dtype=np.int64)
    np.maximum.at(best, a, most)
    return folder, sorted({(int(x), int(y)) for x, y in zip(first, last)}), best


def _runs(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def _pairs(counts: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    key, n = counts
    for k in range(0, len(key), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], names=["key", "n"])


class Lookup:
    """Counts of sorted keys from mapped shards."""

    def __init__(self, folder: str, shards: list[tuple[int, int]]):
        self.folder, self.shards, self.open = folder, shards, {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), dtype=np.int64)
        for first, last in self.shards:
            lo, hi = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            if hi > lo:
                if (held := self.open.get(first)) is None:
                    held = self.open[first] = tuple(get(f"{self.folder}/{first}-{last}-{kind}.npy") for kind in ("keys", "counts"))
                out[lo:hi] = held[1][np.searchsorted(held[0], keys[lo:hi])]
        return out


class _Sent:
    """Both tokenizers, broadcast (their files are a few MB), with what the driver needs to know of them."""

    def __init__(self, spark, tokenizer_json: str, model: bytes):
        self.width, self.size = len(PieceEncoder(model).token_bytes), Merges(tokenizer_json).size
        if self.size > Aligned._top or self.size * self.width >= 1 << 40:
            raise ValueError("vocabularies too large for packed keys")
        self.key = hash((tokenizer_json, model))
        self._held = spark.sparkContext.broadcast(((tokenizer_json, spans.library_classes()), model))

    @property
    def value(self):
        return self._held.value


RESULT = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}


def align_documents(docs: DataFrame, tokenizer_json: str, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", written: bool = False) -> DataFrame:
    """``doc_id`` and per text the tokens of both tokenizers, groups, links, links of an A id's highest count, and counts over links.

    ``written`` adds ``groups``, the groups themselves as a string.  Texts null, empty, or not given back by either tokenizer's
    tokens have zeros and an empty digest.  Invalid UTF-8 is read as replacement characters.  Null and repeated
    ids: a row each, and each row counts as a document.  A text of any length is a slice of its own; a group of any size is paired
    by distinct ids in blocks.  Empty table: no rows.  Other columns are not read.

    Partial counts are stored in the checkpoint folder, shards next to them (they stay until the folder is cleared).
    Hot pairs come once a partition; keys are dealt by ranges.
    """
    spark = docs.sparkSession
    shared.ensure_checkpoint_dir(spark)
    sent = _Sent(spark, tokenizer_json, model)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(docs, text_col).alias("text"))
    folder, shards, best = pair_counts(read.select("text"), sent)
    highest = spark.sparkContext.broadcast(best)  # one number an A id
    width = sent.width
    names = list(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, top = Lookup(folder, shards), highest.value
        for batch, lo, hi, x in _slices(batches, 1, sent):
            keys, times = x.links()
            pair = keys % (Aligned._top * width)
            distinct, back = np.unique(pair, return_inverse=True)
            count = lookup.of(distinct)[back]
            doc = keys // (Aligned._top * width)
            begin = np.searchsorted(doc, np.arange(x.n + 1))

            def total(v: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(v)])[begin])

            text, at = x.written()
            raw = [text[i : max(i, j - 1)].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            sums = [np.bincount(x.doc_a, minlength=x.n), np.bincount(x.doc_b, minlength=x.n), np.bincount(x.doc, minlength=x.n), total(times), total(times * (count == top[pair // width])), total(times * count)]
            out = [batch.column(0).slice(lo, hi - lo), *(pa.array(s.astype(np.int64)) for s in sums), pa.array([hashlib.sha256(r).hexdigest() if r else "" for r in raw])]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array([r.decode() for r in raw])] if written else [])], names=["doc_id", *names, *(["groups"] if written else [])])
        shared.tidy()

    return read.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in RESULT.items()) + (", groups string" if written else ""))
