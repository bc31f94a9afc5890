"""Edit-aware token counts: a segment tree of pre-tokens for each document.

Pre-tokens are encoded independently, so a text's token count is the sum over its
pre-tokens.  A tree's leaves are runs of at most BLOCK pre-tokens with their
characters, pre-tokens and tokens; inner nodes hold sums of characters (to find a
position) and of tokens.  Trees are columns of a table (:func:`grow_trees`), so
they can be written and edited later (:func:`edit_trees`).

An edit looks its leaf up, pre-tokenizes again from a few pre-tokens before it (no
rule looks further ahead than that) until a leaf boundary of the old text is met
again after it; only the leaves in between are encoded, and the differences are
added along their paths to the root.  Text is held leaf by leaf, so the cost of an
edit follows the edit and the tree's height, not the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import shared, spans, textbytes
from panelforge.llm.bpe import TextEncoder
from panelforge.llm.transcode import Vocabulary, engine

BLOCK = 16
#: Pre-tokens before an edit that are cut again, and characters after a boundary that decide it.
CONTEXT, AHEAD = 3, 4


class SumTree:
    """Sums over leaves in an implicit binary tree."""

    def __init__(self, leaves: list[int]):
        n = max(1, len(leaves))
        self.size = 1 << (n - 1).bit_length()
        level = [*leaves, *[0] * (self.size - len(leaves))]
        levels = [level]
        while len(level) > 1:
            level = [x + y for x, y in zip(level[::2], level[1::2])]
            levels.append(level)
        self.nodes = [0, *(v for level in reversed(levels) for v in level)]  # the root is node 1

    @property
    def total(self) -> int:
        return self.nodes[1]

    def leaf(self, k: int) -> int:
        return self.nodes[self.size + k]

    def add(self, leaf: int, change: int) -> int:
        """Adds to a leaf and every node above it; the number of nodes touched."""
        at, touched = self.size + leaf, 0
        while at:
            self.nodes[at] += change
            at >>= 1
            touched += 1
        return touched

    def prefix(self, leaf: int) -> int:
        """The sum of the leaves before ``leaf``."""
        at, out = self.size + leaf, 0
        while at > 1:
            if at & 1:
                out += self.nodes[at - 1]
            at >>= 1
        return out

    def find(self, value: int) -> tuple[int, int]:
        """The leaf whose own part of the running sum holds ``value`` (0 to total - 1), and the sum before it."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if value - before >= self.nodes[at]:
                before += self.nodes[at]
                at += 1
        return at - self.size, before


class DocumentTree:
    """The leaves of one document, and the trees over their characters and tokens."""

    def __init__(self, texts: list[str], sizes: list[int], tokens: list[int]):
        self.texts, self.sizes = texts or [""], sizes or [0]
        self.chars, self.tokens = SumTree([len(t) for t in self.texts]), SumTree(tokens or [0])
        self.encoded = self.touched = 0
        self.pending: list[tuple[int, list[int]]] = []  # first leaf, new pre-tokens of each leaf from it on

    @property
    def text(self) -> str:
        return "".join(self.texts)

    @property
    def total(self) -> int:
        return self.tokens.total

    def edit(self, start: int, end: int, new: str, pattern) -> list[str]:
        """Replace code points ``start`` to ``end``; the pre-tokens that must be encoded, whose counts ``settle`` takes."""
        n, leaves = self.chars.total, len(self.texts)
        start, end = min(max(start, 0), n), min(max(end, start, 0), n)
        a, before = self.chars.find(min(start, n - 1)) if n else (0, 0)
        context = 0
        while a and context < CONTEXT:  # leaves that hold enough pre-tokens before the edit
            a -= 1
            before -= len(self.texts[a])
            context += self.sizes[a]
        b, upto = a, before  # leaves a .. b - 1 hold the edit
        while b < leaves and (upto < end or upto == before):
            upto += len(self.texts[b])
            b += 1
        old = "".join(self.texts[a:b])
        head = old[: start - before] + new + old[end - before :]
        while True:
            tail, more = "", b  # what follows decides where the last pre-token ends
            while more < leaves and len(tail) < AHEAD:
                tail += self.texts[more]
                more += 1
            words, seam = [], 0
            for m in pattern.finditer(head + tail):
                if m.start() >= len(head):
                    break
                words.append(m[0])
                seam = m.end()
            if b == leaves or seam == len(head):
                break
            head += self.texts[b]  # no boundary here any more: one leaf further
            b += 1
        return self._replace(a, b, words)

    def _replace(self, a: int, b: int, words: list[str]) -> list[str]:
        """New pre-tokens in leaves a .. b - 1; a tree that they would crowd is laid out anew."""
        self.encoded += len(words)
        slots = max(b - a, 1)
        each = -(-len(words) // slots)
        if each > 4 * BLOCK:
            fresh = [words[k : k + BLOCK] for k in range(0, len(words), BLOCK)]
            tokens = [*(self.tokens.leaf(k) for k in range(a)), *[0] * len(fresh), *(self.tokens.leaf(k) for k in range(b, len(self.texts)))]
            self.texts[a:b], self.sizes[a:b] = ["".join(w) for w in fresh], [len(w) for w in fresh]
            self.chars, self.tokens = SumTree([len(t) for t in self.texts]), SumTree(tokens)
            self.touched += 2 * self.tokens.size
        else:
            fresh = [words[k * each : (k + 1) * each] for k in range(slots)]
            for k, own in enumerate(fresh, a):
                text = "".join(own)
                if change := len(text) - len(self.texts[k]):
                    self.chars.add(k, change)
                self.texts[k], self.sizes[k] = text, len(own)
        self.pending.append((a, [len(w) for w in fresh]))
        return words

    def settle(self, counts: list[int]) -> None:
        """The counts of the pre-tokens of the latest edit."""
        first, sizes = self.pending.pop()
        at = 0
        for k, n in enumerate(sizes, first):
            if change := sum(counts[at : at + n]) - self.tokens.leaf(k):
                self.touched += self.tokens.add(k, change)
            at += n

    def tokens_before(self, position: int) -> int:
        """Tokens of the leaves that lie before a code point."""
        return self.tokens.prefix(self.chars.find(position)[0]) if position < self.chars.total else self.total


LEAVES = {"leaf_chars": "array<int>", "leaf_pretokens": "array<int>", "leaf_tokens": "array<int>"}
_LIST = pa.list_(pa.int32())


def leaves_of(encoder: TextEncoder, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First leaf of each document, and the characters, pre-tokens and tokens of every leaf."""
    starts, ends, first = spans.spaced(buf, offs, encoder.classes)
    counts = encoder.span_counts(buf, starts, ends)
    n = np.diff(first)
    leaves = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
    begin = np.repeat(first[:-1] - leaves[:-1] * BLOCK, np.diff(leaves)) + np.arange(leaves[-1]) * BLOCK  # first pre-token of each leaf
    stop = np.minimum(begin + BLOCK, np.repeat(first[1:], np.diff(leaves)))
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    total = np.concatenate([[0], np.cumsum(counts)])
    edge = np.append(starts, len(buf))
    return leaves, chars[ends[stop - 1]] - chars[edge[begin]], stop - begin, total[stop] - total[begin]


def grow_trees(docs: DataFrame, tokenizer_json: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the tree of every text in new columns ``leaf_chars, leaf_pretokens, leaf_tokens``.

    Counts are those of ordinary text: special strings are not looked for.  Null or
    empty text: no leaves.  Other columns pass through, columns with these names are
    replaced.  Empty table: no rows.  A map; a text longer than a slice is one by itself.
    """
    vocabulary = Vocabulary(docs.sparkSession, tokenizer_json)

    def values(text: pa.Array) -> dict:
        encoder, parts, at = engine(vocabulary), [[], [], []], [np.zeros(1, np.int32)]
        for _, _, buf, offs in textbytes.slices(text):
            leaves, *own = leaves_of(encoder, *spans.valid(buf, offs))
            at.append((leaves[1:] + at[-1][-1]).astype(np.int32))
            for p, x in zip(parts, own):
                p.append(x.astype(np.int32))
        offsets = pa.array(np.concatenate(at))
        return {c: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *p]))) for c, p in zip(LEAVES, parts)}

    return shared.append_columns(docs, shared.text_column(docs, text_col), values, {c: T.ArrayType(T.IntegerType()) for c in LEAVES}, keep_engines=True)


def edit_trees(trees: DataFrame, edits, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edited documents with their updated trees and what the edits cost.

    ``trees`` as :func:`grow_trees` or this function made them; ``edits``: a column of
    ``array<struct<start:int,length:int,text:string>>`` in code points.  Edits are
    applied one after another from the greatest start to the least (of equal starts
    the first given first), each to the text as the one before left it.

    Returns ``doc_id, text, leaf_chars, leaf_pretokens, leaf_tokens, n_tokens_before,
    encoded_pretokens, touched_nodes``.  Null edits: none.  Positions beyond the text
    are moved to its end.  Repeated rows: one result each.  Empty table: no rows.
    """
    vocabulary = Vocabulary(trees.sparkSession, tokenizer_json)
    schema = "doc_id long, text string, leaf_chars array<int>, leaf_pretokens array<int>, leaf_tokens array<int>, n_tokens_before long, encoded_pretokens long, touched_nodes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = engine(vocabulary)
        pattern = encoder.pretoken_pattern
        for batch in batches:
            for a, b, _, _ in textbytes.slices(batch.column(1), 2 * textbytes.SLICE):
                ids, texts, asked, *leaves = (c.slice(a, b - a) for c in batch.columns)
                out = []
                for text, chars, sizes, tokens in zip(texts.to_pylist(), *(x.to_pylist() for x in leaves)):
                    cuts = [0]
                    for n in chars:
                        cuts.append(cuts[-1] + n)
                    out.append(DocumentTree([text[i:j] for i, j in zip(cuts, cuts[1:])], sizes, tokens))
                before = [t.total for t in out]
                todo = [sorted(e or [], key=lambda x: x["start"], reverse=True) for e in asked.to_pylist()]
                for r in range(max(map(len, todo), default=0)):  # one edit of every document at a time
                    now = [(t, t.edit(e[r]["start"], e[r]["start"] + e[r]["length"], e[r]["text"] or "", pattern)) for t, e in zip(out, todo) if r < len(e)]
                    counts = encoder.counts_of([w.encode() for _, words in now for w in words]).tolist()
                    at = 0
                    for t, words in now:
                        t.settle(counts[at : at + len(words)])
                        at += len(words)
                n = [len(t.texts) for t in out]
                columns = [[[len(x) for x in t.texts] for t in out], [t.sizes for t in out], [[t.tokens.leaf(k) for k in range(m)] for t, m in zip(out, n)]]
                numbers = [before, [t.encoded for t in out], [t.touched for t in out]]
                yield pa.RecordBatch.from_arrays([ids, pa.array([t.text for t in out], pa.string()), *(pa.array(c, _LIST) for c in columns), *(pa.array(x, pa.int64()) for x in numbers)], names=[c.split()[0] for c in schema.split(", ")])

    read = trees.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(trees, text_col).alias("text"), edits.alias("edits"), *LEAVES)
    return read.mapInArrow(run, schema)


def count_edits(docs: DataFrame, edits, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts before and after edits of every row, from trees grown and then edited.

    Returns ``doc_id, n_tokens, n_tokens_after, n_pretokens, encoded_pretokens,
    touched_nodes, edited_sha256``.  ``edits`` as in :func:`edit_trees`; null or empty
    text has no tokens, edits insert into it.  No shuffle; memory follows the longest text.
    """
    names = [shared.fresh(docs, c) for c in ("asked_edits", "whole_text")]
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(docs, text_col).alias(names[1]), edits.alias(names[0]))
    done = edit_trees(grow_trees(read, tokenizer_json, text_col=names[1]), F.col(names[0]), tokenizer_json, text_col=names[1])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), total("leaf_tokens").alias("n_tokens_after"), total("leaf_pretokens").alias("n_pretokens"), "encoded_pretokens", "touched_nodes", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))


def revision(text):
    """Three edits of a text: a cut at a quarter, a correction at the middle, an addition at three quarters."""
    n = F.char_length(text)

    def one(at, length, new):
        return F.struct(at.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(new).alias("text"))

    return F.array(one(F.floor(n / 4), 7, ""), one(F.floor(n / 2), 5, "it's re-worded,"), one(F.floor(n * 3 / 4), 0, "\n\nAn added sentence of 2026. "))
