"""Cross-entropy difference between matched target and background n-gram models.

Both models are word bigrams with a Dirichlet prior on word frequencies and share one
vocabulary, all words of the corpus.  Counts cover all documents (background) and all target
documents, and are kept for every word and every bigram in tables dealt over ranges of
their 64-bit keys (62 bits of hash and two that say what is counted), which grow with the corpus;
two n-grams share a count only if their hashes are equal.

A document's score is its mean loss per token under the background minus that
under the target: larger where it reads more like the target.  A document's own
counts are taken out of every model that counted it, so that documents inside
and outside the target set are scored alike.  Its copies elsewhere are documents of
their own and stay in the models: a text that occurs twice is scored with one
occurrence left, which lowers both losses.

Traffic.  A slice of documents asks for the counts of its distinct keys.  Where there are more
than LANES key ranges, slices do not talk to ranges one by one: a bundle of slices combines the
keys of a lane of ranges first, asks for these, and deals the answers out again.  With S slices and R
ranges that makes about S * sqrt(R) + sqrt(R) * R messages instead of S * R, and a message
holds the keys of sqrt(R) of the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import shared, sketch, textbytes

PRIOR = 20.0
#: Target ids up to this many are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text of a slice and of a key range; their numbers grow with the corpus.
SLICE_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
#: Key ranges that slices ask directly; beyond, lanes of ranges and bundles of slices lie between.
LANES = 512
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xE7037ED1A0B428DB)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = textbytes.lowered(buf)
    starts, ends, first = textbytes.alnum_words(low, offs)
    return textbytes.span_hashes(low, starts, ends, cased=True), first


def mark_targets(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", flag: str = "is_target") -> DataFrame:
    """``docs`` with a boolean column that is true where ``targets`` lists the id."""
    key = shared.fresh(docs, "target_id")
    ids = targets.select(F.col(id_col).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    docs = docs.drop(flag)
    return docs.join(F.broadcast(ids) if few else ids, F.col(id_col).cast("long") == F.col(key), "left").withColumn(flag, F.col(key).isNotNull()).drop(key)


def _keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token three 64-bit keys, its word's, its context's and their pair's (the kind in the low bits); and each document's first."""
    h, first = _words(buf, offs)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][np.diff(first) > 0]] = np.uint64(0x5851F42D4C957F2D)  # the start mark
    with np.errstate(over="ignore"):
        each = (textbytes.mix(h + _A), textbytes.mix(before + _B), textbytes.mix(textbytes.mix(before * _A) + h * _B))
    return np.stack([x & ~np.uint64(3) | np.uint64(k) for k, x in enumerate(each)]), first


def _repeats(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its document."""
    _, at, n = np.unique((doc << np.int64(32)) | key, return_inverse=True, return_counts=True)
    return n[at]


def _slice_keys(table: pa.Table, text: str, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's sorted distinct keys, each token's three places among them, tokens of each document, and target flags."""
    keys, sizes = [np.empty((3, 0), np.uint64)], [np.empty(0, np.int64)]
    for chunk in table.column(text).chunks:
        for _, _, buf, offs in textbytes.slices(chunk):
            k, first = _keys(buf, offs)
            keys.append(k)
            sizes.append(np.diff(first))
    u, at = np.unique(np.concatenate(keys, axis=1), return_inverse=True)
    return u, at.reshape(3, -1), np.concatenate(sizes), table.column(target).to_numpy().astype(bool)


def _packed(u: np.ndarray, counts: list[np.ndarray], cuts: list[int]) -> list[pa.Array]:
    """Keys as compressed differences and their counts, one entry a part."""
    parts = list(zip(cuts, cuts[1:]))
    return [pa.array([sketch.squeeze(np.diff(u[i:j], prepend=np.uint64(0))) for i, j in parts], pa.binary()), *(pa.array([sketch.squeeze(x[i:j]) for i, j in parts], pa.binary()) for x in counts)]


def _unpacked(table: pa.Table, *names: str) -> list[list[np.ndarray]]:
    """Keys, and counts of the given columns, of every row."""
    keys = [np.cumsum(sketch.spread(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("keys")]
    return [keys, *([sketch.spread(x.as_py(), np.int64) for x in table.column(c)] for c in names)]


def _merged(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of all rows, where each row's keys are among them, and summed counts."""
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, at, [np.bincount(at, weights=np.concatenate(x), minlength=len(u)).astype(np.int64) for x in counts]


_KNOWN = ("words", "in_target", "in_background")


def score_corpus(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "is_target", prior: float = PRIOR, names: tuple[str, str, str, str] = ("n_tokens", "target_loss", "background_loss", "difference")) -> DataFrame:
    """``docs`` without the text, with ``target_col``, tokens, mean losses per token under both models and their difference.

    No word is cut.  Slices of documents send the counts of their distinct keys to the ranges of keys (in bundles, see
    above); a range adds them up and answers with the totals, which the slice's documents are scored with.  Keys
    travel as compressed differences.

    Null, empty and wordless texts have no tokens and null losses; empty ones are dealt evenly.  Null ids are no
    targets.  Repeated rows are documents of their own; rows of one id and text share a slice.  Columns of ``docs`` named like
    the results are replaced, others pass through whatever they are called.  Empty table: no rows.
    """
    marked = mark_targets(docs, targets, id_col=id_col, flag=target_col)
    size = docs.select(F.sum(F.octet_length(shared.text_column(docs, text_col))).alias("n")).first()["n"] or 0
    slices, ranges = (max(1, -(-size // b)) for b in (SLICE_BYTES, RANGE_BYTES))
    lanes = ranges if ranges <= LANES else int(np.ceil(np.sqrt(ranges)))
    fine = -(-ranges // lanes)  # ranges of a lane
    bundled = fine > 1
    bundle = lanes if bundled else 1  # slices of a bundle
    ranges = lanes * fine
    edge_of = np.array([(k << 64) // ranges for k in range(ranges)], dtype=np.uint64)
    rest = [c for c in marked.columns if c not in (text_col, *names)]
    words, flag, slice_ = (shared.fresh_of(rest, c) for c in ("words_of", "counted", "slice"))
    text = shared.text_column(marked, text_col)
    hashed = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slices))
    dealt = marked.select(*rest, text.alias(words), F.col(target_col).alias(flag), F.when(text == "", F.pmod(F.monotonically_increasing_id(), F.lit(slices))).otherwise(hashed).alias(slice_))

    def ask(table: pa.Table) -> pa.Table:
        u, at, sizes, target = _slice_keys(table, words, flag)
        b = np.bincount(at.ravel(), minlength=len(u))
        t = np.bincount(at[:, np.repeat(target, sizes)].ravel(), minlength=len(u))
        own = table.column(slice_)[0].as_py()
        cuts = [0, *np.searchsorted(u, edge_of[::fine][1:]), len(u)]
        head = [pa.array(x, pa.int64()) for x in (range(lanes), [own] * lanes, [own // bundle] * lanes)]
        return pa.Table.from_arrays([*head, *_packed(u, [t, b], cuts)], names=["lane", "slice", "bundle", "keys", "target", "background"])

    def combine(table: pa.Table) -> pa.Table:
        """The keys of a bundle's slices in one lane, cut by ranges."""
        keys, *counts = _unpacked(table, "target", "background")
        u, _, sums = _merged(keys, counts)
        lane = table.column("lane")[0].as_py()
        cuts = [0, *np.searchsorted(u, edge_of[lane * fine + 1 : (lane + 1) * fine]), len(u)]
        head = [pa.array(x, pa.int64()) for x in (range(lane * fine, (lane + 1) * fine), [table.column("bundle")[0].as_py()] * fine, [lane] * fine)]
        return pa.Table.from_arrays([*head, *_packed(u, sums, cuts)], names=["range", "slice", "lane", "keys", "target", "background"])

    def answer(table: pa.Table) -> pa.Table:
        """The totals of every asker's keys (a slice, or a bundle), and how many words and tokens a range counts."""
        keys, *counts = _unpacked(table, "target", "background")
        u, at, sums = _merged(keys, counts)
        word = (u & np.uint64(3)) == 0
        known = [int(word.sum()), *(int(x[word].sum()) for x in sums)]
        cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        back = [pa.array([sketch.squeeze(x[at[i:j]]) for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in sums]
        place = "range" if bundled else "lane"
        return pa.Table.from_arrays([table.column("slice"), table.column("lane"), table.column(place), *back, *(pa.array([k] * table.num_rows, pa.int64()) for k in known)], names=["slice", "lane", "place", "target", "background", *_KNOWN])

    def deal_out(asked: pa.Table, found: pa.Table) -> pa.Table:
        """A bundle's answers in one lane, for each of its slices."""
        found = found.sort_by("place")
        keys, *_ = _unpacked(asked)
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.concatenate([sketch.spread(x.as_py(), np.int64) for x in found.column(c)]) for c in ("target", "background")]
        cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        back = [pa.array([sketch.squeeze(x[at[i:j]]) for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in totals]
        known = [pa.array([sum(found.column(c).to_pylist())] * asked.num_rows, pa.int64()) for c in _KNOWN]
        return pa.Table.from_arrays([asked.column("slice"), asked.column("lane"), asked.column("lane"), *back, *known], names=["slice", "lane", "place", "target", "background", *_KNOWN])

    def losses(table: pa.Table, found: pa.Table) -> pa.Table:
        _, at, n, target = _slice_keys(table, words, flag)
        found = found.sort_by("place")
        distinct, *totals = (sum(found.column(c).to_pylist()) for c in _KNOWN)
        doc = np.repeat(np.arange(len(n)), n)
        own = [_repeats(doc, x) for x in at]
        first, out = np.concatenate([[0], np.cumsum(n)]), []
        for c, total, counted in (("target", totals[0], target), ("background", totals[1], np.ones(len(n), dtype=bool))):
            counts = np.concatenate([np.empty(0, np.int64), *(sketch.spread(x.as_py(), np.int64) for x in found.column(c))])
            word, context, pair = (counts[a] - o * counted[doc] for a, o in zip(at, own))
            single = (word + 1.0) / (total - (n * counted)[doc] + distinct + 1)
            summed = np.concatenate([[0], np.cumsum(-np.log((pair + prior * single) / (context + prior)))])
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append((summed[first[1:]] - summed[first[:-1]]) / n)
        t, b = out
        return pa.Table.from_arrays([*(table.column(c) for c in rest), pa.array(n), *(pa.array(x, mask=n == 0) for x in (t, b, b - t))], names=[*rest, *names])

    replies = "slice long, lane long, place long, target binary, background binary, words long, in_target long, in_background long"
    asked = dealt.groupBy(slice_).applyInArrow(ask, "lane long, slice long, bundle long, keys binary, target binary, background binary")
    if bundled:
        asked = shared.cut(asked)
        merged = asked.groupBy("bundle", "lane").applyInArrow(combine, "range long, slice long, lane long, keys binary, target binary, background binary")
        found = merged.groupBy("range").applyInArrow(answer, replies).withColumnRenamed("slice", "bundle")
        answers = asked.groupBy("bundle", "lane").cogroup(found.groupBy("bundle", "lane")).applyInArrow(deal_out, replies)
    else:
        answers = asked.groupBy("lane").applyInArrow(answer, replies)
    types = (T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*marked.select(*rest).schema.fields, *(T.StructField(c, t) for c, t in zip(names, types))])
    return dealt.groupBy(slice_).cogroup(answers.groupBy("slice")).applyInArrow(losses, schema)
