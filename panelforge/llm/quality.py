"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

Two views of a document: what its words are made of (content) and how its page is
laid out and where it came from (metadata: length, lines, and how often labelled
pages of its language and of its source were good).  Both are logistic regressions.
They start from a bounded sample of labelled rows; then, in rounds, each view marks
the rows it is most sure of among ALL unlabelled rows, a share that grows with the
rounds and keeps the labels' proportions, and the other view learns from them.

Features of all rows are written once.  A round reads them in a few passes: one
histogram of scores sets the thresholds, and sums of gradients and curvatures, as
many numbers as features squared, move the weights; no row reaches the driver.  The
marked rows together weigh a fixed share of the labelled ones, so their number does
not change the balance.  Calibration and the combination of the two calibrated
logits use labelled rows that no learner saw, weighted so that each label counts as
it does among all labelled rows.  All documents are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import shared, textbytes
from panelforge.llm.toxicity import class_weights, hash_order, held_out, label_sample, platt, sigmoid

MAX_POSITIVE, MAX_NEGATIVE = 8000, 4000
ROUNDS, STEPS = 4, 2
#: Share of the unlabelled rows that a view may mark more in each round, how sure it must be, and the marked rows' weight as a share of the labelled ones.
PER_ROUND, SURE, TAUGHT = 0.1, 0.9, 0.25
CALIBRATION = 4
THRESHOLD = 0.5
#: Bins of a histogram of logits, which are cut off at -LIMIT and LIMIT.
BINS, LIMIT = 4800, 12.0
#: Labelled ids up to this many are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Pages that a language or source must have been seen on to count half.
PRIOR = 2.0

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other punctuation
_CLASS[[*range(97, 123), *range(0x80, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[0x20, *range(9, 14)]] = 4
_CLASS[[*b".,;:!?'\"()-"]] = 5
_CLASS[[*b"#$%&*@^~|<>{}[]\\/=+_`"]] = 6

CONTENT = ("lower", "upper", "digit", "mark", "symbol", "other", "word_length", "word_spread", "words_distinct", "top_word", "symbol_words", "capital_words", "bang_words", "short_words", "long_words", "doubled_words")
LAYOUT = ("log_bytes", "log_lines", "log_line_length", "longest_line", "line_spread", "line_distinct", "blank", "ended", "spaces", "words_a_line")


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values and the greatest count, of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    if not len(order):
        return np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    d, v = doc[order], h[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(order)))
    most = np.zeros(len(first) - 1)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=len(first) - 1).astype(float), most


def views(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content and layout features of each document; both start with a constant."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    kind = _CLASS[buf]
    share = {k: _per(kind == k, offs) / size for k in range(7)}
    starts, ends, first = textbytes.word_spans(buf, offs)
    words = np.maximum(np.diff(first), 1)
    length = (ends - starts).astype(float)
    h = textbytes.span_hashes(buf, starts, ends)
    distinct, top = _distinct(h, first)
    mean = _per(length, first) / words
    spread = np.sqrt(np.maximum(_per(length**2, first) / words - mean**2, 0))
    tail = kind[ends - 1] if len(ends) else np.empty(0, np.uint8)
    head = kind[starts] if len(starts) else np.empty(0, np.uint8)
    second = kind[np.minimum(starts + 1, ends - 1)] if len(starts) else np.empty(0, np.uint8)
    doubled = np.zeros(len(h), dtype=bool)
    doubled[1:] = h[1:] == h[:-1]
    doubled[first[:-1][np.diff(first) > 0]] = False  # a document's first word follows none
    bang = buf[ends - 1] == 0x21 if len(ends) else np.empty(0, bool)
    content = np.stack(
        [
            np.ones(n), share[1], share[2], share[3], share[5], share[6], share[0], np.log1p(mean), np.log1p(spread), distinct / words, top / words,
            _per(tail == 6, first) / words, _per((head == 2) & (second == 2), first) / words, _per(bang, first) / words, _per(length <= 2, first) / words, _per(length >= 12, first) / words,
            _per(doubled, first) / words,
        ],
        axis=1,
    )
    inside = buf != 0x0A
    ls, le, lf = textbytes.runs(inside, offs)
    lines = np.maximum(np.diff(lf), 1)
    ll = (le - ls).astype(float)
    line_mean = _per(ll, lf) / lines
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), np.diff(lf)), ll)
    same, _ = _distinct(textbytes.span_hashes(buf, ls, le), lf)
    ended = buf[le - 1] == 0x2E if len(le) else np.empty(0, bool)
    breaks = _per(~inside, offs)
    layout = np.stack(
        [
            np.ones(n), np.log(size), np.log(lines), np.log1p(line_mean), np.log1p(longest), np.log1p(np.sqrt(np.maximum(_per(ll**2, lf) / lines - line_mean**2, 0))), same / lines,
            np.maximum(breaks - lines + 1, 0) / (breaks + 1), _per(ended, lf) / lines, share[4], np.log1p(words / lines),
        ],
        axis=1,
    )
    return content, layout


WIDE = len(CONTENT) + 1, len(LAYOUT) + 1


def good_odds(counts: dict[str, tuple[float, float]], rate: float, value: str | None, less: tuple[float, float] = (0.0, 0.0)) -> float:
    """Log odds of good pages of a language or source against all pages; 0 where it is unknown."""
    good, bad = counts.get(value, (0.0, 0.0)) if value is not None else (0.0, 0.0)
    return float(np.log((good - less[0] + PRIOR * rate) / rate) - np.log((bad - less[1] + PRIOR * (1 - rate)) / (1 - rate)))


@dataclass(frozen=True)
class Origins:
    """Good and bad labelled pages of each language and source: as many entries as sampled rows at most."""

    rate: float
    counts: tuple[dict, dict]

    @classmethod
    def of(cls, origin: list[tuple], y: np.ndarray) -> Origins:
        counts: tuple[dict, dict] = ({}, {})
        for row, label in zip(origin, y):
            for held, v in zip(counts, row):
                if v is not None:
                    good, bad = held.get(v, (0.0, 0.0))
                    held[v] = (good + label, bad + 1 - label)
        return cls(float((np.sum(y) + 1) / (len(y) + 2)), counts)

    def rows(self, origin: list[tuple], y: np.ndarray | None = None) -> np.ndarray:
        """Odds of language and source; a row with a label is not counted in its own."""
        less = [(float(v), float(1 - v)) for v in y] if y is not None else [(0.0, 0.0)] * len(origin)
        return np.array([[good_odds(c, self.rate, v, own if v is not None else (0.0, 0.0)) for c, v in zip(self.counts, row)] for row, own in zip(origin, less)]).reshape(len(origin), 2)

    def columns(self, *columns: pa.Array) -> np.ndarray:
        out = []
        for held, column in zip(self.counts, columns):
            coded = column.dictionary_encode()
            each = np.array([good_odds(held, self.rate, v) for v in coded.dictionary.to_pylist()] + [good_odds(held, self.rate, None)])
            out.append(each[coded.indices.fill_null(len(each) - 1).to_numpy(zero_copy_only=False)])
        return np.stack(out, axis=1) if len(columns[0]) else np.empty((0, 2))


def _expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, bounded."""
    z = np.clip((x - centre) / scale, -5, 5)
    return np.concatenate([np.ones((len(z), 1)), z[:, 1:], z[:, 1:] ** 2 / 5], axis=1)


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, ridge: float, extra=None) -> np.ndarray:
    """One bounded step; ``extra`` is a (gradient, curvature) of further rows."""
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    p = sigmoid(x @ theta)
    g, h = x.T @ (w * (p - y)) + penalty @ theta, (x * (w * p * (1 - p))[:, None]).T @ x + penalty
    if extra is not None:
        g, h = g + extra[0], h + extra[1]
    return np.clip(np.linalg.solve(h, g), -2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    theta = np.zeros(x.shape[1])
    for _ in range(30):
        step = _newton(x, y, w, theta, ridge)
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    return theta


@dataclass(frozen=True)
class Model:
    """For each view: centre, scale, weights and calibration; then the combination of calibrated logits."""

    parts: tuple
    mix: np.ndarray  # shift and one weight for each view
    origins: Origins | None = None
    constant: float | None = None

    def logits(self, content: np.ndarray, layout: np.ndarray, *origin: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            return (np.full(len(content), self.constant),) * 3
        xs = content, np.concatenate([layout, self.origins.columns(*origin)], axis=1)
        each = [np.clip(a * (_expand(x, c, s) @ w) + b, -LIMIT, LIMIT) for x, (c, s, w, a, b) in zip(xs, self.parts)]
        return each[0], each[1], self.mix[0] + self.mix[1] * each[0] + self.mix[2] * each[1]


@dataclass(frozen=True)
class Round:
    """What a pass over the unlabelled rows needs: frames and weights of both views, and the marks of their teachers."""

    frames: tuple  # (centre, scale) of each view
    teacher: tuple  # weights that mark rows
    origins: Origins
    marks: tuple | None = None  # (least logit of label 1, greatest of label 0) of each view
    student: tuple | None = None  # weights whose gradient is asked for

    def expanded(self, content, layout, *origin) -> list[np.ndarray]:
        return [_expand(x, *f) for x, f in zip((content, np.concatenate([layout, self.origins.columns(*origin)], axis=1)), self.frames)]

    def counts(self, xs: list[np.ndarray]) -> np.ndarray:
        """Rows in each bin of each view's logit."""
        return np.concatenate([np.bincount(bin_of(x @ w), minlength=BINS) for x, w in zip(xs, self.teacher)]).astype(float)

    def sums(self, xs: list[np.ndarray]) -> np.ndarray:
        """For each view: rows that the other one marks, their gradient and curvature."""
        out = []
        for v in (0, 1):
            z = bin_of(xs[1 - v] @ self.teacher[1 - v])
            up, down = self.marks[1 - v]
            x = xs[v][(z >= up) | (z <= down)]
            y = (z >= up)[(z >= up) | (z <= down)].astype(float)
            p = sigmoid(x @ self.student[v])
            out += [np.array([float(len(y))]), x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)]
        return np.concatenate(out)


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.minimum((np.clip(z, -LIMIT, LIMIT) + LIMIT) * (BINS / (2 * LIMIT)), BINS - 1).astype(np.int64)


def marks_of(counts: np.ndarray, share: float, rate: float) -> tuple[int, int]:
    """(least bin of label 1, greatest bin of label 0): the surest ``share`` of all rows in the labels' proportions, none less sure than SURE."""
    sure, room = np.log(SURE / (1 - SURE)), share * counts.sum()
    up = BINS - int(np.searchsorted(np.cumsum(counts[::-1]), room * rate, side="left")) - 1
    down = int(np.searchsorted(np.cumsum(counts), room * (1 - rate), side="left"))
    return max(up, int(bin_of(np.array([sure]))[0]) + 1), min(down, int(bin_of(np.array([-sure]))[0]) - 1)


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, origins: Origins, unlabelled=None, stands_for: dict[int, float] | None = None, rounds: int = ROUNDS) -> Model:
    """Labelled views ``xs`` with labels ``y``; ``unlabelled(round, method)`` sums a method of :class:`Round` over all other rows."""
    positive = int(y.sum())
    if not 0 < positive < len(y) or len(y) < 2 * CALIBRATION:
        return Model((), np.zeros(3), None, float(np.log((positive + 1) / (len(y) - positive + 1))))
    held = np.arange(len(y)) % CALIBRATION == 0
    frames = tuple((x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6) for x in xs)
    xe = [_expand(x, *f) for x, f in zip(xs, frames)]
    ones, rate = np.ones(int((~held).sum())), float(y[~held].mean())
    weights = tuple(_logistic(x[~held], y[~held], ones) for x in xe)
    for r in range(1, rounds + 1 if unlabelled else 1):
        teacher = weights
        counts = unlabelled(Round(frames, teacher, origins), "counts").reshape(2, BINS)
        if not counts.sum():
            break
        marks = tuple(marks_of(c, r * PER_ROUND, rate) for c in counts)
        for _ in range(STEPS):
            total, at, new = unlabelled(Round(frames, teacher, origins, marks, weights), "sums"), 0, []
            for v in (0, 1):
                k = xe[v].shape[1]
                n, g, h = total[at], total[at + 1 : at + 1 + k], total[at + 1 + k : at + 1 + k + k * k].reshape(k, k)
                at += 1 + k + k * k
                w = TAUGHT * len(ones) / n if n else 0.0
                new.append(weights[v] - _newton(xe[v][~held], y[~held], ones, weights[v], 1.0, (w * g, w * h)))
            weights = tuple(new)
    parts, logits, w = [], [], class_weights(y[held], stands_for or {})
    for v in (0, 1):
        z = xe[v][held] @ weights[v]
        a, b = platt(z, y[held], weight=w)
        parts.append((*frames[v], weights[v], a, b))
        logits.append(np.clip(a * z + b, -LIMIT, LIMIT))
    mix = _logistic(np.stack([np.ones(held.sum()), *logits], axis=1), y[held], w, ridge=0.5)
    return Model(tuple(parts), mix, origins)


ROWS = {"views": T.BinaryType(), "lang": T.StringType(), "source": T.StringType()}


def view_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``doc_id, views, lang, source`` of every row; ``views`` holds both views' features as 32-bit floats."""
    id_, text = shared.fresh(docs, "row_id"), shared.fresh(docs, "row_text")
    base = docs.select(F.col(id_col).cast("long").alias(id_), shared.text_column(docs, text_col).alias(text), *(c.alias(n) for c, n in zip(_origin(docs, lang_col, source_col), ("lang", "source"))))

    def values(column: pa.Array) -> dict:
        rows = [r.tobytes() for _, _, buf, offs in textbytes.slices(column) for r in np.concatenate(views(buf, offs), axis=1).astype("<f4")]
        return {"views": pa.array(rows, pa.binary())}

    return shared.append_columns(base, F.col(text), values, {"views": T.BinaryType()}).select(F.col(id_).alias("doc_id"), *ROWS)


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Content and layout features of packed rows."""
    x = np.frombuffer(b"".join(rows), dtype="<f4").astype(float).reshape(-1, sum(WIDE))
    return x[:, : WIDE[0]], x[:, WIDE[0] :]


def _origin(docs: DataFrame, *names: str):
    return [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in names]


def _summed(rows: DataFrame, what: Round, method: str) -> np.ndarray:
    """The sum of a method of ``what`` over all rows: partitions send one vector each, a few tasks add them."""
    held = rows.sparkSession.sparkContext.broadcast(what)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                xs = held.value.expanded(*_arrays(batch.column(0).to_pylist()), batch.column(1), batch.column(2))
                own = getattr(held.value, method)(xs)
                total = own if total is None else total + own
        yield from _vector(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, dtype="<f8") for b in batches for x in b.column(0).to_pylist()]
        yield from _vector(np.sum(parts, axis=0) if parts else None)

    partial = rows.select(*ROWS).mapInArrow(one, "total binary")
    wide = -(-rows.rdd.getNumPartitions() // 64)
    parts = [np.frombuffer(r["total"], dtype="<f8") for r in partial.repartition(wide).mapInArrow(add, "total binary").collect()]
    held.destroy()
    return np.sum(parts, axis=0) if parts else np.zeros(2 * BINS)


def _vector(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["total"])


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, rounds: int = ROUNDS) -> Model:
    """Co-train on a bounded sample of labelled rows and all rows that ``labels`` does not list.

    The driver receives two short feature vectors for each sampled row, at most
    ``max_positive + max_negative`` of them.  Labels of the held-out fold are never
    read.  An id that several rows share stands for one of them.  Null ids, texts,
    languages and sources take part as they are; without rows of both labels the
    model is a constant, the share of label 1 with one added to each count.
    """
    rows = shared.cut(view_rows(docs, id_col, text_col, lang_col, source_col))
    sample, stands_for = label_sample(labels, label_col, {1: max_positive, 0: max_negative}, id_col)
    own = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*ROWS)).alias("row")).select("doc_id", "label", "row.*").collect()
    order = hash_order(np.array([r["doc_id"] for r in own], dtype=np.int64))
    own = [own[k] for k in order.tolist()]
    y = np.array([r["label"] for r in own], dtype=float)
    origin = [(r["lang"], r["source"]) for r in own]
    content, layout = _arrays([bytes(r["views"]) for r in own])
    origins = Origins.of(origin, y)
    listed = labels.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    few = listed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rest = shared.cut(rows.join(F.broadcast(listed) if few else listed, "doc_id", "left_anti"))
    return co_train((content, np.concatenate([layout, origins.rows(origin, y)], axis=1)), y, origins, lambda what, method: _summed(rest, what, method), stands_for, rounds)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", names: tuple[str, str, str] = ("content_score", "metadata_score", "score")) -> DataFrame:
    """``docs`` with the calibrated probability of each view and their combination in new columns ``names``.

    Null or empty text: scored on its features (all shares are zero).  Null or
    missing language and source: those of an unseen one.  Every other column is passed
    through, columns with these names are replaced.  Empty table: no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def values(text, lang, source) -> dict[str, np.ndarray]:
        out = [np.empty((3, 0))]
        for a, b, buf, offs in textbytes.slices(text):
            out.append(np.stack([sigmoid(z) for z in held.value.logits(*views(buf, offs), lang.slice(a, b - a), source.slice(a, b - a))]))
        return dict(zip(names, np.concatenate(out, axis=1)))

    origin = _origin(docs, lang_col, source_col)
    return shared.append_columns(docs, text_col, values, {c: T.DoubleType() for c in names}, *origin)


__all__ = ["Model", "co_train", "fit", "held_out", "score", "views"]
