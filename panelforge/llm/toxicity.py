"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (``bits`` wide) of its words, of word
beginnings (so inflections share weight), of adjacent pairs and of pairs one word
apart.  Training is per-coordinate FTRL-proximal: L1 leaves few weights other
than zero, and these are what scoring broadcasts; at most 2**bits exist.

Fitting reads a bounded sample of labelled rows (``max_positive`` and
``max_negative``, chosen by a hash of the document id).  Their features are hashed
where the texts lie; the learner, a sequence by nature, is one task that reads
arrays of 32-bit numbers.  Calibration weighs the sample's rows so that each label
counts as it does among all labelled rows, whatever the two limits are.  Scoring
covers all rows in one pass without a shuffle.
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

BITS = 22
PREFIXES = (4, 5, 6, 7)
MAX_POSITIVE, MAX_NEGATIVE = 4000, 8000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 2.0, 0.1, 3
#: One sampled row in so many is kept from the learner and calibrates its scores.
CALIBRATION = 5
HELD_OUT_FOLDS = 5
THRESHOLD = 0.5
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hashed feature) of all features, repeats included."""
    low = textbytes.lowered(buf)
    starts, ends, first = textbytes.alnum_words(low, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    h = textbytes.span_hashes(low, starts, ends, cased=True)
    out, of = [h], [doc]
    with np.errstate(over="ignore"):
        for k in PREFIXES:
            long = np.flatnonzero(ends - starts > k)
            out.append(textbytes.span_hashes(low, starts[long], starts[long] + k, cased=True) ^ np.uint64(0x5851F42D4C957F2D))
            of.append(doc[long])
        for gap, c in ((1, _B), (2, _C)):
            pair = np.flatnonzero(doc[gap:] == doc[:-gap])
            out.append(textbytes.mix(h[pair] * _A + h[pair + gap] * c))
            of.append(doc[pair])
    return np.concatenate(of), (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates over presence features."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z = np.zeros(1 << bits, dtype=np.float32)
        self.n = np.zeros(1 << bits, dtype=np.float32)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _bias(self) -> float:
        return -self.bias_z * self.alpha / (self.beta + self.bias_n**0.5)

    def learn(self, index: np.ndarray, label: int) -> None:
        z, n = self.z[index], self.n[index]
        w, b = self._weights(z, n), self._bias()
        g = float(sigmoid(w.sum() + b)) - label
        self.z[index] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self._weights(self.z, self.n).astype(np.float32)
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at], self._bias()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def class_weights(y: np.ndarray, stands_for: dict[int, float]) -> np.ndarray:
    """A weight for each sampled row by how many known rows it stands for; they sum to the number of rows."""
    w = np.where(np.asarray(y) == 1, stands_for.get(1, 1.0), stands_for.get(0, 1.0))
    return w * (len(w) / w.sum()) if len(w) else w


def platt(x: np.ndarray, y: np.ndarray, prior: float = 2.0, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Scale and shift of logits ``x`` that fit labels ``y``, held near (1, 0) by a prior."""
    theta, centre = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    w = np.ones(len(y)) if weight is None else weight
    positive, all_ = float(w[np.asarray(y) == 1].sum()), float(w.sum())
    if not 0 < np.sum(y) < len(y):
        return 1.0, 0.0
    target = np.where(np.asarray(y) == 1, (positive + 1) / (positive + 2), 1 / (all_ - positive + 2))
    x = np.clip(x, -35, 35)
    rows = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = sigmoid(rows @ theta)
        step = np.linalg.solve((rows * (w * p * (1 - p))[:, None]).T @ rows + prior * np.eye(2), rows.T @ (w * (p - target)) + prior * (theta - centre))
        theta = theta - np.clip(step, -1, 1)
        theta[0] = np.clip(theta[0], 0.25, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


@dataclass(frozen=True)
class Model:
    """Weights other than zero, the bias, and the calibration's scale and shift."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
        doc, f = features(buf, offs, self.bits)
        hit = np.flatnonzero(table[f])
        pair = np.unique((doc[hit] << np.int64(32)) | f[hit])  # each feature counts once in a text
        raw = self.bias + np.bincount(pair >> 32, table[pair & 0xFFFFFFFF], minlength=len(offs) - 1)
        return self.scale * raw + self.shift


def held_out(id_col: str = "doc_id", folds: int = HELD_OUT_FOLDS):
    """True where the CRC-32 of the id as text is a multiple of ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, label`` outside the held-out fold; repeated ids count once with their highest label, null ids and labels go."""
    return (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def label_sample(labels: DataFrame, label_col: str, most: dict[int, int], id_col: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """At most ``most[y]`` labelled ids of each label ``y``, by a hash of the id, and how many known ids one of each stands for."""
    known = known_labels(labels, label_col, id_col)
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, {y: count.get(y, 0) / max(1, min(n, count.get(y, 0))) for y, n in most.items()}


def hash_order(ids: np.ndarray) -> np.ndarray:
    """A fixed order of document ids that does not depend on their place in a table."""
    return np.lexsort((ids, textbytes.mix(ids.astype(np.int64).view(np.uint64))))


def train(ids: np.ndarray, y: np.ndarray, features_of: list[np.ndarray], stands_for: dict[int, float], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """A model of labelled rows: FTRL over most of them in hash order, calibration on every CALIBRATION-th.

    Without rows of both labels the model is a constant, the share of label 1 with
    one added to each count.
    """
    positive = int(y.sum())
    if not 0 < positive < len(y):
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), float(np.log((positive + 1) / (len(y) - positive + 1))), bits)
    learner, order = Ftrl(bits), hash_order(ids)
    kept = order[::CALIBRATION]
    learned = np.delete(order, np.s_[::CALIBRATION])
    for _ in range(epochs):
        for k in learned.tolist():
            learner.learn(features_of[k], y[k])
    index, weight, bias = learner.sparse()
    table = np.zeros(1 << bits, dtype=np.float32)
    table[index] = weight
    scale, shift = platt(np.array([bias + table[features_of[k]].sum() for k in kept.tolist()]), y[kept], weight=class_weights(y[kept], stands_for))
    return Model(index, weight, bias, bits, scale, shift)


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, epochs: int = EPOCHS) -> Model:
    """Learn from a bounded sample of labelled rows, none of them held out; see :func:`train`.

    An id that several rows share stands for the least of their texts.  Labels
    without a document, null ids and null labels are not used.
    """
    sample, stands_for = label_sample(labels, label_col, {1: max_positive, 0: max_negative}, id_col)
    texts = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(docs, text_col).alias("text"))
        .join(F.broadcast(sample), "doc_id")  # at most max_positive + max_negative rows of two numbers
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "label", "text")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.ENGINES.clear()
        shared.tidy()
        for batch in batches:
            for a, b, buf, offs in textbytes.slices(batch.column(2)):
                doc, f = features(buf, offs, bits)
                key = np.unique((doc << np.int64(32)) | f)
                cuts = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << 32)
                f = (key & 0xFFFFFFFF).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array([f[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["doc_id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.ENGINES.clear()
        ids, ys, held = [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            ys.append(batch.column(1).to_numpy())
            held += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(2)]
        m = train(np.concatenate([np.empty(0, np.int64), *ids]), np.concatenate([np.empty(0, np.int64), *ys]), held, stands_for, bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (m.index.tobytes(), m.weight.tobytes(), m.bias, m.scale, m.shift)], names=["index", "weight", "bias", "scale", "shift"])
        held.clear()
        shared.tidy()

    rows = texts.mapInArrow(hashed, "doc_id long, label int, features binary").repartition(1)
    row = rows.mapInArrow(learn, "index binary, weight binary, bias double, scale double, shift double").collect()
    if not row:
        return train(np.empty(0, np.int64), np.empty(0, np.int64), [], stands_for, bits)
    return Model(np.frombuffer(row[0]["index"], np.int32), np.frombuffer(row[0]["weight"], np.float32), row[0]["bias"], bits, row[0]["scale"], row[0]["shift"])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (0 to 1) in a new column ``score_col``.

    Null or empty text: the score of no features.  Every other column is passed
    through, a column named ``score_col`` is replaced.  Empty table: no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def values(text: pa.Array) -> dict[str, np.ndarray]:
        model = held.value
        table = np.zeros(1 << model.bits, dtype=np.float32)
        table[model.index] = model.weight
        out = [sigmoid(model.logits(buf, offs, table)) for _, _, buf, offs in textbytes.slices(text)]
        return {score_col: np.concatenate([np.empty(0), *out])}

    return shared.append_columns(docs, text_col, values, {score_col: T.DoubleType()})
