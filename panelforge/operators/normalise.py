"""Bringing two kinds of probes onto one scale: beta mixtures by sample, mapped component by component.

Values of one kind (type II) are compressed against the other's (type I).  Each sample's values of a kind
are a mixture of three beta distributions (low, middle, high), fitted by EM to a histogram; values of the
second kind are carried by their probability in their own low or high component to the quantile of the
first kind's, and what lies between is stretched so that the scale has no gap (Teschendorff and others, 2013).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import special
from panelforge.operators import within

BINS, ROUNDS = 1000, 200
#: Where low and high values begin before the first round.
START = (0.2, 0.75)
_GRID = 1 / (1 + np.exp(-np.linspace(-12, 12, 4001)))


def fit_mixture(counts: np.ndarray, rounds: int = ROUNDS, tol: float = 1e-7) -> np.ndarray:
    """(weight, a, b) of three beta components, one row each by rising mean, from a histogram of (0, 1)."""
    x = (np.arange(len(counts)) + 0.5) / len(counts)
    resp = np.stack([x < START[0], (x >= START[0]) & (x <= START[1]), x > START[1]], axis=1).astype(float) * 0.98 + 0.02 / 3
    total, before, out = counts.sum(), -np.inf, None
    lx, l1x = np.log(x), np.log1p(-x)
    for _ in range(rounds):
        n = np.maximum((counts[:, None] * resp).sum(axis=0), 1e-9)
        mean = (counts[:, None] * resp * x[:, None]).sum(axis=0) / n
        var = np.maximum((counts[:, None] * resp * (x[:, None] - mean) ** 2).sum(axis=0) / n, 1e-7)
        size = np.maximum(mean * (1 - mean) / var - 1, 1e-3)  # moments in the place of the likelihood's maximum
        a, b = mean * size, (1 - mean) * size
        norm = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
        log = np.log(n / total) + norm + np.outer(lx, a - 1) + np.outer(l1x, b - 1)
        top = log.max(axis=1, keepdims=True)
        dens = np.exp(log - top)
        resp = dens / dens.sum(axis=1, keepdims=True)
        now = float((counts * (top[:, 0] + np.log(dens.sum(axis=1)))).sum()) / max(total, 1)
        out = np.stack([n / total, a, b], axis=1)
        if abs(now - before) < tol:
            break
        before = now
    return out[np.argsort(out[:, 1] / (out[:, 1] + out[:, 2]), kind="stable")]


def borders(model: np.ndarray) -> tuple[float, float]:
    """Where the low component stops and the high one begins to be the likeliest, between their means."""
    w, a, b = model.T
    norm = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    log = np.log(np.maximum(w, 1e-300)) + norm + np.outer(np.log(_GRID), a - 1) + np.outer(np.log1p(-_GRID), b - 1)
    best, mean = log.argmax(axis=1), a / (a + b)
    low, high = _GRID[(best == 0) & (_GRID < mean[1])], _GRID[(best == 2) & (_GRID > mean[1])]
    return (float(low.max()) if len(low) else float(mean[0])), (float(high.min()) if len(high) else float(mean[2]))


def carry(x: np.ndarray, own: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Each value's quantile under the beta (a, b) ``to`` at its probability under ``own``; both tails keep their precision."""
    out = np.empty_like(x)
    low = x <= own[0] / (own[0] + own[1])
    for at, flip in ((low, False), (~low, True)):
        tables = [special.incomplete_beta_array(b if flip else a, a if flip else b, 1 - _GRID if flip else _GRID) for a, b in (own, to)]
        logs = [np.log(np.maximum(t[::-1] if flip else t, 1e-300)) for t in tables]
        grid = _GRID[::-1] if flip else _GRID
        p = np.interp(1 - x[at] if flip else x[at], 1 - grid if flip else grid, logs[0])
        out[at] = np.interp(p, logs[1], grid)
    return out


def mapped(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Values of the second kind on the first's scale."""
    lo, hi = borders(second)
    y = x.astype(float).copy()
    ok = np.isfinite(x) & (x > 0) & (x < 1)
    low, high = ok & (x <= lo), ok & (x >= hi)
    mid = ok & ~low & ~high
    y[low], y[high] = carry(x[low], second[0, 1:], first[0, 1:]), carry(x[high], second[2, 1:], first[2, 1:])
    a, b = carry(np.array([lo]), second[0, 1:], first[0, 1:])[0], carry(np.array([hi]), second[2, 1:], first[2, 1:])[0]
    if hi > lo:
        y[mid] = a + (x[mid] - lo) * (b - a) / (hi - lo)
    return y


def histograms(panel: DataFrame, kind: str, values: str) -> DataFrame:
    """``sample, second, bin, n`` of all values inside (0, 1): a map that returns the bins of a partition, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m, second = within.matrix_of(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(int)
                if total is None:
                    total = np.zeros((m.shape[1], 2, BINS), dtype=np.int64)
                ok = np.isfinite(m) & (m > 0) & (m < 1)
                row, col = np.nonzero(ok)
                at = np.minimum((m[row, col] * BINS).astype(int), BINS - 1)
                total += np.bincount((col * 2 + second[row]) * BINS + at, minlength=total.size).reshape(total.shape)
        if total is not None:
            s, k, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[s, k, b])], names=["sample", "second", "bin", "n"])

    read = panel.select(F.col(kind).alias("second"), values)
    return read.mapInArrow(run, "sample int, second int, bin int, n long").groupBy("sample", "second", "bin").agg(F.sum("n").alias("n"))


def probe_types(panel: DataFrame, second: str, values: str = "beta") -> DataFrame:
    """``panel`` with the ``values`` (arrays of beta values, one a sample) of its second kind of probes on the first's scale.

    ``second``: the boolean column that says which probes these are.  Samples are fitted apart, in parallel; a sample with
    fewer than 100 values of either kind stays as it is, so do values that are missing, 0 or 1.  One model a sample (18
    numbers) goes to all tasks; the panel is read twice and never shuffled.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((2, BINS))
        counts[pdf["second"], pdf["bin"]] = pdf["n"]
        if counts.sum(axis=1).min() < 100:
            return pd.DataFrame({"sample": pd.Series([], dtype="int32"), "model": pd.Series([], dtype=object)})
        return pd.DataFrame({"sample": [int(pdf["sample"].iloc[0])], "model": [np.stack([fit_mixture(c) for c in counts]).ravel().tolist()]})

    models = {r["sample"]: np.array(r["model"]).reshape(2, 3, 3) for r in histograms(panel.withColumn("__second", F.col(second).cast("int")), "__second", values).groupBy("sample").applyInPandas(fit, "sample int, model array<double>").collect()}
    at, flag = panel.columns.index(values), panel.columns.index(second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, rows = within.matrix_of(batch.column(at)).copy(), batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
            for k, (one, two) in models.items():
                m[rows, k] = mapped(m[rows, k], one, two)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    types = ", ".join(f"`{f.name}` {'array<double>' if f.name == values else f.dataType.simpleString()}" for f in panel.schema)
    return panel.mapInArrow(run, types)
