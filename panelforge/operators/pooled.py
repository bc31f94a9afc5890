"""Ordinary least squares over samples, not within subjects: intercept, exposure, covariates, array.

The fixed-threshold baseline is fitted like this on purpose; the joint mixed model starts from the
same design.  All permuted exposures of a design share its other columns, so these are projected
out once: the slope of a replicate is one dot product a row (Frisch-Waugh-Lovell).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import hashing
from panelforge.operators import within

TINY = 1e-9


def indicators(values: list) -> np.ndarray:
    """Columns for all levels but the first, in sorted order."""
    names = [str(v) for v in values]
    return np.array([[float(v == level) for level in sorted(set(names))[1:]] for v in names]).reshape(len(names), -1)


def others(n: int, covariates=None, array: list | None = None) -> np.ndarray:
    """Intercept, covariates and array indicators; columns that are constant go."""
    parts = [np.ones((n, 1))]
    if covariates is not None and np.size(covariates):
        x = np.asarray(covariates, float).reshape(n, -1)
        if not np.isfinite(x).all():
            raise ValueError("covariates must be complete")
        parts.append(x[:, (x != x[:1]).any(axis=0)])
    if array is not None:
        parts.append(indicators(array))
    return np.hstack(parts)


def basis_of(x: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, of as many as are independent (pivoting by what is left of each)."""
    left, out = x.astype(float).copy(), []
    scale = np.sqrt((left**2).sum(axis=0))
    for _ in range(x.shape[1]):
        size = np.sqrt((left**2).sum(axis=0)) / np.where(scale > 0, scale, 1)
        k = int(size.argmax())
        if size[k] <= TINY:
            break
        q = left[:, k] / np.sqrt((left[:, k] ** 2).sum())
        for v in out:  # once more, for rounding
            q = q - v * (v @ q)
        q /= np.sqrt((q**2).sum())
        out.append(q)
        left -= np.outer(q, q @ left)
    return np.array(out).T.reshape(len(x), -1)


class Slopes:
    """The exposure's coefficient under one or many exposures that share all other columns."""

    def __init__(self, exposures: np.ndarray, other: np.ndarray):
        x = np.atleast_2d(np.asarray(exposures, float))
        if not np.isfinite(x).all():
            raise ValueError("the exposure must be complete")
        self.basis = basis_of(other)
        rest = x - (x @ self.basis) @ self.basis.T
        size = (rest**2).sum(axis=1)
        self.known = size > TINY * np.maximum((x**2).sum(axis=1), 1e-300)
        self.project = np.where(self.known[:, None], rest / np.where(self.known, size, 1)[:, None], np.nan).T
        self.rank = self.basis.shape[1] + 1
        self.df = x.shape[1] - self.rank
        self.unit = 1 / np.where(self.known, size, np.nan)

    def of(self, m: np.ndarray) -> np.ndarray:
        """One column of slopes an exposure; NaN where the other columns hold it."""
        return m @ self.project

    def variance(self, m: np.ndarray) -> np.ndarray:
        """Residual variance of each row under the first exposure."""
        r = m - (m @ self.basis) @ self.basis.T
        b = r @ self.project[:, 0]
        return np.maximum((r**2).sum(axis=1) - b**2 / self.unit[0], 0) / self.df


def fit_panel(panel: DataFrame, slopes: Slopes, values: str = "m", keep: tuple[str, ...] = ("probe", "chr", "pos")) -> DataFrame:
    """``betas`` (an array, one slope an exposure) of every probe: a map over blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                b = slopes.of(within.matrix_of(part.column(len(keep))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, max(b.shape[1], 1), dtype=np.int32)), pa.array(b.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], names=[*keep, "betas"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.select(*keep).schema)
    return panel.select(*keep, values).mapInArrow(run, f"{types}, betas array<double>")


def residual_panel(panel: DataFrame, basis: np.ndarray, values: str = "m", keep: tuple[str, ...] = ("probe", "chr", "pos")) -> DataFrame:
    """Every row of ``values`` less its projection on the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = within.matrix_of(batch.column(len(keep)))
                r = m - (m @ basis) @ basis.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, r.shape[1], dtype=np.int32)), pa.array(r.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, values])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.select(*keep).schema)
    return panel.select(*keep, values).mapInArrow(run, f"{types}, `{values}` array<double>")


#: Points, and queries, of one range of values that a task holds.
RANGE_ROWS = 250_000


def value_bounds(points: DataFrame, queries: DataFrame, value: str, parts: int) -> list[float]:
    """Rising bounds of at least ``parts`` ranges of the queries' values, and of as many as keep a range at about RANGE_ROWS points and
    queries however many there are (rows of one value stay together)."""
    found: set[float] = set()
    for df, least in ((points, 1), (queries, parts)):
        v = df.select(F.col(value).cast("double").alias("v"))
        n = max(least, -(-v.count() // RANGE_ROWS))
        if n > 1:
            found.update(v.agg(F.percentile_approx("v", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"] or [])
    return sorted(found)


def dominance(points: DataFrame, queries: DataFrame, level: str, value: str, name: str = "hits", parts: int = 64) -> DataFrame:
    """``queries`` with ``name``: how many points have at least their level and at least their value.

    Two-dimensional dominance counts without comparing all pairs: points and queries are dealt into ranges of
    the value, more of them where there are more rows; a range's points are compared only with its own queries, level by level in
    sorted arrays, and whole ranges above are added from counts by (range, level): running sums along the ranges.
    """
    kept = queries.columns
    bounds = value_bounds(points, queries, value, parts)
    p = points.select(F.col(level).cast("long").alias("__l"), F.col(value).cast("double").alias("__v")).where("__v is not null").withColumn("__r", hashing.rising_range(F.col("__v"), bounds))
    q = queries.withColumn("__r", hashing.rising_range(F.col(value).cast("double"), bounds))
    asked = q.select("__r", F.col(level).cast("long").alias("__l")).distinct()
    counts = p.groupBy("__r", F.col("__l").alias("__pl")).agg(F.count("*").alias("__n"))
    # ranges by levels that a query has: every range's points of at least a level, then those of the ranges above
    each = counts.join(F.broadcast(asked.select("__l").distinct()), F.col("__pl") >= F.col("__l")).select("__r", "__l", "__n")
    grid = each.unionByName(asked.withColumn("__n", F.lit(0).cast("long"))).groupBy("__r", "__l").agg(F.sum("__n").alias("__n"))
    higher = Window.partitionBy("__l").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    above = grid.select("__r", "__l", F.sum("__n").over(higher).alias("__above"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)

    def own(qs, ps):
        if not len(qs):
            return qs.assign(__within=np.empty(0, dtype=np.int64))[[*kept, "__r", "__within"]]
        lv, vv = ps["__l"].to_numpy(), ps["__v"].to_numpy()
        out = np.zeros(len(qs), dtype=np.int64)
        ql, qv = qs[level].to_numpy(), qs[value].to_numpy(float)
        for k in np.unique(ql):
            at, high = ql == k, np.sort(vv[lv >= k])
            out[at] = len(high) - np.searchsorted(high, qv[at], side="left")
        return qs.assign(__within=out)[[*kept, "__r", "__within"]]

    near = q.groupBy("__r").cogroup(p.groupBy("__r")).applyInPandas(own, f"{fields}, `__r` int, `__within` long")
    joined = near.withColumn("__l", F.col(level).cast("long")).join(above, ["__r", "__l"], "left")
    return joined.withColumn(name, F.col("__within") + F.coalesce("__above", F.lit(0))).select(*kept, name)


def joint_fwer(found: DataFrame, null: DataFrame, reps: int, name: str = "fwer") -> DataFrame:
    """``name``: the share of replicates with a bump at least as long (``l``) and as high (``|value|``), and of areas ``name_area``.

    A replicate is a staircase: the highest value among bumps of at least a length.  For each length that was
    found the ``reps`` stairs are one array, joined by length; a bump counts the entries it does not exceed.
    """
    stairs = null.groupBy("rep", F.col("l").alias("__l")).agg(F.max(F.abs("value")).alias("__v"))
    lengths = found.select(F.col("l").alias("__own")).distinct()
    steps = lengths.join(stairs, F.col("__l") >= F.col("__own")).groupBy("__own", "rep").agg(F.max("__v").alias("__v"))
    steps = steps.groupBy("__own").agg(F.collect_list("__v").alias("__stairs"))
    area = null.groupBy("rep").agg(F.max("area").alias("__a")).agg(F.collect_list("__a").alias("__areas"))
    d = found.join(steps, F.col("l") == F.col("__own"), "left").crossJoin(F.broadcast(area))  # one row of at most ``reps`` numbers

    def share(stairs_: str, v):
        return F.when(F.lit(reps) > 0, F.coalesce(F.size(F.filter(stairs_, lambda x: x >= v)), F.lit(0)) / F.lit(max(reps, 1)))

    return d.withColumn(name, share("__stairs", F.abs("value"))).withColumn(f"{name}_area", share("__areas", F.col("area"))).drop("__own", "__stairs", "__areas")


