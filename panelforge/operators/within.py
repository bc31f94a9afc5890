"""Within-subject estimation: demeaning, guards, fits, moderation, residuals, GLS."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import special
from panelforge.functions.session import settled
from panelforge.operators import quantiles

KEEP = 1e-9


def within_transform(df: DataFrame, value: str, *by: str, name: str | None = None) -> DataFrame:
    """``value`` less its mean over ``by`` (subject, or probe and subject)."""
    return df.withColumn(name or f"{value}_within", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def identification(design: DataFrame, exposure: str = "exposure", subject: str = "subject", *by: str) -> DataFrame:
    """``n_samples, n_subjects, df`` of a covariate-free within fit; 0 where exposure never varies within a subject."""
    d = within_transform(design, exposure, *by, subject, name="__x")
    g = d.groupBy(*by).agg(F.count("*").alias("n_samples"), F.countDistinct(subject).alias("n_subjects"), F.max(F.abs("__x")).alias("__m"))
    return g.select(*by, "n_samples", "n_subjects", F.when(F.col("__m") > KEEP, F.col("n_samples") - F.col("n_subjects") - 1).otherwise(0).cast("long").alias("df"))


def fit_long(df: DataFrame, by: list[str], value: str = "value", exposure: str = "exposure", subject: str = "subject") -> DataFrame:
    """Covariate-free within fits of long rows, one for each ``by``: ``beta, se, z, df``.

    Pure aggregates over demeaned columns; groups that are not identified go.
    """
    w = Window.partitionBy(*by, subject)
    d = df.withColumn("__x", F.col(exposure) - F.avg(exposure).over(w)).withColumn("__y", F.col(value) - F.avg(value).over(w))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(subject).alias("subjects"), F.sum(F.col("__x") * F.col("__x")).alias("xx"), F.sum(F.col("__x") * F.col("__y")).alias("xy"), F.sum(F.col("__y") * F.col("__y")).alias("yy"), F.max(F.abs("__x")).alias("m"))
    g = g.withColumn("df", F.col("n") - F.col("subjects") - 1).where((F.col("m") > KEEP) & (F.col("df") > 0))
    rss = F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0))
    g = g.withColumn("beta", F.col("xy") / F.col("xx")).withColumn("se", F.sqrt(rss / F.col("df") / F.col("xx")))
    return g.select(*by, "beta", "se", F.when(F.col("se") > 0, F.col("beta") / F.col("se")).otherwise(0.0).alias("z"), F.col("df").cast("long").alias("df"), F.col("n").alias("n_samples"), F.col("subjects").alias("n_subjects"))


class Design:
    """The demeaned design of one set of samples: kept columns, inverse and degrees of freedom."""

    def __init__(self, exposure, subject, covariates=None):
        x = np.asarray(exposure, float).reshape(-1, 1)
        if covariates is not None and np.size(covariates):
            x = np.hstack([x, np.asarray(covariates, float).reshape(len(x), -1)])
        if not np.isfinite(x).all():
            raise ValueError("exposure and covariates must be complete")
        _, code = np.unique(np.asarray(subject, dtype=str), return_inverse=True)
        self.code, self.subjects = code, int(code.max()) + 1 if len(code) else 0
        count = np.bincount(code, minlength=self.subjects)
        self.mean = np.zeros((self.subjects, len(code)))
        self.mean[code, np.arange(len(code))] = 1 / count[code]
        xw = self.demean(x.T).T
        keep = np.abs(xw).max(axis=0) > KEEP if len(xw) else np.zeros(x.shape[1], bool)
        self.kept = keep
        self.xw = xw[:, keep]
        self.identified = bool(keep[0]) if len(keep) else False
        self.df = len(code) - self.subjects - int(keep.sum()) if self.identified else 0
        if self.identified:
            self.inverse = special.pseudo_inverse(self.xw.T @ self.xw)
            self.project = self.xw @ self.inverse

    def demean(self, m: np.ndarray) -> np.ndarray:
        """Rows less their subject means."""
        return m - (m @ self.mean.T)[:, self.code]

    def fit(self, m: np.ndarray, demeaned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(beta of the exposure, residual variance) of each row of ``m``."""
        if not self.identified:
            raise ValueError("the exposure does not vary within any subject")
        if self.df <= 0:
            raise ValueError("no degrees of freedom are left")
        mw = m if demeaned else self.demean(m)
        b = mw @ self.project
        rss = np.maximum((mw * mw).sum(axis=1) - ((mw @ self.xw) * b).sum(axis=1), 0)
        return b[:, 0], rss / self.df

    def residuals(self, m: np.ndarray, project: bool = True) -> np.ndarray:
        mw = self.demean(m)
        return mw - (mw @ self.project) @ self.xw.T if project and self.identified else mw

    @property
    def unit(self) -> float:
        return float(self.inverse[0, 0])


def rows_of(covariates, at) -> np.ndarray | None:
    """The covariates of some samples; None without any."""
    return None if covariates is None else np.asarray(covariates, float)[np.asarray(at)]


def take(df: DataFrame, values: str, at: list[int]) -> DataFrame:
    """``df`` with the entries ``at`` of its value arrays: one array expression, however many samples there are."""
    return df.withColumn(values, F.transform(F.lit(np.array(at, dtype=np.int32).tolist()), lambda i: F.get(F.col(values), i)) if len(at) else F.array().cast(dict(df.dtypes)[values]))


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix; ValueError where lengths differ, nulls are NaN."""
    if not len(column):
        return np.empty((0, 0))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (n != n[0]).any():
        raise ValueError("value arrays of a panel must all have one value a sample")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), int(n[0]))


def fit_panel(panel: DataFrame, design: Design, values: str = "m", keep: tuple[str, ...] = ("probe", "chr", "pos")) -> DataFrame:
    """``beta, s2`` of every probe: blocks of rows against one small design, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                beta, s2 = design.fit(matrix_of(batch.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(beta), pa.array(s2)], names=[*keep, "beta", "s2"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.select(*keep).schema)
    return panel.select(*keep, values).mapInArrow(run, f"{types}, beta double, s2 double")


def residual_panel(panel: DataFrame, design: Design, values: str = "m", project: bool = True, name: str = "resid") -> DataFrame:
    """The panel with each probe's residual profile."""
    keep = panel.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = np.ascontiguousarray(design.residuals(matrix_of(batch.column(keep.index(values))), project))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, r.shape[1], dtype=np.int32)), pa.array(r.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*keep, name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema)
    return panel.mapInArrow(run, f"{types}, `{name}` array<double>")


def prior_of(n: int, mean_log: float, var_log: float, df: float) -> tuple[float, float] | None:
    """(d0, s0^2) of the scaled inverse chi-square prior by moments; None leaves variances as they are (fewer than 100)."""
    if n < 100:
        return None
    e = mean_log - special.digamma(df / 2) + math.log(df / 2)
    target = var_log - special.trigamma(df / 2)
    if target <= 0:
        return math.inf, math.exp(e)
    d0 = 2 * special.trigamma_inverse(target)
    return d0, math.exp(e + special.digamma(d0 / 2) - math.log(d0 / 2))


def prior_from(fits: DataFrame, df: float, s2: str = "s2") -> tuple[float, float] | None:
    """The prior of a table of variances: two moments of their logarithms reach the driver."""
    log = F.log(F.col(s2))
    row = fits.where((F.col(s2) > 0) & (F.col(s2) != float("inf"))).agg(F.count("*").alias("n"), F.avg(log).alias("m"), F.var_samp(log).alias("v")).first()
    return prior_of(row["n"], row["m"], row["v"], df) if row["n"] >= 100 else None


def moderate(fits: DataFrame, df: float, s2: str = "s2", name: str = "s2_post") -> DataFrame:
    """Empirical-Bayes variances under :func:`prior_from`; as they are where there are too few."""
    return drawn_to(fits, prior_from(fits, df, s2), df, s2, name)


def drawn_to(fits: DataFrame, prior: tuple[float, float] | None, df: float, s2: str = "s2", name: str = "s2_post") -> DataFrame:
    if prior is None:
        return fits.withColumn(name, F.col(s2))
    d0, s0 = prior
    return fits.withColumn(name, F.lit(s0) if math.isinf(d0) else (F.lit(d0 * s0) + df * F.col(s2)) / (d0 + df))


#: Shares of log variances pulled in at the low and the high end by the robust prior; a prior degree of freedom taken as infinite.
TAILS, ENDLESS = (0.05, 0.1), 1e6


def robust_prior(n: int, mean: float, var: float, df: float) -> tuple[float, float]:
    """(d0, s0^2) from the winsorised mean and variance of log variances (Phipson and others, 2016)."""

    def excess(d0: float) -> float:
        return var - special.winsorised_log_f(df, d0, TAILS)[1]

    if excess(ENDLESS) <= 0:
        d0 = math.inf
    else:
        lo, hi = math.log(1e-2), math.log(ENDLESS)  # the variance falls as d0 grows
        for _ in range(45):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if excess(math.exp(mid)) < 0 else (lo, mid)
        d0 = math.exp((lo + hi) / 2)
    return d0, math.exp(mean - special.winsorised_log_f(df, min(d0, ENDLESS), TAILS)[0])


def moderate_robust(fits: DataFrame, df: float, s2: str = "s2", name: str = "s2_post") -> DataFrame:
    """``moderate`` with a prior that probes of outlying variance neither shape nor are drawn to.

    ``df_prior`` is each row's prior degrees of freedom: that of the winsorised fit, and less the surer a variance
    is an outlier, which is the false discovery rate of its upper tail (running minima of tail times rows over rank).
    Fewer than 100 variances: as they are, with ``df_prior`` 0.  Quantiles and moments reach the driver.
    """
    from panelforge.operators.inference import bh

    log = F.log(F.col(s2))
    ok = fits.where((F.col(s2) > 0) & (F.col(s2) != float("inf")))
    n = ok.count()
    if n < 100:
        return fits.withColumn("df_prior", F.lit(0.0)).withColumn(name, F.col(s2))
    q = quantiles.quantiles(ok.select(log.alias("log")), "log", [TAILS[0], 1 - TAILS[1]])
    drawn = F.least(F.greatest(log, F.lit(q[0])), F.lit(q[1]))
    mean, var, top = ok.agg(F.avg(drawn), F.var_samp(drawn), F.max(s2)).first()
    d0, s0 = robust_prior(n, mean, var, df)
    finite = min(d0, ENDLESS)

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return pd.Series(special.f_upper(v.to_numpy(float) / s0, df, finite))

    greatest = float(special.f_upper(top / s0, df, finite)[0])
    pooled = n * df
    outlier = 0.0
    if math.isfinite(d0) and greatest > 0:
        outlier = d0 * math.log(0.5) / math.log(min(greatest, 0.5))
        again = float(special.f_upper(top / s0, df, outlier)[0])
        outlier *= math.log(0.5) / math.log(min(again, 0.5))
    # equal p share a rate: rows are joined by p, so a copy of the column stays as it is
    rated = bh(fits.withColumn("__tail", F.when(F.col(s2) > 0, tail(F.col(s2))).otherwise(F.lit(1.0))), "__tail", "__same")
    usual = d0 if math.isfinite(d0) else pooled
    rated = rated.withColumn("df_prior", F.when(F.col("__same") < 1, F.col("__same") * usual + (1 - F.col("__same")) * outlier).otherwise(F.lit(usual)))
    post = (F.col("df_prior") * s0 + df * F.col(s2)) / (F.col("df_prior") + df)
    return rated.withColumn(name, F.when(F.lit(math.isinf(d0)) & (F.col("__same") >= 1), F.lit(s0)).otherwise(post)).drop("__tail", "__same")


def sample_weights(panel: DataFrame, exposure: list[float], covariates=None, values: str = "m", rounds: int = 20, tolerance: float = 1e-3) -> np.ndarray:
    """Relative precision of each sample, geometric mean 1: the REML estimate for one variance a probe over one weight a sample.

    At the fixed point a sample's weighted squared residuals, each over its probe's variance, add up to what its
    leverage leaves.  Each round is one pass that sums one number a sample; samples that the design fits exactly keep 1.
    """
    x = np.column_stack([np.ones(len(exposure)), exposure, *([np.asarray(covariates, float)] if covariates is not None else [])])
    n, w = len(x), np.ones(len(x))
    for _ in range(rounds):
        root = np.sqrt(w)
        basis, r = np.linalg.qr(x * root[:, None])
        basis = basis[:, np.abs(np.diag(r)) > 1e-9 * np.abs(np.diag(r)).max()]
        left, df = 1 - (basis**2).sum(axis=1), n - basis.shape[1]

        def run(batches: Iterator[pa.RecordBatch], root=root, basis=basis, df=df) -> Iterator[pa.RecordBatch]:
            total, rows = np.zeros(n), 0
            for batch in batches:
                if batch.num_rows:
                    m = matrix_of(batch.column(0)) * root
                    e = (m - m @ basis @ basis.T) ** 2
                    s2 = e.sum(axis=1) / df
                    good = np.isfinite(s2) & (s2 > 0)
                    total += (e[good] / s2[good, None]).sum(axis=0)
                    rows += int(good.sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total), pa.array([rows] * n, pa.int64())], names=["sample", "total", "rows"])

        sums = panel.select(values).mapInArrow(run, "sample int, total double, rows long").groupBy("sample").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect()
        ratio = np.ones(n)
        for k in sums:
            if k["rows"] and left[k["sample"]] > 1e-9:
                ratio[k["sample"]] = max(k["total"] / (k["rows"] * left[k["sample"]]), 1e-12)
        w = w / ratio
        w = w / np.exp(np.log(w).mean())
        if np.abs(np.log(ratio)).max() < tolerance:
            break
    return w


def moderate_array(s2: np.ndarray, df: float) -> np.ndarray:
    """The same for a replicate's variances inside a task."""
    ok = s2[np.isfinite(s2) & (s2 > 0)]
    prior = prior_of(len(ok), float(np.log(ok).mean()), float(np.log(ok).var(ddof=1)), df) if len(ok) >= 100 else None
    if prior is None:
        return s2
    d0, s0 = prior
    return np.full_like(s2, s0) if math.isinf(d0) else (d0 * s0 + df * s2) / (d0 + df)


def with_z(fits: DataFrame, unit: float, variance: str = "s2_post") -> DataFrame:
    """``se`` and ``z`` from a variance column and (X'X)^-1 of the exposure."""
    se = F.sqrt(F.col(variance) * F.lit(unit))
    return fits.withColumn("se", se).withColumn("z", F.when(F.col("se") > 0, F.col("beta") / F.col("se")).otherwise(0.0))


class BlockREML:
    """Within-subject correlation of many probes by REML: y = X b + u(subject) + e, e with variance over the sample's weight.

    The design is projected out and the subjects' part rotated to its eigenvectors once; in these coordinates a probe's values are
    independent with variances s2 (1 + lambda d), so its likelihood is a function of lambda alone.
    """

    def __init__(self, subject: list, other: np.ndarray, weights=None):
        root = np.ones(len(subject)) if weights is None else np.sqrt(np.asarray(weights, float))
        levels, code = np.unique(np.asarray(subject, dtype=str), return_inverse=True)
        z = np.zeros((len(code), len(levels)))
        z[np.arange(len(code)), code] = root
        x = np.asarray(other, float) * root[:, None]
        u, s, _ = np.linalg.svd(x, full_matrices=True)
        left = u[:, int((s > 1e-9 * s.max()).sum()) :]  # an orthonormal basis of what the design leaves
        d, v = np.linalg.eigh(left.T @ z @ z.T @ left)
        self.d = np.maximum(d, 0.0)
        self.rotate = root[:, None] * (left @ v)
        most = np.bincount(code).max()
        self.least, self.most = (-1 / (most - 1) + 0.01 if most > 1 else 0.0), 0.99
        self.free = len(self.d)

    def _deviance(self, t2: np.ndarray, lam: np.ndarray) -> np.ndarray:
        """-2 log REML of each row at its own lambda, up to a constant."""
        scale = 1 + lam[:, None] * self.d
        return self.free * np.log(np.maximum((t2 / scale).sum(axis=1), 1e-300)) + np.log(scale).sum(axis=1)

    def of(self, m: np.ndarray, steps: int = 48) -> np.ndarray:
        """The correlation lambda / (1 + lambda) of each row: the best of a grid, then golden sections around it."""
        t2 = (m @ self.rotate) ** 2
        edge = -0.999 / self.d.max()  # variances stay positive: lambda > -1 / d
        low = max(self.least, edge / (1 + edge)) if edge > -1 else self.least
        grid = np.linspace(low, self.most, 60)
        dev = np.stack([self._deviance(t2, np.full(len(t2), r / (1 - r))) for r in grid], axis=1)
        k = dev.argmin(axis=1)
        a, b = grid[np.maximum(k - 1, 0)], grid[np.minimum(k + 1, len(grid) - 1)]
        g = (math.sqrt(5) - 1) / 2
        for _ in range(steps):
            p, q = b - g * (b - a), a + g * (b - a)
            left = self._deviance(t2, p / (1 - p)) < self._deviance(t2, q / (1 - q))
            a, b = np.where(left, a, p), np.where(left, q, b)
        return np.where(t2.sum(axis=1) > 0, (a + b) / 2, np.nan)


def consensus_correlation(panel: DataFrame, subject: list, values: str = "m", trim: float = 0.15, exposure: list[float] | None = None, covariates=None, weights=None) -> float:
    """Consensus within-subject correlation: every probe's REML estimate beside the design, trimmed mean of atanh.

    The design is an intercept, the exposure and the covariates (array indicators among them); ``weights``: precision of each
    sample.  Estimates are exact to 1e-8; quantiles and one mean reach the driver.  0 where no sample shares its subject.
    """
    parts = [np.ones(len(subject)), *([exposure] if exposure is not None else []), *([np.asarray(covariates, float)] if covariates is not None and np.size(covariates) else [])]
    reml = BlockREML(subject, np.column_stack(parts), weights)
    if reml.free < 2 or np.ptp(reml.d) < 1e-9:  # every direction alike: nothing tells subjects from noise
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                r = reml.of(matrix_of(batch.column(0).slice(at, 2048)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arctanh(np.clip(r, -0.99, 0.99)))], names=["a"])

    a = settled(panel.select(values).mapInArrow(run, "a double"))
    mean = quantiles.trimmed_mean(a, "a", trim)
    return 0.0 if mean is None else math.tanh(mean)


def fit_gls(panel: DataFrame, exposure: list[float], subject: list, covariates=None, rho: float | None = None, values: str = "m", keep: tuple[str, ...] = ("probe", "chr", "pos"), weights=None, robust: bool = False) -> DataFrame:
    """GLS with a compound-symmetric correlation within subjects: ``beta, se, t, p``, ``s2`` (as fitted) with moderated variances.

    ``covariates``: samples by columns, an array's indicators among them.  ``weights``: precision of each sample.
    ``robust``: the prior of ``moderate_robust``.  p takes residual and prior degrees of freedom together (at most those of all rows).
    ValueError where the other columns hold the exposure.

    Design and data are whitened by one Cholesky factor; the other columns are projected out, so a block of rows is one product.
    """
    from panelforge.operators import pooled

    rho = consensus_correlation(panel, subject, values, exposure=exposure, covariates=covariates, weights=weights) if rho is None else rho
    same = np.asarray(subject, dtype=str)
    v = np.where(same[:, None] == same[None, :], rho, 0.0)
    np.fill_diagonal(v, 1.0)
    if weights is not None:
        root = np.sqrt(np.asarray(weights, float))
        v = v / np.outer(root, root)
    white = np.linalg.inv(np.linalg.cholesky(v))
    slopes = pooled.Slopes(white @ np.asarray(exposure, float), white @ pooled.others(len(exposure), covariates))
    if not slopes.known[0] or slopes.df <= 0:
        raise ValueError("the exposure is not identified beside the other columns")
    df = slopes.df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mw = matrix_of(batch.column(len(keep))) @ white.T
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(slopes.of(mw)[:, 0]), pa.array(slopes.variance(mw))], names=[*keep, "beta", "s2"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.select(*keep).schema)
    fits = settled(panel.select(*keep, values).mapInArrow(run, f"{types}, beta double, s2 double"))
    if robust:
        post = moderate_robust(fits, df)
    else:
        prior = prior_from(fits, df)
        post = drawn_to(fits, prior, df).withColumn("df_prior", F.lit(float(prior[0]) if prior else 0.0))
    most = float(df) * fits.count()
    done = with_z(post, float(slopes.unit[0])).withColumnRenamed("z", "t").withColumn("__df", F.least(F.lit(float(df)) + F.col("df_prior"), F.lit(most)))

    @F.pandas_udf("double")
    def tail(t: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series(special.t_two_sided_array(t.to_numpy(float), free.to_numpy(float)))

    return done.withColumn("p", tail("t", "__df")).select(*keep, "beta", "se", "t", "p", "s2")
