"""Resampling and multiplicity: folds, permutations, nulls, FWER, stability, FDR, intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import hashing, kernels
from panelforge.functions.session import settled
from panelforge.operators import genome, scan, within


def folds(subjects: DataFrame, n_folds: int, seed: int = 0, subject: str = "subject") -> DataFrame:
    """``subject, fold``: subjects by (FNV-1a of "seed:id", id) in contiguous folds whose sizes differ by one at most.

    Ranks are taken in ranges of the hash, and the ranges' counts (1,024 at most) say where each begins: no window holds all subjects.
    """
    s = subjects.select(F.col(subject).cast("string").alias("subject")).where("subject is not null").distinct()
    s = settled(s.withColumn("__h", hashing.fnv1a(F.concat(F.lit(f"{seed}:"), "subject"))).withColumn("__r", F.shiftright("__h", 22)))
    sizes = s.groupBy("__r").agg(F.count("*").alias("__n"))
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__r", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__b"), F.sum("__n").over(total).alias("__m"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy("__h", "subject")) - 1 + F.col("__b")
    small, more = F.floor(F.col("__m") / n_folds), F.col("__m") % n_folds  # the first ``more`` folds have one subject more
    fold = F.when(rank < more * (small + 1), F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return s.join(F.broadcast(base), "__r").select("subject", fold.cast("int").alias("fold"))


def permute(df: DataFrame, rep: int | str, seed: int, within_subject: bool = True, sample: str = "sample", subject: str = "subject", exposure: str = "exposure", name: str = "permuted") -> DataFrame:
    """Exposure dealt anew among a subject's own samples (or all samples), by hash order: the same under any partitioning.

    ``rep`` is a number or the name of a replicate column.  Without subjects rows
    are ranked in ranges of a hash with the ranges' offsets, not in one window.
    """
    by = [subject] if within_subject else []
    key = F.lit(rep) if isinstance(rep, int) else F.col(rep)
    if isinstance(rep, str):
        by = [rep, *by]
    dealt = hashing.order_key(seed, key, F.col(sample))
    if within_subject:
        d = df.withColumn("__to", F.row_number().over(Window.partitionBy(*by).orderBy(sample))).withColumn("__from", F.row_number().over(Window.partitionBy(*by).orderBy(dealt, sample)))
    else:
        d = _ranked(_ranked(df, by, hashing.order_key(seed, F.lit("place"), F.col(sample)), sample, "__to"), by, dealt, sample, "__from")
    given = d.select(*by, F.col("__from").alias("__to"), F.col(exposure).alias(name))
    return d.drop("__from").join(given, [*by, "__to"]).drop("__to")


def _ranked(df: DataFrame, by: list[str], hashed, sample: str, name: str) -> DataFrame:
    """``df`` with row numbers from 1 by (hash, sample) inside each group of ``by``: ranges of the hash are numbered apart and shifted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("__key", hashed).withColumn("__range", F.floor(hashing.unit(F.col("__key")) * parts))
    sizes = d.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    shift = sizes.withColumn("__shift", F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    w = Window.partitionBy(*by, "__range").orderBy("__key", sample)
    return d.withColumn(name, F.row_number().over(w)).join(F.broadcast(shift), [*by, "__range"]).withColumn(name, F.col(name) + F.col("__shift")).drop("__key", "__range", "__shift")  # a row a range


def permuted_exposures(sheet: list[tuple[int, float, str]], rep: int, seed: int, within_subject: bool = True) -> np.ndarray:
    """The same for one replicate of a small design held in memory."""
    x = np.array([e for _, e, _ in sheet], float)
    rng = np.random.Generator(np.random.PCG64([seed, rep]))
    if not within_subject:
        return rng.permutation(x)
    s = np.array([str(v[0]) for v in sheet])
    out = x.copy()
    for k in np.unique(s):
        at = np.flatnonzero(s == k)
        out[at] = x[rng.permutation(at)]
    return out


def subsample(subjects: DataFrame, reps: int, frac: float = 0.5, seed: int = 1, subject: str = "subject") -> DataFrame:
    """``rep, subject``: max(2, floor(frac * n)) subjects of each replicate, without replacement."""
    s = subjects.select(F.col(subject).alias("subject")).distinct()
    k = max(2, math.floor(frac * s.count()))
    r = s.crossJoin(F.broadcast(s.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep"))))  # reps is a parameter
    w = Window.partitionBy("rep").orderBy(hashing.order_key(seed, "rep", "subject"), "subject")
    return r.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).select("rep", "subject")


def fwer(regions: DataFrame, null: DataFrame, z: str = "z", statistic: str = "max_abs_z", name: str = "p_fwer") -> DataFrame:
    """``p = (1 + #{null >= |z|}) / (1 + B)`` and its Monte-Carlo standard error (0 when B = 0).

    The null has one number a replicate; it is sorted into one array.
    """
    n = null.select(F.col(statistic).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("__null"))
    d = regions.crossJoin(F.broadcast(n))  # one row of B numbers
    b = F.size("__null")
    hits = F.size(F.filter("__null", lambda x: x >= F.abs(F.col(z))))
    p = (1 + hits) / (1 + b)
    return d.withColumn(name, p).withColumn(f"{name}_mcse", F.when(b > 0, F.sqrt(F.col(name) * (1 - F.col(name)) / b)).otherwise(0.0)).drop("__null")


def borderline(df: DataFrame, name: str = "p_fwer", level: float = 0.05):
    """How many p lie within two of their standard errors of ``level``, those equal to it included."""
    p, e = F.col(name), F.col(f"{name}_mcse")
    return df.agg(F.sum(((p - 2 * e < level) & (p + 2 * e > level)).cast("long")).alias("borderline"))


def bh(df: DataFrame, p: str = "p", name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p, without a window over all rows.

    Equal p share an adjusted p, so distinct values with their counts are enough;
    cumulative counts and reverse running minima are taken in ranges of p and
    joined by one row a range.  A null or NaN p is no test and gets none back.
    """
    spark = df.sparkSession
    g = df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = g.agg(F.percentile_approx("__p", [k / parts for k in range(1, parts)], 10000).alias("q")).first()["q"] if parts > 1 else []
    g = g.withColumn("__r", hashing.rising_range(F.col("__p"), sorted(set(bounds or []))))
    w, falling = (Window.partitionBy("__r").orderBy(o) for o in (F.asc("__p"), F.desc("__p")))
    g = g.withColumn("__k", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = g.groupBy("__r").agg(F.sum("__n").alias("__s"))
    base = sizes.withColumn("__b", F.sum("__s").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")).crossJoin(sizes.agg(F.sum("__s").alias("__m"))).select("__r", "__b", "__m")
    g = g.join(F.broadcast(base), "__r").withColumn("__raw", F.col("__p") * F.col("__m") / (F.col("__k") + F.col("__b")))
    low = g.groupBy("__r").agg(F.min("__raw").alias("__l"))
    later = low.withColumn("__next", F.min("__l").over(Window.orderBy("__r").rowsBetween(1, Window.unboundedFollowing))).select("__r", "__next")
    g = g.join(F.broadcast(later), "__r").withColumn(name, F.least(F.lit(1.0), F.coalesce("__next", F.lit(1.0)), F.min("__raw").over(falling.rowsBetween(Window.unboundedPreceding, 0))))
    return df.join(g.select(F.col("__p").alias(p), name), p, "left")


def correlation_interval(r, n, z: float = 1.959963984540054):
    """(low, high) of Fisher's interval as columns; null unless n > 3."""
    half = z / F.sqrt(n - 3)
    return tuple(F.when((n > 3) & (F.abs(r) < 1), F.tanh(F.atanh(r) + s * half)) for s in (-1, 1))


def wilson_interval(p, n, z: float = 1.959963984540054):
    """(low, high) of Wilson's interval as columns; null unless n > 0."""
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


# replicates over (replicate, chromosome) groups ---------------------------------------


def weights(se: np.ndarray) -> np.ndarray:
    """1 / se^2; 0 without a positive standard error."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(se > 0, 1 / se**2, 0.0)


def tracks(fits: DataFrame, lam0: float, decay: float = 1000.0, by: tuple[str, ...] = ("chr",), lam_col: str | None = None) -> DataFrame:
    """``theta`` of every probe: the penalised track of each (replicate, chromosome).

    ``fits``: probe, pos, beta, se and the group columns.  A group is one
    chromosome of one replicate.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fits.schema) + ", theta double, w double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "probe"], kind="stable")
        w = weights(pdf["se"].to_numpy(float))
        lam = kernels.penalty(pdf["pos"].to_numpy(float), float(pdf[lam_col].iloc[0]) if lam_col else lam0, decay, w)
        pdf["theta"] = kernels.tv_denoise(pdf["beta"].to_numpy(float), w, lam)
        pdf["w"] = w
        return pdf

    return fits.groupBy(*by).applyInPandas(run, types)


#: Rows of a piece of a track, and how close both bounds must be.
TRACK_ROWS, AGREE = 200_000, 1e-9


def tracks_in_pieces(fits: DataFrame, lam0: float, decay: float = 1000.0, by: tuple[str, ...] = ("chr",), rows: int = TRACK_ROWS, cuts: DataFrame | None = None) -> DataFrame:
    """``tracks`` of chromosomes of any size: the same values, many tasks a chromosome.

    A piece is solved together with its neighbours under both extreme pulls from beyond; where the bounds agree they are
    the whole chromosome's solution.  Pieces that are not settled like that are solved again between more neighbours, twice as many
    each time, until they are or nothing lies beyond.  Segments are then averaged over the whole chromosome.
    """
    chrom = by[-1]
    cuts = scan.cut_points(fits, rows, chrom) if cuts is None else cuts
    if cuts is None:
        return tracks(fits, lam0, decay, by)
    w = F.when(F.col("se") > 0, 1 / (F.col("se") * F.col("se"))).otherwise(0.0)
    d = scan.pieced(fits.withColumn("w", w), cuts, chrom)
    scale = d.where("w > 0").groupBy(*by).agg((F.percentile("w", 0.5) * lam0).alias("__lam"))  # a row a replicate and chromosome
    last = d.groupBy(*by).agg(F.max(scan.PIECE).alias("__pieces"))
    few = last.join(scale, list(by), "left").withColumn("__lam", F.coalesce("__lam", F.lit(float(lam0))))
    d = settled(d.join(F.broadcast(few), list(by)))
    fields = [f for f in d.schema.fields]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "probe"], kind="stable")
        y, wt, pos, lam = pdf["beta"].to_numpy(float), pdf["w"].to_numpy(float), pdf["pos"].to_numpy(float), float(pdf["__lam"].iloc[0])
        edges = lam * np.exp(-np.diff(pos) / decay)
        ends = (lam if pdf[scan.PIECE].min() > 0 else 0.0, lam if pdf[scan.PIECE].max() < pdf["__pieces"].iloc[0] else 0.0)
        lower, upper = kernels.tv_bracket(y, wt, edges, ends)
        core = (pdf[scan.PIECE] == pdf["__core"]).to_numpy()
        sure = bool((upper - lower <= AGREE * np.maximum(1.0, np.abs(upper)))[core].all())
        out = pdf[core].drop(columns="__core")
        return out.assign(theta=((lower + upper) / 2)[core], __sure=sure)

    done, halo, open_ = None, 1, None
    while True:
        near = F.sequence(F.greatest(F.col(scan.PIECE) - halo, F.lit(0)), F.least(F.col(scan.PIECE) + halo, F.col("__pieces")))
        spread = d.withColumn("__core", F.explode(near))
        if open_ is not None:
            spread = spread.join(F.broadcast(open_), [*by, "__core"], "left_semi")
        found = settled(spread.groupBy(*by, "__core").applyInPandas(solve, f"{types}, theta double, __sure boolean"))
        part = found.where("__sure").drop("__sure")
        done = part if done is None else done.unionByName(part)
        open_ = settled(found.where("not __sure").select(*by, F.col(scan.PIECE).alias("__core")).distinct())  # a row a piece at most
        if open_.limit(1).count() == 0:
            break
        halo *= 2
    plain = done.drop("__lam", "__pieces")
    order = ("pos", "probe")
    t = scan.with_previous(plain, {"__level": F.col("theta")}, by, order, False)
    new = F.coalesce(F.abs(F.col("theta") - F.col("__level")) > 10 * AGREE, F.lit(True)).cast("int")
    t = scan.with_running(t.withColumn("__new", new), {"__segment": F.col("__new")}, by, order, False)
    level = t.groupBy(*by, "__segment").agg(F.sum("w").alias("__sw"), F.sum(F.col("w") * F.col("beta")).alias("__swb"), F.avg("theta").alias("__mean"))
    t = t.join(level, [*by, "__segment"]).withColumn("theta", F.when(F.col("__sw") > 0, F.col("__swb") / F.col("__sw")).otherwise(F.col("__mean")))
    return t.select(*fits.columns, "theta", "w")


class Replicates:
    """Within-subject fits of many replicates that share the subjects: permuted exposures, or subsets of whole subjects.

    A design is demeaned inside its subjects and is 0 outside its samples, so one product of a block of rows with all designs
    side by side gives every replicate's cross products; squares are summed over each replicate's samples by another.
    """

    def __init__(self, subject: list, designs: list[tuple[int, within.Design, np.ndarray | None]]):
        n = len(subject)
        _, self.code = np.unique(np.asarray(subject, dtype=str), return_inverse=True)
        self.mean = np.zeros((int(self.code.max()) + 1, n))
        self.mean[self.code, np.arange(n)] = 1 / np.bincount(self.code)[self.code]
        usable = [(r, d, np.arange(n) if at is None else np.asarray(at)) for r, d, at in designs if d is not None and d.identified and d.df > 0]
        self.reps = [r for r, _, _ in usable]
        k = max((d.xw.shape[1] for _, d, _ in usable), default=1)
        self.x, self.inverse, self.inside = np.zeros((n, len(usable), k)), np.zeros((len(usable), k, k)), np.zeros((n, len(usable)))
        for j, (_, d, at) in enumerate(usable):
            own = d.xw.shape[1]
            self.x[at, j, :own], self.inverse[j, :own, :own], self.inside[at, j] = d.xw, d.inverse, 1.0
        self.df, self.unit = np.array([d.df for _, d, _ in usable], float), np.array([d.unit for _, d, _ in usable])

    def fit(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exposure's slopes, residual variances): one column a replicate."""
        mw = m - (m @ self.mean.T)[:, self.code]
        n, reps, k = self.x.shape
        cross = (mw @ self.x.reshape(n, reps * k)).reshape(len(m), reps, k)
        b = np.einsum("irk,rkl->irl", cross, self.inverse) if k > 1 else cross * self.inverse[None, :, :, 0]
        rss = (mw * mw) @ self.inside - (cross * b).sum(axis=2)
        return b[:, :, 0], np.maximum(rss, 0) / self.df

    def priors(self, panel: DataFrame, values: str = "m") -> tuple[np.ndarray, np.ndarray]:
        """(d0, s0^2) of every replicate from a pass that returns a few sums a partition and replicate; 0 and 0 where there are too few probes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(self.reps)))
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    s2 = self.fit(within.matrix_of(batch.column(0).slice(at, 1024)))[1]
                    ok = np.isfinite(s2) & (s2 > 0)
                    log = np.log(np.where(ok, s2, 1.0))
                    total += np.stack([ok.sum(axis=0), log.sum(axis=0), (log * log).sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(self.reps)), pa.int32()), *(pa.array(t) for t in total)], names=["j", "n", "s", "q"])

        d0, s0 = np.zeros(len(self.reps)), np.zeros(len(self.reps))
        for r in panel.select(values).mapInArrow(run, "j int, n double, s double, q double").groupBy("j").agg(*(F.sum(c).alias(c) for c in "nsq")).collect():
            if r["n"] >= 2:
                mean = r["s"] / r["n"]
                d0[r["j"]], s0[r["j"]] = within.prior_of(int(r["n"]), mean, (r["q"] - r["n"] * mean * mean) / (r["n"] - 1), self.df[r["j"]]) or (0.0, 0.0)
        return d0, s0

    def errors(self, s2: np.ndarray, priors: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Standard errors from moderated variances (as they are without ``priors``)."""
        if priors is not None:
            d0, s0 = priors
            endless = np.isinf(d0)
            some = np.where(endless, 0.0, d0)
            s2 = np.where(endless, s0, (some * s0 + self.df * s2) / (some + self.df))
        return np.sqrt(s2 * self.unit)

    def estimates(self, panel: DataFrame, shrink: bool = True, chunk: int = 8, values: str = "m", priors: tuple | None = None) -> DataFrame:
        """``chunk, probe, chr, pos, beta, se``: arrays of the slopes and errors of ``chunk`` replicates, a row a probe and chunk.

        Two passes over the panel where variances are moderated: no fit is kept between them.
        """
        if priors is None and shrink and self.reps:
            priors = self.priors(panel, values)
        reps = len(self.reps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    beta, s2 = self.fit(within.matrix_of(part.column(3)))
                    se = self.errors(s2, priors)
                    for c in range(0, reps, chunk):
                        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(own.ravel())) for own in (np.ascontiguousarray(x[:, c : c + chunk]) for x in (beta, se))]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, c // chunk, np.int32)), *part.columns[:3], *lists], names=["chunk", "probe", "chr", "pos", "beta", "se"])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.select("probe", "chr", "pos").schema)
        return panel.select("probe", "chr", "pos", values).mapInArrow(run, f"chunk int, {types}, beta array<double>, se array<double>")

    def regions(self, panel: DataFrame, lam0: float, decay: float, min_probes: int, min_effect: float, shrink: bool = True, chunk: int = 8, rows: int = scan.ROWS) -> DataFrame:
        """``rep, chr, start, end, effect, z`` of every replicate's regions, without cluster keys.

        A group is a chromosome of ``chunk`` replicates: its positions travel and are sorted once for all of them.
        Chromosomes of more than ``rows`` probes go through pieces, replicate by replicate.
        """
        kind, reps = dict(panel.dtypes)["chr"], list(self.reps)
        cuts = scan.cut_points(panel.select("chr", "pos"), rows)
        priors = self.priors(panel) if shrink and reps else None
        large = None
        if cuts is not None:
            named = F.broadcast(cuts.select(F.col("__chr").alias("chr")))
            each = self.estimates(panel.join(named, "chr", "left_semi"), shrink, chunk, priors=priors)
            both = F.posexplode(F.arrays_zip("beta", "se")).alias("k", "v")
            numbers = F.array(*map(F.lit, reps))
            fits = each.select("chunk", "probe", "chr", "pos", both).select(F.get(numbers, F.col("chunk") * chunk + F.col("k")).cast("int").alias("rep"), "chr", "probe", "pos", "v.beta", "v.se")
            t = tracks_in_pieces(fits, lam0, decay, ("rep", "chr"), rows, cuts)
            t = t.withColumn("sw", F.col("w")).withColumn("swb", F.col("w") * F.col("beta"))
            large = genome.call_regions(t, min_probes, min_effect, by=("rep", "chr"), ties=("probe",), cuts=cuts).select("rep", "chr", "start", "end", "effect", "z")
            panel = panel.join(named, "chr", "left_anti")

        def found(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["pos", "probe"], kind="stable")
            pos, first = pdf["pos"].to_numpy(), int(pdf["chunk"].iloc[0]) * chunk
            betas, ses = np.stack(pdf["beta"].to_numpy()), np.stack(pdf["se"].to_numpy())
            out = []
            for j in range(betas.shape[1]):
                beta, w = betas[:, j], weights(ses[:, j])
                theta = kernels.tv_denoise(beta, w, kernels.penalty(pos.astype(float), lam0, decay, w))
                start, end, effect, z = kernels.segments(theta, beta, w, min_probes, min_effect)
                out.append(pd.DataFrame({"rep": reps[first + j], "start": pos[start], "end": pos[end], "effect": effect, "z": z}))
            out = pd.concat(out)
            out.insert(1, "chr", pdf["chr"].iloc[0])
            return out

        small = self.estimates(panel, shrink, chunk, priors=priors).groupBy("chr", "chunk").applyInPandas(found, f"rep int, chr {kind}, start long, end long, effect double, z double")
        return small if large is None else small.unionByName(large)


def region_null(panel: DataFrame, sheet: list[tuple], n_perm: int, lam0: float, *, covariates=None, scheme: str = "within", seed: int = 1, decay: float = 1000.0, min_probes: int = 3, min_effect: float = 0.05, shrink: bool = True) -> DataFrame:
    """``rep, max_abs_z`` of permuted exposures; 0 where a replicate has no region."""
    spark = panel.sparkSession
    subject = [s for s, _, _ in sheet]
    if n_perm == 0:
        return spark.createDataFrame([], "rep int, max_abs_z double")
    reps = Replicates(subject, [(k, within.Design(permuted_exposures(sheet, k, seed, scheme == "within"), subject, covariates), None) for k in range(n_perm)])
    top = reps.regions(panel, lam0, decay, min_probes, min_effect, shrink).groupBy("rep").agg(F.max(F.abs("z")).alias("m"))
    return spark.range(n_perm).select(F.col("id").cast("int").alias("rep")).join(top, "rep", "left").select("rep", F.coalesce("m", F.lit(0.0)).alias("max_abs_z"))


def stability(panel: DataFrame, sheet: list[tuple], regions: DataFrame, n_boot: int, lam0: float, *, covariates=None, frac: float = 0.5, seed: int = 1, decay: float = 1000.0, min_probes: int = 3, min_effect: float = 0.05, region_id: str = "region") -> DataFrame:
    """``regions`` with ``stability``: the share of subject subsamples that find an overlapping region.

    Subsamples of fewer than three subjects or without freedom find nothing but count.
    """
    if n_boot == 0:
        return regions.withColumn("stability", F.lit(None).cast("double"))
    subjects = sorted({s for s, _, _ in sheet})
    k = max(2, math.floor(frac * len(subjects)))
    reps = []
    for b in range(n_boot):
        own = set(np.random.Generator(np.random.PCG64([seed, b])).choice(subjects, k, replace=False).tolist())
        at = np.array([i for i, s in enumerate(sheet) if s[0] in own])
        reps.append((b, within.Design([sheet[i][1] for i in at], [sheet[i][0] for i in at], within.rows_of(covariates, at)) if k >= 3 else None, at))
    replicates = Replicates([s for s, _, _ in sheet], reps)
    found = replicates.regions(panel, lam0, decay, min_probes, min_effect).select("chr", F.col("rep").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    mine = regions.select("chr", F.col(region_id).alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    hits = genome.interval_overlap(mine, found).groupBy("a_id").agg(F.countDistinct("b_id").alias("__hits")).withColumnRenamed("a_id", region_id)
    return regions.join(hits, region_id, "left").withColumn("stability", F.coalesce(F.col("__hits"), F.lit(0)) / n_boot).drop("__hits")


def cv_lambda(panel: DataFrame, sheet: list[tuple], grid: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0), n_folds: int = 5, seed: int = 1, decay: float = 1000.0, covariates=None) -> DataFrame:
    """``lam0, wsse, n, score``: held-out subjects' weighted error of each smoothness.

    Fits of a fold do not depend on the smoothness and are made once; folds with
    fewer than two test or four training subjects, or without freedom, are skipped.
    """
    spark = panel.sparkSession
    subjects = spark.createDataFrame([(str(s),) for s in sorted({s for s, _, _ in sheet})], "subject string")
    of = {r["subject"]: r["fold"] for r in folds(subjects, n_folds, seed).collect()}
    reps = []
    for f in sorted(set(of.values())):
        test = np.array([i for i, s in enumerate(sheet) if of[str(s[0])] == f])
        train = np.array([i for i, s in enumerate(sheet) if of[str(s[0])] != f])
        sizes = [len({sheet[i][0] for i in part}) for part in (test, train)]
        both = [within.Design([sheet[i][1] for i in part], [sheet[i][0] for i in part], within.rows_of(covariates, part)) for part in (test, train)] if sizes[0] >= 2 and sizes[1] >= 4 else []
        if both and all(d.identified and d.df > 0 for d in both):
            reps += [(2 * f + side, d, part) for side, (part, d) in enumerate(zip((test, train), both))]
    if not reps:
        raise ValueError("no fold can be fitted")
    replicates = Replicates([s for s, _, _ in sheet], reps)
    lams = [float(v) for v in grid]

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        """Held-out error of one fold's chromosome under every smoothness: its fits come once."""
        pdf = pdf.sort_values(["pos", "probe"], kind="stable")
        betas, ses, pos = np.stack(pdf["beta"].to_numpy()), np.stack(pdf["se"].to_numpy()), pdf["pos"].to_numpy(float)
        wt, w = weights(ses[:, 0]), weights(ses[:, 1])
        rows = []
        for v in lams:
            theta = kernels.tv_denoise(betas[:, 1], w, kernels.penalty(pos, v, decay, w))
            rows.append((v, float(np.nansum(wt * (betas[:, 0] - theta) ** 2)), int((wt > 0).sum())))
        return pd.DataFrame(rows, columns=["lam0", "wsse", "n"])

    # a chunk is a fold: its test fit, then its training fit
    parts = replicates.estimates(panel, chunk=2).groupBy("chunk", "chr").applyInPandas(errors, "lam0 double, wsse double, n long")
    g = parts.groupBy("lam0").agg(F.sum("wsse").alias("wsse"), F.sum("n").alias("n"))
    return g.withColumn("score", F.when(F.col("n") > 0, F.col("wsse") / F.col("n")))


def best_lambda(table: DataFrame) -> float:
    """The smoothness of the least score, the first of the grid on ties; ValueError when no score is finite."""
    row = table.where("score is not null and not isnan(score)").orderBy("score", "lam0").first()
    if row is None:
        raise ValueError("no smoothness has a finite score")
    return row["lam0"]
