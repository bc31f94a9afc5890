"""Differential regions end to end, and the fixed-threshold baselines."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import kernels
from panelforge.functions.session import settled
from panelforge.operators import genome, inference, pooled, quality_control, quantiles, scan, within


def find_regions(panel: DataFrame, sheet: list[tuple[int, float, str]], *, max_gap: float = 1000, rho_min: float = 0.30, lam: float | tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0), cv_folds: int = 5, decay: float = 1000.0, min_probes: int = 3, min_effect: float = 0.05, n_perm: int = 0, scheme: str = "within", n_boot: int = 0, seed: int = 1, covariates=None) -> tuple[DataFrame, dict]:
    """(regions, run record).

    Fit and moderate, cluster residuals, choose the smoothness (a grid is
    cross-validated over whole subjects, a number is used as it is), smooth each
    chromosome, call regions inside clusters; then, if asked for, permutation FWER
    (without cluster keys), stability, and each array's own effects (by prefix sums).  ``covariates``
    (samples by columns) stay in every fit; those that never vary within a subject go.  ``scheme``: the permutations are "within"
    subjects, "naive" over all samples, or "both": then ``p_fwer_within`` and ``p_fwer_naive`` stand beside ``p_fwer``, which is the
    former.  Chromosomes beyond a task's size are scanned in pieces.
    Rows come by rising p where there is one, then in genome order.
    """
    exposure, subject = [e for _, e, _ in sheet], [s for s, _, _ in sheet]
    design = within.Design(exposure, subject, covariates)
    cuts = scan.cut_points(panel.select("chr", "pos"))
    fits = within.with_z(within.moderate(settled(within.fit_panel(panel, design)), design.df), design.unit)
    lam0 = lam if isinstance(lam, (int, float)) else inference.best_lambda(inference.cv_lambda(panel, sheet, tuple(lam), cv_folds, seed, decay, covariates))
    clusters = genome.comethylation_clusters(within.residual_panel(panel, design), "resid", max_gap, rho_min, "chr", "pos", "probe", cuts=cuts).select("probe", "cluster")
    track = inference.tracks_in_pieces(fits.select("probe", "chr", "pos", "beta", "se"), lam0, decay, rows=scan.ROWS).join(clusters, "probe")
    track = track.withColumn("sw", F.col("w")).withColumn("swb", F.col("w") * F.col("beta"))
    regions = settled(genome.call_regions(track, min_probes, min_effect, cluster="cluster", ties=("probe",), cuts=cuts).withColumn("region", F.concat_ws(":", "chr", "start", "end")))
    record = {"lam0": lam0, "df": design.df, "n_subjects": design.subjects, "n_samples": len(sheet), "n_perm": n_perm, "n_boot": n_boot}
    asked = dict(covariates=covariates, seed=seed, decay=decay, min_probes=min_probes, min_effect=min_effect)
    if n_perm or n_boot:
        for k, name in enumerate(("within", "naive") if scheme == "both" else (scheme,)):
            null = settled(inference.region_null(panel, sheet, n_perm, lam0, scheme=name, **asked))
            record[f"null_q95_{name}"] = quantiles.quantiles(null, "max_abs_z", [0.95])[0]
            regions = inference.fwer(regions, null, name="p_fwer" if k == 0 else f"p_fwer_{name}")
            if scheme == "both" and k == 0:
                regions = regions.withColumns({"p_fwer_within": F.col("p_fwer"), "p_fwer_within_mcse": F.col("p_fwer_mcse")})
        regions = inference.stability(panel, sheet, regions, n_boot, lam0, **asked)
    arrays = sorted({a for _, _, a in sheet})
    probes = fits.count()
    for array in arrays:
        at = [i for i, s in enumerate(sheet) if s[2] == array]
        own = within.Design([exposure[i] for i in at], [subject[i] for i in at], within.rows_of(covariates, at))
        if own.subjects >= 3 and own.identified and own.df > 0:
            part = within.take(panel, "m", at)
            each = within.with_z(within.moderate(within.fit_panel(part, own), own.df), own.unit).select("probe", "chr", "pos", "beta", "se")
            pooled_ = genome.index_range_effects(regions.select("chr", "region", "probe_start", "probe_end"), each, ("probe",), cuts, rows=probes)
            regions = regions.join(pooled_.select("region", F.col("effect").alias(f"effect_{array}"), F.col("se").alias(f"se_{array}")), "region", "left")
    pair = [f"effect_{a}" for a in arrays if f"effect_{a}" in regions.columns]
    if len(pair) == 2:
        regions = regions.withColumn("sign_concordant", F.signum(pair[0]) == F.signum(pair[1]))
    by_p = [F.col("p_fwer")] if "p_fwer" in regions.columns else []
    return regions.orderBy(*by_p, F.col("chr").try_cast("int").asc_nulls_last(), F.col("chr").cast("string"), "start"), record


def dealt_exposures(exposure: list[float], n_perm: int, seed: int) -> np.ndarray:
    """The exposure, then ``n_perm`` orders of it: by an MD5 of seed, replicate and sample, so that any engine can repeat them."""
    x = np.asarray(exposure, float)
    keys = [[hashlib.md5(f"{seed}:{rep}:{i}".encode()).hexdigest() for i in range(len(x))] for rep in range(1, n_perm + 1)]
    return np.array([x, *(x[sorted(range(len(x)), key=lambda i, k=k: (k[i], i))] for k in keys)])


def smoothed_clusters(pos: np.ndarray, cluster: np.ndarray, y: np.ndarray, span: float, least: int, in_span: int) -> tuple[np.ndarray, np.ndarray]:
    """(robust local fits, which rows have one) of rows in the order of clusters and positions.

    A cluster of fewer than ``least`` rows, or whose ``span`` base pairs hold fewer than ``in_span`` of them at its median
    spacing, is not smoothed and takes no part.  Clusters of one size and neighbourhood are fitted together.
    """
    begin = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
    size = np.diff(np.append(begin, len(cluster)))
    out, fitted, alike = y.astype(float).copy(), np.zeros(len(pos), bool), {}
    for a, n in zip(begin.tolist(), size.tolist()):
        if n >= least:
            near = int(kernels.span_of(pos[a : a + n], span) * n + 1e-7)
            if near >= in_span:
                alike.setdefault((n, near), []).append(a)
    for (n, near), firsts in alike.items():
        at = np.array(firsts)[:, None] + np.arange(n)
        out[at] = kernels.lowess(pos[at], out[at], near)
        fitted[at] = True
    return out, fitted


#: Clusters that one group of a task holds.
CLUSTERS = 256


def replicate_bumps(fits: DataFrame, cutoff: float, max_gap: float, smooth: bool, span: float, least: int, in_span: int) -> DataFrame:
    """``rep, chr, start, end, value, area, cluster, l, cluster_l``: runs of one sign beyond ``cutoff`` inside gap clusters.

    ``fits``: probe, chr, pos and ``betas``, the slopes under all replicates (0 is the observed one).  Clusters are dealt out in
    groups of a few hundred, so a chromosome is many tasks.
    """
    cuts = scan.cut_points(fits.select("chr", "pos"))
    wide = genome.gap_clusters(fits, max_gap, "chr", "pos", "probe", cuts=cuts).withColumn("part", F.floor(F.col("cluster") / CLUSTERS))
    kind = dict(fits.dtypes)["chr"]

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "probe"], kind="stable")
        pos, cluster, y = pdf["pos"].to_numpy(), pdf["cluster"].to_numpy(), np.stack(pdf["betas"].to_numpy())
        fitted = np.isfinite(y[:, :1]).all(axis=1)
        if smooth:
            y, fitted = smoothed_clusters(pos, cluster, y, span, least, in_span)
        begin = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
        size = np.diff(np.append(begin, len(cluster)))
        wide_of, edge = np.repeat(size, size), np.append(True, cluster[1:] != cluster[:-1])
        out = []
        for rep in range(y.shape[1]):
            side = np.where(fitted & (y[:, rep] >= cutoff), 1, np.where(fitted & (y[:, rep] <= -cutoff), -1, 0))
            first = np.flatnonzero(edge | np.append(True, side[1:] != side[:-1]))
            n, total = np.diff(np.append(first, len(side))), np.add.reduceat(y[:, rep], first)
            keep = side[first] != 0
            a, n, total = first[keep], n[keep], total[keep]
            out.append(pd.DataFrame({"rep": rep, "start": pos[a], "end": pos[a + n - 1], "value": total / n, "area": np.abs(total), "cluster": cluster[a], "l": n, "cluster_l": wide_of[a]}))
        out = pd.concat(out)
        out.insert(1, "chr", pdf["chr"].iloc[0])
        return out

    return wide.groupBy("chr", "part").applyInPandas(found, f"rep int, chr {kind}, start long, end long, value double, area double, cluster long, l long, cluster_l long")


def judged(bumps: DataFrame, n_perm: int) -> DataFrame:
    """The observed bumps with ``fwer, fwer_area, p_value, p_value_area``: by length and height together, and by area.

    ``fwer``: the share of replicates with a bump as extreme; ``p_value``: the share of all their bumps.  Nulls without replicates.
    """
    seen, null = bumps.where("rep = 0").drop("rep"), bumps.where("rep > 0")
    names = ("fwer", "fwer_area", "p_value", "p_value_area")
    if n_perm == 0:
        return seen.withColumns({n: F.lit(None).cast("double") for n in names})
    total = null.count()
    # what is read several times below is computed once
    seen = settled(pooled.joint_fwer(seen, null, n_perm)).withColumn("__high", F.abs("value")).withColumn("__one", F.lit(0))
    tall = null.withColumn("__high", F.abs("value")).withColumn("__one", F.lit(0))
    seen = settled(pooled.dominance(tall, seen, "l", "__high", "__both"))
    seen = pooled.dominance(tall, seen, "__one", "area", "__area")
    return seen.withColumn("p_value", F.col("__both") / F.lit(max(total, 1))).withColumn("p_value_area", F.col("__area") / F.lit(max(total, 1))).drop("__high", "__one", "__both", "__area")


def array_slopes(panel: DataFrame, sheet: list[tuple], covariates, least: int) -> dict[str, DataFrame]:
    """``probe, chr, pos, slope`` of every array's own pooled fit; arrays of fewer than ``least`` samples have none."""
    out = {}
    for array in sorted({a for _, _, a in sheet}):
        at = [i for i, s in enumerate(sheet) if s[2] == array]
        if len(at) >= least:
            own = pooled.Slopes(np.array([sheet[i][1] for i in at]), pooled.others(len(at), within.rows_of(covariates, at)))
            if own.known[0]:
                out[array] = pooled.fit_panel(within.take(panel, "m", at), own).select("probe", "chr", "pos", F.col("betas")[0].alias("slope"))
    return out


def bumphunter(panel: DataFrame, sheet: list[tuple[int, float, str]], *, covariates=None, adjust_array: bool = False, max_gap: float = 300, cutoff: float = 0.10, smooth: bool = True, span: float = 1000, least: int = 7, in_span: int = 5, n_perm: int = 0, seed: int = 1) -> DataFrame:
    """The legacy baseline: pooled fits, robust smoothing within gap clusters, thresholded bumps, permutation error rates.

    Every probe is regressed on the exposure with an intercept, the covariates (constant ones go) and, with ``adjust_array``, the
    array; subjects play no part, which is what makes it the baseline.  A replicate permutes the exposure
    over all samples and keeps the other columns.  Bumps carry the mean slope of each array's own fit where there are two arrays.
    ValueError where the other columns hold the exposure.  Replicates that they hold have no bumps.
    """
    other = pooled.others(len(sheet), covariates, [a for _, _, a in sheet] if adjust_array else None)
    slopes = pooled.Slopes(dealt_exposures([e for _, e, _ in sheet], n_perm, seed), other)
    if not slopes.known[0] or slopes.df <= 0:
        raise ValueError("the exposure is not identified beside the other columns")
    bumps = settled(replicate_bumps(pooled.fit_panel(panel, slopes), cutoff, max_gap, smooth, span, least, in_span))
    out = settled(judged(bumps, n_perm))
    per_array = array_slopes(panel, sheet, covariates, 6)
    if len(per_array) == 2:
        for array, fits in per_array.items():
            inside = genome.points_in_intervals(fits, out.select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end")))
            mean = inside.groupBy("chr", F.col("b_start").alias("start"), F.col("b_end").alias("end")).agg(F.avg("slope").alias(f"effect_{array}"))
            out = out.join(mean, ["chr", "start", "end"], "left")
    return out


def bounded_clusters(df: DataFrame, max_gap: float, widest: float, cuts: DataFrame | None = None) -> DataFrame:
    """``cluster``: gap clusters; one wider than ``widest`` is cut into as few pieces of equal width as fit."""
    c = genome.gap_clusters(df, max_gap, "chr", "pos", "probe", cuts=cuts)
    extent = c.groupBy("chr", "cluster").agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi")).where(F.col("__hi") - F.col("__lo") >= widest)
    c = c.join(extent, ["chr", "cluster"], "left")
    pieces = F.floor((F.col("__hi") - F.col("__lo") + 1) / widest) + 1
    piece = F.coalesce(F.floor((F.col("pos") - F.col("__lo")) * pieces / (F.col("__hi") - F.col("__lo") + 1)), F.lit(0))
    ids = c.withColumn("__piece_of", piece)
    starts = ids.groupBy("chr", "cluster", "__piece_of").agg(F.count("*").alias("__m"))
    numbered = starts.withColumn("__new", F.dense_rank().over(Window.partitionBy("chr").orderBy("cluster", "__piece_of"))).drop("__m")
    return ids.join(numbered, ["chr", "cluster", "__piece_of"]).withColumn("cluster", F.col("__new")).drop("__lo", "__hi", "__piece_of", "__new")


def blockfinder(panel: DataFrame, sheet: list[tuple[int, float, str]], *, covariates=None, adjust_array: bool = False, island: str | None = None, collapse_gap: float = 500, widest: float = 1500, block_gap: float = 250_000, span: float = 250_000, cutoff: float = 0.02, smooth: bool = True, least: int = 7, in_span: int = 5, n_perm: int = 0, seed: int = 1, as_beta: bool = True) -> DataFrame:
    """Legacy blocks: open-sea probes collapsed by a fixed gap, pooled fits of the clusters' means, smoothing over ``span``, bumps.

    ``island``: the column that says where a probe lies (null is open sea); without it all probes take part.  Clusters
    are at most ``widest`` wide.  M values become beta values (``as_beta``) before they are averaged.  At most 100 replicates.
    Empty when nothing passes.
    """
    kept = panel if island is None else panel.where(F.coalesce(F.col(island), F.lit("OpenSea")) == "OpenSea")
    kept = kept.select("probe", "chr", "pos", (F.transform("m", quality_control.m_to_beta) if as_beta else F.col("m")).alias("m"))
    cuts = scan.cut_points(kept.select("chr", "pos"))
    local = bounded_clusters(kept, collapse_gap, widest, cuts).withColumn("local", (F.col("cluster") - 1).cast("int"))
    collapsed = genome.collapse_clusters(genome.global_ids(local.drop("cluster"), "local"), "m")
    units = collapsed.select(F.col("cluster").alias("probe"), "chr", F.floor("mid").cast("long").alias("pos"), "m")
    n_perm = min(n_perm, 100)
    other = pooled.others(len(sheet), covariates, [a for _, _, a in sheet] if adjust_array else None)
    slopes = pooled.Slopes(dealt_exposures([e for _, e, _ in sheet], n_perm, seed), other)
    if not slopes.known[0] or slopes.df <= 0:
        raise ValueError("the exposure is not identified beside the other columns")
    return judged(settled(replicate_bumps(pooled.fit_panel(units, slopes), cutoff, block_gap, smooth, span, least, in_span)), n_perm)
