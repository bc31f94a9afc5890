"""The stages of an analysis as functions over tables; each can be run by itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.session import settled
from panelforge.operators import compare, genome, inference, normalise, pooled, quality_control, within
from panelforge.panel import Panel, design_matrix
from panelforge.sources import tables


def _held(rows: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """``probe, held``: the values a probe has, as (``ordinal``, ``m``) in the order of ``order`` (keys, ``ordinal``; one row a sample).

    A probe that one sample has twice is an error.
    """
    v = rows.join(F.broadcast(order), keys).groupBy("probe").agg(F.array_sort(F.collect_list(F.struct("ordinal", "m"))).alias("v"))
    twice = F.size("v") > F.size(F.array_distinct(F.transform("v", lambda x: x["ordinal"])))
    return v.select("probe", F.when(twice, F.raise_error("a sample has a probe twice")).otherwise(F.col("v")).alias("held"))


def _bound(held: DataFrame, n: int) -> DataFrame:
    """``probe, m``: one array a probe over all ``n`` samples; a value that a sample lacks is null.

    Each value is followed by the nulls up to the next one: time and room are those of the result, probes times samples.
    """
    nulls = lambda k: F.array_repeat(F.lit(None).cast("double"), k)
    after = lambda i: F.coalesce(F.get("held", i + 1)["ordinal"], F.lit(n))
    pieces = F.transform("held", lambda x, i: F.concat(F.array(x["m"]), nulls(after(i) - x["ordinal"] - 1)))
    return held.select("probe", F.flatten(F.concat(F.array(nulls(F.get("held", F.lit(0))["ordinal"])), pieces)).alias("m"))


def _ordered(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The samples numbered from 0 in the order of their keys: one row each."""
    return samples.select(*keys).distinct().withColumn("ordinal", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("int"))


def harmonise(intensities: DataFrame, annotation: DataFrame, *, detp: DataFrame | None = None, detp_frac: float = 0.05, detp_max: float = 0.01, drop_sex: bool = True, cross_reactive: DataFrame | None = None, offset: float = 100.0, bind: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, sample QC, probe audit) from ``sample, probe, meth, unmeth, detp`` rows.

    Samples that fail (or cannot be judged: ``reason`` says so) go before probes are judged; probes are joined by name.
    The panel's arrays have one entry for each kept sample, in the order of their names; a missing value is null.
    Where many samples have few probes each, arrays over all of them are far more than the values: without ``bind`` the panel has ``held``,
    the values a probe has as (``ordinal``, ``m``), instead of ``m``.
    """
    qc = settled(quality_control.sample_qc(intensities, detp_max=detp_max, frac_max=detp_frac))
    good = qc.where("not sample_fail").select("sample")
    kept = intensities.join(good, "sample", "left_semi")
    audit = quality_control.probe_audit(annotation, detp or kept.select("probe", "detp"), cross_reactive=cross_reactive, detp_max=detp_max, drop_sex=drop_sex)
    beta = kept.join(audit.where("kept").select("probe"), "probe", "left_semi").withColumn("beta", F.col("meth") / (F.col("meth") + F.col("unmeth") + offset))
    order = settled(_ordered(good, ["sample"]))
    rows = _held(beta.select("sample", "probe", quality_control.beta_to_m(F.col("beta")).alias("m")), order, ["sample"])
    rows = _bound(rows, order.count()) if bind else rows
    panel = annotation.join(rows, "probe").select("probe", "chr", "pos", "m" if bind else "held")
    return panel, qc, audit


def harmonise_arrays(arrays: dict[str, DataFrame], annotation: DataFrame, *, controls: dict[str, DataFrame] | None = None, out_of_band: dict[str, DataFrame] | None = None, normal: dict[str, DataFrame] | None = None, sheet: DataFrame | None = None, detp_frac: float = 0.05, detp_max: float = 0.01, least: float = 10.5, sex_cutoff: float = -2.0, drop_sex: bool = True, cross_reactive: DataFrame | None = None, offset: float = 100.0, mixture: bool = False, bind: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, sample QC, probe audit) of several arrays bound on the probes that all of them have.

    ``arrays``: name to ``sample, probe, meth, unmeth`` with ``detp``, or with ``channel`` where ``controls`` (name to
    ``sample, channel, intensity``) give the detection p.  ``out_of_band`` and ``normal`` (the same form) correct
    background and dyes before values are taken; detection and quality are judged on the raw intensities.
    ``sheet``: ``sample, sex`` as told (and ``array``, if names occur on several), compared with the sex
    that the X and Y probes show; null where either is unknown.  A scan is a sample on an array: one name on two arrays is two
    scans.  Scans are judged on all probes of their own array; those that fail, or cannot be judged, go before
    probes are judged; sex mismatches stay and are marked.  Panel rows hold the values ``m`` in the
    order of ``samples`` (names) and ``scanned`` (arrays); a probe that one array lacks goes, a value that a scan lacks is null.
    ``mixture``: beta values of probes of ``Type`` II (a column of the annotation) are brought onto the scale of type I's.
    ``bind``: as in :func:`harmonise`; rows without it have ``held`` instead of ``samples``, ``scanned`` and ``m``, and the mixture needs it.
    """
    if mixture and not bind:
        raise ValueError("the mixture is fitted on bound arrays")
    sides = []
    for name, df in arrays.items():
        raw = quality_control.control_detection(df, controls[name]) if controls is not None else df
        value = raw.withColumns({"__raw_m": F.col("meth"), "__raw_u": F.col("unmeth")})
        if out_of_band is not None:
            value = quality_control.background_corrected(value, out_of_band[name], None if normal is None else normal[name])
        sides.append(value.select("sample", "probe", F.col("__raw_m").alias("meth"), F.col("__raw_u").alias("unmeth"), F.col("meth").alias("signal_m"), F.col("unmeth").alias("signal_u"), "detp", F.lit(name).alias("array")))
    scans, scan = compare.union_methods(*sides), ["array", "sample"]
    qc = quality_control.sample_qc(scans, detp_max=detp_max, frac_max=detp_frac, least=least, by=("array",))
    sex = annotation.select("probe", F.upper(F.regexp_replace("chr", "^chr", "")).alias("chr")).where("chr in ('X', 'Y')")
    shown = quality_control.predict_sex(scans.join(sex, "probe").withColumn("cn", F.log2(F.col("meth") + F.col("unmeth"))), cutoff=sex_cutoff, by=("array",))
    qc = qc.join(shown.select(*scan, "predicted_sex"), scan, "left")
    if sheet is not None:
        told = [c for c in scan if c in sheet.columns]
        qc = qc.join(sheet.select(*told, "sex"), told, "left").withColumn("sex_mismatch", quality_control.sex_mismatch(F.col("sex"), F.col("predicted_sex")))
    qc = settled(qc)  # a row a scan, read by the probes' filters, the panel and the caller
    good = qc.where("not sample_fail").select(*scan)
    common = settled(scans.groupBy("probe").agg(F.countDistinct("array").alias("held")).where(F.col("held") == len(arrays)).select("probe"))  # a row a probe, read twice
    kept = scans.join(good, scan, "left_semi").join(common, "probe", "left_semi")
    audit = quality_control.probe_audit(annotation.join(common, "probe", "left_semi"), kept.select("probe", "detp"), cross_reactive=cross_reactive, detp_max=detp_max, drop_sex=drop_sex)
    order = settled(_ordered(good, ["sample", "array"]))
    m = kept.withColumn("m", quality_control.beta_to_m(F.col("signal_m") / (F.col("signal_m") + F.col("signal_u") + offset)))
    rows = _held(m.select(*scan, "probe", "m"), order, scan)
    if not bind:
        return audit.where("kept").select("probe", "chr", "pos").join(rows, "probe").select("probe", "chr", "pos", "held"), qc, audit
    rows = _bound(rows, order.count())
    names = order.agg(F.array_sort(F.collect_list(F.struct("ordinal", "sample", "array"))).alias("o")).select(F.col("o.sample").alias("samples"), F.col("o.array").alias("scanned"))
    if mixture:
        kinds = annotation.select("probe", (F.col("Type") == "II").alias("second")).where("second is not null")
        beta = rows.join(kinds, "probe").withColumn("m", F.transform("m", quality_control.m_to_beta))
        rows = normalise.probe_types(beta, "second", "m").select("probe", F.transform("m", lambda x: F.when(x.isNotNull() & ~F.isnan(x), quality_control.beta_to_m(x))).alias("m"))
    panel = audit.where("kept").select("probe", "chr", "pos").join(rows, "probe").crossJoin(F.broadcast(names))  # one row: the scans' names
    return panel.select("probe", "chr", "pos", "samples", "scanned", "m"), qc, audit


def probe_model(panel: Panel, exposure, subject, array=None, covariates: list[str] = (), weighted: bool = True, robust: bool = True, rho: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(statistics, summary): joint and per-array mixed fits with FDR; one summary row a fit.

    The array is a fixed effect of the joint fit, so a shift between arrays does not pass for an effect.
    ``weighted``: samples count by their precision; ``robust``: the prior of variances withstands outliers; ``rho``: a
    known within-subject correlation instead of the consensus of REML estimates.

    Samples without the exposure or a covariate are left out; covariates that are
    constant among the samples of a fit go.
    """
    named = [c for c in (exposure, *covariates) if isinstance(c, str)]
    panel = panel.complete(*named)
    s = panel.sheet(exposure, subject, array)
    fits, rows = [], []
    for name, at in [("joint", range(len(s))), *((a, [i for i, v in enumerate(s) if v[2] == a]) for a in sorted({v[2] for v in s}) if array is not None)]:
        at = list(at)
        part = within.take(panel.data, "m", at)
        x, k = [s[i][1] for i in at], [s[i][0] for i in at]
        columns = [c for c in (design_matrix([panel.samples[i] for i in at], list(covariates)), pooled.indicators([s[i][2] for i in at]) if name == "joint" else None) if c is not None and np.size(c)]
        extra = np.hstack(columns) if columns else None
        weights = within.sample_weights(part, x, extra) if weighted else None
        own = within.consensus_correlation(part, k, exposure=x, covariates=extra, weights=weights) if rho is None else rho
        f = inference.bh(within.fit_gls(part, x, k, extra, rho=own, weights=weights, robust=robust)).withColumn("fit", F.lit(name))
        fits.append(f)
        rows.append(f.agg(F.count("*").alias("n_probes"), F.sum((F.col("fdr") < 0.05).cast("long")).alias("n_fdr05")).select(F.lit(name).alias("fit"), F.lit(len(at)).alias("n_samples"), F.lit(len(set(k))).alias("n_subjects"), F.lit(own).alias("within_subject_cor"), "n_probes", "n_fdr05"))
    return compare.union_methods(*fits), compare.union_methods(*rows)


def covariate_residuals(panel: Panel, exposure, subject, array=None, covariates: list[str] = ()) -> DataFrame:
    """``probe, chr, pos, m``: each probe's residuals beside intercept, covariates and array, the exposure left in."""
    panel = panel.complete(*[c for c in (exposure, *covariates) if isinstance(c, str)])
    s = panel.sheet(exposure, subject, array)
    other = pooled.others(len(s), design_matrix(panel.samples, list(covariates)), [v[2] for v in s] if array is not None else None)
    return pooled.residual_panel(panel.data, pooled.basis_of(other))


def full_comparison(rows: list[DataFrame]) -> tuple[DataFrame, str]:
    """(table, Markdown report) of ``compare.method_row`` rows, with every column of the comparison."""
    table = compare.union_methods(*rows)
    return table, "# Comparison of methods\n\n" + tables.markdown(table)


def comparison(methods: dict[str, DataFrame], p: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """(table, Markdown report) of several methods' regions; a missing method is an empty table."""
    table = compare.union_methods(*(compare.method_summary(n, d, (p or {}).get(n)) for n, d in methods.items()))
    first = ["method", "n", "median_width", "total_bp", "median_probes"]
    table = table.select(*first, *(c for c in table.columns if c not in first))
    return table, "# Comparison of methods\n\n" + tables.markdown(table)


def gap_histogram(track: DataFrame, edges: tuple[int, ...] = (10, 30, 100, 300, 1000, 3000)) -> DataFrame:
    """Counts of adjacent gaps by class, the data of the spacing figure."""
    label = F.lit(f">{edges[-1]}")
    for e in reversed(edges):
        label = F.when(F.col("gap") <= e, F.lit(f"<={e}")).otherwise(label)
    return genome.with_gap(track).where("gap is not null").groupBy(label.alias("gap_class")).agg(F.count("*").alias("n"))


def first_rows(df: DataFrame, keys: DataFrame, on: str, order: str, n: int = 2000) -> DataFrame:
    """The first ``n`` rows by position among those whose key is listed."""
    return df.join(keys.select(on).distinct(), on, "left_semi").orderBy(order, on).limit(n)
