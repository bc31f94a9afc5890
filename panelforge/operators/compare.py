"""Agreement between arrays and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import genome


#: Columns of the comparison of methods, in their order (fixed values).
COLUMNS = (
    "method", "level", "n_regions", "n_fwer05", "median_width_bp", "median_n_probes", "cross_array_r_common", "sign_concordance_common", "cross_array_r", "sign_concordance",
    "null_q95_max_abs_z", "total_bp", "n_cross_array", "runtime_s", "n_clusters", "n_cross_array_common", "n_fwer05_naive_perm", "null_q95_naive_perm",
)


def _finite(*names: str):
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return out


def agreement(df: DataFrame, a: str, b: str, least_r: int = 3, least_sign: int = 1) -> DataFrame:
    """``n, r, sign_concordance`` over finite pairs; null with fewer pairs than asked for."""
    g = df.where(_finite(a, b)).agg(F.count("*").alias("n"), F.corr(a, b).alias("__r"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("__s"))
    return g.select("n", F.when((F.col("n") >= least_r) & ~F.isnan("__r"), F.col("__r")).alias("r"), F.when(F.col("n") >= least_sign, F.col("__s")).alias("sign_concordance"))


def ivw(df: DataFrame, by: list[str], beta: str = "beta", se: str = "se") -> DataFrame:
    """Inverse-variance weighted effect and its SE of each ``by``; rows without a positive finite SE go."""
    w = 1 / (F.col(se) * F.col(se))
    ok = df.where(_finite(beta, se) & (F.col(se) > 0))
    return ok.groupBy(*by).agg((F.sum(w * F.col(beta)) / F.sum(w)).alias("effect"), F.sqrt(1 / F.sum(w)).alias("se"), F.count("*").alias("n"))


def region_effects(regions: DataFrame, fits: DataFrame, by: tuple[str, ...] = ("array",)) -> DataFrame:
    """Each region's pooled effect per array: points joined to intervals by bins, then weighted means.

    ``regions``: chr, region, start, end; ``fits``: chr, pos, beta, se and ``by``.
    """
    inside = genome.points_in_intervals(fits, regions.select("chr", "region", F.col("start").alias("b_start"), F.col("end").alias("b_end")))
    return ivw(inside, ["region", *by])


def common_footing(regions: DataFrame, fits: DataFrame, arrays: tuple[str, str], array: str = "array") -> DataFrame:
    """Agreement of two arrays over region effects re-estimated alike; three finite pairs at least."""
    e = region_effects(regions, fits, (array,)).groupBy("region").pivot(array, list(arrays)).agg(F.first("effect"))
    return agreement(e.withColumnRenamed(arrays[0], "__a").withColumnRenamed(arrays[1], "__b"), "__a", "__b", 3, 3)


def method_summary(name: str, regions: DataFrame, p: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for a method: count, widths, probes and, where it has one, p at most .05."""
    cols = [F.count("*").alias("n"), F.percentile("width", 0.5).alias("median_width"), F.sum("width").alias("total_bp"), F.percentile("n_probes", 0.5).alias("median_probes")]
    if p:
        cols.append(F.sum((F.col(p) <= 0.05).cast("long")).alias("n_fwer05"))
    return regions.agg(*cols, *(F.avg(c).alias(f"mean_{c}") for c in extra)).withColumn("method", F.lit(name))


def method_row(name: str, level: str, regions: DataFrame, *, probes: str = "n_probes", p: str | None = None, p_naive: str | None = None, effects: tuple[str, str] | None = None, null: DataFrame | None = None, null_naive: DataFrame | None = None, fits: DataFrame | None = None, arrays: tuple[str, str] = ("450K", "EPIC"), runtime_s: float | None = None, n_clusters: int | None = None) -> DataFrame:
    """One row with every column of the comparison (``COLUMNS``); what a method lacks is null.

    ``regions``: chr, start, end and the named columns; text that is no number counts as missing.  ``effects``: the
    method's own effect of each array.  ``null``, ``null_naive``: ``max_abs_z`` of permutations.  ``fits``: chr, pos,
    beta, se, array, by which each region's effect is estimated anew, alike for all methods (equal regions once).
    """

    def number(c: str):
        return F.col(c).try_cast("double")

    cols = [F.count("*").alias("n_regions"), F.percentile(number("end") - number("start") + 1, 0.5).alias("median_width_bp"), F.sum(number("end") - number("start") + 1).alias("total_bp"), F.percentile(number(probes), 0.5).alias("median_n_probes")]
    for column, out in ((p, "n_fwer05"), (p_naive, "n_fwer05_naive_perm")):
        if column:
            cols.append(F.sum(F.coalesce(number(column) <= 0.05, F.lit(False)).cast("long")).alias(out))
    parts = []
    if effects:
        regions = regions.withColumns({"__a": number(effects[0]), "__b": number(effects[1])})
        parts.append(agreement(regions, "__a", "__b").select(F.when(F.col("n") > 0, F.col("n")).alias("n_cross_array"), F.col("r").alias("cross_array_r"), "sign_concordance"))
    if fits is not None:
        keyed = regions.select("chr", F.concat_ws(":", "chr", "start", "end").alias("region"), "start", "end").distinct()
        common = common_footing(keyed, fits, arrays)
        parts.append(common.select(F.col("n").alias("n_cross_array_common"), F.col("r").alias("cross_array_r_common"), F.col("sign_concordance").alias("sign_concordance_common")))
    for values, out in ((null, "null_q95_max_abs_z"), (null_naive, "null_q95_naive_perm")):
        if values is not None:
            parts.append(values.agg(F.percentile("max_abs_z", 0.95).alias(out)))
    row = union_methods(regions.agg(*cols), *parts)  # one row a part, each with columns of its own
    row = row.agg(*(F.max(c).alias(c) for c in row.columns))
    named = {"method": F.lit(name), "level": F.lit(level), "runtime_s": F.lit(runtime_s).cast("double"), "n_clusters": F.lit(n_clusters).cast("long")}
    row = row.withColumns({**named, **{c: F.lit(None).cast("double") for c in COLUMNS if c not in named and c not in row.columns}})
    return row.select(*(F.col(c) if c in ("method", "level") else F.col(c).cast("long" if c.startswith("n_") else "double").alias(c) for c in COLUMNS))


def union_methods(*rows: DataFrame) -> DataFrame:
    """Rows of several methods; columns that a method lacks are null."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
