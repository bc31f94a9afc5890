"""Preparation of array values: transforms, sample and probe filters, coding, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.session import settled

EPS = 1e-6


def beta_to_m(b: Column) -> Column:
    """log2(b / (1 - b)) of b clipped to [1e-6, 1 - 1e-6]."""
    c = F.least(F.greatest(b, F.lit(EPS)), F.lit(1 - EPS))
    return F.log2(c / (1 - c))


def m_to_beta(m: Column) -> Column:
    return F.pow(F.lit(2.0), m) / (F.pow(F.lit(2.0), m) + 1)


def is_beta(df: DataFrame, value: str) -> bool:
    """Whether all finite values lie in [0, 1]; missing and infinite ones say nothing."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    row = df.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    return row["lo"] is not None and row["lo"] >= 0 and row["hi"] <= 1


def scale_exposure(x: Column, how: str = "raw", by: float = 100.0) -> Column:
    return {"raw": x, "scaled": x / by, "log1p": F.log1p(x)}[how]


def code_exposure(df: DataFrame, column: str, name: str = "exposure") -> DataFrame:
    """Numbers and booleans as they are; exactly two levels become 0 and 1 in sorted order; else ValueError."""
    kind = dict(df.dtypes)[column]
    if kind not in ("string",):
        return df.withColumn(name, F.col(column).cast("double"))
    row = df.agg(F.countDistinct(column).alias("n"), F.max(column).alias("top")).first()
    if row["n"] != 2:
        raise ValueError(f"{column} has {row['n']} levels; two are needed")
    return df.withColumn(name, (F.col(column) == row["top"]).cast("double"))


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one distinct value."""
    if not columns:
        return []
    row = df.agg(*(F.countDistinct(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] > 1]


def sample_qc(intensities: DataFrame, sample: str = "sample", meth: str = "meth", unmeth: str = "unmeth", detp: str = "detp", *, least: float = 10.5, detp_max: float = 0.01, frac_max: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Median log2 intensities, share of failed probes and the failure flag of each sample (of each ``by``).

    A sample without any intensity or detection p cannot be judged: it fails, and ``reason`` says why
    (``no intensity``, ``no detection p``, ``low intensity``, ``detection``; null for a sample that passes).
    """
    g = intensities.groupBy(*by, sample).agg(F.percentile(F.log2(meth), 0.5).alias("m_med"), F.percentile(F.log2(unmeth), 0.5).alias("u_med"), F.avg((F.col(detp) > detp_max).cast("double")).alias("frac_failed"))
    g = g.withColumn("qc_mean", (F.col("m_med") + F.col("u_med")) / 2)
    low, lost = F.col("qc_mean") < least, F.col("frac_failed") > frac_max
    reason = F.when(F.col("qc_mean").isNull(), "no intensity").when(F.col("frac_failed").isNull(), "no detection p").when(low, "low intensity").when(lost, "detection")
    return g.withColumn("reason", reason).withColumn("sample_fail", F.col("reason").isNotNull())


def detection_p(intensity: Column, mean: Column, sd: Column) -> Column:
    """Upper normal tail of an intensity against negative controls (a rational approximation, error below 7.5e-8)."""
    z = (intensity - mean) / sd
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def control_detection(intensities: DataFrame, controls: DataFrame, channel: str = "channel", name: str = "detp") -> DataFrame:
    """``intensities`` (sample, meth, unmeth, channel) with the detection p of their total.

    ``controls``: sample, channel (Grn or Red), intensity of negative controls.  Centre and spread of a channel are
    the median and 1.4826 times the median absolute deviation of its controls; a one-colour probe is twice its
    channel, a two-colour probe (null channel) the sum of both.  A sample without controls has a null p.
    """
    mid = controls.groupBy("sample", "channel").agg(F.percentile("intensity", 0.5).alias("__mid"))
    off = controls.join(mid, ["sample", "channel"]).groupBy("sample", "channel", "__mid").agg((F.percentile(F.abs(F.col("intensity") - F.col("__mid")), 0.5) * 1.4826).alias("__sd"))
    pick = {f"__{k}_{c}": F.max(F.when(F.col("channel") == c, F.col(f"__{k}"))) for c in ("Grn", "Red") for k in ("mid", "sd")}
    row = settled(off.groupBy("sample").agg(*(e.alias(n) for n, e in pick.items())))  # a row a sample: the intensities are read several times
    value = {k: F.when(F.col(channel).isNull(), F.col(f"__{k}_Grn") + F.col(f"__{k}_Red")).when(F.col(channel) == "Grn", 2 * F.col(f"__{k}_Grn")).otherwise(2 * F.col(f"__{k}_Red")) for k in ("mid", "sd")}
    return intensities.join(row, "sample", "left").withColumn(name, detection_p(F.col("meth") + F.col("unmeth"), value["mid"], value["sd"])).drop(*pick)


def spread_of(df: DataFrame, value: str, by: tuple[str, ...], clip: float = 1.5) -> DataFrame:
    """``mid, sd, mean`` of each group: the median, 1.4826 times the median absolute deviation, and the mean of values drawn in to ``clip`` of these around it."""
    mid = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("mid"))
    sd = df.join(mid, [*by]).groupBy(*by, "mid").agg((F.percentile(F.abs(F.col(value) - F.col("mid")), 0.5) * 1.4826).alias("sd"))
    drawn = F.least(F.greatest(F.col(value), F.col("mid") - clip * F.col("sd")), F.col("mid") + clip * F.col("sd"))
    return df.join(sd, [*by]).groupBy(*by, "mid", "sd").agg(F.avg(drawn).alias("mean"))


def excess_of_normal(z: Column) -> Column:
    """z + phi(z) / Phi(z): the mean of a standard normal around ``z`` that is cut at 0.  No cancellation where z is far below 0."""
    t, tail = -z, F.lit(0.0)
    for k in range(30, 0, -1):  # the continued fraction of Mills' ratio
        tail = F.lit(float(k)) / (t + tail) if k > 1 else tail
    low = 1 / (t + tail)
    u = 1 / (1 + 0.2316419 * F.abs(z))
    poly = u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429))))
    density = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    return F.when(z < -2, low).otherwise(z + density / F.when(z >= 0, 1 - density * poly).otherwise(density * poly))


def normal_exponential(x: Column, mu: Column, sigma: Column, alpha: Column) -> Column:
    """Expected signal in x = signal + background: the signal exponential with mean alpha, the background normal (mu, sigma)."""
    m = x - mu - sigma * sigma / alpha
    return F.when(sigma > 0, sigma * excess_of_normal(m / sigma)).otherwise(F.greatest(x - mu, F.lit(0.0)))


def background_corrected(intensities: DataFrame, out_of_band: DataFrame, normal: DataFrame | None = None, *, offset: float = 15.0, channel: str = "channel") -> DataFrame:
    """``intensities`` with meth and unmeth corrected for background and, with ``normal``, for the dyes' different brightness.

    ``out_of_band``: sample, channel (Grn or Red), intensity measured in a probe's other colour; its robust centre and spread are
    the background of the sample's channel.  The signal's mean is the robust mean of the channel's own intensities above that, 10 at least.  A
    one-colour probe is read in its channel, a two-colour one (null channel) has meth in Grn and unmeth in Red.
    ``normal``: sample, channel, intensity of normalisation controls; red is scaled by the ratio of their means in
    both colours.  A sample without out-of-band values keeps its intensities.
    """
    read = {"meth": F.coalesce(F.col(channel), F.lit("Grn")), "unmeth": F.coalesce(F.col(channel), F.lit("Red"))}
    own = intensities.select("sample", F.explode(F.array(*(F.struct(c.alias("colour"), F.col(v).cast("double").alias("x")) for v, c in read.items()))).alias("r")).select("sample", "r.colour", "r.x")
    back = spread_of(out_of_band.select("sample", F.col("channel").alias("colour"), F.col("intensity").cast("double").alias("x")), "x", ("sample", "colour"))
    signal = spread_of(own, "x", ("sample", "colour")).select("sample", "colour", F.col("mean").alias("level"))
    by_channel = back.join(signal, ["sample", "colour"]).withColumn("alpha", F.greatest(F.col("level") - F.col("mid"), F.lit(10.0)))
    pick = {f"__{k}_{c}": F.max(F.when(F.col("colour") == c, F.col(k))) for c in ("Grn", "Red") for k in ("mid", "sd", "alpha")}
    row = by_channel.groupBy("sample").agg(*(e.alias(n) for n, e in pick.items()))
    if normal is not None:
        each = {f"__bright_{c}": F.avg(F.when(F.col("channel") == c, F.col("intensity"))) for c in ("Grn", "Red")}
        pick |= each
        row = row.join(normal.groupBy("sample").agg(*(e.alias(n) for n, e in each.items())), "sample", "left")
    out = intensities.join(row, "sample", "left")  # one row a sample
    for v, c in read.items():
        mu, sd, alpha = (F.when(c == "Grn", F.col(f"__{k}_Grn")).otherwise(F.col(f"__{k}_Red")) for k in ("mid", "sd", "alpha"))
        value = normal_exponential(F.col(v).cast("double"), mu, sd, alpha) + offset
        if normal is not None:
            value = value * F.when(c == "Red", F.coalesce(F.col("__bright_Grn") / F.col("__bright_Red"), F.lit(1.0))).otherwise(F.lit(1.0))
        out = out.withColumn(f"__{v}", F.when(mu.isNull(), F.col(v).cast("double")).otherwise(value))
    return out.withColumns({v: F.col(f"__{v}") for v in read}).drop(*(f"__{v}" for v in read), *pick)


def predict_sex(df: DataFrame, sample: str = "sample", chrom: str = "chr", copy_number: str = "cn", cutoff: float = -2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """F where median CN(Y) - median CN(X) is below the cut-off, else M; null for a sample without probes of both."""
    g = df.groupBy(*by, sample).agg(F.percentile(F.when(F.col(chrom) == "X", F.col(copy_number)), 0.5).alias("x"), F.percentile(F.when(F.col(chrom) == "Y", F.col(copy_number)), 0.5).alias("y"))
    apart = F.col("y") - F.col("x")
    return g.withColumn("predicted_sex", F.when(apart < cutoff, "F").when(apart >= cutoff, "M"))


def sex_mismatch(a: Column, b: Column) -> Column:
    return F.upper(F.substring(a, 1, 1)) != F.upper(F.substring(b, 1, 1))


def probe_audit(probes: DataFrame, detp: DataFrame | None = None, *, cross_reactive: DataFrame | None = None, maf_min: float = 0.01, detp_max: float = 0.01, drop_sex: bool = True, probe: str = "probe", chrom: str = "chr") -> DataFrame:
    """Flags ``fail_detp, is_sex, is_crossreactive, dropped_snp`` and ``kept`` of every probe.

    A probe fails detection if it fails in any kept sample; SNP frequencies are null-safe.
    """
    out = probes
    if detp is not None:
        failed = detp.where(F.col("detp") > detp_max).select(probe).distinct().withColumn("fail_detp", F.lit(True))
        out = out.join(failed, probe, "left").withColumn("fail_detp", F.coalesce("fail_detp", F.lit(False)))
    else:
        out = out.withColumn("fail_detp", F.lit(False))
    if cross_reactive is not None:
        hit = cross_reactive.select(probe).distinct().withColumn("is_crossreactive", F.lit(True))
        out = out.join(hit, probe, "left").withColumn("is_crossreactive", F.coalesce("is_crossreactive", F.lit(False)))
    else:
        out = out.withColumn("is_crossreactive", F.lit(False))
    mafs = [F.coalesce(F.col(c) >= maf_min, F.lit(False)) for c in ("CpG_maf", "SBE_maf") if c in probes.columns]
    out = out.withColumn("dropped_snp", reduce(lambda a, b: a | b, mafs, F.lit(False))).withColumn("is_sex", F.upper(F.regexp_replace(F.col(chrom).cast("string"), "^chr", "")).isin("X", "Y"))
    bad = F.col("fail_detp") | F.col("is_crossreactive") | F.col("dropped_snp") | (F.lit(drop_sex) & F.col("is_sex"))
    return out.withColumn("kept", ~bad)


def documented(df: DataFrame, names: tuple[str, ...] = ("Probe_rs", "CpG_rs", "SBE_rs"), name: str = "documented_snp") -> DataFrame:
    """``df`` with a flag: whether any of the variant columns that it has names a variant."""
    have = [F.col(c).isNotNull() for c in names if c in df.columns]
    return df.withColumn(name, reduce(lambda a, b: a | b, have, F.lit(False)))


def documented_first(df: DataFrame, name: str = "documented_snp", chrom: str = "chr", pos: str = "pos") -> DataFrame:
    """Flagged rows first, then in the order of chromosome names and positions."""
    return df.orderBy(F.col(name).desc(), F.col(chrom).cast("string"), pos)


def open_sea(df: DataFrame, island: str = "island", status: str = "status", shared: str = "shared_450K_EPIC", least: int = 1000) -> DataFrame:
    """Autosomal open-sea probes that both arrays share; fewer than ``least`` is an error."""
    from panelforge.operators.genome import autosomes

    kept = autosomes(df.where((F.coalesce(F.col(island), F.lit("OpenSea")) == "OpenSea") & (F.col(status) == shared)))
    n = kept.limit(least).count()
    if n < least:
        raise ValueError(f"{n} open-sea probes are left; at least {least} are needed")
    return kept


def gene_family(gene: Column, prefix: str = "CYP") -> Column:
    """Whether a ;-separated gene list has a member that begins with ``prefix``."""
    return gene.rlike(f"(^|;){prefix}")


def intersect_probes(*sides: DataFrame, probe: str = "probe") -> DataFrame:
    """Names that every side has."""
    return reduce(lambda a, b: a.intersect(b), [s.select(probe) for s in sides])


def manifest_concordance(a: DataFrame, b: DataFrame, attributes: list[str], probe: str = "probe") -> DataFrame:
    """``attribute, discordant, pct`` over shared probes, and a row ``any``."""
    j = a.select(probe, *(F.col(c).cast("string").alias(f"a_{c}") for c in attributes)).join(b.select(probe, *(F.col(c).cast("string").alias(f"b_{c}") for c in attributes)), probe)
    differ = [(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))) for c in attributes]
    row = j.agg(F.count("*").alias("n"), *(F.sum(d.cast("long")).alias(c) for d, c in zip(differ, attributes)), F.sum(reduce(lambda x, y: x | y, differ).cast("long")).alias("any"))
    names = [*attributes, "any"]
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return row.selectExpr("n", f"stack({len(names)}, {pairs}) as (attribute, discordant)").select("attribute", "discordant", F.when(F.col("n") > 0, F.col("discordant") * 100.0 / F.col("n")).alias("pct"))


def align(panel_names: DataFrame, sheet: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """The sheet in the order of ``panel_names`` (key, ordinal); ValueError names how many are missing."""
    missing = panel_names.join(sheet.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} names have no row in the sheet")
    return panel_names.join(sheet, key).orderBy(ordinal)


def kept_rows(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def dropped_rows(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_anti")
