"""Ordered operators along a genome: gaps, clusters, penalties, regions, runs and interval joins.

Windows are partitioned by chromosome (or probe), never global, and by pieces of a
chromosome where ``cuts`` (:func:`scan.cut_points`) say so; consecutive ids over the whole
genome come from per-chromosome counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import quantiles, scan

BIN = 100_000


def normalise_chr(c: Column) -> Column:
    """Strip a leading ``chr``."""
    return F.regexp_replace(c.cast("string"), "^chr", "")


def canonical_chr(c: Column) -> Column:
    """5, '5.0' and 'chr5' all become 'chr5'."""
    return F.concat(F.lit("chr"), F.regexp_replace(normalise_chr(c), r"\.0$", ""))


def autosomes(df: DataFrame, chrom: str = "chr") -> DataFrame:
    """Chromosomes 1 to 22, with an integer ``chr_num``."""
    return df.withColumn(chrom, normalise_chr(F.col(chrom))).where(F.col(chrom).isin([str(k) for k in range(1, 23)])).withColumn("chr_num", F.col(chrom).cast("int"))


def order(chrom: str = "chr", pos: str = "pos", *ties: str):
    return Window.partitionBy(chrom).orderBy(pos, *ties)


def with_gap(df: DataFrame, chrom: str = "chr", pos: str = "pos", *ties: str, cuts: DataFrame | None = None) -> DataFrame:
    """``gap``: distance to the row before on the chromosome, null at the first."""
    if cuts is None:
        return df.withColumn("gap", F.col(pos) - F.lag(pos).over(order(chrom, pos, *ties)))
    d = scan.with_previous(scan.pieced(df, cuts, chrom, pos), {"__last": F.col(pos)}, (chrom,), (pos, *ties), False)
    return d.withColumn("gap", F.col(pos) - F.col("__last")).drop("__last", scan.PIECE)


def islands(df: DataFrame, breaks: Column, chrom: str = "chr", pos: str = "pos", *ties: str, name: str = "island", cuts: DataFrame | None = None) -> DataFrame:
    """Number runs from 1 on each chromosome; a true or null ``breaks`` starts one.

    ``breaks`` is of columns of ``df``: with ``cuts`` it must not look at other rows by a window.  Rows of one position (and ``ties``) are
    one place: a break at any of them is one of all.
    """
    flagged = df.withColumn("__new", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    return scan.with_running(scan.pieced(flagged, cuts, chrom, pos), {name: F.col("__new")}, (chrom,), (pos, *ties), cuts is None, peers=True).drop("__new", scan.PIECE)


def gap_clusters(df: DataFrame, max_gap: float, chrom: str = "chr", pos: str = "pos", *ties: str, cuts: DataFrame | None = None) -> DataFrame:
    """Clusters of rows no more than ``max_gap`` from the one before."""
    return islands(with_gap(df, chrom, pos, *ties, cuts=cuts), F.col("gap") > max_gap, chrom, pos, *ties, name="cluster", cuts=cuts)


def cluster_table(clustered: DataFrame, chrom: str = "chr", pos: str = "pos") -> DataFrame:
    return clustered.groupBy(chrom, "cluster").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n_probes")).withColumn("width", F.col("end") - F.col("start") + 1)


def fixed_collapse(df: DataFrame, max_gap: float = 500, least: int = 2, widest: int = 1500) -> DataFrame:
    """One row: how many gap clusters have ``least`` probes and at most ``widest`` width, their median width and size; nulls when none."""
    kept = cluster_table(gap_clusters(df, max_gap)).where((F.col("n_probes") >= least) & (F.col("width") <= widest))
    return kept.agg(F.count("*").alias("n_clusters"), F.percentile("width", 0.5).alias("median_width"), F.percentile("n_probes", 0.5).alias("median_probes"))


def spacing(df: DataFrame, max_gap: float = 300, cuts: DataFrame | None = None) -> DataFrame:
    """Gap median and quartiles, share beyond ``max_gap``, clusters and the share of single-probe ones: one row.

    Quantiles are exact (:mod:`panelforge.operators.quantiles`): no task holds all gaps.
    """
    gaps = with_gap(df, cuts=cuts).where("gap is not null")
    q = quantiles.quantiles(gaps, "gap", [0.25, 0.5, 0.75])
    g = gaps.agg(F.count("*").alias("n_gaps"), *(F.lit(v).cast("double").alias(f"gap_q{k}") for v, k in zip(q, (25, 50, 75))), (F.sum((F.col("gap") > max_gap).cast("long")) * 100.0 / F.count("*")).alias("pct_beyond"))
    c = cluster_table(gap_clusters(df, max_gap, cuts=cuts)).agg(F.count("*").alias("n_clusters"), (F.sum((F.col("n_probes") == 1).cast("long")) * 100.0 / F.count("*")).alias("pct_single"))
    return g.crossJoin(c)  # one row each


def row_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_rows(df: DataFrame, values: str, name: str) -> DataFrame:
    """``name``: each row of ``values`` less its mean and scaled to length 1; zeros where nothing is left."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            v = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=float)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, many = np.repeat(np.arange(len(n)), n), np.maximum(n, 1)
            v = v - (np.bincount(row, v, len(n)) / many)[row]
            norm = np.sqrt(np.bincount(row, v * v, len(n)))
            v = np.divide(v, norm[row], out=np.zeros_like(v), where=norm[row] > 0)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, name])

    return df.mapInArrow(run, f"{types}, `{name}` array<double>")


def adjacent_correlation(df: DataFrame, resid: str, max_gap: float, chrom: str = "chr", pos: str = "pos", *ties: str, cuts: DataFrame | None = None) -> DataFrame:
    """``gap`` and ``rho`` with the probe before, computed only within ``max_gap``; a zero-norm row has rho 0.

    Rows are brought to mean 0 and length 1 once, so a pair costs one dot product: time is linear in samples.
    """
    unit = scan.pieced(unit_rows(df, resid, "__c"), cuts, chrom, pos)
    before = scan.with_previous(unit, {"__last": F.col(pos), "__p": F.col("__c")}, (chrom,), (pos, *ties), cuts is None)
    gap = F.col(pos) - F.col("__last")
    rho = F.greatest(F.least(row_dot(F.col("__c"), F.col("__p")), F.lit(1.0)), F.lit(-1.0))
    return before.withColumn("gap", gap).withColumn("rho", F.when(F.col("gap") <= max_gap, rho)).drop("__c", "__p", "__last", scan.PIECE)


def global_ids(df: DataFrame, local: str, chrom: str = "chr", name: str = "cluster") -> DataFrame:
    """Consecutive ids over the genome from ids 0.. on each chromosome (null stays -1); offsets are one row a chromosome."""
    counts = df.groupBy(chrom).agg((F.coalesce(F.max(local), F.lit(-1)) + 1).alias("__n"))
    offsets = counts.withColumn("__o", F.sum("__n").over(Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    return df.join(F.broadcast(offsets), chrom).withColumn(name, F.coalesce(F.col(local) + F.col("__o"), F.lit(-1)).cast("int")).drop("__o")


def comethylation_clusters(df: DataFrame, resid: str, max_gap: float = 1000, rho_min: float = 0.30, chrom: str = "chr", pos: str = "pos", *ties: str, cuts: DataFrame | None = None) -> DataFrame:
    """``cluster``: runs of two or more probes linked by distance and correlation, numbered in genome order; others -1.

    A row is in a cluster if it is linked to the row before or the row after to it, and it begins one if
    only the latter; so no run has to be gathered.
    """
    linked = adjacent_correlation(df, resid, max_gap, chrom, pos, *ties, cuts=cuts).withColumn("__joined", F.coalesce(F.col("rho") >= rho_min, F.lit(False)))
    back = tuple(F.desc(c) for c in (pos, *ties))
    d = scan.pieced(linked, cuts, chrom, pos)
    following = F.lead("__joined").over(scan.window((chrom,), pos, *ties))
    if cuts is not None:
        heads = d.groupBy(chrom, scan.PIECE).agg(F.min_by("__joined", F.struct(pos, *ties)).alias("__head"))
        heads = heads.select(F.col(chrom).alias("__hc"), F.col(scan.PIECE).alias("__hp"), F.lead("__head").over(Window.partitionBy(chrom).orderBy(scan.PIECE)).alias("__head"))
        d = d.join(F.broadcast(heads), (F.col(chrom) == F.col("__hc")) & (F.col(scan.PIECE) == F.col("__hp")), "left").drop("__hc", "__hp")
        following = F.when(F.row_number().over(scan.window((chrom,), *back)) == 1, F.col("__head")).otherwise(following)
    d = d.withColumn("__next", F.coalesce(following, F.lit(False))).drop("__head")
    begins = (~F.col("__joined") & F.col("__next")).cast("int")
    d = scan.with_running(d, {"__k": begins}, (chrom,), (pos, *ties), cuts is None)
    d = d.withColumn("__local", F.when(F.col("__joined") | F.col("__next"), F.col("__k") - 1))
    return global_ids(d, "__local", chrom).drop("__joined", "__next", "__k", "__local", "gap", "rho", scan.PIECE)


def collapse_clusters(df: DataFrame, values: str, chrom: str = "chr", pos: str = "pos") -> DataFrame:
    """Mean profile, extent and size of each cluster; a map-side aggregate of (cluster, sample)."""
    inside = df.where("cluster >= 0")
    means = inside.select("cluster", F.posexplode(values).alias("__k", "__v")).groupBy("cluster", "__k").agg(F.avg("__v").alias("__m")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("__k", "__m"))).alias("__ms"))
    extent = inside.groupBy("cluster").agg(F.first(chrom).alias(chrom), F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n_probes"))
    return extent.join(means, "cluster").select("cluster", chrom, "start", "end", ((F.col("start") + F.col("end")) / 2).alias("mid"), "n_probes", F.transform("__ms", lambda x: x["__m"]).alias(values))


def distance_penalty(df: DataFrame, lam0: float, decay: float = 1000.0, w: str = "w", floor: float = 0.0, chrom: str = "chr", pos: str = "pos", *ties: str) -> DataFrame:
    """``lam`` of the edge to the probe before: max(lam0 * median positive weight of the chromosome * exp(-gap / decay), floor)."""
    scale = df.where(F.col(w) > 0).groupBy(chrom).agg(F.percentile(w, 0.5).alias("__scale"))
    return with_gap(df, chrom, pos, *ties).join(scale, chrom, "left").withColumn("lam", F.greatest(F.lit(lam0) * F.coalesce("__scale", F.lit(1.0)) * F.exp(-F.col("gap") / decay), F.lit(floor))).drop("__scale")


def call_regions(df: DataFrame, min_probes: int = 3, min_effect: float = 0.05, tol: float = 1e-6, cluster: str | None = None, sw: str = "sw", swb: str = "swb", theta: str = "theta", by: tuple[str, ...] = ("chr",), pos: str = "pos", ties: tuple[str, ...] = (), cuts: DataFrame | None = None) -> DataFrame:
    """Segments of constant theta (and cluster) with their precision-weighted effect.

    ``sw`` is each probe's weight and ``swb`` weight times estimate.  Unclustered
    probes (-1) get keys of their own.  ``by`` may hold a replicate column before the chromosome.
    """
    along, whole = (pos, *ties), cuts is None
    d = scan.pieced(df, cuts, by[-1], pos)
    d = scan.with_running(d, {"__i": F.lit(1)}, by, along, whole).withColumn("__i", F.col("__i") - 1)
    seen = {"__theta": F.col(theta)}
    if cluster:
        d = d.withColumn("__k", F.when(F.col(cluster) < 0, -F.col("__i") - 1).otherwise(F.col(cluster)))
        seen["__kp"] = F.col("__k")
    d = scan.with_previous(d, seen, by, along, whole)
    new = F.abs(F.col(theta) - F.col("__theta")) > tol
    if cluster:
        new = new | (F.col("__k") != F.col("__kp"))
    runs = scan.with_running(d.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")), {"segment": F.col("__new")}, by, along, whole)
    g = runs.groupBy(*by, "segment").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n_probes"), F.sum(sw).alias("__w"), F.sum(swb).alias("__wb"), F.avg(theta).alias("theta"), F.min("__i").alias("probe_start"), F.max("__i").alias("probe_end"))
    g = g.where((F.col("n_probes") >= min_probes) & (F.col("__w") > 0)).withColumn("effect", F.col("__wb") / F.col("__w")).withColumn("se", F.sqrt(1 / F.col("__w")))
    return g.where(F.abs("effect") >= min_effect).select(*by, "start", "end", (F.col("end") - F.col("start") + 1).alias("width"), "n_probes", "effect", "se", (F.col("effect") / F.col("se")).alias("z"), "theta", "probe_start", "probe_end")


def index_range_effects(regions: DataFrame, fits: DataFrame, ties: tuple[str, ...] = (), cuts: DataFrame | None = None, chrom: str = "chr", pos: str = "pos", rows: int | None = None) -> DataFrame:
    """``regions`` (chr, ``probe_start``, ``probe_end``: places of probes on their chromosome, from 0) with ``effect, se`` over ``fits``.

    ``fits``: chr, pos, beta, se of the same probes in the same order.  Weights and weighted slopes are summed up along each
    chromosome, so a region is two lookups however many probes it has.  Null where no probe has weight.  Both lookups are over as many
    tasks as ``rows``, the number of ``fits`` or a bound of it (counted where it is not given), asks for: a join's own shuffle would hold more in a task as the table grows.
    """
    w = F.when(F.col("se") > 0, 1 / (F.col("se") * F.col("se"))).otherwise(0.0)
    d = scan.pieced(fits.withColumn("__w", w).withColumn("__wb", F.col("__w") * F.coalesce(F.col("beta"), F.lit(0.0))), cuts, chrom, pos)
    d = scan.with_running(d, {"__k": F.lit(1), "__sw": F.col("__w"), "__swb": F.col("__wb")}, (chrom,), (pos, *ties), cuts is None)
    sums = d.select(F.col(chrom).alias("c"), (F.col("__k") - 1).alias("at"), F.col("__sw").alias("w"), F.col("__swb").alias("wb"))
    sums = scan.dealt(sums, fits.count() if rows is None else rows, "c", "at")
    last, before = (sums.select(*(F.col(c).alias(f"__{k}_{c}") for c in sums.columns)) for k in ("last", "before"))
    out = regions.join(last, (F.col(chrom) == F.col("__last_c")) & (F.col("probe_end") == F.col("__last_at")))
    out = out.join(before, (F.col(chrom) == F.col("__before_c")) & (F.col("probe_start") - 1 == F.col("__before_at")), "left")
    w, wb = (F.col(f"__last_{c}") - F.coalesce(F.col(f"__before_{c}"), F.lit(0.0)) for c in ("w", "wb"))
    return out.select(*regions.columns, F.when(w > 0, wb / w).alias("effect"), F.when(w > 0, F.sqrt(1 / w)).alias("se"))


def call_blocks(df: DataFrame, posterior: str = "posterior", min_post: float = 0.80, min_clusters: int = 3, neutral: int = 1, chrom: str = "chr", cuts: DataFrame | None = None) -> DataFrame:
    """Maximal runs of one state other than the neutral one; doubtful clusters count as neutral.

    ``df``: chr, start, end and an array of state probabilities.  A block ends at
    its last cluster's end; its posterior is the mean of its state's.  ``cuts`` are positions of starts.
    """
    best = F.array_max(posterior)
    state = F.when(best >= min_post, F.array_position(posterior, best).cast("int") - 1).otherwise(neutral)
    d = scan.with_previous(scan.pieced(df.withColumn("state", state), cuts, chrom, "start"), {"__state": F.col("state")}, (chrom,), ("start", "end"), cuts is None)
    new = F.coalesce(F.col("state") != F.col("__state"), F.lit(True)).cast("int")
    runs = scan.with_running(d.withColumn("__new", new), {"run": F.col("__new")}, (chrom,), ("start", "end"), cuts is None)
    g = runs.where(F.col("state") != neutral).groupBy(chrom, "run", "state").agg(F.min("start").alias("start"), F.max(F.struct("start", "end"))["end"].alias("end"), F.count("*").alias("n_clusters"), F.avg(F.get(posterior, F.col("state"))).alias("posterior"))
    return g.where(F.col("n_clusters") >= min_clusters).select(chrom, "start", "end", (F.col("end") - F.col("start") + 1).alias("width"), "n_clusters", F.when(F.col("state") > neutral, "hyper").otherwise("hypo").alias("direction"), "posterior")


def interval_overlap(a: DataFrame, b: DataFrame, chrom: str = "chr", bin_size: int = BIN) -> DataFrame:
    """Pairs of intervals (``a_id, a_start, a_end`` and ``b_id, b_start, b_end``) that share a position.

    An equi-join on (chromosome, bin): each interval is listed in the bins it
    covers and a pair is reported only in the bin where its overlap begins, so
    no duplicates arise and nothing is compared across the genome.
    """
    x = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a_start") / bin_size), F.floor(F.col("a_end") / bin_size))))
    y = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("b_start") / bin_size), F.floor(F.col("b_end") / bin_size))))
    both = x.join(y, [chrom, "bin"]).where("a_start <= b_end and b_start <= a_end")
    return both.where(F.floor(F.greatest("a_start", "b_start") / bin_size) == F.col("bin")).drop("bin")


def interval_containment(inner: DataFrame, outer: DataFrame, chrom: str = "chr", bin_size: int = BIN) -> DataFrame:
    """Pairs where ``a`` lies within ``b``."""
    return interval_overlap(inner, outer, chrom, bin_size).where("a_start >= b_start and a_end <= b_end")


def points_in_intervals(points: DataFrame, intervals: DataFrame, chrom: str = "chr", pos: str = "pos", bin_size: int = BIN) -> DataFrame:
    """Points (``pos``) with the intervals (``b_start, b_end``) that hold them, ends included."""
    x = points.withColumn("bin", F.floor(F.col(pos) / bin_size))
    y = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("b_start") / bin_size), F.floor(F.col("b_end") / bin_size))))
    return x.join(y, [chrom, "bin"]).where(F.col(pos).between(F.col("b_start"), F.col("b_end"))).drop("bin")


def nearest(queries: DataFrame, features: DataFrame, chrom: str = "chr", near: int = 1000, close: int = 50) -> DataFrame:
    """Each query (``q_id, pos``) with its nearest feature (``f_id, pos``), ties to the lower position.

    One union and two ordered scans of a chromosome: the last feature before and
    the first after are carried along; ``within_near`` counts features by range.
    """
    u = queries.select(chrom, "pos", F.col("q_id"), F.lit(None).cast("long").alias("f_id"), F.lit(1).alias("kind")).unionByName(features.select(chrom, "pos", F.lit(None).cast("long").alias("q_id"), F.col("f_id"), F.lit(0).alias("kind")))
    w = Window.partitionBy(chrom).orderBy("pos", "kind", "f_id", "q_id")
    f = F.when(F.col("kind") == 0, F.struct(F.col("pos").alias("p"), F.col("f_id").alias("f")))
    back = Window.partitionBy(chrom).orderBy(*(F.desc(c) for c in ("pos", "kind", "f_id", "q_id")))  # the same order from the end: a running frame, not one that shrinks
    u = u.withColumn("before", F.last(f, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.last(f, True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    u = u.withColumn("within_near", F.sum((F.col("kind") == 0).cast("long")).over(Window.partitionBy(chrom).orderBy("pos").rangeBetween(-near, near)))
    q = u.where("kind = 1")
    left = F.col("before").isNotNull() & (F.col("after").isNull() | (F.col("pos") - F.col("before.p") <= F.col("after.p") - F.col("pos")))
    hit = F.when(left, F.col("before")).otherwise(F.col("after"))
    return q.select(chrom, "q_id", "pos", hit["f"].alias("nearest"), hit["p"].alias("nearest_pos"), F.abs(hit["p"] - F.col("pos")).alias("distance"), F.coalesce("within_near", F.lit(0)).alias("within_near")).withColumn("close", F.coalesce(F.col("distance") <= close, F.lit(False)))


def value_groups(df: DataFrame, by: str, value: str, threshold: float, name: str = "grp") -> DataFrame:
    """Order each ``by``'s values and start a new group (0..) where the step exceeds ``threshold``."""
    w = Window.partitionBy(by).orderBy(value, *[c for c in df.columns if c not in (by, value)])
    df = df.withColumn("__step", F.col(value) - F.lag(value).over(w))
    return df.withColumn(name, F.sum((F.coalesce(F.col("__step"), F.lit(0.0)) > threshold).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def gaphunter(df: DataFrame, by: str = "probe", value: str = "beta", threshold: float = 0.05, outlier_share: float = 0.01) -> DataFrame:
    """Probes with two or more value groups after groups below ``outlier_share`` of the samples are dropped."""
    g = value_groups(df, by, value, threshold).groupBy(by, "grp").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    kept = g.withColumn("total", total).where(F.col("n") >= F.col("total") * outlier_share)
    return kept.groupBy(by).agg(F.count("*").alias("n_groups"), F.max("n").alias("largest"), F.first("total").alias("n_samples")).where("n_groups >= 2")
