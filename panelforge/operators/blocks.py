"""Large-scale blocks: a three-state hidden Markov model over cluster effects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import kernels
from panelforge.functions.session import settled
from panelforge.operators import compare, genome, quantiles, scan, within

ROUNDS = 60
#: Clusters of a chromosome that one row of arrays holds.
PIECE_ROWS = 100_000


def _start(effects: DataFrame, length_scale: float) -> kernels.BlockModel:
    low, high = quantiles.quantiles(effects, "y", [0.05, 0.95])
    return kernels.first_model(low, effects.agg(F.stddev_pop("y")).first()[0], high, length_scale)


def _messages(operators: list[tuple], pi: np.ndarray) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """What enters and leaves every piece, from (chromosome, piece, operator) rows: prefix and suffix products of a chromosome's pieces."""
    out, of = {}, {}
    for chrom, piece, m in sorted(operators, key=lambda r: (str(r[0]), r[1])):
        of.setdefault(chrom, []).append((piece, m))
    for chrom, pieces in of.items():
        a, into = pi, []
        for _, m in pieces:
            into.append(a)
            a = a @ m
            a = a / a.sum()
        z, leave = np.ones(len(pi)), []
        for _, m in reversed(pieces):
            leave.append(z)
            z = m @ z
            z = z / z.max()
        out |= {(chrom, p): (x, y) for (p, _), x, y in zip(pieces, into, leave[::-1])}
    return out


def fit_blocks(effects: DataFrame, length_scale: float = 250_000, rounds: int = ROUNDS, tol: float = 1e-5, rows: int = PIECE_ROWS) -> tuple[kernels.BlockModel, DataFrame]:
    """The fitted model and ``effects`` (chr, mid, start, end, y, se) with ``posterior``.

    A row of arrays holds a piece of a chromosome, ``rows`` clusters or so.  Where a chromosome has several, a round first takes
    one 3 x 3 operator a piece to the driver, whose prefix and suffix products say what enters and leaves each piece; then
    pieces are independent.  Four sums a state of each piece reach the driver, no cluster does.
    """
    model = _start(effects, length_scale)
    names = effects.columns
    cuts = scan.cut_points(effects, rows, "chr", "mid")
    placed = scan.with_previous(scan.pieced(effects, cuts, "chr", "mid"), {"__last": F.col("mid")}, ("chr",), ("mid", "start", "end"), cuts is None)
    ordered = F.array_sort(F.collect_list(F.struct("mid", "start", "end", (F.col("mid") - F.col("__last")).cast("double").alias("gap"), F.struct(*names).alias("row"))))

    def column(name: str):
        return F.transform("c", lambda x: x["row"][name]).alias(f"c_{name}")

    packed = placed.groupBy("chr", F.col(scan.PIECE).alias("piece")).agg(ordered.alias("c"))
    packed = settled(packed.select("chr", "piece", F.transform("c", lambda x: x["gap"]).alias("c_gap"), *map(column, names)))
    several = cuts is not None

    def steps(row, by: kernels.BlockModel) -> tuple[np.ndarray, np.ndarray]:
        gap = np.array([np.nan if g is None else g for g in row.c_gap], float)
        return kernels.emissions(np.asarray(row.c_y, float), np.asarray(row.c_se, float), by), kernels.stays(gap, by.length_scale)

    def messages_of(by: kernels.BlockModel) -> dict:
        if not several:
            return {}

        def operators(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([[str(r.chr), r.piece, *kernels.piece_operator(*steps(r, by), by.pi)[0].ravel()] for r in pdf.itertuples()], columns=["chr", "piece", *(f"m{k}" for k in range(9))])

        found = packed.select("chr", "piece", "c_gap", "c_y", "c_se").mapInPandas(operators, "chr string, piece int, " + ", ".join(f"m{k} double" for k in range(9))).collect()
        return _messages([(r[0], r[1], np.array(r[2:], float).reshape(3, 3)) for r in found], by.pi)

    def posterior(row, by: kernels.BlockModel, known: dict) -> tuple[np.ndarray, float]:
        entering, leaving = known.get((str(row.chr), row.piece), (by.pi, np.ones(3)))
        return kernels.piece_posterior(*steps(row, by), by.pi, entering, leaving)

    before, known = -np.inf, {}
    for k in range(rounds):
        now, known = model, messages_of(model)

        def sums(batches: Iterator[pd.DataFrame], now=now, known=known) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.itertuples():
                    g, ll = posterior(row, now, known)
                    out.append([ll, *kernels.sufficient(g, np.asarray(row.c_y, float), np.asarray(row.c_se, float)).reshape(-1)])
                yield pd.DataFrame(out, columns=["ll", *(f"s{i}" for i in range(12))])

        found = packed.select("chr", "piece", "c_gap", "c_y", "c_se").mapInPandas(sums, "ll double, " + ", ".join(f"s{i} double" for i in range(12))).collect()
        total = np.array([list(r) for r in found], dtype=float).sum(axis=0)
        used, model = model, kernels.maximise(model, total[1:].reshape(4, 3))
        model.loglik, model.rounds = float(total[0]), k + 1
        if kernels.settled(before, model.loglik, tol):
            break
        before = model.loglik
    final, order = kernels.ordered_states(model)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["posterior"] = [posterior(row, used, known)[0][:, order].tolist() for row in pdf.itertuples()]
            yield pdf[["chr", "piece", "c_gap", *(f"c_{n}" for n in names), "posterior"]]

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    decoded = packed.mapInPandas(decode, f"{types}, posterior array<array<double>>")
    out = decoded.select(F.explode(F.arrays_zip(*(f"c_{n}" for n in names), "posterior")).alias("r"))
    return final, out.select(*(F.col(f"r.c_{n}").alias(n) for n in names), "r.posterior")


def cluster_effects(clusters: DataFrame, design: within.Design, values: str = "m", shrink: bool = True) -> DataFrame:
    """``cluster, chr, start, end, mid, n_probes, y, se`` of collapsed profiles."""
    keep = ("cluster", "chr", "start", "end", "mid", "n_probes")
    fits = within.fit_panel(clusters, design, values, keep)
    fits = within.with_z(within.moderate(fits, design.df) if shrink else fits.withColumn("s2_post", F.col("s2")), design.unit)
    return fits.select(*keep, F.col("beta").alias("y"), "se")


def find_blocks(panel: DataFrame, sheet: list[tuple[int, float, str]], *, max_gap: float = 1500, rho_min: float = 0.20, length_scale: float = 250_000, min_post: float = 0.80, min_clusters: int = 3, min_fit_clusters: int = 200, project: bool = True, covariates=None) -> tuple[DataFrame, DataFrame, kernels.BlockModel]:
    """(blocks, cluster effects, model): cluster, collapse, fit, decode; per-array effects where an array's design is identified.

    Fewer than ``min_fit_clusters`` clusters is an error.  ``project`` chooses whether
    the design is taken out of the residuals that clusters are built from.  Chromosomes beyond a task's size are scanned in
    pieces.  ``agreement`` says how the arrays' effects of the blocks agree.
    """
    exposure, subject = [e for _, e, _ in sheet], [s for s, _, _ in sheet]
    design = within.Design(exposure, subject, covariates)
    resid = within.residual_panel(panel, design, project=project)
    cuts = scan.cut_points(panel.select("chr", "pos"))
    clustered = genome.comethylation_clusters(resid, "resid", max_gap, rho_min, "chr", "pos", "probe", cuts=cuts)
    collapsed = settled(genome.collapse_clusters(clustered, "m"))
    n = collapsed.count()
    if n < min_fit_clusters:
        raise ValueError(f"{n} clusters; at least {min_fit_clusters} are needed")
    model, effects = fit_blocks(cluster_effects(collapsed, design), length_scale)
    blocks = genome.call_blocks(effects, "posterior", min_post, min_clusters, model.neutral, cuts=scan.cut_points(effects, scan.ROWS, "chr", "start"))
    for array in sorted({a for _, _, a in sheet}):
        at = [i for i, s in enumerate(sheet) if s[2] == array]
        own = within.Design([exposure[i] for i in at], [subject[i] for i in at], within.rows_of(covariates, at))
        if own.subjects >= 3 and own.identified and own.df > 0:
            part = within.take(collapsed, "m", at)
            fits = cluster_effects(part, own).select("chr", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("cluster").alias("a_id"), F.col("y").alias("beta"), "se")
            inside = genome.interval_containment(fits, blocks.select("chr", F.struct("start", "direction").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end")))
            pooled = compare.ivw(inside, ["chr", "b_start"]).select("chr", F.col("b_start").alias("start"), F.col("effect").alias(f"effect_{array}"))
            blocks = blocks.join(pooled, ["chr", "start"], "left")
    return blocks, effects, model


def agreement(blocks: DataFrame) -> dict:
    """``cross_array_r, sign_concordance, n`` of the two arrays' block effects: r over pairs that are finite (more than 2), signs over all rows.

    Nulls where there are no two arrays or no blocks.
    """
    pair = sorted(c for c in blocks.columns if c.startswith("effect_"))
    if len(pair) != 2:
        return {"cross_array_r": None, "sign_concordance": None, "n": 0}
    a, b = (F.col(c).cast("double") for c in pair)
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    same = F.coalesce((F.signum(a) == F.signum(b)).cast("double"), F.lit(0.0))
    row = blocks.agg(F.sum(ok.cast("long")).alias("n"), F.corr(F.when(ok, a), F.when(ok, b)).alias("r"), F.avg(same).alias("s")).first()
    return {"cross_array_r": row["r"] if (row["n"] or 0) > 2 else None, "sign_concordance": row["s"], "n": row["n"] or 0}
