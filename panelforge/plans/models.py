"""Queries of the pooled baseline and the joint mixed model, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import blocks, genome, pooled, quantiles, regions, scan, within
from panelforge.panel import Panel
from panelforge.plans import stages
from panelforge.plans.oracles import GAPS, LONG, _r
from panelforge.plans.queries import N_PERM, r6
from panelforge.sources import adapters, tables

CUTOFF, SEED, BLOCK_PERM = 0.015, 1, 20


def _covariate() -> list[float]:
    return [float(i * i % 5) for i in range(adapters.DIMS)]


def _exposure() -> list[float]:
    return [e for _, e, _ in adapters.sheet_rows()]


def pooled_slopes(spark, d):
    """Slopes of every probe beside a covariate and the array, with their standard errors."""
    other = pooled.others(adapters.DIMS, np.array(_covariate()), [a for _, _, a in adapters.sheet_rows()])
    slopes = pooled.Slopes(np.array(_exposure()), other)
    f = pooled.fit_panel(adapters.panel_embeddings(spark, d), slopes)
    return f.select("probe", "chr", "pos", r6(F.col("betas")[0], "slope"))


def array_slopes(spark, d):
    """Each array's own pooled slopes."""
    fits = regions.array_slopes(adapters.panel_embeddings(spark, d), adapters.sheet_rows(), None, 6)
    out = None
    for array, f in fits.items():
        rows = f.select("probe", F.lit(array).alias("platform"), r6("slope", "slope"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bumphunter_raw(spark, d):
    """The baseline without smoothing, beside a covariate and the array: bumps, error rates of 200 replicates, effects by array."""
    b = regions.bumphunter(adapters.panel_embeddings(spark, d), adapters.sheet_rows(), covariates=np.array(_covariate()), adjust_array=True, smooth=False, cutoff=CUTOFF, n_perm=N_PERM, seed=SEED)
    numbers = ("value", "area", "fwer", "fwer_area", "p_value", "p_value_area", "effect_450K", "effect_EPIC")
    return b.select("chr", "start", "end", "l", "cluster_l", *(r6(c, c) for c in numbers))


def blockfinder_raw(spark, d):
    """Collapsed probes (at most 700 wide), their pooled bumps without smoothing and error rates."""
    b = regions.blockfinder(adapters.panel_embeddings(spark, d), adapters.sheet_rows(), widest=700, cutoff=0.004, smooth=False, n_perm=BLOCK_PERM, seed=SEED)
    return b.select("chr", "start", "end", "l", "cluster_l", *(r6(c, c) for c in ("value", "area", "fwer", "fwer_area")))


RHO = 0.25


def _panel(spark, d) -> Panel:
    c = _covariate()
    return Panel.of(adapters.panel_embeddings(spark, d), [{"subject": s, "exposure": e, "array": a, "c": c[i]} for i, (s, e, a) in enumerate(adapters.sheet_rows())])


def joint_probe_slopes(spark, d):
    """The mixed model's slopes and variances at a known correlation, joint (beside the array) and of each array."""
    stats, _ = stages.probe_model(_panel(spark, d), "exposure", "subject", "array", ["c"], weighted=False, robust=False, rho=RHO)
    return stats.select("fit", "probe", r6("beta", "beta"), r6("s2", "s2"))


def covariate_residuals(spark, d):
    """Residuals beside the covariate and the array, as three sums a probe that depend on their order."""
    r = stages.covariate_residuals(_panel(spark, d), "exposure", "subject", "array", ["c"])
    total = lambda f: F.aggregate(F.transform("m", f), F.lit(0.0), lambda s, x: s + x)
    return r.select("probe", r6(total(lambda x, i: x * x), "squares"), r6(total(lambda x, i: x * (i % 4)), "by_visit"), r6(total(lambda x, i: x * i), "by_place"))


def consensus_rho(spark, d):
    """Consensus correlation beside the exposure and the array, without and with sample weights."""
    p, s = adapters.panel_embeddings(spark, d), adapters.sheet_rows()
    x, k = [e for _, e, _ in s], [v for v, _, _ in s]
    extra = pooled.indicators([a for _, _, a in s])
    own = within.sample_weights(p, x, extra)
    rows = [("equal", within.consensus_correlation(p, k, exposure=x, covariates=extra)), ("weighted", within.consensus_correlation(p, k, exposure=x, covariates=extra, weights=own))]
    return spark.createDataFrame(rows, "weights string, rho double").select("weights", r6("rho", "rho"))


def quantile_table(spark, d):
    """Exact quantiles of line prices and of event values by counts in bins."""
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    rows = []
    for name, t, c in (("price", tables.table(spark, d, "lineitem"), "l_extendedprice"), ("value", tables.table(spark, d, "events"), "value"), ("size", tables.table(spark, d, "part"), "p_size")):
        rows += [(name, q, v) for q, v in zip(shares, quantiles.quantiles(t, c, shares))]
    return spark.createDataFrame(rows, "name string, share double, v double").select("name", "share", r6("v", "v"))


def single_chromosome_islands(spark, d):
    """All line items as one chromosome, scanned in pieces: gap clusters of order lines with their extents."""
    li = tables.table(spark, d, "lineitem").select(F.lit(1).alias("chr"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.round("l_quantity").cast("long").alias("q"))
    cuts = scan.cut_points(li, max(1000, li.count() // 24))
    c = genome.gap_clusters(li, 5, "chr", "pos", cuts=cuts)
    return c.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.sum("q").alias("q"))


def index_range_effects(spark, d):
    """Regions of the line-item track as ranges of places, their effects over another table of the same places by prefix sums."""
    t = genome.gap_clusters(adapters.track_lineitem(spark, d), 30)
    t = t.withColumn("theta", (F.floor(F.col("pos") / 60) % 3).cast("double"))
    reg = genome.call_regions(t, 2, 0.0, cluster="cluster").select("chr", "start", "probe_start", "probe_end")
    fits = t.select("chr", "pos", (F.col("n") - F.lit(1.5)).alias("beta"), F.sqrt(F.lit(1.0) / F.col("sw")).alias("se"))
    return genome.index_range_effects(reg, fits, rows=tables.table(spark, d, "lineitem").count()).select("chr", "start", r6("effect", "effect"), r6("se", "se"))


def blocks_default(spark, d):
    """Blocks with the reference's thresholds: every embedding gives four probes of 16 samples, a stretch of each chromosome rises."""
    e = adapters.panel_embeddings(spark, d)
    piece = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("m", k * 16 + 1, 16)))
    p = e.select("chr", "pos", "probe", piece.alias("k", "m")).select((F.col("probe") * 4 + F.col("k")).alias("probe"), "chr", (F.col("pos") * 4 + F.col("k") * 200).alias("pos"), "m")
    rising = F.transform("m", lambda x, i: x + 0.12 * (i % 4))
    p = p.withColumn("m", F.when(F.col("pos") % 100_000 >= 60_000, rising).otherwise(F.col("m")))
    sheet = adapters.sheet_rows()[:16]
    b, _, _ = blocks.find_blocks(p, sheet, rho_min=0.0)
    return b.select("chr", "start", "end", "width", "n_clusters", "direction", r6("posterior", "posterior"))


QUERIES = {f.__name__: f for f in (pooled_slopes, array_slopes, bumphunter_raw, blockfinder_raw, joint_probe_slopes, covariate_residuals, consensus_rho, quantile_table, single_chromosome_islands, index_range_effects, blocks_default)}

_SAMPLES = """smp AS (SELECT CAST(i AS INTEGER) AS sample, CAST(i % 4 AS DOUBLE) AS x, CAST((i * i) % 5 AS DOUBLE) AS c, CASE WHEN i < 40 THEN '450K' ELSE 'EPIC' END AS platform FROM range(64) t(i))"""


def _dealt(reps: int) -> str:
    """Exposures of all replicates (0 is the observed one): the sample in place r gets that of the r-th by MD5."""
    return f"""{_SAMPLES},
k AS (SELECT rep, sample, x, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5('{SEED}:' || rep || ':' || sample) END, sample) - 1 AS place FROM smp, range(0, {reps + 1}) r(rep)),
dealt AS (SELECT k.rep, s.sample, k.x, s.c, s.platform FROM k JOIN smp s ON s.sample = k.place)"""


# slope beside intercept, covariate and array: all columns less their means by array, then two normal equations
_TWO = """cen AS (SELECT rep, sample, x - avg(x) OVER w AS x, c - avg(c) OVER w AS c FROM dealt WINDOW w AS (PARTITION BY rep, platform)),
mom AS (SELECT rep, sum(x * x) AS xx, sum(x * c) AS xc, sum(c * c) AS cc FROM cen GROUP BY rep),
sl AS (SELECT m.rep, l.probe, l.chr, l.pos, (any_value(m.cc) * sum(d.x * l.value) - any_value(m.xc) * sum(d.c * l.value)) / (any_value(m.xx) * any_value(m.cc) - any_value(m.xc) * any_value(m.xc)) AS b
       FROM long l JOIN cen d ON d.sample = l.sample JOIN mom m ON m.rep = d.rep GROUP BY 1, 2, 3, 4)"""


def _bumps(cutoff: float, gap: int, reps: int) -> str:
    """Runs beyond the cut-off within gap clusters of every replicate, and the error rates of those of replicate 0."""
    return f"""gp AS (SELECT *, pos - lag(pos) OVER (PARTITION BY rep, chr ORDER BY pos, probe) AS gap FROM sl),
cl AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY rep, chr ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) AS cluster, CASE WHEN b >= {cutoff} THEN 1 WHEN b <= -{cutoff} THEN -1 ELSE 0 END AS side FROM gp),
ed AS (SELECT *, count(*) OVER (PARTITION BY rep, chr, cluster) AS cluster_l, lag(side) OVER w AS before, lag(cluster) OVER w AS cb FROM cl WINDOW w AS (PARTITION BY rep, chr ORDER BY pos, probe)),
rn AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> side OR cb <> cluster THEN 1 ELSE 0 END) OVER (PARTITION BY rep, chr ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) AS run FROM ed),
bp AS (SELECT rep, chr, run, min(pos) AS s, max(pos) AS e, avg(b) AS value, abs(sum(b)) AS area, count(*) AS l, any_value(cluster_l) AS cluster_l FROM rn WHERE side <> 0 GROUP BY 1, 2, 3),
nul AS (SELECT * FROM bp WHERE rep > 0),
rates AS (SELECT o.chr, o.run, count(DISTINCT CASE WHEN n.l >= o.l AND abs(n.value) >= abs(o.value) THEN n.rep END) / {float(reps)} AS fwer, count(DISTINCT CASE WHEN n.area >= o.area THEN n.rep END) / {float(reps)} AS fwer_area,
    count(*) FILTER (n.l >= o.l AND abs(n.value) >= abs(o.value)) / CAST((SELECT count(*) FROM nul) AS DOUBLE) AS p_value, count(*) FILTER (n.area >= o.area) / CAST((SELECT count(*) FROM nul) AS DOUBLE) AS p_value_area
  FROM bp o CROSS JOIN nul n WHERE o.rep = 0 GROUP BY 1, 2)"""


_ARRAY = """own AS (SELECT probe, chr, pos, platform, (avg(exposure * value) - avg(exposure) * avg(value)) / (avg(exposure * exposure) - avg(exposure) * avg(exposure)) AS b FROM long GROUP BY 1, 2, 3, 4)"""
# the same of each array's own samples, beside the covariate
_ARRAY_TWO = """ca AS (SELECT sample, platform, x - avg(x) OVER w AS x, c - avg(c) OVER w AS c FROM smp WINDOW w AS (PARTITION BY platform)),
ma AS (SELECT platform, sum(x * x) AS xx, sum(x * c) AS xc, sum(c * c) AS cc FROM ca GROUP BY platform),
own AS (SELECT l.probe, l.chr, l.pos, ca.platform, (any_value(cc) * sum(ca.x * l.value) - any_value(xc) * sum(ca.c * l.value)) / (any_value(xx) * any_value(cc) - any_value(xc) * any_value(xc)) AS b
        FROM long l JOIN ca ON ca.sample = l.sample JOIN ma ON ma.platform = ca.platform GROUP BY 1, 2, 3, 4)"""

# Whitened by 1 - sqrt((1 - rho) / (1 + (n - 1) rho)) of the subject's mean, then a variance of 1 - rho: subjects all have 4 visits.
_FITS = """fits AS (SELECT * FROM (VALUES ('joint'), ('450K'), ('EPIC')) f(fit)),
long2 AS (SELECT f.fit, l.probe, l.sample, l.platform, l.subject, l.exposure AS x, s.c, l.value AS y FROM long l JOIN smp s ON s.sample = l.sample JOIN fits f ON f.fit = 'joint' OR f.fit = l.platform),
gls AS (SELECT fit, probe, platform, sample, (x - {k} * avg(x) OVER w) / {q} AS x, (c - {k} * avg(c) OVER w) / {q} AS c, (y - {k} * avg(y) OVER w) / {q} AS y FROM long2 WINDOW w AS (PARTITION BY fit, probe, subject)),
mid AS (SELECT fit, probe, sample, x - avg(x) OVER w AS x, c - avg(c) OVER w AS c, y - avg(y) OVER w AS y, platform FROM gls WINDOW w AS (PARTITION BY fit, probe, platform)),
two AS (SELECT fit, probe, sum(x * x) AS xx, sum(x * c) AS xc, sum(c * c) AS cc, sum(x * y) AS xy, sum(c * y) AS cy, sum(y * y) AS yy, count(*) - 2 - count(DISTINCT platform) AS df FROM mid GROUP BY 1, 2),
sol AS (SELECT *, (cc * xy - xc * cy) / (xx * cc - xc * xc) AS b, (xx * cy - xc * xy) / (xx * cc - xc * xc) AS g FROM two)""".format(
    k=f"(1 - sqrt((1 - {RHO}) / (1 + 3 * {RHO})))", q=f"sqrt(1 - {RHO})")

ORACLES = {
    "index_range_effects": f"""WITH {GAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS i, (pos // 60) % 3 AS theta FROM clustered),
      e AS (SELECT *, CASE WHEN theta <> lag(theta) OVER w OR cluster <> lag(cluster) OVER w OR i = 0 THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY chr ORDER BY pos)),
      sg AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM e)
      SELECT chr, min(pos) AS "start", {_r('sum(sw * (n - 1.5)) / sum(sw)', 'effect')}, {_r('sqrt(1.0 / sum(sw))', 'se')} FROM sg GROUP BY chr, segment HAVING count(*) >= 2 AND sum(sw) > 0""",
    "joint_probe_slopes": f"WITH {LONG}, {_SAMPLES}, {_FITS} SELECT fit, probe, {_r('b', 'beta')}, {_r('(yy - b * xy - g * cy) / df', 's2')} FROM sol",
    "covariate_residuals": f"""WITH {LONG}, {_SAMPLES}, cl AS (SELECT l.probe, l.sample, s.c - avg(s.c) OVER w AS c, l.value - avg(l.value) OVER w AS y FROM long l JOIN smp s ON s.sample = l.sample WINDOW w AS (PARTITION BY l.probe, l.platform)),
      sl AS (SELECT probe, sum(c * y) / sum(c * c) AS g FROM cl GROUP BY 1), r AS (SELECT cl.probe, sample, y - g * c AS e FROM cl JOIN sl ON sl.probe = cl.probe)
      SELECT probe, {_r('sum(e * e)', 'squares')}, {_r('sum(e * (sample % 4))', 'by_visit')}, {_r('sum(e * sample)', 'by_place')} FROM r GROUP BY 1""",
    "quantile_table": "WITH s AS (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]) AS share), "
    + "t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(share AS DOUBLE) AS share, (SELECT list(CAST({c} AS DOUBLE) ORDER BY {c}) FROM {t} WHERE {c} IS NOT NULL) AS v FROM s" for n, t, c in (("price", "lineitem", "l_extendedprice"), ("value", "events", "value"), ("size", "part", "p_size")))
    + "), h AS (SELECT name, share, v, (len(v) - 1) * share AS h FROM t) "
    + f"SELECT name, share, {_r('v[CAST(floor(h) AS BIGINT) + 1] + (v[CAST(ceil(h) AS BIGINT) + 1] - v[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h))', 'v')} FROM h",
    "single_chromosome_islands": """WITH li AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS pos, count(*) AS n, sum(CAST(round(l_quantity) AS BIGINT)) AS q FROM lineitem GROUP BY 1),
      g AS (SELECT *, pos - lag(pos) OVER (ORDER BY pos) AS gap FROM li), c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
      SELECT CAST(cluster AS BIGINT) AS cluster, min(pos) AS "start", max(pos) AS "end", CAST(sum(n) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS q FROM c GROUP BY 1""",
    "pooled_slopes": f"WITH {LONG}, {_dealt(0)}, {_TWO} SELECT probe, chr, pos, {_r('b', 'slope')} FROM sl",
    "array_slopes": f"WITH {LONG}, {_ARRAY} SELECT probe, platform, {_r('b', 'slope')} FROM own",
    "bumphunter_raw": f"""WITH {LONG}, {_dealt(N_PERM)}, {_TWO}, {_bumps(CUTOFF, 300, N_PERM)}, {_ARRAY_TWO},
      eff AS (SELECT bp.chr, bp.run, avg(own.b) FILTER (platform = '450K') AS a, avg(own.b) FILTER (platform = 'EPIC') AS z FROM bp JOIN own ON own.chr = bp.chr AND own.pos BETWEEN bp.s AND bp.e WHERE bp.rep = 0 GROUP BY 1, 2)
      SELECT bp.chr, s AS "start", e AS "end", l, cluster_l, {_r('value', 'value')}, {_r('area', 'area')}, {_r('fwer', 'fwer')}, {_r('fwer_area', 'fwer_area')}, {_r('p_value', 'p_value')}, {_r('p_value_area', 'p_value_area')},
        {_r('eff.a', 'effect_450K')}, {_r('eff.z', 'effect_EPIC')}
      FROM bp JOIN rates ON rates.chr = bp.chr AND rates.run = bp.run JOIN eff ON eff.chr = bp.chr AND eff.run = bp.run WHERE bp.rep = 0""",
    "blockfinder_raw": f"""WITH {LONG}, {_dealt(BLOCK_PERM)},
      gc AS (SELECT probe, chr, pos, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos, probe) AS gap FROM panel),
      c0 AS (SELECT probe, chr, pos, sum(CASE WHEN gap IS NULL OR gap > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) AS c FROM gc),
      c1 AS (SELECT *, min(pos) OVER (PARTITION BY chr, c) AS lo, max(pos) OVER (PARTITION BY chr, c) AS hi FROM c0),
      c2 AS (SELECT probe, chr, pos, c, CASE WHEN hi - lo >= 700 THEN (pos - lo) * ((hi - lo + 1) // 700 + 1) // (hi - lo + 1) ELSE 0 END AS piece FROM c1),
      un AS (SELECT chr, c, piece, (min(pos) + max(pos)) // 2 AS mid FROM c2 GROUP BY 1, 2, 3),
      lc AS (SELECT un.chr, un.mid AS pos, dense_rank() OVER (ORDER BY un.chr, un.c, un.piece) AS probe, l.sample, avg(1 / (1 + pow(2, -l.value))) AS value
             FROM long l JOIN c2 ON c2.probe = l.probe JOIN un ON un.chr = c2.chr AND un.c = c2.c AND un.piece = c2.piece GROUP BY un.chr, un.c, un.piece, un.mid, l.sample),
      cen AS (SELECT rep, sample, x - avg(x) OVER (PARTITION BY rep) AS x FROM dealt),
      mom AS (SELECT rep, sum(x * x) AS xx FROM cen GROUP BY rep),
      sl AS (SELECT m.rep, l.probe, l.chr, l.pos, sum(d.x * l.value) / any_value(m.xx) AS b FROM lc l JOIN cen d ON d.sample = l.sample JOIN mom m ON m.rep = d.rep GROUP BY 1, 2, 3, 4),
      {_bumps(0.004, 250_000, BLOCK_PERM)}
      SELECT bp.chr, s AS "start", e AS "end", l, cluster_l, {_r('value', 'value')}, {_r('area', 'area')}, {_r('fwer', 'fwer')}, {_r('fwer_area', 'fwer_area')}
      FROM bp JOIN rates ON rates.chr = bp.chr AND rates.run = bp.run WHERE bp.rep = 0""",
}
