"""The pooled baseline, robust smoothing, dominance counts and scans in pieces against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import kernels
from panelforge.operators import genome, pooled, regions, scan, within

from test_operators import panel, sheet_of, simulated


def test_pooled_slopes_equal_least_squares(spark):
    m, sheet = simulated(3, 60)
    rng = np.random.default_rng(1)
    age, same = rng.normal(size=len(sheet)), np.ones(len(sheet))
    x = np.array([e for _, e, _ in sheet])
    for array in (None, [a for _, _, a in sheet]):
        other = pooled.others(len(sheet), np.column_stack([age, same]), array)
        assert other.shape[1] == (2 if array is None else 3)  # the constant covariate goes
        exposures = np.array([x, rng.permutation(x), rng.permutation(x)])
        slopes = pooled.Slopes(exposures, other)
        rows = pooled.fit_panel(panel(spark, m), slopes).orderBy("probe").collect()
        for k, e in enumerate(exposures):
            full = np.column_stack([e, other])
            want, rss, *_ = np.linalg.lstsq(full, m.T, rcond=None)
            assert np.allclose([r.betas[k] for r in rows], want[0], atol=1e-10)
        full = np.column_stack([x, other])
        assert slopes.df == len(x) - full.shape[1]
        left = m - (full @ np.linalg.lstsq(full, m.T, rcond=None)[0]).T
        assert np.allclose(slopes.variance(m), (left**2).sum(axis=1) / slopes.df)


def test_baseline_is_not_within_subject(spark):
    """Between subjects the exposure goes down, within subjects up: the baseline shows the former."""
    sheet = [(s, float(v) + 4 * s, "450K" if s < 15 else "EPIC") for s in range(30) for v in range(4)]
    s, x = np.array([v[0] for v in sheet]), np.array([v[1] for v in sheet])
    rng = np.random.default_rng(2)
    m = rng.normal(0, 0.05, (16, len(sheet))) + 0.2 * (x - 4 * s) - 0.9 * s
    found = regions.bumphunter(panel(spark, m, gap=100), sheet, cutoff=0.1).collect()
    assert len(found) == 1 and found[0]["value"] == pytest.approx(np.polyfit(x, m.mean(axis=0), 1)[0], abs=0.02) and found[0]["value"] < -0.1
    assert found[0]["l"] == 16 and found[0]["fwer"] is None
    design = within.Design(x.tolist(), s.tolist())
    assert design.fit(m)[0].mean() > 0.15


def test_array_term_takes_the_shift_out(spark):
    rng = np.random.default_rng(3)
    sheet = [(s, float(v) + (2.0 if s >= 15 else 0.0), "450K" if s < 15 else "EPIC") for s in range(30) for v in range(4)]
    late = np.array([s >= 15 for s, _, _ in sheet])
    m = rng.normal(0, 0.1, (20, len(sheet))) + 3.0 * late
    with_, without = (regions.bumphunter(panel(spark, m, gap=100), sheet, cutoff=0.2, adjust_array=a, n_perm=5) for a in (True, False))
    assert with_.count() == 0 and without.count() > 0
    with pytest.raises(ValueError):  # an exposure that is the array
        regions.bumphunter(panel(spark, m), [(s, float(s >= 15), a) for s, _, a in sheet], adjust_array=True)


def test_bumps_of_a_planted_run_and_of_short_clusters(spark):
    m, sheet = simulated(4, 60, effect=0.5, shift=0.0)
    m[50:55] += 2.0 * np.array([e for _, e, _ in sheet])  # in a cluster of five: not smoothed, no bump
    data = panel(spark, m, gap=100).withColumn("pos", F.when(F.col("probe") >= 50, F.col("pos") + 100_000).when(F.col("probe") >= 55, F.col("pos") + 200_000).otherwise(F.col("pos"))).where("probe < 55")
    found = regions.bumphunter(data, sheet, cutoff=0.25, n_perm=19)
    rows = found.collect()
    assert all(r["end"] < 5000 for r in rows)
    top = max(rows, key=lambda r: r["area"])
    assert top["l"] >= 30 and abs(top["value"] - 0.5) < 0.3 and top["fwer"] <= 0.1 and top["fwer_area"] <= 0.1
    assert {"effect_450K", "effect_EPIC"} <= set(found.columns)


def plain_lowess(x, y, near, rounds):
    """One point after another."""
    robust = np.ones(len(x))
    for turn in range(rounds + 1):
        fit = np.empty(len(x))
        for i in range(len(x)):
            far = min((max(x[i] - x[a], x[a + near - 1] - x[i]), a) for a in range(max(0, i - near + 1), min(i, len(x) - near) + 1))
            at = np.arange(far[1], far[1] + near)
            d = x[at] - x[i]
            w = (1 - np.minimum(np.abs(d) / np.abs(d).max(), 1) ** 3) ** 3 * robust[at]
            a = np.column_stack([np.ones(near), d])
            fit[i] = np.linalg.lstsq(a * np.sqrt(w)[:, None], y[at] * np.sqrt(w), rcond=None)[0][0]
        if turn < rounds:
            left = np.abs(y - fit)
            robust = np.clip(1 - (left / (6 * np.median(left))) ** 2, 0, None) ** 2
    return fit


def test_robust_local_regression():
    rng = np.random.default_rng(5)
    pos = np.sort(rng.choice(100_000, (3, 40), replace=False), axis=1)
    y = np.sin(pos / 2e4)[:, :, None] + rng.normal(0, 0.05, (3, 40, 2))
    y[1, 20, 0] += 8  # an outlier
    fit = kernels.lowess(pos, y, 15, pairs=1000)
    for k in range(3):
        for c in range(2):
            assert np.allclose(fit[k, :, c], plain_lowess(pos[k].astype(float), y[k, :, c], 15, 3), atol=1e-8)
    assert np.abs(fit[1, :, 0] - np.sin(pos[1] / 2e4)).max() < 0.2
    assert np.abs(kernels.lowess(pos, y, 15, rounds=0)[1, :, 0] - np.sin(pos[1] / 2e4)).max() > 0.5


def test_dominance_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    p = [(int(a), float(b)) for a, b in zip(rng.integers(1, 9, 600), np.round(rng.normal(size=600), 1))]
    q = [(int(a), float(b)) for a, b in zip(rng.integers(1, 11, 90), np.round(rng.normal(size=90), 1))]
    points, queries = (spark.createDataFrame(v, "l long, v double") for v in (p, q))
    got = sorted((r["l"], r["v"], r["hits"]) for r in pooled.dominance(points, queries, "l", "v", parts=7).collect())
    assert got == sorted((a, b, sum(x >= a and y >= b for x, y in p)) for a, b in q)
    assert pooled.dominance(points.limit(0), queries, "l", "v").agg(F.sum("hits")).first()[0] == 0


def test_dominance_ranges_grow_in_number_with_the_points(spark, monkeypatch):
    """Most points lie below all queries: ranges of the queries' values alone put them into one task."""
    monkeypatch.setattr(pooled, "RANGE_ROWS", 50)
    points = [(k % 3 + 1, k / 1000) for k in range(2000)]
    asked = [(k % 3 + 1, 1.9 + k / 100) for k in range(20)]
    p, q = spark.createDataFrame(points, "l long, v double"), spark.createDataFrame(asked, "l long, v double")
    dealt = []
    monkeypatch.setattr(pooled.hashing, "rising_range", lambda c, b, keep=pooled.hashing.rising_range: dealt.append(b) or keep(c, b))
    got = sorted((r["l"], r["v"], r["hits"]) for r in pooled.dominance(p, q, "l", "v", parts=7).collect())
    assert got == sorted((l, v, sum(a >= l and x >= v for a, x in points)) for l, v in asked)
    assert dealt and all(np.bincount(np.searchsorted(b, [v for _, v in points])).max() <= 100 for b in dealt)


def test_scans_in_pieces_equal_whole_ones(spark):
    rng = np.random.default_rng(7)
    rows = [(k, int(c), int(p), rng.normal(size=12).tolist(), float(t), 1.0, float(b)) for k, (c, p, t, b) in enumerate(zip(rng.choice([1, 1, 1, 1, 2, 3], 1500), rng.integers(0, 20_000, 1500), rng.integers(0, 2, 1500), rng.normal(size=1500)))]
    df = spark.createDataFrame(rows, "probe long, chr int, pos long, r array<double>, theta double, sw double, swb double").cache()
    cuts = scan.cut_points(df, 120)
    assert cuts is not None and cuts.count() >= 1 and scan.cut_points(df, 10_000) is None
    pieces = scan.pieced(df, cuts).where("chr = 1").groupBy(scan.PIECE).count().collect()
    assert len(pieces) > 5 and max(r["count"] for r in pieces) < 400

    def same(f, key=("chr", "pos", "probe")):
        a, b = (sorted(map(str, f(c).collect())) for c in (None, cuts))
        assert a == b and len(a) > 0

    same(lambda c: genome.gap_clusters(df, 15, "chr", "pos", "probe", cuts=c))
    same(lambda c: genome.comethylation_clusters(df, "r", 40, -0.1, "chr", "pos", "probe", cuts=c))
    clustered = genome.comethylation_clusters(df, "r", 40, -0.1, "chr", "pos", "probe")
    same(lambda c: genome.call_regions(clustered, 2, 0.0, cluster="cluster", ties=("probe",), cuts=c).select("chr", "start", "end", "n_probes", "probe_start", "probe_end", F.round("effect", 9).alias("e")))
    states = df.select("chr", F.col("pos").alias("start"), (F.col("pos") + F.col("probe")).alias("end"), F.when(F.col("theta") > 0, F.array(F.lit(0.1), F.lit(0.05), F.lit(0.85))).otherwise(F.array(F.lit(0.3), F.lit(0.4), F.lit(0.3))).alias("posterior"))
    same(lambda c: genome.call_blocks(states, min_clusters=2, cuts=c).select("chr", "start", "end", "n_clusters", "direction"))


def test_neighbour_correlation_is_linear_in_samples(spark):
    import time

    took = []
    for samples in (64, 512):
        df = spark.range(4000).select(F.col("id").alias("probe"), F.lit(1).alias("chr"), (F.col("id") * 10).alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.sin(i * F.col("id").cast("double"))).alias("r")).cache()
        df.count()
        genome.adjacent_correlation(df, "r", 100, "chr", "pos", "probe").agg(F.sum("rho")).first()
        began = time.time()
        genome.adjacent_correlation(df, "r", 100, "chr", "pos", "probe").agg(F.sum("rho")).first()
        took.append(time.time() - began)
    assert took[1] < 20 * took[0] + 2


def test_correlation_edges(spark):
    df = spark.createDataFrame([(0, 1, 0, [1.0, 2.0, 3.0]), (1, 1, 10, [2.0, 4.0, 6.0]), (2, 1, 20, [5.0, 5.0, 5.0]), (3, 1, 30, [3.0, 2.0, 1.0]), (4, 1, 5000, [1.0, 2.0, 3.0])], "probe long, chr int, pos long, r array<double>")
    rho = {r["probe"]: r["rho"] for r in genome.adjacent_correlation(df, "r", 100, "chr", "pos", "probe").collect()}
    assert rho[0] is None and rho[1] == pytest.approx(1.0) and rho[2] == 0 and rho[3] == 0 and rho[4] is None
    assert sheet_of(2)[0][0] == 0


def test_ragged_panels_are_refused(spark):
    df = spark.createDataFrame([(0, 1, 0, [1.0, 2.0, 3.0]), (1, 1, 10, [2.0, 4.0, 6.0, 1.0, 1.0])], "probe long, chr int, pos long, m array<double>").coalesce(1)
    with pytest.raises(Exception, match="one value a sample"):
        within.fit_panel(df, within.Design([0.0, 1.0, 2.0, 3.0], ["a", "a", "b", "b"])).collect()


def test_rows_of_one_position_share_a_cluster(spark):
    df = spark.range(600).select(F.lit(1).alias("chr"), (F.floor(F.col("id") / 3) * 7).alias("pos"), F.col("id").alias("probe")).repartition(5)
    for cuts in (None, scan.cut_points(df, 100)):
        got = genome.gap_clusters(df, 6, cuts=cuts).groupBy("pos").agg(F.countDistinct("cluster").alias("n"), F.min("cluster").alias("c")).collect()
        assert len(got) == 200 and all(r.n == 1 and r.c == r.pos // 7 + 1 for r in got)
