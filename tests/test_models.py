"""The joint mixed model, REML correlation, exact quantiles, guards, harmonisation and pieces of chromosomes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import panel, sheet_of, simulated

from panelforge.functions import kernels
from panelforge.operators import blocks, genome, inference, quality_control, quantiles, regions, within
from panelforge.panel import Panel
from panelforge.plans import stages


def samples_of(sheet, **more):
    return [{"subject": s, "exposure": e, "array": a, **{k: v[i] for k, v in more.items()}} for i, (s, e, a) in enumerate(sheet)]


def test_array_shift_does_not_pass_for_an_effect(spark):
    """Later arrays have more exposure: without the array's term the shift would be the slope."""
    rng = np.random.default_rng(0)
    sheet = [(s, float(v) + (1.5 if s >= 15 else 0.0), "450K" if s < 15 else "EPIC") for s in range(30) for v in range(4)]
    late = np.array([s >= 15 for s, _, _ in sheet])
    m = rng.normal(0, 0.3, (150, len(sheet))) + rng.normal(0, 0.3, (150, 30))[:, [s for s, _, _ in sheet]] + 2.0 * late
    p = Panel.of(panel(spark, m), samples_of(sheet))
    stats, summary = stages.probe_model(p, "exposure", "subject", "array", weighted=False, robust=False)
    joint = np.array([r.beta for r in stats.where("fit = 'joint'").collect()])
    assert abs(joint.mean()) < 0.02
    row = {r.fit: r for r in summary.collect()}
    assert row["joint"].n_fdr05 <= 3 and 0.3 < row["joint"].within_subject_cor < 0.65 and row["450K"].n_samples == 60
    assert abs(within.consensus_correlation(p.data, [s for s, _, _ in sheet])) > 0.8  # what ignoring the design would give


def plain_reml(y, x, z, weights):
    """-2 log REML at a correlation, from matrices as they are defined."""

    def deviance(r):
        lam = r / (1 - r)
        v = np.diag(1 / weights) + lam * z @ z.T
        vi = np.linalg.inv(v)
        xvx = x.T @ vi @ x
        res = y - x @ np.linalg.solve(xvx, x.T @ vi @ y)
        return (len(y) - x.shape[1]) * math.log(res @ vi @ res) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1]

    grid = np.linspace(-0.1, 0.98, 400)
    k = int(np.argmin([deviance(r) for r in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    for _ in range(200):
        p, q = a + (b - a) * 0.382, a + (b - a) * 0.618
        a, b = (a, q) if deviance(p) < deviance(q) else (p, b)
    return (a + b) / 2


def test_reml_equals_plain_optimiser():
    rng = np.random.default_rng(1)
    sheet = sheet_of(10)
    s, e = np.array([v[0] for v in sheet]), np.array([v[1] for v in sheet])
    z, weights = np.eye(10)[s], rng.uniform(0.5, 2, len(s))
    x = np.column_stack([np.ones(len(s)), e, rng.normal(size=len(s)), s >= 5])
    m = rng.normal(size=(50, len(s))) + rng.uniform(0, 1.5, (50, 1)) * rng.normal(size=(50, 10))[:, s] + 3.0 * (s >= 5)
    for w in (np.ones(len(s)), weights):
        got = within.BlockREML(s.tolist(), x, w).of(m)
        want = np.array([plain_reml(y, x, z, w) for y in m])
        inner = (want > -0.09) & (want < 0.97)
        assert inner.sum() > 30 and np.abs(got - want)[inner].max() < 1e-6


def test_consensus_uses_the_design_and_trims(spark):
    rng = np.random.default_rng(2)
    sheet = sheet_of()
    s = np.array([v[0] for v in sheet])
    m = rng.normal(size=(300, len(s))) + 0.7 * rng.normal(size=(300, 30))[:, s]
    shifted = m + 5.0 * (s >= 15)
    array = np.array([[float(k >= 15)] for k in s])
    a, b = (within.consensus_correlation(panel(spark, v), s.tolist(), exposure=[v[1] for v in sheet], covariates=array) for v in (m, shifted))
    assert a == pytest.approx(b, abs=1e-9) and abs(a - 0.49 / 1.49) < 0.05
    assert within.consensus_correlation(panel(spark, m[:, :30]), list(range(30))) == 0.0


def test_gls_p_takes_the_prior_freedom(spark):
    m, sheet = simulated(6, 300, effect=0.0)
    args = ([e for _, e, _ in sheet], [s for s, _, _ in sheet])
    rows = within.fit_gls(panel(spark, m), *args, rho=0.5).collect()
    prior = within.prior_from(within.fit_gls(panel(spark, m), *args, rho=0.5).select("s2"), 118)
    from panelforge.functions import special

    free = min(118 + prior[0], 118 * 300)
    for r in rows[:20]:
        assert r.p == pytest.approx(special.t_two_sided(r.t, free), rel=1e-6)
    with pytest.raises(ValueError):
        within.fit_gls(panel(spark, m), [float(a == "EPIC") for _, _, a in sheet], args[1], covariates=np.array([[float(a == "EPIC")] for _, _, a in sheet]), rho=0.1)


@pytest.mark.parametrize("few", [20_000, 3])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=400), rng.normal(size=300) * 1e-9, np.full(200, 0.25), [1e18, -1e18, 5e-324]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(4)
    q = [0, 0.05, 0.3, 0.5, 0.77, 0.999, 1]
    assert np.allclose(quantiles.quantiles(df, "v", q), np.quantile(v, q), rtol=1e-12, atol=0)
    cut = int(0.15 * len(v))
    assert quantiles.trimmed_mean(df, "v", 0.15) == pytest.approx(np.sort(v)[cut:-cut].mean(), rel=1e-9)
    assert quantiles.quantiles(df.limit(0), "v", [0.5]) == [None] and quantiles.trimmed_mean(df.limit(0), "v", 0.1) is None
    assert quantiles.quantiles(spark.createDataFrame([(7.0,)] * 5, "v double"), "v", [0.1, 0.9]) == [7.0, 7.0]


def test_guards(spark):
    inf, nan = float("inf"), float("nan")
    beta = spark.createDataFrame([(0.1,), (0.9,), (inf,), (-inf,), (nan,), (None,)], "v double")
    assert quality_control.is_beta(beta, "v") and not quality_control.is_beta(beta.union(spark.createDataFrame([(1.5,)], "v double")), "v")
    assert quality_control.varying(beta, []) == []
    p = spark.createDataFrame([(0.01,), (0.5,), (nan,), (None,)], "p double")
    out = {str(r.p): r.fdr for r in inference.bh(p).collect()}
    assert out["0.01"] == pytest.approx(0.02) and out["nan"] is None and out["None"] is None
    line = spark.createDataFrame([(0.05, 0.01), (0.05, 0.0), (0.04, 0.006), (0.2, 0.01)], "p_fwer double, p_fwer_mcse double")
    assert inference.borderline(line).first()[0] == 2
    cn = spark.createDataFrame([("a", "X", 13.0), ("b", "Y", 9.0), ("c", "X", 12.0), ("c", "Y", 12.5)], "sample string, chr string, cn double")
    assert {r["sample"]: r.predicted_sex for r in quality_control.predict_sex(cn).collect()} == {"a": None, "b": None, "c": "M"}
    qc = spark.createDataFrame([("a", 9000.0, 9000.0, None), ("b", 9000.0, 9000.0, 0.001), ("c", None, None, 0.001), ("d", 100.0, 100.0, 0.001), ("e", 9000.0, 9000.0, 0.5)], "sample string, meth double, unmeth double, detp double")
    assert {r["sample"]: (r.sample_fail, r.reason) for r in quality_control.sample_qc(qc).collect()} == {"a": (True, "no detection p"), "b": (False, None), "c": (True, "no intensity"), "d": (True, "low intensity"), "e": (True, "detection")}


def test_harmonised_rows_have_one_value_a_scan(spark):
    ann = spark.createDataFrame([(f"cg{k}", "chr1", k) for k in range(6)], "probe string, chr string, pos long")

    def scan(samples, missing=()):
        return spark.createDataFrame([(s, f"cg{k}", 8000.0 + 100 * k + len(s), 8000.0, 0.001) for s in samples for k in range(6) if (s, k) not in missing], "sample string, probe string, meth double, unmeth double, detp double")

    p, qc, _ = stages.harmonise(scan(["b", "aa", "ccc"], {("aa", 2)}), ann)
    rows = {r.probe: r.m for r in p.collect()}
    assert all(len(m) == 3 for m in rows.values()) and rows["cg2"][0] is None and None not in rows["cg3"]
    assert [x for x in rows["cg2"][1:]] == sorted(rows["cg2"][1:])  # the order of names: aa, b, ccc
    # one name on two arrays is two scans
    both = {"450K": scan(["s", "t"]), "EPIC": scan(["s"], {("s", 4)})}
    sheet = spark.createDataFrame([("s", "M", "450K"), ("s", "F", "EPIC")], "sample string, sex string, array string")
    p, qc, audit = stages.harmonise_arrays(both, ann, sheet=sheet)
    assert qc.count() == 3 and {(r["sample"], r["array"]): r.sex for r in qc.collect()} == {("s", "450K"): "M", ("t", "450K"): None, ("s", "EPIC"): "F"}
    rows = p.collect()
    assert {r.probe for r in rows} == {f"cg{k}" for k in (0, 1, 2, 3, 5)}
    assert all(r.samples == ["s", "s", "t"] and r.scanned == ["450K", "EPIC", "450K"] and len(r.m) == 3 for r in rows)
    with pytest.raises(Exception, match="a probe twice"):
        stages.harmonise(scan(["a", "b"]).union(scan(["a"])), ann)[0].collect()


def test_harmonised_rows_of_many_samples_hold_what_is_there(spark):
    """20,000 samples of 4 probes each: 4 of 20,000 places a row are filled, so only rows without places are small."""
    n = 20_000
    li = spark.range(n * 4).select(F.concat(F.lit("s"), F.lpad((F.col("id") % n).cast("string"), 5, "0")).alias("sample"), ((F.col("id") % n + F.floor(F.col("id") / n)) % n).alias("probe"), (8000.0 + F.col("id") % 100).alias("meth"), F.lit(8000.0).alias("unmeth"), F.lit(0.001).alias("detp"))
    ann = spark.range(n).select(F.col("id").alias("probe"), F.lit("chr1").alias("chr"), F.col("id").alias("pos"))
    p, _, _ = stages.harmonise(li, ann, bind=False)
    row = p.agg(F.count("*"), F.sum(F.size("held")), F.max(F.size("held"))).first()
    assert tuple(row) == (n, 4 * n, 4)
    assert [x.ordinal for x in p.where("probe = 7").first().held] == [4, 5, 6, 7]
    bound = stages.harmonise(li, ann)[0].where("probe in (0, 7, 19999)").collect()
    assert {r.probe: [i for i, x in enumerate(r.m) if x is not None] for r in bound} == {0: [0, n - 3, n - 2, n - 1], 7: [4, 5, 6, 7], 19999: [n - 4, n - 3, n - 2, n - 1]} and all(len(r.m) == n for r in bound)
    with pytest.raises(ValueError):
        stages.harmonise_arrays({"450K": li}, ann, mixture=True, bind=False)


def test_background_and_dyes(spark):
    """Two channels of planted background and brightness agree after correction."""
    rng = np.random.default_rng(4)
    rows, oob, norm = [], [], []
    for s, (bg, bright) in {"a": ((200.0, 900.0), 1.0), "b": ((500.0, 300.0), 0.6)}.items():
        truth = rng.exponential(4000, 2000)
        for k in range(2000):
            meth = truth[k] + rng.normal(bg[0], 30)
            unmeth = (truth[k] + rng.normal(bg[1] / bright, 30 / bright)) * bright
            rows.append((s, f"p{k}", float(meth), float(unmeth), None, float(truth[k])))
        oob += [(s, c, float(v)) for c, m in zip(("Grn", "Red"), bg) for v in rng.normal(m, 30, 800)]
        norm += [(s, c, float(v)) for c, m in (("Grn", 8000.0), ("Red", 8000.0 * bright)) for v in rng.normal(m, 50, 50)]
    scans = spark.createDataFrame(rows, "sample string, probe string, meth double, unmeth double, channel string, truth double")
    out = quality_control.background_corrected(scans, spark.createDataFrame(oob, "sample string, channel string, intensity double"), spark.createDataFrame(norm, "sample string, channel string, intensity double"))
    got = out.select("sample", "truth", "meth", "unmeth").toPandas()
    big = got[got.truth > 500]
    assert (got.meth > 0).all() and (got.unmeth > 0).all()
    assert np.abs(np.log(big.meth / big.unmeth)).median() < 0.06 and np.abs(big.meth - 15 - big.truth).median() < 60
    raw = scans.toPandas()
    assert np.abs(np.log(raw.meth / raw.unmeth)).median() > 0.1
    z = np.array([-40.0, -6.0, -2.5, -1.5, 0.0, 3.0, 20.0])
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame({"z": z}))
    got = np.array([r[0] for r in frame.select(quality_control.excess_of_normal(F.col("z"))).collect()])
    want = [v + math.exp(-v * v / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-v / math.sqrt(2))) if v > -30 else 1 / 40 - 2 / 40**3 for v in z]
    assert np.allclose(got, want, rtol=2e-5)


def test_posteriors_of_pieces_equal_whole_ones(spark):
    rng = np.random.default_rng(7)
    y, se = rng.normal(0, 0.05, 700), rng.uniform(0.02, 0.08, 700)
    y[200:300] += 0.3
    rows = [(1 if i < 600 else 2, float(i * 90_000), i * 90_000, i * 90_000 + 10, float(y[i]), float(se[i])) for i in range(700)]
    df = spark.createDataFrame(rows, "chr int, mid double, start long, end long, y double, se double").repartition(3)
    whole, a = blocks.fit_blocks(df)
    cut, b = blocks.fit_blocks(df, rows=70)
    assert np.allclose(whole.mu, cut.mu, atol=1e-10) and whole.loglik == pytest.approx(cut.loglik, rel=1e-10) and whole.rounds == cut.rounds
    pa_, pb = (np.array([r.posterior for r in v.orderBy("mid").collect()]) for v in (a, b))
    assert np.allclose(pa_, pb, atol=1e-9)


def test_piece_operator_carries_the_likelihood():
    rng = np.random.default_rng(8)
    model = kernels.BlockModel(np.array([-0.2, 0.0, 0.2]), np.array([0.1, 0.05, 0.1]), np.array([0.1, 0.8, 0.1]), 1000.0)
    y, se, pos = rng.normal(0, 0.2, 37), rng.uniform(0.01, 0.1, 37), np.cumsum(rng.integers(1, 900, 37)).astype(float)
    g, ll = kernels.forward_backward(y, se, pos, model)
    b, stay = kernels.emissions(y, se, model), kernels.stays(np.append(np.nan, np.diff(pos)), 1000.0)
    m, log = kernels.piece_operator(b, stay, model.pi)
    assert log + math.log((model.pi @ m).sum()) == pytest.approx(ll, rel=1e-12)


def test_block_agreement(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.3, 0.1), (-0.2, 0.4), (0.5, 0.9), (0.4, None)], "effect_450K double, effect_EPIC double")
    got = blocks.agreement(df)
    assert got["n"] == 4 and got["cross_array_r"] == pytest.approx(np.corrcoef([0.1, 0.3, -0.2, 0.5], [0.2, 0.1, 0.4, 0.9])[0, 1]) and got["sign_concordance"] == pytest.approx(0.6)
    assert blocks.agreement(df.limit(0))["cross_array_r"] is None


def test_both_nulls_and_prefix_effects(spark):
    m, sheet = simulated(9, 120)
    found, record = regions.find_regions(panel(spark, m), sheet, rho_min=-1.0, lam=1.0, n_perm=9, scheme="both")
    rows = found.collect()
    assert {"p_fwer_within", "p_fwer_within_mcse", "p_fwer_naive", "p_fwer_naive_mcse"} <= set(found.columns)
    assert all(r.p_fwer == r.p_fwer_within for r in rows) and record["null_q95_within"] >= 0 and "null_q95_naive" in record
    for array in ("450K", "EPIC"):
        at = [i for i, s in enumerate(sheet) if s[2] == array]
        own = within.Design([sheet[i][1] for i in at], [sheet[i][0] for i in at])
        beta, s2 = own.fit(m[:, at])
        post = within.moderate_array(s2, own.df)
        w = 1 / (post * own.unit)
        for r in rows:
            k = slice(r.probe_start, r.probe_end + 1)
            assert r[f"effect_{array}"] == pytest.approx((w[k] * beta[k]).sum() / w[k].sum(), rel=1e-6) and r[f"se_{array}"] == pytest.approx(math.sqrt(1 / w[k].sum()), rel=1e-6)


def test_replicates_equal_their_own_designs():
    m, sheet = simulated(10, 40)
    subject = [s for s, _, _ in sheet]
    age = np.random.default_rng(1).normal(size=(len(sheet), 1))
    at = [i for i, s in enumerate(sheet) if s[0] % 2]
    designs = [(0, within.Design([e for _, e, _ in sheet], subject, age), None), (1, within.Design(inference.permuted_exposures(sheet, 1, 1, True), subject, age), None), (2, within.Design([sheet[i][1] for i in at], [subject[i] for i in at], age[at]), np.array(at))]
    r = inference.Replicates(subject, designs)
    beta, s2 = r.fit(m)
    for j, (_, d, cols) in enumerate(designs):
        b, v = d.fit(m if cols is None else m[:, cols])
        assert np.allclose(beta[:, j], b, atol=1e-10) and np.allclose(s2[:, j], v, rtol=1e-9)
    assert genome.BIN > 0


@pytest.mark.parametrize("lam0", [0.3, 40.0])
def test_track_in_pieces_equals_the_whole_one(spark, lam0):
    """Short reach: neighbours settle a piece; long reach: pieces must look further, to the ends at last."""
    rng = np.random.default_rng(11)
    n = 1500
    pos = np.cumsum(rng.integers(1, 400, n))
    beta = np.repeat(rng.normal(size=30), 50) + rng.normal(0, 0.3, n)
    se = rng.uniform(0.1, 0.6, n)
    se[::97] = 0.0
    rows = [(i, 1 if i < 1300 else 2, int(pos[i]), float(beta[i]), float(se[i])) for i in range(n)]
    fits = spark.createDataFrame(rows, "probe long, chr int, pos long, beta double, se double").repartition(3)
    whole = inference.tracks(fits, lam0, 300.0).orderBy("probe").toPandas()
    parts = inference.tracks_in_pieces(fits, lam0, 300.0, rows=60).orderBy("probe").toPandas()
    assert np.allclose(whole.theta, parts.theta, atol=1e-8) and np.allclose(whole.w, parts.w)
    assert set(whole.columns) == set(parts.columns)


def test_track_brackets_hold_the_chain():
    rng = np.random.default_rng(12)
    y, w, lam = rng.normal(size=400), rng.uniform(0.5, 2, 400), rng.uniform(0.01, 0.6, 399)
    x = kernels.tv_solve(y, w, lam)
    lower, upper = kernels.tv_bracket(y[100:300], w[100:300], lam[100:299], (lam[99], lam[299]))
    assert (lower <= x[100:300] + 1e-9).all() and (x[100:300] <= upper + 1e-9).all()
    assert np.allclose(lower[60:140], upper[60:140])


def test_replicates_of_large_chromosomes_go_through_pieces(spark):
    m, sheet = simulated(13, 300)
    subject = [s for s, _, _ in sheet]
    data = panel(spark, m).withColumn("chr", F.when(F.col("probe") < 260, 1).otherwise(2))
    reps = inference.Replicates(subject, [(k, within.Design(inference.permuted_exposures(sheet, k, 1, True), subject), None) for k in (3, 4, 7)])
    rows = lambda d: sorted((r["rep"], r["chr"], r["start"], r["end"], round(r["z"], 6)) for r in d.collect())
    whole = rows(reps.regions(data, 0.3, 1000.0, 2, 0.0, chunk=2))
    assert whole == rows(reps.regions(data, 0.3, 1000.0, 2, 0.0, chunk=2, rows=70)) and {r[0] for r in whole} == {3, 4, 7}


def planted_mixture(rng, n, a):
    kind = rng.choice(3, n, p=[0.45, 0.1, 0.45])
    return np.where(kind == 0, rng.beta(*a[0], n), np.where(kind == 1, rng.beta(*a[1], n), rng.beta(*a[2], n)))


def test_second_kind_lies_on_the_scale_of_the_first(spark):
    from panelforge.operators import normalise

    rng = np.random.default_rng(14)
    one, two = [(3, 60), (8, 8), (60, 3)], [(9, 60), (9, 9), (50, 9)]
    first, second = (np.stack([planted_mixture(rng, n, a) for _ in range(3)], axis=1) for n, a in ((6000, one), (9000, two)))
    first[0, 0], second[5, 1], second[6, 1] = np.nan, 0.0, 1.0
    rows = [(k, bool(k >= 6000), [float(v) for v in r]) for k, r in enumerate(np.vstack([first, second]))]
    df = spark.createDataFrame(rows, "probe long, second boolean, beta array<double>").repartition(5)
    out = np.array([r.beta for r in normalise.probe_types(df, "second").orderBy("probe").collect()])
    assert np.array_equal(out[:6000], first, equal_nan=True) and out[6005, 1] == 0.0 and out[6006, 1] == 1.0
    q = np.array([0.05, 0.1, 0.2, 0.3, 0.7, 0.8, 0.9, 0.95])
    for k in range(3):
        want, before, after = (np.nanquantile(v, q) for v in (first[:, k], second[:, k], out[6000:, k]))
        assert np.abs(after - want).max() < 0.02 < np.abs(before - want).max()
    order = np.argsort(second[:, 0])
    assert (np.diff(out[6000:, 0][order]) >= -1e-9).all()  # no value overtakes another
    few = df.where("probe % 200 = 0")
    assert sorted(map(str, normalise.probe_types(few, "second").collect())) == sorted(map(str, few.collect()))


def test_matrix_sink_writes_from_all_tasks(spark, tmp_path, monkeypatch):
    from panelforge.sources import matrix

    m = np.random.default_rng(15).normal(size=(500, 7))
    df = spark.createDataFrame([(k * 3, f"cg{k}", [float(v) for v in r]) for k, r in enumerate(m)], "row long, name string, m array<double>").repartition(6)
    for most in (1_000_000, 10):
        monkeypatch.setattr(matrix, "NAMES", most)
        stem = str(tmp_path / f"m{most}")
        matrix.write_f64(df, stem, name="name", colnames=[f"s{k}" for k in range(7)])
        assert np.array_equal(np.fromfile(f"{stem}.f64", "<f8").reshape(7, 500).T, m)
        back = matrix.read_f64(spark, stem, block=64).orderBy("row").collect()
        assert [r.name for r in back] == [f"cg{k}" for k in range(500)] and np.array_equal([r.m for r in back], m)
    matrix.write_f64(df.limit(0), str(tmp_path / "none"))
    assert matrix.header(str(tmp_path / "none"))["nrow"] == 0
    with pytest.raises(ValueError):
        matrix.write_f64(df.withColumn("m", F.slice("m", 1, (F.col("row") % 2 + 1).cast("int"))), str(tmp_path / "bad"))


def test_group_audit_of_a_variant_and_of_artefacts(spark):
    rng = np.random.default_rng(16)
    subject, chip = np.repeat(np.arange(30), 4), np.tile(np.arange(4), 30)
    genotype_ = (rng.random((30, 2)) < 0.25).sum(axis=1)
    groups = {"variant": (genotype_[subject] > 0).astype(int), "chip": (chip == 2).astype(int), "flat": np.zeros(120, int), "one": (np.arange(120) == 7).astype(int)}
    rows = [(p, int(i), int(g), int(subject[i]), int(chip[i])) for p, v in groups.items() for i, g in enumerate(v)]
    from panelforge.operators import genotype

    df = spark.createDataFrame(rows, "probe string, sample int, grp int, subject int, array int")
    out = {r.probe: r for r in genotype.group_audit(df, spark.createDataFrame([("variant", 0.25), ("chip", 0.25)], "probe string, maf double"), n_perm=499).collect()}
    assert out["variant"].called and out["variant"].invariant and out["variant"].freq_ok and out["variant"].chip_ok
    assert out["chip"].flagged and not out["chip"].invariant and not out["chip"].chip_ok and not out["chip"].called
    assert not out["flat"].flagged and not out["one"].flagged and out["one"].called is None
    cases = spark.createDataFrame([(k, "spread", "variant", 0.2) for k in range(60)] + [(100 + k, "observed", "no signal", 0.05) for k in range(40)] + [(200 + k, "observed", "chip artefact", 0.05) for k in range(40)], "key long, layout string, kind string, maf double")
    rates = {r.kind: r for r in genotype.audit_rates(genotype.audit_simulation(cases, list(zip(subject.tolist(), (subject // 2).tolist())), n_perm=199)).collect()}
    assert rates["variant"].all_four > 75 and rates["no signal"].flagged < 10 and rates["chip artefact"].all_four < 10


def test_audit_cases_are_dealt_over_tasks_with_the_same_draws(spark):
    from panelforge.operators import genotype

    cases = spark.range(0, 6000, 1, 1).select(F.col("id").alias("key"), F.lit("observed").alias("layout"), F.lit("no signal").alias("kind"), F.lit(0.05).alias("maf"))
    out = genotype.audit_simulation(cases, [(i // 4, i // 8) for i in range(64)], n_perm=99)
    tasks = {r.p for r in out.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(tasks) == 3 and out.select("key").distinct().count() == 6000
    rng = np.random.default_rng(8)
    for k in range(60):
        sizes = rng.integers(2, 9, 6)
        minor = np.random.default_rng(k).multivariate_hypergeometric(sizes, 6) if k % 2 else np.minimum(sizes, [6, 0, 1, 0, 0, 0])
        e = sizes * (minor.sum() / sizes.sum())
        stat = lambda o: ((o - e) ** 2 / e + (o - e) ** 2 / (sizes - e)).sum(axis=-1)  # noqa: B023, E731
        draws = np.random.default_rng(k).multivariate_hypergeometric(sizes, int(minor.sum()), size=1000)
        plain = (int((stat(draws) >= stat(minor) - 1e-12).sum()) + 1) / 1001 >= 0.05
        assert genotype.chip_separable(sizes, minor, 1000, np.random.default_rng(k)) == plain


def test_best_lambda_takes_the_first_of_equals(spark):
    nan = float("nan")
    grid = spark.createDataFrame([(0.5, 2.0), (0.1, nan), (1.0, 1.5), (0.2, 1.5), (0.05, None)], "lam0 double, score double")
    assert inference.best_lambda(grid) == 0.2
    with pytest.raises(ValueError):
        inference.best_lambda(grid.where("score is null or isnan(score)"))


def test_folds_differ_by_one_at_most(spark):
    for n, k in ((17, 5), (3, 5), (40, 4)):
        got = inference.folds(spark.range(n).select(F.concat(F.lit("s"), "id").alias("subject")), k, 3).collect()
        sizes = sorted(np.bincount([r.fold for r in got]).tolist())
        assert sum(sizes) == n and sizes[-1] - sizes[0] <= 1 and max(r.fold for r in got) == min(k, n) - 1
