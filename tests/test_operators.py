"""Operators on simulated panels: recovery, invariants, guards, edge cases."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import hashing, kernels, special
from panelforge.operators import blocks, genome, genotype, inference, quality_control, regions, within
from panelforge.sources import matrix, tables


def fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def panel(spark, m, gap=120, chrom=1):
    return spark.createDataFrame([(i, chrom, i * gap, [float(v) for v in row]) for i, row in enumerate(m)], "probe long, chr int, pos long, m array<double>")


def sheet_of(subjects=30, visits=4):
    return [(s, float(v) / 2, "450K" if s < subjects // 2 else "EPIC") for s in range(subjects) for v in range(visits)]


def simulated(seed=0, probes=400, effect=0.30, shift=1.5):
    """An array offset nested in subjects, a strong subject effect and a true effect on the first 40 probes."""
    rng = np.random.default_rng(seed)
    sheet = sheet_of()
    s, x = np.array([v[0] for v in sheet]), np.array([v[1] for v in sheet])
    m = rng.normal(0, 0.3, (probes, len(sheet))) + rng.normal(0, 2.0, (probes, 30))[:, s] + np.where(s < 15, 0, shift)
    m[:40] += effect * x
    return m, sheet


def test_fit_recovers_effect_under_array_offset(spark):
    m, sheet = simulated()
    design = within.Design([e for _, e, _ in sheet], [s for s, _, _ in sheet])
    rows = within.fit_panel(panel(spark, m), design).orderBy("probe").collect()
    beta = np.array([r.beta for r in rows])
    assert abs(beta[:40].mean() - 0.30) < 0.03 and abs(beta[40:].mean()) < 0.02
    # the same as least squares with subject dummies
    s, x = np.array([v[0] for v in sheet]), np.array([v[1] for v in sheet])
    full = np.column_stack([x, np.eye(30)[s]])
    assert np.allclose(beta[:5], np.linalg.lstsq(full, m[:5].T, rcond=None)[0][0], atol=1e-10)


def test_covariate_constant_within_subject_is_dropped():
    sheet = sheet_of()
    e, s = [v[1] for v in sheet], [v[0] for v in sheet]
    a, b = within.Design(e, s), within.Design(e, s, [[float(k)] for k in s])
    m = np.random.default_rng(0).normal(size=(5, len(e)))
    assert np.allclose(a.fit(m)[0], b.fit(m)[0], atol=1e-12) and a.df == b.df
    with pytest.raises(ValueError):
        within.Design([1.0, np.nan], ["a", "a"])
    with pytest.raises(ValueError):
        within.Design([1.0, 1.0], ["a", "b"]).fit(m[:, :2])


def test_degrees_of_freedom(spark):
    rows = [(i, str(i // 2), float(i % 2)) for i in range(12)]
    d = spark.createDataFrame(rows, "sample int, subject string, exposure double")
    assert within.identification(d).first()["df"] == 12 - 6 - 1
    assert within.identification(d.withColumn("exposure", F.lit(1.0))).first()["df"] == 0


def test_moderation_shrinks_and_is_identity_when_few(spark):
    rng = np.random.default_rng(2)
    s2 = 0.1 * 25 / rng.chisquare(6, 3000) * rng.chisquare(25, 3000) / 25
    df = spark.createDataFrame([(float(v),) for v in s2], "s2 double")
    post = np.array([r.s2_post for r in within.moderate(df, 25).collect()])
    assert np.log(post).std() < np.log(s2).std()
    assert np.allclose(np.sort(post), np.sort(within.moderate_array(s2, 25)), rtol=1e-9)
    few = df.limit(50)
    assert few.count() == 50 and all(r.s2 == r.s2_post for r in within.moderate(few, 25).collect())


def test_robust_moderation_withstands_outliers(spark):
    rng = np.random.default_rng(12)
    f = (rng.chisquare(20, 200_000) / 20) / (rng.chisquare(8, 200_000) / 8)
    assert special.f_upper(2.0, 20, 8)[0] == pytest.approx((f >= 2).mean(), abs=4e-3) and (f <= special.f_quantile(0.3, 20, 8)).mean() == pytest.approx(0.3, abs=4e-3)
    z = np.log(f)
    drawn = np.clip(z, *np.quantile(z, [0.05, 0.9]))
    assert special.winsorised_log_f(20, 8, (0.05, 0.1)) == pytest.approx((drawn.mean(), drawn.var()), abs=5e-3)
    s2 = 0.2 * f[:4000]
    s2[:60] *= 200
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(s2)], "probe int, s2 double")
    rows = within.moderate_robust(df, 20).orderBy("probe").collect()
    d0, post = np.array([r.df_prior for r in rows]), np.array([r.s2_post for r in rows])
    assert len(rows) == 4000 and abs(np.median(d0) - 8) < 1.5 and (d0[:60] < 1).mean() > 0.9
    # an ordinary row of tail p has the rate 4000 p / (60 + 3940 p), below 6 / 7.5 for p < 0.057 only
    assert (d0[60:] > 6).mean() > 0.943
    plain = within.prior_of(4000, float(np.log(s2).mean()), float(np.log(s2).var(ddof=1)), 20)
    assert plain[0] < np.median(d0) - 1 and np.abs(post[:60] / s2[:60] - 1).max() < 0.6
    same = within.moderate_robust(df.where("probe >= 60").withColumn("s2", F.lit(0.2)), 20).first()
    assert same.df_prior > 20 * 1000 and same.s2_post == pytest.approx(0.2, rel=0.1)  # no spread: drawn to one variance
    assert {r.df_prior for r in within.moderate_robust(df.limit(50), 20).collect()} == {0.0}


def test_sample_weights_and_weighted_fit(spark):
    rng = np.random.default_rng(13)
    sheet = sheet_of(10, 4)
    x, sd = np.array([e for _, e, _ in sheet]), np.ones(40)
    sd[:4], sd[4:8] = 3.0, 0.5
    m = rng.normal(0, 1, (3000, 40)) * sd * np.sqrt(10 / rng.chisquare(10, 3000))[:, None]
    df = panel(spark, m)
    w = within.sample_weights(df, list(x))
    want = sd**-2.0 / np.exp(np.log(sd**-2.0).mean())
    assert np.abs(np.log(w / want)).max() < 0.2
    assert np.allclose(within.sample_weights(df.limit(0), list(x)), 1.0)
    keys = [s for s, _, _ in sheet]
    fit = within.fit_gls(df, list(x), keys, rho=0.2, weights=w).orderBy("probe").first()
    # the same as least squares under the weighted covariance
    v = np.where(np.equal.outer(keys, keys), 0.2, 0.0)
    np.fill_diagonal(v, 1.0)
    iv = np.linalg.inv(v / np.sqrt(np.outer(w, w)))
    d = np.column_stack([np.ones(40), x])
    assert fit.beta == pytest.approx(np.linalg.solve(d.T @ iv @ d, d.T @ iv @ m[0])[1], abs=1e-9)
    p = np.array([r.p for r in within.fit_gls(df, list(x), keys, rho=0.0, weights=w, robust=True).collect()])
    assert len(p) == 3000 and abs((p < 0.05).mean() - 0.05) < 0.015


def test_comethylation_clusters_find_runs(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(size=(300, 40))
    for a, b in ((50, 56), (150, 158)):
        r[a:b] = rng.normal(size=40) + 0.3 * r[a:b]
    df = panel(spark, r).withColumnRenamed("m", "resid")
    out = {x.probe: x.cluster for x in genome.comethylation_clusters(df, "resid", 1000, 0.5, "chr", "pos", "probe").collect()}
    for a, b in ((50, 56), (150, 158)):
        assert len({out[k] for k in range(a, b)}) == 1 and out[a] >= 0
    ids = sorted({v for v in out.values() if v >= 0})
    assert ids == list(range(len(ids))) and sum(v == -1 for v in out.values()) > 200
    flat = df.withColumn("resid", F.transform("resid", lambda x: F.lit(1.0)))
    assert {x.cluster for x in genome.comethylation_clusters(flat, "resid", 1000, 0.5, "chr", "pos", "probe").collect()} == {-1}


def test_regions_end_to_end_find_the_planted_run(spark):
    m, sheet = simulated(1)
    found, record = regions.find_regions(panel(spark, m), sheet, rho_min=-1.0, lam=1.0, n_perm=5, n_boot=4)
    top = found.orderBy(F.desc(F.abs("z"))).first()
    assert abs(top["effect"] - 0.30) < 0.06 and top["start"] <= 600 and record["df"] == 120 - 30 - 1
    assert top["stability"] == 1.0 and top["p_fwer"] == pytest.approx(1 / 6) and top["sign_concordant"]


def test_inference_is_optional(spark):
    reg = spark.createDataFrame([("a", 3.0)], "region string, z double")
    out = inference.fwer(reg, spark.createDataFrame([], "max_abs_z double")).first()
    assert out["p_fwer"] == 1.0 and out["p_fwer_mcse"] == 0.0


def test_permutations_keep_subjects(spark):
    rows = [(i, f"s{i // 3}" if i < 30 else f"t{i}", float(i % 3)) for i in range(35)]
    d = spark.createDataFrame(rows, "sample int, subject string, exposure double")
    p = inference.permute(d, 1, 5).collect()
    for s in {r.subject for r in p}:
        own = [r for r in p if r.subject == s]
        assert sorted(r.permuted for r in own) == sorted(r.exposure for r in own)
    assert all(r.permuted == r.exposure for r in p if r.subject.startswith("t"))
    again = {r.sample: r.permuted for r in inference.permute(d.repartition(7), 1, 5).collect()}
    assert again == {r.sample: r.permuted for r in p}
    x = inference.permuted_exposures([(r[1], r[2], "A") for r in rows], 0, 1)
    assert sorted(x[:3]) == [0.0, 1.0, 2.0] and (x[30:] == [float(i % 3) for i in range(30, 35)]).all()


def test_folds_are_contiguous_hash_order(spark):
    subjects = [f"{k:04d}" for k in range(23)]
    rows = inference.folds(spark.createDataFrame([(s,) for s in subjects], "subject string"), 5, 3).collect()
    order = sorted(subjects, key=lambda s: (fnv(f"3:{s}".encode()), s))
    want, at = {}, 0
    for f in range(5):
        size = 23 // 5 + (f < 23 % 5)
        want |= dict.fromkeys(order[at : at + size], f)
        at += size
    assert {r.subject: r.fold for r in rows} == want


def test_fnv_over_bytes(spark):
    words = ["", "foobar", "é日", "a" * 40]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(hashing.fnv1a(F.col("w"))).collect()]
    assert got == [fnv(w.encode()) for w in words]


def test_bh_equals_definition(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(size=400), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    got = np.array([r.fdr for r in inference.bh(df).orderBy("i").collect()])
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    adj = np.minimum.accumulate(raw[::-1])[::-1]
    want = np.empty(len(p))
    want[order] = np.minimum(adj, 1)
    assert np.allclose(got, want)


def test_interval_joins_equal_brute_force(spark):
    rng = np.random.default_rng(6)

    def draw(prefix, n):
        return [(int(rng.integers(1, 3)), i, int(s), int(s + rng.integers(0, 900))) for i, s in enumerate(rng.integers(0, 5000, n))]

    a, b = draw("a", 120), draw("b", 90)
    x = spark.createDataFrame(a, "chr int, a_id int, a_start long, a_end long")
    y = spark.createDataFrame(b, "chr int, b_id int, b_start long, b_end long")
    got = sorted((r.a_id, r.b_id) for r in genome.interval_overlap(x, y, bin_size=300).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])
    got = sorted((r.a_id, r.b_id) for r in genome.interval_containment(x, y, bin_size=300).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] >= q[2] and p[3] <= q[3])


def test_blocks_recover_runs(spark):
    rng = np.random.default_rng(7)
    y, se = rng.normal(0, 0.03, 500), rng.uniform(0.02, 0.08, 500)
    y[120:200] += 0.25
    y[330:400] -= 0.25
    y += rng.normal(0, se)
    rows = [(1 + i // 250, float(i * 120_000), i * 120_000, i * 120_000 + 500, float(y[i]), float(se[i])) for i in range(500)]
    df = spark.createDataFrame(rows, "chr int, mid double, start long, end long, y double, se double").repartition(5)
    model, post = blocks.fit_blocks(df)
    wide = float(np.std(y))
    plain = kernels.BlockModel(np.array([np.quantile(y, 0.05), 0.0, np.quantile(y, 0.95)]), np.array([wide, wide / 2, wide]), np.array([0.05, 0.9, 0.05]), 250_000)
    mid, before = np.arange(500) * 120_000.0, -np.inf
    for _ in range(60):  # the same rounds over both chromosomes in memory
        parts = [kernels.forward_backward(y[k], se[k], mid[k], plain) for k in (slice(0, 250), slice(250, 500))]
        g, ll = np.concatenate([p[0] for p in parts]), sum(p[1] for p in parts)
        plain = kernels.maximise(plain, kernels.sufficient(g, y, se))
        if abs(ll - before) < 1e-5 * max(1.0, abs(before)):
            break
        before = ll
    assert np.allclose(model.mu, np.sort(plain.mu), atol=1e-7)
    p1 = np.array([r.posterior for r in post.orderBy("mid").collect()])
    assert np.allclose(p1, g[:, np.argsort(plain.mu)], atol=1e-6)
    state = np.argmax(p1, axis=1)
    assert (state[120:200] == 2).mean() > 0.7 and (state[330:400] == 0).mean() > 0.7 and (np.delete(state, np.r_[120:200, 330:400]) != 1).mean() < 0.15
    assert {r.direction for r in genome.call_blocks(post).collect()} == {"hyper", "hypo"}


def test_regions_with_covariates_and_text_chromosomes(spark):
    m, sheet = simulated(2)
    age = np.random.default_rng(5).normal(size=len(sheet))
    shifted = m + 0.8 * age[None, :]  # a covariate that moves every probe
    data = panel(spark, shifted).withColumn("chr", F.lit("X"))
    found, record = regions.find_regions(data, sheet, rho_min=-1.0, lam=1.0, n_perm=4, covariates=np.column_stack([age, [float(s[0]) for s in sheet]]))
    rows = found.collect()
    top = max(rows, key=lambda r: abs(r["z"]))
    assert abs(top["effect"] - 0.30) < 0.06 and top["chr"] == "X" and record["df"] == 120 - 30 - 2
    assert [r["p_fwer"] for r in rows] == sorted(r["p_fwer"] for r in rows)
    legacy = regions.bumphunter(panel(spark, m).withColumn("chr", F.lit("X")), sheet, cutoff=0.15, n_perm=9).collect()
    assert {r["chr"] for r in legacy} == {"X"} and min(r["fwer_area"] for r in legacy) == 0.0  # no replicate of nine has such an area


def test_nearest_stays_linear_on_one_chromosome(spark):
    q = spark.range(0, 150_000).select(F.lit(1).alias("chr"), (F.col("id") * 7 + 3).alias("pos"), F.col("id").alias("q_id"))
    f = spark.range(0, 100_000).select(F.lit(1).alias("chr"), (F.col("id") * 10).alias("pos"), F.col("id").alias("f_id"))
    out = genome.nearest(q, f, near=20)
    got = out.agg(F.count("*"), F.max("distance"), F.sum((F.col("distance") <= 5).cast("int"))).first()
    assert got[0] == 150_000 and got[2] >= 142_000  # an operator whose frames grow would not end
    bh = inference.bh(spark.range(200_000).select((F.col("id") / 200_000.0).alias("p")))
    assert bh.agg(F.max("fdr")).first()[0] <= 1.0


def test_chip_p_takes_any_probe_id(spark):
    rows = [(f"cg{p}", i, int(i < 10) if p == 0 else (i * 7 + p) % 2, "A" if i < 20 else "B") for p in range(3) for i in range(40)]
    g = spark.createDataFrame(rows, "probe string, sample int, grp int, array string")
    out = {r.probe: r.p_chip for r in genotype.chip_permutation_p(g, 2000).collect()}
    rng = np.random.default_rng(1)
    chip = np.arange(40) < 20
    hits = sum(abs((rng.permutation(np.arange(40) < 10) & chip).sum() - 5) >= 5 for _ in range(20000)) / 20000
    assert out["cg0"] == pytest.approx(hits, abs=2e-3) and out["cg1"] > 0.3
    assert out == {r.probe: r.p_chip for r in genotype.chip_permutation_p(g.repartition(7), 2000).collect()}


def test_tails_and_fisher_equal_plain_sums(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(v) for v in rng.integers(0, 12, 4)) for _ in range(80)] + [(0, 0, 0, 0), (5, 0, 0, 5), (0, 3, 4, 0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    for r in df.withColumn("p", genotype.fisher(*map(F.col, "abcd"))).withColumn("t", genotype.carriers_tail(F.col("a"), F.col("b"), F.col("c") / 12)).collect():
        assert r.p == pytest.approx(special.hypergeometric_two_sided(r.a, r.b, r.c, r.d), abs=1e-9)
        assert r.t == pytest.approx(special.binomial_tail(r.a, r.b, r.c / 12), abs=1e-9)
    t = np.array([0.0, 0.3, -2.0, 8.0, 60.0])
    assert np.allclose(special.t_two_sided_array(t, 11.0), [special.t_two_sided(float(v), 11.0) for v in t])


def test_lines_are_dealt_over_tasks_by_their_number(spark, smoke, monkeypatch):
    """One partition of the shuffle's default would hold any number of lines; a chromosome stays in one task and is not moved again."""
    from panelforge.operators import scan
    from panelforge.sources import adapters

    monkeypatch.setattr(scan, "DEALT", 100)
    t = adapters.track_lineitem(spark, smoke)
    lines = tables.table(spark, smoke, "lineitem").count()
    assert t.rdd.getNumPartitions() == -(-lines // 100) > 4
    held = genome.gap_clusters(t, 30).select("chr", F.spark_partition_id().alias("p")).distinct()
    assert held.count() == held.select("chr").distinct().count() and held.agg(F.max("p")).first()[0] > 4


@pytest.mark.parametrize("name", ["method_comparison", "top_regions", "block_runs"])
def test_track_queries_move_lines_once_over_tasks_by_their_number(spark, smoke, monkeypatch, name):
    """Sums, windows and sorts of the whole query follow the dealing; by a shuffle of Spark's own, tasks would hold more in a larger table."""
    from panelforge.operators import scan
    from panelforge.plans import catalog

    monkeypatch.setattr(scan, "DEALT", 100)
    lines = tables.table(spark, smoke, "lineitem").count()
    plan = catalog.QUERIES[name](spark, smoke)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moves and all(f", {-(-lines // 100)}), REPARTITION_BY_NUM" in line for line in moves)


def test_lookups_of_ranges_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """The joins of regions with prefix sums had the shuffle's default of tasks, so a task held more rows in a larger table."""
    from panelforge.operators import scan

    monkeypatch.setattr(scan, "DEALT", 100)
    fits = spark.range(3000).select((F.col("id") % 3).alias("chr"), F.floor(F.col("id") / 3).alias("pos"), (F.col("id") % 7 - 3.0).alias("beta"), F.lit(1.0).alias("se"))
    reg = spark.range(600).select((F.col("id") % 3).alias("chr"), (F.floor(F.col("id") / 3) * 5).alias("probe_start"), (F.floor(F.col("id") / 3) * 5 + 4).alias("probe_end"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for known in ({}, {"rows": 3000}):
            out = genome.index_range_effects(reg, fits, **known)
            held = out.groupBy(F.spark_partition_id()).count().collect()
            assert len(held) > 20 and max(r["count"] for r in held) < 60
            got = {(r["chr"], r["probe_start"]): (r["effect"], r["se"]) for r in out.collect()}
            assert len(got) == 600
            for (c, s), (effect, se) in got.items():
                own = [(k * 3 + c) % 7 - 3.0 for k in range(s, s + 5)]
                assert abs(effect - sum(own) / 5) < 1e-9 and abs(se - 5**-0.5) < 1e-12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_carriers_tail_of_many_rows(spark):
    """100,000 rows of 126 trials: a sum of sums of logarithms took minutes of one task."""
    df = spark.range(0, 100_000, 1, 1).select((F.col("id") % 129).alias("k"), ((F.col("id") % 50 + 1) / 60.0).alias("p"))
    began = time.time()
    out = df.withColumn("t", genotype.carriers_tail(F.col("k"), F.lit(126), F.col("p"))).groupBy("k", "p").agg(F.first("t").alias("t")).collect()
    assert time.time() - began < 60
    assert all(r.t == pytest.approx(special.binomial_tail(r.k, 126, r.p), rel=1e-9, abs=1e-300) for r in out)
    edge = spark.createDataFrame([(3, None), (None, 0.5), (0, 0.0), (5, 0.0), (5, 1.0), (127, 1.0)], "k int, p double")
    assert [r.t for r in edge.select(genotype.carriers_tail(F.col("k"), F.lit(126), F.col("p")).alias("t")).collect()] == [None, None, 1.0, 0.0, 1.0, 0.0]


def test_variant_flags_sex_and_labels(spark):
    df = spark.createDataFrame([(1, "chr2", 5, None, None), (2, "chr1", 9, "rs1", None), (3, "chr1", 4, None, "rs2"), (4, "chr1", 1, None, None)], "probe int, chr string, pos int, Probe_rs string, SBE_rs string")
    assert [(r.probe, r.documented_snp) for r in quality_control.documented_first(quality_control.documented(df)).collect()] == [(3, True), (2, True), (4, False), (1, False)]
    cn = spark.createDataFrame([("s1", "X", 13.0), ("s1", "Y", 9.0), ("s2", "X", 12.0), ("s2", "Y", 12.5)], "sample string, chr string, cn double")
    sex = {r["sample"]: r.predicted_sex for r in quality_control.predict_sex(cn).collect()}
    assert sex == {"s1": "F", "s2": "M"}
    told = spark.createDataFrame([("s1", "male"), ("s2", "M")], "sample string, told string").join(quality_control.predict_sex(cn), "sample")
    assert {r["sample"]: r.m for r in told.select("sample", quality_control.sex_mismatch(F.col("told"), F.col("predicted_sex")).alias("m")).collect()} == {"s1": True, "s2": False}
    assert kernels.state_labels(2) == ["hypo_s0", "hypo_s1", "neutral"]


def test_local_linear_uses_all_neighbours():
    rng = np.random.default_rng(9)
    pos, y, w = np.sort(rng.integers(0, 5000, 1500)).astype(float), rng.normal(size=1500), rng.uniform(0.5, 2, 1500)
    for pairs in (10, 100_000):
        out = kernels.local_linear(pos, np.stack([y, -y], axis=1), w, 2000.0, pairs)
        for i in range(0, 1500, 97):
            d = pos - pos[i]
            k = np.clip(1 - (np.abs(d) / 2000.0) ** 3, 0, None) ** 3 * w
            coef = np.linalg.lstsq(np.stack([np.ones(1500), d], axis=1) * np.sqrt(k)[:, None], y * np.sqrt(k), rcond=None)[0]
            assert out[i, 0] == pytest.approx(coef[0], abs=1e-8) and out[i, 1] == pytest.approx(-coef[0], abs=1e-8)


def test_gap_operators_on_edges(spark):
    empty = spark.createDataFrame([], "chr int, pos long, probe long")
    assert genome.gap_clusters(empty, 10).count() == 0
    assert genome.fixed_collapse(empty.withColumn("x", F.lit(1))).first()["n_clusters"] == 0
    one = spark.createDataFrame([(1, 5, 1)], "chr int, pos long, probe long")
    assert genome.gap_clusters(one, 10).first()["cluster"] == 1
    assert genome.canonical_chr(F.lit("5.0")) is not None
    got = [r[0] for r in spark.createDataFrame([("5",), ("5.0",), ("chr5",)], "c string").select(genome.canonical_chr(F.col("c"))).collect()]
    assert got == ["chr5"] * 3


def test_genotype_groups(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.1, 0.12, 0.5, 0.52, 0.9])], "probe int, sample int, beta double")
    g = genome.value_groups(df, "probe", "beta", 0.15)
    assert [r.grp for r in g.orderBy("sample").collect()] == [0, 0, 1, 1, 2]
    assert genotype.minor_groups(g).first()["minor"] == 2
    calls = df.select(genotype.call(F.col("beta")).alias("c")).collect()
    assert [r.c for r in calls] == ["AA", "AA", "AB", "AB", "BB"]
    pair = genotype.pair_concordance(df.withColumn("call", genotype.call(F.col("beta")))).collect()
    assert len(pair) == 10 and {r.concordance for r in pair} == {0.0, 1.0}


def test_quality_control_guards(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("a", 2.0)], "g string, b double")
    assert [r.exposure for r in quality_control.code_exposure(df, "g").collect()] == [0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        quality_control.code_exposure(df.withColumn("g", F.lit("a")), "g")
    assert not quality_control.is_beta(df, "b") and quality_control.is_beta(df.where("b <= 1"), "b")
    m = df.select(quality_control.beta_to_m(F.col("b")).alias("m")).collect()
    assert all(np.isfinite(r.m) for r in m)
    with pytest.raises(ValueError):
        quality_control.align(spark.createDataFrame([("x", 0)], "g string, ordinal int"), df.select("g").distinct(), "g")
    p = spark.range(1).select(quality_control.detection_p(F.lit(1.96), F.lit(0.0), F.lit(1.0)).alias("p")).first()["p"]
    assert abs(p - 0.0249979) < 1e-6


def test_matrix_round_trip_and_damage(spark, tmp_path):
    m = np.random.default_rng(8).normal(size=(10, 7))
    stem = str(tmp_path / "m")
    matrix.write_f64(panel(spark, m).withColumn("name", F.concat(F.lit("cg"), "probe")), stem, row="probe", name="name")
    rows = matrix.read_f64(spark, stem, block=3).orderBy("row").collect()
    assert np.array_equal(np.array([r.m for r in rows]), m) and rows[4]["name"] == "cg4"
    assert np.array_equal(np.fromfile(f"{stem}.f64", "<f8").reshape((10, 7), order="F"), m)
    with open(f"{stem}.f64", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        matrix.header(stem)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("0010", float("nan")), ("0011", 1.5)], "id string, v double")
    assert [json.loads(r.json) for r in tables.strict_json(df).collect()] == [{"id": "0010", "v": None}, {"id": "0011", "v": 1.5}]
    path = str(tmp_path / "t.csv")
    tables.write_csv(df, path, gzip=True)
    assert {r.id for r in tables.read_csv(spark, path).collect()} == {"0010", "0011"}
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), missing="a int").count() == 0
    assert tables.read_json(spark, str(tmp_path / "none.json")) == {}
    tables.save_objects({"x": df}, str(tmp_path / "store"))
    assert tables.load_objects(spark, str(tmp_path / "store"), ["x"])["x"].count() == 2
    assert tables.strict_record({"a": [float("inf"), 1.0]}) == {"a": [None, 1.0]}
    assert tables.resolve(spark.createDataFrame([(1,)], "MAPINFO int"), "pos") == "MAPINFO"
    assert tables.markdown(df).count("\n") == 4


def test_naive_permutation_of_all_orders(spark, smoke):
    from collections import Counter

    from panelforge.plans import catalog

    rows = catalog.QUERIES["permutation_naive_all"](spark, smoke).collect()
    assert len(rows) == len({r.sample for r in rows}) == spark.read.parquet(f"{smoke}/orders.parquet").count()
    assert Counter(r.exposure for r in rows) == Counter(r.permuted for r in rows)
    assert sum(r.exposure != r.permuted for r in rows) > 0.9 * len(rows)
    d = spark.createDataFrame([(k, float(k)) for k in range(500)], "sample long, exposure double")
    a, b = ({r.sample: r.permuted for r in inference.permute(x, 1, 5, False).collect()} for x in (d, d.repartition(7)))
    assert a == b and sorted(a.values()) == [float(k) for k in range(500)] and a != {r.sample: r.permuted for r in inference.permute(d, 2, 5, False).collect()}


def test_resampling_queries_run_the_references_replicates(spark, smoke, monkeypatch):
    from panelforge.operators import regions as region_operators
    from panelforge.plans import catalog

    for name in ("permutation_null", "naive_null"):
        assert catalog.QUERIES[name](spark, smoke).count() == 200
    asked = {}

    def watch(module, name, *keys):
        real = getattr(module, name)

        def called(*a, **b):
            asked[name] = tuple(b[k] if isinstance(k, str) else a[k] for k in keys)
            return real(*a, **b)

        monkeypatch.setattr(module, name, called)

    watch(region_operators, "bumphunter", "n_perm")
    watch(genotype, "chip_permutation_p", 1)
    watch(genotype, "audit_simulation", "n_perm")
    watch(inference, "stability", 3)
    for name in ("bumphunter_like", "chip_permutation_p", "audit_simulation", "stability_selection"):
        catalog.QUERIES[name](spark, smoke)
    assert asked == {"bumphunter": (200,), "chip_permutation_p": (5000,), "audit_simulation": (1000,), "stability": (50,)}
    watch(region_operators, "find_regions", "n_perm", "n_boot")
    catalog.QUERIES["regions_end_to_end"](spark, smoke)
    assert asked["find_regions"] == (200, 50)
