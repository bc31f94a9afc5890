"""The library's front, array scans and stages."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import panel as front
from panelforge.functions import kernels
from panelforge.operators import compare, quality_control
from panelforge.plans import stages
from panelforge.sources import idat


def idat_bytes(address, mean, sd, beads):
    parts = [(idat.COUNT, struct.pack("<i", len(address))), (idat.ADDRESS, np.array(address, "<i4").tobytes()), (idat.SPREAD, np.array(sd, "<u2").tobytes()), (idat.MEAN, np.array(mean, "<u2").tobytes()), (idat.BEADS, np.array(beads, "u1").tobytes())]
    at, table, body = 16 + 10 * len(parts), b"", b""
    for code, data in parts:
        table += struct.pack("<Hq", code, at + len(body))
        body += data
    return b"IDAT" + struct.pack("<qi", 3, len(parts)) + table + body


def test_scans(spark, tmp_path):
    for sample, channel, mean in (("s1", "Grn", [10, 20, 30]), ("s1", "Red", [5, 6, 7])):
        data = idat_bytes([1, 2, 3], mean, [1, 1, 1], [9, 9, 9])
        (tmp_path / f"{sample}_{channel}.idat.gz").write_bytes(gzip.compress(data))
    scans = idat.read_idats(spark, str(tmp_path))
    assert scans.count() == 6
    manifest = spark.createDataFrame([("cg1", 1, None, None), ("cg2", 2, 3, "Red")], "probe string, address_a int, address_b int, channel string")
    got = {r.probe: (r.meth, r.unmeth) for r in idat.intensities(scans, manifest).collect()}
    assert got == {"cg1": (10, 5), "cg2": (7, 6)}
    with pytest.raises(ValueError):
        idat.parse(b"IDAX" + bytes(20))
    with pytest.raises(ValueError):
        idat.parse(data[:-5])


def test_background_signal_is_positive_and_monotone():
    x = np.linspace(0, 5000, 200)
    s = kernels.background_signal(x, 300.0, 80.0, 900.0)
    assert (s > 0).all() and (np.diff(s) >= -1e-9).all() and abs(s[-1] - (5000 - 300 - 80**2 / 900)) < 1


def samples(n=24):
    return [{"person": f"{i // 4:03d}", "visit": float(i % 4), "arm": "a" if i % 2 else "b", "array": "450K" if i < 12 else "EPIC", "site": ["x", "y", "z"][i % 3]} for i in range(n)]


def test_panel_resolves_and_refuses(spark):
    rng = np.random.default_rng(0)
    data = spark.createDataFrame([(f"cg{i}", "chr1", i * 100, rng.uniform(0.05, 0.95, 24).tolist()) for i in range(120)], "name string, seqnames string, MAPINFO long, beta array<double>")
    p = front.Panel.of(data, samples())
    assert "assay" in p.metadata and p.sorted().first()["probe"] == "cg0" and p.coordinates().columns == ["probe", "chr", "pos"]
    f = p.fit("visit", "person", ["site"])
    assert f.count() == 120 and p.fit("arm", "person").count() == 120
    design = p.design("visit", "person", ["site"])
    assert design.df == 24 - 6 - 3
    for bad in (lambda: front.Panel.of(data, samples(23)), lambda: p.fit("nothing", "person"), lambda: p.fit([1.0], "person"), lambda: p.fit("site", "person"), lambda: p.fit([None] * 24, "person"), lambda: front.Panel.of(data.drop("MAPINFO"), samples())):
        with pytest.raises(ValueError):
            bad()
    found, record = p.regions("visit", "person", "array", lam=0.5, rho_min=-1.0)
    assert record["n_subjects"] == 6 and {"effect_450K", "effect_EPIC"} <= set(found.columns)
    with pytest.raises(ValueError):
        p.blocks("visit", "person")


def test_ranges_and_stability(spark):
    df = spark.createDataFrame([("1", 5, 9, "x")], "seqnames string, Start long, End long, note string")
    assert front.as_ranges(df).first().asDict() == {"chr": "1", "start": 5, "end": 9, "width": 5, "note": "x"}
    with pytest.raises(ValueError):
        front.as_ranges(df.drop("End"))
    share, n = front.stability_selection(lambda own: spark.createDataFrame([(s,) for s in own], "key string"), list("abcd"), 8)
    assert n == 8 and abs(sum(share.values()) - 2) < 1e-9


def test_comparison_report(spark):
    a = spark.createDataFrame([(10, 2), (20, 4)], "width long, n_probes long")
    b = spark.createDataFrame([], "width long, n_probes long, p double")
    table, report = stages.comparison({"one": a, "none": b}, {"none": "p"})
    assert table.count() == 2 and "| one | 2 |" in report
    assert stages.gap_histogram(spark.createDataFrame([(1, 0), (1, 5), (1, 5000)], "chr int, pos long")).count() == 2


def test_full_comparison(spark):
    reg = spark.createDataFrame([("1", 1, 10, 2, "0.01", 0.5, 1.0), ("1", 21, 40, 4, "NA", -0.5, -2.0), ("2", 1, 2, 6, "0.2", 1.0, 3.0), ("2", 9, 9, 1, "0.05", 2.0, None)], "chr string, start long, end long, L long, p string, a double, b double")
    null = spark.createDataFrame([(float(k),) for k in range(101)], "max_abs_z double")
    fits = spark.createDataFrame([("1", 5, 0.1, 1.0, "450K"), ("1", 5, 0.3, 1.0, "EPIC")], "chr string, pos long, beta double, se double, array string")
    one = compare.method_row("one", "region", reg, probes="L", p="p", effects=("a", "b"), null=null, fits=fits, runtime_s=3.5)
    none = compare.method_row("none", "block", reg.limit(0), probes="L", p="p", effects=("a", "b"), n_clusters=7)
    r, e = one.first(), none.first()
    assert one.columns == none.columns == list(compare.COLUMNS)
    assert (r.n_regions, r.n_fwer05, r.median_width_bp, r.total_bp, r.median_n_probes) == (4, 2, 6.0, 33.0, 3.0)
    assert r.n_cross_array == 3 and r.cross_array_r == pytest.approx(np.corrcoef([0.5, -0.5, 1.0], [1.0, -2.0, 3.0])[0, 1]) and r.sign_concordance == 1.0
    assert (r.n_cross_array_common, r.cross_array_r_common, r.null_q95_max_abs_z, r.runtime_s) == (1, None, 95.0, 3.5)
    assert (e.n_regions, e.n_cross_array, e.median_width_bp, e.n_clusters) == (0, None, None, 7)
    table, report = stages.full_comparison([one, none])
    assert table.count() == 2 and "| none | block | 0 |" in report


def test_two_arrays_harmonised(spark):
    probes = [(f"cg{k}", "chrX" if k < 10 else "chrY" if k < 20 else f"chr{k % 22 + 1}", k) for k in range(60)]
    ann = spark.createDataFrame(probes, "probe string, chr string, pos long")
    rng = np.random.default_rng(4)
    dark = "e2"

    def scan(array, samples, held):
        rows = []
        for s in samples:
            for name, chrom, k in probes:
                if k in held:
                    level = 300.0 if s == dark else 9000.0
                    if chrom == "chrY" and s in ("k1", "e1"):
                        level = 1200.0
                    rows.append((s, name, level * (1 + k / 60), level * 0.9, None if k % 2 else "Grn"))
        return spark.createDataFrame(rows, "sample string, probe string, meth double, unmeth double, channel string")

    arrays = {"450K": scan("450K", ["k1", "k2"], set(range(58))), "EPIC": scan("EPIC", ["e1", "e2", "e3"], set(range(2, 60)))}
    controls = {a: spark.createDataFrame([(s, c, float(v)) for s in names for c in ("Grn", "Red") for v in rng.normal(200, 20, 101)], "sample string, channel string, intensity double") for a, names in (("450K", ["k1", "k2"]), ("EPIC", ["e1", "e2", "e3"]))}
    told = spark.createDataFrame([("k1", "female"), ("k2", "Male"), ("e1", "M"), ("e3", "male")], "sample string, sex string")
    panel, qc, audit = stages.harmonise_arrays(arrays, ann, controls=controls, sheet=told)
    q = {r["sample"]: r for r in qc.collect()}
    assert {s for s, r in q.items() if r.sample_fail} == {dark} and q["k1"]["array"] == "450K" and len(q) == 5
    assert (q["k1"].predicted_sex, q["k1"].sex_mismatch, q["e1"].sex_mismatch, q["k2"].sex_mismatch, q[dark].sex_mismatch) == ("F", False, True, False, None)
    assert {r.probe for r in audit.collect()} == {f"cg{k}" for k in range(2, 58)}
    rows = panel.collect()
    assert {r.probe for r in rows} == {f"cg{k}" for k in range(20, 58)} and all(r.samples == ["e1", "e3", "k1", "k2"] for r in rows)
    r = next(r for r in rows if r.probe == "cg30")
    beta = 9000 * 1.5 / (9000 * 1.5 + 9000 * 0.9 + 100)
    assert np.allclose(r.m, np.log2(beta / (1 - beta)))
    # detection by the sum of both channels or by twice one
    d = {r.probe: r.detp for r in quality_control.control_detection(arrays["EPIC"].where(F.col("sample") == dark).withColumn("meth", F.lit(200.0)).withColumn("unmeth", F.lit(200.0)), controls["EPIC"]).collect()}
    assert 0.2 < d["cg10"] < 0.8 and 0.2 < d["cg11"] < 0.8
