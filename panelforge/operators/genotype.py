"""Genotype-style calls, concordance and group audits of per-probe values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import special


def call(beta: Column, lo: float = 0.25, hi: float = 0.75) -> Column:
    """AA below ``lo``, BB above ``hi``, AB between; null stays null."""
    return F.when(beta < lo, "AA").when(beta > hi, "BB").when(beta.isNotNull(), "AB")


#: Calls that one block of probes holds.
BLOCK_CALLS = 2_000_000


def bit_planes(code: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int, places: int, levels: int) -> np.ndarray:
    """One plane a level: a bit a (row, place), 64 places a word."""
    words = -(-places // 64)
    planes = np.zeros((levels, rows, words), dtype=np.uint64)
    np.bitwise_or.at(planes, (code, row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return planes


def pair_concordance(calls: DataFrame, probe: str = "probe", sample: str = "sample", value: str = "call") -> DataFrame:
    """``a, b, n, concordance`` of every pair of samples: share of shared probes with equal calls, nulls skipped.

    Probes are dealt into blocks; a block keeps one bit plane a call and sample, and a pair is counted by the bits that both
    planes have.  So a pair is a row a block, not a row a probe: the result is the square of the samples, what is shuffled is that
    times the blocks.  A sample that has a probe twice with different calls agrees with either.
    """
    known = calls.where(F.col(value).isNotNull() & F.col(sample).isNotNull() & F.col(probe).isNotNull()).select(F.col(probe).alias("p"), F.col(sample).alias("s"), F.col(value).alias("v"))
    blocks = max(1, -(-known.count() // BLOCK_CALLS))
    kind = dict(known.dtypes)["s"]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        place, _ = pd.factorize(pdf["p"])
        row, names = pd.factorize(pdf["s"], sort=True)
        code, levels = pd.factorize(pdf["v"])
        planes = bit_planes(code, row, place, len(names), int(place.max()) + 1, len(levels))
        held = np.bitwise_or.reduce(planes, axis=0)
        out = []
        for i in range(len(names) - 1):
            both = np.bitwise_count(held[i + 1 :] & held[i]).sum(axis=1, dtype=np.int64)
            same = sum(np.bitwise_count(p[i + 1 :] & p[i]).sum(axis=1, dtype=np.int64) for p in planes)
            out.append(pd.DataFrame({"a": names[i], "b": names[i + 1 :], "n": both, "same": same}))
        return pd.concat(out) if out else pd.DataFrame({"a": names[:0], "b": names[:0], "n": [], "same": []})

    pairs = known.groupBy(F.pmod(F.xxhash64("p"), F.lit(blocks))).applyInPandas(count, f"a {kind}, b {kind}, n long, same long")
    g = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).where("n > 0")
    return g.select("a", "b", "n", (F.col("same") / F.col("n")).alias("concordance"))


def minor_groups(groups: DataFrame, probe: str = "probe", grp: str = "grp") -> DataFrame:
    """``probe, minor, n_minor``: the least frequent label of each probe, the first label on ties."""
    n = groups.groupBy(probe, grp).agg(F.count("*").alias("n"))
    return n.groupBy(probe).agg(F.min(F.struct("n", grp)).alias("m"), F.count("*").alias("n_groups")).select(probe, F.col(f"m.{grp}").alias("minor"), F.col("m.n").alias("n_minor"), "n_groups")


def r_squared(df: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """One-way R2 = 1 - SSW / SST of each ``by``; null when SST is 0."""
    w, t = Window.partitionBy(by, group), Window.partitionBy(by)
    d = df.withColumn("__w", F.col(value) - F.avg(value).over(w)).withColumn("__t", F.col(value) - F.avg(value).over(t))
    g = d.groupBy(by).agg(F.sum(F.col("__w") ** 2).alias("ssw"), F.sum(F.col("__t") ** 2).alias("sst"))
    return g.select(by, F.when(F.col("sst") > 0, 1 - F.col("ssw") / F.col("sst")).alias("r2"))


def chi_square(df: DataFrame, by: str, row: str, col: str, yates: bool = False) -> DataFrame:
    """Pearson's statistic of each ``by``'s table and its degrees of freedom, cells without rows included.

    From sum(o^2 / e) - n, so empty cells need not exist: e = r c / n.  ``yates``
    corrects 2 x 2 tables.
    """
    cells = df.groupBy(by, row, col).agg(F.count("*").alias("o"))
    m = cells.withColumn("r", F.sum("o").over(Window.partitionBy(by, row))).withColumn("c", F.sum("o").over(Window.partitionBy(by, col))).withColumn("n", F.sum("o").over(Window.partitionBy(by)))
    g = m.groupBy(by).agg(F.first("n").alias("n"), F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"), F.countDistinct(row).alias("rows"), F.countDistinct(col).alias("cols"), F.max(F.struct("r", "c", "o")).alias("one"))
    plain = F.col("s") - F.col("n")
    e = F.col("one.r") * F.col("one.c") / F.col("n")
    dev = F.abs(F.col("one.o") - e)
    short = F.greatest(dev - F.least(F.lit(0.5), dev), F.lit(0.0))
    corrected = F.when((F.col("rows") == 2) & (F.col("cols") == 2) & (dev > 0), plain * (short / dev) ** 2).otherwise(plain) if yates else plain
    return g.select(by, F.col("n").alias("n"), corrected.alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"))


def profile(groups: DataFrame, probe: str = "probe", sample: str = "sample", grp: str = "grp", subject: str = "subject", array: str = "array") -> DataFrame:
    """Minor-group profile: sizes, subjects, straddling subjects, top array share and a text summary."""
    g = groups.join(minor_groups(groups, probe, grp), probe).withColumn("is_minor", (F.col(grp) == F.col("minor")).cast("int"))
    per = g.groupBy(probe, subject).agg(F.sum("is_minor").alias("k"), F.count("*").alias("n"))
    subj = per.groupBy(probe).agg(F.count("*").alias("n_subjects"), F.sum((F.col("k") > 0).cast("long")).alias("minor_subjects"), F.sum(((F.col("k") > 0) & (F.col("k") < F.col("n"))).cast("long")).alias("straddlers"))
    text = per.where("k > 0").groupBy(probe).agg(F.concat_ws("; ", F.array_sort(F.collect_list(F.concat(F.lpad(F.col(subject).cast("string"), 4, "0"), F.lit(": "), F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"))))).alias("summary"))
    share = g.where("is_minor = 1").groupBy(probe, array).agg(F.count("*").alias("n")).groupBy(probe).agg((F.max("n") / F.sum("n")).alias("top_share"))
    base = g.groupBy(probe).agg(F.first("n_minor").alias("n_minor"), F.first("n_groups").alias("n_groups"), F.count("*").alias("n_samples"))
    return base.join(subj, probe).join(text, probe, "left").join(share, probe, "left")


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher p of 2 x 2 counts: the feasible tables no likelier than this one (to a part in 1e7).

    Tables run from the least to the greatest feasible first count; each one's odds
    against the one before are a ratio of four counts, so the whole is a fold.
    """
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    lo, hi = F.greatest(F.lit(0).cast("long"), a - d), F.least(a + b, a + c)
    row, col, rest = a + b, a + c, d - a
    start = F.struct(F.lit(0.0).alias("log"), F.array(F.lit(0.0)).alias("all"))

    def ratio(k: Column) -> Column:  # log odds of k against k - 1
        return F.log((row - k + 1).cast("double")) + F.log((col - k + 1).cast("double")) - F.log(k.cast("double")) - F.log((rest + k).cast("double"))

    steps = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(F.array().cast("array<bigint>"))
    logs = F.aggregate(steps, start, lambda s, k: F.struct((s["log"] + ratio(k)).alias("log"), F.concat(s["all"], F.array(s["log"] + ratio(k))).alias("all")), lambda s: s["all"])
    top = F.array_max(logs)
    p = F.transform(logs, lambda x: F.exp(x - top))
    own = F.get(p, (a - lo).cast("int")) * (1 + 1e-7)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    return F.least(F.lit(1.0), add(F.filter(p, lambda v: v <= own)) / add(p))


def carriers_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of a binomial of n trials; null where an argument is null.

    A batch of rows is one continued fraction of arrays: its steps do not grow with the trials of a row.
    """

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(special.binomial_tail_array(k, n, p))

    return tail(k.cast("double"), n.cast("double"), p.cast("double"))


def hwe_carriers(maf: Column, n_groups: Column | None = None) -> Column:
    """Expected carrier share: 2 maf - maf^2, or maf^2 where three or more groups are seen."""
    carrier = 2 * maf - maf * maf
    return carrier if n_groups is None else F.when(n_groups >= 3, maf * maf).otherwise(carrier)


def chip_permutation_p(groups: DataFrame, n_perm: int = 5000, seed: int = 1, probe: str = "probe", grp: str = "grp", chip: str = "array") -> DataFrame:
    """(hits + 1) / (B + 1) of each probe: permutations whose minor-by-chip chi-square reaches the observed one.

    Samples of a probe are counted by chip before anything else; permuting the minor
    label over samples deals its counts over chips by a multivariate hypergeometric
    law, so a permutation is one draw of counts.  Probes may have ids of any type
    (draws are seeded by a hash of the id); a probe of one group has p = 1.
    """
    minor = groups.groupBy(probe, grp).agg(F.count("*").alias("n")).groupBy(probe).agg(F.min(F.struct("n", grp))[grp].alias("__minor"), F.count("*").alias("__groups"))
    cells = groups.join(minor, probe).groupBy(probe, "__groups", chip).agg(F.count("*").alias("n"), F.sum((F.col(grp) == F.col("__minor")).cast("long")).alias("k"))
    packed = cells.groupBy(probe, "__groups").agg(F.array_sort(F.collect_list(F.struct(F.col(chip).alias("c"), "n", "k"))).alias("v"))
    packed = packed.select(F.col(probe), F.col("__groups").alias("g"), F.xxhash64(F.lit(seed), probe).alias("seed"), F.transform("v", lambda x: x["n"]).alias("n"), F.transform("v", lambda x: x["k"]).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, key, n, k in zip(pdf["g"], pdf["seed"], pdf["n"], pdf["k"]):
                n, k = np.asarray(n, dtype=np.int64), np.asarray(k, dtype=np.int64)
                if g < 2:
                    out.append(1.0)
                    continue
                e = n * (k.sum() / n.sum())
                f = n - e
                rng = np.random.Generator(np.random.PCG64([seed, int(key) % 2**64]))
                stat = lambda o: ((o - e) ** 2 / e + (o - e) ** 2 / f).sum(axis=-1)  # noqa: B023, E731
                hits = int((stat(rng.multivariate_hypergeometric(n, int(k.sum()), size=n_perm)) >= stat(k) - 1e-9).sum())
                out.append((hits + 1) / (n_perm + 1))
            yield pd.DataFrame({probe: pdf[probe], "p_chip": np.array(out, dtype=float)})

    kind = groups.schema[probe].dataType.simpleString()
    return packed.mapInPandas(run, f"`{probe}` {kind}, p_chip double")


def group_audit(groups: DataFrame, maf: DataFrame, n_perm: int = 5000, seed: int = 1, probe: str = "probe", grp: str = "grp", subject: str = "subject", chip: str = "array", level: float = 0.05) -> DataFrame:
    """The audit of value groups as genotypes, one row a probe: does the minor group behave like carriers of a variant?

    ``flagged``: there are two groups or more and the least frequent has two samples or more.  For flagged probes: ``invariant``, no
    subject is partly in it; ``p_freq``, two-sided binomial p of the number of its subjects under Hardy-Weinberg at the probe's
    ``maf`` (squared where there are three groups or more), and ``freq_ok``; ``p_chip`` by permutation, and ``chip_ok``; ``called``, all
    of them.  Nulls for the others.  ``maf``: probe, maf; a probe without one cannot be judged by frequency.
    """
    minor = minor_groups(groups, probe, grp)
    own = groups.join(minor, probe).withColumn("__in", (F.col(grp) == F.col("minor")).cast("long"))
    each = own.groupBy(probe, "n_minor", "n_groups", subject).agg(F.sum("__in").alias("k"), F.count("*").alias("n"))
    g = each.groupBy(probe, "n_minor", "n_groups").agg(F.count("*").alias("n_subjects"), F.sum((F.col("k") > 0).cast("long")).alias("minor_subjects"), F.sum(((F.col("k") > 0) & (F.col("k") < F.col("n"))).cast("long")).alias("straddlers"))
    g = g.join(maf.select(probe, "maf"), probe, "left").join(chip_permutation_p(groups, n_perm, seed, probe, grp, chip), probe)
    share = hwe_carriers(F.col("maf"), F.col("n_groups"))
    k, n = F.col("minor_subjects"), F.col("n_subjects")
    p = F.least(F.lit(1.0), 2 * F.least(carriers_tail(k, n, share), 1 - carriers_tail(k + 1, n, share)))
    flagged = (F.col("n_groups") >= 2) & (F.col("n_minor") >= 2)
    out = g.withColumn("flagged", flagged).withColumn("invariant", F.when(flagged, F.col("straddlers") == 0)).withColumn("p_freq", F.when(flagged & F.col("maf").isNotNull(), p)).withColumn("p_chip", F.when(flagged, F.col("p_chip")))
    out = out.withColumn("freq_ok", F.col("p_freq") >= level).withColumn("chip_ok", F.col("p_chip") >= level)
    called = F.when(flagged, F.col("invariant") & F.coalesce(F.col("freq_ok"), F.lit(False)) & F.col("chip_ok"))
    return out.withColumn("called", called).select(probe, "n_groups", "n_minor", "n_subjects", "minor_subjects", "straddlers", "flagged", "invariant", "p_freq", "freq_ok", "p_chip", "chip_ok", "called")


#: Fixed values of simulated probes: mean beta of AA, AB and BB, noise, the step that parts groups, what an artefact adds.
MEANS, NOISE, STEP, ARTEFACT = (0.15, 0.50, 0.85), 0.03, 0.15, 0.3
KINDS = ("variant", "no signal", "chip artefact", "subject artefact")


def simulate_case(kind: str, maf: float, subject: np.ndarray, chip: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Beta values of one probe over the sheet's samples."""
    subjects, chips = int(subject.max()) + 1, int(chip.max()) + 1
    if kind == "variant":
        alleles = (rng.random((subjects, 2)) < maf).sum(axis=1)
        return np.clip(np.array(MEANS)[alleles[subject]] + rng.normal(0, NOISE, len(subject)), 0.01, 0.99)
    value = rng.normal(0.5, 0.05, len(subject))
    if kind == "chip artefact":
        value = value + ARTEFACT * (chip == rng.integers(chips))
    elif kind == "subject artefact":
        value = value + ARTEFACT * (subject == rng.integers(subjects))
    return np.clip(value, 0.01, 0.99)


#: Simulated cases of one task, draws between two looks at the hits.
CASES, LOOK = 2000, 100


def chip_separable(sizes: np.ndarray, minor: np.ndarray, n_perm: int, rng: np.random.Generator, level: float = 0.05) -> bool:
    """Whether (hits + 1) / (n_perm + 1) reaches ``level``: hits are dealings of the minor label over chips whose chi-square reaches that of ``minor``.

    Draws come in the order in which one call would give them, and end when the rest can no longer change the answer.
    """
    m, total = int(minor.sum()), int(sizes.sum())
    e = sizes * (m / total)
    stat = lambda o: ((o - e) ** 2 / e + (o - e) ** 2 / (sizes - e)).sum(axis=-1)
    own, hits, left = stat(minor) - 1e-12, 0, n_perm
    while (hits + 1) / (n_perm + 1) < level <= (hits + left + 1) / (n_perm + 1):
        size = min(LOOK, left)
        hits += int((stat(rng.multivariate_hypergeometric(sizes, m, size=size)) >= own).sum())
        left -= size
    return (hits + 1) / (n_perm + 1) >= level


def audit_simulation(cases: DataFrame, sheet: list[tuple], n_perm: int = 1000, seed: int = 1) -> DataFrame:
    """What the audit says of simulated probes: one for each row of ``cases`` (key, layout, kind, maf) on the samples of ``sheet`` (subject, chip).

    ``layout``: ``observed`` keeps the sheet's chips, ``spread`` deals samples over chips anew.  ``kind``: one of KINDS.  Returns the
    cases with ``flagged, invariant, freq_ok, chip_ok, called`` (null where not flagged).  Cases are seeded by their key, wherever
    they are simulated (a case is a row of a few bytes and a millisecond of work, so they are dealt over tasks by number); repeated keys give equal rows.
    """
    tasks = max(1, -(-cases.count() // CASES))
    subject, chip = (np.unique(np.array([str(r[k]) for r in sheet]), return_inverse=True)[1] for k in (0, 1))
    subjects, chips = int(subject.max()) + 1, int(chip.max()) + 1
    full = np.bincount(subject)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, layout, kind, maf in zip(batch["key"], batch["layout"], batch["kind"], batch["maf"]):
                rng = np.random.Generator(np.random.PCG64([seed, int(key) % 2**63]))
                own = rng.permutation(np.resize(np.arange(chips), len(chip))) if layout == "spread" else chip
                beta = simulate_case(kind, maf, subject, own, rng)
                order = np.argsort(beta, kind="stable")
                code = np.empty(len(beta), int)
                code[order] = np.cumsum(np.append(0, np.diff(beta[order]) > STEP))
                count = np.bincount(code)
                minor = code == int(np.argmin(count))
                if len(count) < 2 or minor.sum() < 2:
                    rows.append((False, None, None, None, None))
                    continue
                per = np.bincount(subject[minor], minlength=subjects)
                invariant, carriers, p = not ((per > 0) & (per < full)).any(), int((per > 0).sum()), hwe_share(maf, len(count))
                two = min(1.0, 2 * min(special.binomial_tail(carriers, subjects, p), 1 - special.binomial_tail(carriers + 1, subjects, p)))
                sizes = np.bincount(own, minlength=chips)
                held = sizes > 0
                clean = chip_separable(sizes[held], np.bincount(own[minor], minlength=chips)[held], n_perm, rng)
                rows.append((True, bool(invariant), bool(two >= 0.05), bool(clean), bool(invariant and two >= 0.05 and clean)))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=["flagged", "invariant", "freq_ok", "chip_ok", "called"], dtype=object)], axis=1)

    return cases.select(F.col("key").cast("long").alias("key"), "layout", "kind", F.col("maf").cast("double").alias("maf")).repartition(tasks).mapInPandas(run, "key long, layout string, kind string, maf double, flagged boolean, invariant boolean, freq_ok boolean, chip_ok boolean, called boolean")


def audit_rates(audited: DataFrame) -> DataFrame:
    """``layout, kind, maf, n`` and per cent: of cases ``flagged``, of flagged ones by each criterion, and of all cases ``all_four``."""
    share = lambda c: F.round(100 * F.avg(F.when(F.col("flagged"), F.col(c).cast("double"))), 1)
    each = {"invariant": "invariant", "freq_consistent": "freq_ok", "chip_separable": "chip_ok"}
    return audited.groupBy("layout", "kind", "maf").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("flagged").cast("double")), 1).alias("flagged"), *(share(c).alias(n) for n, c in each.items()), F.round(100 * F.avg(F.coalesce(F.col("called").cast("double"), F.lit(0.0))), 1).alias("all_four"))


def hwe_share(maf: float, n_groups: int) -> float:
    return maf * maf if n_groups >= 3 else 2 * maf - maf * maf
