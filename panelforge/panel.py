"""The library's front: a panel of measurements with its samples, validated once.

``Panel`` holds a DataFrame (probe, chr, pos, values) and a small sheet of
samples in the order of the value arrays.  Its methods are the entry points of
region and block detection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import blocks, genome, quality_control, regions, within
from panelforge.sources import tables


def columns_of(sheet: list[dict], given, *, name: str) -> list:
    """A column of the sheet by name, or a vector of the right length."""
    if isinstance(given, str):
        if given not in sheet[0]:
            raise ValueError(f"{name}: the sheet has no column {given!r}")
        return [r[given] for r in sheet]
    out = list(given)
    if len(out) != len(sheet):
        raise ValueError(f"{name}: {len(out)} values for {len(sheet)} samples")
    return out


def coded(values: list) -> list[float]:
    """Numbers and booleans as they are, two levels as 0 and 1 in sorted order; else ValueError."""
    if any(v is None or isinstance(v, float) and not math.isfinite(v) for v in values):
        raise ValueError("exposure and covariates must be complete")
    if all(isinstance(v, (int, float, bool, np.number)) for v in values):
        return [float(v) for v in values]
    levels = sorted({str(v) for v in values})
    if len(levels) != 2:
        raise ValueError(f"{len(levels)} levels; two are needed")
    return [float(str(v) == levels[1]) for v in values]


def design_matrix(sheet: list[dict], covariates: list[str]) -> np.ndarray | None:
    """Covariates as columns; constant ones go, factors become indicators of all levels but the first."""
    out = []
    for c in covariates:
        v = columns_of(sheet, c, name="covariates")
        if len({str(x) for x in v}) == 1 and v[0] is not None:
            continue  # a covariate that never varies says nothing
        if all(isinstance(x, (int, float, bool)) and x is not None for x in v):
            out.append(coded(v))
        else:
            if any(x is None for x in v):
                raise ValueError(f"covariate {c!r} must be complete")
            out += [[float(str(x) == level) for x in v] for level in sorted({str(x) for x in v})[1:]]
    return np.array(out).T if out else None


@dataclass
class Panel:
    """``data``: probe, chr, pos and a value array; ``samples``: one dict a sample, in array order."""

    data: DataFrame
    samples: list[dict]
    values: str = "m"
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of(cls, data: DataFrame, samples: list[dict], values: str | None = None) -> Panel:
        """Resolve column aliases, take M over other value columns, turn beta values into M, check lengths.

        The first column is the probe's name if none is called ``probe``.
        """
        chrom, pos = tables.resolve(data, "chr"), tables.resolve(data, "pos")
        arrays = [c for c, t in data.dtypes if t.startswith("array<")]
        if values is None:
            named = [c for c in arrays if c.lower() == "m"]
            if not named and len(arrays) != 1:
                raise ValueError(f"which of {arrays} holds the values?")
            values = (named or arrays)[0]
        probe = "probe" if "probe" in data.columns else data.columns[0]
        out = data.select(F.col(probe).alias("probe"), genome.normalise_chr(F.col(chrom)).alias("chr"), F.col(pos).cast("long").alias("pos"), F.col(values).cast("array<double>").alias("m"))
        row = out.agg(F.min(F.size("m")).alias("lo"), F.max(F.size("m")).alias("hi"), F.max(F.exists("m", lambda x: x.isNull() | F.isnan(x)).cast("int")).alias("gap"), F.min(F.array_min("m")).alias("least"), F.max(F.array_max("m")).alias("most")).first()
        if row["lo"] is not None and (row["lo"] != len(samples) or row["hi"] != len(samples)):
            raise ValueError(f"value arrays of {row['lo']} to {row['hi']} for {len(samples)} samples")
        if row["gap"]:
            raise ValueError("the values must be complete")
        notes = {}
        if row["least"] is not None and row["least"] >= 0 and row["most"] <= 1:
            out = out.withColumn("m", F.transform("m", quality_control.beta_to_m))
            notes["assay"] = "beta values were turned into M values"
        return cls(out, samples, "m", notes)

    def complete(self, *columns: str) -> Panel:
        """The panel of the samples that have a finite value in every named column of the sheet."""
        at = [i for i, r in enumerate(self.samples) if all(r.get(c) is not None and not (isinstance(r[c], float) and not math.isfinite(r[c])) for c in columns)]
        if len(at) == len(self.samples):
            return self
        data = within.take(self.data, "m", at)
        return Panel(data, [self.samples[i] for i in at], self.values, self.metadata | {"incomplete_samples": len(self.samples) - len(at)})

    def sorted(self) -> DataFrame:
        """Probes in genome order."""
        return self.data.orderBy(F.col("chr").try_cast("int").asc_nulls_last(), "chr", "pos", "probe")

    def coordinates(self) -> DataFrame:
        return self.data.select("probe", "chr", "pos")

    def sheet(self, exposure, subject, array=None) -> list[tuple]:
        x, s = coded(columns_of(self.samples, exposure, name="exposure")), columns_of(self.samples, subject, name="subject")
        a = columns_of(self.samples, array, name="array") if array is not None else ["all"] * len(x)
        return [(str(k), e, str(v)) for k, e, v in zip(s, x, a)]

    def design(self, exposure, subject, covariates: list[str] = ()) -> within.Design:
        s = self.sheet(exposure, subject)
        return within.Design([e for _, e, _ in s], [k for k, _, _ in s], design_matrix(self.samples, list(covariates)))

    def fit(self, exposure, subject, covariates: list[str] = (), shrink: bool = True) -> DataFrame:
        """``probe, chr, pos, beta, se, z`` of the within-subject fit."""
        d = self.design(exposure, subject, covariates)
        f = within.fit_panel(self.data, d)
        f = within.moderate(f, d.df) if shrink else f.withColumn("s2_post", F.col("s2"))
        return within.with_z(f, d.unit).select("probe", "chr", "pos", "beta", "se", "z")

    def regions(self, exposure, subject, array=None, covariates: list[str] = (), **parameters) -> tuple[DataFrame, dict]:
        found, record = regions.find_regions(self.data, self.sheet(exposure, subject, array), covariates=design_matrix(self.samples, list(covariates)), **parameters)
        return found, record | self.metadata

    def blocks(self, exposure, subject, array=None, covariates: list[str] = (), **parameters) -> tuple[DataFrame, DataFrame, dict]:
        found, effects, model = blocks.find_blocks(self.data, self.sheet(exposure, subject, array), covariates=design_matrix(self.samples, list(covariates)), **parameters)
        return found, effects, {"mu": model.mu.tolist(), "sigma": model.sigma.tolist(), "pi": model.pi.tolist(), "loglik": model.loglik, "rounds": model.rounds, "neutral": model.neutral} | self.metadata


def as_ranges(df: DataFrame) -> DataFrame:
    """Any table with chr, start and end (by alias) as ranges with the rest as attributes; ValueError without them."""
    names = {c.lower(): c for c in df.columns}
    missing = [c for c in ("start", "end") if c not in names]
    if missing:
        raise ValueError(f"ranges need {missing}")
    chrom = tables.resolve(df, "chr")
    rest = [c for c in df.columns if c not in (chrom, names["start"], names["end"])]
    return df.select(F.col(chrom).cast("string").alias("chr"), F.col(names["start"]).cast("long").alias("start"), F.col(names["end"]).cast("long").alias("end"), (F.col(names["end"]) - F.col(names["start"]) + 1).cast("long").alias("width"), *rest)


def stability_selection(fit, subjects: list, n_boot: int = 100, frac: float = 0.5, seed: int = 1) -> tuple[dict, int]:
    """How often each key is found: ``fit(subset)`` returns a DataFrame with a column ``key`` for a list of subjects.

    One set of keys a subsample reaches the driver (regions, not probes).
    """
    subjects = sorted(set(subjects))
    k = max(2, math.floor(frac * len(subjects)))
    count: dict = {}
    for b in range(n_boot):
        own = np.random.Generator(np.random.PCG64([seed, b])).choice(len(subjects), min(k, len(subjects)), replace=False)
        for r in fit([subjects[i] for i in sorted(own)]).select("key").distinct().collect():
            count[r["key"]] = count.get(r["key"], 0) + 1
    return {key: n / n_boot for key, n in count.items()}, n_boot


__all__ = ["Panel", "as_ranges", "stability_selection"]
