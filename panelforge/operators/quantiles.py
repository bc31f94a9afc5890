"""Exact quantiles of a column without gathering it: counts in bins, then only the bins that hold a wanted rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, and values of one bin that are taken to the driver at last.
BINS, FEW = 2048, 20_000


def _finite(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(v.alias("v")).where("v is not null and not isnan(v)")


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (from 0) of the sorted column; nulls and NaN do not count.

    Each pass counts the rows of every open interval in BINS bins; intervals with few rows, or of one value, are done.  A pass
    brings at most BINS counts an interval to the driver, and there are no more intervals than ranks.
    """
    v = _finite(df, value)
    wanted = sorted(set(ranks))
    row = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    found: dict[int, float] = {}
    # intervals: (least value, greatest value, rows below, rows inside) -> ranks
    todo = {(row[0], row[1], 0, row[2]): [r for r in wanted if 0 <= r < row[2]]}
    while todo := {k: r for k, r in todo.items() if r}:
        small, large = [], []
        for key, own in todo.items():
            lo, hi, below, n = key
            if lo == hi:
                found.update((r, lo) for r in own)
            else:
                (small if n <= FEW else large).append((key, own))
        todo = {}
        if small:
            inside = F.lit(False)
            for (lo, hi, _, _), _ in small:
                inside = inside | F.col("v").between(lo, hi)
            held = sorted(r["v"] for r in v.where(inside).collect())  # at most FEW a wanted rank
            at = 0
            for (lo, hi, below, n), own in sorted(small):
                begin = next(k for k in range(at, len(held)) if held[k] >= lo)
                found.update((r, held[begin + r - below]) for r in own)
                at = begin
        for (lo, hi, below, n), own in large:
            width = (hi - lo) / BINS
            if not math.isfinite(width) or lo + width == lo:
                # values that double precision cannot divide further, or infinite ones: distinct values are few here
                place = F.col("v")
            else:
                place = F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1)).cast("double")
            counts = v.where(F.col("v").between(lo, hi)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()
            start = below
            for c in counts:
                mine = [r for r in own if start <= r < start + c["n"]]
                if mine:
                    todo.setdefault((c["lo"], c["hi"], start, c["n"]), []).extend(mine)
                start += c["n"]
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between order statistics; None without values."""
    n = _finite(df, value).count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * q for q in shares]
    both = order_statistics(df, value, [k for h in at for k in (math.floor(h), math.ceil(h))])
    return [a + (b - a) * (h - math.floor(h)) if a != b else a for h, a, b in zip(at, both[::2], both[1::2])]


def trimmed_mean(df: DataFrame, value: str, trim: float) -> float | None:
    """The mean without the floor(trim * n) least and greatest values."""
    v = _finite(df, value)
    n = v.count()
    if not n:
        return None
    cut = math.floor(trim * n)
    if 2 * cut >= n:
        cut = (n - 1) // 2
    lo, hi = order_statistics(df, value, [cut, n - 1 - cut])
    row = v.agg(F.sum(F.when((F.col("v") > lo) & (F.col("v") < hi), F.col("v"))), F.sum((F.col("v") <= lo).cast("long")), F.sum((F.col("v") >= hi).cast("long"))).first()
    if lo == hi:
        return lo
    return ((row[0] or 0.0) + lo * (row[1] - cut) + hi * (row[2] - cut)) / (n - 2 * cut)
