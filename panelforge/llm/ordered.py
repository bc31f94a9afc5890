"""Rows in a global order without a global sort task: ranges, and each range's successor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.shared import cut, fresh, partitions

LEAST = -(2**63)


def bounds_of(df: DataFrame, key: str, parts: int | None = None, *, accuracy: int = 20_000) -> list[int]:
    """Rising bounds of about equal ranges of the long ``key``: approximate quantiles over all rows, ``parts`` numbers."""
    parts = parts or partitions(df.sparkSession)
    steps = [k / parts for k in range(1, parts)]
    found = df.agg(F.percentile_approx(F.coalesce(F.col(key), F.lit(LEAST)), steps, accuracy).alias("q")).first()["q"] if steps else []
    return sorted(set(found or []))


def falling_range(key, bounds: list[int]):
    """Column: how many of ``bounds`` lie at or above the key, so that it rises as the key falls; null keys come last."""
    at = F.coalesce(key, F.lit(LEAST))
    falling = bounds[::-1]
    wide = max(1, int(len(falling) ** 0.5))
    groups = [falling[k : k + wide] for k in range(0, len(falling), wide)]
    if not groups:
        return F.lit(0)
    # by groups of bounds: two short array scans instead of one long
    reached = lambda bs: F.size(F.filter(bs, lambda b: b >= at))
    first = reached(F.array(*(F.lit(g[0]) for g in groups)))
    table = F.array(*(F.array(*(F.lit(b) for b in g)) for g in groups))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * wide + reached(F.get(table, first - 1)))


def ranges(df: DataFrame, key: str, parts: int | None = None) -> tuple[DataFrame, str, int]:
    """``df`` with a range number that rises as the long ``key`` falls, its name, and how many ranges there are.

    Null keys come last.  Rows of one key share a range.
    """
    name, bounds = fresh(df, "range"), bounds_of(df, key, parts)
    return df.withColumn(name, falling_range(F.col(key), bounds)), name, len(bounds) + 1


def with_successors(df: DataFrame, key: str, *ties: str) -> tuple[DataFrame, str, str]:
    """Rows dealt into ranges of falling ``key``, each range followed by a copy of the next range's first row.

    Returns (rows, range column, flag column of the copies).  Within a
    partition rows are sorted by range, copies last, falling key and ``ties``; so
    each row's successor in the global order is the row after it, and the row
    after the last is the first.  One shuffle of the rows; the copies are one row
    a range.  A range is no larger than the rows of one key or its share.
    """
    dealt, rng, n = ranges(df, key)
    copy = fresh(dealt, "copied")
    cols = df.columns
    # the first row of each range; the falling key's largest, then ties rising
    top = dealt.groupBy(rng).agg(F.max(F.coalesce(F.col(key), F.lit(LEAST))).alias("k"))
    heads = dealt.join(F.broadcast(top.withColumnRenamed(rng, "r")), (F.col(rng) == F.col("r")) & (F.coalesce(F.col(key), F.lit(LEAST)) == F.col("k"))).drop("r", "k")
    heads = cut(heads.groupBy(rng).agg(F.min(F.struct(*ties, *(c for c in cols if c not in ties))).alias("row")))
    w = Window.orderBy(rng)
    previous = heads.withColumn("to", F.coalesce(F.lag(rng).over(w), F.max(rng).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    copies = previous.select(*(F.col("row")[c].alias(c) for c in cols), F.col("to").alias(rng), F.lit(1).alias(copy))
    rows = dealt.withColumn(copy, F.lit(0)).unionByName(copies)
    out = rows.repartitionById(n, F.col(rng)).sortWithinPartitions(F.col(rng), F.col(copy), F.coalesce(F.col(key), F.lit(LEAST)).desc(), *(F.col(c).asc() for c in ties))
    return out, rng, copy
