"""Hashes and hash orders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as a long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    steps = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")) * F.lit(16777619)) % F.lit(4294967296))


def order_key(seed: int, *columns) -> Column:
    """A reproducible pseudo-random string from a seed and key columns; the same under any partitioning and in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns)))


def unit(key: Column) -> Column:
    """A number from 0 to 1 in the order of such strings."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(16**12)


def rising_range(value: Column, bounds: list) -> Column:
    """How many of the rising ``bounds`` lie below a value: two short array scans instead of one long."""
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    if not groups:
        return F.lit(0)
    below = lambda bs: F.size(F.filter(bs, lambda b: b < value))
    first = below(F.array(*(F.lit(g[0]) for g in groups)))
    table = F.array(*(F.array(*(F.lit(b) for b in g)) for g in groups))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * wide + below(F.get(table, first - 1)))
