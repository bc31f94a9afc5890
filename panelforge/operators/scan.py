"""Ordered scans along chromosomes of any size: pieces, carried rows and running counts.

A chromosome with more rows than a task should hold is cut at positions into pieces.  A scan runs
within pieces; what a piece needs of those before it is one row a piece: the last row of the
nearest earlier piece, and sums over all earlier ones.  Those rows are few (rows of the table over
rows of a piece), so they are ordered in one window a chromosome and sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chromosome that one task scans.
ROWS = 2_000_000
#: Rows of many chromosomes that one task scans.
DEALT = 200_000
PIECE = "__piece"


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` (``rows`` rows) dealt by the columns ``by`` over so many tasks that one holds about ``DEALT`` rows however large the table is.

    Left to the size of shuffled bytes, a task's rows grow with the table: sorts, windows and sums of a chain of scans are all held by one task.
    """
    few = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(few, -(-rows // DEALT)), *by)


def cut_points(df: DataFrame, rows: int = ROWS, chrom: str = "chr", pos: str = "pos") -> DataFrame | None:
    """``chr, cuts``: positions where chromosomes of more than ``rows`` rows are cut; None where there is none.

    One aggregate over (chromosome, position).  Rows of one position stay together; at most 1,000 cuts a chromosome.
    """
    big = df.groupBy(F.col(chrom).alias("__chr")).agg(F.count("*").alias("__n")).where(F.col("__n") > rows)
    found = [(r["__chr"], r["__n"]) for r in big.collect()]  # at most the table's rows over ``rows``
    if not found:
        return None
    most = min(1000, max(-(-n // rows) for _, n in found))
    steps = [k / most for k in range(1, most)]
    own = df.where(F.col(chrom).isin([c for c, _ in found])).groupBy(F.col(chrom).alias("__chr")).agg(F.percentile_approx(F.col(pos).cast("double"), steps, 10_000).alias("__cuts"))
    return own.select("__chr", F.array_sort(F.array_distinct("__cuts")).alias("__cuts"))


def pieced(df: DataFrame, cuts: DataFrame | None, chrom: str = "chr", pos: str = "pos") -> DataFrame:
    """``df`` with the number of each row's piece of its chromosome."""
    if cuts is None:
        return df.withColumn(PIECE, F.lit(0))
    held = df.join(F.broadcast(cuts), F.col(chrom) == F.col("__chr"), "left")  # cut chromosomes only: few
    return held.withColumn(PIECE, F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(pos))), F.lit(0))).drop("__chr", "__cuts")


def window(by: tuple[str, ...], *order):
    return Window.partitionBy(*by, PIECE).orderBy(*order)


def with_previous(df: DataFrame, values: dict[str, Column], by: tuple[str, ...], order: tuple[str, ...], whole: bool) -> DataFrame:
    """``df`` with ``values`` of the row before in its group under the given names; null at a group's first.

    ``whole``: groups have one piece each, nothing is carried.
    """
    w = window(by, *order)
    row = F.struct(*(v.alias(n) for n, v in values.items()))
    out = df.withColumn("__own", row).withColumn("__before", F.lag("__own").over(w))
    if not whole:
        ends = df.groupBy(*by, PIECE).agg(F.max_by(row, F.struct(*order)).alias("__end"))
        ends = ends.withColumn("__carried", F.lag("__end").over(Window.partitionBy(*by).orderBy(PIECE))).drop("__end").where("__carried is not null")
        ends = ends.select(*(F.col(b).alias(f"__b{k}") for k, b in enumerate(by)), F.col(PIECE).alias("__bp"), "__carried")
        same = F.col(PIECE) == F.col("__bp")
        for k, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"__b{k}"))
        out = out.join(F.broadcast(ends), same, "left").withColumn("__before", F.coalesce("__before", "__carried")).drop("__bp", "__carried", *(f"__b{k}" for k in range(len(by))))
    for n in values:
        out = out.withColumn(n, F.col("__before")[n])
    return out.drop("__own", "__before")


def with_running(df: DataFrame, sums: dict[str, Column], by: tuple[str, ...], order: tuple[str, ...], whole: bool, peers: bool = False) -> DataFrame:
    """``df`` with running sums (this row included) along its group; ``peers``: rows of one place in the order have one sum."""
    w = window(by, *order)
    w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for n, v in sums.items():
        out = out.withColumn(n, F.sum(v).over(w))
    if not whole:
        totals = df.groupBy(*by, PIECE).agg(*(F.sum(v).alias(f"__t_{n}") for n, v in sums.items()))
        earlier = Window.partitionBy(*by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select(*(F.col(b).alias(f"__b{k}") for k, b in enumerate(by)), F.col(PIECE).alias("__bp"), *(F.sum(f"__t_{n}").over(earlier).alias(f"__o_{n}") for n in sums)).where(F.col("__bp") > 0)
        same = F.col(PIECE) == F.col("__bp")
        for k, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"__b{k}"))
        out = out.join(F.broadcast(base), same, "left")
        for n in sums:
            out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)))
        out = out.drop("__bp", *(f"__o_{n}" for n in sums), *(f"__b{k}" for k in range(len(by))))
    return out
