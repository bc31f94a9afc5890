"""Connected components of a distributed edge list by alternating stars.

Each round points every node's larger neighbours at its smallest one, then every
node at its smallest smaller neighbour; rounds needed grow with the logarithm of
the longest path.  Edges stay distributed; a round is two aggregations by node
and is written to the shared checkpoint folder, so a lost executor costs one
round at most.  Edges that are stars already take no round, and what a round
shuffled is let go before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import cut, release

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct edges (a, b) with a < b."""
    if large:
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))))
    else:
        both = edges.select(F.col("b").alias("v"), F.col("a").alias("u"))
    low = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
    linked = both.join(low, "v")
    if large:
        out = linked.where("u > v").select(F.col("m").alias("a"), F.col("u").alias("b"))
    else:
        out = linked.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("v").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node with an edge; the component is its smallest node.

    Self loops and null ends are ignored; repeated and reversed edges count once.
    Nodes may be of any orderable type.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    e = cut(e.where("x and y and a <> b").select("a", "b").distinct())
    for _ in range(MAX_ROUNDS):
        if _are_stars(e):
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component")))
        e = cut(_stars(_stars(e, True), False))
        release(e.sparkSession)
    raise RuntimeError("components did not settle")


def _are_stars(e: DataFrame) -> bool:
    """Whether the larger end of each distinct edge (a < b) is in no other edge: then every smaller end is its component's smallest node."""
    ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.lit(False).alias("larger")), F.struct(F.col("b").alias("v"), F.lit(True).alias("larger")))))
    seen = ends.groupBy("v").agg(F.max("larger").alias("larger"), F.count("*").alias("n"))
    return seen.where("larger and n > 1").isEmpty()
