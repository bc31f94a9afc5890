"""Mixing sources to target weights by systematic sampling (built-in functions only).

Sources share the words of the whole corpus by weight; a target stops at CAP times its
source's size and the excess is shared anew by weight.  All documents of a source are
expected equally often (target / size, at most CAP copies).  They are ordered by falling
size, their expected copies are summed up along that order, one random offset a source is
added, and a document is taken once for every whole number its own step crosses.  In this
order the words taken differ from the target by at most one document, the largest.

Sums are whole numbers and decimals, so a rerun, another partitioning or another engine
gives the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import ordered, shared

#: Sources weigh these in turn, by code point; a target is at most CAP times its source's size.
WEIGHTS, CAP = (1, 2, 3), 3
#: Offsets are multiples of one over this.
GRAIN = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, weight, over, under``: the target is over / under words, exactly.

    ``sizes``: one row a source (``source, source_size``).  The sources whose targets stop are those
    of least size by weight: sorted by that, they are the shortest prefix after which the next one's
    share of the rest is no more than its stop.  Two windows order the sources, one row each.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = "decimal(20,0)"
    s = s.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
    s = s.withColumn("shares", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # once a share fits, it fits all that follow: what is left by weight no longer falls
    fits = F.col("rest").cast(exact) * F.col("weight") <= (cap * F.col("source_size")).cast(exact) * F.col("shares")
    s = s.withColumn("open", F.max(fits.cast("int")).over(by_stop.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    first = F.min_by(F.when(F.col("open"), F.struct("rest", "shares")), F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source"))).over(whole)
    s = s.withColumn("first", first)
    over = F.when(F.col("open"), F.col("first.rest") * F.col("weight")).otherwise(cap * F.col("source_size"))
    return s.select("source", "source_size", "weight", over.alias("over"), F.when(F.col("open"), F.col("first.shares")).otherwise(F.lit(1)).cast("long").alias("under"))


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in GRAIN parts, from an MD5 of seed and name."""
    named = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 8), 16, 10).cast("long") % GRAIN


def mix(sized: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 1) -> DataFrame:
    """``sized`` with ``source_size, target`` (its source's), ``copies`` and ``taken`` (copies x size).

    Equal rows are one group with a count (partial counts come before the shuffle), so a third of the
    table may be one repeated row.  Groups are dealt into ranges of (falling size, hash of the row);
    counts by (source, range) give every range its offset, and running sums go within (source, range):
    a hot source or a hot size is spread over all ranges, and rows move once more after the grouping.

    Null sources are one source, the last.  Null sizes count as 0.  Empty tables give no rows; if all sizes are 0,
    targets and words taken are 0.  Ties are ordered by an MD5 of all columns, then by the columns, which must be
    comparable (no maps).  Other columns pass through, whatever they are called, but for those
    returned, which are replaced.  Up to 10^12 rows a source and 10^17 words.
    """
    sized = sized.drop(*(c for c in ("source_size", "target", "copies", "taken") if c not in (source, size)))
    given = sized.columns
    names = [f"c{k}" for k in range(len(given))]
    src, num = names[given.index(source)], names[given.index(size)]
    rows = sized.toDF(*names)
    groups = shared.cut(rows.groupBy(*names).agg(F.count("*").alias("held")))
    words_of = F.coalesce(F.col(num), F.lit(0)).cast("long")
    row = F.concat_ws("|", *(F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names))
    hashed = F.shiftright(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long"), 1)
    groups = groups.withColumn("words", words_of).withColumn("place", F.shiftleft(F.col("words"), 31) + hashed)
    dealt, rng, _ = ordered.ranges(groups, "place", 4 * shared.partitions(sized.sparkSession))
    counted = shared.cut(dealt.groupBy(src, rng).agg(F.sum("held").alias("rows"), F.sum(F.col("held") * F.col("words")).alias("total")))
    per_source = targets(counted.groupBy(F.col(src).alias("source")).agg(F.sum("total").alias("source_size")), weights, cap)
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy(src).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.withColumn("start", earlier).join(per_source, F.col(src).eqNullSafe(F.col("source")), "left")
    starts = starts.select(F.col(src).alias("s"), F.col(rng).alias("r"), "start", "source_size", "over", "under", offset(F.col(src), seed).alias("offset"))
    w = Window.partitionBy(src, rng).orderBy(F.desc("place"), *names)
    ranked = dealt.withColumn("before", F.sum("held").over(w) - F.col("held"))
    ranked = ranked.join(starts, F.col(src).eqNullSafe(F.col("s")) & (F.col(rng) == F.col("r")))
    ranked = ranked.withColumn("before", F.col("before") + F.col("start")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("held"))))

    grain, each = F.lit(GRAIN).cast("decimal(4,0)"), F.col("under").cast("decimal(9,0)") * F.col("source_size").cast("decimal(17,0)")

    def crossed(k: Column) -> Column:
        """Whole numbers up to offset / GRAIN + k * over / (under * size): the offset and the expected copies of the first ``k`` rows."""
        steps = k.cast("decimal(12,0)") * F.col("over").cast("decimal(18,0)") * grain
        return F.call_function("div", steps + F.col("offset").cast("decimal(4,0)") * each, each * grain)

    rank = F.col("before") + F.col("nth")
    copies = F.when(F.col("source_size") > 0, crossed(rank) - crossed(rank - 1)).otherwise(F.lit(0)).cast("long")
    out = ranked.withColumn("copies", copies)
    target = (F.col("over").cast("double") / F.col("under").cast("double")).alias("target")
    return out.select(*(F.col(n).alias(g) for n, g in zip(names, given)), "source_size", target, "copies", (F.col("copies") * F.col("words")).alias("taken"))


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: every row as often as it is taken, numbered from 1 in ``copy``."""
    return mixed.where(F.col(copies) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies)


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source`` of every row of ``docs``; a null text has size 0.

    Only ids, sources and word counts are moved; ``emit`` lists the rows as often as they are taken, and texts
    are joined to it by id.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    return mix(sized, **parameters).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
