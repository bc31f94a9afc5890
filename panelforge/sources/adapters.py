"""The driver tables as panels, tracks and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import scan
from panelforge.sources.tables import table

DIMS, VISITS, FIRST_ARRAY = 64, 4, 10


def panel_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``probe, chr, pos, m``: chromosome = label + 1; runs of eight neighbours 200 apart, then a gap of 5,000."""
    e = table(spark, sf_dir, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.withColumn("r", rank).select(
        F.col("vec_id").alias("probe"), (F.col("label") + 1).cast("int").alias("chr"), (F.col("r") * 200 + F.floor(F.col("r") / 8) * 5000).cast("long").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("m")
    )


def sample_sheet(spark: SparkSession) -> DataFrame:
    """``sample, subject, exposure, array`` of the 64 columns of :func:`panel_embeddings`."""
    s = spark.range(DIMS).select(F.col("id").cast("int").alias("sample"))
    return s.select("sample", F.floor(F.col("sample") / VISITS).cast("int").alias("subject"), (F.col("sample") % VISITS).cast("double").alias("exposure"), F.when(F.col("sample") < FIRST_ARRAY * VISITS, "450K").otherwise("EPIC").alias("array"))


def sheet_rows() -> list[tuple[int, float, str]]:
    """(subject, exposure, array) of each sample, in sample order."""
    return [(i // VISITS, float(i % VISITS), "450K" if i < FIRST_ARRAY * VISITS else "EPIC") for i in range(DIMS)]


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``probe, chr, pos, sample, subject, exposure, array, value``."""
    p = panel_embeddings(spark, sf_dir).select("probe", "chr", "pos", F.posexplode("m").alias("sample", "value"))
    subject = F.floor(F.col("sample") / VISITS).cast("int")
    return p.select("probe", "chr", "pos", "sample", subject.alias("subject"), (F.col("sample") % VISITS).cast("double").alias("exposure"), F.when(F.col("sample") < FIRST_ARRAY * VISITS, "450K").otherwise("EPIC").alias("array"), "value")


def panel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, subject, exposure, y, array``: visits are orders, exposure is days since the first in hundreds."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    o = o.withColumn("day", day).withColumn("first", F.min("day").over(Window.partitionBy("o_custkey")))
    return o.select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("subject"), ((F.col("day") - F.col("first")) / 100.0).alias("exposure"), F.log2("o_totalprice").alias("y"), F.col("c_mktsegment").alias("array"))


def track_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chr, pos, n, sw, swb``: a chromosome a part, a position a day; beta = swb / sw.

    ``sw`` is the summed quantity (1 / se^2) and ``swb`` the sum of quantity times
    discount in per cent less 5: whole numbers, so sums are exact.  Lines are dealt by chromosome
    once, over tasks by their number: the sums and all scans along chromosomes follow without moving rows again.
    """
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    q, d = F.round("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long") - 5
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = scan.dealt(l.select(F.col("l_partkey").alias("chr"), day.alias("pos"), q.alias("q"), (q * d).alias("qd")), l.count(), "chr")
    return rows.groupBy("chr", "pos").agg(F.count("*").alias("n"), F.sum("q").alias("sw"), F.sum("qd").alias("swb"))


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chr, pos, probe, value``: a chromosome a user, positions in seconds."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chr"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"), F.col("event_id").alias("probe"), F.round("value", 2).alias("value"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``probe, sample, beta``: each embedding scaled to [0, 1] over its 64 samples."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("probe"), F.transform("embedding", lambda x: x.cast("double")).alias("m"))
    p = p.withColumn("lo", F.array_min("m")).withColumn("hi", F.array_max("m")).where("hi > lo")
    return p.select("probe", "lo", "hi", F.posexplode("m").alias("sample", "v")).select("probe", "sample", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("beta"))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping probe manifests ``probe, design, gene, chr, pos``: parts by key, with attributes that partly disagree."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("probe"), F.col("p_type").alias("design"), F.concat_ws(";", "p_brand", F.element_at(F.split("p_name", " "), 1)).alias("gene"), (F.col("p_partkey") % 24 + 1).cast("string").alias("chr"), (F.col("p_partkey") * 137 % 100000).alias("pos"))
    a = p.where("probe % 5 <> 0")
    b = p.where("probe % 7 <> 0").select("probe", F.when(F.col("probe") % 11 == 0, "other").otherwise(F.col("design")).alias("design"), "gene", F.concat(F.lit("chr"), "chr").alias("chr"), (F.col("pos") + (F.col("probe") % 13 == 0).cast("int")).alias("pos"))
    return a, b
