"""Array scans: the public binary layout of IDAT files (version 3), read through Spark's binary file source."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field codes of the format (fixed values).
COUNT, ADDRESS, SPREAD, MEAN, BEADS = 1000, 102, 103, 104, 107


def parse(data: bytes) -> dict[str, np.ndarray]:
    """``address, mean, sd, beads`` of one file; ValueError where it is no IDAT or is cut short."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:4] != b"IDAT" or struct.unpack_from("<q", data, 4)[0] != 3:
        raise ValueError("not an IDAT file of version 3")
    (n,) = struct.unpack_from("<i", data, 12)
    fields = dict(struct.unpack_from("<Hq", data, 16 + 10 * k) for k in range(n))
    (count,) = struct.unpack_from("<i", data, fields[COUNT])

    def column(code: int, kind: str) -> np.ndarray:
        return np.frombuffer(data, dtype=kind, count=count, offset=fields[code])

    try:
        return {"address": column(ADDRESS, "<i4"), "mean": column(MEAN, "<u2"), "sd": column(SPREAD, "<u2"), "beads": column(BEADS, "u1")}
    except ValueError as e:
        raise ValueError("the IDAT file is cut short") from e


def read_idats(spark: SparkSession, path: str) -> DataFrame:
    """``sample, channel, address, mean, sd, beads``: one row for each address of every file below ``path``.

    Sample and channel come from names such as ``<sample>_Grn.idat.gz``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                stem = name.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".idat")
                sample, _, channel = stem.rpartition("_")
                f = parse(content.as_py())
                n = len(f["address"])
                yield pa.RecordBatch.from_arrays([pa.array([sample] * n), pa.array([channel] * n), *(pa.array(f[c].astype(np.int32)) for c in ("address", "mean", "sd", "beads"))], names=["sample", "channel", "address", "mean", "sd", "beads"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idat*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "sample string, channel string, address int, mean int, sd int, beads int")


def intensities(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """``sample, probe, meth, unmeth`` by a manifest ``probe, address_a, address_b, channel``.

    Two-colour probes (no second address) read both channels at one address;
    one-colour probes read their channel at two.
    """
    s = scans.select("sample", "channel", "address", "mean")
    two = manifest.where("address_b is null").select("probe", F.col("address_a").alias("address"))
    one = manifest.where("address_b is not null")
    both = s.join(two, "address").groupBy("sample", "probe").agg(F.max(F.when(F.col("channel") == "Grn", F.col("mean"))).alias("meth"), F.max(F.when(F.col("channel") == "Red", F.col("mean"))).alias("unmeth"))
    sides = one.select("probe", "channel", F.explode(F.array(F.struct(F.col("address_a").alias("address"), F.lit("unmeth").alias("side")), F.struct(F.col("address_b").alias("address"), F.lit("meth").alias("side")))).alias("x")).select("probe", "channel", "x.*")
    single = s.join(sides, ["address", "channel"]).groupBy("sample", "probe").agg(*(F.max(F.when(F.col("side") == c, F.col("mean"))).alias(c) for c in ("meth", "unmeth")))
    return both.unionByName(single)


def beta_values(df: DataFrame, offset: float = 100.0) -> DataFrame:
    return df.withColumn("beta", F.col("meth") / (F.col("meth") + F.col("unmeth") + offset))
