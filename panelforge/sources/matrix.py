"""Column-major little-endian float64 matrices with a JSON header, as a data source.

``<stem>.f64`` holds the values and ``<stem>_dims.json`` nrow, ncol, order and,
if known, rownames and colnames.  Reading plans one task for each block of rows;
a task reads its rows' slice of every column, so no task holds the matrix.  Writing
is as parallel: tasks write their rows' slices to their places in the file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelforge.functions.session import settled

BLOCK_ROWS = 4096


def header(stem: str) -> dict:
    with open(f"{stem}_dims.json", encoding="utf-8") as f:
        dims = json.load(f)
    if dims.get("order", "F") != "F":
        raise ValueError("only column-major matrices are read")
    want, have = dims["nrow"] * dims["ncol"] * 8, os.path.getsize(f"{stem}.f64")
    if want != have:
        raise ValueError(f"{stem}.f64 has {have} bytes; its header asks for {want}")
    return dims


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class MatrixReader(DataSourceReader):
    def __init__(self, stem: str, block: int):
        self.stem, self.block, self.dims = stem, block, header(stem)

    def partitions(self):
        n = self.dims["nrow"]
        return [_Rows(k, min(n, k + self.block)) for k in range(0, n, self.block)] or [_Rows(0, 0)]

    def read(self, partition):
        n, cols = self.dims["nrow"], self.dims["ncol"]
        names = self.dims.get("rownames")
        view = np.memmap(f"{self.stem}.f64", dtype="<f8", mode="r", shape=(n, cols), order="F") if n * cols else np.empty((n, cols))
        part = np.array(view[partition.lo : partition.hi])
        for k, row in enumerate(part):
            i = partition.lo + k
            yield i, (names[i] if names else None), row.tolist()


class MatrixSource(DataSource):
    """``spark.read.format("panel_f64").option("path", stem)``: row, name, m."""

    @classmethod
    def name(cls) -> str:
        return "panel_f64"

    def schema(self) -> str:
        return "row long, name string, m array<double>"

    def reader(self, schema):
        return MatrixReader(self.options["path"], int(self.options.get("blockrows", BLOCK_ROWS)))


#: Row names up to this many stand in the header; more are a table next to the values.
NAMES = 1_000_000


def read_f64(spark: SparkSession, stem: str, block: int = BLOCK_ROWS) -> DataFrame:
    """``row, name, m`` of a matrix; names come from the header, or from the table that it names."""
    spark.dataSource.register(MatrixSource)
    rows = spark.read.format("panel_f64").option("path", stem).option("blockrows", block).load()
    table = header(stem).get("rownames_table")
    if table is None:
        return rows
    return rows.drop("name").join(spark.read.parquet(table), "row", "left").select("row", "name", "m")


def write_f64(df: DataFrame, stem: str, *, row: str = "row", values: str = "m", name: str | None = None, colnames: list[str] | None = None) -> None:
    """Write a matrix in the order of ``row`` from all tasks at once; ``stem`` lies in a folder that driver and executors share.

    Rows are sorted in ranges; the sizes of these (one number a partition reach the driver) say where each begins, and a task writes its rows'
    stretch of every column to its place.  A task that runs again writes the same bytes to the same places.  Rows of
    unequal length or with missing values are an error; an empty table makes an empty matrix.
    """
    shape = df.agg(F.count("*").alias("n"), F.min(F.size(values)).alias("lo"), F.max(F.size(values)).alias("hi"), F.max(F.exists(values, lambda x: x.isNull()).cast("int")).alias("gap")).first()
    n, cols = shape["n"], shape["hi"] or 0
    if n and (shape["lo"] != shape["hi"] or shape["gap"]):
        raise ValueError("every row of a matrix has one value a column")
    with open(f"{stem}.f64", "wb") as f:
        f.truncate(n * cols * 8)
    picked = [F.col(row).alias("__row"), F.col(values).cast("array<double>").alias("__m"), *([F.col(name).cast("string").alias("__name")] if name else [])]
    laid = settled(df.select(*picked).repartitionByRange(F.col("__row")).sortWithinPartitions("__row")).withColumn("__part", F.spark_partition_id())
    sizes = {r["__part"]: r["count"] for r in laid.groupBy("__part").count().collect()}
    begin, at = {}, 0
    for part in sorted(sizes):
        begin[part], at = at, at + sizes[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        with open(f"{stem}.f64", "r+b") as f:
            for batch in batches:
                k = batch.num_rows
                if not k:
                    continue
                first = begin[batch.column(1)[0].as_py()] + seen
                block = batch.column(0).flatten().to_numpy().astype("<f8").reshape(k, cols).T
                for c in range(cols):
                    os.pwrite(f.fileno(), np.ascontiguousarray(block[c]).tobytes(), (c * n + first) * 8)
                seen += k
                if len(batch.columns) > 2:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + k)), batch.column(2)], names=["row", "name"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([None], pa.string())], names=["row", "name"])
            os.fsync(f.fileno())

    written = laid.select("__m", "__part", *(["__name"] if name else [])).mapInArrow(run, "row long, name string")
    dims: dict = {"nrow": n, "ncol": cols, "order": "F"}
    if name and n > NAMES:
        written.write.mode("overwrite").parquet(f"{stem}_rownames")
        dims["rownames_table"] = f"{stem}_rownames"
    elif name:
        dims["rownames"] = [r["name"] for r in sorted(written.collect(), key=lambda r: r["row"])]  # at most NAMES
    else:
        written.write.format("noop").mode("overwrite").save()
    if colnames:
        dims["colnames"] = colnames
    with open(f"{stem}_dims.json", "w", encoding="utf-8") as f:
        json.dump(dims, f)
