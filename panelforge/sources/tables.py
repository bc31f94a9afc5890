"""Table sources and sinks: CSV, JSON, matrices and object stores."""

from __future__ import annotations

import json
import math
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIASES = {"chr": ("chr", "seqnames", "chromosome", "chrom"), "pos": ("pos", "mapinfo", "start", "position")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be read, by the file system that Spark itself uses."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, *, missing: str | None = None) -> DataFrame:
    """A CSV with header (plain or gzip); an absent file gives an empty table of schema ``missing``, if that is given.

    Without a schema all columns are strings, so that identifiers keep leading zeros.
    """
    if missing is not None and not exists(spark, path):
        return spark.createDataFrame([], missing)
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON document as a dict; {} where it is absent."""
    if not exists(spark, path):
        return {}
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text)


def finite(column):
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def strict_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON string a row, non-finite numbers as null (and nulls written out)."""
    cols = [finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def strict_record(value):
    """A Python value for a run record: non-finite numbers become None, at any depth."""
    if isinstance(value, dict):
        return {k: strict_record(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict_record(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def resolve(df: DataFrame, wanted: str) -> str:
    """The column that stands for ``wanted`` (case-insensitive aliases); ValueError if none does."""
    names = {c.lower(): c for c in df.columns}
    for a in ALIASES.get(wanted, (wanted,)):
        if a in names:
            return names[a]
    raise ValueError(f"no column for {wanted!r} among {df.columns}")


def save_objects(members: dict[str, DataFrame], path: str) -> None:
    """Several named tables in one folder."""
    for name, df in members.items():
        df.write.mode("overwrite").parquet(str(PurePosixPath(path) / name) if "://" not in path else f"{path.rstrip('/')}/{name}")


def load_objects(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def markdown(df: DataFrame, most: int = 1000, digits: int = 4) -> str:
    """A small report table as Markdown; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")

    def cell(v) -> str:
        return "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.{digits}g}" if isinstance(v, float) else str(v)

    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
