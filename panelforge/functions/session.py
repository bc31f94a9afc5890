"""What a computed table is kept in while several plans read it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the shared checkpoint folder where the session has one, so that no executor's loss matters
    and Spark clears it away with the DataFrame; in memory on a single machine without one."""
    sc = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None:
            return df.persist()
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors have mounted, inside the session's checkpoint folder; a temporary one on a single machine.

    ValueError where the checkpoint folder is in a store that cannot be mounted.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp(prefix=f"panelforge-{name}-")
    path = "/" + named.removeprefix("file:").lstrip("/") if named.startswith("file:") else named
    if "://" in path:
        raise ValueError(f"{named} is not a mounted folder")
    path = os.path.join(path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path
