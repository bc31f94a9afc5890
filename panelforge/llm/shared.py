"""Session plumbing that the operators share: shared storage, partition counts and columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Tables that a Python worker keeps between tasks; the operators that need none drop them.
ENGINES: dict = {}


def tidy() -> None:
    """Give memory that a finished partition freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only on one machine (tests, the bench), where neither the setting nor the
    context has one, is a temporary folder chosen; a cluster without one is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelforge-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark clear away shuffles and checkpoints that nothing refers to any more.

    Its cleaner learns of them when the driver collects garbage; a driver with memory to spare may leave it for half an hour
    (``spark.cleaner.periodicGC.interval``), and a long chain of joins then keeps all its shuffles on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(docs: DataFrame, text: str = "text"):
    """The text as a string; a null text is an empty one."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` does not have."""
    return fresh_of(df.columns, wanted)


def fresh_of(columns: list[str], wanted: str) -> str:
    """A name like ``wanted`` that is not among ``columns``."""
    taken, name, k = {c.lower() for c in columns}, wanted, 0
    while name.lower() in taken:
        k += 1
        name = f"{wanted}_{k}"
    return name


def append_columns(docs: DataFrame, text, values: Callable[..., dict[str, np.ndarray]], types: dict[str, T.DataType], *extra, keep_engines: bool = False) -> DataFrame:
    """``docs`` with new columns computed per Arrow batch from ``text`` (and ``extra`` columns).

    ``text`` is a column, or the name of one of ``docs``: a string column is then read where it passes through, not sent to the worker
    twice (a null in it stays one); any other is cast as by :func:`text_column`.
    ``values`` gets the arrays and returns one array for each name in ``types``.
    Columns of ``docs`` with these names are replaced, all others pass through
    untouched, whatever they are called.  A map over partitions: no shuffle.
    """
    docs = docs.drop(*types)
    n, names = len(docs.columns), list(types)
    inputs, at = [], []
    for k, c in enumerate((text, *extra)):
        if isinstance(c, str):
            if dict(docs.dtypes).get(c) == "string" and docs.columns.count(c) == 1:
                at.append(docs.columns.index(c))
                continue
            c = text_column(docs, c)
        at.append(n + len(inputs))
        inputs.append(c.alias(fresh(docs, f"input_{k}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_engines and ENGINES:
            ENGINES.clear()
            tidy()  # before this stage takes its own
        for batch in batches:
            out = values(*(batch.column(k) for k in at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(out[c] if isinstance(out[c], pa.Array) else pa.array(out[c]) for c in names)], names=[*batch.schema.names[:n], *names])
        tidy()

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in types.items())])
    return docs.select("*", *inputs).mapInArrow(run, schema)
