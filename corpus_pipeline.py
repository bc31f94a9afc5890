"""From documents to packed token sequences: filter, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``.  Labels are read from ``sf_dir``; models are fitted on the
stage's own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import packing, prefix_join, quality, registry, shared, toxicity

#: Removed ids up to this many are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Near duplicates share this much (per cent) of their shingles of so many words.
NEAR_THRESHOLD, NEAR_WIDTH = 80, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold.

    A null or empty text has no features: it goes or stays by the model's bias alone
    (labels are mostly clean, so it stays).  Texts of any length are scored whole;
    equal texts go or stay together; repeated rows stay repeated; an empty table
    stays empty.  Other columns pass through, whatever they are called.
    """
    name = shared.fresh(docs, "toxicity_score")
    model = toxicity.fit(docs, registry.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose combined quality score reaches the threshold.

    A null or empty text is scored on features of zero; null languages and sources
    as unseen ones.  Rows with equal text, language and source go or stay together;
    repeated rows stay repeated; an empty table stays empty.  Other columns pass
    through, whatever they are called.
    """
    names = tuple(shared.fresh(docs, f"quality_{v}") for v in ("content", "metadata", "score"))
    model = quality.fit(docs, registry.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, names=names).where(F.col(names[2]) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id.

    Rows that share an id are one document and leave one row (the first by their
    JSON text); rows without an id are kept, so are null, empty and blank texts.
    Columns may be of any type and name, an empty table stays empty.
    """
    found = shared.cut(prefix_join.near_duplicates(docs, threshold=NEAR_THRESHOLD, width=NEAR_WIDTH))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("copies"))
    ids = shared.cut(ids.where("component_id <> doc_id or copies > 1"))
    name = shared.fresh(docs, "other_id")
    gone, twice = (ids.where(c).select(F.col("doc_id").alias(name)) for c in ("component_id <> doc_id", "component_id = doc_id"))
    few = gone.count() <= BROADCAST_IDS
    same = F.col("doc_id").cast("long") == F.col(name)
    kept = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    if twice.limit(1).count() == 0:
        return kept
    row = F.struct(*docs.columns)
    single = kept.join(twice, same, "left_semi").groupBy(F.col("doc_id").cast("long").alias(name)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(twice, same, "left_anti").unionByName(single)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids.

    A null or empty text is one piece, the closing id alone; repeated rows and rows
    without an id are packed by themselves; texts of any length are packed whole; an
    empty table gives no rows.
    """
    packed = packing.pack_documents(docs, registry.vocabulary(registry.WORD_VOCABULARY))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
#: Two stages are learned; tests compare the pipeline with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written in the shared folder."""
    shared.ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = registry.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
